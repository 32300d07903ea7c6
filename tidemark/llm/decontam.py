"""Benchmark decontamination by templates, in DataFrame operations.

Numbers, names and units become typed placeholders; short windows of the resulting template tokens are hashed and
joined with the benchmark's. A hit names a diagonal, along which the whole item is then compared token by token, so that edited
copies are found too. A placeholder counts with another value only if its diagonal maps each benchmark value to one
value in the document, so a question asked again with other numbers is caught and a chance meeting of patterns is not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.rows import keyed, opened, without
from tidemark.plans.shared import bounded, stored

#: Template tokens of a window; least literal tokens in one; share of an item's windows that a document must hold.
WINDOW, LITERALS, COVERAGE = 8, 4, 0.5
#: Template tokens of a candidate window: n tokens with (n - 4) / 4 changed ones or fewer have a whole one. Share of an item's tokens kept in one place.
SEED, KEPT = 4, 0.7
#: Diagonals this far from one with a hit are compared too, for words put in or left out close to each other.
NEAR = 2
NO_ID = -(1 << 63)
#: Units of measure, lower case.
UNITS = "mm cm m km in ft yd mi mg g kg t lb oz ml l s sec min h hr day days week weeks month months year years hour hours minute minutes second seconds meter meters metre metres kilometer kilometers mile miles foot feet inch inches gram grams kilogram kilograms pound pounds ounce ounces liter liters litre litres dollar dollars cent cents euro euros percent degree degrees watt watts volt volts hz khz mhz ghz kb mb gb tb".split()
#: Characters behind which a capital starts a sentence.
STARTS = ".!?:\n\r\t\"“«( "


def raw_tokens(text: Column) -> Column:
    """Words and numbers; a word at the start of a sentence keeps the mark in front of it."""
    return F.regexp_extract_all(text, F.lit(r"""\p{N}+(?:[.,:]\p{N}+)*|(?:^|[.!?:\n\r"“«(]\s*)?[\p{L}\p{M}]+"""), F.lit(0))


def plain(token: Column) -> Column:
    return F.ltrim(F.lower(token), F.lit(STARTS))


def template(tokens: Column) -> Column:
    """Template tokens: <n> for numbers, <u> for units behind a number, <name> for capitalised words inside a sentence, else the word."""
    number = lambda t: ((c := F.substring(t, F.lit(1), F.lit(1))).between("0", "9")) | ((c > "~") & c.rlike(r"^\p{N}"))

    def each(all_of):
        def one(t, i):
            c, second, low = F.substring(t, F.lit(1), F.lit(1)), F.substring(t, F.lit(2), F.lit(1)), plain(t)
            name = (c != F.lower(c)) & (F.length(t) > 1) & (second == F.lower(second)) & (i > 0)
            return F.when(number(t), "<n>").when(name, "<name>").when(low.isin(UNITS) & (i > 0) & number(F.get(all_of, i - 1)), "<u>").otherwise(low)

        return F.transform(all_of, one)

    return F.transform(F.array(tokens), each)[0]  # bound once, or the tokens would be made again for each


def windows(tokens: Column, size: Column | int) -> Column:
    """(at, hash) of every window of ``size`` tokens, from 0; none if there are fewer."""
    size = F.lit(size) if isinstance(size, int) else size
    starts = F.when(F.size(tokens) >= size, F.sequence(F.lit(0), F.size(tokens) - size)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.struct(i.alias("at"), F.xxhash64(size, F.slice(tokens, i + 1, size)).alias("hash")))


def benchmark_windows(benchmark: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Items (item_id, item_raw, item_template, n, size, whole: starts of their windows), their candidate windows (item_id, item_at, hash, size), and windows of
    tokens as written for the items of SEED tokens or more that have no candidate window."""
    items = benchmark.where("text is not null").select("item_id", raw_tokens(F.col("text")).alias("item_raw")).withColumn("item_template", template(F.col("item_raw")))
    items = items.where(F.size("item_template") > 0).withColumn("n", F.size("item_template")).withColumn("size", F.least(F.lit(WINDOW), F.col("n")))
    literals = lambda at, size: F.size(F.filter(F.slice("item_template", at + 1, size), lambda t: ~t.startswith("<")))
    whole = F.filter(F.sequence(F.lit(0), F.col("n") - F.col("size")), lambda i: literals(i, F.col("size")) >= F.least(F.lit(LITERALS), F.col("size")))
    items = stored(items.withColumn("whole", whole))
    seeds = items.select("item_id", "item_template", F.least(F.lit(SEED), F.col("n")).alias("size"))
    spread = seeds.select("item_id", "size", "item_template", F.explode(windows(F.col("item_template"), F.col("size"))).alias("w")).where(literals(F.col("w.at"), F.col("size")) >= F.least(F.lit(LITERALS * SEED // WINDOW), F.col("size")))
    spread = stored(spread.select("item_id", F.col("w.at").alias("item_at"), F.col("w.hash").alias("hash"), "size"))
    # items of numbers and names alone have no template that tells them: copies of them are looked for by their tokens as they are
    bare = items.where(F.col("n") >= SEED).join(spread.select("item_id").distinct(), "item_id", "left_anti").select("item_id", F.explode(windows(as_written(F.col("item_raw")), SEED)).alias("w"))
    return items, spread, stored(bare.select("item_id", F.col("w.at").alias("item_at"), F.col("w.hash").alias("hash"), F.lit(SEED).alias("size")))


def as_written(tokens: Column) -> Column:
    """Tokens for windows that no placeholder may match."""
    return F.transform(tokens, lambda t: F.concat(F.lit("="), plain(t)))


def along_diagonals(hits: DataFrame, rows: DataFrame, items: DataFrame) -> DataFrame:
    """doc, item_id, n, shift, same, kept, found, changed of every diagonal with or near a hit: item positions with the same
    word in the document (without a hit, two such words in a row); those and the placeholders of hit windows with another value, if no value stands for two; starts
    of the item's windows that are kept whole; number of values changed."""
    diagonals = hits.groupBy("doc", "item_id", (F.col("at") - F.col("item_at")).alias("shift")).agg(F.collect_set(F.struct("item_at", "size")).alias("seeds"))
    beyond = F.transform(F.sequence(F.lit(-NEAR), F.lit(NEAR)), lambda k: F.struct((F.col("shift") + k).alias("shift"), F.when(k == 0, F.col("seeds")).otherwise(F.slice("seeds", 1, 0)).alias("seeds")))
    diagonals = diagonals.select("doc", "item_id", F.explode(beyond).alias("d")).groupBy("doc", "item_id", "d.shift").agg(F.flatten(F.collect_list("d.seeds")).alias("seeds"))
    held = stored(diagonals.groupBy("doc").agg(F.collect_list(F.struct("item_id", "shift", "seeds")).alias("diagonals")))
    texts = rows.join(bounded(held), "doc").select("doc", "diagonals", F.explode(F.array(raw_tokens(F.col("text")))).alias("raw"))
    texts = texts.select("doc", "diagonals", "raw", F.explode(F.array(template(F.col("raw")))).alias("t"))
    off = F.greatest(F.lit(0), -F.col("d.shift"))  # item tokens before the start of the text
    placed = texts.select("doc", "raw", "t", F.explode("diagonals").alias("d")).select("doc", "raw", "t", "d.*", off.alias("off")).join(bounded(items), "item_id")
    # the part of the text beside the item; a row of the same doc_id with another text may be shorter
    part = lambda c: F.slice(c, F.col("shift") + F.col("off") + 1, F.greatest(F.lit(0), F.col("n") - F.col("off")))
    placed = placed.select("doc", "item_id", "n", "size", "whole", "shift", "seeds", "off", "item_raw", "item_template", F.transform(part("raw"), plain).alias("beside"), part("t").alias("t")).where((F.col("off") < F.col("n")) & (F.size("beside") > 0))

    def compare(word, k):
        at = k + F.col("off")
        of, kind = plain(F.element_at("item_raw", at + 1)), F.element_at("item_template", at + 1)
        hit = F.exists("seeds", lambda w: (w["item_at"] <= at) & (at < w["item_at"] + w["size"]))
        return F.struct(at.alias("at"), of.alias("of"), word.alias("is"), (kind.startswith("<") & (kind == F.element_at("t", k + 1)) & hit).alias("slot"))

    compared = placed.select("doc", "item_id", "n", "size", "whole", "shift", (F.size("seeds") > 0).alias("hit"), F.explode(F.array(F.transform("beside", compare))).alias("c"))
    slots = F.array_distinct(F.transform(F.filter("c", lambda x: x["slot"]), lambda x: F.struct(x["of"], x["is"])))
    compared = compared.select("doc", "item_id", "n", "size", "whole", "shift", "hit", "c", F.explode(F.array(slots)).alias("slots"))
    different = lambda side: F.size(F.array_distinct(F.transform("slots", lambda s: s[side])))
    consistent = (F.size("slots") == different("of")) & (F.size("slots") == different("is"))
    compared = compared.withColumn("consistent", consistent)
    at = lambda test: F.transform(F.filter("c", test), lambda x: x["at"])
    kept = at(lambda x: (x["of"] == x["is"]) | (x["slot"] & F.col("consistent")))
    changed = F.when(F.col("consistent"), F.size(F.filter("slots", lambda s: s["of"] != s["is"]))).otherwise(0)
    full = compared.select("doc", "item_id", "n", "size", "whole", "shift", "hit", at(lambda x: x["of"] == x["is"]).alias("same"), kept.alias("kept"), changed.alias("changed"))
    paired = lambda c: F.when(F.col("hit"), F.col(c)).otherwise(F.filter(c, lambda p: F.array_contains(F.col(c), p - 1) | F.array_contains(F.col(c), p + 1)))
    full = full.select("doc", "item_id", "n", "size", "whole", "shift", paired("same").alias("same"), F.explode(F.array(paired("kept"))).alias("kept"), "changed")
    found = F.filter("whole", lambda i: F.size(F.array_intersect("kept", F.sequence(i, i + F.col("size") - 1))) == F.col("size"))
    return full.where(F.size("kept") > 0).withColumn("found", found)


def matches(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, share: float = KEPT) -> DataFrame:
    """doc_id, item_id, coverage, windows_found, first_token, last_token, changed_slots for every document and benchmark
    item it holds: ``share`` of the item's tokens or more in one place, or ``coverage`` of its windows anywhere.

    Whole texts are read. One place is the diagonals whose shifts differ by up to half the item's length, so words may be
    replaced, put in and left out; at least WINDOW tokens (of a shorter item, all) must be kept, LITERALS of them as they
    are. An item shorter than a window is one window of its own length. Windows with fewer than LITERALS words of
    WINDOW aren't counted, and candidate windows with fewer than half words not looked for; an item that has no other ones is found by windows of
    its tokens as they are, so as a copy and not with other values, if it has SEED tokens. On a diagonal where one benchmark value stands
    for two document values, or one of the document for two of the item, placeholders count only where the value is unchanged. ``coverage`` is the larger of the two
    shares; first and last token and changed_slots are those of the best place. Null texts and null item texts match
    nothing; repeated rows, and rows that share a doc_id, are one document; null doc_ids are reported as null; extra columns are left out.
    """
    items, wanted, bare = benchmark_windows(benchmark)
    sizes = sorted(r["size"] for r in wanted.select("size").distinct().collect())  # SEED or fewer values
    rows = docs.where("text is not null").select(F.coalesce("doc_id", F.lit(NO_ID).cast("long")).alias("doc"), "text")
    tokens = rows.select("doc", F.explode(F.array(template(raw_tokens(F.col("text"))))).alias("t"))  # one row each: keeps the optimiser from copying the expression
    all_windows = F.concat(*[windows(F.col("t"), s) for s in sizes]) if sizes else F.array().cast("array<struct<at int, hash long>>")
    if bare.limit(1).count():
        tokens = rows.select("doc", F.explode(F.array(raw_tokens(F.col("text")))).alias("raw")).select("doc", F.explode(F.array(F.struct(template(F.col("raw")).alias("t"), as_written(F.col("raw")).alias("raw")))).alias("x")).select("doc", "x.t", "x.raw")
        all_windows = F.concat(all_windows, windows(F.col("raw"), SEED))
        wanted = wanted.unionByName(bare)
    hits = tokens.select("doc", F.explode(F.array(all_windows)).alias("all")).select("doc", F.explode("all").alias("w")).select("doc", F.col("w.at").alias("at"), F.col("w.hash").alias("hash")).join(bounded(wanted), "hash")
    hits = stored(hits.select("doc", "item_id", "at", "item_at", "size").distinct())

    lines = stored(along_diagonals(hits, rows, items))
    # two rows of places, half an item apart, so that diagonals less than that apart meet in one
    place = F.floor((2 * F.col("shift") + F.col("half") * F.col("n")) / (2 * F.col("n")))
    union = lambda c: F.size(F.array_distinct(F.flatten(F.collect_list(c))))
    places = lines.withColumn("half", F.explode(F.array(F.lit(0), F.lit(1)))).groupBy("doc", "item_id", "n", "half", place.alias("place")).agg(
        union("kept").alias("kept"), union("same").alias("same"), F.min(F.col("shift") + F.array_min("kept")).alias("first_token"), F.max(F.col("shift") + F.array_max("kept")).alias("last_token"), F.max("changed").alias("changed_slots")
    )
    enough = (F.col("kept") >= share * F.col("n")) & (F.col("kept") >= F.least(F.lit(WINDOW), F.col("n"))) & (F.col("same") >= F.least(F.lit(LITERALS), F.col("n")))
    best = places.groupBy("doc", "item_id").agg(F.max(F.struct(enough.alias("enough"), (F.col("kept") / F.col("n")).alias("kept_share"), -F.col("first_token"), "first_token", "last_token", "changed_slots")).alias("best")).select("doc", "item_id", "best.enough", "best.kept_share", "best.first_token", "best.last_token", "best.changed_slots")
    counted = lines.select("doc", "item_id", F.size("whole").alias("windows"), F.explode("found").alias("at")).groupBy("doc", "item_id", "windows").agg(F.countDistinct("at").alias("windows_found"))
    both = best.join(counted, ["doc", "item_id"], "left").withColumn("windows_found", F.coalesce("windows_found", F.lit(0).cast("long")))
    window_share = F.when(F.col("windows_found") > 0, F.col("windows_found") / F.col("windows")).otherwise(0.0)
    full = both.withColumn("window_share", window_share).where(F.col("enough") | ((F.col("windows_found") > 0) & (F.col("window_share") >= coverage)))
    return full.select(F.when(F.col("doc") != NO_ID, F.col("doc")).alias("doc_id"), "item_id", F.greatest("kept_share", "window_share").alias("coverage"), "windows_found", "first_token", "last_token", "changed_slots")


def clean(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """The rows of ``docs``, all columns, whose text matches no benchmark item (see ``matches``).

    Each row goes or stays by its own text, also when its doc_id is null or shared; rows with null text stay, and all rows
    do if there is no item.
    """
    rows = keyed(docs)
    found = stored(matches(rows.select("doc_id", "text"), benchmark, coverage).select("doc_id").distinct())
    return opened(without(rows, found), docs.columns)
