"""Secret scans: fixed patterns, and Markov models that tell random strings from ordinary identifiers.

Two first-order character models are counted from labelled samples: one over random strings (values of pattern matches
and generated keys), one over ordinary strings (long words of the corpus, and identifiers, paths, dates and versions
made of words and numbers). A fifth of the samples, by hash, is held out of the counts; the threshold for the
log-likelihood ratio per character lies midway between the least that lets at most FALSE_ALARMS of the held-out ordinary
samples pass and the greatest that lets RECALL of the held-out random ones pass. A token over it is reported as ``markov`` if no pattern covers it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.plans.shared import stored

#: Kinds in the order in which spans with one start are listed.
KINDS = ("assign", "access", "hex", "markov")
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A run that is too short fails as a whole, so the least lengths can stand in these two patterns.
PATTERNS = {"assign": ASSIGN, "access": "AKIA[A-Z0-9]{16,}", "hex": "[0-9a-f]{24,}"}
TOKEN = "[A-Za-z0-9+/_=-]"
#: Tokens that the models judge: 16 characters or more with a letter.
CANDIDATE = rf"(?<!{TOKEN})(?=[0-9+/_=-]*[A-Za-z]){TOKEN}{{16,}}"
ORDINARY = rf"(?<!{TOKEN})[A-Za-z_-]{{12,}}(?!{TOKEN})"
#: Samples generated of each kind; counts that back a model's row off; share of held-out ordinary samples that may pass, and of
#: random ones that should; parts of which one is held out; width of the bins, in nats per character, in which the threshold is sought.
GENERATED, BACKOFF, FALSE_ALARMS, RECALL, PARTS, BIN = 4000, 2.0, 0.002, 0.98, 5, 0.02
#: Words that identifiers are made of.
WORDS = (
    "access account action api app archive array article auth aws backup base batch block bucket buffer build byte cache chain channel char check chunk ci class client code column commit config connection content "
    "copy count cursor data database date default delete digest domain entry error event export field file filter format function group handler hash header host http https id image import index input instance "
    "item job json key label layer length level library limit line link list local log main map master memory message meta method mode model module mysql name node number object offset option order output page "
    "param parent part path payload port prefix process profile project property query queue range rate record region release remote report request resource response result role root route row rule s3 sample schema "
    "script search section server service session set sha256 size source stage state status storage stream string suffix system table tag target task template temp test text thread time token total trace type "
    "unicode update upload url user utf8 utf8mb4 uuid value vector version view volume worker www xml zone"
).split()
#: Code points of the stretches in which candidates and base spans of a text meet.
STRETCH = 4096
#: Characters of the models, without and with the start mark.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"

SPAN = "array<struct<kind int, start int, stop int, value string>>"


def spans_of(text: Column, pattern: str, kind: int, keep=None) -> Column:
    """Matches of a pattern with code point positions. Matches are fenced by two control characters (which the
    text itself has been cleared of), the fences split, and positions summed up over the pieces. Work grows with the matches to the power 1.5."""
    length = lambda piece: (F.length(piece) - 1).cast("int")

    def grouped(pieces):
        """A list grows by copying, so the pieces are taken in groups of the root of their number."""
        matches = F.size(pieces) - 1
        group = F.greatest(F.ceil(F.sqrt(matches)), F.lit(1)).cast("int")
        groups = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(matches / group).cast("int") - 1, F.lit(0))), lambda g: F.slice(pieces, g * group + 2, group))
        return F.struct(F.length(F.element_at(pieces, 1)).cast("int").alias("first"), groups.alias("groups"))

    def onward(acc, one):
        n = F.aggregate(one, F.lit(0), lambda total, piece: total + length(piece))
        return F.struct((acc.at + n).alias("at"), F.concat(acc.begins, F.array(acc.at)).alias("begins"))

    def step(acc, piece):
        n = F.instr(piece, "\u0002") - 1
        one = F.struct(F.lit(kind).alias("kind"), acc.at.alias("start"), (acc.at + n).cast("int").alias("stop"), F.substring(piece, F.lit(1), n).alias("value"))
        return F.struct((acc.at + length(piece)).alias("at"), F.concat(acc.found, F.array(one)).alias("found"))

    def placed(cut):
        begins = F.aggregate(cut.groups, F.struct(cut["first"].alias("at"), F.array().cast("array<int>").alias("begins")), onward, lambda acc: acc.begins)
        return F.flatten(F.zip_with(cut.groups, begins, lambda one, at: F.aggregate(one, F.struct(at.alias("at"), F.array().cast(SPAN).alias("found")), step, lambda acc: acc.found)))

    # each value that is used again is bound to a lambda's variable, or it would be made again for each element
    pieces = F.split(F.regexp_replace(text, f"(?:{pattern})", "\u0001$0\u0002"), "\u0001")
    found = F.transform(F.transform(F.array(pieces), grouped), placed)[0]
    if keep:
        found = F.filter(found, lambda s: keep(s.value))
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(SPAN))


def long_value(match: Column) -> Column:
    return F.length(F.regexp_extract(match, ASSIGN, 2)) >= 6


def bigrams(token: Column) -> Column:
    """Neighbouring characters, the first behind the start mark ``^``."""
    marked = F.concat(F.lit("^"), token)
    return F.transform(F.sequence(F.lit(1), F.length(token)), lambda i: F.substring(marked, i, F.lit(2)))


def markov_table(random: DataFrame, ordinary: DataFrame) -> DataFrame:
    """pair, llr: ln P(second | first) under the random less the ordinary model, for every pair of the alphabet.

    Both inputs have a ``token`` and a count ``n``. A row of counts is mixed with BACKOFF counts dealt as single
    characters are; the table has 67 * 68 rows.
    """
    spark = random.sparkSession
    chars = F.array(*[F.lit(c) for c in ALPHABET])
    pairs = spark.range(1).select(F.explode(F.concat(chars, F.array(F.lit("^")))).alias("a"), chars.alias("bs")).select("a", F.explode("bs").alias("b"))
    both = random.select("token", "n", F.lit(1).alias("is_random")).unionByName(ordinary.select("token", "n", F.lit(0).alias("is_random")))
    counted = both.select(F.explode(bigrams(F.col("token"))).alias("pair"), "n", "is_random").groupBy("pair").agg(F.sum(F.col("n") * F.col("is_random")).alias("r"), F.sum(F.col("n") * (1 - F.col("is_random"))).alias("o"))
    full = stored(pairs.withColumn("pair", F.concat("a", "b")).join(counted, "pair", "left").select("pair", "a", "b", F.coalesce("r", F.lit(0)).alias("r"), F.coalesce("o", F.lit(0)).alias("o")))
    rows = full.groupBy("a").agg(F.sum("r").alias("ra"), F.sum("o").alias("oa"))
    columns = full.groupBy("b").agg((F.sum("r") + 0.5).alias("rb"), (F.sum("o") + 0.5).alias("ob"))
    totals = columns.agg(F.sum("rb").alias("rt"), F.sum("ob").alias("ot")).first()
    p = lambda n, row, column, total: (F.col(n) + BACKOFF * F.col(column) / F.lit(float(totals[total]))) / (F.col(row) + BACKOFF)
    return full.join(rows, "a").join(columns, "b").select("pair", F.ln(p("r", "ra", "rb", "rt") / p("o", "oa", "ob", "ot")).alias("llr"))


def random_strings(spark, n: int) -> DataFrame:
    """token, n: ``n`` strings each of hex, base64, capitals and digits, letters, and small letters and digits, from digests of a counter."""
    d = spark.range(n).select(F.col("id").cast("string").alias("i")).select("i", F.sha2("i", 256).alias("h"), F.sha2(F.concat(F.lit("second"), "i"), 256).alias("g"))
    size = F.pmod(F.xxhash64("i"), F.lit(25)) + 16
    plain = F.translate(F.base64(F.unhex("h")), "+/=", "")
    letters = F.translate(F.concat(plain, F.base64(F.unhex("g"))), "0123456789+/=", "qXzKvJwYbG")
    small = F.translate(F.concat("h", "g"), "abcdef0123456789", "kq7xw2m9vzt4pjs8")
    kinds = F.array(F.substring("h", 1, 40), F.substring(F.base64(F.unhex("h")), 1, 40), F.translate(F.substring("h", 1, 20), "abcdef0123", "QXKZJWMPVT"), letters.substr(F.lit(1), size.cast("int")), small.substr(F.lit(1), size.cast("int")))
    return d.select(F.explode(kinds).alias("token"), F.lit(1).alias("n"))


def identifiers(spark, n: int) -> DataFrame:
    """token, n: ``n`` strings each of five kinds of ordinary identifier: snake case, paths, camel case, dates, versions."""
    words = F.array(*[F.lit(w) for w in WORDS])
    pick = lambda k: F.element_at(words, (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(WORDS))) + 1).cast("int"))
    number = lambda k, most: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(most))
    two = lambda k, most: F.lpad(number(k, most).cast("string"), 2, "0")
    digits = F.substring(number(9, 10**9).cast("string"), 1, (number(8, 7) + 1).cast("int"))
    kinds = F.array(
        F.concat_ws("_", pick(1), pick(2), pick(3), pick(4), digits),
        F.concat(pick(1), F.lit("/"), pick(2), F.lit("/"), pick(3), F.lit("/"), pick(4), digits),
        F.concat(pick(1), F.initcap(pick(2)), F.initcap(pick(3)), F.initcap(pick(4)), digits),
        F.concat((1990 + number(5, 50)).cast("string"), F.lit("-"), two(6, 12), F.lit("-"), two(7, 28), F.lit("T"), two(8, 24), F.lit("-"), two(9, 60), F.lit("-"), two(10, 60)),
        F.concat_ws("-", pick(1), pick(2), pick(3), F.concat(F.lit("v"), number(4, 20)), number(5, 30).cast("string"), number(6, 1000).cast("string")),
    )
    return spark.range(n).select(F.explode(kinds).alias("token"), F.lit(1).alias("n"))


def leads(tokens: DataFrame, model: DataFrame) -> DataFrame:
    """token, lead of distinct tokens: mean log-likelihood ratio of their characters, in nats."""
    return tokens.select("token", F.explode(bigrams(F.col("token"))).alias("pair")).join(F.broadcast(model), "pair").groupBy("token").agg(F.avg("llr").alias("lead"))


def trained(random: DataFrame, ordinary: DataFrame) -> tuple[DataFrame, float, dict]:
    """The table of ``markov_table`` from four fifths of the samples (token, n), the threshold from the rest, and what it
    gives there: held-out recall and false_alarms. Bins of leads reach the driver, a bounded number."""
    held = F.pmod(F.xxhash64(F.lit("part"), "token"), F.lit(PARTS)) == 0
    model = stored(markov_table(random.where(~held), ordinary.where(~held)))
    bins = {}
    for kind, sample in (("random", random), ("ordinary", ordinary)):
        tested = leads(sample.where(held & (F.length("token") >= 16)).select("token").distinct(), model)
        bins[kind] = {r["bin"]: r["n"] for r in tested.groupBy(F.floor(F.col("lead") / BIN).alias("bin")).agg(F.count("*").alias("n")).collect()}
    total = {k: max(1, sum(v.values())) for k, v in bins.items()}
    passing = lambda kind, at: sum(n for b, n in bins[kind].items() if b >= at) / total[kind]
    edges = range(0, int(3 / BIN) + 1)  # from no lead to three nats a character
    low = next((b for b in edges if passing("ordinary", b) <= FALSE_ALARMS), edges[-1])
    at = (low + max([b for b in edges if b >= low and passing("random", b) >= RECALL], default=low)) // 2
    return model, at * BIN, {"recall": passing("random", at), "false_alarms": passing("ordinary", at), "threshold": at * BIN}


def samples(docs: DataFrame, matched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Random and ordinary samples (token, n): values of ``matched`` pattern spans and generated keys; long words of all
    ``docs`` (column t), as they are and in capitals, and generated identifiers."""
    spark = docs.sparkSession
    known = matched.select(F.when(F.col("s.kind") == 0, F.regexp_extract("s.value", ASSIGN, 2)).otherwise(F.col("s.value")).alias("token"))
    known = known.groupBy(F.regexp_replace("token", "[^A-Za-z0-9+/_=-]", "").alias("token")).agg(F.lit(1).alias("n")).where("token != ''")
    words = docs.select(F.explode(F.regexp_extract_all(F.col("t"), F.lit(ORDINARY), F.lit(0))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    # both kinds weigh alike however large the corpus is: a generated identifier counts for more where there are many words
    share = words.agg(F.greatest(F.lit(1.0), F.sum("n") / F.lit(5.0 * GENERATED)).alias("weight"))
    made = identifiers(spark, GENERATED).join(F.broadcast(share), F.lit(True)).select("token", F.coalesce("weight", F.lit(1.0)).alias("n"))
    return known.unionByName(random_strings(spark, GENERATED)), stored(words.select("token", F.col("n").cast("double").alias("n")).unionByName(words.select(F.upper("token").alias("token"), F.lit(1.0).alias("n"))).unionByName(made))


def scan(docs: DataFrame) -> DataFrame:
    """Every secret in every whole text: one row per row of ``docs`` with doc_id and ``spans``, an array of
    (kind index into KINDS, start, stop, value) by start, then kind; positions in code points, stop exclusive.

    Null text counts as empty and has no spans. Repeated rows are scanned alike; an empty table gives no rows; other
    columns are left out. Model counts cover all documents; only distinct candidate tokens are scored and shuffled.
    """
    text = F.translate(F.coalesce("text", F.lit("")), "\u0001\u0002", "\u0003\u0003")
    rows = docs.select("doc_id", text.alias("t"))
    t = F.col("t")
    base = F.concat(spans_of(t, PATTERNS["assign"], 0, long_value), spans_of(t, PATTERNS["access"], 1), spans_of(t, PATTERNS["hex"], 2))
    scanned = rows.select("doc_id", F.xxhash64("t").alias("key"), base.alias("base"), spans_of(t, CANDIDATE, 3).alias("maybe"))
    scanned = stored(scanned)
    random, ordinary = samples(rows, scanned.select(F.explode("base").alias("s")))
    model, threshold, _ = trained(random, ordinary)

    # a candidate that touches a base span is dropped: both meet in the stretches of STRETCH code points that they touch, so no list is walked for each candidate
    stretches = F.explode(F.sequence(F.floor(F.col("s.start") / STRETCH), F.floor((F.col("s.stop") - 1) / STRETCH))).alias("stretch")
    maybe = stored(scanned.select("doc_id", "key", F.explode("maybe").alias("s")).distinct())
    fixed = scanned.where(F.size("maybe") > 0).select(F.col("doc_id").alias("base_doc"), F.col("key").alias("base_key"), F.explode("base").alias("s"))
    fixed = fixed.select("base_doc", "base_key", F.col("s.start").alias("base_start"), F.col("s.stop").alias("base_stop"), stretches.alias("base_stretch"))
    same = F.col("doc_id").eqNullSafe(F.col("base_doc")) & (F.col("key") == F.col("base_key")) & (F.col("stretch") == F.col("base_stretch"))
    touched = maybe.select("doc_id", "key", "s", stretches).join(fixed, same & (F.col("base_start") < F.col("s.stop")) & (F.col("s.start") < F.col("base_stop")), "left_semi")
    touched = touched.select(F.col("doc_id").alias("gone_doc"), F.col("key").alias("gone_key"), F.col("s.start").alias("gone_start")).distinct()
    maybe = maybe.join(touched, F.col("doc_id").eqNullSafe(F.col("gone_doc")) & (F.col("key") == F.col("gone_key")) & (F.col("s.start") == F.col("gone_start")), "left_anti")
    scored = leads(maybe.select(F.col("s.value").alias("token")).distinct(), model).where(F.col("lead") >= threshold)
    added = maybe.join(scored, maybe["s"]["value"] == scored["token"]).groupBy(F.col("doc_id").alias("of_doc"), F.col("key").alias("of_key")).agg(F.collect_list("s").alias("added"))
    joined = scanned.join(added, F.col("doc_id").eqNullSafe(F.col("of_doc")) & (F.col("key") == F.col("of_key")), "left")
    return joined.select("doc_id", sorted_spans(F.concat("base", F.coalesce("added", F.array().cast(SPAN)))).alias("spans"))


def sorted_spans(spans: Column) -> Column:
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s.start.alias("start"), s.kind.alias("kind"), s.stop.alias("stop"), s.value.alias("value"))))
    return F.transform(ordered, lambda s: F.struct(s.kind.alias("kind"), s.start.alias("start"), s.stop.alias("stop"), s.value.alias("value")))


def listed(spans: Column) -> Column:
    """``kind:start:stop`` joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s.kind + 1), s.start, s.stop)), ",")
