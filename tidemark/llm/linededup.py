"""Near-duplicate lines, by an exact set-similarity join in DataFrame operations.

A line is the set of its lower-cased words. Words are ordered by rarity; two sets can only be similar if
the first few words of both, in that order, meet (prefix filter), at places early enough (positional filter), in lines of
like length (length filter), and if the parity bitmaps of the sets differ in few enough bits. A line only needs one
similar line before it, so the joins are semi joins: no row is ever made for a pair, however many lines are alike.
The whole sets are compared in the condition of the last one, and of similar lines all but the first in the corpus are removed.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.plans.shared import bounded, packed, released, stored, unpacked

#: Similarity in percent.
PERCENT = 80
#: Words are counted in 2 ** COUNTER_BITS hashed counters, a fixed size whatever the corpus.
COUNTER_BITS = 15
#: Lists of line numbers are broadcast up to this many entries in all; more are joined by shuffle.
LISTS_BROADCAST = 1_000_000
WIDE = ("map0", "map1")
NO_ID = -(1 << 63)


def normal(low: Column) -> Column:
    """Words of a lower-cased line parted by one space; the pattern runs only on lines that need it."""
    low = F.trim(low)
    odd = low.contains("  ") | low.contains("\t") | low.contains("\r") | low.contains("\f") | low.contains("\x0b")
    return F.when(odd, F.trim(F.regexp_replace(low, r"[ \t\n\x0B\f\r]+", " "))).otherwise(low)


def once(value: Column) -> Column:
    """A generator of one row: the optimiser can't copy the value into the filters and projections behind it."""
    return F.explode(F.array(value))


def word_classes(lines: DataFrame) -> Column:
    """Of lower-cased ``raw`` lines: rarity class (0-127, by the logarithm of the count) of every counter, as a constant array.

    Words, parted by spaces, are counted over all lines; only the counters, of which there are 2 ** COUNTER_BITS for any
    corpus, reach the driver."""
    size = 1 << COUNTER_BITS
    counter = F.xxhash64("w").bitwiseAND(F.lit(size - 1)).cast("int")
    counted = lines.select(F.explode(F.split("raw", " ")).alias("w")).groupBy(counter.alias("counter")).agg(F.count("*").alias("n"))
    classes = [0] * size
    for r in counted.select("counter", F.least(F.lit(127), F.floor(3 * F.log2(1 + F.col("n")))).alias("class")).collect():
        classes[r["counter"]] = r["class"]
    return F.split(F.lit(" ".join(map(str, classes))), " ").cast("array<int>")  # folded by the optimiser


def sorted_words(norm: Column, classes: Column) -> Column:
    """Distinct words as 64-bit keys, rare words first: the class in front, then 56 bits of the word's hash."""

    def key(h):
        rarity = F.get(classes, h.bitwiseAND(F.lit((1 << COUNTER_BITS) - 1)).cast("int"))
        return F.shiftleft(rarity.cast("long"), 56).bitwiseOR(F.shiftrightunsigned(h, 8))

    return F.sort_array(F.transform(F.array_distinct(hashed_words(norm)), key))


def hashed_words(norm: Column) -> Column:
    return F.transform(F.split(norm, " "), lambda w: F.xxhash64(w))


def on_lists(docs: DataFrame, lists: DataFrame, how: str) -> DataFrame:
    """Joins documents with (doc, text_hash, listed) rows, by broadcast while those hold few numbers."""
    entries = lists.agg(F.coalesce(F.sum(F.size("listed") + 1), F.lit(0))).first()[0]
    return docs.join(F.broadcast(lists) if entries <= LISTS_BROADCAST else lists, ["doc", "text_hash"], how)


def bitmap(words: str, part: int) -> Column:
    """One of two parts of a parity bitmap of 128 bits: a word flips the bit that its hash names."""
    return F.expr(f"aggregate({words}, 0L, (acc, w) -> if((w & 64) = {64 * part}, acc ^ shiftleft(1L, int(w & 63)), acc))")


def room(percent: int) -> Column:
    """Of a row with ``n`` words, whose prefix word is at place ``at``: the most words of a line that can be similar if this word is the first
    of the common ones. Of two such sets of a and b words, percent * (a + b) / (100 + percent) are common at least, and n - at at most."""
    return F.expr(f"int(({100 + percent} * (n - at) - {percent} * n) div {percent})")


def plausible(percent: int, maps: tuple[str, ...]) -> Column:
    """Whether rows a and b of one prefix word can belong to similar lines: length, positional and bitmap filter, in whole numbers.

    The ``room`` of both rows holds the first two filters. Bits that differ are even or odd as the sizes' sum is, so their
    bound needs no rounding."""
    differ = reduce(add, [F.bit_count(F.col(f"a.{m}").bitwiseXOR(F.col(f"b.{m}"))) for m in maps])
    return (
        (F.col("a.key") == F.col("b.key"))
        & (F.col("a.room") >= F.col("b.n"))
        & (F.col("b.room") >= F.col("a.n"))
        & ((100 + percent) * differ <= (100 - percent) * (F.col("a.n") + F.col("b.n")))
    )


def repeated_lines(light: DataFrame) -> DataFrame:
    """``light`` (doc, text_hash, line, h1, h2: position and digest of a line), with ``repeat``: an equal line is before it."""
    several = light.groupBy("h1", "h2").agg(F.min("doc").alias("first_doc"), F.count("*").alias("n")).where("n > 1")
    several = stored(several.select("h1", "h2", "first_doc"))
    firsts = light.join(bounded(several), ["h1", "h2"]).where("doc = first_doc").groupBy("h1", "h2", "first_doc").agg(F.min(F.struct("text_hash", "line")).alias("first"))
    firsts = stored(firsts)
    at_first = (F.col("doc") == F.col("first_doc")) & (F.struct("text_hash", "line") == F.col("first"))
    marked = light.join(bounded(firsts), ["h1", "h2"], "left").select("doc", "text_hash", "line", "h1", F.coalesce(~at_first, F.lit(False)).alias("repeat"))
    marked = stored(marked)
    released(light, several, firsts)
    return marked


def similar_lines(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc, text_hash, line of each line (numbered from 0) that has an equal or similar line before it in order of doc,
    text_hash and line number. Lines without words have none.

    ``docs`` has doc, text_hash and text (none null); rows equal in the first two are one text. Equal lines are one from the start, so
    a line that a third of all documents share costs one row a partition; the joins see each distinct line once.
    """
    texts = docs
    docs = docs.select("doc", "text_hash", once(F.lower("text")).alias("text"))

    def lines_of(frame):
        return frame.select("doc", "text_hash", *[c for c in ("listed",) if c in frame.columns], F.posexplode(F.split("text", "\n")).alias("line", "raw"))

    norm = once(normal(F.col("raw"))).alias("norm")
    light = stored(lines_of(docs).select("doc", "text_hash", "line", norm).where("norm != ''").select("doc", "text_hash", "line", F.xxhash64("norm").alias("h1"), F.xxhash64(F.lit("second"), "norm").alias("h2")))
    marked = repeated_lines(light)
    # documents whose every line is a first need no list; others list the lines that aren't
    repeats = stored(marked.where("repeat").groupBy("doc", "text_hash").agg(F.collect_list("line").alias("listed")))

    unique = lines_of(on_lists(docs, repeats, "left")).where(F.col("listed").isNull() | ~F.array_contains("listed", F.col("line")))
    ranks = word_classes(unique.select("raw"))
    sets = unique.select(norm).where("norm != ''").select(F.xxhash64("norm").alias("h"), once(sorted_words(F.col("norm"), ranks)).alias("keys"))
    n = F.size("keys")
    bits = F.expr("aggregate(keys, 0L, (acc, k) -> acc ^ shiftleft(1L, int(k & 63)))")
    prefix = F.slice("keys", 1, (n - F.ceil(n * percent / 100) + 1).cast("int"))
    rows = sets.select("h", n.alias("n"), once(bits).alias("bits"), prefix.alias("prefix")).select("h", "n", "bits", F.posexplode("prefix").alias("at", "key"))
    # half of the word's hash will do to meet
    rows = rows.select("h", "n", "bits", room(percent).alias("room"), (F.col("key") % ((1 << 31) - 1)).cast("int").alias("key"))
    # rows of lines that have a partner before or behind them
    met = stored(rows.alias("a").join(rows.alias("b"), plausible(percent, ("bits",)) & (F.col("a.h") != F.col("b.h")), "left_semi"))

    lines = stored(met.select("h").distinct())
    wanted = marked.where("not repeat").join(bounded(lines), F.col("h1") == F.col("h")).groupBy("doc", "text_hash").agg(F.collect_list("line").alias("listed"))
    wanted = stored(wanted)
    held = on_lists(texts, wanted, "inner").select("doc", "text_hash", "listed", once(F.lower("text")).alias("text"))
    full = lines_of(held).where(F.array_contains("listed", F.col("line"))).select("doc", "text_hash", "line", norm)
    # with wider bitmaps, so that few texts have to move
    hashed = once(hashed_words(F.col("norm"))).alias("words")
    full = full.select("doc", "text_hash", "line", "norm", hashed).select(F.xxhash64("norm").alias("h"), "doc", "text_hash", "line", "norm", once(F.array_distinct("words")).alias("words"))
    full = stored(full.select("h", "doc", "text_hash", "line", "norm", *[bitmap("words", k).alias(m) for k, m in enumerate(WIDE)]))
    placed = stored(met.drop("bits").join(bounded(full.drop("norm")), "h"))
    released(repeats, met, lines, wanted)

    place = lambda x: F.struct(F.col(f"{x}.doc"), F.col(f"{x}.text_hash"), F.col(f"{x}.line"))
    earlier = plausible(percent, WIDE) & (place("b") < place("a"))
    # b.h only makes both sides read the same columns, so that one exchange serves both
    tried = stored(placed.alias("a").join(placed.alias("b"), earlier & (F.col("a.h") != F.col("b.h")), "left_semi"))
    same = F.size(F.array_intersect(F.split("a.norm", " "), F.split("b.norm", " ")))

    def decided(tried: DataFrame) -> DataFrame:
        """Lines of ``tried`` rows that have a similar line before them, by the whole sets."""
        keys = stored(tried.select("key").distinct())
        near = stored(placed.join(bounded(keys), "key", "left_semi").alias("b").join(tried.alias("a"), earlier, "left_semi"))
        needed = stored(near.select("h").unionByName(tried.select("h")).distinct())
        norms = full.select("h", "norm").join(bounded(needed), "h", "left_semi")
        pairs = tried.join(norms, "h").alias("a").join(near.join(norms, "h").alias("b"), earlier & ((100 + percent) * same >= percent * (F.col("a.n") + F.col("b.n"))), "left_semi")
        found = stored(pairs.select("h", "doc", "text_hash", "line").distinct())
        released(keys, near, needed)
        return found

    # the first prefix word that met another line settles most lines; the rest try their other words
    firsts = stored(tried.groupBy("h").agg(F.max("room").alias("most")))
    ordered = stored(tried.join(bounded(firsts), "h"))
    first = decided(ordered.where("room = most").drop("most"))
    second = decided(ordered.where("room < most").drop("most").join(bounded(first.select("h")), "h", "left_anti"))
    gone = stored(marked.where("repeat").select("doc", "text_hash", "line").unionByName(first.unionByName(second).drop("h")).distinct())
    released(marked, full, placed, tried, firsts, ordered, first, second)
    return gone


def dedup_lines(docs: DataFrame, percent: int = PERCENT, count_as: str | None = "lines_removed") -> DataFrame:
    """The rows of ``docs``, all their columns, with ``text`` less the lines that have an equal or similar line
    earlier in the corpus. The number of lines removed is added as ``count_as`` unless that is None; a column
    of ``docs`` with that name is replaced, all others keep their values whatever they are called.

    The order is doc_id, then the text's hash (for rows that share a doc_id), then line number; similarity is Jaccard's over
    distinct lower-cased words (runs of non-white space), at least ``percent``; lines without words always stay. Only the first
    of a chain of similar lines is sure to stay: a line goes for an earlier similar one even if that goes too.
    Null texts stay null with 0 removed; null doc_ids come before all others; rows equal in doc_id and text are
    one text, so they keep and lose the same lines, and rows that share only the doc_id are different texts. If all lines go, text is "".
    """
    id_col = F.coalesce("doc_id", F.lit(NO_ID).cast("long"))
    keyed = packed(docs, doc=id_col, text_hash=F.xxhash64("text"))
    gone = similar_lines(docs.where("text is not null").select(id_col.alias("doc"), F.xxhash64("text").alias("text_hash"), "text"), percent)
    lists = stored(gone.groupBy("doc", "text_hash").agg(F.collect_list("line").alias("listed")))
    released(gone)
    joined = on_lists(keyed, lists, "left")
    text, listed = F.col("row")["text"], F.col("listed")
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda line, i: ~F.array_contains("listed", i)), "\n")
    changed = {"text": F.when(listed.isNull() | text.isNull(), text).otherwise(kept)}
    if count_as:
        changed[count_as] = F.when(listed.isNull() | text.isNull(), 0).otherwise(F.size("listed"))
    return unpacked(joined, docs.columns, **changed)
