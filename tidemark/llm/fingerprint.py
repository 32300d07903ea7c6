"""Exact document fingerprints: one canonical form, a 128-bit digest of it, bytes compared where digests agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.manifest import ranked
from tidemark.plans.shared import bounded, stored

#: Consecutive ids that one window group holds when documents are put in order.
RUN = 1024
#: Run heads are broadcast up to this many rows (16 bytes each); more are joined by shuffle.
HEADS_BROADCAST = 500_000


def canonical(text: Column) -> Column:
    """NFC, full case folding, each run of white space one space, trimmed; null counts as empty. Folding makes STRASSE and straße one text, which
    lower case would not."""
    plain = F.octet_length(text) == F.length(text)
    composed = lambda t: F.call_function("java_method", F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), t, F.lit(False))
    folded = F.call_function("java_method", F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), composed(text), F.lit(True))
    # plain ASCII is its own normal form, and folds to lower case; a folded text may need composing again
    same = F.when(plain, F.lower(text)).otherwise(composed(folded))
    return F.coalesce(F.trim(F.regexp_replace(same, r"(?U)\s+", " ")), F.lit(""))


def digest(canon: Column) -> Column:
    """32 hex digits: xxhash64 under two independent seeds."""
    half = lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")
    return F.concat(half(F.xxhash64(canon)), half(F.xxhash64(F.lit("wide"), canon)))


def likeness(a: Column, canon_a: Column, b: Column, canon_b: Column) -> Column:
    """1.0 where digests and then canonical bytes are equal, else 0.0: an exact digest has nothing between."""
    return F.when((a == b) & (canon_a == canon_b), 1.0).otherwise(0.0)


def canonical_rows(docs: DataFrame) -> DataFrame:
    """doc_id, canon, fingerprint of every row."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("canon", canonical(F.col("text")))
    return rows.select("doc_id", "canon", digest(F.col("canon")).alias("fingerprint"))


def shared_groups(docs: DataFrame) -> DataFrame:
    """fingerprint, canon, group_doc, group_size, kinds of the texts that several rows have, stored.

    Digests are counted first, with partial counts, so a group of any size costs a row a partition. Only buckets of two or
    more rows go on: they are grouped by the canonical bytes themselves. ``kinds`` is how many texts a bucket holds; canon is
    null where that is one, so texts are written for colliding digests alone.
    """
    rows = canonical_rows(docs)
    several = stored(rows.groupBy("fingerprint").agg(F.count("*").alias("n")).where("n > 1").select("fingerprint"))
    texts = rows.join(bounded(several), "fingerprint", "left_semi").groupBy("fingerprint", "canon").agg(F.min("doc_id").alias("group_doc"), F.count("*").alias("group_size"))
    kinds = F.count("*").over(Window.partitionBy("fingerprint"))
    return stored(texts.withColumn("kinds", kinds).withColumn("canon", F.when(F.col("kinds") > 1, F.col("canon"))))


def with_groups(rows: DataFrame, docs: DataFrame, canon: str, columns: list[str]) -> DataFrame:
    """``columns`` of ``rows``, which have doc_id, fingerprint and the column ``canon``, with group_doc and group_size behind."""
    found = shared_groups(docs)
    single = found.where("kinds = 1").select("fingerprint", F.col("group_doc").alias("one_doc"), F.col("group_size").alias("one_size"))
    collided = found.where("kinds > 1").select(F.col("fingerprint").alias("of"), "canon", F.col("group_doc").alias("other_doc"), F.col("group_size").alias("other_size"))
    doc, size = F.col("one_doc"), F.col("one_size")
    if collided.limit(1).count():
        rows = rows.withColumnRenamed(canon, "bytes").join(bounded(collided), (F.col("fingerprint") == F.col("of")) & (F.col("bytes") == F.col("canon")), "left").select(*columns, "other_doc", "other_size")
        doc, size = F.coalesce("one_doc", "other_doc"), F.coalesce("one_size", "other_size")
    else:
        rows = rows.select(*columns)
    joined = rows.join(bounded(single), "fingerprint", "left")
    return joined.select(*columns, F.coalesce(doc, F.col("doc_id")).alias("group_doc"), F.coalesce(size, F.lit(1)).alias("group_size"))


def duplicate_groups(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, group_doc (smallest doc_id with the same canonical bytes), group_size, for every row.

    Null and empty texts form one group; a null doc_id never leads a group unless all its rows are null; repeated
    rows count each time; an empty table gives no rows.
    """
    return with_groups(canonical_rows(docs), docs, "canon", ["doc_id", "fingerprint"])


def with_next_text(docs: DataFrame) -> DataFrame:
    """doc_id, text, next_text: the text of the next document by descending doc_id; after the last comes the first.

    Rows lie in runs of RUN ids, so no task sorts more than a run. The head of each run is also dealt to the run
    above it (the topmost head to the lowest run) as a guest behind that run's own rows. Runs are put in order by range partitions, so ids may be as sparse as
    they like. Null ids come last, in one run; equal ids follow one another by text. One row alone is its own next.
    """
    runs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.floor(F.col("doc_id") / RUN), F.lit(-(1 << 60))).alias("run"))
    heads = ranked(stored(runs.groupBy("run").agg(F.max("doc_id").alias("doc_id"))), "run")
    heads = stored(heads)
    n = heads.count()
    above = heads.select(F.col("run").alias("host"), F.pmod(F.col("rank") - 1, F.lit(max(n, 1))).alias("rank"))
    up = heads.join(above, "rank").select(F.col("run").alias("from_run"), F.col("doc_id").alias("head"), "host")
    if n <= HEADS_BROADCAST:
        up = F.broadcast(up)
    hosts = runs.join(up, (F.col("run") == F.col("from_run")) & F.col("doc_id").eqNullSafe(F.col("head")), "left").select("doc_id", "text", "run", "host")
    dealt = hosts.select("doc_id", "text", F.explode(F.when(F.col("host").isNull(), F.array(F.struct(F.col("run"), F.lit(False).alias("guest")))).otherwise(F.array(F.struct(F.col("run"), F.lit(False).alias("guest")), F.struct(F.col("host").alias("run"), F.lit(True).alias("guest"))))).alias("at"))
    order = Window.partitionBy("at.run").orderBy("at.guest", F.col("doc_id").desc_nulls_last(), "text")
    return dealt.withColumn("next_text", F.lead("text").over(order)).where("not at.guest").select("doc_id", "text", "next_text")


def edited(text: Column, next_text: Column) -> Column:
    """``text`` with its last third (rounded down) replaced by as many leading code points of ``next_text``, or all of it."""
    third = F.floor(F.length(text) / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - third), F.substring(next_text, F.lit(1), third))


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint beside those of its edited text and of the next document (see ``with_next_text``).

    Returns doc_id, n_chars, edited (the text), fingerprint, edited_fingerprint, near_edited, near_next, group_doc, group_size
    (see ``duplicate_groups``). Null text counts as empty; an empty table gives no rows; repeated rows stay; other
    columns are left out.
    """
    t, nxt, e = F.col("text"), F.col("next_text"), F.col("edited")
    rows = with_next_text(docs).withColumn("edited", edited(t, nxt)).select("*", canonical(t).alias("c"), canonical(e).alias("ce"), canonical(nxt).alias("cn"))
    rows = rows.select("*", digest(F.col("c")).alias("fingerprint"), digest(F.col("ce")).alias("edited_fingerprint"), digest(F.col("cn")).alias("nf"))
    near = lambda digested, canon: likeness(F.col("fingerprint"), F.col("c"), F.col(digested), F.col(canon))
    rows = rows.select("doc_id", F.length(t).cast("long").alias("n_chars"), "edited", "fingerprint", "edited_fingerprint", near("edited_fingerprint", "ce").alias("near_edited"), near("nf", "cn").alias("near_next"), "c")
    return with_groups(rows, docs, "c", ["doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
