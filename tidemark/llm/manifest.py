"""Merkle manifest of a table: levels built as parent-linked node rows, climbed by a recursive query that folds each leaf up to the root."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.shared import bounded, named, stored

#: Consecutive nodes that become one.
FAN = 16
#: Consecutive leaves that look for their upper nodes together: each node is stored once for each such part that it covers, so the join on
#: (node, part) has no hot key although all leaves meet in the root.
PART = 1 << 16
HEX = 64
#: Node rows, of 1.2 kB at most, that are broadcast; more are joined by shuffle.
NODES_BROADCAST = 50_000
#: Number of the first level over the sources' roots; levels inside sources lie below.
OVER = 1000


def digest(*values: Column) -> Column:
    """Lower-case hex SHA-256 of the values, each as its UTF-8 byte count, ``:`` and itself, or ``-`` for null."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]), 256)


def ranked(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` (stored) with ``rank``, their place from 0 in the order of the columns ``order``: range partitions, and one count a partition through the driver."""
    placed = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("placed", F.monotonically_increasing_id()))
    part = F.shiftright("placed", 33)
    counts = sorted((r.part, r.n) for r in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    before = [(p, sum(n for _, n in counts[:i])) for i, (p, _) in enumerate(counts)]
    offsets = F.broadcast(rows.sparkSession.createDataFrame(before, "part long, before long"))
    return placed.join(offsets, part == F.col("part")).withColumn("rank", F.col("before") + F.col("placed").bitwiseAND((1 << 33) - 1)).drop("placed", "part", "before")


def joined(nodes: Column) -> Column:
    return F.array_join(nodes, "")


def over(level: DataFrame, tree: list[str], number: int) -> DataFrame:
    """The next level, stored: node rows with ``kids`` (digests of up to FAN nodes in order) and their own digest, for trees of which ``left`` > 1 nodes remain."""
    run = F.floor(F.col("idx") / FAN).cast("long").alias("idx")
    kids = F.sort_array(F.collect_list(F.struct("idx", "digest")))
    grouped = level.where("left > 1").groupBy(*tree, run).agg(F.first("left").alias("left"), F.min("first").alias("first"), F.max("last").alias("last"), kids.alias("of"))
    grouped = grouped.select(*tree, "idx", F.ceil(F.col("left") / FAN).cast("long").alias("left"), "first", "last", joined(F.col("of.digest")).alias("kids"))
    return stored(grouped.select("*", F.sha2("kids", 256).alias("digest"), F.lit(number).alias("level")))


def linked(level: DataFrame, inside: bool, sources: int) -> DataFrame:
    """Node rows with their parent's (up_level, up) and their place ``pos`` in it; the root has none. Inside a source a node's number is the rank of its
    first leaf, over the sources it is its place in the level."""
    last = F.col("left") == 1
    if not inside:
        up_level, up, pos = F.when(~last, F.col("level") + 1), F.when(~last, F.floor(F.col("idx") / FAN)), F.col("idx") % FAN
        return level.withColumns({"number": F.col("idx"), "up_level": up_level, "up": up, "pos": pos, "subroot": F.lit(None).cast("string")})
    width = F.pow(F.lit(FAN), F.col("level") + 1).cast("long")
    top = F.lit(OVER + 1) if sources > 1 else F.lit(None)
    up_level = F.when(last, top).otherwise(F.col("level") + 1)
    up = F.when(last, F.floor(F.col("tree") / FAN) if sources > 1 else F.lit(None)).otherwise(F.col("base") + F.floor(F.col("idx") / FAN) * width)
    pos = F.when(last, F.col("tree") % FAN).otherwise(F.col("idx") % FAN)
    return level.withColumns({"number": F.col("first"), "up_level": up_level.cast("int"), "up": up.cast("long"), "pos": pos, "subroot": F.when(last, F.col("digest"))})


CLIMB = """
WITH RECURSIVE climb (part, up_level, up, pos, digest, subroot, doc_ids, leaves, folded, siblings) AS (
    SELECT part, up_level, up, pos, digest, subroot, doc_ids, leaves, folded, siblings FROM {runs}
    UNION ALL
    SELECT c.part, n.up_level, n.up, n.pos, n.digest, coalesce(c.subroot, n.subroot), c.doc_ids, c.leaves,
        transform(c.folded, h -> unhex(sha2(concat(left(n.kids, 64 * c.pos), lower(hex(h)), substr(n.kids, 64 * c.pos + 65)), 256))),
        concat(c.siblings, unhex(concat(left(n.kids, 64 * c.pos), substr(n.kids, 64 * c.pos + 65))))
    FROM climb c JOIN {nodes} n ON n.level = c.up_level AND n.number = c.up AND n.part = c.part
)
SELECT digest AS root, subroot, doc_ids, leaves, folded, siblings FROM climb WHERE up_level IS NULL
"""


def climbed(spark: SparkSession, runs: DataFrame, nodes: DataFrame) -> DataFrame:
    """All runs of leaves at the root, stored. Spark ends a recursion at a number of rows unless told not to; its setting is put back afterwards."""
    key = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        return stored(spark.sql(CLIMB, runs=runs, nodes=nodes))
    finally:
        spark.conf.set(key, before)


def manifest(docs: DataFrame, columns: list[str], tampered: dict[str, Column], when: Callable[[Column], Column], group: str = "source") -> DataFrame:
    """doc_id, leaf, subroot, root, proof (hex digests of all siblings, bottom up), folded_root and verified for every row of ``docs``.

    A leaf is the digest of the row's ``columns``. In each ``group``, leaves go by doc_id (rows equal in it by leaf; nulls first), and while several
    nodes remain, each FAN consecutive ones become the digest of their joined hex digests, the last ones even if fewer; the groups' roots likewise,
    null first, then by bytes. Where ``when(doc_id)`` holds, ``tampered`` columns stand in for those of the same name when the leaf is
    folded up again with its original siblings; verified says whether that gives the root.

    Null values are values like any other. Repeated rows are leaves of their own. Other columns are left out. An empty table gives no rows.

    Ranks come from range partitions. Leaves climb in the rows of their runs: each is folded by itself, but the 16 leaves of a run
    share their siblings above it, so the state of the recursion is a sixteenth of what single leaves would need.
    """
    spark = docs.sparkSession
    plain = docs.select(named("doc_id").alias("doc_id"), named(group).cast("string").alias("grp"), when(F.col("doc_id")).alias("hit"), digest(*[named(c) for c in columns]).alias("leaf"), *[digest(*[tampered.get(c, named(c)) for c in columns]).alias("other")])
    hit = F.coalesce("hit", F.lit(False))
    rows = stored(plain.select("doc_id", "grp", "leaf", F.when(hit, F.col("other")).otherwise(F.col("leaf")).alias("folded"), F.monotonically_increasing_id().alias("tie")))
    leaves = stored(ranked(rows, "grp", "doc_id", "leaf", "tie"))
    found = stored(leaves.groupBy("grp").agg(F.min("rank").alias("base"), F.count("*").alias("left")))
    trees = stored(ranked(found, "base").withColumnRenamed("rank", "tree"))
    sources, most = trees.agg(F.count("*"), F.max("left")).first()

    of = trees.withColumnRenamed("grp", "of")
    own = leaves.join(bounded(of), F.col("grp").eqNullSafe(F.col("of"))).select("tree", "base", "left", (F.col("rank") - F.col("base")).alias("idx"), "doc_id", "leaf", "folded")
    run = F.floor(F.col("idx") / FAN).cast("long").alias("idx")
    runs = own.groupBy("tree", "base", "left", run).agg(F.sort_array(F.collect_list(F.struct("idx", "leaf", "folded", "doc_id"))).alias("of"))
    alone = F.col("left") == 1
    first = F.col("base") + F.col("idx") * FAN
    runs = runs.select("tree", "base", "left", "idx", first.alias("first"), (first + F.size("of") - 1).alias("last"), joined(F.col("of.leaf")).alias("kids"), "of")
    runs = runs.withColumns({"digest": F.when(alone, F.col("kids")).otherwise(F.sha2("kids", 256)), "level": F.lit(1)})
    level = stored(runs.withColumn("alone", alone).withColumn("left", F.ceil(F.col("left") / FAN).cast("long")))

    # levels inside the sources; the number of rounds is the logarithm of the largest
    tree, number, left = ["tree", "base"], 1, -(-(most or 0) // FAN)
    runs, levels, tops = level, [], [level.where("left = 1")]
    while left > 1:
        number, left = number + 1, -(-left // FAN)
        level = over(level, tree, number)
        levels.append(linked(level, True, sources))
        tops.append(level.where("left = 1"))
    level, number = None, OVER
    for top in tops:
        part = top.select(F.col("tree").alias("idx"), F.lit(sources).cast("long").alias("left"), "first", "last", "digest")
        level = part if level is None else level.unionAll(part)
    left = sources
    while left > 1:
        number, left = number + 1, -(-left // FAN)
        level = over(level, [], number)
        levels.append(linked(level, False, sources))

    start = linked(runs, True, sources)
    fold = lambda x, j: F.unhex(F.when(F.col("alone"), x).otherwise(F.sha2(F.concat(F.substring("kids", F.lit(1), HEX * j), x, F.substring("kids", HEX * j + HEX + 1, F.length("kids"))), 256)))
    start = start.select(
        F.floor(F.col("first") / PART).alias("part"), "up_level", "up", "pos", "digest", "subroot", F.col("of.doc_id").alias("doc_ids"), F.unhex("kids").alias("leaves"),
        F.transform("of.folded", fold).alias("folded"), F.lit(b"").alias("siblings"),
    )
    kept = ["level", "number", "up_level", "up", "pos", "digest", "subroot", "kids"]
    nodes = None
    for one in levels:
        parts = F.sequence(F.floor(F.col("first") / PART), F.floor(F.col("last") / PART))
        one = one.select(*kept, F.explode(parts).alias("part"))
        nodes = one if nodes is None else nodes.unionAll(one)
    done = climbed(spark, start, bounded(stored(nodes), NODES_BROADCAST)) if nodes is not None else start.withColumnRenamed("digest", "root")

    texts = done.select("root", "subroot", "doc_ids", F.lower(F.hex("leaves")).alias("kids"), F.transform("folded", lambda x: F.lower(F.hex(x))).alias("folded"), F.lower(F.hex("siblings")).alias("siblings"))
    each = texts.select("root", "subroot", "kids", "siblings", F.posexplode(F.arrays_zip("doc_ids", "folded")).alias("j", "one"))
    j = F.col("j")
    proof = F.concat(F.substring("kids", F.lit(1), HEX * j), F.substring("kids", HEX * j + HEX + 1, F.length("kids")), F.col("siblings"))
    folded = F.col("one.folded")
    return each.select(F.col("one.doc_ids").alias("doc_id"), F.substring("kids", HEX * j + 1, F.lit(HEX)).alias("leaf"), "subroot", "root", proof.alias("proof"), folded.alias("folded_root"), (folded == F.col("root")).alias("verified"))
