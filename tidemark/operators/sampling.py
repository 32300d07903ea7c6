"""Draws by weight with prefix sums, negative pairs, and quotas that close."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.shared import bounded, stored

#: Rows of a slice whose running sum one task makes, about.
SLICE = 65_536
#: Rounds after which a draw of pairs gives up.
MOST_ROUNDS = 60


def uniform(*parts) -> Column:
    """A number in [0, 1) made from a hash."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 52)) / F.lit(float(1 << 52))


def intervals(df: DataFrame, key: str, weight: str) -> tuple[DataFrame, float]:
    """key, begin, end: each row's share of the line from 0 to the sum of weights, and that sum. Rows without a positive weight have none.

    Slices of the keys' hashes are summed first, then each slice runs from its own begin, so no task sees all rows; the slices are one in SLICE rows.
    """
    rows = df.where(F.col(weight) > 0).select(F.col(key).alias("key"), F.col(weight).cast("double").alias("w"))
    slices = max(1, rows.count() // SLICE)
    rows = stored(rows.withColumn("slice", F.pmod(F.xxhash64(F.lit("slice"), "key"), F.lit(slices))))
    heads = rows.groupBy("slice").agg(F.sum("w").alias("whole"))
    heads = stored(heads.select("slice", "whole", F.sum("whole").over(Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("until")))
    total = heads.agg(F.max("until")).first()[0] or 0.0
    begin = heads.select("slice", (F.col("until") - F.col("whole")).alias("from"))
    end = F.sum("w").over(Window.partitionBy("slice").orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return stored(rows.withColumn("end", end).join(bounded(begin), "slice").select("key", (F.col("from") + F.col("end") - F.col("w")).alias("begin"), (F.col("from") + F.col("end")).alias("end"))), total


def drawn(places: DataFrame, line: DataFrame, total: float, cells: int) -> DataFrame:
    """The rows of ``places`` (at, between 0 and 1) with the ``key`` of the interval that each lies in: a range join by equal cells of the line, of which an interval covers
    as many as its weight asks for."""
    width = total / cells
    cell = lambda x: F.least(F.floor(x / width), F.lit(cells - 1))
    spans = line.select("key", "begin", "end", F.explode(F.sequence(cell(F.col("begin")), cell(F.col("end")))).alias("cell"))
    asked = places.withColumn("place", F.col("at") * total).withColumn("cell", cell(F.col("place")))
    return asked.join(spans, "cell").where("begin <= place and place < end").drop("cell", "place", "begin", "end", "at")


def first_rows(df: DataFrame, number: str, n: int) -> DataFrame:
    """The ``n`` rows of ``df`` (stored) with the smallest ``number``, whole and different numbers: whole stretches by their counts, then one stretch in order."""
    most = df.agg(F.max(number)).first()[0]
    if most is None:
        return df
    width = max(1, (most + 1) // 10_000)
    taken = 0
    for r in sorted(df.groupBy(F.floor(F.col(number) / width).alias("s")).agg(F.count("*").alias("n")).collect()):  # 10,001 counts at most
        if taken + r["n"] >= n:
            last = df.where((F.col(number) >= r["s"] * width) & (F.col(number) < (r["s"] + 1) * width)).orderBy(number).limit(n - taken)
            return df.where(F.col(number) < r["s"] * width).unionByName(last)
        taken += r["n"]
    return df


def negative_pairs(edges: DataFrame, n: int, power: float = 0.75, seed: int = 7) -> DataFrame:
    """a < b: exactly ``n`` different pairs of nodes of ``edges`` (src, dst) that no edge joins in either direction, both ends drawn by degree to the ``power``.

    Pairs that meet themselves, an edge or an earlier pair are refused and drawn again. More pairs than there are, or than MOST_ROUNDS rounds find, is an error.
    """
    ends = edges.where("src is not null and dst is not null").select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.pow(F.count("*"), F.lit(power)).alias("w"))
    line, total = intervals(ends, "node", "w")
    nodes = line.count()
    known = stored(edges.where("src != dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct())
    if n > nodes * (nodes - 1) // 2 - known.count():
        raise ValueError(f"the graph has fewer than {n} pairs without an edge")
    cells, found, have, at = max(1, nodes // 4), None, 0, 0
    spark = edges.sparkSession
    for _ in range(MOST_ROUNDS):
        if have >= n:
            break
        more = 2 * (n - have) + 64
        draws = spark.range(at, at + more).withColumnRenamed("id", "draw")
        sides = [drawn(draws.withColumn("at", uniform(F.lit(seed), F.lit(side), "draw")), line, total, cells).withColumnRenamed("key", side) for side in ("x", "y")]
        pairs = sides[0].join(sides[1], "draw").where("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "draw")
        pairs = pairs.join(known, ["a", "b"], "left_anti").groupBy("a", "b").agg(F.min("draw").alias("draw"))
        if found is not None:
            pairs = pairs.join(found, ["a", "b"], "left_anti")
        found = stored(pairs if found is None else found.unionByName(pairs))
        have, at = found.count(), at + more
    if have < n:
        raise ValueError(f"{MOST_ROUNDS} rounds found {have} of {n} pairs")
    return first_rows(found, "draw", n).select("a", "b") if n else spark.createDataFrame([], "a long, b long")


def apportion(groups: DataFrame, keys: list[str], group: str, available: str, target: Column | int) -> DataFrame:
    """``groups`` with ``quota``: in proportion to ``available``, never above it, and in sum the smaller of ``target`` and all that is available.

    Each group that has anything gets one at least, where the target allows one for each. What rounding down leaves goes to the largest remainders; what the least
    of one costs is taken from the largest quotas. Ties go by the group's name. A table of groups has few rows for each of ``keys``.
    """
    own = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    goal = target if isinstance(target, Column) else F.lit(target)
    n, total = F.coalesce(F.col(available), F.lit(0)).cast("long"), F.sum(F.coalesce(F.col(available), F.lit(0)).cast("long")).over(own)
    t = groups.withColumn("n_", n).withColumn("total_", total).withColumn("some_", F.count_if(n > 0).over(own)).withColumn("goal_", F.greatest(F.least(goal.cast("long"), F.col("total_")), F.lit(0)))
    share = F.col("goal_") * F.col("n_")
    t = t.withColumn("low_", F.coalesce(F.expr("try_divide(goal_ * n_ - pmod(goal_ * n_, total_), total_)").cast("long"), F.lit(0)))
    t = t.withColumn("rest_", F.coalesce(F.try_mod(share, F.col("total_")), F.lit(0)))
    raised = (F.col("goal_") >= F.col("some_")) & (F.col("low_") == 0) & (F.col("n_") > 0)
    t = t.withColumn("rest_", F.when(raised, F.lit(-1)).otherwise(F.col("rest_"))).withColumn("low_", F.when(raised, F.lit(1)).otherwise(F.col("low_")))
    t = t.withColumn("open_", F.col("goal_") - F.sum("low_").over(own))
    up = F.row_number().over(own.orderBy(F.desc("rest_"), group)) <= F.col("open_")
    t = t.withColumn("spare_", F.greatest(F.col("low_") - 1, F.lit(0)))
    before = F.sum("spare_").over(own.orderBy(F.desc("spare_"), group).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("spare_")
    down = F.greatest(F.least(F.col("spare_"), -F.col("open_") - before), F.lit(0))
    quota = F.when(F.col("open_") > 0, F.col("low_") + up.cast("long")).otherwise(F.col("low_") - down)
    return t.withColumn("quota", quota).select(*groups.columns, "quota")
