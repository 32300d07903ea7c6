"""Cascades over time on any graph: breadth-first levels of the part that each moment sees, for all cascades and moments at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.shared import released, stored


def spread(start: DataFrame, links: DataFrame, keys: list[str], inside: DataFrame | None = None) -> DataFrame:
    """``keys``, node, distance of all nodes that ``start`` (keys with cascade and at among them, node) reaches over ``links`` (cascade, src, dst, since), where a link is
    open from its moment ``since`` on; with ``inside`` (cascade, at, node) only over nodes that it has.

    A round takes the nodes met last one link further, for all keys together; the nodes met in each round are written once and read from then on.
    """
    levels = [stored(start.select(*keys, "node").distinct().withColumn("distance", F.lit(0).cast("long")))]
    while levels[-1].limit(1).count():
        on = F.col("cascade") == F.col("in_cascade")
        step = links.select(F.col("cascade").alias("in_cascade"), "src", "dst", "since")
        further = levels[-1].join(step, on & (F.col("node") == F.col("src")) & (F.col("since") <= F.col("at"))).select(*keys, F.col("dst").alias("node")).distinct()
        if inside is not None:
            further = further.join(inside, ["cascade", "at", "node"], "left_semi")
        seen = reduce(lambda a, b: a.unionByName(b), [x.select(*keys, "node") for x in levels])
        levels.append(stored(further.join(seen, [*keys, "node"], "left_anti").withColumn("distance", F.lit(len(levels)).cast("long"))))
    return reduce(lambda a, b: a.unionByName(b), levels)


def over_time(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """cascade, at, size, depth, breadth, virality at each moment at which a cascade's root, or a node beside it, is new.

    nodes: cascade, node, time, is_root; edges: cascade, src, dst, away from the root as a rule, though any graph will do. The moment sees nodes of its time or before, and of
    them those that the root reaches along edges. depth is the largest distance from the root, breadth the most nodes at one distance above zero (0 if there are none),
    virality the mean distance of two different nodes over edges in either direction (null for one node). Nodes given twice count once, at their first time; edges
    whose ends aren't nodes of the cascade, self loops and rows with nulls are left out.

    The distances of all pairs are the price of virality on graphs with cycles: their rows are the squares of the cascades' sizes, for each moment.
    """
    at = nodes.where("cascade is not null and node is not null and time is not null").groupBy("cascade", "node").agg(F.min("time").alias("time"), F.max(F.coalesce("is_root", F.lit(False))).alias("is_root"))
    at = stored(at)
    ends = lambda name: at.select("cascade", F.col("node").alias(name), F.col("time").alias(f"{name}_time"))
    links = edges.where("src != dst").select("cascade", "src", "dst").distinct().join(ends("src"), ["cascade", "src"]).join(ends("dst"), ["cascade", "dst"])
    links = stored(links.select("cascade", "src", "dst", F.greatest("src_time", "dst_time").alias("since")))
    roots = at.where("is_root").select("cascade", "node", F.col("time").alias("root_time"))
    moments = at.select("cascade", F.col("time").alias("at")).distinct()
    start = roots.join(moments, "cascade").where("at >= root_time").select("cascade", "at", "node")
    reach = stored(spread(start, links, ["cascade", "at"]))
    levels = reach.groupBy("cascade", "at", "distance").agg(F.count("*").alias("n"))
    shape = levels.groupBy("cascade", "at").agg(F.sum("n").alias("size"), F.max("distance").alias("depth"), F.coalesce(F.max(F.when(F.col("distance") > 0, F.col("n"))), F.lit(0)).alias("breadth"))
    either = stored(links.unionByName(links.select("cascade", F.col("dst").alias("src"), F.col("src").alias("dst"), "since")).distinct())
    inside = reach.select("cascade", "at", "node")
    pairs = spread(inside.withColumn("source", F.col("node")), either, ["cascade", "at", "source"], inside).where("source != node")
    mean = pairs.groupBy("cascade", "at").agg(F.avg("distance").alias("virality"))
    return shape.join(mean, ["cascade", "at"], "left").select("cascade", "at", "size", "depth", "breadth", "virality")


def paths(nodes: DataFrame, rounds: int = 40) -> DataFrame:
    """``nodes`` (node, parent, time) that a root, a node without a parent, leads to: cascade (the root), node, parent, depth, time, and since, the latest time on the way from the root.

    By pointer doubling; nodes below a missing parent go, and so do those that still point to none of the roots after all rounds, which a cycle holds.
    """
    now = stored(nodes.select("node", "parent", "time", F.coalesce("parent", "node").alias("up"), F.col("parent").isNotNull().cast("long").alias("depth"), F.col("time").alias("since")))
    for _ in range(rounds):
        above = now.select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"), F.col("since").alias("before"))
        new = stored(now.join(above, "up").select("node", "parent", "time", F.col("next").alias("up"), (F.col("depth") + F.col("more")).alias("depth"), F.greatest("since", "before").alias("since"), (F.col("more") > 0).alias("moved")))
        released(now)
        now = new
        if not now.where("moved").limit(1).count():
            break
    tree = now.select(F.col("up").alias("cascade"), "node", "parent", "depth", "time", "since")
    return tree.join(now.where("parent is null").select(F.col("node").alias("cascade")), "cascade", "left_semi")


def trees_over_time(nodes: DataFrame) -> DataFrame:
    """What ``over_time`` gives for cascades that are trees, each with one root: nodes (node, parent, time), where a root has no parent.

    A moment sees the nodes whose whole way from the root is of its time or before. Distances of pairs aren't made: a node with s of the n nodes seen below it, itself
    counted, lies above s (n - s) pairs. Nodes are counted by the moment since when they are seen, from the deepest level up; a node has as many counts as its cascade has
    moments at most. Nodes given twice count once, at their first time; rows without a node or a time are left out.
    """
    one = nodes.where("node is not null and time is not null").groupBy("node").agg(F.min(F.struct("time", "parent")).alias("x")).select("node", "x.parent", "x.time")
    tree = stored(paths(one))
    deepest = tree.agg(F.max("depth")).first()[0]
    own = lambda depth: tree.where(F.col("depth") == depth).select("cascade", "node", "parent", "since")
    counts, lifted = [], None
    for depth in range(deepest or 0, -1, -1):
        here = own(depth).withColumn("n", F.lit(1).cast("long"))
        if lifted is not None:
            ends = own(depth).drop("since")
            here = here.unionByName(lifted.join(ends, "node").select("cascade", "node", "parent", "since", "n")).groupBy("cascade", "node", "parent", "since").agg(F.sum("n").alias("n"))
        counts.append(stored(here))
        lifted = counts[-1].groupBy(F.col("parent").alias("node"), "since").agg(F.sum("n").alias("n"))
    below = reduce(lambda a, b: a.unionByName(b), counts).withColumn("s", F.sum("n").over(Window.partitionBy("node").orderBy("since")))
    squares = (F.col("n") * (2 * F.col("s") - F.col("n"))).cast("decimal(38,0)")  # how far s * s rises
    level = tree.groupBy("cascade", "depth", "since").agg(F.count("*").alias("new"))
    level = level.withColumn("wide", F.when(F.col("depth") > 0, F.sum("new").over(Window.partitionBy("cascade", "depth").orderBy("since"))).otherwise(0))
    none = F.lit(0).cast("long")
    rows = level.select("cascade", F.col("since").alias("at"), "new", "depth", "wide", none.alias("s"), none.cast("decimal(38,0)").alias("squares"))
    rows = rows.unionByName(below.select("cascade", F.col("since").alias("at"), none.alias("new"), none.alias("depth"), none.alias("wide"), F.col("n").alias("s"), squares.alias("squares")))
    rows = rows.unionByName(tree.select("cascade", F.col("time").alias("at"), none.alias("new"), none.alias("depth"), none.alias("wide"), none.alias("s"), none.cast("decimal(38,0)").alias("squares")).distinct())
    rows = rows.groupBy("cascade", "at").agg(F.sum("new").alias("new"), F.max("depth").alias("depth"), F.max("wide").alias("wide"), F.sum("s").alias("s"), F.sum("squares").alias("squares"))
    so_far = Window.partitionBy("cascade").orderBy("at")
    shape = rows.select("cascade", "at", F.sum("new").over(so_far).alias("size"), F.max("depth").over(so_far).alias("depth"), F.max("wide").over(so_far).alias("breadth"), F.sum("s").over(so_far).alias("s"), F.sum("squares").over(so_far).alias("squares"))
    pairs = F.col("size").cast("decimal(18,0)") * F.col("s").cast("decimal(19,0)") - F.col("squares")
    mean = F.when(F.col("size") > 1, 2 * pairs.cast("double") / (F.col("size").cast("double") * (F.col("size") - 1)))
    return shape.where("size > 0").select("cascade", "at", "size", "depth", "breadth", mean.alias("virality"))
