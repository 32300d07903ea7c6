"""Graph measures as iterated joins and aggregates. Edge tables have src and dst; every loop cuts its lineage by a stored table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.shared import released, stored


def undirected(edges: DataFrame) -> DataFrame:
    """Distinct pairs a < b without self loops."""
    return edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).where("a != b").distinct()


def both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))


def degrees(edges: DataFrame) -> DataFrame:
    """node, degree (a self loop counts twice), centrality degree / (nodes - 1)."""
    d = edges.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
    return d.join(F.broadcast(d.agg(F.count("*").alias("nodes"))), F.lit(True)).select("node", "degree", F.try_divide(F.col("degree"), F.col("nodes") - 1).alias("centrality"))


def clustering(edges: DataFrame) -> DataFrame:
    """node, triangles, coefficient. Each edge points from the lower to the higher degree, so a hub opens few wedges."""
    pairs = undirected(edges)
    deg = both_ways(pairs).groupBy("a").agg(F.count("*").alias("k"))
    ranked = pairs.join(deg.select("a", F.col("k").alias("ka")), "a").join(deg.select(F.col("a").alias("b"), F.col("k").alias("kb")), "b")
    up = F.struct("ka", "a") < F.struct("kb", "b")
    to = stored(ranked.select(F.when(up, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("v")))
    wedge = to.join(to.select("u", F.col("v").alias("w")), "u").where("v < w")
    closed = pairs.select(F.col("a").alias("v"), F.col("b").alias("w"))
    tri = wedge.join(closed, ["v", "w"])
    per = tri.select(F.explode(F.array("u", "v", "w")).alias("a")).groupBy("a").agg(F.count("*").alias("triangles"))
    n = F.coalesce("triangles", F.lit(0))
    return deg.join(per, "a", "left").select(F.col("a").alias("node"), n.alias("triangles"), F.when(F.col("k") > 1, 2 * n / (F.col("k") * (F.col("k") - 1))).otherwise(0.0).alias("coefficient"))


def directed_clustering(edges: DataFrame) -> DataFrame:
    """node, triangles, reciprocal, coefficient of a directed graph without its self loops and repeated edges: directed triangles through the node (each choice of one
    direction for three joined pairs of nodes, both senses counted), its neighbours joined both ways, and the share of the triangles that its edges could form.

    With d edges at a node, r of them in reciprocal pairs of which there are r, the coefficient is triangles / (2 (d (d - 1) - 2 r)); 0 where none could form.
    Each joined pair points from the lower to the higher number of neighbours, so a hub opens few wedges; pairs carry 2 where both directions exist.
    """
    one = edges.where("src != dst").select("src", "dst").distinct()
    pairs = stored(one.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.count("*").alias("m")))
    both = pairs.select("a", "b", "m").union(pairs.select("b", "a", "m")).toDF("a", "b", "m")
    at = stored(both.groupBy("a").agg(F.count("*").alias("k"), F.sum("m").alias("d"), F.count_if(F.col("m") == 2).alias("r")))
    ranked = pairs.join(at.select("a", F.col("k").alias("ka")), "a").join(at.select(F.col("a").alias("b"), F.col("k").alias("kb")), "b")
    up = F.struct("ka", "a") < F.struct("kb", "b")
    to = stored(ranked.select(F.when(up, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("v"), "m"))
    wedge = to.join(to.select("u", F.col("v").alias("w"), F.col("m").alias("m2")), "u").where("v < w")
    tri = wedge.join(pairs.select(F.col("a").alias("v"), F.col("b").alias("w"), F.col("m").alias("m3")), ["v", "w"])
    per = tri.select(F.explode(F.array("u", "v", "w")).alias("a"), (2 * F.col("m") * F.col("m2") * F.col("m3")).alias("n")).groupBy("a").agg(F.sum("n").alias("triangles"))
    could = 2 * (F.col("d") * (F.col("d") - 1) - 2 * F.col("r"))
    n = F.coalesce("triangles", F.lit(0))
    return at.join(per, "a", "left").select(F.col("a").alias("node"), n.alias("triangles"), F.col("r").alias("reciprocal"), F.when(could > 0, n / could).otherwise(0.0).alias("coefficient"))


def pagerank(edges: DataFrame, alpha: float = 0.85, rounds: int = 50, tolerance: float = 1e-9) -> DataFrame:
    """node, rank. The mass of nodes without out-edges goes to all nodes alike; stops when the total change is small."""
    out = stored(edges.select("src", "dst").distinct())
    n_out = out.groupBy("src").agg(F.count("*").alias("k"))
    links = stored(out.join(n_out, "src").select("src", "dst", (1 / F.col("k")).alias("share")))
    nodes = stored(out.select(F.explode(F.array("src", "dst")).alias("node")).distinct().join(n_out.select(F.col("src").alias("node"), F.lit(False).alias("sends")), "node", "left").select("node", F.coalesce("sends", F.lit(True)).alias("dangling")))
    n = nodes.count()
    rank, last = nodes.withColumn("rank", F.lit(1.0 / max(n, 1))), None
    for _ in range(rounds if n else 0):
        lost = rank.agg(F.sum(F.when(F.col("dangling"), F.col("rank")))).first()[0] or 0.0
        got = links.join(rank.select(F.col("node").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        new = rank.join(got, "node", "left").select("node", "dangling", ((1 - alpha + alpha * lost) / n + alpha * F.coalesce("got", F.lit(0.0))).alias("rank"), F.col("rank").alias("old"))
        new = stored(new)
        change = new.agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0]
        if last is not None:
            released(last)
        rank, last = new.drop("old"), new
        if change < tolerance * n:
            break
    return rank.select("node", "rank")


def eigenvector(edges: DataFrame, rounds: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """node, score: power iteration of the undirected adjacency plus identity, unit length."""
    sym = stored(both_ways(undirected(edges)))
    score, last = sym.select(F.col("a").alias("node")).distinct().withColumn("score", F.lit(1.0)), None
    for _ in range(rounds):
        got = sym.join(score.select(F.col("node").alias("b"), "score"), "b").groupBy(F.col("a").alias("node")).agg(F.sum("score").alias("got"))
        raw = stored(score.join(got, "node", "left").select("node", (F.col("score") + F.coalesce("got", F.lit(0.0))).alias("raw"), F.col("score").alias("old")))
        if last is not None:
            released(last)
        last = raw
        size = raw.agg(F.sqrt(F.sum(F.col("raw") * F.col("raw")))).first()[0] or 1.0
        new = raw.select("node", (F.col("raw") / size).alias("score"), "old")
        change = new.agg(F.sum(F.abs(F.col("score") - F.col("old")))).first()[0] or 0.0
        score = new.drop("old")
        if change < tolerance:
            break
    return score


def core_numbers(edges: DataFrame) -> DataFrame:
    """node, core: each node takes the H-index of its neighbours' values, from the degrees down, until nothing changes."""
    sym = stored(both_ways(undirected(edges)))
    value = last = stored(sym.groupBy("a").agg(F.count("*").alias("core")))
    while True:
        near = sym.join(value.select(F.col("a").alias("b"), "core"), "b").groupBy("a", "core").agg(F.count("*").alias("n"))
        above = F.sum("n").over(Window.partitionBy("a").orderBy(F.desc("core")))  # neighbours with at least this value
        h = near.withColumn("h", F.least("core", above)).groupBy("a").agg(F.max("h").alias("new"))
        new = stored(value.join(h, "a").select("a", F.least("core", "new").alias("core"), F.col("core").alias("old")))
        moved = new.where("core != old").limit(1).count()
        released(last)
        value, last = new.select("a", "core"), new
        if not moved:
            return value.select(F.col("a").alias("node"), "core")


def betweenness(edges: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """node, score: shortest paths through a node over directed pairs, by level frames from each source (all nodes, or the
    given ones: the whole takes sources * edges rows) and back-propagation of dependencies."""
    out = stored(edges.select("src", "dst").where("src != dst").distinct())
    nodes = out.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    start = (sources.select("node") if sources is not None else nodes).select(F.col("node").alias("s"), F.col("node").alias("v"), F.lit(0).alias("level"), F.lit(1.0).alias("paths"))
    levels = [stored(start)]
    while True:
        seen = reduce(lambda x, y: x.union(y), [x.select("s", "v") for x in levels])  # each level is written once
        step = levels[-1].join(out, F.col("v") == F.col("src")).groupBy("s", "dst").agg(F.sum("paths").alias("paths")).withColumnRenamed("dst", "v")
        nxt = stored(step.join(seen, ["s", "v"], "left_anti").select("s", "v", F.lit(len(levels)).alias("level"), "paths"))
        if not nxt.limit(1).count():
            break
        levels.append(nxt)
    depend = levels[-1].select("s", "v", "paths", F.lit(0.0).alias("d"))
    total = depend
    for k in range(len(levels) - 2, -1, -1):
        share = levels[k].join(out, F.col("v") == F.col("src")).join(depend.select("s", F.col("v").alias("dst"), F.col("paths").alias("p"), "d"), ["s", "dst"]).groupBy("s", "v").agg(F.sum(F.col("paths") / F.col("p") * (1 + F.col("d"))).alias("d"))
        depend = stored(levels[k].join(share, ["s", "v"], "left").select("s", "v", "paths", F.coalesce("d", F.lit(0.0)).alias("d")))
        total = total.union(depend)
    return nodes.join(total.where("s != v").groupBy(F.col("v").alias("node")).agg(F.sum("d").alias("score")), "node", "left").select("node", F.coalesce("score", F.lit(0.0)).alias("score"))


def modularity(pairs: DataFrame, label: DataFrame) -> float:
    """Of weighted undirected pairs (a, b, w; loops allowed) under node -> community labels."""
    j = pairs.join(label.select(F.col("node").alias("a"), F.col("community").alias("ca")), "a").join(label.select(F.col("node").alias("b"), F.col("community").alias("cb")), "b")
    m = j.agg(F.sum("w")).first()[0] or 1.0
    c = j.select(F.explode(F.array(F.struct(F.col("ca").alias("c"), "w", F.when(F.col("ca") == F.col("cb"), F.col("w")).otherwise(0.0).alias("i")), F.struct(F.col("cb").alias("c"), "w", F.lit(0.0).alias("i")))).alias("x")).groupBy("x.c").agg(F.sum("x.i").alias("inside"), F.sum("x.w").alias("total"))
    return c.agg(F.sum(F.col("inside") / m - F.pow(F.col("total") / (2 * m), 2))).first()[0] or 0.0


def moves(sym: DataFrame, label: DataFrame, two_m: float) -> DataFrame:
    """Of label (node, community, k): node, community, k, inside (weight of the node's edges into its community), to (the community with the largest gain, ties to its own and
    then to the smaller name). Edges (a, b, w, both ways) are dealt out twice: to the label of b, and with it to a."""
    tot = label.groupBy("community").agg(F.sum("k").alias("tot"))
    own = label.join(tot, "community").select("node", "community", "k", "tot")
    sent = sym.join(own.select(F.col("node").alias("b"), F.col("community").alias("near"), F.col("tot").alias("near_tot")), "b").select("a", "near", "near_tot", "w")
    near = sent.repartition("a").groupBy("a", "near").agg(F.first("near_tot").alias("near_tot"), F.sum("w").alias("w")).withColumnRenamed("a", "node")
    gain = lambda w, tot, mine: F.round(w - F.col("k") * (tot - F.when(mine, F.col("k")).otherwise(0.0)) / two_m, 9)
    mine = F.col("near") == F.col("community")
    best = F.max(F.when(F.col("near").isNotNull(), F.struct(gain(F.col("w"), F.col("near_tot"), mine).alias("gain"), mine.cast("int").alias("mine"), (-F.col("near")).alias("name"))))
    top = own.join(near, "node", "left").groupBy("node", "community", "k", "tot").agg(best.alias("best"), F.coalesce(F.max(F.when(mine, F.col("w"))), F.lit(0.0)).alias("inside"))
    stay = F.struct(gain(F.lit(0.0), F.col("tot"), F.lit(True)).alias("gain"), F.lit(1).alias("mine"), (-F.col("community")).alias("name"))
    return top.select("node", "community", "k", "inside", F.when(F.col("best") > stay, -F.col("best.name")).otherwise(F.col("community")).alias("to"))


def communities(edges: DataFrame, rounds: int = 8, levels: int = 4) -> DataFrame:
    """node, community by modularity: nodes of one parity (changing each round) move to the neighbouring community with
    the largest gain, ties to the smaller name; a round that doesn't raise modularity is taken back and ends the
    level; communities then become nodes. Names are the smallest member. Isolates aren't in the edge table.

    A round reads the edges once: the next moves and the modularity of the labels come from the same sums."""
    pairs = stored(undirected(edges).withColumn("w", F.lit(1.0)))
    whole = stored(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("community")))
    for _ in range(levels):
        sym = stored(pairs.where("a != b").select("a", "b", "w").union(pairs.where("a != b").select("b", "a", "w")))
        k = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("node"), "w"), F.struct(F.col("b").alias("node"), "w"))).alias("x")).groupBy("x.node").agg(F.sum("x.w").alias("k"))
        m, loops = pairs.agg(F.sum("w"), F.sum(F.when(F.col("a") == F.col("b"), F.col("w")))).first()
        m, loops = m or 1.0, loops or 0.0

        def weighed(label, sym=sym, m=m, loops=loops):
            found = stored(moves(sym, label, 2 * m))
            inside, squares = found.groupBy("community").agg(F.sum("inside").alias("inside"), F.sum("k").alias("tot")).agg(F.sum("inside"), F.sum(F.pow(F.col("tot") / (2 * m), 2))).first()
            return found, (loops + (inside or 0.0) / 2) / m - (squares or 0.0)

        (now, best), still = weighed(k.select("node", F.col("node").alias("community"), "k")), 0
        started = best
        for r in range(rounds):
            gate = F.pmod(F.xxhash64("node", F.lit(r // 2)) + r, F.lit(2)) == 0
            new, q = weighed(now.select("node", F.when(gate, F.col("to")).otherwise(F.col("community")).alias("community"), "k"))
            if q > best + 1e-9:
                released(now)
                now, best, still = new, q, 0
            else:
                released(new)
                still += 1
                if still == 2:
                    break
        released(sym)
        if best <= started + 1e-9:
            break
        named = now.join(now.groupBy("community").agg(F.min("node").alias("name")), "community").select("node", F.col("name").alias("community"))
        named = stored(named)
        joined = stored(whole.withColumnRenamed("community", "mid").join(named.select(F.col("node").alias("mid"), "community"), "mid").select("node", "community"))
        a, b = named.select(F.col("node").alias("a"), F.col("community").alias("ca")), named.select(F.col("node").alias("b"), F.col("community").alias("cb"))
        folded = stored(pairs.join(a, "a").join(b, "b").groupBy(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).agg(F.sum("w").alias("w")))
        released(now, named, whole, pairs)
        whole, pairs = joined, folded
    return whole


def resolve_roots(nodes: DataFrame, rounds: int = 40) -> DataFrame:
    """id, root, depth by pointer doubling over (id, parent). A parent that isn't an id counts as none; nodes that
    lead into a cycle get null for both."""
    known = nodes.select(F.col("id").alias("parent"), F.lit(True).alias("known"))
    now = stored(nodes.select("id", "parent").join(known, "parent", "left").select("id", F.when(F.col("known"), F.col("parent")).alias("up")).select("id", F.coalesce("up", "id").alias("at"), F.col("up").isNotNull().cast("long").alias("depth")))
    for _ in range(rounds):
        b = now.select(F.col("id").alias("at"), F.col("at").alias("next"), F.col("depth").alias("more"))
        new = stored(now.join(b, "at").select("id", F.col("next").alias("at"), (F.col("depth") + F.col("more")).alias("depth"), (F.col("more") > 0).alias("moved")))
        moved = new.where("moved").limit(1).count()
        now = new.drop("moved")
        if not moved:
            return now.select("id", F.col("at").alias("root"), "depth")
    rooted = now.join(now.where("depth = 0").select(F.col("id").alias("at")), "at", "left_semi").select("id", F.col("at").alias("root"), "depth")
    return now.select("id").join(rooted, "id", "left")
