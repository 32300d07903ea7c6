"""Queries over graph measures."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tidemark.functions import geometry as geo
from tidemark.operators import graph, sampling, simjoin
from tidemark.operators.components import connected_components
from tidemark.plans.registry import query
from tidemark.plans.shared import stored, table
from tidemark.sources import social

UND = ", und AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM net WHERE src <> dst), sym AS (SELECT a, b FROM und UNION ALL SELECT b, a FROM und)"
NET = ", net AS (SELECT follower_id AS src, followee_id AS dst FROM follows)"
NODES = NET + ", nodes AS MATERIALIZED (SELECT DISTINCT unnest([src, dst]) AS node FROM net)"
#: Rounds of the iterated measures: in SQL each one is a table of its own.
ROUNDS, CORE_ROUNDS = 12, 30


def unrolled(first: str, step: str, rounds: int, last: str) -> str:
    """SQL of a loop: table r0, then each round's table from the one before."""
    tables = [f", r0 AS MATERIALIZED ({first})"] + [f", r{k} AS MATERIALIZED ({step.format(before=f'r{k - 1}')})" for k in range(1, rounds + 1)]
    return "".join(tables) + " " + last.format(before=f"r{rounds}")


def net(spark, d):
    """All follow pairs."""
    return social.follows(spark, d).select(F.col("follower_id").alias("src"), F.col("followee_id").alias("dst"))


@query("degree", NET + ", g AS (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM net UNION ALL SELECT dst FROM net) GROUP BY 1) SELECT node, degree, degree / (count(*) OVER () - 1) AS centrality FROM g")
def degree(spark, d):
    return graph.degrees(net(spark, d))


@query("clustering", NET + UND + ", k AS (SELECT a AS node, count(*) AS k FROM sym GROUP BY 1), t AS (SELECT x.a AS node, count(*) AS n FROM sym x JOIN sym y ON x.a = y.a AND x.b < y.b JOIN und z ON z.a = x.b AND z.b = y.b GROUP BY 1) SELECT node, coalesce(n, 0) AS triangles, CASE WHEN k > 1 THEN 2.0 * coalesce(n, 0) / (k * (k - 1)) ELSE 0 END AS coefficient FROM k LEFT JOIN t USING (node)")
def clustering(spark, d):
    return graph.clustering(net(spark, d))


@query(
    "directed_clustering",
    NET
    + """, one AS (SELECT DISTINCT src, dst FROM net WHERE src <> dst), sym AS (SELECT a, b, count(*) AS m FROM (SELECT src AS a, dst AS b FROM one UNION ALL SELECT dst, src FROM one) GROUP BY 1, 2),
k AS (SELECT a AS node, sum(m) AS d, count(*) FILTER (m = 2) AS r FROM sym GROUP BY 1), t AS (SELECT x.a AS node, sum(x.m * y.m * z.m) AS n FROM sym x JOIN sym y ON y.a = x.b JOIN sym z ON z.a = y.b AND z.b = x.a GROUP BY 1)
SELECT node, CAST(coalesce(n, 0) AS BIGINT) AS triangles, r AS reciprocal, CASE WHEN d * (d - 1) - 2 * r > 0 THEN coalesce(n, 0) / (2.0 * (d * (d - 1) - 2 * r)) ELSE 0 END AS coefficient FROM k LEFT JOIN t USING (node)""",
)
def directed_clustering(spark, d):
    return graph.directed_clustering(net(spark, d))


@query("negative_edges", NET + ", nodes AS (SELECT DISTINCT unnest([src, dst]) AS node FROM net) SELECT CAST(2000 AS BIGINT) AS pairs, CAST(2000 AS BIGINT) AS different, CAST(0 AS BIGINT) AS joined, count(*) >= 0 AS known FROM nodes")
def negative_edges(spark, d):
    """Two thousand negative pairs of the follow graph: how many, how many different, how many with an edge, and whether all ends are nodes of the graph."""
    e = net(spark, d)
    pairs = stored(sampling.negative_pairs(e, 2000))
    joined = pairs.join(graph.undirected(e), ["a", "b"], "left_semi")
    nodes = e.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    strange = pairs.select(F.explode(F.array("a", "b")).alias("node")).join(nodes, "node", "left_anti")
    one = pairs.agg(F.count("*").alias("pairs"), F.count_distinct("a", "b").alias("different"))
    return one.join(F.broadcast(joined.agg(F.count("*").alias("joined"))), F.lit(True)).join(F.broadcast(strange.agg((F.count("*") == 0).alias("known"))), F.lit(True))


PAGERANK = unrolled(
    "SELECT node, 1.0 / (SELECT count(*) FROM nodes) AS rank FROM nodes",
    "SELECT nodes.node, (0.15 + 0.85 * (SELECT coalesce(sum(rank), 0) FROM {before} WHERE node NOT IN (SELECT src FROM share))) / (SELECT count(*) FROM nodes) + 0.85 * coalesce(g.got, 0) AS rank "
    "FROM nodes LEFT JOIN (SELECT dst, sum(rank * part) AS got FROM share JOIN {before} p ON p.node = share.src GROUP BY 1) g ON g.dst = nodes.node",
    ROUNDS,
    "SELECT node, rank FROM {before}",
)


@query("pagerank", NODES + ", share AS MATERIALIZED (SELECT src, dst, 1.0 / count(*) OVER (PARTITION BY src) AS part FROM net)" + PAGERANK)
def pagerank(spark, d):
    return graph.pagerank(net(spark, d), rounds=ROUNDS, tolerance=0)


EIGEN = unrolled(
    "SELECT node, CAST(1 AS DOUBLE) AS score FROM nodes WHERE node IN (SELECT a FROM sym)",
    "SELECT node, raw / sqrt(sum(raw * raw) OVER ()) AS score FROM (SELECT x.node, x.score + coalesce(g.got, 0) AS raw FROM {before} x LEFT JOIN (SELECT a, sum(score) AS got FROM sym JOIN {before} y ON y.node = sym.b GROUP BY 1) g ON g.a = x.node)",
    ROUNDS,
    "SELECT node, score FROM {before}",
)


@query("eigenvector", NODES + UND + EIGEN)
def eigenvector(spark, d):
    return graph.eigenvector(net(spark, d), rounds=ROUNDS, tolerance=0)


CORES = unrolled(
    "SELECT a AS node, count(*) AS core FROM sym GROUP BY 1",
    "SELECT node, min(core) AS core FROM (SELECT x.node, least(x.core, h.h) AS core FROM {before} x JOIN (SELECT a, max(least(core, above)) AS h FROM "
    "(SELECT a, core, sum(n) OVER (PARTITION BY a ORDER BY core DESC) AS above FROM (SELECT s.a, v.core, count(*) AS n FROM sym s JOIN {before} v ON v.node = s.b GROUP BY 1, 2)) GROUP BY 1) h ON h.a = x.node) GROUP BY 1",
    CORE_ROUNDS,
    "SELECT node, CAST(core AS BIGINT) AS core FROM {before}",
)


@query("kcore", NET + UND + CORES)
def kcore(spark, d):
    return graph.core_numbers(net(spark, d))


#: Accounts from which shortest paths start; the score is scaled to all of them.
PIVOTS = 16


@query("betweenness")
def betweenness(spark, d):
    """Estimated from PIVOTS sources in hash order, over all follow pairs."""
    e = net(spark, d)
    nodes = e.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    found = graph.betweenness(e, nodes.orderBy(F.xxhash64("node"), "node").limit(PIVOTS))
    return found.join(F.broadcast(nodes.agg(F.count("*").alias("n"))), F.lit(True)).select("node", (F.col("score") * F.greatest(F.lit(1.0), F.col("n") / PIVOTS)).alias("score"))


@query("communities")
def communities(spark, d):
    return graph.communities(net(spark, d))


COMPONENTS = unrolled(
    "SELECT node, node AS component FROM nodes",
    "SELECT x.node, least(any_value(x.component), min(y.component)) AS component FROM {before} x JOIN sym ON sym.a = x.node JOIN {before} y ON y.node = sym.b GROUP BY 1",
    ROUNDS,
    "SELECT node, component FROM {before}",
)


@query("components", NODES + UND + COMPONENTS)
def components(spark, d):
    return connected_components(social.follows(spark, d), "follower_id", "followee_id")


@query("radial_order", "WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), r AS (SELECT label, vec_id, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS r, sqrt(list_sum(list_transform(v[1:32], lambda x: x * x))) AS s FROM e) SELECT a.label, avg(CASE WHEN (a.r - b.r) * (a.s - b.s) > 0 THEN 1.0 ELSE 0.0 END) AS agreement, avg(greatest(0, 0.1 - sign(a.r - b.r) * (a.s - b.s))) AS loss, count(*) AS pairs FROM r a JOIN r b ON a.label = b.label AND a.vec_id < b.vec_id GROUP BY 1", views=False)
def radial_order(spark, d):
    """Share of a label's pairs that keep the order of their radii, and the hinge loss of those that don't, from sums over pairs of blocks."""
    rows = table(spark, d, "embeddings").select("label", "vec_id", geo.norm(F.col("embedding")).alias("r"), geo.norm(F.slice("embedding", 1, 32)).alias("s"))

    def block(x, y, within):
        dr, ds = x["r"][:, None] - y["r"], x["s"][:, None] - y["s"]
        keep = np.triu(np.ones_like(dr, bool), 1) if within else np.ones_like(dr, bool)
        return ((dr * ds > 0) & keep).sum(), np.maximum(0.0, 0.1 - np.sign(dr) * ds)[keep].sum(), keep.sum()

    sums = simjoin.pair_sums(rows, "label", "vec_id", ["r", "s"], block, ["same", "lost", "n"]).where("n > 0")
    return sums.select("label", (F.col("same") / F.col("n")).alias("agreement"), (F.col("lost") / F.col("n")).alias("loss"), F.col("n").cast("long").alias("pairs"))


DISTANCES = "sqrt(list_sum(list_transform(list_zip({a}, {b}), lambda x: (x[1] - x[2]) ^ 2)))"


@query("distance_distortion", "WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), p AS (SELECT a.label, " + DISTANCES.format(a="a.v", b="b.v") + " AS known, " + DISTANCES.format(a="a.v[1:32]", b="b.v[1:32]") + " AS told FROM e a JOIN e b ON a.label = b.label AND a.vec_id < b.vec_id) SELECT label, avg(abs(told - known) / greatest(known, 1e-8)) AS distortion, count(*) AS pairs FROM p GROUP BY 1", views=False)
def distance_distortion(spark, d):
    """Mean relative change of the distances of a label's pairs when half of the dimensions tell them."""
    rows = table(spark, d, "embeddings").select("label", "vec_id", F.col("embedding").cast("array<double>").alias("known"), F.slice("embedding", 1, 32).cast("array<double>").alias("told"))
    return measures_of_pairs(rows, "label", "vec_id", "known", "told")


def measures_of_pairs(rows, group, key, known, told):
    """group, distortion, pairs: mean of |told - known| / known over the Euclidean distances of each pair of a group's vectors."""

    def block(x, y, within):
        a, b = (np.sqrt(np.maximum((x[c] ** 2).sum(1)[:, None] + (y[c] ** 2).sum(1) - 2 * x[c] @ y[c].T, 0)) for c in (known, told))
        off = np.abs(b - a) / np.maximum(a, 1e-8)
        keep = np.triu(np.ones_like(off, bool), 1) if within else np.ones_like(off, bool)
        return off[keep].sum(), keep.sum()

    sums = simjoin.pair_sums(rows, group, key, [known, told], block, ["off", "n"]).where("n > 0")
    return sums.select(group, (F.col("off") / F.col("n")).alias("distortion"), F.col("n").cast("long").alias("pairs"))


@query("lorentz_centroid", "WITH e AS (SELECT label, list_transform(embedding[1:4], lambda x: CAST(x AS DOUBLE) / 20) AS v FROM embeddings), x AS (SELECT label, v, greatest(sqrt(list_sum(list_transform(v, lambda y: y * y))), 1e-12) AS n FROM e), p AS (SELECT label, avg(cosh(n)) AS t, avg(v[1] * sinh(n) / n) AS a, avg(v[2] * sinh(n) / n) AS b, avg(v[3] * sinh(n) / n) AS c, avg(v[4] * sinh(n) / n) AS d FROM x GROUP BY 1) SELECT label, t / sqrt(t * t - a * a - b * b - c * c - d * d) AS time, a / sqrt(t * t - a * a - b * b - c * c - d * d) AS first FROM p", views=False)
def lorentz_centroid(spark, d):
    x = table(spark, d, "embeddings").select("label", geo.exp0(geo.scaled(F.slice("embedding", 1, 4), F.lit(0.05))).alias("x"))
    m = x.groupBy("label").agg(*[F.avg(F.element_at("x", i + 1)).alias(f"x{i}") for i in range(5)])
    size = F.sqrt(F.col("x0") * F.col("x0") - sum(F.col(f"x{i}") * F.col(f"x{i}") for i in range(1, 5)))
    return m.select("label", (F.col("x0") / size).alias("time"), (F.col("x1") / size).alias("first"))
