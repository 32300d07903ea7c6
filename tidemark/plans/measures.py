"""Queries over aggregates: behaviour features, audits, evaluation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import ids
from tidemark.operators import evaluation as ev
from tidemark.operators import graph, nested
from tidemark.operators import tables as ops
from tidemark.plans.registry import query
from tidemark.plans.shared import table
from tidemark.sources import social

#: The actions of the log, for pivots.
ACTIONS = ["click", "error", "purchase", "signup", "view"]
SHARES = ", ".join(f"count(*) FILTER (action = '{a}') / greatest(count(*), 1) AS {a}_ratio" for a in ACTIONS)


@query("behavior_features", "SELECT u.user_id, coalesce(t.n, 0) AS n_actions, coalesce(t.v, 0) AS mean_value, coalesce(p.n, 0) AS n_posts FROM users u LEFT JOIN (SELECT user_id, count(*) n, avg(value) v FROM trace GROUP BY 1) t USING (user_id) LEFT JOIN (SELECT user_id, count(*) n FROM posts GROUP BY 1) p USING (user_id)")
def behavior_features(spark, d):
    t = social.trace(spark, d).groupBy("user_id").agg(F.count("*").alias("n_actions"), F.avg("value").alias("mean_value"))
    p = social.posts(spark, d).groupBy("user_id").agg(F.count("*").alias("n_posts"))
    return social.users(spark, d).select("user_id").join(t, "user_id", "left").join(p, "user_id", "left").fillna(0)


DEGREE = "deg AS (SELECT id, count(*) AS degree FROM (SELECT follower_id AS id FROM follows UNION ALL SELECT followee_id FROM follows) GROUP BY 1)"


@query("node_features", f", {DEGREE} SELECT u.user_id, u.is_bad, coalesce(d.degree, 0) AS degree, b.n AS n_actions FROM users u LEFT JOIN deg d ON d.id = u.user_id JOIN (SELECT user_id, count(*) n FROM trace GROUP BY 1) b USING (user_id)")
def node_features(spark, d):
    deg = social.follows(spark, d).select(F.explode(F.array("follower_id", "followee_id")).alias("user_id")).groupBy("user_id").agg(F.count("*").alias("degree"))
    b = social.trace(spark, d).groupBy("user_id").agg(F.count("*").alias("n_actions"))
    return social.users(spark, d).select("user_id", "is_bad").join(deg, "user_id", "left").fillna(0, ["degree"]).join(b, "user_id")


MARKS = {"url": r"https?://", "mention": r"@[A-Za-z0-9_]+", "hashtag": r"#[A-Za-z0-9_]+", "media": r"[.](jpg|jpeg|png|gif|mp4)"}
MARK_COUNTS = ", ".join(f"avg(len(regexp_extract_all(content, '{p}'))) AS {n}s" for n, p in MARKS.items())


@query(
    "post_averages",
    ", got AS (SELECT post_id, count(*) FILTER (action = 'repost') AS reposts, count(*) FILTER (action = 'comment') AS replies FROM reactions GROUP BY 1) "
    "SELECT user_id, avg(num_likes) AS likes, avg(num_dislikes) AS dislikes, avg(coalesce(reposts, 0)) AS reposts, avg(coalesce(replies, 0)) AS replies, avg(CASE WHEN is_quote THEN 1 ELSE 0 END) AS quotes, "
    + MARK_COUNTS
    + ", count(*) AS n_posts FROM posts LEFT JOIN got USING (post_id) GROUP BY 1",
)
def post_averages(spark, d):
    """Of each account's posts: mean likes, dislikes, reposts, replies, quotes, links, mentions, hashtags and media, and their number."""
    a = F.col("action")
    got = social.reactions(spark, d).groupBy("post_id").agg(F.count_if(a == "repost").alias("reposts"), F.count_if(a == "comment").alias("replies"))
    p = social.posts(spark, d).join(got, "post_id", "left").fillna(0, ["reposts", "replies"])
    plain = [F.avg(c).alias(n) for c, n in (("num_likes", "likes"), ("num_dislikes", "dislikes"), ("reposts", "reposts"), ("replies", "replies"))]
    return p.groupBy("user_id").agg(*plain, F.avg(F.col("is_quote").cast("int")).alias("quotes"), *[F.avg(F.regexp_count("content", F.lit(m))).alias(f"{n}s") for n, m in MARKS.items()], F.count("*").alias("n_posts"))


@query("user_text_ratios", "SELECT user_id, " + ", ".join(f"avg(CASE WHEN regexp_matches(content, '{p}') THEN 1.0 ELSE 0.0 END) AS {n}" for n, p in MARKS.items()) + " FROM posts GROUP BY 1")
def user_text_ratios(spark, d):
    """Share of each account's posts with a link, mention, hashtag or media file."""
    return social.posts(spark, d).groupBy("user_id").agg(*[F.avg(F.col("content").rlike(p).cast("double")).alias(n) for n, p in MARKS.items()])


@query("action_ratios", f"SELECT user_id, {SHARES} FROM trace GROUP BY 1")
def action_ratios(spark, d):
    wide = social.trace(spark, d).groupBy("user_id").pivot("action", ACTIONS).count().fillna(0)
    total = F.greatest(reduce(lambda a, b: a + b, map(F.col, ACTIONS)), F.lit(1))
    return wide.select("user_id", *[(F.col(a) / total).alias(f"{a}_ratio") for a in ACTIONS])


@query("hour_entropy", ", h AS (SELECT user_id, hour(ts) AS h, count(*) AS n FROM trace GROUP BY 1, 2), p AS (SELECT user_id, n / sum(n) OVER (PARTITION BY user_id) AS p FROM h) SELECT user_id, -sum(p * ln(p + 1e-12)) AS entropy FROM p GROUP BY 1")
def hour_entropy(spark, d):
    h = social.trace(spark, d).groupBy("user_id", F.hour("ts").alias("h")).agg(F.count("*").alias("n"))
    p = h.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("user_id")))
    return p.groupBy("user_id").agg((-F.sum(F.col("p") * F.ln(F.col("p") + 1e-12))).alias("entropy"))


TEXT_MARKS = {"url": r"https?://", "mention": r"@[A-Za-z0-9_]+", "hashtag": r"#[A-Za-z0-9_]+", "number": r"[0-9]"}


@query("text_ratios", "SELECT source, " + ", ".join(f"avg(CASE WHEN regexp_matches(content, '{p}') THEN 1.0 ELSE 0.0 END) AS {n}" for n, p in TEXT_MARKS.items()) + " FROM posts GROUP BY 1")
def text_ratios(spark, d):
    return social.posts(spark, d).groupBy("source").agg(*[F.avg(F.col("content").rlike(p).cast("double")).alias(n) for n, p in TEXT_MARKS.items()])


@query("author_text", "SELECT conv_id, md5(string_agg(text, ' ' ORDER BY turn)) AS digest, sum(length(text)) + count(*) - 1 AS n FROM conversations GROUP BY 1", views=False)
def author_text(spark, d):
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    joined = F.array_join(F.transform("t", lambda x: x["text"]), " ")
    return c.select("conv_id", F.md5(joined).alias("digest"), F.length(joined).cast("long").alias("n"))


@query("mean_embedding", "SELECT label, i, avg(x) AS mean FROM (SELECT label, unnest(embedding) AS x, unnest(range(64)) AS i FROM embeddings) GROUP BY 1, 2", views=False)
def mean_embedding(spark, d):
    return table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x")).alias("mean"))


@query("boundary_features", ", o AS (SELECT follower_id id, count(*) n FROM follows GROUP BY 1), i AS (SELECT followee_id id, count(*) n FROM follows GROUP BY 1) SELECT user_id, ln(1 + coalesce(o.n, 0)) AS out_log, ln(1 + coalesce(i.n, 0)) AS in_log, coalesce(o.n, 0) / greatest(coalesce(o.n, 0) + coalesce(i.n, 0), 1) AS out_share, o.n IS NOT NULL OR i.n IS NOT NULL AS observed FROM users LEFT JOIN o ON o.id = user_id LEFT JOIN i ON i.id = user_id")
def boundary_features(spark, d):
    f = social.follows(spark, d)
    o, i = (f.groupBy(F.col(c).alias("user_id")).agg(F.count("*").alias(n)) for c, n in (("follower_id", "o"), ("followee_id", "i")))
    u = social.users(spark, d).select("user_id").join(o, "user_id", "left").join(i, "user_id", "left")
    a, b = F.coalesce("o", F.lit(0)), F.coalesce("i", F.lit(0))
    return u.select("user_id", F.log1p(a).alias("out_log"), F.log1p(b).alias("in_log"), (a / F.greatest(a + b, F.lit(1))).alias("out_share"), (F.col("o").isNotNull() | F.col("i").isNotNull()).alias("observed"))


@query("score_rollup", "SELECT user_id, avg(s) AS mean, max(s) AS most, avg(CASE WHEN s >= 0.6 THEN 1.0 ELSE 0.0 END) AS over_share FROM (SELECT user_id, value / 100 AS s FROM trace) GROUP BY 1")
def score_rollup(spark, d):
    s = F.col("value") / 100
    return social.trace(spark, d).groupBy("user_id").agg(F.avg(s).alias("mean"), F.max(s).alias("most"), F.avg((s >= 0.6).cast("double")).alias("over_share"))


@query("frictionless_index", ", g AS (SELECT user_id, value / 100 AS a, date_diff('second', lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), ts) / 3600.0 AS delay FROM trace) SELECT user_id, avg(a) AS mean, max(a) AS most, max(a * CASE WHEN coalesce(delay, 0) <= 0 THEN 1 ELSE exp(-greatest(0, delay - 5) / 60) END) AS penalised FROM g GROUP BY 1")
def frictionless_index(spark, d):
    sec = F.expr("unix_seconds(cast(date_trunc('SECOND', ts) as timestamp))")
    t = social.trace(spark, d).withColumn("a", F.col("value") / 100).withColumn("delay", (sec - F.lag(sec).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))) / 3600.0)
    keep = F.when(F.coalesce("delay", F.lit(0.0)) <= 0, 1.0).otherwise(F.exp(-F.greatest(F.lit(0.0), F.col("delay") - 5) / 60))
    return t.groupBy("user_id").agg(F.avg("a").alias("mean"), F.max("a").alias("most"), F.max(F.col("a") * keep).alias("penalised"))


@query("class_profile", "SELECT is_bad, nation, avg(balance) AS balance, count(*) AS n FROM users GROUP BY 1, 2")
def class_profile(spark, d):
    return social.users(spark, d).groupBy("is_bad", "nation").agg(F.avg("balance").alias("balance"), F.count("*").alias("n"))


@query("run_audit", "SELECT 'action' AS what, action AS name, count(*) AS n FROM trace GROUP BY 2 UNION ALL SELECT 'role', user_type, count(*) FROM users GROUP BY 2 UNION ALL SELECT 'rows', 'posts', count(*) FROM posts UNION ALL SELECT 'agents', 'trace', count(DISTINCT user_id) FROM trace UNION ALL SELECT 'personas', 'not empty', count(*) FILTER (trim(user_name) <> '') FROM users")
def run_audit(spark, d):
    t = social.trace(spark, d)
    parts = [t.groupBy("action").count().select(F.lit("action").alias("what"), F.col("action").alias("name"), F.col("count").alias("n")), social.users(spark, d).groupBy("user_type").count().select(F.lit("role").alias("what"), F.col("user_type").alias("name"), F.col("count").alias("n")), social.posts(spark, d).agg(F.count("*").alias("n")).select(F.lit("rows").alias("what"), F.lit("posts").alias("name"), "n"), t.agg(F.countDistinct("user_id").alias("n")).select(F.lit("agents").alias("what"), F.lit("trace").alias("name"), "n"), social.users(spark, d).agg(F.count_if(F.trim("user_name") != "").alias("n")).select(F.lit("personas").alias("what"), F.lit("not empty").alias("name"), "n")]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("edge_audit", "SELECT relation, count(*) AS rows, count(*) FILTER (src % 10 = 3) AS core_source, count(*) FILTER (dst % 10 = 3) AS core_target, count(DISTINCT dst) FILTER (src % 10 = 3) AS incident FROM edges GROUP BY 1")
def edge_audit(spark, d):
    a, b = F.col("src") % 10 == 3, F.col("dst") % 10 == 3
    return social.edges(spark, d).groupBy("relation").agg(F.count("*").alias("rows"), F.count_if(a).alias("core_source"), F.count_if(b).alias("core_target"), F.countDistinct(F.when(a, F.col("dst"))).alias("incident"))


@query("json_census", "SELECT key, json_type(info, '$.' || key) AS kind, count(*) AS n FROM (SELECT info, unnest(json_keys(info)) AS key FROM trace) GROUP BY 1, 2")
def json_census(spark, d):
    t = social.trace(spark, d).select(F.expr("parse_json(info)").alias("v"))
    found = t.lateralJoin(spark.tvf.variant_explode(F.col("v").outer())).select("key", F.schema_of_variant("value").alias("kind"))
    kind = F.when(F.col("kind") == "BIGINT", "UBIGINT").when(F.col("kind") == "STRING", "VARCHAR").otherwise(F.col("kind"))
    return found.groupBy("key", kind.alias("kind")).agg(F.count("*").alias("n"))


PROFILED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("column_profile", " UNION ALL ".join(f"SELECT '{c}' AS name, count(*) AS n, count(*) FILTER ({c} = 0) AS zeros, count(*) FILTER (isnan({c})) AS nans, count(*) FILTER (isinf({c})) AS infs, count(*) FILTER (isfinite({c})) AS finite, min({c}) AS least, max({c}) AS most, avg({c}) AS mean, stddev_pop({c}) AS std FROM lineitem" for c in PROFILED), views=False)
def column_profile(spark, d):
    long = table(spark, d, "lineitem").unpivot([], PROFILED, "name", "v")
    v = F.col("v")
    return long.groupBy("name").agg(F.count("*").alias("n"), F.count_if(v == 0).alias("zeros"), F.count_if(F.isnan(v)).alias("nans"), F.count_if(F.abs(v) == float("inf")).alias("infs"), F.count_if(~F.isnan(v) & (F.abs(v) != float("inf"))).alias("finite"), F.min(v).alias("least"), F.max(v).alias("most"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"))


QS = (0.0, 0.25, 0.5, 0.75, 0.9, 0.99, 1.0)


@query("norm_quantiles", f"SELECT CAST(unnest({list(QS)}) AS DOUBLE) AS q, unnest(quantile_cont(n, {list(QS)})) AS norm FROM (SELECT sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))) AS n FROM embeddings)", views=False)
def norm_quantiles(spark, d):
    from tidemark.functions.geometry import norm

    q = table(spark, d, "embeddings").agg(F.percentile(norm(F.col("embedding")), F.array(*[F.lit(float(x)) for x in QS])).alias("v"))
    return q.select(F.explode(F.arrays_zip(F.array(*[F.lit(float(x)) for x in QS]).alias("q"), F.col("v").alias("norm"))).alias("z")).select("z.q", "z.norm")


@query("value_distribution", "SELECT o_orderpriority AS value, count(*) AS n, count(*) / sum(count(*)) OVER () AS rate FROM orders GROUP BY 1", views=False)
def value_distribution(spark, d):
    return ev.distribution(table(spark, d, "orders"), "o_orderpriority")


@query("relation_profile", ", m AS (SELECT relation, src, dst, count(*) AS k FROM edges GROUP BY 1, 2, 3), w AS (SELECT relation, avg(weight) AS mean_weight, count(*) FILTER (src = dst) AS self_loops FROM edges GROUP BY 1) SELECT m.relation, CAST(sum(k) AS BIGINT) AS rows, count(*) AS pairs, CAST(sum(k) - count(*) AS BIGINT) AS duplicates, max(k) AS most, any_value(mean_weight) AS mean_weight, any_value(self_loops) AS self_loops FROM m JOIN w USING (relation) GROUP BY 1")
def relation_profile(spark, d):
    e = social.edges(spark, d)
    m = e.groupBy("relation", "src", "dst").agg(F.count("*").alias("k"), F.sum("weight").alias("w"), F.count_if(F.col("src") == F.col("dst")).alias("s"))
    return m.groupBy("relation").agg(F.sum("k").alias("rows"), F.count("*").alias("pairs"), (F.sum("k") - F.count("*")).alias("duplicates"), F.max("k").alias("most"), (F.sum("w") / F.sum("k")).alias("mean_weight"), F.sum("s").alias("self_loops"))


@query("matrix_audit", ", v AS (SELECT vec_id, unnest(embedding) AS x, unnest(range(64)) AS i FROM embeddings) SELECT i, count(*) FILTER (x = 0) AS zeros, min(x) = 0 AND max(x) = 0 AS zero_column, min(x) = max(x) AS constant, count(*) FILTER (x <> 0 AND x <> 1) AS not_boolean, count(*) FILTER (x < 0 OR x > 1) AS outside_unit FROM v GROUP BY 1")
def matrix_audit(spark, d):
    """Of each column: zeros, whether it is all zero or constant, values that aren't 0 or 1, values outside of 0 to 1."""
    v, x = table(spark, d, "embeddings").select(F.posexplode("embedding").alias("i", "x")), F.col("x")
    return v.groupBy("i").agg(F.count_if(x == 0).alias("zeros"), ((F.min(x) == 0) & (F.max(x) == 0)).alias("zero_column"), (F.min(x) == F.max(x)).alias("constant"), F.count_if((x != 0) & (x != 1)).alias("not_boolean"), F.count_if((x < 0) | (x > 1)).alias("outside_unit"))


@query("matrix_row_audit", ", r AS (SELECT embedding AS e, count(*) AS n FROM embeddings GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS rows, CAST(coalesce(sum(n) FILTER (list_max(list_transform(e, lambda x: abs(x))) = 0), 0) AS BIGINT) AS zero_rows, CAST(sum(n) - count(*) AS BIGINT) AS duplicate_rows FROM r")
def matrix_row_audit(spark, d):
    """Rows, rows of zeros, and rows equal to an earlier one; rows are grouped by two digests of their values."""
    e = table(spark, d, "embeddings").select(F.xxhash64("embedding").alias("h"), F.md5(F.to_json("embedding")).alias("m"), (F.array_max(F.transform("embedding", F.abs)) == 0).alias("zero"))
    r = e.groupBy("h", "m").agg(F.count("*").alias("n"), F.max("zero").alias("zero"))
    return r.agg(F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(F.col("zero"), F.col("n"))), F.lit(0)).alias("zero_rows"), (F.sum("n") - F.count("*")).alias("duplicate_rows"))


@query("label_crosstab", "SELECT quality, toxic, count(*) AS n FROM labels GROUP BY 1, 2", views=False)
def label_crosstab(spark, d):
    return table(spark, d, "labels").groupBy("quality", "toxic").agg(F.count("*").alias("n"))


@query("role_crosstab", "SELECT user_type, nation, count(*) AS n, avg(is_bad) AS bad_share FROM users GROUP BY 1, 2")
def role_crosstab(spark, d):
    """Role by class, here user type by nation, with the share of coordinated accounts."""
    return social.users(spark, d).groupBy("user_type", "nation").agg(F.count("*").alias("n"), F.avg("is_bad").alias("bad_share"))


@query("self_loop_counts", "SELECT src, count(*) FILTER (relation = 'A') AS a, count(*) FILTER (relation = 'N') AS n, count(*) FILTER (relation = 'R') AS r FROM edges WHERE src = dst GROUP BY 1")
def self_loop_counts(spark, d):
    e = social.edges(spark, d).where("src = dst").groupBy("src").pivot("relation", ["A", "N", "R"]).count().fillna(0)
    return e.select("src", F.col("A").alias("a"), F.col("N").alias("n"), F.col("R").alias("r"))


@query("split_leakage", ", s AS (SELECT user_id, CASE WHEN event_id % 10 < 7 THEN 'train' WHEN event_id % 10 < 9 THEN 'validation' ELSE 'test' END AS split, action FROM trace) SELECT action, user_id, count(DISTINCT split) AS n_splits FROM s GROUP BY 1, 2 HAVING count(DISTINCT split) > 1")
def split_leakage(spark, d):
    k = F.col("event_id") % 10
    t = social.trace(spark, d).withColumn("split", F.when(k < 7, "train").when(k < 9, "validation").otherwise("test"))
    return t.groupBy("action", "user_id").agg(F.countDistinct("split").alias("n_splits")).where("n_splits > 1")


SPLIT_OF = "CASE WHEN p_partkey % 10 < 7 THEN 'train' WHEN p_partkey % 10 < 9 THEN 'validation' ELSE 'test' END"


@query("signature_leakage", f"SELECT sha256(p_name || '|' || p_brand || '|' || p_size) AS signature, count(DISTINCT {SPLIT_OF}) AS n_splits, count(*) AS n FROM part GROUP BY 1 HAVING count(DISTINCT {SPLIT_OF}) > 1", views=False)
def signature_leakage(spark, d):
    """Contents that stand in more than one split under different ids."""
    p = table(spark, d, "part").select(F.sha2(F.concat_ws("|", "p_name", "p_brand", "p_size"), 256).alias("signature"), F.expr(SPLIT_OF).alias("split"))
    return p.groupBy("signature").agg(F.countDistinct("split").alias("n_splits"), F.count("*").alias("n")).where("n_splits > 1")


@query("scenario_overlap", f", s AS (SELECT DISTINCT p_type AS scenario, {SPLIT_OF} AS split FROM part) SELECT a.scenario, a.split AS first, b.split AS second FROM s a JOIN s b ON a.scenario = b.scenario AND a.split < b.split")
def scenario_overlap(spark, d):
    """Scenarios that two splits have in common."""
    s = table(spark, d, "part").select(F.col("p_type").alias("scenario"), F.expr(SPLIT_OF).alias("split")).distinct()
    return s.withColumnRenamed("split", "first").join(s.withColumnRenamed("split", "second"), "scenario").where("first < second")


@query("plan_duplicates", "SELECT p_name, p_brand, count(*) AS n FROM part GROUP BY 1, 2 HAVING count(*) > 1", views=False)
def plan_duplicates(spark, d):
    return ops.duplicate_keys(table(spark, d, "part"), ["p_name", "p_brand"])


@query("activation_coverage", ", s AS (SELECT step, count(DISTINCT user_id) AS active, count(*) AS n FROM trace GROUP BY 1) SELECT step, active, n, coalesce(step - lag(step) OVER (ORDER BY step), 1) = 1 AS contiguous FROM s")
def activation_coverage(spark, d):
    s = social.trace(spark, d).groupBy("step").agg(F.countDistinct("user_id").alias("active"), F.count("*").alias("n"))
    before = s.select((F.col("step") + 1).alias("step"), F.lit(True).alias("had"))  # a join, so no single-task window over steps
    first = s.agg(F.min("step").alias("first"))
    return s.join(before, "step", "left").join(F.broadcast(first), F.col("step") == F.col("first"), "left").select("step", "active", "n", (F.coalesce("had", F.lit(False)) | F.col("first").isNotNull()).alias("contiguous"))


@query("activation_audit", ", s AS (SELECT step, count(DISTINCT user_id) AS active, count(*) AS n FROM trace GROUP BY 1), u AS (SELECT count(*) AS users FROM users) SELECT max(step) - min(step) + 1 = count(*) AS contiguous, count(*) FILTER (active > users) AS over_budget, CAST(sum(n - active) AS BIGINT) AS repeated, (SELECT count(*) FROM users u WHERE u.user_id NOT IN (SELECT user_id FROM trace WHERE step < 15)) AS not_before_cutoff FROM s, u")
def activation_audit(spark, d):
    """Whether steps follow each other, steps with more active accounts than there are, repeated activations, and accounts never active before the cutoff."""
    t, u = social.trace(spark, d), social.users(spark, d).select("user_id")
    s = t.groupBy("step").agg(F.countDistinct("user_id").alias("active"), F.count("*").alias("n"))
    n = u.agg(F.count("*").alias("users"))
    late = u.join(t.where("step < 15").select("user_id").distinct(), "user_id", "left_anti").agg(F.count("*").alias("not_before_cutoff"))
    one = s.join(F.broadcast(n), F.lit(True)).agg((F.max("step") - F.min("step") + 1 == F.count("*")).alias("contiguous"), F.count_if(F.col("active") > F.col("users")).alias("over_budget"), F.sum(F.col("n") - F.col("active")).alias("repeated"))
    return one.join(F.broadcast(late), F.lit(True))  # rows of totals


SCORED = "scored AS (SELECT doc_id, toxic AS y, (n_chars * 37 % 1000) / 1000.0 AS p FROM labels JOIN documents USING (doc_id))"


def scored(spark, d):
    j = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return j.select("doc_id", F.col("toxic").alias("y"), (F.col("n_chars") * 37 % 1000 / 1000.0).alias("p"))


@query("clf_metrics", f", {SCORED}, c AS (SELECT count(*) FILTER (p >= 0.5 AND y = 1) AS tp, count(*) FILTER (p >= 0.5 AND y = 0) AS fp, count(*) FILTER (p < 0.5 AND y = 1) AS fn, count(*) FILTER (p < 0.5 AND y = 0) AS tn FROM scored) SELECT *, tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall, 2 * tp / nullif(2 * tp + fp + fn, 0) AS f1, (tp + tn) / (tp + tn + fp + fn) AS accuracy, fn / nullif(tp + fn, 0) AS escape_rate FROM c")
def clf_metrics(spark, d):
    return ev.confusion(scored(spark, d))


@query("auc_ap", f", {SCORED}, g AS (SELECT p, sum(y) AS pos, sum(1 - y) AS neg FROM scored GROUP BY 1), c AS (SELECT p, pos, neg, sum(neg) OVER (ORDER BY p) - neg AS below, sum(pos) OVER (ORDER BY p DESC) AS tp, sum(pos + neg) OVER (ORDER BY p DESC) AS seen FROM g) SELECT sum(pos * (below + neg / 2.0)) / (sum(pos) * sum(neg)) AS auc, sum(pos * tp / seen) / sum(pos) AS ap FROM c")
def auc_ap(spark, d):
    return ev.auc_ap(scored(spark, d))


@query("calibration", f", {SCORED}, b AS (SELECT least(floor(p * 10), 9) AS bin, count(*) AS n, avg(p) AS mean_p, avg(y) AS rate FROM scored GROUP BY 1) SELECT (SELECT avg((p - y) * (p - y)) FROM scored) AS brier, sum(n * abs(mean_p - rate)) / sum(n) AS ece FROM b")
def calibration(spark, d):
    return ev.calibration(scored(spark, d))


@query("metric_rollup", "SELECT avg(m) AS macro, sum(m * n) / sum(n) AS weighted FROM (SELECT nullif(avg(CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END), 0) AS m, count(*) AS n FROM trace GROUP BY user_id) WHERE m IS NOT NULL")
def metric_rollup(spark, d):
    g = social.trace(spark, d).groupBy("user_id").agg(F.avg((F.col("value") > 50).cast("double")).alias("m"), F.count("*").alias("n")).where("m != 0")
    return g.agg(F.avg("m").alias("macro"), (F.sum(F.col("m") * F.col("n")) / F.sum("n")).alias("weighted"))


NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
PAIRS = [(a, b) for i, a in enumerate(NUM) for b in NUM[i + 1 :]]


@query("feature_corr", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM lineitem" for a, b in PAIRS), views=False)
def feature_corr(spark, d):
    return ev.correlations(table(spark, d, "lineitem"), NUM)


@query("vif")
def vif(spark, d):
    return ev.vif(table(spark, d, "lineitem"), NUM)


MODULES = {"amount": ["l_quantity", "l_extendedprice"], "rate": ["l_discount", "l_tax"]}


def two_regressors(y: str, a: str, b: str) -> str:
    """R2 of a column on two others from their correlations, as SQL."""
    return f"(corr({y}, {a}) ^ 2 + corr({y}, {b}) ^ 2 - 2 * corr({y}, {a}) * corr({y}, {b}) * corr({a}, {b})) / (1 - corr({a}, {b}) ^ 2)"


@query(
    "module_independence",
    "WITH r AS (" + " UNION ALL ".join(f"SELECT '{m}' AS module, ({two_regressors(own[0], *other)} + {two_regressors(own[1], *other)}) / 2 AS r2 FROM lineitem" for m, own, other in (("amount", *MODULES.values()), ("rate", *reversed(MODULES.values())))) + ") SELECT module, r2, 1 / (1 - r2) AS vif, r2 < 0.5 AS independent FROM r",
    views=False,
)
def module_independence(spark, d):
    return ev.module_independence(table(spark, d, "lineitem"), MODULES)


@query("module_correlations", "SELECT 'amount' AS a, 'amount' AS b, abs(corr(l_quantity, l_extendedprice)) AS mean_r FROM lineitem UNION ALL SELECT 'rate', 'rate', abs(corr(l_discount, l_tax)) FROM lineitem UNION ALL SELECT 'amount', 'rate', (abs(corr(l_quantity, l_discount)) + abs(corr(l_quantity, l_tax)) + abs(corr(l_extendedprice, l_discount)) + abs(corr(l_extendedprice, l_tax))) / 4 FROM lineitem", views=False)
def module_correlations(spark, d):
    return ev.module_correlations(table(spark, d, "lineitem"), MODULES)


@query("anova_f", ", g AS (SELECT user_type AS k, count(*) AS n, avg(balance) AS m, var_pop(balance) * count(*) AS ss FROM users GROUP BY 1), t AS (SELECT avg(balance) AS m, count(*) AS n FROM users) SELECT (sum(g.n * (g.m - t.m) ^ 2) / (count(*) - 1)) / (sum(ss) / (any_value(t.n) - count(*))) AS f FROM g, t")
def anova_f(spark, d):
    return ev.anova_f(social.users(spark, d), "user_type", "balance")


#: The expansion of Student's t quantile about the normal's, for more than 30 degrees of freedom.
Z = 1.959963984540054
T_SQL = f"{Z} + ({Z}^3 + {Z}) / (4 * df) + (5 * {Z}^5 + 16 * {Z}^3 + 3 * {Z}) / (96 * df^2) + (3 * {Z}^7 + 19 * {Z}^5 + 17 * {Z}^3 - 15 * {Z}) / (384 * df^3)"


@query("mean_ci", f", c AS (SELECT *, CAST(round(value * 100) AS BIGINT) AS cents FROM trace), g AS (SELECT user_id, step, avg(cents) AS mean, count(*) AS n, count(*) - 1.0 AS df, stddev_samp(cents) AS s FROM c GROUP BY GROUPING SETS ((user_id, step), (user_id))) SELECT user_id, step, n, mean, CASE WHEN df > 0 THEN (CASE WHEN df > 30 THEN {T_SQL} ELSE {ev.T95}[CAST(df AS INTEGER)] END) * s / sqrt(n) END AS half FROM g")
def mean_ci(spark, d):
    """Mean and 95 % interval of the value, in hundredths, for each account and step, and for each account."""
    t = social.trace(spark, d).withColumn("cents", F.round(F.col("value") * 100).cast("long"))
    each = ev.mean_interval(t.withColumn("g", F.struct("user_id", "step")), "g", "cents").select("g.user_id", "g.step", "n", "mean", "half")
    return each.unionByName(ev.mean_interval(t, "user_id", "cents").withColumn("step", F.lit(None).cast("long")))


@query("curve_rmse", ", m AS (SELECT action, step, count(*) AS n FROM trace GROUP BY 1, 2) SELECT a.action, sqrt(avg((a.n - b.n) ^ 2)) / max(b.n) AS rmse FROM m a JOIN m b ON a.step = b.step AND b.action = 'view' WHERE a.action <> 'view' GROUP BY 1")
def curve_rmse(spark, d):
    m = social.trace(spark, d).groupBy("action", "step").agg(F.count("*").alias("n"))
    real = m.where("action = 'view'").select("step", F.col("n").alias("real"))
    return m.where("action != 'view'").join(real, "step").groupBy("action").agg((F.sqrt(F.avg(F.pow(F.col("n") - F.col("real"), 2))) / F.max("real")).alias("rmse"))


@query("histogram", "SELECT CAST(floor(value / 10) AS BIGINT) AS bin, count(*) AS n FROM trace GROUP BY 1")
def histogram(spark, d):
    return social.trace(spark, d).groupBy(F.floor(F.col("value") / 10).alias("bin")).agg(F.count("*").alias("n"))


@query("cluster_purity", "SELECT max(n) / sum(n) AS purity FROM (SELECT nation, count(*) AS n FROM users WHERE is_bad = 1 GROUP BY 1)")
def cluster_purity(spark, d):
    return social.users(spark, d).where("is_bad = 1").groupBy("nation").agg(F.count("*").alias("n")).agg((F.max("n") / F.sum("n")).alias("purity"))


LISTS = "lists AS (SELECT follower_id, list(followee_id) AS following FROM follows GROUP BY 1)"


@query("followers_from_lists", f", {LISTS} SELECT u AS user_id, count(*) AS followers FROM (SELECT unnest(following) AS u FROM lists) GROUP BY 1")
def followers_from_lists(spark, d):
    lists = social.follows(spark, d).groupBy("follower_id").agg(F.collect_list("followee_id").alias("following"))
    return lists.select(F.explode("following").alias("user_id")).groupBy("user_id").agg(F.count("*").alias("followers"))


@query("edges_from_lists", f", {LISTS} SELECT follower_id AS src, CAST(x AS BIGINT) AS dst FROM (SELECT follower_id, unnest(following) AS x FROM lists) WHERE x IN (SELECT user_id FROM users WHERE is_bad = 1)")
def edges_from_lists(spark, d):
    lists = social.follows(spark, d).groupBy("follower_id").agg(F.to_json(F.collect_list("followee_id")).alias("text"))
    e = lists.select(F.col("follower_id").alias("src"), F.explode(F.from_json("text", "array<bigint>")).alias("dst"))
    return e.join(social.users(spark, d).where("is_bad = 1").select(F.col("user_id").alias("dst")), "dst", "left_semi").select("src", "dst")


@query("paired_summary", "SELECT a.user_id % 5 AS seed, avg(a.n - b.n) AS mean_gain, count(*) FILTER (a.n > b.n) AS wins, count(*) AS pairs FROM (SELECT user_id, count(*) AS n FROM trace WHERE action = 'click' GROUP BY 1) a JOIN (SELECT user_id, count(*) AS n FROM trace WHERE action = 'view' GROUP BY 1) b USING (user_id) GROUP BY 1")
def paired_summary(spark, d):
    w = social.trace(spark, d).groupBy("user_id").pivot("action", ["click", "view"]).count().dropna()
    return w.groupBy((F.col("user_id") % 5).alias("seed")).agg(F.avg(F.col("click") - F.col("view")).alias("mean_gain"), F.count_if(F.col("click") > F.col("view")).alias("wins"), F.count("*").alias("pairs"))


@query("rag_counters", "SELECT CAST(sum(len(regexp_extract_all(text, '\\bde\\b'))) AS BIGINT) AS de, CAST(sum(len(regexp_extract_all(text, '\\bthe\\b'))) AS BIGINT) AS the, count(DISTINCT source) AS sources FROM documents", views=False)
def rag_counters(spark, d):
    return table(spark, d, "documents").agg(F.sum(F.regexp_count("text", F.lit(r"(?<![A-Za-z0-9_])de(?![A-Za-z0-9_])"))).alias("de"), F.sum(F.regexp_count("text", F.lit(r"(?<![A-Za-z0-9_])the(?![A-Za-z0-9_])"))).alias("the"), F.countDistinct("source").alias("sources"))


@query("input_audit", "SELECT count(*) AS n, count(DISTINCT doc_id) AS ids, min(doc_id) AS lo, max(doc_id) AS hi, count(*) FILTER (trim(coalesce(text, '')) = '') AS empty FROM documents", views=False)
def input_audit(spark, d):
    return table(spark, d, "documents").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("ids"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count_if(F.trim(F.coalesce("text", F.lit(""))) == "").alias("empty"))


@query("profile_quality", "SELECT doc_id, len(string_split(text, ' ')) AS words, len(string_split(text, ' ')) >= 80 AND n_chars >= 400 AS ok FROM documents", views=False)
def profile_quality(spark, d):
    w = F.size(F.split("text", " "))
    return table(spark, d, "documents").select("doc_id", w.alias("words"), ((w >= 80) & (F.col("n_chars") >= 400)).alias("ok"))


@query("pool_counts", "SELECT source, count(*) AS items, count(*) FILTER (text <> '') AS filled, count(DISTINCT text) AS unique_texts FROM documents GROUP BY 1", views=False)
def pool_counts(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("items"), F.count_if(F.col("text") != "").alias("filled"), F.countDistinct("text").alias("unique_texts"))


@query("behavior_table", ", p AS (SELECT user_id, count(*) n, sum(num_likes) l FROM posts GROUP BY 1), t AS (SELECT user_id, count(*) FILTER (action = 'like') AS given, count(*) FILTER (action = 'comment') AS comments FROM reactions GROUP BY 1), o AS (SELECT follower_id id, count(*) n FROM follows GROUP BY 1), i AS (SELECT followee_id id, count(*) n FROM follows GROUP BY 1) SELECT u.user_id, coalesce(p.n, 0) AS n_posts, CAST(coalesce(p.l, 0) AS BIGINT) AS likes_received, coalesce(t.given, 0) AS likes_given, coalesce(t.comments, 0) AS n_comments, coalesce(o.n, 0) AS out_degree, coalesce(i.n, 0) AS in_degree, coalesce(o.n, 0) / (coalesce(i.n, 0) + 1) AS out_in FROM users u LEFT JOIN p USING (user_id) LEFT JOIN t USING (user_id) LEFT JOIN o ON o.id = u.user_id LEFT JOIN i ON i.id = u.user_id")
def behavior_table(spark, d):
    p = social.posts(spark, d).groupBy("user_id").agg(F.count("*").alias("n_posts"), F.sum("num_likes").alias("likes_received"))
    t = social.reactions(spark, d).groupBy("user_id").agg(F.count_if(F.col("action") == "like").alias("likes_given"), F.count_if(F.col("action") == "comment").alias("n_comments"))
    f = social.follows(spark, d)
    o, i = (f.groupBy(F.col(c).alias("user_id")).agg(F.count("*").alias(n)) for c, n in (("follower_id", "out_degree"), ("followee_id", "in_degree")))
    u = social.users(spark, d).select("user_id")
    for x in (p, t, o, i):
        u = u.join(x, "user_id", "left")
    return u.fillna(0).withColumn("out_in", F.col("out_degree") / (F.col("in_degree") + 1))


@query(
    "post_features",
    ", e AS (SELECT *, length(content) AS n, post_id % 24 AS h FROM posts) SELECT post_id, ln(1 + n) AS log_chars, ln(1 + len(string_split(trim(content), ' '))) AS log_words, "
    "length(regexp_replace(content, '[^A-Z]', '', 'g')) / greatest(n, 1) AS upper_ratio, length(regexp_replace(content, '[^.,;:!?]', '', 'g')) / greatest(n, 1) AS punct_ratio, "
    "len(regexp_extract_all(content, 'https?://')) AS urls, len(regexp_extract_all(content, '@')) AS mentions, len(regexp_extract_all(content, '#')) AS hashtags, "
    "CAST(original_post_id IS NOT NULL AND NOT is_quote AS INTEGER) AS is_repost, CAST(is_quote AS INTEGER) AS is_quote, CAST(contains(content, '?') AS INTEGER) AS asks, "
    "ln(1 + num_likes) AS log_likes, ln(1 + num_dislikes) AS log_dislikes, sin(2 * pi() * h / 24) AS hour_sin, cos(2 * pi() * h / 24) AS hour_cos FROM e",
)
def post_features(spark, d):
    """Fourteen observed features: log lengths, character ratios, counts of links, mentions and hashtags, flags, log counters, hour on a circle."""
    text, n, angle = F.col("content"), F.greatest(F.length("content"), F.lit(1)), 2 * F.pi() * (F.col("post_id") % 24) / 24
    count = lambda p: F.regexp_count(text, F.lit(p))
    return social.posts(spark, d).select(
        "post_id", F.log1p(F.length(text)).alias("log_chars"), F.log1p(F.size(F.split(F.trim(text), " "))).alias("log_words"),
        (count("[A-Z]") / n).alias("upper_ratio"), (count("[.,;:!?]") / n).alias("punct_ratio"), count("https?://").alias("urls"), count("@").alias("mentions"), count("#").alias("hashtags"),
        (F.col("original_post_id").isNotNull() & ~F.col("is_quote")).cast("int").alias("is_repost"), F.col("is_quote").cast("int").alias("is_quote"), text.contains("?").cast("int").alias("asks"),
        F.log1p("num_likes").alias("log_likes"), F.log1p("num_dislikes").alias("log_dislikes"), F.sin(angle).alias("hour_sin"), F.cos(angle).alias("hour_cos"),
    )


#: First-person words.
FIRST = ("i", "me", "my", "mine", "je", "moi", "ich", "mich", "yo", "la")


@query("narcissism_boost", f", w AS (SELECT doc_id, string_split(lower(text), ' ') AS w, (n_chars % 100) / 100.0 AS base FROM documents), x AS (SELECT doc_id, base, len(list_filter(w, lambda x: x IN {FIRST})) / len(w) AS dens FROM w) SELECT doc_id, least(1, base + least(0.5 * dens, 0.2)) AS boosted, 0.70 * least(1, base + least(0.5 * dens, 0.2)) + 0.15 * base + 0.15 * dens AS index FROM x")
def narcissism_boost(spark, d):
    w = F.split(F.lower("text"), " ")
    x = table(spark, d, "documents").select("doc_id", (F.col("n_chars") % 100 / 100.0).alias("base"), (F.size(F.filter(w, lambda t: t.isin(*FIRST))) / F.size(w)).alias("dens"))
    b = F.least(F.lit(1.0), F.col("base") + F.least(0.5 * F.col("dens"), F.lit(0.2)))
    return x.select("doc_id", b.alias("boosted"), (0.70 * b + 0.15 * F.col("base") + 0.15 * F.col("dens")).alias("index"))


@query("empathy_gap", ", x AS (SELECT doc_id, (n_chars % 83) / 83.0 AS arousal, least(n_chars / 5000.0, 1) AS depth, n_chars % 4000 + 2 AS ppl, len(string_split(text, ' ')) AS tokens FROM documents), y AS (SELECT *, greatest(0, least(1, 1 - (ln(ppl) - ln(2)) / (ln(4001) - ln(2)))) AS fluency FROM x) SELECT doc_id, arousal * CASE WHEN tokens >= 15 THEN 0.6 * depth + 0.4 * fluency ELSE 0 END AS gap FROM y")
def empathy_gap(spark, d):
    n = F.col("n_chars")
    fluency = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - (F.ln(n % 4000 + 2) - F.ln(F.lit(2))) / (F.ln(F.lit(4001)) - F.ln(F.lit(2)))))
    rigidity = F.when(F.size(F.split("text", " ")) >= 15, 0.6 * F.least(n / 5000.0, F.lit(1.0)) + 0.4 * fluency).otherwise(0.0)
    return table(spark, d, "documents").select("doc_id", (n % 83 / 83.0 * rigidity).alias("gap"))


@query("edge_reliability", "SELECT src, dst, ln(1 + sum(weight)) AS log_weight, ln(1 + count(*)) AS log_multiplicity, least(greatest(max(weight) * 10, 0), 1) AS gate FROM edges GROUP BY 1, 2")
def edge_reliability(spark, d):
    return social.edges(spark, d).groupBy("src", "dst").agg(F.log1p(F.sum("weight")).alias("log_weight"), F.log1p(F.count("*")).alias("log_multiplicity"), F.least(F.greatest(F.max("weight") * 10, F.lit(0.0)), F.lit(1.0)).alias("gate"))


@query("action_vocab", "SELECT action, row_number() OVER (ORDER BY action) - 1 AS idx FROM (SELECT DISTINCT action FROM trace WHERE step < 20)")
def action_vocab(spark, d):
    v = social.trace(spark, d).where("step < 20").select("action").distinct()
    # a vocabulary is small by nature: its size is the number of action names
    return v.select("action", (F.row_number().over(Window.orderBy("action")) - 1).alias("idx"))


@query("target_masks", "SELECT u.user_id, l.toxic AS target, l.toxic IS NOT NULL AS mask, CASE WHEN u.is_bad = 1 THEN u.nation END AS privileged FROM users u LEFT JOIN labels l ON l.doc_id = u.user_id")
def target_masks(spark, d):
    lab = table(spark, d, "labels").select(F.col("doc_id").alias("user_id"), F.col("toxic").alias("target"))
    return social.users(spark, d).join(lab, "user_id", "left").select("user_id", "target", F.col("target").isNotNull().alias("mask"), F.when(F.col("is_bad") == 1, F.col("nation")).alias("privileged"))


@query("cutoff_check", "SELECT count(*) FILTER (step > 20) AS violations, count(*) AS n FROM trace WHERE user_id < 75")
def cutoff_check(spark, d):
    return social.trace(spark, d).where("user_id < 75").agg(F.count_if(F.col("step") > 20).alias("violations"), F.count("*").alias("n"))


@query("circular_hours", "SELECT event_id, least(abs(hour(ts) - 21), 24 - abs(hour(ts) - 21)) AS apart FROM trace")
def circular_hours(spark, d):
    return social.trace(spark, d).select("event_id", ids.circular_hours(F.hour("ts"), F.lit(21)).alias("apart"))


TRACED = ["view", "click", "signup", "purchase", "error"]


@query(
    "behavior_full",
    ", p AS (SELECT user_id, count(*) AS n FROM posts GROUP BY 1), lr AS (SELECT p.user_id, count(*) AS n FROM reactions r JOIN posts p USING (post_id) WHERE r.action = 'like' GROUP BY 1), "
    "rg AS (SELECT user_id, count(*) FILTER (action = 'like') AS given, count(*) FILTER (action = 'comment') AS comments FROM reactions GROUP BY 1), "
    "t AS (SELECT user_id, " + ", ".join(f"count(*) FILTER (action = '{a}') AS trace_{a}" for a in TRACED) + " FROM trace GROUP BY 1), o AS (SELECT follower_id AS user_id, count(*) AS n FROM follows GROUP BY 1), i AS (SELECT followee_id AS user_id, count(*) AS n FROM follows GROUP BY 1), "
    "sym AS (SELECT a, b, count(*) AS m FROM (SELECT follower_id AS a, followee_id AS b FROM follows UNION ALL SELECT followee_id, follower_id FROM follows) GROUP BY 1, 2), k AS (SELECT a AS user_id, sum(m) AS d, count(*) FILTER (m = 2) AS r FROM sym GROUP BY 1), "
    "tri AS (SELECT x.a AS user_id, sum(x.m * y.m * z.m) AS n FROM sym x JOIN sym y ON y.a = x.b JOIN sym z ON z.a = y.b AND z.b = x.a GROUP BY 1) "
    "SELECT u.user_id, u.user_type, coalesce(p.n, 0) AS post_count, coalesce(rg.comments, 0) AS comment_count, coalesce(rg.given, 0) AS given_likes, coalesce(lr.n, 0) AS received_likes, "
    + ", ".join(f"coalesce(trace_{a}, 0) AS trace_{a}" for a in TRACED)
    + ", coalesce(o.n, 0) AS out_degree, coalesce(i.n, 0) AS in_degree, CASE WHEN d * (d - 1) - 2 * r > 0 THEN coalesce(tri.n, 0) / (2.0 * (d * (d - 1) - 2 * r)) ELSE 0 END AS clustering, coalesce(o.n, 0) / greatest(coalesce(i.n, 0), 1) AS out_in_ratio "
    "FROM users u LEFT JOIN p USING (user_id) LEFT JOIN lr USING (user_id) LEFT JOIN rg USING (user_id) LEFT JOIN t USING (user_id) LEFT JOIN o USING (user_id) LEFT JOIN i USING (user_id) LEFT JOIN k USING (user_id) LEFT JOIN tri USING (user_id)",
)
def behavior_full(spark, d):
    """Activity, likes given and received, five trace counters, degrees, directed clustering and ratio of every account."""
    posts, reactions, follows = social.posts(spark, d), social.reactions(spark, d), social.follows(spark, d)
    action = F.col("action")
    parts = [
        posts.groupBy("user_id").agg(F.count("*").alias("post_count")),
        reactions.groupBy("user_id").agg(F.count_if(action == "comment").alias("comment_count"), F.count_if(action == "like").alias("given_likes")),
        reactions.where(action == "like").groupBy("post_id").agg(F.count("*").alias("n")).join(posts.select("post_id", "user_id"), "post_id").groupBy("user_id").agg(F.sum("n").alias("received_likes")),
        social.trace(spark, d).groupBy("user_id").agg(*[F.count_if(action == a).alias(f"trace_{a}") for a in TRACED]),
        *[follows.groupBy(F.col(c).alias("user_id")).agg(F.count("*").alias(n)) for c, n in (("follower_id", "out_degree"), ("followee_id", "in_degree"))],
        graph.directed_clustering(follows.select(F.col("follower_id").alias("src"), F.col("followee_id").alias("dst"))).select(F.col("node").alias("user_id"), F.col("coefficient").alias("clustering")),
    ]
    u = social.users(spark, d).select("user_id", "user_type")
    for x in parts:
        u = u.join(x, "user_id", "left")
    return u.fillna(0).withColumn("out_in_ratio", F.col("out_degree") / F.greatest(F.col("in_degree"), F.lit(1)))


EPISODES = "(SELECT p_partkey AS episode_id, CASE WHEN p_partkey % 3 = 0 THEN 'real' ELSE 'synthetic' END AS domain, CASE p_partkey % 3 WHEN 0 THEN 'baseline' WHEN 1 THEN 'simulation_main' ELSE 'simulation_scale' END AS purpose, p_brand AS scenario_id, CASE WHEN p_size % 7 > 0 THEN p_size * 10 END AS num_agents FROM part)"


@query("plan_summary", "SELECT count(*) AS episodes, count(*) FILTER (domain = 'real') AS real_episodes, count(*) FILTER (domain = 'synthetic') AS synthetic_episodes, CAST(sum(CASE WHEN domain = 'synthetic' THEN coalesce(num_agents, 0) ELSE 0 END) AS BIGINT) AS synthetic_agents, "
       f"list_sort(list_distinct(list(scenario_id) FILTER (purpose = 'simulation_main'))) AS main_scenarios, list_sort(list_distinct(list(num_agents) FILTER (purpose = 'simulation_scale' AND num_agents IS NOT NULL))) AS scale_sizes FROM {EPISODES}", views=False)  # fmt: skip
def plan_summary(spark, d):
    """A plan's episodes by domain, agents of its synthetic ones, and the scenarios and sizes that it covers."""
    n = F.col("p_partkey") % 3
    episodes = table(spark, d, "part").select(
        F.when(n == 0, "real").otherwise("synthetic").alias("domain"), F.when(n == 0, "baseline").when(n == 1, "simulation_main").otherwise("simulation_scale").alias("purpose"),
        F.col("p_brand").alias("scenario_id"), F.when(F.col("p_size") % 7 > 0, F.col("p_size") * 10).alias("num_agents"),
    )
    return ops.plan_summary(episodes)


@query("value_counts", "SELECT 'l_returnflag' AS name, l_returnflag AS value, count(*) AS n FROM lineitem GROUP BY 2 UNION ALL SELECT 'l_linestatus', l_linestatus, count(*) FROM lineitem GROUP BY 2 UNION ALL SELECT 'l_linenumber', CAST(l_linenumber AS VARCHAR), count(*) FROM lineitem GROUP BY 2", views=False)
def value_counts(spark, d):
    return ops.value_counts(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"])


@query("paired_gate", ", s AS (SELECT user_id % 8 AS seed, action AS method, avg(value) AS distortion, count(*) / 100.0 AS agreement, max(value) / 1000 AS loss FROM trace WHERE action IN ('click', 'view') GROUP BY 1, 2), "
       "p AS (SELECT a.distortion - b.distortion AS reduction, b.agreement - a.agreement AS gain, b.loss - a.loss AS change FROM s a JOIN s b USING (seed) WHERE a.method = 'click' AND b.method = 'view'), "
       "o AS (SELECT count(*) AS pairs, avg(reduction) AS mean_reduction, avg(gain) AS mean_gain, avg(change) AS mean_change, count(*) FILTER (reduction > 0) AS better, count(*) FILTER (gain >= 0) AS kept, coalesce(max(change) <= 0.02, false) AS tolerable FROM p) "
       "SELECT *, pairs >= 5 AND better >= ceil(0.8 * pairs) AND kept >= ceil(0.8 * pairs) AND tolerable AS ready FROM o")  # fmt: skip
def paired_gate(spark, d):
    t = social.trace(spark, d).where("action in ('click', 'view')")
    rows = t.groupBy((F.col("user_id") % 8).alias("seed"), F.col("action").alias("method")).agg(F.avg("value").alias("distortion"), (F.count("*") / 100.0).alias("agreement"), (F.max("value") / 1000).alias("loss"))
    return ev.paired_gate(rows, "click", "view")


@query("profile_check", "SELECT p_partkey AS row, 4 + CAST(p_size % 2 AS BIGINT) AS leaves, CAST(1 + p_size % 3 AS BIGINT) AS words, p_size % 2 = 1 AND p_size % 3 > 0 AS valid FROM part", views=False)
def profile_check(spark, d):
    """Quality of nested profiles made of the parts' columns."""
    size = F.col("p_size").cast("int")
    extra = F.when(size % 2 == 1, '"some"').otherwise('" "')
    summary = F.array_join(F.array_repeat(F.lit("word"), (1 + size % 3).cast("int")), " ")
    text = F.concat(F.lit('{"Summary": "'), summary, F.lit('", "Generated At": 1, "Base": {"brand": "'), F.col("p_brand"), F.lit('", "size": '), size.cast("string"), F.lit(', "more": ['), extra, F.lit(', "x", {}, null]}, "Other": {"deep": {"er": 5}, "none": ""}}'))
    return nested.profile_quality(table(spark, d, "part").select(F.col("p_partkey").alias("row"), text.alias("json")), 5, 2)


@query("padded_scale", ", f AS (SELECT post_id, user_id, min(step) AS step FROM reactions GROUP BY 1, 2), g AS (SELECT post_id, step, CAST(sum(count(*)) OVER (PARTITION BY post_id ORDER BY step) AS BIGINT) AS scale FROM f GROUP BY 1, 2), spine AS (SELECT post_id, unnest(range(300)) AS step FROM (SELECT DISTINCT post_id FROM g)) "
       "SELECT s.post_id, s.step, (SELECT max(scale) FROM g WHERE g.post_id = s.post_id AND g.step <= s.step) AS scale FROM spine s")  # fmt: skip
def padded_scale(spark, d):
    """Cumulative scale of each cascade over 300 steps, padded with the last value."""
    first = social.reactions(spark, d).groupBy("post_id", "user_id").agg(F.min("step").alias("step"))
    g = first.groupBy("post_id", "step").agg(F.count("*").alias("n")).withColumn("scale", F.sum("n").over(Window.partitionBy("post_id").orderBy("step")))
    return ops.padded(g, "post_id", "step", "scale", 300)
