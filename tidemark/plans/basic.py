"""Queries over scans, ids, text, joins and coalescing of edges."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import ids
from tidemark.operators import nested
from tidemark.operators import tables as ops
from tidemark.plans.registry import query
from tidemark.plans.shared import table
from tidemark.sources import social

CLASS_AGG = """SELECT user_type, count(*) AS n_actions, count(DISTINCT user_id) AS n_users, count(*) FILTER (action = 'click') / count(*) AS click_share FROM trace JOIN users USING (user_id) GROUP BY user_type"""


@query("class_actions", CLASS_AGG)
def class_actions(spark, d):
    j = social.trace(spark, d).join(social.users(spark, d), "user_id")
    return j.groupBy("user_type").agg(F.count("*").alias("n_actions"), F.countDistinct("user_id").alias("n_users"), (F.count_if(F.col("action") == "click") / F.count("*")).alias("click_share"))


@query("scan_users", "SELECT user_id, user_name, user_type FROM users WHERE nation = 3")
def scan_users(spark, d):
    return social.users(spark, d).where("nation = 3").select("user_id", "user_name", "user_type")


@query("scan_edges", "SELECT src, dst, relation FROM edges WHERE relation = 'R'")
def scan_edges(spark, d):
    return social.edges(spark, d).where("relation = 'R'").select("src", "dst", "relation")


@query("scan_posts", "SELECT post_id, user_id, num_likes FROM posts WHERE num_likes > 50")
def scan_posts(spark, d):
    return social.posts(spark, d).where("num_likes > 50").select("post_id", "user_id", "num_likes")


@query("label_contract", "SELECT user_id, user_type, is_bad, CASE WHEN is_bad = 1 THEN 'bot' ELSE 'human' END AS label, coalesce(nullif(trim(user_name), ''), 'unknown') AS description FROM users")
def label_contract(spark, d):
    u = social.users(spark, d).drop("is_bad").withColumn("is_bad", F.lower("user_type").contains("bad").cast("int"))
    return u.select("user_id", "user_type", "is_bad", F.when(F.col("is_bad") == 1, "bot").otherwise("human").alias("label"), F.coalesce(F.when(F.trim("user_name") != "", F.trim("user_name")), F.lit("unknown")).alias("description"))


@query("emb_dim_check", "SELECT len(embedding) AS dims, count(*) AS n, count(DISTINCT vec_id) AS n_ids FROM embeddings GROUP BY 1", views=False)
def emb_dim_check(spark, d):
    return table(spark, d, "embeddings").groupBy(F.size("embedding").alias("dims")).agg(F.count("*").alias("n"), F.countDistinct("vec_id").alias("n_ids"))


@query("bundle_check", "SELECT 'users' AS part, count(*) AS n, count(DISTINCT user_id) AS n_ids FROM users UNION ALL SELECT 'posts', count(*), count(DISTINCT post_id) FROM posts UNION ALL SELECT 'edges', count(*), count(DISTINCT evidence) FROM edges")
def bundle_check(spark, d):
    parts = [("users", social.users, "user_id"), ("posts", social.posts, "post_id"), ("edges", social.edges, "evidence")]
    rows = [f(spark, d).agg(F.count("*").alias("n"), F.countDistinct(k).alias("n_ids")).select(F.lit(p).alias("part"), "n", "n_ids") for p, f, k in parts]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query("platform_export", "SELECT p.post_id, p.user_id, u.user_name, p.step AS created_at, p.num_likes, count(r.event_id) AS n_reactions FROM posts p JOIN users u USING (user_id) LEFT JOIN reactions r ON r.post_id = p.post_id GROUP BY ALL")
def platform_export(spark, d):
    r = social.reactions(spark, d).groupBy("post_id").agg(F.count("*").alias("n_reactions"))
    return social.posts(spark, d).join(social.users(spark, d), "user_id").join(r, "post_id", "left").select("post_id", "user_id", "user_name", F.col("step").alias("created_at"), "num_likes", F.coalesce("n_reactions", F.lit(0)).alias("n_reactions"))


@query("content_hash", "SELECT c_custkey AS user_id, sha256('{\"name\":\"' || c_name || '\",\"segment\":\"' || c_mktsegment || '\"}') AS sha FROM customer", views=False)
def content_hash(spark, d):
    # keys in order, volatile ones left out
    return table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.sha2(F.to_json(F.struct(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))), 256).alias("sha"))


NESTED = "concat('{\"user\": ', user_id, ', \"props\": ', props, ', \"Generated At\": \"', event_id, '\", \"about\": {\"Profile Index\": ', event_id, ', \"value\": ', value, ', \"kind\": {\"', event_type, '\": [', event_id, '.0, {\"Generated At\": 1}, \"a.b\"]}}}')"


@query("nested_hash", "SELECT event_id, sha256('{\"about\":{\"kind\":{\"' || event_type || '\":[' || event_id || ',{},\"a.b\"]},\"value\":' || CASE WHEN value = floor(value) THEN CAST(CAST(value AS BIGINT) AS VARCHAR) ELSE CAST(value AS VARCHAR) END || '},\"props\":{\"k\":' || json_extract_string(props, '$.k') || '},\"user\":' || user_id || '}') AS sha FROM events", views=False)
def nested_hash(spark, d):
    """Digests of nested records whose volatile keys, at any depth, and order of keys don't count."""
    e = table(spark, d, "events").select("event_id", F.expr(NESTED).alias("json"))
    return nested.with_canonical(e, "json", ("Generated At", "Profile Index")).select("event_id", F.sha2("canonical", 256).alias("sha"))


@query(
    "nested_tree",
    "SELECT event_id AS row, unnest(['user', 'props', 'props.k', 'about', 'about.value', 'about.kind', 'about.kind.' || event_type]) AS node, unnest([1, 1, 2, 1, 2, 2, 3]) AS depth, unnest([NULL, NULL, 'props', NULL, 'about', 'about', 'about.kind']) AS parent,"
    " unnest([0, 1, 0, 2, 0, 1, 0]) AS children, unnest([2, 2, 0, 2, 1, 1, 0]) AS siblings FROM events",
    views=False,
)
def nested_tree(spark, d):
    """Taxonomy nodes of nested records; lists are leaves."""
    e = table(spark, d, "events").select(F.col("event_id").alias("row"), F.expr(NESTED).alias("json"))
    return nested.taxonomy(nested.leaves(e, ("Generated At", "Profile Index"), lists=False))


@query("log_split", "SELECT CAST(nullif(regexp_extract(line, 'Agent ([0-9]+)\\b', 1), '') AS BIGINT) AS agent_id, count(*) AS n FROM (SELECT CASE WHEN event_id % 7 = 0 THEN 'INFO system tick' ELSE 'INFO Agent ' || user_id || ' did ' || action END AS line FROM trace) GROUP BY 1")
def log_split(spark, d):
    t = social.trace(spark, d)
    line = F.when(F.col("event_id") % 7 == 0, "INFO system tick").otherwise(F.concat(F.lit("INFO Agent "), F.col("user_id"), F.lit(" did "), F.col("action")))
    n = F.regexp_extract(line, r"Agent (\d+)\b", 1)
    return t.groupBy(F.when(n != "", n.cast("long")).alias("agent_id")).agg(F.count("*").alias("n"))


@query("follow_timeline", "SELECT user_id AS src, target AS dst, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nth FROM trace WHERE action = 'signup' AND target IS NOT NULL")
def follow_timeline(spark, d):
    t = social.trace(spark, d).where("action = 'signup' AND target IS NOT NULL")
    return t.select(F.col("user_id").alias("src"), F.col("target").alias("dst"), "ts", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("nth"))


ODD_ID = "CASE c_custkey % 6 WHEN 0 THEN ' ' || c_custkey || ' ' WHEN 1 THEN 'NaN' WHEN 2 THEN c_custkey || '.0' WHEN 3 THEN 'u' || c_custkey WHEN 4 THEN '' ELSE c_name END"


def odd_ids(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.expr(ODD_ID).alias("raw"))


NOT_ID = "lower(trim(raw)) IN ('', 'none', 'nan', 'null')"


@query("canon_id", f"SELECT c_custkey, CASE WHEN NOT ({NOT_ID}) THEN trim(raw) END AS id FROM (SELECT c_custkey, {ODD_ID} AS raw FROM customer)", views=False)
def canon_id(spark, d):
    return odd_ids(spark, d).select("c_custkey", ids.canonical_id(F.col("raw")).alias("id"))


@query("canon_int_id", f"SELECT c_custkey, regexp_replace(CASE WHEN NOT ({NOT_ID}) THEN trim(raw) END, '^(-?[0-9]+)\\.0+$', '\\1') AS id FROM (SELECT c_custkey, {ODD_ID} AS raw FROM customer)", views=False)
def canon_int_id(spark, d):
    return odd_ids(spark, d).select("c_custkey", ids.integer_id(F.col("raw")).alias("id"))


@query("id_alias", f"SELECT c_custkey, unnest(CASE WHEN regexp_matches(trim(raw), '^u?[0-9]+$') THEN [ltrim(trim(raw), 'u'), 'u' || ltrim(trim(raw), 'u')] ELSE [CASE WHEN NOT ({NOT_ID}) THEN trim(raw) END] END) AS alias FROM (SELECT c_custkey, {ODD_ID} AS raw FROM customer)", views=False)
def id_alias(spark, d):
    return odd_ids(spark, d).select("c_custkey", F.explode(ids.id_aliases(F.col("raw"))).alias("alias"))


@query("relation_map", "SELECT CASE relation WHEN 'A' THEN 'follow' WHEN 'N' THEN 'mention' END AS action, count(*) AS n FROM edges WHERE relation IN ('A', 'N') GROUP BY 1")
def relation_map(spark, d):
    names = F.create_map(F.lit("A"), F.lit("follow"), F.lit("N"), F.lit("mention"))
    return social.edges(spark, d).where(F.col("relation").isin("A", "N")).groupBy(names[F.col("relation")].alias("action")).agg(F.count("*").alias("n"))


@query("canon_follow", "SELECT CASE WHEN relation = 'R' THEN dst ELSE src END AS follower, CASE WHEN relation = 'R' THEN src ELSE dst END AS followee, count(*) AS n FROM edges GROUP BY 1, 2")
def canon_follow(spark, d):
    flip = F.col("relation") == "R"
    e = social.edges(spark, d).select(F.when(flip, F.col("dst")).otherwise(F.col("src")).alias("follower"), F.when(flip, F.col("src")).otherwise(F.col("dst")).alias("followee"))
    return e.groupBy("follower", "followee").agg(F.count("*").alias("n"))


@query("evidence_safe_cols", "SELECT user_id, user_name, nation, balance FROM users")
def evidence_safe_cols(spark, d):
    blocked = {"user_type", "is_bad"}
    u = social.users(spark, d)
    return u.select(*[c for c in u.columns if c not in blocked])


@query("label_normalize", "SELECT CASE WHEN user_type LIKE '%bad%' THEN 'bot' WHEN user_type LIKE '%good%' THEN 'human' END AS label, count(*) AS n, count(*) FILTER (user_type NOT LIKE '%bad%' AND user_type NOT LIKE '%good%') AS rejected FROM users GROUP BY 1")
def label_normalize(spark, d):
    t = F.lower("user_type")
    label = F.when(t.contains("bad"), "bot").when(t.contains("good"), "human")
    return social.users(spark, d).groupBy(label.alias("label")).agg(F.count("*").alias("n"), F.count_if(label.isNull()).alias("rejected"))


@query("split_normalize", "SELECT CASE lower(s) WHEN 'val' THEN 'validation' WHEN 'dev' THEN 'validation' ELSE lower(s) END AS split, count(*) AS n FROM (SELECT CASE c_custkey % 4 WHEN 0 THEN 'Train' WHEN 1 THEN 'val' WHEN 2 THEN 'DEV' ELSE 'test' END AS s FROM customer) GROUP BY 1", views=False)
def split_normalize(spark, d):
    s = F.element_at(F.array(*map(F.lit, ("Train", "val", "DEV", "test"))), (F.col("c_custkey") % 4 + 1).cast("int"))
    low = F.lower(s)
    return table(spark, d, "customer").groupBy(F.when(low.isin("val", "dev"), "validation").otherwise(low).alias("split")).agg(F.count("*").alias("n"))


@query("search_posts", "SELECT post_id, user_id FROM posts WHERE content ILIKE '%license%' OR CAST(post_id AS VARCHAR) LIKE '%77%'")
def search_posts(spark, d):
    return social.posts(spark, d).where(F.col("content").ilike("%license%") | F.col("post_id").cast("string").contains("77")).select("post_id", "user_id")


@query("search_users", "SELECT user_id, user_name FROM users WHERE user_name ILIKE '%0012%' OR user_type ILIKE '%BAD_%' AND CAST(user_id AS VARCHAR) LIKE '%3%'")
def search_users(spark, d):
    u = social.users(spark, d)
    return u.where(F.col("user_name").ilike("%0012%") | (F.col("user_type").ilike("%BAD_%") & F.col("user_id").cast("string").contains("3"))).select("user_id", "user_name")


@query("post_type", "SELECT CASE WHEN original_post_id IS NULL THEN 'common' WHEN is_quote THEN 'quote' ELSE 'repost' END AS kind, count(*) AS n FROM posts GROUP BY 1")
def post_type(spark, d):
    return social.posts(spark, d).groupBy(ids.post_type(F.col("original_post_id"), F.col("is_quote")).alias("kind")).agg(F.count("*").alias("n"))


@query("artifact_contract", ", wanted AS (SELECT DISTINCT lang, unnest(['src0', 'src1', 'src2', 'none']) AS source FROM posts) SELECT w.lang, w.source FROM wanted w ANTI JOIN posts p ON w.lang = p.lang AND w.source = p.source")
def artifact_contract(spark, d):
    p = social.posts(spark, d)
    wanted = p.select("lang").distinct().select("lang", F.explode(F.array(*map(F.lit, ("src0", "src1", "src2", "none")))).alias("source"))
    return wanted.join(p.select("lang", "source"), ["lang", "source"], "left_anti")


@query("profile_eligible", "SELECT user_id, CAST(regexp_extract(k, 'Count_([0-9]+)', 1) AS INT) AS attributes FROM (SELECT user_id, 'profile_Count_' || (user_id % 400) || '.json' AS k FROM users) WHERE CAST(regexp_extract(k, 'Count_([0-9]+)', 1) AS INT) >= 300")
def profile_eligible(spark, d):
    k = F.concat(F.lit("profile_Count_"), F.col("user_id") % 400, F.lit(".json"))
    n = F.regexp_extract(k, r"Count_(\d+)", 1).cast("int")
    return social.users(spark, d).where(n >= 300).select("user_id", n.alias("attributes"))


@query("no_self_reaction", "SELECT r.event_id, r.user_id, r.post_id, r.action FROM reactions r JOIN posts p ON r.post_id = p.post_id WHERE r.user_id <> p.user_id AND r.action IN ('like', 'dislike')")
def no_self_reaction(spark, d):
    p = social.posts(spark, d).select("post_id", F.col("user_id").alias("author"))
    return social.reactions(spark, d).where(F.col("action").isin("like", "dislike")).join(p, "post_id").where("user_id != author").select("event_id", "user_id", "post_id", "action")


@query("bad_original_posts", "SELECT count(*) AS n FROM posts JOIN users USING (user_id) WHERE is_bad = 1 AND original_post_id IS NULL")
def bad_original_posts(spark, d):
    return social.posts(spark, d).where("original_post_id IS NULL").join(social.users(spark, d).where("is_bad = 1"), "user_id").agg(F.count("*").alias("n"))


CORE = "core AS (SELECT s_suppkey AS id FROM supplier WHERE s_suppkey % 10 = 3)"


def core(spark, d):
    return table(spark, d, "supplier").where("s_suppkey % 10 = 3").select(F.col("s_suppkey").alias("id"))


def neighbourhood(edges, core):
    """Edges with an end in the core, with flags for either end."""
    a, b = core.select(F.col("id").alias("src"), F.lit(True).alias("a")), core.select(F.col("id").alias("dst"), F.lit(True).alias("b"))
    return edges.join(a, "src", "left").join(b, "dst", "left").where("a or b").select("src", "dst", "relation", "evidence", F.coalesce("a", F.lit(False)).alias("src_core"), F.coalesce("b", F.lit(False)).alias("dst_core"))


@query("open_neighborhood", f", {CORE} SELECT src, dst, relation, evidence, src IN (SELECT id FROM core) AS src_core, dst IN (SELECT id FROM core) AS dst_core FROM edges WHERE src IN (SELECT id FROM core) OR dst IN (SELECT id FROM core)")
def open_neighborhood(spark, d):
    return neighbourhood(social.edges(spark, d), core(spark, d))


@query("boundary_users", f", {CORE}, near AS (SELECT src, dst FROM edges WHERE src IN (SELECT id FROM core) OR dst IN (SELECT id FROM core)) SELECT DISTINCT id FROM (SELECT src AS id FROM near UNION ALL SELECT dst FROM near) WHERE id NOT IN (SELECT id FROM core)")
def boundary_users(spark, d):
    near = neighbourhood(social.edges(spark, d), core(spark, d))
    return near.select(F.explode(F.array("src", "dst")).alias("id")).distinct().join(core(spark, d), "id", "left_anti")


@query("missing_core", "SELECT DISTINCT user_id FROM trace WHERE user_id NOT IN (SELECT user_id FROM posts WHERE lang = 'es')")
def missing_core(spark, d):
    return ops.missing_keys(social.trace(spark, d), social.posts(spark, d).where("lang = 'es'"), "user_id")


@query("action_post_resolve", "SELECT t.event_id, coalesce(p.post_id, q.post_id) AS post_id, CASE WHEN p.post_id IS NULL AND q.post_id IS NULL THEN 'entity:' || t.target END AS node FROM (SELECT event_id, user_id, target * 20 AS target FROM trace) t LEFT JOIN posts p ON p.post_id = t.target LEFT JOIN posts q ON q.post_id = t.user_id * 9")
def action_post_resolve(spark, d):
    t = social.trace(spark, d).select("event_id", (F.col("target") * 20).alias("target"), (F.col("user_id") * 9).alias("source"))
    p = social.posts(spark, d).select("post_id")
    j = t.join(p.withColumnRenamed("post_id", "target_post"), F.col("target") == F.col("target_post"), "left").join(p.withColumnRenamed("post_id", "source_post"), F.col("source") == F.col("source_post"), "left")
    post = F.coalesce("target_post", "source_post")
    return j.select("event_id", post.alias("post_id"), F.when(post.isNull(), F.concat(F.lit("entity:"), F.col("target"))).alias("node"))


@query("join_1to1_check", "SELECT user_id, user_name, n FROM users LEFT JOIN (SELECT user_id, count(*) AS n FROM trace GROUP BY 1) USING (user_id)")
def join_1to1_check(spark, d):
    n = social.trace(spark, d).groupBy("user_id").agg(F.count("*").alias("n"))
    return ops.join_one_to_one(social.users(spark, d).select("user_id", "user_name"), n, "user_id")


@query("feed_following", "SELECT f.follower_id AS user_id, p.post_id, p.num_likes FROM follows f JOIN posts p ON p.user_id = f.followee_id WHERE p.step = 29")
def feed_following(spark, d):
    p = social.posts(spark, d).where("step = 29")
    return social.follows(spark, d).join(p, F.col("followee_id") == p["user_id"]).select(F.col("follower_id").alias("user_id"), "post_id", "num_likes")


@query("good_follows_bad", "SELECT follower_id, followee_id FROM follows JOIN users a ON a.user_id = follower_id JOIN users b ON b.user_id = followee_id WHERE a.is_bad = 0 AND b.is_bad = 1")
def good_follows_bad(spark, d):
    u = social.users(spark, d)
    good, bad = u.where("is_bad = 0").select(F.col("user_id").alias("follower_id")), u.where("is_bad = 1").select(F.col("user_id").alias("followee_id"))
    return social.follows(spark, d).join(good, "follower_id").join(bad, "followee_id").select("follower_id", "followee_id")


@query("bot_subgraph", "SELECT follower_id, followee_id FROM follows WHERE follower_id IN (SELECT user_id FROM users WHERE is_bad = 1) AND followee_id IN (SELECT user_id FROM users WHERE is_bad = 1)")
def bot_subgraph(spark, d):
    bad = social.users(spark, d).where("is_bad = 1").select("user_id")
    return social.follows(spark, d).join(bad, F.col("follower_id") == F.col("user_id"), "left_semi").join(bad, F.col("followee_id") == F.col("user_id"), "left_semi")


@query("reverse_coverage", "SELECT count(*) AS edges, count(*) FILTER (EXISTS (SELECT 1 FROM follows r WHERE r.follower_id = f.followee_id AND r.followee_id = f.follower_id)) AS reversed FROM follows f")
def reverse_coverage(spark, d):
    f = social.follows(spark, d)
    swapped = f.select(F.col("followee_id").alias("follower_id"), F.col("follower_id").alias("followee_id"), F.lit(1).alias("back"))
    return f.join(swapped, ["follower_id", "followee_id"], "left").agg(F.count("*").alias("edges"), F.count("back").alias("reversed"))


@query("comment_context", "SELECT t.event_id, p.user_id AS author, u.user_type, p.num_likes FROM trace t JOIN posts p ON p.post_id = t.target JOIN users u ON u.user_id = t.user_id WHERE t.action = 'purchase'")
def comment_context(spark, d):
    t = social.trace(spark, d).where("action = 'purchase'").withColumn("post_id", F.from_json("info", "k bigint")["k"])
    p = social.posts(spark, d).select("post_id", F.col("user_id").alias("author"), "num_likes")
    return t.join(p, "post_id").join(social.users(spark, d), "user_id").select("event_id", "author", "user_type", "num_likes")


EV = "ev AS (SELECT user_id, list(event_id ORDER BY event_id) AS ids FROM trace GROUP BY 1)"


@query("evidence_link", f", {EV}, one AS (SELECT user_id, unnest(ids) * 2 AS evidence_id FROM ev) SELECT o.user_id, o.evidence_id, t.action, t.event_id IS NULL AS unresolved FROM one o LEFT JOIN trace t ON t.event_id = o.evidence_id")
def evidence_link(spark, d):
    t = social.trace(spark, d)
    one = t.select("user_id", (F.col("event_id") * 2).alias("evidence_id"))
    return one.join(t.select(F.col("event_id").alias("evidence_id"), "action", F.lit(True).alias("hit")), "evidence_id", "left").select("user_id", "evidence_id", "action", F.col("hit").isNull().alias("unresolved"))


@query("evidence_for_user", "SELECT DISTINCT event_id, action FROM trace WHERE user_id = 42 OR target = 42")
def evidence_for_user(spark, d):
    t = social.trace(spark, d)
    return t.where("user_id = 42").union(t.where("target = 42")).select("event_id", "action").distinct()


@query("run_pairs", "SELECT a.user_id, a.n AS first_run, b.n AS second_run FROM (SELECT user_id, count(*) AS n FROM trace WHERE step < 15 GROUP BY 1) a JOIN (SELECT user_id, count(*) AS n FROM trace WHERE step >= 15 GROUP BY 1) b USING (user_id)")
def run_pairs(spark, d):
    t = social.trace(spark, d)
    a, b = (t.where(c).groupBy("user_id").agg(F.count("*").alias(n)) for c, n in (("step < 15", "first_run"), ("step >= 15", "second_run")))
    return a.join(b, "user_id")


@query("edge_coalesce", "SELECT src, dst, relation, count(*) AS multiplicity, list(evidence ORDER BY evidence) AS evidence_ids FROM edges GROUP BY 1, 2, 3")
def edge_coalesce(spark, d):
    return social.edges(spark, d).groupBy("src", "dst", "relation").agg(F.count("*").alias("multiplicity"), F.array_sort(F.collect_list("evidence")).alias("evidence_ids"))


@query("edge_coalesce_weighted", "SELECT src, dst, relation, count(*) AS multiplicity, min(weight) AS weight, max(weight) - min(weight) <= 1e-7 + 1e-6 * abs(max(weight)) AS agrees FROM edges GROUP BY 1, 2, 3")
def edge_coalesce_weighted(spark, d):
    lo, hi = F.min("weight"), F.max("weight")
    return social.edges(spark, d).groupBy("src", "dst", "relation").agg(F.count("*").alias("multiplicity"), lo.alias("weight"), (hi - lo <= 1e-7 + 1e-6 * F.abs(hi)).alias("agrees"))


@query("add_reverse", "SELECT src, dst, relation, false AS synthetic FROM edges WHERE relation = 'R' UNION ALL SELECT dst, src, relation, true FROM edges WHERE relation = 'R'")
def add_reverse(spark, d):
    e = social.edges(spark, d).where("relation = 'R'").select("src", "dst", "relation")
    back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "relation")
    return e.withColumn("synthetic", F.lit(False)).unionByName(back.withColumn("synthetic", F.lit(True)))


@query("typed_edges", "SELECT 'user' AS src_type, user_id AS src, 'posts' AS relation, 'post' AS dst_type, post_id AS dst FROM posts UNION ALL SELECT 'post', post_id, 'authored_by', 'user', user_id FROM posts")
def typed_edges(spark, d):
    p = social.posts(spark, d)
    fwd = p.select(F.lit("user").alias("src_type"), F.col("user_id").alias("src"), F.lit("posts").alias("relation"), F.lit("post").alias("dst_type"), F.col("post_id").alias("dst"))
    return fwd.unionByName(p.select(F.lit("post").alias("src_type"), F.col("post_id").alias("src"), F.lit("authored_by").alias("relation"), F.lit("user").alias("dst_type"), F.col("user_id").alias("dst")))


@query("text_pool", "SELECT lang, content, min(post_id) AS first_post, count(*) AS copies FROM posts GROUP BY 1, 2 HAVING count(*) > 1")
def text_pool(spark, d):
    return social.posts(spark, d).groupBy("lang", "content").agg(F.min("post_id").alias("first_post"), F.count("*").alias("copies")).where("copies > 1")


@query("assignment_diff", ", a AS (SELECT DISTINCT user_id FROM trace WHERE step < 3 AND action = 'error'), b AS (SELECT DISTINCT user_id FROM trace WHERE step > 26) SELECT user_id, 'left' AS side FROM a WHERE user_id NOT IN (SELECT user_id FROM b) UNION ALL SELECT user_id, 'right' FROM b WHERE user_id NOT IN (SELECT user_id FROM a)")
def assignment_diff(spark, d):
    t = social.trace(spark, d)
    return ops.set_difference(t.where("step < 3 AND action = 'error'"), t.where("step > 26"), "user_id")


@query("graph_metadata", "SELECT DISTINCT 'user' AS src_type, relation, 'item' AS dst_type FROM edges UNION SELECT DISTINCT 'user', action, 'post' FROM reactions")
def graph_metadata(spark, d):
    a = social.edges(spark, d).select(F.lit("user").alias("src_type"), "relation", F.lit("item").alias("dst_type"))
    return a.unionByName(social.reactions(spark, d).select(F.lit("user").alias("src_type"), F.col("action").alias("relation"), F.lit("post").alias("dst_type"))).distinct()


@query("evidence_union", "SELECT 'trace:' || event_id AS evidence_id, action AS kind, user_id AS actor FROM trace UNION ALL SELECT 'post:' || post_id, 'post', user_id FROM posts UNION ALL SELECT 'follow:' || follower_id || '>' || followee_id, 'follow', follower_id FROM follows")
def evidence_union(spark, d):
    one = lambda df, i, k, a: df.select(i.alias("evidence_id"), k.alias("kind"), F.col(a).alias("actor"))
    t = one(social.trace(spark, d), F.concat(F.lit("trace:"), F.col("event_id")), F.col("action"), "user_id")
    p = one(social.posts(spark, d), F.concat(F.lit("post:"), F.col("post_id")), F.lit("post"), "user_id")
    return t.unionByName(p).unionByName(one(social.follows(spark, d), F.concat(F.lit("follow:"), F.col("follower_id"), F.lit(">"), F.col("followee_id")), F.lit("follow"), "follower_id"))


@query("evidence_long", "SELECT user_id, 'name' AS field, user_name AS value FROM users UNION ALL SELECT user_id, 'nation', CAST(nation AS VARCHAR) FROM users")
def evidence_long(spark, d):
    u = social.users(spark, d).select("user_id", F.col("user_name").alias("name"), F.col("nation").cast("string").alias("nation"))
    return u.unpivot("user_id", ["name", "nation"], "field", "value")


@query("clean_text", "SELECT doc_id, lower(trim(regexp_replace(regexp_replace(regexp_replace(text, 'https?://[^ \\t\\r\\n]+|www\\.[^ \\t\\r\\n]+', '', 'g'), '@[A-Za-z0-9_]+', '', 'g'), '[ \\t\\r\\n]+', ' ', 'g'))) AS clean FROM documents", views=False)
def clean_text(spark, d):
    return table(spark, d, "documents").select("doc_id", ids.clean_text(F.col("text")).alias("clean"))


@query("tweet_pool", "SELECT doc_id, len(list_filter(list_transform(string_split(text, ' | '), lambda x: trim(x)), lambda x: length(x) > 7)) AS kept, len(string_split(text, ' | ')) AS parts FROM documents", views=False)
def tweet_pool(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(ids.text_pool(F.col("text"), 7)).alias("kept"), F.size(F.split("text", r" \| ")).alias("parts"))


@query("content_node_id", "SELECT e.event_id, CASE WHEN e.action = 'like' THEN substr(sha256(p.content), 1, 24) ELSE CAST(e.event_id AS VARCHAR) END AS node FROM reactions e JOIN posts p USING (post_id)")
def content_node_id(spark, d):
    j = social.reactions(spark, d).join(social.posts(spark, d).select("post_id", "content"), "post_id")
    return j.select("event_id", ids.content_node(F.col("action"), F.col("content"), F.col("event_id")).alias("node"))


@query("role_campaign", "SELECT user_id, CASE nation % 3 WHEN 0 THEN 'seed' WHEN 1 THEN 'amplifier' ELSE 'bystander' END AS role, CASE WHEN is_bad = 1 THEN 'campaign_' || nation END AS campaign FROM users")
def role_campaign(spark, d):
    roles = F.element_at(F.array(*map(F.lit, ("seed", "amplifier", "bystander"))), (F.col("nation") % 3 + 1).cast("int"))
    return social.users(spark, d).select("user_id", roles.alias("role"), F.when(F.col("is_bad") == 1, F.concat_ws("_", F.lit("campaign"), F.col("nation"))).alias("campaign"))


@query("post_view", "SELECT p.post_id, CASE WHEN p.original_post_id IS NULL THEN 'User ' || p.user_id || ' posted' WHEN p.is_quote THEN 'User ' || p.user_id || ' quoted a post from user ' || o.user_id ELSE 'User ' || p.user_id || ' reposted a post from user ' || o.user_id END AS view, p.num_likes - p.num_dislikes AS score FROM posts p LEFT JOIN posts o ON o.post_id = p.original_post_id")
def post_view(spark, d):
    p = social.posts(spark, d)
    o = p.select(F.col("post_id").alias("original_post_id"), F.col("user_id").alias("origin"))
    verb = F.when(F.col("is_quote"), "quoted").otherwise("reposted")
    view = F.when(F.col("original_post_id").isNull(), F.format_string("User %d posted", "user_id")).otherwise(F.format_string("User %d %s a post from user %d", F.col("user_id"), verb, F.col("origin")))
    return p.join(o, "original_post_id", "left").select("post_id", view.alias("view"), (F.col("num_likes") - F.col("num_dislikes")).alias("score"))


@query("short_text", "SELECT post_id, substr(replace(replace(content, chr(10), ' '), chr(13), ' '), 1, 120) AS short, length(content) > 120 AS cut FROM posts")
def short_text(spark, d):
    """Content on one line, at most 120 characters of it."""
    return social.posts(spark, d).select("post_id", ids.short_text(F.col("content"), 120).alias("short"), (F.length("content") > 120).alias("cut"))


@query("nli_calibration", "SELECT event_id, (value / 100 - (event_id % 101) / 100.0 + 1) / 2 AS score FROM trace")
def nli_calibration(spark, d):
    """Entailment and contradiction shares, as a scorer would leave them, on one scale from 0 to 1."""
    return social.trace(spark, d).select("event_id", ids.nli_score(F.col("value") / 100, F.col("event_id") % 101 / 100.0).alias("score"))


@query("coarse_filter", "SELECT post_id FROM posts ORDER BY md5('coarse|' || post_id), post_id LIMIT 100")
def coarse_filter(spark, d):
    """A hundred posts at random, by the order of a seeded digest: the candidates for a costly ranking."""
    return social.posts(spark, d).select("post_id").orderBy(F.md5(F.concat(F.lit("coarse|"), F.col("post_id"))), "post_id").limit(100)


REACTED = "SELECT user_id AS src, post_id AS dst FROM reactions WHERE action = '{}' AND post_id IS NOT NULL"
RELATIONS = [("user", "posts", "post", "authored_by", "SELECT user_id AS src, post_id AS dst FROM posts"), ("user", "follows", "user", "followed_by", "SELECT follower_id AS src, followee_id AS dst FROM follows"), ("user", "likes", "post", "liked_by", REACTED.format("like")), ("user", "comments_on", "post", "commented_by", REACTED.format("comment"))]


@query(
    "typed_graph",
    ", e AS (" + " UNION ALL ".join(f"SELECT '{a}' AS src_type, src, '{r}' AS relation, '{b}' AS dst_type, dst FROM ({sql}) UNION ALL SELECT '{b}', dst, '{inverse}', '{a}', src FROM ({sql})" for a, r, b, inverse, sql in RELATIONS) + ") SELECT src_type, relation, dst_type, count(*) AS edges, CAST(sum(src * 31 + dst) AS BIGINT) AS mark FROM e GROUP BY 1, 2, 3",
)
def typed_graph(spark, d):
    """Edges of four relations and their inverses, counted with a mark of their ends."""
    r = social.reactions(spark, d)
    reacted = lambda action: r.where(F.col("action") == action).select(F.col("user_id").alias("src"), F.col("post_id").alias("dst"))
    tables = [social.posts(spark, d).select(F.col("user_id").alias("src"), F.col("post_id").alias("dst")), social.follows(spark, d).select(F.col("follower_id").alias("src"), F.col("followee_id").alias("dst")), reacted("like"), reacted("comment")]
    e = ops.typed_edges([(t, a, relation, b, inverse) for t, (a, relation, b, inverse, _) in zip(tables, RELATIONS, strict=True)])
    return e.groupBy("src_type", "relation", "dst_type").agg(F.count("*").alias("edges"), F.sum(F.col("src") * 31 + F.col("dst")).alias("mark"))


@query(
    "evidence_all",
    "SELECT 'trace:' || event_id AS evidence_id, 'trace' AS kind, user_id AS actor, action AS text FROM trace UNION ALL SELECT 'post:' || post_id, 'post', user_id, lang FROM posts UNION ALL SELECT 'follow:' || follower_id || '>' || followee_id, 'follow', follower_id, NULL FROM follows "
    "UNION ALL SELECT 'comment:' || event_id || '>' || post_id, 'comment', user_id, NULL FROM reactions WHERE action = 'comment' AND post_id IS NOT NULL UNION ALL SELECT 'like:' || user_id || '>' || post_id || '>' || event_id, 'like', user_id, NULL FROM reactions WHERE action = 'like' AND post_id IS NOT NULL UNION ALL SELECT 'user:' || user_id, 'user', user_id, user_name FROM users",
)
def evidence_all(spark, d):
    """Evidence rows of six tables in one form."""
    r = social.reactions(spark, d)
    return ops.evidence_rows([
        (social.trace(spark, d), "trace", ["event_id"], "user_id", "action"), (social.posts(spark, d), "post", ["post_id"], "user_id", "lang"), (social.follows(spark, d), "follow", ["follower_id", "followee_id"], "follower_id", None),
        (r.where("action = 'comment'"), "comment", ["event_id", "post_id"], "user_id", None), (r.where("action = 'like'"), "like", ["user_id", "post_id", "event_id"], "user_id", None), (social.users(spark, d), "user", ["user_id"], "user_id", "user_name"),
    ])


@query("evidence_from_lists", ", c AS (SELECT c_custkey AS user_id, c_name || ' ; ;' || c_mktsegment AS names, CASE WHEN c_custkey % 3 > 0 THEN c_nationkey || '|x' END AS places FROM customer), u AS (SELECT user_id, 'names' AS field, list_filter(list_transform(string_split_regex(names, '\\s*[;|]\\s*'), lambda x: trim(x)), lambda x: x <> '') AS v FROM c UNION ALL SELECT user_id, 'places', list_filter(string_split_regex(coalesce(places, ''), '\\s*[;|]\\s*'), lambda x: x <> '') FROM c) SELECT user_id, field, unnest(range(1, len(v) + 1)) AS position, unnest(v) AS value FROM u")
def evidence_from_lists(spark, d):
    """Entries of text lists in two columns, in order."""
    c = table(spark, d, "customer")
    rows = c.select(F.col("c_custkey").alias("user_id"), F.concat("c_name", F.lit(" ; ;"), "c_mktsegment").alias("names"), F.when(F.col("c_custkey") % 3 > 0, F.concat(F.col("c_nationkey").cast("string"), F.lit("|x"))).alias("places"))
    return ops.evidence_lists(rows, "user_id", ["names", "places"])
