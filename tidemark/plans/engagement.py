"""Queries over reactions, exposure, cascades and folds of the action log."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import cascade, counters, graph
from tidemark.operators import tables as ops
from tidemark.plans.registry import query

from tidemark.sources import social

WITH_ROOTS = social.SQL.replace("WITH trace", "WITH RECURSIVE trace", 1) + ", roots AS (SELECT post_id, post_id AS root, 0 AS depth FROM posts WHERE original_post_id IS NULL UNION ALL SELECT p.post_id, r.root, r.depth + 1 FROM posts p JOIN roots r ON p.original_post_id = r.post_id)"


def roots(spark, d):
    return graph.resolve_roots(social.posts(spark, d).select(F.col("post_id").alias("id"), F.col("original_post_id").alias("parent"))).withColumnRenamed("id", "post_id")


@query("root_post", WITH_ROOTS + " SELECT post_id, root, depth FROM roots", views=False)
def root_post(spark, d):
    return roots(spark, d)


def interactions(spark, d):
    """Reactions with the class of the actor and of the root post's author."""
    p = social.posts(spark, d).select(F.col("post_id").alias("root"), F.col("user_id").alias("author"))
    u = social.users(spark, d).select("user_id", "is_bad")
    r = social.reactions(spark, d).join(roots(spark, d).select("post_id", "root"), "post_id").join(p, "root")
    return r.join(u.withColumnRenamed("is_bad", "actor_bad"), "user_id").join(u.select(F.col("user_id").alias("author"), F.col("is_bad").alias("target_bad")), "author")


INTER = WITH_ROOTS + ", inter AS (SELECT r.*, q.root, a.is_bad AS actor_bad, b.is_bad AS target_bad FROM reactions r JOIN roots q USING (post_id) JOIN posts p ON p.post_id = q.root JOIN users a ON a.user_id = r.user_id JOIN users b ON b.user_id = p.user_id)"


@query("interaction_matrix", INTER + " SELECT action, actor_bad, target_bad, count(*) AS n FROM inter GROUP BY 1, 2, 3", views=False)
def interaction_matrix(spark, d):
    return interactions(spark, d).groupBy("action", "actor_bad", "target_bad").agg(F.count("*").alias("n"))


@query("agent_attack_features", INTER + " SELECT user_id, count(*) FILTER (action = 'like' AND target_bad = 1) AS like_to_bad, count(*) FILTER (action = 'like' AND target_bad = 0) AS like_to_good, count(*) FILTER (action = 'repost' AND target_bad = 1) AS repost_to_bad, count(*) AS total FROM inter GROUP BY 1", views=False)
def agent_attack_features(spark, d):
    a, t = F.col("action"), F.col("target_bad")
    return interactions(spark, d).groupBy("user_id").agg(F.count_if((a == "like") & (t == 1)).alias("like_to_bad"), F.count_if((a == "like") & (t == 0)).alias("like_to_good"), F.count_if((a == "repost") & (t == 1)).alias("repost_to_bad"), F.count("*").alias("total"))


@query("view_exposure", INTER + " SELECT root AS post_id, count(*) AS views, count(DISTINCT user_id) AS viewers FROM inter WHERE action = 'refresh' GROUP BY 1", views=False)
def view_exposure(spark, d):
    return interactions(spark, d).where("action = 'refresh'").groupBy(F.col("root").alias("post_id")).agg(F.count("*").alias("views"), F.countDistinct("user_id").alias("viewers"))


METRICS = {
    "views": "action = 'refresh' AND target_bad = 1",
    "good_views": "action = 'refresh' AND target_bad = 1 AND actor_bad = 0",
    "likes": "action = 'like' AND target_bad = 1",
    "good_likes": "action = 'like' AND target_bad = 1 AND actor_bad = 0",
    "dislikes": "action = 'dislike' AND target_bad = 1",
    "reposts": "action = 'repost' AND target_bad = 1",
    "good_reposts": "action = 'repost' AND target_bad = 1 AND actor_bad = 0",
    "comments": "action = 'comment' AND target_bad = 1",
    "in_group": "actor_bad = 1 AND target_bad = 1",
}


#: Of posts with the class of their author: the first step's posts, later originals and reposts of each class.
POSTED = {
    "initial_posts": "step IN (0)",
    "bad_initial_posts": "step IN (0) AND is_bad = 1",
    "bad_new_originals": "NOT step IN (0) AND original_post_id IS NULL AND is_bad = 1",
    "good_new_originals": "NOT step IN (0) AND original_post_id IS NULL AND is_bad = 0",
    "posts_reposted_by_bad": "original_post_id IS NOT NULL AND is_bad = 1",
    "posts_reposted_by_good": "original_post_id IS NOT NULL AND is_bad = 0",
}
DISTINCT = {
    "good_viewers": ("action = 'refresh' AND target_bad = 1 AND actor_bad = 0", "user_id"),
    "bad_viewers": ("action = 'refresh' AND target_bad = 1 AND actor_bad = 1", "user_id"),
    "good_post_viewers": ("action = 'refresh' AND target_bad = 0", "user_id"),
    "touched_posts": ("target_bad = 1", "root"),
}


@query(
    "attack_metrics",
    INTER
    + ", acted AS (SELECT "
    + ", ".join(f"count(*) FILTER ({c}) AS {n}" for n, c in METRICS.items())
    + ", "
    + ", ".join(f"count(DISTINCT CASE WHEN {c} THEN {of} END) AS {n}" for n, (c, of) in DISTINCT.items())
    + ", count(*) FILTER (target_bad = 1) / count(*) AS bad_share FROM inter), posted AS (SELECT "
    + ", ".join(f"count(*) FILTER ({c}) AS {n}" for n, c in POSTED.items())
    + " FROM posts JOIN users USING (user_id)) SELECT * FROM acted, posted",
    views=False,
)
def attack_metrics(spark, d):
    """One row: what was done to posts of bad accounts, by whom, who saw them, and what both classes posted."""
    once = [F.countDistinct(F.when(F.expr(c), F.col(of))).alias(n) for n, (c, of) in DISTINCT.items()]
    acted = interactions(spark, d).agg(*[F.count_if(F.expr(c)).alias(n) for n, c in METRICS.items()], *once, (F.count_if(F.col("target_bad") == 1) / F.count("*")).alias("bad_share"))
    posted = social.posts(spark, d).join(social.users(spark, d).select("user_id", "is_bad"), "user_id").agg(*[F.count_if(F.expr(c)).alias(n) for n, c in POSTED.items()])
    return acted.join(F.broadcast(posted), F.lit(True))  # two rows of totals


@query("initial_posts", "SELECT post_id, user_id, original_post_id IS NULL AS original FROM posts WHERE step IN (0)")
def initial_posts(spark, d):
    """Posts that were there before the first step."""
    return social.posts(spark, d).where(F.col("step").isin(0)).select("post_id", "user_id", F.col("original_post_id").isNull().alias("original"))


@query("post_engagement", "SELECT post_id, count(DISTINCT CASE WHEN action = 'like' AND is_bad = 0 THEN user_id END) AS good_likes, count(DISTINCT CASE WHEN action = 'repost' THEN user_id END) AS reposts, count(*) FILTER (action = 'comment' AND event_id % 2 = 0) AS agree, count(*) FILTER (action = 'comment' AND event_id % 2 = 1) AS disagree, count(DISTINCT CASE WHEN action = 'refresh' THEN user_id END) AS viewers FROM reactions JOIN users USING (user_id) GROUP BY 1")
def post_engagement(spark, d):
    a = F.col("action")
    r = social.reactions(spark, d).join(social.users(spark, d).select("user_id", "is_bad"), "user_id")
    once = lambda c: F.countDistinct(F.when(c, F.col("user_id")))
    return r.groupBy("post_id").agg(once((a == "like") & (F.col("is_bad") == 0)).alias("good_likes"), once(a == "repost").alias("reposts"), F.count_if((a == "comment") & (F.col("event_id") % 2 == 0)).alias("agree"), F.count_if((a == "comment") & (F.col("event_id") % 2 == 1)).alias("disagree"), once(a == "refresh").alias("viewers"))


#: Of reactions: the totals kept for each step; comments with an even number agree.
STEP_TOTALS = {
    "likes": "action = 'like'",
    "reposts": "action = 'repost'",
    "agree": "action = 'comment' AND event_id % 2 = 0",
    "disagree": "action = 'comment' AND event_id % 2 = 1",
}


@query(
    "step_engagement",
    ", b AS (SELECT r.* FROM reactions r JOIN posts p USING (post_id) JOIN users u ON u.user_id = p.user_id WHERE u.is_bad = 1), s AS (SELECT step, "
    + ", ".join(f"count(*) FILTER ({c}) AS {n}" for n, c in STEP_TOTALS.items())
    + " FROM b GROUP BY 1) SELECT step, "
    + ", ".join(f"CAST(sum({n}) OVER (ORDER BY step) AS BIGINT) AS {n}" for n in STEP_TOTALS)
    + " FROM s",
)
def step_engagement(spark, d):
    bad = social.posts(spark, d).join(social.users(spark, d).where("is_bad = 1"), "user_id").select("post_id")
    s = social.reactions(spark, d).join(bad, "post_id", "left_semi").groupBy("step").agg(*[F.count_if(F.expr(c)).alias(n) for n, c in STEP_TOTALS.items()])
    w = Window.orderBy("step")  # one row a step
    return s.select("step", *[F.sum(n).over(w).alias(n) for n in STEP_TOTALS])


@query("same_status", "SELECT likes, reposts, list(post_id ORDER BY post_id) AS posts FROM (SELECT post_id, count(*) FILTER (action = 'like') AS likes, count(*) FILTER (action = 'repost') AS reposts FROM reactions GROUP BY 1) GROUP BY 1, 2")
def same_status(spark, d):
    s = social.reactions(spark, d).groupBy("post_id").agg(F.count_if(F.col("action") == "like").alias("likes"), F.count_if(F.col("action") == "repost").alias("reposts"))
    return s.groupBy("likes", "reposts").agg(F.array_sort(F.collect_list("post_id")).alias("posts"))


@query("reaction_state", "SELECT user_id, post_id, arg_max(action, struct_pack(ts := ts, e := event_id)) AS state FROM reactions WHERE action IN ('like', 'dislike') GROUP BY 1, 2")
def reaction_state(spark, d):
    r = social.reactions(spark, d).where("action IN ('like', 'dislike')")
    return r.groupBy("user_id", "post_id").agg(F.max_by("action", F.struct("ts", "event_id")).alias("state"))


@query("root_rollup", WITH_ROOTS + ", both_posts AS (SELECT r.event_id, r.action, unnest(list_distinct([r.post_id, q.root])) AS post_id FROM reactions r JOIN roots q USING (post_id)) SELECT post_id, action, count(*) AS n FROM both_posts GROUP BY 1, 2", views=False)
def root_rollup(spark, d):
    r = social.reactions(spark, d).join(roots(spark, d).select("post_id", "root"), "post_id")
    return r.select("action", F.explode(F.array_distinct(F.array("post_id", "root"))).alias("post_id")).groupBy("post_id", "action").agg(F.count("*").alias("n"))


@query("follow_state", "SELECT user_id, target FROM (SELECT user_id, target, action FROM trace WHERE action IN ('signup', 'error') QUALIFY row_number() OVER (PARTITION BY user_id, target ORDER BY ts DESC, event_id DESC) = 1) WHERE action = 'signup'")
def follow_state(spark, d):
    return ops.fold_switch(social.trace(spark, d), ["user_id", "target"], ["ts", "event_id"], ["signup"], ["error"])


@query("counter_state", "SELECT target AS post_id, count(*) FILTER (action = 'purchase') AS reposts, count(*) FILTER (action = 'click') - count(*) FILTER (action = 'error') AS net_likes, sum(CASE WHEN action = 'purchase' THEN value ELSE 0 END) AS sales FROM trace GROUP BY 1")
def counter_state(spark, d):
    a = F.col("action")
    return social.trace(spark, d).groupBy(F.col("target").alias("post_id")).agg(F.count_if(a == "purchase").alias("reposts"), (F.count_if(a == "click") - F.count_if(a == "error")).alias("net_likes"), F.sum(F.when(a == "purchase", F.col("value")).otherwise(0.0)).alias("sales"))


#: Fixed values of the query below: the platform action that each event of the log plays, by its number.
LOGGED = [*counters.SWITCHES, *counters.ADDS, "do_nothing"]
SWITCH_ROWS = "(VALUES " + ", ".join(f"('{a}', '{slot}', '{state}', {str(sets).lower()})" for a, (slot, state, sets) in counters.SWITCHES.items()) + ") AS sw(action, slot, state, sets)"
RAISE_ROWS = "(VALUES " + ", ".join(f"('{slot}', '{state}', '{whose}', '{entity}', '{counter}')" for (slot, state), raises in counters.RAISES.items() for whose, entity, counter in raises) + ") AS ra(slot, state, whose, entity, counter)"
ADD_ROWS = "(VALUES " + ", ".join(f"('{a}', '{entity}', '{counter}')" for a, (entity, counter) in counters.ADDS.items()) + ") AS ad(action, entity, counter)"


def platform_log(spark, d):
    t = social.trace(spark, d)
    action = F.get(F.array(*[F.lit(a) for a in LOGGED]), (F.col("event_id") * 7 % len(LOGGED)).cast("int"))
    return t.select((F.col("user_id") % 20).alias("actor"), (F.col("target") % 20).alias("object"), action.alias("action"), F.col("ts").alias("at"), "event_id", (F.col("event_id") % 5).alias("quantity"))


@query(
    "platform_counters",
    social.SQL.replace("WITH trace", "WITH RECURSIVE trace", 1)
    + f""", log AS (SELECT user_id % 20 AS actor, target % 20 AS object, ({LOGGED!r})[CAST(event_id * 7 % {len(LOGGED)} AS INTEGER) + 1] AS action, ts AS moment, event_id, event_id % 5 AS quantity FROM trace),
numbered AS (SELECT l.*, slot, state, sets, row_number() OVER (PARTITION BY actor, object, slot ORDER BY moment, event_id) AS n FROM log l JOIN {SWITCH_ROWS} ON sw.action = l.action),
walk AS (
    SELECT actor, object, slot, n, CASE WHEN sets THEN state END AS held FROM numbered WHERE n = 1
    UNION ALL
    SELECT w.actor, w.object, w.slot, x.n, CASE WHEN x.sets THEN x.state WHEN w.held = x.state THEN NULL ELSE w.held END FROM walk w JOIN numbered x ON x.actor = w.actor AND x.object = w.object AND x.slot = w.slot AND x.n = w.n + 1
), final AS (SELECT actor, object, slot, held FROM walk QUALIFY row_number() OVER (PARTITION BY actor, object, slot ORDER BY n DESC) = 1),
changes AS (
    SELECT ra.entity, CASE ra.whose WHEN 'actor' THEN actor ELSE object END AS id, ra.counter, 1 AS n FROM final f JOIN {RAISE_ROWS} ON ra.slot = f.slot AND ra.state = f.held
    UNION ALL SELECT ad.entity, object, ad.counter, CASE WHEN l.action = 'purchase_product' THEN quantity ELSE 1 END FROM log l JOIN {ADD_ROWS} ON ad.action = l.action
) SELECT entity, id, counter, CAST(sum(n) AS BIGINT) AS n FROM changes GROUP BY 1, 2, 3 HAVING sum(n) <> 0""",
    views=False,
)
def platform_counters(spark, d):
    """All counters of posts, comments, accounts and products after the whole action log, with undo, exclusive and once-only actions."""
    return counters.platform_counters(platform_log(spark, d))


@query("rec_trace", ", s AS (SELECT user_id, post_id, count(*) FILTER (action = 'refresh') * 1.0 AS base, count(*) FILTER (action = 'like') - count(*) FILTER (action = 'dislike') AS adj FROM reactions GROUP BY 1, 2), g AS (SELECT *, max(base) OVER (PARTITION BY user_id) - min(base) OVER (PARTITION BY user_id) AS spread FROM s) SELECT user_id, post_id, base + adj * spread / 2 AS score FROM g QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY base + adj * spread / 2 DESC, post_id) <= 5")
def rec_trace(spark, d):
    a, w = F.col("action"), Window.partitionBy("user_id")
    s = social.reactions(spark, d).groupBy("user_id", "post_id").agg((F.count_if(a == "refresh") * 1.0).cast("double").alias("base"), (F.count_if(a == "like") - F.count_if(a == "dislike")).alias("adj"))
    s = s.withColumn("score", F.col("base") + F.col("adj") * (F.max("base").over(w) - F.min("base").over(w)) / 2)
    return ops.cap_per_key(s, ["user_id"], [F.desc("score"), "post_id"], 5).select("user_id", "post_id", "score")


CHAIN_TEXT = "CASE WHEN original_post_id IS NULL THEN 'original_post: ' || post_id ELSE 'A repost from user_' || original_author || '. original_post: ' || post_id END"


@query("cascade_edges", f"SELECT regexp_extract(t, 'repost from user_([0-9]+)\\.', 1) AS src, 'user_' || user_id AS dst, count(*) AS n FROM (SELECT user_id, {CHAIN_TEXT} AS t FROM posts) WHERE t LIKE 'A repost%' GROUP BY 1, 2")
def cascade_edges(spark, d):
    text = social.posts(spark, d).select("user_id", F.expr(CHAIN_TEXT).alias("t")).where(F.col("t").startswith("A repost"))
    return text.groupBy(F.regexp_extract("t", r"repost from user_(\d+)\.", 1).alias("src"), F.concat(F.lit("user_"), F.col("user_id")).alias("dst")).agg(F.count("*").alias("n"))


@query("cascade_shape", WITH_ROOTS + ", b AS (SELECT root, depth, count(*) AS n FROM roots GROUP BY 1, 2) SELECT root, max(depth) AS depth, max(n) AS breadth, CAST(sum(n) AS BIGINT) AS size FROM b GROUP BY 1", views=False)
def cascade_shape(spark, d):
    b = roots(spark, d).groupBy("root", "depth").agg(F.count("*").alias("n"))
    return b.groupBy("root").agg(F.max("depth").alias("depth"), F.max("n").alias("breadth"), F.sum("n").alias("size"))


@query("virality", WITH_ROOTS + ", anc AS (SELECT post_id, post_id AS a FROM posts UNION ALL SELECT x.post_id, p.original_post_id FROM anc x JOIN posts p ON p.post_id = x.a WHERE p.original_post_id IS NOT NULL), s AS (SELECT a, count(*) AS s FROM anc GROUP BY 1), t AS (SELECT r.root, s.s, count(*) OVER (PARTITION BY r.root) AS n FROM s JOIN roots r ON r.post_id = s.a) SELECT root, 2.0 * sum(s * (n - s)) / any_value(n * (n - 1)) AS virality FROM t WHERE n > 1 GROUP BY 1", views=False)
def virality(spark, d):
    """Mean distance in a cascade tree from subtree sizes; each round lifts all nodes one ancestor."""
    p = social.posts(spark, d).select("post_id", "original_post_id")
    up = p.select(F.col("post_id").alias("a"), F.col("original_post_id").alias("next")).where("next is not null")
    now = p.select("post_id", F.col("post_id").alias("a"))
    layers = [now]
    depth = roots(spark, d)
    for _ in range(depth.agg(F.max("depth")).first()[0] or 0):
        now = now.join(up, "a").select("post_id", F.col("next").alias("a"))
        layers.append(now)
    s = reduce(lambda x, y: x.unionByName(y), layers).groupBy("a").agg(F.count("*").alias("s"))
    t = s.join(depth.select(F.col("post_id").alias("a"), "root"), "a")
    n = t.groupBy("root").agg(F.count("*").alias("n"))
    return t.join(n, "root").where("n > 1").groupBy("root").agg((2.0 * F.sum(F.col("s") * (F.col("n") - F.col("s"))) / F.first(F.col("n") * (F.col("n") - 1))).alias("virality"))


MOMENTS = """, nodes AS (SELECT r.root AS cascade, p.post_id AS node, p.step AS time, p.original_post_id AS parent FROM posts p JOIN roots r USING (post_id)), moments AS (SELECT DISTINCT cascade, time AS "at" FROM nodes),
reach AS (
    SELECT n.cascade, m."at", n.node, 0 AS depth, [n.node] AS way FROM nodes n JOIN moments m ON m.cascade = n.cascade AND m."at" >= n.time WHERE n.parent IS NULL
    UNION ALL SELECT r.cascade, r."at", n.node, r.depth + 1, list_append(r.way, n.node) FROM reach r JOIN nodes n ON n.cascade = r.cascade AND n.parent = r.node AND n.time <= r."at"
), levels AS (SELECT cascade, "at", depth, count(*) AS n FROM reach GROUP BY 1, 2, 3), shape AS (SELECT cascade, "at", CAST(sum(n) AS BIGINT) AS size, max(depth) AS depth, coalesce(max(n) FILTER (depth > 0), 0) AS breadth FROM levels GROUP BY 1, 2),
below AS (SELECT cascade, "at", a, count(*) AS s FROM (SELECT cascade, "at", unnest(way) AS a FROM reach) GROUP BY 1, 2, 3), mean AS (SELECT cascade, "at", sum(s * (size - s)) * 2.0 / any_value(size * (size - 1)) AS virality FROM below JOIN shape USING (cascade, "at") WHERE size > 1 GROUP BY 1, 2)
SELECT cascade, "at", size, depth, breadth, virality FROM shape LEFT JOIN mean USING (cascade, "at")"""


@query("cascade_times", WITH_ROOTS + MOMENTS, views=False)
def cascade_times(spark, d):
    """Size, depth, breadth and virality of every repost cascade at each of its moments; a post whose original isn't there yet isn't reached."""
    p = social.posts(spark, d).select(F.col("post_id").alias("node"), F.col("original_post_id").alias("parent"), F.col("step").alias("time"))
    return cascade.trees_over_time(p)


@query("isolates", "SELECT user_id FROM users WHERE user_id NOT IN (SELECT follower_id FROM follows UNION SELECT followee_id FROM follows)")
def isolates(spark, d):
    ends = social.follows(spark, d).select(F.explode(F.array("follower_id", "followee_id")).alias("user_id"))
    return social.users(spark, d).select("user_id").join(ends, "user_id", "left_anti")


@query("enhanced_edges", "SELECT DISTINCT least(follower_id, followee_id) AS a, greatest(follower_id, followee_id) AS b FROM follows UNION SELECT least(user_id, original_author), greatest(user_id, original_author) FROM posts WHERE original_post_id IS NOT NULL AND user_id <> original_author")
def enhanced_edges(spark, d):
    f = social.follows(spark, d).select(F.col("follower_id").alias("x"), F.col("followee_id").alias("y"))
    p = social.posts(spark, d).where("original_post_id is not null").select(F.col("user_id").alias("x"), F.col("original_author").alias("y")).where("x != y")
    return f.union(p).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
