"""Queries over windows, top-k, samples, feeds and taxonomies."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import geometry as geo
from tidemark.operators import chain, feeds, sampling, simjoin, vectorindex
from tidemark.operators import tables as ops
from tidemark.plans.registry import query
from tidemark.plans.shared import stored, table
from tidemark.sources import social


@query("dedup_first", "SELECT user_id, event_id, action FROM trace QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1")
def dedup_first(spark, d):
    return ops.first_per_key(social.trace(spark, d), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "action")


@query("cap_per_user", "SELECT user_id, event_id FROM trace QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) <= 5")
def cap_per_user(spark, d):
    return ops.cap_per_key(social.trace(spark, d), ["user_id"], [F.desc("ts"), "event_id"], 5).select("user_id", "event_id")


@query("next_action", "SELECT u.user_id, t.action AS next_action FROM (SELECT DISTINCT user_id FROM trace) u LEFT JOIN (SELECT user_id, action FROM trace WHERE step > 25 AND value > 30 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1) t USING (user_id)")
def next_action(spark, d):
    t = social.trace(spark, d)
    after = ops.first_per_key(t.where("step > 25 AND value > 30"), ["user_id"], ["ts", "event_id"]).select("user_id", F.col("action").alias("next_action"))
    return t.select("user_id").distinct().join(after, "user_id", "left")


@query(
    "volatility",
    f", o AS (SELECT vec_id % (SELECT count(*) FROM customer) AS user_id, vec_id, embedding FROM embeddings), v AS (SELECT user_id, embedding AS e, lag(embedding) OVER (PARTITION BY user_id ORDER BY vec_id) AS p FROM o), "
    "s AS (SELECT user_id, CASE WHEN p IS NOT NULL THEN sqrt(list_sum(list_transform(list_zip(e, p), lambda x: (CAST(x[1] AS DOUBLE) - x[2]) ^ 2))) END AS d FROM v) "
    "SELECT user_id, avg(d) AS mean, max(d) AS most, count(*) AS texts, CASE WHEN count(*) < 2 THEN 'insufficient' ELSE 'measured' END AS state FROM s GROUP BY 1",
)
def volatility(spark, d):
    """Distance between consecutive vectors of an account, mean and largest; accounts with one text are told as insufficient."""
    e = table(spark, d, "embeddings").select((F.col("vec_id") % social.n_users(spark, d)).alias("user_id"), "vec_id", "embedding")
    v = e.withColumn("before", F.lag("embedding").over(Window.partitionBy("user_id").orderBy("vec_id")))
    v = v.withColumn("d", F.when(F.col("before").isNotNull(), geo.distance(F.col("embedding"), F.col("before"))))
    return v.groupBy("user_id").agg(F.avg("d").alias("mean"), F.max("d").alias("most"), F.count("*").alias("texts"), F.when(F.count("*") < 2, "insufficient").otherwise("measured").alias("state"))


@query("top_evidence", "SELECT user_id, action, event_id, value FROM trace WHERE value > 0 QUALIFY row_number() OVER (PARTITION BY user_id, action ORDER BY value DESC, event_id) <= 5")
def top_evidence(spark, d):
    return ops.cap_per_key(social.trace(spark, d).where("value > 0"), ["user_id", "action"], [F.desc("value"), "event_id"], 5).select("user_id", "action", "event_id", "value")


@query("contribution_rank", ", c AS (SELECT user_id, action, sum(value) - 300 AS c FROM trace GROUP BY 1, 2) SELECT user_id, action, c AS contribution, CASE WHEN c > 0 THEN 'raises' WHEN c < 0 THEN 'lowers' ELSE 'neutral' END AS direction, row_number() OVER (PARTITION BY user_id ORDER BY round(abs(c), 6) DESC, action) AS rank FROM c")
def contribution_rank(spark, d):
    c = social.trace(spark, d).groupBy("user_id", "action").agg((F.sum("value") - 300).alias("contribution"))
    x = F.col("contribution")
    return c.select("user_id", "action", x, F.when(x > 0, "raises").when(x < 0, "lowers").otherwise("neutral").alias("direction"), F.row_number().over(Window.partitionBy("user_id").orderBy(F.round(F.abs(x), 6).desc(), "action")).alias("rank"))


@query("contribution_packets", ", c AS (SELECT user_id, action, sum(value) - 300 AS c FROM trace GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(abs(c), 6) DESC, action) AS rank FROM c) SELECT user_id, count(*) AS n, string_agg(rank || ' ' || action || CASE WHEN c > 0 THEN ' raises' WHEN c < 0 THEN ' lowers' ELSE ' neutral' END, ', ' ORDER BY rank) AS packet FROM r GROUP BY 1")
def contribution_packets(spark, d):
    """Each account's contributions by rank, as the packet sink writes them, in one line."""
    entry = F.transform("contributions", lambda c: F.concat_ws(" ", c["rank"], c["action"], c["direction"]))
    return social.packets(contribution_rank(spark, d)).select("user_id", F.size("contributions").cast("long").alias("n"), F.array_join(entry, ", ").alias("packet"))


@query("engagement_delta", ", s AS (SELECT post_id, step, count(*) AS n FROM reactions GROUP BY 1, 2) SELECT post_id, step, n, n - coalesce(lag(n) OVER (PARTITION BY post_id ORDER BY step), 0) AS delta FROM s")
def engagement_delta(spark, d):
    s = social.reactions(spark, d).groupBy("post_id", "step").agg(F.count("*").alias("n"))
    return s.withColumn("delta", F.col("n") - F.coalesce(F.lag("n").over(Window.partitionBy("post_id").orderBy("step")), F.lit(0)))


@query("cascade_scale", ", first AS (SELECT post_id, user_id, min(step) AS step FROM reactions GROUP BY 1, 2), g AS (SELECT post_id, step, count(*) AS n FROM first GROUP BY 1, 2), spine AS (SELECT p.post_id, s.step FROM (SELECT DISTINCT post_id FROM first) p, (SELECT unnest(range(30)) AS step) s) SELECT post_id, step, CAST(sum(coalesce(n, 0)) OVER (PARTITION BY post_id ORDER BY step) AS BIGINT) AS scale FROM spine LEFT JOIN g USING (post_id, step)")
def cascade_scale(spark, d):
    first = social.reactions(spark, d).groupBy("post_id", "user_id").agg(F.min("step").alias("step"))
    g = first.groupBy("post_id", "step").agg(F.count("*").alias("n"))
    spine = first.select("post_id").distinct().select("post_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(29).cast("long"))).alias("step"))
    return spine.join(g, ["post_id", "step"], "left").select("post_id", "step", F.sum(F.coalesce("n", F.lit(0))).over(Window.partitionBy("post_id").orderBy("step")).alias("scale"))


CHAIN = """, c AS (SELECT user_id, event_id, action, row_number() OVER w AS seq, lag(sha256(user_id || '|' || event_id || '|' || action)) OVER w AS prev, lag(action) OVER w AS before FROM trace WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), k AS (SELECT *, CASE WHEN event_id % 101 = 0 THEN 'tampered' ELSE prev END AS stored FROM c)
SELECT user_id, count(*) AS events, count(*) FILTER (stored IS DISTINCT FROM prev) AS broken, count(*) FILTER (before = 'error' AND action = 'purchase') AS bad_transitions FROM k GROUP BY 1"""


@query("chain_verify", CHAIN)
def chain_verify(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    digest = F.sha2(F.concat_ws("|", "user_id", "event_id", "action"), 256)
    c = social.trace(spark, d).withColumn("prev", F.lag(digest).over(w)).withColumn("before", F.lag("action").over(w))
    c = c.withColumn("stored", F.when(F.col("event_id") % 101 == 0, "tampered").otherwise(F.col("prev")))
    return c.groupBy("user_id").agg(F.count("*").alias("events"), F.count_if(~F.col("stored").eqNullSafe(F.col("prev"))).alias("broken"), F.count_if((F.col("before") == "error") & (F.col("action") == "purchase")).alias("bad_transitions"))


#: Fixed values of the queries below: what may follow an action.
ACTION_STEPS = {"": ("signup", "view"), "signup": ("view", "click"), "view": ("click", "view", "error"), "click": ("purchase", "view", "error"), "purchase": ("view",), "error": ("signup", "view")}
MAY_FOLLOW = "(VALUES " + ", ".join(f"('{a}', '{b}')" for a, after in ACTION_STEPS.items() for b in after) + ") AS may(a, b)"
SEALED = """WITH RECURSIVE numbered AS (SELECT user_id AS key, event_id, event_type AS state, CAST(event_id AS VARCHAR) AS payload, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sequence FROM events),
sealed AS (
    SELECT *, CAST(NULL AS VARCHAR) AS previous_state, '' AS previous_hash, sha256('{"key":"' || key || '","payload":"' || payload || '","previous_hash":"","previous_state":null,"sequence":1,"state":"' || state || '"}') AS event_hash FROM numbered WHERE sequence = 1
    UNION ALL
    SELECT n.*, s.state, s.event_hash, sha256('{"key":"' || n.key || '","payload":"' || n.payload || '","previous_hash":"' || s.event_hash || '","previous_state":"' || s.state || '","sequence":' || n.sequence || ',"state":"' || n.state || '"}') FROM sealed s JOIN numbered n ON n.key = s.key AND n.sequence = s.sequence + 1
)"""


def action_chain(spark, d):
    t = social.trace(spark, d)
    sequence = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return t.select(F.col("user_id").alias("key"), sequence.cast("long").alias("sequence"), F.col("action").alias("state"), F.col("event_id").cast("string").alias("payload"))


@query(
    "chain_audit",
    SEALED + f""", stored AS (
    SELECT key, sequence, previous_state, state, CASE WHEN event_id % 101 = 0 THEN 'changed' ELSE payload END AS payload, previous_hash, event_hash FROM sealed WHERE event_id % 103 <> 0
    UNION ALL SELECT key, sequence, previous_state, state, CASE WHEN event_id % 101 = 0 THEN 'changed' ELSE payload END, previous_hash, event_hash FROM sealed WHERE event_id % 107 = 0 AND event_id % 103 <> 0
    UNION ALL SELECT key, sequence, previous_state, state, 'forked', previous_hash, sha256('{{"key":"' || key || '","payload":"forked","previous_hash":"' || previous_hash || '","previous_state":' || coalesce('"' || previous_state || '"', 'null') || ',"sequence":' || sequence || ',"state":"' || state || '"}}') FROM sealed WHERE event_id % 109 = 0
), told AS (
    SELECT *, NOT EXISTS (SELECT 1 FROM stored p WHERE p.key = s.key AND p.sequence = s.sequence - 1) AND sequence > 1 AS gap,
        sha256('{{"key":"' || key || '","payload":"' || payload || '","previous_hash":"' || previous_hash || '","previous_state":' || coalesce('"' || previous_state || '"', 'null') || ',"sequence":' || sequence || ',"state":"' || state || '"}}') <> event_hash AS tampered,
        CASE WHEN sequence = 1 THEN previous_hash <> '' ELSE NOT EXISTS (SELECT 1 FROM stored p WHERE p.key = s.key AND p.sequence = s.sequence - 1 AND p.event_hash = s.previous_hash) END AS unlinked,
        CASE WHEN sequence = 1 THEN previous_state IS NOT NULL ELSE NOT EXISTS (SELECT 1 FROM stored p WHERE p.key = s.key AND p.sequence = s.sequence - 1 AND p.state = s.previous_state) END AS misstated,
        NOT EXISTS (SELECT 1 FROM {MAY_FOLLOW} WHERE a = coalesce(previous_state, '') AND b = state) AS illegal FROM stored s
), sums AS (
    SELECT key, count(*) AS events, count(DISTINCT sequence) FILTER (gap) AS gaps, count(*) - count(DISTINCT (sequence, payload)) AS repeats, count(DISTINCT (sequence, payload)) - count(DISTINCT sequence) AS forks,
        count(*) FILTER (tampered) AS tampered, count(*) FILTER (unlinked) AS unlinked, count(*) FILTER (misstated) AS misstated, count(*) FILTER (illegal) AS illegal FROM told GROUP BY 1
) SELECT *, gaps + repeats + forks + tampered + unlinked + misstated + illegal = 0 AS valid FROM sums""",
    views=False,
)
def chain_audit(spark, d):
    """Sealed chains of all accounts' actions, in which payloads were changed, events left out, repeated and forked."""
    sealed = stored(chain.seal(action_chain(spark, d)))
    own = lambda n: F.col("payload").cast("long") % n == 0
    held = sealed.where(~own(103))
    held = held.union(held.where(own(107))).withColumn("payload", F.when(own(101), "changed").otherwise(F.col("payload")))
    forked = sealed.where(own(109)).withColumn("payload", F.lit("forked"))
    forked = forked.withColumn("event_hash", chain.event_digest(*[F.col(c) for c in ("key", "sequence", "previous_state", "state", "payload", "previous_hash")]))
    return chain.verify(held.unionByName(forked), ACTION_STEPS)


@query(
    "state_fold",
    f"""WITH RECURSIVE numbered AS (SELECT user_id AS key, event_type AS state, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sequence FROM events), may AS (SELECT * FROM {MAY_FOLLOW}),
folded AS (
    SELECT key, CAST(0 AS BIGINT) AS sequence, '' AS state, false AS accepted, '' AS now FROM numbered WHERE sequence = 1
    UNION ALL
    SELECT n.key, n.sequence, n.state, m.b IS NOT NULL, CASE WHEN m.b IS NOT NULL THEN n.state ELSE f.now END FROM folded f JOIN numbered n ON n.key = f.key AND n.sequence = f.sequence + 1 LEFT JOIN may m ON m.a = f.now AND m.b = n.state
) SELECT key, sequence, state, accepted, nullif(now, '') AS now FROM folded WHERE sequence > 0""",
    views=False,
)
def state_fold(spark, d):
    return chain.fold(action_chain(spark, d), ACTION_STEPS)


@query("case_state", "SELECT target AS case_id, arg_max(action, event_id) AS state, max(event_id) AS sequence FROM trace GROUP BY 1")
def case_state(spark, d):
    return social.trace(spark, d).groupBy(F.col("target").alias("case_id")).agg(F.max_by("action", "event_id").alias("state"), F.max("event_id").alias("sequence"))


@query("last_likes", ", l AS (SELECT user_id, post_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM reactions WHERE action = 'like'), a AS (SELECT user_id, list(post_id ORDER BY n) AS p FROM l WHERE n <= 5 GROUP BY 1) SELECT user_id, unnest(p || list_transform(range(5 - len(p)), lambda x: p[1])) AS post_id, unnest(range(1, 6)) AS slot FROM a")
def last_likes(spark, d):
    likes = ops.cap_per_key(social.reactions(spark, d).where("action = 'like'"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 5)
    p = likes.groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("ts", "event_id", "post_id")), asc=False), lambda x: x["post_id"]).alias("p"))
    padded = F.concat("p", F.array_repeat(F.element_at("p", 1), 5 - F.size("p")))
    return p.select("user_id", F.posexplode(padded).alias("slot", "post_id")).select("user_id", "post_id", (F.col("slot") + 1).alias("slot"))


@query("role_names", ", c AS (SELECT label, avg(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)))) AS radius FROM embeddings GROUP BY 1) SELECT label, CASE row_number() OVER (ORDER BY round(radius, 9), label) WHEN 1 THEN 'core' WHEN 2 THEN 'organiser' WHEN 3 THEN 'amplifier' ELSE 'peripheral' END AS role FROM c")
def role_names(spark, d):
    c = table(spark, d, "embeddings").groupBy("label").agg(F.avg(geo.norm(F.col("embedding"))).alias("radius"))
    n = F.row_number().over(Window.orderBy(F.round("radius", 9), "label"))  # one row a cluster
    return c.select("label", F.when(n == 1, "core").when(n == 2, "organiser").when(n == 3, "amplifier").otherwise("peripheral").alias("role"))


@query("recent_profile", "SELECT u.user_id, u.user_name || coalesce(' ' || p.content, '') AS profile FROM users u LEFT JOIN (SELECT user_id, arg_max(content, post_id) AS content FROM posts GROUP BY 1) p USING (user_id)")
def recent_profile(spark, d):
    p = social.posts(spark, d).groupBy("user_id").agg(F.max_by("content", "post_id").alias("content"))
    return social.users(spark, d).join(p, "user_id", "left").select("user_id", F.concat("user_name", F.coalesce(F.concat(F.lit(" "), F.col("content")), F.lit(""))).alias("profile"))


HOT = "round(sign(num_likes - num_dislikes) * log10(greatest(abs(num_likes - num_dislikes), 1)) + step * 86400 / 45000.0, 7)"


@query("rec_hot", f"SELECT post_id, {HOT} AS score FROM posts ORDER BY score DESC, post_id LIMIT 50")
def rec_hot(spark, d):
    s = F.col("num_likes") - F.col("num_dislikes")
    score = F.round(F.signum(s) * F.log10(F.greatest(F.abs(s), F.lit(1))) + F.col("step") * 86400 / 45000.0, 7)
    return social.posts(spark, d).select("post_id", score.alias("score")).orderBy(F.desc("score"), "post_id").limit(50)


@query("trend", "SELECT post_id, num_likes FROM posts WHERE step >= 29 - 7 ORDER BY num_likes DESC, post_id LIMIT 20")
def trend(spark, d):
    return social.posts(spark, d).where("step >= 29 - 7").select("post_id", "num_likes").orderBy(F.desc("num_likes"), "post_id").limit(20)


@query("rec_random")
def rec_random(spark, d):
    """Five posts for each user by hash order, of all posts."""
    u = social.users(spark, d).select("user_id")
    return simjoin.random_per_query(u, social.posts(spark, d).select("post_id"), "user_id", "post_id", 5)


@query("feed_refresh", ", net AS (SELECT f.follower_id AS user_id, p.post_id, p.num_likes FROM follows f JOIN posts p ON p.user_id = f.followee_id), top AS (SELECT user_id, post_id FROM net QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY num_likes DESC, post_id) <= 3), rec AS (SELECT u.user_id, h.post_id FROM users u, (SELECT post_id FROM posts ORDER BY num_likes DESC, post_id LIMIT 5) h) SELECT user_id, post_id FROM top UNION SELECT user_id, post_id FROM rec")
def feed_refresh(spark, d):
    p = social.posts(spark, d)
    net = social.follows(spark, d).join(p, F.col("followee_id") == p["user_id"]).select(F.col("follower_id").alias("user_id"), "post_id", "num_likes")
    top = ops.cap_per_key(net, ["user_id"], [F.desc("num_likes"), "post_id"], 3).select("user_id", "post_id")
    hot = p.orderBy(F.desc("num_likes"), "post_id").limit(5).agg(F.collect_list("post_id").alias("ids"))  # five ids as one row
    rec = social.users(spark, d).select("user_id").join(F.broadcast(hot), F.lit(True)).select("user_id", F.explode("ids").alias("post_id"))
    return top.union(rec).distinct()


@query("post_with_comments", "SELECT post_id, list(event_id ORDER BY warn DESC, ts, event_id) AS comments FROM (SELECT post_id, event_id, ts, event_id % 13 = 0 AS warn FROM reactions WHERE action = 'comment' QUALIFY row_number() OVER (PARTITION BY post_id ORDER BY event_id % 13 = 0 DESC, ts, event_id) <= 5) GROUP BY 1")
def post_with_comments(spark, d):
    c = social.reactions(spark, d).where("action = 'comment'").withColumn("warn", (F.col("event_id") % 13 != 0).cast("int"))
    top = ops.cap_per_key(c, ["post_id"], ["warn", "ts", "event_id"], 5)
    return top.groupBy("post_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("warn", "ts", "event_id"))), lambda x: x["event_id"]).alias("comments"))


@query("balanced_sample", ", c AS (SELECT user_id, is_bad, row_number() OVER (PARTITION BY is_bad ORDER BY user_id) AS n FROM users), q AS (SELECT least(400, count(*) FILTER (is_bad = 1)) AS bad, count(*) FILTER (is_bad = 0) AS good FROM users) SELECT user_id, is_bad FROM c, q WHERE n <= CASE WHEN is_bad = 1 THEN bad ELSE least(800 - bad, good) END")
def balanced_sample(spark, d):
    u = social.users(spark, d).select("user_id", "is_bad")
    q = u.agg(F.least(F.lit(400), F.count_if(F.col("is_bad") == 1)).alias("bad"), F.count_if(F.col("is_bad") == 0).alias("good"))
    n = u.withColumn("n", F.row_number().over(Window.partitionBy("is_bad").orderBy("user_id"))).join(F.broadcast(q), F.lit(True))
    return n.where(F.col("n") <= F.when(F.col("is_bad") == 1, F.col("bad")).otherwise(F.least(800 - F.col("bad"), F.col("good")))).select("user_id", "is_bad")


@query("reservoir_edges", "SELECT src, dst, relation FROM (SELECT DISTINCT src, dst, relation FROM edges) QUALIFY row_number() OVER (PARTITION BY src, relation ORDER BY dst * 7919 % 10007, dst) <= 10")
def reservoir_edges(spark, d):
    e = social.edges(spark, d).select("src", "dst", "relation").distinct()
    return ops.cap_per_key(e, ["src", "relation"], [F.col("dst") * 7919 % 10007, "dst"], 10)


@query("action_quota", ", c AS (SELECT user_id, action, count(*) AS n FROM trace WHERE action IN ('click', 'view') GROUP BY 1, 2) SELECT user_id, action, n, greatest(1, CAST(floor(20.0 * n / sum(n) OVER (PARTITION BY user_id)) AS BIGINT)) AS quota FROM c")
def action_quota(spark, d):
    c = social.trace(spark, d).where("action IN ('click', 'view')").groupBy("user_id", "action").agg(F.count("*").alias("n"))
    return c.withColumn("quota", F.greatest(F.lit(1), F.floor(20.0 * F.col("n") / F.sum("n").over(Window.partitionBy("user_id")))))


def quota_sql(groups: str, key: str, group: str, target: int) -> str:
    """Largest remainders with one at least for each group, as SQL over a table (key, group, n)."""
    own = f"PARTITION BY {key}"
    return f""", z AS (SELECT *, sum(n) OVER ({own}) AS total, count(*) FILTER (n > 0) OVER ({own}) AS filled, least({target}, sum(n) OVER ({own})) AS goal FROM {groups}),
y AS (SELECT *, CASE WHEN goal >= filled AND goal * n // total = 0 AND n > 0 THEN 1 ELSE goal * n // total END AS low, CASE WHEN goal >= filled AND goal * n // total = 0 AND n > 0 THEN -1 ELSE goal * n % total END AS rest FROM z),
x AS (SELECT *, goal - sum(low) OVER ({own}) AS open, greatest(low - 1, 0) AS spare FROM y),
w AS (SELECT *, row_number() OVER ({own} ORDER BY rest DESC, {group}) AS place, coalesce(sum(spare) OVER ({own} ORDER BY spare DESC, {group} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM x)
SELECT {key}, {group}, n, CAST(CASE WHEN open > 0 THEN low + CASE WHEN place <= open THEN 1 ELSE 0 END ELSE low - greatest(least(spare, -open - before), 0) END AS BIGINT) AS quota FROM w"""


@query("closed_quota", ", c AS (SELECT user_id, action, count(*) AS n FROM trace GROUP BY 1, 2)" + quota_sql("c", "user_id", "action", 20))
def closed_quota(spark, d):
    """Twenty actions an account, shared out over its kinds of action in proportion, one of each at least."""
    c = social.trace(spark, d).groupBy("user_id", "action").agg(F.count("*").alias("n"))
    return sampling.apportion(c, ["user_id"], "action", "n", 20)


@query("quota_sample", ", c AS (SELECT user_id, action, count(*) AS n FROM trace GROUP BY 1, 2), q AS (" + quota_sql("c", "user_id", "action", 20).replace(", z AS", "WITH z AS", 1) + ") SELECT user_id, count(*) AS taken FROM (SELECT t.user_id, row_number() OVER (PARTITION BY t.user_id, t.action ORDER BY t.ts DESC, t.event_id) AS n, q.quota FROM trace t JOIN q USING (user_id, action)) WHERE n <= quota GROUP BY 1")
def quota_sample(spark, d):
    """How many actions of each account its quotas take, the latest of each kind."""
    n = F.row_number().over(Window.partitionBy("user_id", "action").orderBy(F.desc("ts"), "event_id"))
    t = social.trace(spark, d).withColumn("n", n).join(closed_quota(spark, d).select("user_id", "action", "quota"), ["user_id", "action"])
    return t.where("n <= quota").groupBy("user_id").agg(F.count("*").alias("taken"))


@query("weighted_sample", ", u AS (SELECT step, user_id, count(*) AS w FROM trace GROUP BY 1, 2), r AS (SELECT step, user_id, -ln((CAST('0x' || substr(sha256(step || '|' || user_id), 1, 13) AS BIGINT) + 1) / 4503599627370497.0) / greatest(w, 1e-6) AS race FROM u) SELECT step, user_id FROM r QUALIFY row_number() OVER (PARTITION BY step ORDER BY race, user_id) <= 8")
def weighted_sample(spark, d):
    u = social.trace(spark, d).groupBy("step", "user_id").agg(F.count("*").alias("w"))
    return ops.cap_per_key(u.withColumn("race", ops.weighted_race(F.col("w"), "step", "user_id")), ["step"], ["race", "user_id"], 8).select("step", "user_id")


@query("stratified_split", ", r AS (SELECT user_id, is_bad, nation, row_number() OVER (PARTITION BY is_bad, nation ORDER BY user_id * 7919 % 10007, user_id) AS n, count(*) OVER (PARTITION BY is_bad, nation) AS total FROM users) SELECT user_id, CASE WHEN n <= floor(total * 0.7) THEN 'train' WHEN n <= floor(total * 0.9) THEN 'validation' ELSE 'test' END AS split FROM r")
def stratified_split(spark, d):
    """Shares in whole numbers, as SQL's decimals are: 0.7 * 90 is below 63 in floating point."""
    s = Window.partitionBy("is_bad", "nation")
    n, total = F.row_number().over(s.orderBy(F.col("user_id") * 7919 % 10007, "user_id")), F.count("*").over(s)
    return social.users(spark, d).select("user_id", F.when(10 * n <= 7 * total, "train").when(10 * n <= 9 * total, "validation").otherwise("test").alias("split"))


@query("loso_assign", "SELECT p_partkey, CASE WHEN p_type = 'ECONOMY' THEN 'test' WHEN p_size % 5 = 0 THEN 'validation' ELSE 'train' END AS split FROM part", views=False)
def loso_assign(spark, d):
    return table(spark, d, "part").select("p_partkey", F.when(F.col("p_type") == "ECONOMY", "test").when(F.col("p_size") % 5 == 0, "validation").otherwise("train").alias("split"))


@query("edge_budget", ", e AS (SELECT relation, src, dst, sum(weight) AS w FROM edges GROUP BY 1, 2, 3) SELECT relation, src, dst FROM e QUALIFY row_number() OVER (PARTITION BY relation ORDER BY round(w, 6) DESC, src, dst) <= greatest(1, floor(0.05 * count(*) OVER (PARTITION BY relation)))")
def edge_budget(spark, d):
    e = social.edges(spark, d).groupBy("relation", "src", "dst").agg(F.round(F.sum("weight"), 6).alias("w"))
    r = Window.partitionBy("relation")
    return e.withColumn("n", F.row_number().over(r.orderBy(F.desc("w"), "src", "dst"))).withColumn("most", F.greatest(F.lit(1), F.floor(0.05 * F.count("*").over(r)))).where("n <= most").select("relation", "src", "dst")


PATHS = ", paths AS (SELECT DISTINCT p_brand || '.' || p_type || '.' || replace(p_name, ' ', '.') AS path, p_brand AS category FROM part)"


def paths(spark, d):
    return table(spark, d, "part").select(F.concat_ws(".", "p_brand", "p_type", F.translate("p_name", " ", ".")).alias("path"), F.col("p_brand").alias("category")).distinct()


@query("path_quota", PATHS + ", c AS (SELECT category, count(*) AS n, greatest(1, floor(100.0 * count(*) / (SELECT count(*) FROM paths))) AS quota FROM paths GROUP BY 1), s AS (SELECT category, path, 10 - len(string_split(path, '.')) + CASE WHEN path LIKE '%widget%' THEN 5 ELSE 0 END AS score FROM paths) SELECT s.category, s.path, s.score FROM s JOIN c USING (category) QUALIFY row_number() OVER (PARTITION BY s.category ORDER BY s.score DESC, s.path) <= any_value(c.quota) OVER (PARTITION BY s.category)")
def path_quota(spark, d):
    p = paths(spark, d)
    total = p.agg(F.count("*").alias("total"))
    c = p.groupBy("category").agg(F.count("*").alias("n")).join(F.broadcast(total), F.lit(True)).select("category", F.greatest(F.lit(1), F.floor(100.0 * F.col("n") / F.col("total"))).alias("quota"))
    s = p.withColumn("score", 10 - F.size(F.split("path", r"\.")) + F.when(F.col("path").contains("widget"), 5).otherwise(0))
    n = s.withColumn("n", F.row_number().over(Window.partitionBy("category").orderBy(F.desc("score"), "path")))
    return n.join(c, "category").where("n <= quota").select("category", "path", "score")


@query("depth_sample", PATHS + ", t AS (SELECT category, path, ntile(3) OVER (PARTITION BY category ORDER BY length(path) DESC, path) AS third FROM paths) SELECT category, path, third FROM t QUALIFY row_number() OVER (PARTITION BY category, third ORDER BY path) <= CASE third WHEN 1 THEN 5 WHEN 2 THEN 3 ELSE 2 END")
def depth_sample(spark, d):
    t = paths(spark, d).withColumn("third", F.ntile(3).over(Window.partitionBy("category").orderBy(F.length("path").desc(), "path")))
    n = t.withColumn("n", F.row_number().over(Window.partitionBy("category", "third").orderBy("path")))
    return n.where(F.col("n") <= F.when(F.col("third") == 1, 5).when(F.col("third") == 2, 3).otherwise(2)).select("category", "path", "third")


@query("path_tree", PATHS + ", s AS (SELECT string_split(path, '.') AS p FROM paths), n AS (SELECT DISTINCT array_to_string(p[1:i], '.') AS node, i AS depth, nullif(array_to_string(p[1:i - 1], '.'), '') AS parent FROM (SELECT p, unnest(range(1, len(p) + 1)) AS i FROM s)) SELECT node, depth, parent FROM n")
def path_tree(spark, d):
    s = paths(spark, d).select(F.split("path", r"\.").alias("p")).select("p", F.explode(F.sequence(F.lit(1), F.size("p"))).alias("depth"))
    parent = F.array_join(F.slice("p", F.lit(1), F.col("depth") - 1), ".")
    return s.select(F.array_join(F.slice("p", F.lit(1), F.col("depth")), ".").alias("node"), "depth", F.when(parent != "", parent).alias("parent")).distinct()


@query("path_merge", PATHS + " SELECT DISTINCT category, replace(replace(path, '.ECONOMY.', '.STANDARD.'), '.SMALL.', '.STANDARD.') AS path FROM paths")
def path_merge(spark, d):
    p = paths(spark, d)
    parts = F.split("path", r"\.")
    level = F.element_at(parts, 2)
    mapping = p.select(level.alias("old")).distinct().select("old", F.when(F.col("old").isin("ECONOMY", "SMALL"), "STANDARD").otherwise(F.col("old")).alias("new"))
    j = p.withColumn("old", level).join(mapping, "old")
    return j.select("category", F.array_join(F.concat(F.slice(parts, 1, 1), F.array("new"), F.slice(parts, F.lit(3), F.size(parts))), ".").alias("path")).distinct()


@query("profile_chunks", "SELECT c_custkey AS agent_id, lower(regexp_replace('Basic Info', '[^A-Za-z0-9]+', '_', 'g')) AS section, 'name: ' || c_name || chr(10) || 'segment: ' || c_mktsegment AS text FROM customer", views=False)
def profile_chunks(spark, d):
    fields = F.map_from_arrays(F.array(F.lit("name"), F.lit("segment"), F.lit("note")), F.array("c_name", "c_mktsegment", F.lit("none")))
    kept = F.map_filter(fields, lambda k, v: ~F.lower(v).isin("", "none", "n/a", "unknown"))
    lines = F.array_join(F.transform(F.map_entries(kept), lambda e: F.concat_ws(": ", e["key"], e["value"])), "\n")
    return table(spark, d, "customer").select(F.col("c_custkey").alias("agent_id"), F.lower(F.regexp_replace(F.lit("Basic Info"), "[^A-Za-z0-9]+", "_")).alias("section"), lines.alias("text"))


TFIDF = """, tok AS (SELECT conv_id, turn, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM conversations), tf AS (SELECT conv_id, turn, w, count(*) AS tf FROM tok GROUP BY 1, 2, 3), n AS (SELECT conv_id, count(DISTINCT turn) AS n FROM tok GROUP BY 1), df AS (SELECT conv_id, w, count(*) AS df FROM tf GROUP BY 1, 2), x AS (SELECT conv_id, turn, w, tf * (ln((1 + n) / (1.0 + df)) + 1) AS v FROM tf JOIN df USING (conv_id, w) JOIN n USING (conv_id)), l AS (SELECT conv_id, turn, sqrt(sum(v * v)) AS len FROM x GROUP BY 1, 2), q AS (SELECT conv_id, w, v / len AS q FROM x JOIN l USING (conv_id, turn) WHERE turn = 0), s AS (SELECT conv_id, turn, sum(v / len * q) AS score FROM x JOIN l USING (conv_id, turn) JOIN q USING (conv_id, w) WHERE turn > 0 GROUP BY 1, 2) SELECT conv_id, turn, score FROM s QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY round(score, 9) DESC, turn) <= 3"""


@query("persona_retrieve", TFIDF)
def persona_retrieve(spark, d):
    tok = table(spark, d, "conversations").select("conv_id", "turn", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("w"))
    tf = tok.groupBy("conv_id", "turn", "w").agg(F.count("*").alias("tf"))
    n, df = tf.groupBy("conv_id").agg(F.countDistinct("turn").alias("n")), tf.groupBy("conv_id", "w").agg(F.count("*").alias("df"))
    x = tf.join(df, ["conv_id", "w"]).join(n, "conv_id").withColumn("v", F.col("tf") * (F.ln((1 + F.col("n")) / (1.0 + F.col("df"))) + 1))
    length = x.groupBy("conv_id", "turn").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("len"))
    unit = x.join(length, ["conv_id", "turn"]).select("conv_id", "turn", "w", (F.col("v") / F.col("len")).alias("u"))
    q = unit.where("turn = 0").select("conv_id", "w", F.col("u").alias("q"))
    s = unit.where("turn > 0").join(q, ["conv_id", "w"]).groupBy("conv_id", "turn").agg(F.sum(F.col("u") * F.col("q")).alias("score"))
    return ops.cap_per_key(s, ["conv_id"], [F.round("score", 9).desc(), "turn"], 3)


@query("prototype_assign", ", p AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1 AS i, count(*) OVER () AS n FROM supplier), r AS (SELECT u.user_id, u.user_id // p.n AS cycle, u.user_id % p.n AS slot FROM users u, (SELECT any_value(n) AS n FROM p) p), s AS (SELECT c.cycle, p.s_suppkey, row_number() OVER (PARTITION BY c.cycle ORDER BY (p.s_suppkey * 7919 + c.cycle * 104729) % 10007, p.s_suppkey) - 1 AS slot FROM (SELECT DISTINCT cycle FROM r) c, p) SELECT r.user_id, s.s_suppkey AS prototype FROM r JOIN s USING (cycle, slot)")
def prototype_assign(spark, d):
    p = table(spark, d, "supplier").select("s_suppkey")
    n = p.count()
    r = social.users(spark, d).select("user_id", F.expr(f"user_id div {n}").alias("cycle"), (F.col("user_id") % n).alias("slot"))
    cycles = r.select("cycle").distinct()
    order = (F.col("s_suppkey") * 7919 + F.col("cycle") * 104729) % 10007
    # each cycle deals every prototype once, so the product is as large as the population
    dealt = p.join(cycles, F.lit(True)).select("cycle", F.col("s_suppkey").alias("prototype"), (F.row_number().over(Window.partitionBy("cycle").orderBy(order, "s_suppkey")) - 1).alias("slot"))
    return r.join(dealt, ["cycle", "slot"]).select("user_id", "prototype")


@query("khop_sample", ", h1 AS (SELECT follower_id AS seed, followee_id AS node FROM follows WHERE follower_id < 5 QUALIFY row_number() OVER (PARTITION BY follower_id ORDER BY followee_id * 7919 % 10007, followee_id) <= 20), h2 AS (SELECT h1.node AS src, f.followee_id AS node FROM (SELECT DISTINCT node FROM h1) h1 JOIN follows f ON f.follower_id = h1.node QUALIFY row_number() OVER (PARTITION BY h1.node ORDER BY f.followee_id * 7919 % 10007, f.followee_id) <= 10) SELECT 1 AS hop, seed AS src, node FROM h1 UNION ALL SELECT 2, src, node FROM h2")
def khop_sample(spark, d):
    f = social.follows(spark, d).select(F.col("follower_id").alias("src"), F.col("followee_id").alias("node"))
    order = [F.col("node") * 7919 % 10007, "node"]
    h1 = ops.cap_per_key(f.where("src < 5"), ["src"], order, 20)
    h2 = ops.cap_per_key(f.join(h1.select(F.col("node").alias("src")).distinct(), "src"), ["src"], order, 10)
    return h1.select(F.lit(1).alias("hop"), "src", "node").unionByName(h2.select(F.lit(2).alias("hop"), "src", "node"))


@query("top_indegree", "SELECT followee_id AS user_id, count(*) AS in_degree FROM follows GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def top_indegree(spark, d):
    return social.follows(spark, d).groupBy(F.col("followee_id").alias("user_id")).agg(F.count("*").alias("in_degree")).orderBy(F.desc("in_degree"), "user_id").limit(10)


@query("lorentz_maps", ", e AS (SELECT vec_id, list_transform(embedding[1:8], lambda x: CAST(x AS DOUBLE) / 20) AS v FROM embeddings), n AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM e) SELECT vec_id, v[1] AS logged, v[1] * tanh(n / 2) / n AS projected FROM n")
def lorentz_maps(spark, d):
    """First coordinate of each vector after the exponential and logarithmic map, and of its image in the Poincare ball."""
    x = table(spark, d, "embeddings").select("vec_id", geo.exp0(geo.scaled(F.slice("embedding", 1, 8), F.lit(0.05))).alias("x"))
    return x.select("vec_id", F.element_at(geo.log0(F.col("x")), 1).alias("logged"), F.element_at(geo.to_poincare(F.col("x")), 1).alias("projected"))


@query("negative_pairs", ", g AS (SELECT id, pow(count(*), 0.75) AS w FROM (SELECT follower_id AS id FROM follows UNION ALL SELECT followee_id FROM follows) GROUP BY 1), r AS (SELECT id, -ln((CAST('0x' || substr(sha256('neg|' || id), 1, 13) AS BIGINT) + 1) / 4503599627370497.0) / greatest(w, 1e-6) AS race FROM g) SELECT id FROM r ORDER BY race, id LIMIT 20")
def negative_pairs(spark, d):
    g = social.follows(spark, d).select(F.explode(F.array("follower_id", "followee_id")).alias("id")).groupBy("id").agg(F.pow(F.count("*"), F.lit(0.75)).alias("w"))
    return g.withColumn("salt", F.lit("neg")).withColumn("race", ops.weighted_race(F.col("w"), "salt", "id")).orderBy("race", "id").limit(20).select("id")


COS = "list_sum(list_transform(list_zip({a}, {b}), lambda x: CAST(x[1] AS DOUBLE) * x[2]))"
NORMED = ", e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x / sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * y)))) AS u FROM embeddings)"


@query("cosine_edges", NORMED + f" SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.vec_id < b.vec_id WHERE {COS.format(a='a.u', b='b.u')} > 0.4")
def cosine_edges(spark, d):
    return simjoin.cosine_pairs(table(spark, d, "embeddings"), "vec_id", "embedding", 0.4).select("a", "b")


@query("knn_edges", NORMED + f", k AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.vec_id <> b.vec_id QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY round({COS.format(a='a.u', b='b.u')}, 9) DESC, b.vec_id) <= 5) SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM k")
def knn_edges(spark, d):
    e = table(spark, d, "embeddings")
    top = simjoin.top_k(e, e, "vec_id", "vec_id", "embedding", 5, skip_same=True)
    return top.select(F.least("query", "item").alias("a"), F.greatest("query", "item").alias("b")).distinct()


@query("index_recall", NORMED + f", t AS (SELECT q.vec_id FROM e q JOIN e p ON q.vec_id <> p.vec_id WHERE q.vec_id % 20 = 0 QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY round({COS.format(a='q.u', b='p.u')}, 9) DESC, p.vec_id) <= 5) SELECT count(*) AS neighbours, true AS reached FROM t")
def index_recall(spark, d):
    """Five neighbours of each query vector by exact comparison with all, and whether the index reaches nine tenths of them."""
    e = table(spark, d, "embeddings")
    queries = e.where("vec_id % 20 = 0")
    index = vectorindex.fit(e, "vec_id", "embedding", k=5)
    near = vectorindex.top_k(queries, e, "vec_id", "vec_id", "embedding", 5, index, skip_same=True).select("query", "item", F.lit(1).alias("met"))
    exact = simjoin.top_k(queries, e, "vec_id", "vec_id", "embedding", 5, skip_same=True).select("query", "item")
    both = exact.join(near, ["query", "item"], "left")
    return both.agg(F.count("*").alias("neighbours"), (F.count("met") >= 0.9 * F.count("*")).alias("reached"))


@query("rec_personalized", NORMED + f" SELECT q.vec_id AS user_id, p.vec_id AS post_id FROM e q JOIN e p ON q.vec_id % 150 <> p.vec_id % 150 WHERE q.vec_id % 20 = 0 QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY round({COS.format(a='q.u', b='p.u')}, 9) DESC, p.vec_id) <= 10")
def rec_personalized(spark, d):
    e = table(spark, d, "embeddings")
    top = simjoin.top_k(e.where("vec_id % 20 = 0"), e, "vec_id", "vec_id", "embedding", 10, owner=150)
    return top.select(F.col("query").alias("user_id"), F.col("item").alias("post_id"))


@query("rec_recency", NORMED + f", s AS (SELECT q.vec_id AS user_id, p.vec_id AS post_id, {COS.format(a='q.u', b='p.u')} * ln((271.8 - p.vec_id % 200) / 100) AS score FROM e q JOIN e p ON q.vec_id % 150 <> p.vec_id % 150 WHERE q.vec_id % 20 = 0) SELECT user_id, post_id FROM s QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC, post_id) <= 10")
def rec_recency(spark, d):
    e = table(spark, d, "embeddings")
    weighted = e.withColumn("weight", F.ln((271.8 - F.col("vec_id") % 200) / 100))
    top = simjoin.top_k(e.where("vec_id % 20 = 0"), weighted, "vec_id", "vec_id", "embedding", 10, owner=150, weight="weight")
    return top.select(F.col("query").alias("user_id"), F.col("item").alias("post_id"))


@query("near_mid_far", NORMED + f", s AS (SELECT q.vec_id AS query, p.vec_id AS item, ntile(3) OVER (PARTITION BY q.vec_id ORDER BY round({COS.format(a='q.u', b='p.u')}, 9) DESC, p.vec_id) AS third FROM e q JOIN e p ON q.vec_id <> p.vec_id WHERE q.vec_id % 20 = 0) SELECT query, item, third FROM s QUALIFY row_number() OVER (PARTITION BY query, third ORDER BY item) <= CASE third WHEN 1 THEN 5 WHEN 2 THEN 3 ELSE 2 END")
def near_mid_far(spark, d):
    e = table(spark, d, "embeddings")
    return simjoin.first_of_parts(e.where("vec_id % 20 = 0"), e, "vec_id", "vec_id", "embedding", [5, 3, 2]).withColumnRenamed("part", "third")


@query("neardup_suppress")
def neardup_suppress(spark, d):
    e = table(spark, d, "embeddings")
    conflicts = simjoin.cosine_pairs(e, "vec_id", "embedding", 0.4)
    return simjoin.greedy_keep(e.select(F.col("vec_id").alias("id")), conflicts.select("a", "b"))


@query("neardup_in_groups")
def neardup_in_groups(spark, d):
    """The same within each label: vectors of two labels don't suppress one another."""
    e = table(spark, d, "embeddings")
    label = e.select(F.col("vec_id").alias("id"), "label")
    conflicts = simjoin.cosine_pairs(e, "vec_id", "embedding", 0.3)
    return simjoin.greedy_keep(label.select("id"), simjoin.within_groups(conflicts, label, "label"))


@query("cosine_pairs", NORMED + f" SELECT a.vec_id AS vec_id, {COS.format(a='a.u', b='b.u')} AS cosine FROM e a JOIN e b ON b.vec_id = a.vec_id + 1")
def cosine_pairs(spark, d):
    e = table(spark, d, "embeddings")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(b, "vec_id").select("vec_id", geo.cosine(F.col("embedding"), F.col("other")).alias("cosine"))


@query("poincare", ", e AS (SELECT vec_id, list_transform(embedding[1:8], lambda x: CAST(x AS DOUBLE) / 20) AS v FROM embeddings), n AS (SELECT vec_id, v, list_sum(list_transform(v, lambda x: x * x)) AS s FROM e) SELECT a.vec_id, acosh(1 + 2 * list_sum(list_transform(list_zip(a.v, b.v), lambda x: (x[1] - x[2]) ^ 2)) / ((1 - a.s) * (1 - b.s))) AS distance, 2 * atanh(sqrt(a.s)) AS radius FROM n a JOIN n b ON b.vec_id = a.vec_id + 1")
def poincare(spark, d):
    v = geo.to_ball(geo.scaled(F.slice("embedding", 1, 8), F.lit(0.05)))
    e = table(spark, d, "embeddings").select("vec_id", v.alias("v"))
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w"))
    return e.join(b, "vec_id").select("vec_id", geo.poincare_distance(F.col("v"), F.col("w")).alias("distance"), geo.poincare_radius(F.col("v")).alias("radius"))


@query("lorentz", ", e AS (SELECT vec_id, list_transform(embedding[1:8], lambda x: CAST(x AS DOUBLE) / 20) AS v FROM embeddings) SELECT vec_id, cosh(sqrt(list_sum(list_transform(v, lambda x: x * x)))) AS time, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS from_origin FROM e")
def lorentz(spark, d):
    x = geo.exp0(geo.scaled(F.slice("embedding", 1, 8), F.lit(0.05)))
    origin = F.array(F.lit(1.0), *[F.lit(0.0)] * 8)
    return table(spark, d, "embeddings").select("vec_id", F.element_at(x, 1).alias("time"), geo.lorentz_distance(x, origin).alias("from_origin"))


#: Accounts are the vectors whose id 20 divides; posts are all vectors, of the account with the same number modulo 150.
TASTE = NORMED + """, r AS (SELECT DISTINCT user_id, post_id, action, event_id, ts FROM reactions), q AS (SELECT vec_id AS id, u FROM e WHERE vec_id % 20 = 0), p AS (SELECT vec_id AS id, u, vec_id % 150 AS owner, ln((271.8 - vec_id % 200) / 100) AS weight FROM e)
, kept AS (SELECT user_id, post_id FROM r WHERE action = 'like' AND post_id IN (SELECT id FROM p) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 5)"""
DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda x: x[1] * x[2]))"


def taste(spark, d):
    """Queries with the vectors of what they liked and disliked, and items (see ``feeds.mixed``); the five latest likes count."""
    e = table(spark, d, "embeddings").select("vec_id", feeds.unit("embedding").alias("u"))
    items = e.select(F.col("vec_id").alias("id"), "u", F.ln((271.8 - F.col("vec_id") % 200) / 100).alias("weight"), (F.col("vec_id") % 150).alias("owner"))
    met = social.reactions(spark, d).join(e.withColumnRenamed("vec_id", "post_id"), "post_id")
    liked = ops.cap_per_key(met.where("action = 'like'"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 5)
    queries = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("id"), "u")
    for rows, out in ((liked, "liked"), (met.where("action = 'dislike'"), "disliked")):
        queries = queries.join(feeds.mean_unit(rows, "user_id", "u", out).withColumnRenamed("user_id", "id"), "id", "left")
    return queries, items


@query("rec_recency_likes", TASTE + f""", likes AS (SELECT q.id, p.id AS post, avg({DOT.format(a='l.u', b='p.u')}) AS s FROM q JOIN kept k ON k.user_id = q.id JOIN p l ON l.id = k.post_id CROSS JOIN p GROUP BY 1, 2)
SELECT q.id AS user_id, p.id AS post_id FROM q JOIN p ON q.id <> p.owner LEFT JOIN likes l ON l.id = q.id AND l.post = p.id QUALIFY row_number() OVER (PARTITION BY q.id ORDER BY round({DOT.format(a='q.u', b='p.u')} * (p.weight + coalesce(l.s, {DOT.format(a='q.u', b='p.u')})), 9) DESC, p.id) <= 10""")
def rec_recency_likes(spark, d):
    """Ten posts an account by similarity times recency plus similarity to its latest likes; its own vector stands in for likes that it doesn't have."""
    queries, items = taste(spark, d)
    ready = queries.select("id", "u", F.coalesce("liked", "u").alias("liked"), "disliked", F.lit(0.0).alias("spread"))
    return feeds.best(ready, items, feeds.recency_score, 10).select(F.col("query").alias("user_id"), F.col("item").alias("post_id"))


@query("rec_trace_similar", TASTE + f""", base AS (SELECT q.id, p.id AS post, p.u, {DOT.format(a='q.u', b='p.u')} AS s FROM q JOIN p ON q.id <> p.owner), spread AS (SELECT id, max(s) - min(s) AS w FROM base GROUP BY 1),
hates AS (SELECT user_id, post_id FROM r WHERE action = 'dislike' AND post_id IN (SELECT id FROM p)),
likes AS (SELECT b.id, b.post, avg({DOT.format(a='l.u', b='b.u')}) AS s FROM base b JOIN kept k ON k.user_id = b.id JOIN p l ON l.id = k.post_id GROUP BY 1, 2),
dislikes AS (SELECT b.id, b.post, avg({DOT.format(a='l.u', b='b.u')}) AS s FROM base b JOIN hates k ON k.user_id = b.id JOIN p l ON l.id = k.post_id GROUP BY 1, 2)
SELECT b.id AS user_id, b.post AS post_id FROM base b JOIN spread USING (id) LEFT JOIN likes l ON l.id = b.id AND l.post = b.post LEFT JOIN dislikes h ON h.id = b.id AND h.post = b.post QUALIFY row_number() OVER (PARTITION BY b.id ORDER BY round(b.s + (coalesce(l.s, 0) - coalesce(h.s, 0)) * w / 2, 9) DESC, b.post) <= 20""")
def rec_trace_similar(spark, d):
    """Twenty posts an account by similarity, moved by what it liked and disliked in proportion to the spread of its similarities."""
    queries, items = taste(spark, d)
    return feeds.best(stored(feeds.with_spread(queries, items)), items, feeds.trace_score, 20).select(F.col("query").alias("user_id"), F.col("item").alias("post_id"))


@query("rec_swapped", "SELECT vec_id AS user_id, CAST(20 AS BIGINT) AS posts, CAST(20 AS BIGINT) AS different, CAST(2 AS BIGINT) AS swapped FROM embeddings WHERE vec_id % 20 = 0", views=False)
def rec_swapped(spark, d):
    """The recommendations above with a tenth replaced by random posts: how many an account has, how many different, how many swapped."""
    recs = stored(rec_trace_similar(spark, d).select(F.col("user_id").alias("query"), F.col("post_id").alias("item")))
    found = feeds.swapped(recs, table(spark, d, "embeddings").select(F.col("vec_id").alias("item")))
    return found.groupBy(F.col("query").alias("user_id")).agg(F.count("*").alias("posts"), F.countDistinct("item").alias("different"), F.count_if("swapped").alias("swapped"))


@query("feed_sampled", NORMED + f""", rec AS (SELECT q.vec_id AS user_id, p.vec_id AS post_id FROM e q JOIN e p ON q.vec_id % 150 <> p.vec_id % 150 WHERE q.vec_id % 20 = 0 QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY round({COS.format(a='q.u', b='p.u')}, 9) DESC, p.vec_id) <= 10),
one AS (SELECT user_id, post_id FROM rec QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY sha256('7|' || user_id || '|' || post_id), post_id) <= 5),
net AS (SELECT DISTINCT f.follower_id AS user_id, p.post_id, p.num_likes FROM follows f JOIN posts p ON p.user_id = f.followee_id), two AS (SELECT user_id, post_id FROM net QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY num_likes DESC, sha256('7|' || user_id || '|' || post_id), post_id) <= 3)
SELECT user_id, post_id FROM one UNION SELECT user_id, post_id FROM two""")
def feed_sampled(spark, d):
    """Five of an account's ten recommendations at random, and the three most liked posts of those it follows, equal ones at random."""
    p = social.posts(spark, d)
    net = social.follows(spark, d).join(p, F.col("followee_id") == p["user_id"]).select(F.col("follower_id").alias("user_id"), "post_id", "num_likes")
    return feeds.refreshed(rec_personalized(spark, d), net, 5, 3)


@query("post_threads", """, c AS (SELECT post_id, event_id AS comment_id, user_id, event_id % 13 = 0 AS warning FROM reactions WHERE action = 'comment'), f AS (SELECT *, CASE WHEN warning AND row_number() OVER (PARTITION BY post_id, warning ORDER BY comment_id) = 1 THEN 0 ELSE 1 END AS first, sha256('7|' || post_id || '|' || comment_id) AS draw FROM c),
k AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY post_id ORDER BY first, draw, comment_id) <= 5), l AS (SELECT post_id, string_agg(comment_id || ' by ' || user_id, ', ' ORDER BY first, draw) AS thread FROM k GROUP BY 1)
SELECT post_id, coalesce(thread, '') AS thread FROM posts LEFT JOIN l USING (post_id)""")
def post_threads(spark, d):
    """Each post with its warning and a sample of its other comments, five at most."""
    c = social.reactions(spark, d).where("action = 'comment'").select("post_id", F.col("event_id").alias("comment_id"), "user_id", (F.col("event_id") % 13 == 0).alias("is_warning"))
    shown = feeds.threads(social.posts(spark, d).select("post_id"), c)
    return shown.select("post_id", F.array_join(F.transform("comments", lambda x: F.concat_ws(" by ", x["comment_id"], x["user_id"])), ", ").alias("thread"))
