"""The social-interaction tables, as views of the given data folder, and readers and sinks for raw files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.shared import table

#: Steps are days since 2024-01-01.
#: The reaction that each kind of event stands for.
REACTION = {"click": "like", "error": "dislike", "view": "refresh", "signup": "repost", "purchase": "comment"}


def n_users(spark: SparkSession, d: str) -> int:
    """Number of accounts, which the rules that make authors and follow pairs count up to; read from the file footers."""
    return max(1, table(spark, d, "customer").count())


def trace(spark: SparkSession, d: str) -> DataFrame:
    """Action log: event_id, user_id, ts, step (day), action, value, target (JSON key k), info."""
    e = table(spark, d, "events")
    return e.select("event_id", "user_id", "ts", F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("long").alias("step"), F.col("event_type").alias("action"), "value", F.get_json_object("props", "$.k").cast("long").alias("target"), F.col("props").alias("info"))


def users(spark: SparkSession, d: str) -> DataFrame:
    """user_id, user_name, user_type, is_bad, nation, balance. One market segment plays the coordinated accounts."""
    c = table(spark, d, "customer")
    bad = F.col("c_mktsegment") == "BUILDING"
    return c.select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("user_name"), F.concat(F.when(bad, "bad_").otherwise("good_"), F.lower("c_mktsegment")).alias("user_type"), bad.cast("int").alias("is_bad"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"))


def posts(spark: SparkSession, d: str) -> DataFrame:
    """post_id, user_id, content, step, original_post_id (a third are originals) and its author, is_quote, num_likes, num_dislikes, lang, source."""
    p = table(spark, d, "documents")
    i, n = F.col("doc_id"), n_users(spark, d)
    return p.select(i.alias("post_id"), (i % n).alias("user_id"), F.col("text").alias("content"), (i % 30).alias("step"), F.when(i % 3 != 0, F.expr("doc_id div 3")).alias("original_post_id"), F.when(i % 3 != 0, F.expr("doc_id div 3") % n).alias("original_author"), (i % 3 == 2).alias("is_quote"), (F.col("n_chars") % 97).alias("num_likes"), (F.col("n_chars") % 31).alias("num_dislikes"), "lang", "source")


def reactions(spark: SparkSession, d: str) -> DataFrame:
    """event_id, user_id, ts, step, post_id, action in like, dislike, refresh, repost, comment."""
    mapped = F.create_map(*[F.lit(x) for kv in REACTION.items() for x in kv])
    return trace(spark, d).select("event_id", "user_id", "ts", "step", F.col("target").alias("post_id"), mapped[F.col("action")].alias("action"))


def edges(spark: SparkSession, d: str) -> DataFrame:
    """A typed multigraph: src, dst, relation, weight, evidence (row id)."""
    li = table(spark, d, "lineitem")
    return li.select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_returnflag").alias("relation"), F.col("l_discount").alias("weight"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("evidence"))


def follows(spark: SparkSession, d: str) -> DataFrame:
    """follower_id, followee_id: distinct directed pairs of accounts, from orders' customer and key."""
    o = table(spark, d, "orders")
    n = n_users(spark, d)
    return o.select((F.col("o_custkey") % n).alias("follower_id"), (F.col("o_orderkey") * 7 % n).alias("followee_id")).where("follower_id != followee_id").distinct()


#: The same views for the SQL side.
SQL = """WITH trace AS (SELECT event_id, user_id, ts, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT) AS step, event_type AS action, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS target, props AS info FROM events),
users AS (SELECT c_custkey AS user_id, c_name AS user_name, CASE WHEN c_mktsegment = 'BUILDING' THEN 'bad_' ELSE 'good_' END || lower(c_mktsegment) AS user_type, CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END AS is_bad, c_nationkey AS nation, c_acctbal AS balance FROM customer),
posts AS (SELECT doc_id AS post_id, doc_id % (SELECT count(*) FROM customer) AS user_id, text AS content, doc_id % 30 AS step, CASE WHEN doc_id % 3 <> 0 THEN doc_id // 3 END AS original_post_id, CASE WHEN doc_id % 3 <> 0 THEN doc_id // 3 % (SELECT count(*) FROM customer) END AS original_author, doc_id % 3 = 2 AS is_quote, n_chars % 97 AS num_likes, n_chars % 31 AS num_dislikes, lang, source FROM documents),
reactions AS (SELECT event_id, user_id, ts, step, target AS post_id, CASE action WHEN 'click' THEN 'like' WHEN 'error' THEN 'dislike' WHEN 'view' THEN 'refresh' WHEN 'signup' THEN 'repost' WHEN 'purchase' THEN 'comment' END AS action FROM trace),
edges AS (SELECT l_suppkey AS src, l_partkey AS dst, l_returnflag AS relation, l_discount AS weight, l_orderkey || '-' || l_linenumber AS evidence FROM lineitem),
pairs AS (SELECT o_custkey % n AS follower_id, o_orderkey * 7 % n AS followee_id FROM orders, (SELECT count(*) AS n FROM customer)),
follows AS (SELECT DISTINCT follower_id, followee_id FROM pairs WHERE follower_id <> followee_id)
"""

USER_SCHEMA = "id string, description string, username string, created_at string, verified boolean, public_metrics struct<followers_count bigint, following_count bigint>"
POST_SCHEMA = "id string, author_id string, text string, created_at string, conversation_id string, in_reply_to_user_id string, public_metrics struct<like_count bigint, reply_count bigint, retweet_count bigint, quote_count bigint>, referenced_tweets array<struct<type string, id string>>"
EDGE_COLUMNS = ("source_id", "relation", "target_id")


def read_users(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Profiles from a JSON array, or JSON lines, with a fixed schema; ids stay text."""
    return spark.read.schema(USER_SCHEMA).option("multiLine", not lines).json(path)


def read_posts(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    return spark.read.schema(POST_SCHEMA).option("multiLine", not lines).json(path)


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """Edges from CSV; a file whose header lacks a required column is refused."""
    header = spark.read.option("header", True).csv(path).columns
    if missing := set(EDGE_COLUMNS) - set(header):
        raise ValueError(f"edge file lacks {sorted(missing)}")
    return spark.read.option("header", True).csv(path).select(*EDGE_COLUMNS)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """id, position: one id a line, in the order of the file; blank lines are skipped. A list without ids, or with one twice, is refused."""
    ids = spark.read.text(path).select(F.trim("value").alias("id"), F.monotonically_increasing_id().alias("position")).where("id != ''")
    seen = ids.groupBy("id").agg(F.count("*").alias("n")).agg(F.count("*").alias("ids"), F.count_if(F.col("n") > 1).alias("twice")).first()
    if not seen["ids"] or seen["twice"]:
        raise ValueError(f"id list {path} has {seen['ids']} ids, {seen['twice']} of them more than once")
    return ids


def read_agent_log(spark: SparkSession, path: str) -> DataFrame:
    """Log records (from one INFO to the next) with the number behind the word Agent; null where there is none."""
    records = spark.read.option("lineSep", "INFO").text(path)
    return records.select(F.trim("value").alias("record"), F.regexp_extract("value", r"Agent (\d+)\b", 1).alias("n")).where("record != ''").select(F.when(F.col("n") != "", F.col("n").cast("long")).alias("agent_id"), "record")


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes, sha256 of every file."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def multi_digest(spark: SparkSession, path: str) -> str:
    """One SHA-256 for all files under ``path``: of the lines ``name digest`` in order of the names behind it, so it neither depends on the order of reading nor on where the folder lies."""
    files = file_digests(spark, path).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "sha256")
    lines = F.sort_array(F.collect_list(F.concat_ws(" ", "name", "sha256")))  # one entry a file
    return files.agg(F.sha2(F.array_join(lines, "\n"), 256).alias("digest")).first()["digest"]


def write_bundle(frames: dict[str, DataFrame], out: str, mode: str = "errorifexists") -> DataFrame:
    """Writes each frame as Parquet under ``out`` and returns the manifest: table, rows, columns, and an order-free digest."""
    spark, rows = next(iter(frames.values())).sparkSession, []
    for name, df in frames.items():
        df.write.mode(mode).parquet(f"{out}/{name}")
        back = spark.read.parquet(f"{out}/{name}")
        rows.append(back.agg(F.count("*").alias("rows"), F.sum(F.xxhash64(*back.columns).cast("decimal(38,0)")).cast("string").alias("digest")).select(F.lit(name).alias("table"), "rows", F.lit(len(back.columns)).alias("columns"), "digest"))
    manifest = rows[0]
    for r in rows[1:]:
        manifest = manifest.unionByName(r)
    manifest.coalesce(1).write.mode(mode).json(f"{out}/manifest")
    return manifest


def check_bundle(spark: SparkSession, out: str) -> DataFrame:
    """Recomputes the manifest of a written bundle: table, rows, digest, ok."""
    manifest = spark.read.json(f"{out}/manifest")
    found = None
    for r in manifest.collect():  # one row a table
        back = spark.read.parquet(f"{out}/{r['table']}")
        one = back.agg(F.count("*").alias("rows"), F.sum(F.xxhash64(*back.columns).cast("decimal(38,0)")).cast("string").alias("digest")).select(F.lit(r["table"]).alias("table"), "rows", "digest", ((F.col("rows") == r["rows"]) & F.col("digest").eqNullSafe(F.lit(r["digest"]))).alias("ok"))
        found = one if found is None else found.unionByName(one)
    return found


def packets(contributions: DataFrame, key: str = "user_id") -> DataFrame:
    """One row an account with its contributions (all other columns, which start with the rank) as a list by rank. A list has as
    many entries as there are features, whatever the number of accounts."""
    rest = [c for c in contributions.columns if c != key]
    return contributions.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("rank", *[c for c in rest if c != "rank"]))).alias("contributions"))


def write_contributions(contributions: DataFrame, out: str, mode: str = "errorifexists") -> None:
    """Contributions in long form as CSV with a header (``long``), and a JSON object for each account on a line of its own (``packets``)."""
    contributions.write.mode(mode).options(header=True, escape="\"", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(f"{out}/long")
    packets(contributions).write.mode(mode).json(f"{out}/packets")
