"""Nested records: leaves by a recursive query over VARIANT values, canonical text and digest, taxonomy nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.shared import named, packed, stored, unlimited_recursion, unpacked

WALK = """
WITH RECURSIVE walk (row, path, value, inner_text) AS (
    SELECT row, CAST(array() AS ARRAY<STRUCT<key: STRING, pos: INT, text: STRING>>), value, to_json(value)
    FROM (SELECT row, try_parse_json(json) AS value FROM {texts})
    UNION ALL
    SELECT w.row, array_append(w.path, named_struct('key', e.key, 'pos', e.pos, 'text', to_json(array(e.key)))), e.value, to_json(e.value)
    FROM walk w, LATERAL variant_explode(w.value) e
    WHERE (e.key IS NULL OR NOT (:drops AND array_contains(:without, e.key))) AND (e.key IS NOT NULL OR :lists)
)
SELECT row, path, inner_text FROM walk
"""


def number_form(text: Column) -> Column:
    """One form for equal numbers: whole ones under 10^15 as digits, others without trailing zeros, or as the shortest double."""
    d = text.try_cast("double")
    whole = (F.floor(d) == d) & (F.abs(d) < 1e15)
    plain = text.rlike(r"^-?[0-9]+(\.[0-9]+)?$")
    return F.when(whole, F.floor(d).cast("long").cast("string")).when(plain, F.regexp_replace(F.regexp_replace(text, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")).otherwise(d.cast("string"))


def leaves(texts: DataFrame, without: tuple[str, ...] = (), lists: bool = True) -> DataFrame:
    """row, path, value: the leaves of each JSON text, at any depth, stored. ``texts`` has row (unique) and json.

    A path holds a struct for each step: key, pos (place in its list or object) and the key as JSON text, null inside lists. A leaf is a scalar, or an object
    or list that has nothing left in it. Keys named in ``without`` go with all below them, at any depth. With ``lists`` False, lists are leaves too.
    A text that isn't JSON, or null, has no leaves. value is JSON; equal numbers have one form.
    """
    spark = texts.sparkSession
    keys = F.array(*[F.lit(k) for k in without or ("",)])
    with unlimited_recursion(spark):
        seen = stored(spark.sql(WALK, {"without": keys, "drops": bool(without), "lists": lists}, texts=texts))
    kind = F.substring("inner_text", 1, 1)
    left = F.size(F.filter(F.json_object_keys("inner_text"), lambda k: F.lit(not without) | ~F.array_contains(keys, k)))
    leaf = F.when(kind == "{", left == 0).when(kind == "[", (F.col("inner_text") == "[]") | F.lit(not lists)).otherwise(F.lit(True))
    value = F.when(kind == "{", "{}").when(kind.isin("[", '"', "t", "f", "n"), F.col("inner_text")).otherwise(number_form(F.col("inner_text")))
    return seen.where(F.col("inner_text").isNotNull() & leaf).select("row", "path", value.alias("value"))


def opened(step: Column) -> Column:
    return F.when(step["key"].isNull(), "[").otherwise("{")


def key_text(step: Column) -> Column:
    """The key and a colon; nothing inside lists."""
    return F.when(step["key"].isNull(), "").otherwise(F.concat(F.substring(step["text"], F.lit(2), F.length(step["text"]) - 2), F.lit(":")))


def closed(steps: Column) -> Column:
    return F.array_join(F.transform(F.reverse(steps), lambda s: F.when(s["key"].isNull(), "]").otherwise("}")), "")


def with_canonical(df: DataFrame, json: str, without: tuple[str, ...] = (), canonical: str = "canonical") -> DataFrame:
    """The rows of ``df`` and the canonical form of the column ``json``: keys in order of their code points, no spaces, one form for equal numbers, keys of ``without`` left out at
    any depth. Null where the text is null or no JSON (an object that has a key twice isn't either). Repeated rows stay.

    The leaves of a record, in order of their paths, are written one behind the other; how many brackets close and open between two of
    them follows from the steps their paths share, so depth costs no further shuffle.
    """
    rows = stored(packed(df, row_id=F.monotonically_increasing_id(), json=named(json)))
    found = leaves(rows.select(F.col("row_id").alias("row"), "json"), without)
    p, q = F.col("path"), F.col("before")
    shared = F.array_position(F.zip_with(p, q, lambda x, y: x.eqNullSafe(y)), F.lit(False)).cast("int") - 1
    rest = lambda steps, at: F.slice(steps, at, F.size(steps))
    deeper = lambda steps: F.array_join(F.transform(steps, lambda s: F.concat(opened(s), key_text(s))), "")
    between = F.concat(closed(rest(q, F.col("shared") + 2)), F.lit(","), key_text(F.get(p, F.col("shared"))), deeper(rest(p, F.col("shared") + 2)))
    piece = F.concat(F.when(q.isNull(), deeper(p)).otherwise(between), F.col("value"))
    told = found.withColumn("before", F.lag("path").over(Window.partitionBy("row").orderBy("path"))).withColumn("shared", shared)
    whole = told.select("row", "path", piece.alias("piece")).groupBy("row").agg(F.sort_array(F.collect_list(F.struct("path", "piece"))).alias("of"))
    text = F.concat(F.array_join(F.col("of.piece"), ""), closed(F.element_at("of", -1)["path"]))
    joined = rows.join(whole.select(F.col("row").alias("row_of"), text.alias("canonical_text")), F.col("row_id") == F.col("row_of"), "left")
    return unpacked(joined, df.columns, **{canonical: F.col("canonical_text")})


def dotted(found: DataFrame) -> DataFrame:
    """row, parts, value of ``leaves``: keys, and places in lists as numbers; the root of a scalar text has no part and is left out."""
    parts = F.transform("path", lambda s: F.coalesce(s["key"], s["pos"].cast("string")))
    return found.where(F.size("path") > 0).select("row", parts.alias("parts"), "value")


def taxonomy(found: DataFrame) -> DataFrame:
    """row, node, depth, parent, children, siblings of every node above and at the leaves; parent is null at depth 1. Each node once in each row."""
    each = dotted(found).select("row", "parts", F.explode(F.sequence(F.lit(1), F.size("parts"))).alias("depth"))
    at = lambda n: F.array_join(F.slice("parts", F.lit(1), n), ".")
    nodes = each.select("row", at(F.col("depth")).alias("node"), "depth", F.when(F.col("depth") > 1, at(F.col("depth") - 1)).alias("parent")).distinct()
    below = nodes.groupBy("row", "parent").agg(F.count("*").alias("n"))
    own = below.where("parent is not null").select("row", F.col("parent").alias("node"), F.col("n").alias("children"))
    level = below.select(F.col("row").alias("of"), F.col("parent").alias("up"), F.col("n").alias("level"))
    nodes = nodes.join(own, ["row", "node"], "left").join(level, (F.col("row") == F.col("of")) & F.col("parent").eqNullSafe(F.col("up")))
    return nodes.select("row", "node", "depth", "parent", F.coalesce("children", F.lit(0)).alias("children"), (F.col("level") - 1).alias("siblings"))


def siblings(nodes: DataFrame, asked: DataFrame) -> DataFrame:
    """row, node, sibling for the (row, node) of ``asked``: the other children of the node's parent in ``nodes`` (see ``taxonomy``)."""
    own = nodes.join(asked.select("row", "node"), ["row", "node"], "left_semi").select("row", "node", "parent")
    other = nodes.select(F.col("row").alias("of"), F.col("node").alias("sibling"), F.col("parent").alias("up"))
    return own.join(other, (F.col("row") == F.col("of")) & F.col("parent").eqNullSafe(F.col("up")) & (F.col("node") != F.col("sibling"))).select("row", "node", "sibling")


#: Keys of a profile that aren't its content.
NO_CONTENT = ("Generated At", "Profile Index", "Summary")


def profile_quality(profiles: DataFrame, least_leaves: int, least_words: int = 80) -> DataFrame:
    """row, leaves, words, valid of each profile (row, json): its non-empty leaves outside NO_CONTENT (top level), the words of its Summary, and whether both are enough.

    Null, empty and blank leaves, and empty objects and lists, count as empty; a text that is no JSON object has neither leaves nor words.
    """
    found = leaves(profiles.select("row", "json"))
    filled = ~F.col("value").isin("null", "{}", "[]") & ~F.col("value").rlike(r'^"(\s|\\[nrt])*"$')
    content = found.where((F.size("path") > 0) & ~F.coalesce(F.get("path", F.lit(0))["key"].isin(*NO_CONTENT), F.lit(False))).groupBy("row").agg(F.count_if(filled).alias("leaves"))
    summary = F.expr("try_variant_get(try_parse_json(json), '$.Summary', 'string')")
    words = F.size(F.filter(F.split(F.coalesce(summary, F.lit("")), r"\s+"), lambda w: w != ""))
    every = profiles.select("row", words.alias("words")).join(content, "row", "left").select("row", F.coalesce("leaves", F.lit(0)).cast("long").alias("leaves"), F.col("words").cast("long").alias("words"))
    return every.withColumn("valid", (F.col("leaves") >= least_leaves) & (F.col("words") >= least_words))
