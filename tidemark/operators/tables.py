"""Generic table operators: keyed dedupe, caps, samples, folds, coverage checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in a stated order; rows with a null key are left out."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.dropna(subset=keys).withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def cap_per_key(df: DataFrame, keys: list[str], order: list, most: int) -> DataFrame:
    """At most ``most`` rows of each key, the first in order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= most).drop("__n")


def hash_order(*cols: str, seed: int = 7) -> Column:
    """A seeded pseudo-random order of rows that doesn't depend on partitioning."""
    return F.xxhash64(F.lit(seed), *cols)


def missing_keys(wanted: DataFrame, having: DataFrame, key: str) -> DataFrame:
    """Keys of ``wanted`` that ``having`` lacks."""
    return wanted.select(key).distinct().join(having.select(key), key, "left_anti")


def set_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """key, side: ids on one side only."""
    return missing_keys(a, b, key).withColumn("side", F.lit("left")).unionByName(missing_keys(b, a, key).withColumn("side", F.lit("right")))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with the count."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def join_one_to_one(a: DataFrame, b: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Join that fails if a key repeats on either side; the check is part of the plan."""

    def proved(df):
        n = F.count("*").over(Window.partitionBy(key))
        ok = F.assert_true(n == 1, F.concat(F.lit(f"{key} repeats: "), F.col(key).cast("string")))
        return df.withColumn("__ok", ok).where("__ok is null").drop("__ok")

    return proved(a).join(proved(b), key, how)


def fold_switch(events: DataFrame, keys: list[str], order: list, on: list[str], off: list[str], action: str = "action") -> DataFrame:
    """Keys whose last switching event is an ``on`` action: the state that a log of on and off events leaves."""
    last = first_per_key(events.where(F.col(action).isin(on + off)), keys, [F.desc(c) if isinstance(c, str) else c for c in order])
    return last.where(F.col(action).isin(on)).select(*keys)


def weighted_race(weight: Column, *key: str) -> Column:
    """Exponential race time -ln(u) / weight from a digest of the key; the k least are a weighted sample without replacement."""
    digest = F.substring(F.sha2(F.concat_ws("|", *key), 256), 1, 13)
    u = (F.conv(digest, 16, 10).cast("double") + 1) / F.lit(float(2**52 + 1))
    return -F.ln(u) / F.greatest(weight, F.lit(1e-6))


def plan_summary(episodes: DataFrame) -> DataFrame:
    """One row on a plan (domain, purpose, scenario_id, num_agents): episodes, real and synthetic ones, agents of the synthetic, the main scenarios and the scale sizes, in order.

    The sets have an entry a scenario or size, however many episodes there are; an empty plan has zeros and empty sets."""
    synthetic, purpose = F.col("domain") == "synthetic", F.col("purpose")
    kept = lambda name, column: F.sort_array(F.collect_set(F.when(synthetic & (purpose == name), F.col(column))))
    agents = F.coalesce(F.sum(F.when(synthetic, F.coalesce(F.col("num_agents"), F.lit(0)))), F.lit(0)).cast("long")
    return episodes.agg(F.count("*").alias("episodes"), F.count_if(F.col("domain") == "real").alias("real_episodes"), F.count_if(synthetic).alias("synthetic_episodes"), agents.alias("synthetic_agents"), kept("simulation_main", "scenario_id").alias("main_scenarios"), kept("simulation_scale", "num_agents").alias("scale_sizes"))


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """name, value (as text), n: how often each value of each column occurs, nulls included, in one pass over the table."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in columns]))
    return df.select(each.alias("x")).groupBy("x.name", "x.value").agg(F.count("*").alias("n"))


def padded(curves: DataFrame, key: str, step: str, value: str, length: int) -> DataFrame:
    """key, step, value for the steps 0 to ``length`` - 1 of every key: its value at the step or else the last one before; null before the first. Later steps are left out."""
    spine = curves.select(key).distinct().select(key, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(length - 1).cast("long"))).alias(step))
    w = Window.partitionBy(key).orderBy(step)
    return spine.join(curves.select(key, F.col(step).cast("long").alias(step), value), [key, step], "left").select(key, step, F.last(value, ignorenulls=True).over(w).alias(value))


def typed_edges(tables: list[tuple[DataFrame, str, str, str, str]]) -> DataFrame:
    """src_type, src, relation, dst_type, dst of all edge tables (src, dst) and their inverses. Each entry is a table, the types of its ends, and the names of the
    relation and its inverse; rows with a null end are left out, repeated edges stay."""
    out = None
    for df, src_type, relation, dst_type, inverse in tables:
        ends = [(src_type, "src", relation, dst_type, "dst"), (dst_type, "dst", inverse, src_type, "src")]
        each = F.explode(F.array(*[F.struct(F.lit(a).alias("src_type"), F.col(x).cast("long").alias("src"), F.lit(r).alias("relation"), F.lit(b).alias("dst_type"), F.col(y).cast("long").alias("dst")) for a, x, r, b, y in ends]))
        one = df.where("src is not null and dst is not null").select(each.alias("e")).select("e.*")  # both directions from one scan
        out = one if out is None else out.unionByName(one)
    return out


def evidence_rows(tables: list[tuple[DataFrame, str, list[str], str, str | None]]) -> DataFrame:
    """evidence_id, kind, actor, text of all tables in one form. Each entry is a table, the prefix of its ids, the columns that make an id (joined by ``>``), the actor's column and
    that of the text, or None; a row without a part of its id is left out."""
    out = None
    for df, prefix, ids, actor, text in tables:
        known = df.dropna(subset=ids)
        one = known.select(F.concat(F.lit(prefix + ":"), F.concat_ws(">", *ids)).alias("evidence_id"), F.lit(prefix).alias("kind"), F.col(actor).cast("long").alias("actor"), (F.col(text) if text else F.lit(None)).cast("string").alias("text"))
        out = one if out is None else out.unionByName(one)
    return out


def evidence_lists(df: DataFrame, key: str, columns: list[str], separator: str = r"\s*[;|]\s*") -> DataFrame:
    """key, field, position, value of the text lists in ``columns``: each cell is split at the separator, blank entries are left out, positions count what is left from 1."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.filter(F.transform(F.split(F.coalesce(F.col(c).cast("string"), F.lit("")), separator), lambda x: F.trim(x)), lambda x: x != "").alias("values")) for c in columns]))
    rows = df.select(key, each.alias("x")).select(key, "x.field", F.posexplode("x.values").alias("position", "value"))
    return rows.select(key, "field", (F.col("position") + 1).cast("long").alias("position"), "value")
