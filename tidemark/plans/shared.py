"""Helpers that every multi-step operator uses: shared scratch tables and null-safe column choice."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows of a table that is broadcast.
BROADCAST_ROWS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors share: ``spark.checkpoint.dir`` when the session has it.

    A session on one machine (tests, notebooks) that lacks the setting gets a temporary folder. On a cluster such a folder would be
    another one on each machine, so a session there without the setting is refused.
    """
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not given:
        if not one_machine(spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        given = tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(given)
    return given


def one_machine(master: str) -> bool:
    """Whether driver and executors are one process: ``local``, ``local[8]``, not ``local-cluster``."""
    return master == "local" or master.startswith("local[")


def stored(df: DataFrame) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it again: lineage ends there, so that
    the loss of an executor costs no more than the stage that it was in. The files go when the JVM ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    kept = spark.read.schema(df.schema).parquet(path)
    kept.stored_at = path
    return kept


def released(*frames: DataFrame) -> None:
    """Deletes tables of ``stored`` that nothing reads any more: all that came from them is stored itself."""
    for df in frames:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def unlimited_recursion(spark: SparkSession):
    """Within it, recursive queries may make any number of rows; Spark stops them at a million otherwise. Their results must be stored inside."""
    key = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, which is a stored or otherwise cheap table of short rows, marked for broadcast if it has at most ``rows``; beyond that its joins shuffle."""
    return F.broadcast(df) if df.count() <= rows else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of the data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def named(column: str):
    """A column by its exact name, whatever characters are in it."""
    return F.col("`" + column.replace("`", "``") + "`")


def packed(df: DataFrame, **added) -> DataFrame:
    """Each row of ``df`` as one struct ``row``, beside ``added`` columns: names of helpers can't clash with the caller's."""
    return df.select(F.struct(*[named(c) for c in df.columns]).alias("row"), *[c.alias(name) for name, c in added.items()])


def unpacked(df: DataFrame, columns: list[str], **changed) -> DataFrame:
    """The ``columns`` of the struct ``row``; ``changed`` ones replace those of the same name, or are added behind."""
    lower = {name.lower(): name for name in changed}
    own = [changed[lower.pop(c.lower())].alias(c) if c.lower() in lower else F.col("row")[c].alias(c) for c in columns]
    return df.select(*own, *[changed[name].alias(name) for name in lower.values()])


def first_column(df: DataFrame, candidates: list[str], default=None):
    """The first of ``candidates`` that ``df`` has, as a column; the literal ``default`` if it has none."""
    found = [c for c in candidates if c in df.columns]
    return F.col(found[0]) if found else F.lit(default)
