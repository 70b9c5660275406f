"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import apply_defaults, scratch_path

#: Rows of an Arrow batch handed to Python. Texts average a few KB and may be far
#: longer, so batches are kept small: a worker holds one batch at a time.
ARROW_ROWS = 256


def prepare(spark: SparkSession) -> None:
    """Session settings the operators rely on; a value the session sets itself wins."""
    apply_defaults(spark)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as keep it apart from the columns
    of ``df`` (whatever their case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


#: Spark drops the shuffle files of a query when it ends.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str, small: bool = False) -> DataFrame:
    """Write ``df`` below the shared checkpoint folder and read it back: cuts the
    lineage, survives lost executors and is evaluated once; its shuffles are dropped when
    it's written. ``small``: narrow rows that need no more files than twice the cores."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    if small:
        df = df.coalesce(2 * spark.sparkContext.defaultParallelism)
    before = spark.conf.get(DROP_SHUFFLES, None)
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(DROP_SHUFFLES)
        else:
            spark.conf.set(DROP_SHUFFLES, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def released(*tables: DataFrame) -> None:
    """Give back the space of ``stored`` tables that no later plan reads: each is
    overwritten with an empty one."""
    for t in tables:
        t.sparkSession.createDataFrame([], t.schema).coalesce(1).write.mode("overwrite").parquet(t.stored_at)
