"""Text log sources: auth.log, syslog and audit.log, batch and streaming."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import constants as K
from ..functions.parse import parse_lines

SOURCE_ORDER = ("auth_log", "syslog", "audit_log")


def _lines(spark: SparkSession, path: str, source: str) -> DataFrame:
    return (spark.read.text(path)
            .withColumn("source", F.lit(source))
            .withColumn("ingest_time", F.current_timestamp()))


def read_source(spark: SparkSession, path: str, source: str) -> DataFrame:
    """Lines of one log source: (value, source, ingest_time, event_id).

    ``event_id`` is a row key for lines that carry no id of their own.
    """
    return _lines(spark, path, source).withColumn("event_id", F.monotonically_increasing_id())


def read_sources(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """One line set from all configured sources (no dedupe), tagged by source. Row
    keys are given after the union, so no two lines share one."""
    frames = [_lines(spark, paths[s], s) for s in SOURCE_ORDER if s in paths]
    if not frames:
        raise ValueError("no log source configured")
    return reduce(lambda a, b: a.unionByName(b), frames).withColumn("event_id", F.monotonically_increasing_id())


def ingest_all(spark: SparkSession, paths: dict[str, str], year: int | None = 2024) -> DataFrame:
    """Read and parse every source: the batch form of one ingestion cycle."""
    return parse_lines(read_sources(spark, paths), year=year)


def stream_source(spark: SparkSession, directory: str, source: str,
                  max_files_per_trigger: int | None = None) -> DataFrame:
    """New files dropped into a landing folder, read incrementally.

    Spark's file source picks up new files (rotated segments), not appended
    bytes; the checkpoint of the query keeps the read position exactly-once.
    ``max_files_per_trigger`` bounds one micro-batch like the reference's
    ``batch_size``.
    """
    reader = spark.readStream.format("text")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return (reader.load(directory)
            .withColumn("source", F.lit(source))
            .withColumn("ingest_time", F.current_timestamp()))


def read_baseline_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Baseline feature rows (event_id string, 14 doubles) from JSON lines. Every field is
    read as text first, so flags may be true/false or 0/1 and ids of any kind."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n in ("event_id", *K.FEATURE_NAMES)])
    rows = spark.read.schema(schema).json(path)

    def number(c: str):
        v = F.lower(F.col(c))
        return F.when(v == "true", 1.0).when(v == "false", 0.0).otherwise(v.try_cast("double")).alias(c)

    return rows.select("event_id", *[number(c) for c in K.FEATURE_NAMES])
