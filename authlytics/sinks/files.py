"""File sinks: incident reports (JSON / text), alert stream, response audit.

Partitioned by day instead of one file per incident; appends are idempotent
per batch when a ``batch_id`` is given (the batch folder is overwritten).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import report as RP


def _dated(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    return df.withColumn("date", F.date_format(F.col(ts), "yyyy-MM-dd"))


def _target(path: str, batch_id: int | None) -> tuple[str, str]:
    return (f"{path}/batch={batch_id}", "overwrite") if batch_id is not None else (path, "append")


def save_json_reports(inc: DataFrame, path: str, batch_id: int | None = None) -> str:
    out, mode = _target(f"{path}/json", batch_id)
    _dated(inc).write.mode(mode).partitionBy("date").json(out)
    return out


def save_text_reports(inc: DataFrame, path: str, batch_id: int | None = None) -> str:
    out, mode = _target(f"{path}/text", batch_id)
    _dated(inc).select("date", RP.text_report().alias("value")).write.mode(mode).partitionBy("date").text(out)
    return out


def save_reports(inc: DataFrame, path: str, fmt: str = "both", batch_id: int | None = None) -> dict:
    """``json`` / ``text`` / ``both``."""
    if fmt not in ("json", "text", "both"):
        raise ValueError("format must be json, text or both")
    files = {}
    if fmt in ("json", "both"):
        files["json"] = save_json_reports(inc, path, batch_id)
    if fmt in ("text", "both"):
        files["text"] = save_text_reports(inc, path, batch_id)
    return files


def append_alerts(alerts: DataFrame, path: str, batch_id: int | None = None) -> str:
    out, mode = _target(path, batch_id)
    alerts.write.mode(mode).json(out)
    return out


def append_audit(audit: DataFrame, path: str, batch_id: int | None = None) -> str:
    out, mode = _target(path, batch_id)
    audit.withColumn("date", F.col("date").cast("string")).write.mode(mode).partitionBy("date").json(out)
    return out


def incident_count(spark: SparkSession, path: str) -> DataFrame:
    """Number of stored incident reports (status view)."""
    return spark.read.schema("incident_id string").json(f"{path}/json").agg(F.countDistinct("incident_id").alias("incidents"))
