"""Operational metrics tables: per-component statistics, bottlenecks,
retention, bounded buffers, recommendations, cycle statistics.

``metrics`` rows: component, operation, duration_ms, timestamp, success,
error_msg. Aggregates are hash aggregates with map-side partial aggregation;
top-k and latest-n are ``orderBy().limit()`` (TakeOrderedAndProject, a
bounded heap per task).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K


def component_stats(metrics: DataFrame) -> DataFrame:
    c = F.col
    return (metrics.groupBy("component").agg(
        F.count(F.lit(1)).alias("total_calls"),
        F.sum("duration_ms").alias("total_time_ms"),
        F.min("duration_ms").alias("min_time_ms"),
        F.max("duration_ms").alias("max_time_ms"),
        F.count_if(~c("success")).alias("errors"))
        .withColumn("avg_time_ms", c("total_time_ms") / c("total_calls"))
        .withColumn("success_rate", (c("total_calls") - c("errors")) / c("total_calls")))


def component_filter(metrics: DataFrame, component: str) -> DataFrame:
    """Statistics of one component (the filter runs before the aggregate and
    is pushed into the scan)."""
    return component_stats(metrics.where(F.col("component") == component))


def top_bottlenecks(metrics: DataFrame, k: int = 5) -> DataFrame:
    """k slowest successful operations; ties keep arrival (time) order."""
    return (metrics.where(F.col("success"))
            .orderBy(F.col("duration_ms").desc(), F.col("timestamp").asc(), F.col("event_id").asc())
            .limit(k)
            .select("component", "operation", "duration_ms", "timestamp"))


def retention(metrics: DataFrame, seconds: int = 3600, as_of=None) -> DataFrame:
    """Keep rows not older than ``as_of - seconds``; ``as_of`` defaults to the
    newest timestamp in the table (one value, read first, so that the filter is a
    literal the scan can use)."""
    if as_of is None:
        as_of = metrics.agg(F.max("timestamp")).first()[0]
    newest = F.lit(as_of).cast(metrics.schema["timestamp"].dataType)
    return metrics.where(F.col("timestamp") >= newest - F.expr(f"INTERVAL {int(seconds)} SECONDS"))


def latest_n(df: DataFrame, n: int = 10000, ts: str = "timestamp", key: str = "event_id") -> DataFrame:
    """Bounded buffer: the newest n rows (drop oldest)."""
    return df.orderBy(F.col(ts).desc(), F.col(key).desc()).limit(n)


def recommendations(metrics: DataFrame) -> DataFrame:
    """One text per finding; the fixed default line when there is none."""
    st = component_stats(metrics)
    c = F.col
    err = F.when(c("success_rate") < 0.95, F.format_string(
        "Component '%s' has error rate %s%%. Review error logs for issues.", c("component"),
        F.format_string("%.1f", F.round((F.lit(1.0) - c("success_rate")) * 100.0, 1))))
    slow = F.when(c("avg_time_ms") > 100, F.format_string(
        "Component '%s' has high latency (%sms avg). Consider optimization.", c("component"),
        F.format_string("%.0f", F.round(c("avg_time_ms"), 0))))
    recs = st.select(c("component"), F.explode(F.filter(F.array(err, slow), lambda x: x.isNotNull())).alias("recommendation"))
    default = (recs.agg(F.count(F.lit(1)).alias("_n")).where("_n = 0")
               .select(F.lit(None).cast("string").alias("component"), F.lit(K.REC_NORMAL).alias("recommendation")))
    return recs.unionByName(default)


def cycle_stats(cycles: DataFrame) -> DataFrame:
    """cycles: one row per detection cycle (cycle_id, started_at, ended_at,
    failed, anomalies). Success rate as the reference computes it."""
    c = F.col
    return (cycles.agg(
        F.count(F.lit(1)).alias("cycles_completed"),
        F.count_if(c("failed")).alias("cycles_failed"),
        F.coalesce(F.sum("anomalies"), F.lit(0)).cast("long").alias("anomalies_detected"),
        (F.unix_seconds(F.max("ended_at").cast("timestamp")) - F.unix_seconds(F.min("started_at").cast("timestamp"))).alias("uptime_seconds"))
        .withColumn("success_rate", (c("cycles_completed") - c("cycles_failed")) / F.greatest(c("cycles_completed"), F.lit(1))))


def recent(df: DataFrame, count: int = 10, ts: str = "timestamp", key: str = "incident_id") -> DataFrame:
    """Most recent ``count`` rows, newest first."""
    return df.orderBy(F.col(ts).desc(), F.col(key).desc()).limit(count)
