"""Incident reports, alerts and the text rendering, as column expressions.

Incident numbering ``INC-yyyymmdd-%06d`` is one sequence per day in (event
time, event id) order. A plain ``row_number() OVER (PARTITION BY date)`` would
put a whole day into one task, so it is a two-level prefix: per (day, second)
counts, an exclusive running sum over that small table, plus a local
row_number inside each (day, second) partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import attack as AT
from ..params import Params
from ..session import cut_lineage

ISO = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def incident_ids(df: DataFrame, ts: str = "event_time", key: str = "event_id", carried: DataFrame | None = None) -> DataFrame:
    """Adds ``incident_id`` (per-day sequence in (ts, key) order). ``carried`` (date, last):
    the numbers that days have reached already."""
    t = F.col(ts).cast("timestamp")
    # read twice below (rows and their counts): the upstream plan runs once
    x = (cut_lineage(df).withColumn("_day", F.to_date(t))
           .withColumn("_sec", F.unix_seconds(t)))
    per_sec = (x.groupBy("_day", "_sec").agg(F.count(F.lit(1)).alias("_c"))
               .withColumn("_base", F.coalesce(F.sum("_c").over(
                   Window.partitionBy("_day").orderBy("_sec").rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)))
               .drop("_c"))
    w = Window.partitionBy("_day", "_sec").orderBy(F.col(ts), F.col(key))
    x = x.withColumn("_loc", F.row_number().over(w)).join(per_sec, ["_day", "_sec"])
    seq = F.col("_base") + F.col("_loc")
    if carried is not None:
        x = x.join(carried.select(F.col("date").alias("_day"), F.col("last").alias("_last")), "_day", "left")
        seq = seq + F.coalesce("_last", F.lit(0))
        x = x.withColumn("_base", seq - F.col("_loc")).drop("_last")
        seq = F.col("_base") + F.col("_loc")
    return (x.withColumn("incident_id", F.format_string("INC-%s-%06d", F.date_format("_day", "yyyyMMdd"), seq))
             .drop("_day", "_sec", "_loc", "_base"))


def feature_subset(prefix: str = "") -> Column:
    """The 8 features the mapping sees; defaults when the vector is missing."""
    c = lambda n: F.col(prefix + n)
    return F.struct(
        F.coalesce(c("ip_failed_logins"), F.lit(0)).alias("ip_failed_logins"),
        F.coalesce(c("ip_unique_users_attempted"), F.lit(0)).alias("ip_unique_users_attempted"),
        F.coalesce(c("ip_failed_to_success_ratio"), F.lit(0.0)).alias("ip_failed_to_success_ratio"),
        F.coalesce(c("user_new_ip_detected"), F.lit(False)).alias("user_new_ip_detected"),
        F.coalesce(c("user_first_sudo_usage"), F.lit(False)).alias("user_first_sudo_usage"),
        F.coalesce(c("user_failed_sudo_attempts"), F.lit(0)).alias("user_failed_sudo_attempts"),
        F.coalesce(c("session_login_to_privesc_seconds"), F.lit(0.0)).alias("session_login_to_privesc_seconds"),
        F.coalesce(c("session_lolbin_executed"), F.lit(False)).alias("session_lolbin_executed"),
    )


def kill_chain(ts: Column, event_type: Column, ip: Column, user: Column) -> Column:
    return F.array(F.struct(F.date_format(ts, ISO).alias("timestamp"),
                            F.format_string("%s: %s -> %s", event_type, F.coalesce(ip, F.lit("unknown")),
                                            F.coalesce(user, F.lit("unknown"))).alias("description")))


def incidents(anomalies: DataFrame, p: Params | None = None, actions: DataFrame | None = None,
              carried: DataFrame | None = None) -> DataFrame:
    """Full nested incident rows from anomaly rows (features + detection
    columns on the row). ``actions`` (event_id, seq, action_type, target,
    reason, result_message) are attached per incident when given; the
    reference's engine path reports none."""
    p = p or Params()
    fs = feature_subset()
    ids = AT.technique_ids(
        F.col("event_type"), p,
        ip_failed_logins=fs["ip_failed_logins"], ip_failed_to_success_ratio=fs["ip_failed_to_success_ratio"],
        user_new_ip_detected=fs["user_new_ip_detected"], user_first_sudo_usage=fs["user_first_sudo_usage"],
        user_failed_sudo_attempts=fs["user_failed_sudo_attempts"],
        session_login_to_privesc_seconds=fs["session_login_to_privesc_seconds"],
        session_lolbin_executed=fs["session_lolbin_executed"])
    x = incident_ids(anomalies, carried=carried).withColumn("_techs", AT.enrich(ids))
    out = x.select(
        "incident_id", "event_id",
        F.col("event_time").alias("timestamp"),
        F.col("risk_level").alias("severity"),
        "event_type", "source_ip", "username", "anomaly_score", "confidence",
        AT.tactics(F.col("_techs")).alias("mitre_tactics"),
        F.col("_techs").alias("mitre_techniques"),
        kill_chain(F.col("event_time"), F.col("event_type"), F.col("source_ip"), F.col("username")).alias("kill_chain_events"),
        "contributing_features", "explanation",
    )
    if actions is None:
        return out.withColumn("response_actions", F.array().cast(
            "array<struct<action_type:string,target:string,reason:string,result_message:string>>"))
    per_event = (actions.groupBy("event_id").agg(F.sort_array(F.collect_list(F.struct(
        "seq", "action_type", "target", "reason", "result_message"))).alias("_a"))
        .select("event_id", F.transform("_a", lambda a: F.struct(a["action_type"].alias("action_type"), a["target"].alias("target"),
                                                                a["reason"].alias("reason"),
                                                                a["result_message"].alias("result_message"))).alias("response_actions")))
    return out.join(per_event, "event_id", "left")


def alerts(inc: DataFrame) -> DataFrame:
    """8-column alert projection."""
    return inc.select(F.col("timestamp"), "incident_id", "severity", "event_type", "source_ip", "username",
                      F.col("anomaly_score").cast("double").alias("anomaly_score"), "explanation")


def _fmt(fmt: str, x: Column, digits: int) -> Column:
    return F.format_string(fmt, F.round(x, digits))


def text_report(ts_fmt: str = ISO) -> Column:
    """80-column text rendering of an incident row."""
    c = F.col
    eq, dash = "=" * 80, "-" * 80
    techs = F.transform(c("mitre_techniques"),
                        lambda t: F.format_string("  - %s: %s (%s)", t["id"], t["name"], t["tactic"]))
    chain = F.transform(c("kill_chain_events"),
                        lambda e, i: F.format_string("%d. [%s] %s", i + 1, e["timestamp"], e["description"]))
    feats = F.transform(c("contributing_features"),
                        lambda f: F.concat(F.lit("  - "), f["name"], F.lit(": "), _fmt("%.3f", f["value"], 3)))
    acts = F.transform(F.coalesce(c("response_actions"), F.array()),
                       lambda a: F.format_string("  - %s: %s (%s)", a["action_type"], a["target"], a["result_message"]))
    has_chain = F.size(c("kill_chain_events")) > 0
    has_acts = F.size(F.coalesce(c("response_actions"), F.array())) > 0
    return F.concat_ws(
        "\n",
        F.lit(eq), F.lit("SECURITY INCIDENT REPORT"), F.lit(eq), F.lit(""),
        F.concat(F.lit("Incident ID: "), c("incident_id")),
        F.concat(F.lit("Timestamp: "), F.date_format(c("timestamp"), ts_fmt)),
        F.concat(F.lit("Severity: "), c("severity")), F.lit(""),
        F.lit("INCIDENT SUMMARY"), F.lit(dash),
        F.concat(F.lit("Event Type: "), c("event_type")),
        F.when(F.coalesce(c("source_ip"), F.lit("")) != "", F.concat(F.lit("Source IP: "), c("source_ip"))),
        F.when(F.coalesce(c("username"), F.lit("")) != "", F.concat(F.lit("Target User: "), c("username"))),
        F.concat(F.lit("Anomaly Score: "), _fmt("%.3f", c("anomaly_score"), 3)),
        F.concat(F.lit("ML Confidence: "), _fmt("%.1f%%", c("confidence") * 100.0, 1)),
        F.lit(""),
        F.lit("MITRE ATT&CK COVERAGE"), F.lit(dash),
        F.concat(F.lit("Tactics: "), F.array_join(c("mitre_tactics"), ", ")),
        F.lit(""), F.lit("Techniques:"), techs, F.lit(""),
        F.when(has_chain, F.lit("KILL CHAIN TIMELINE")), F.when(has_chain, F.lit(dash)),
        chain, F.when(has_chain, F.lit("")),
        F.lit("MACHINE LEARNING ANALYSIS"), F.lit(dash),
        F.concat(F.lit("Explanation: "), c("explanation")),
        F.lit(""), F.lit("Contributing Features:"), feats, F.lit(""),
        F.when(has_acts, F.lit("RESPONSE ACTIONS")), F.when(has_acts, F.lit(dash)),
        acts, F.when(has_acts, F.lit("")),
        F.lit(eq),
    )


def report_json(inc: DataFrame) -> DataFrame:
    cols = [c for c in inc.columns if c != "event_id"]
    return inc.select("incident_id", F.to_json(F.struct(*cols)).alias("json"))
