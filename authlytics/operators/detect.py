"""Score post-processing: risk level, confidence, contributions, explanation.

All are column expressions over a scored feature row (one ``select``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..params import Params


def logistic(raw: Column) -> Column:
    """Reference normalisation ``1 / (1 + exp(s))``; range (0.5, 0.731] for
    s in [-1, 0)."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(raw))


def anomaly_score(raw: Column, p: Params) -> Column:
    """'paper': -score_samples, in (0, 1]; 'logistic': the reference's form."""
    return logistic(raw) if p.score_mode == "logistic" else -raw


def risk_level(score: Column, p: Params | None = None) -> Column:
    p = p or Params()
    return (F.when(score >= p.critical_threshold, "CRITICAL")
            .when(score >= p.high_threshold, "HIGH")
            .when(score >= p.medium_threshold, "MEDIUM")
            .when(score >= p.low_threshold, "LOW")
            .otherwise("NORMAL"))


def confidence(score: Column) -> Column:
    return F.least(score * F.lit(1.5), F.lit(1.0))


def vector(df_or_cols=None) -> Column:
    """The 14 features in fixed order as ARRAY<DOUBLE> (bool -> 0/1)."""
    return F.array(*[F.col(n).cast("double") for n in K.FEATURE_NAMES])


def contributions(vec: Column) -> Column:
    """min(|x|, 1) per feature, kept when > 0.1, sorted by value descending
    (stable on feature order): ARRAY<STRUCT<name, value>>."""
    names = F.array(*[F.lit(n) for n in K.FEATURE_NAMES])
    items = F.transform(F.arrays_zip(names.alias("name"), vec.alias("value")),
                        lambda z, i: F.struct(F.least(F.abs(z["value"]), F.lit(1.0)).alias("value"),
                                              i.alias("idx"), z["name"].alias("name")))
    kept = F.filter(items, lambda s: s["value"] > 0.1)
    keyed = F.transform(kept, lambda s: F.struct((-s["value"]).alias("k"), s["idx"].alias("idx"),
                                                 s["name"].alias("name"), s["value"].alias("value")))
    return F.transform(F.array_sort(keyed), lambda s: F.struct(s["name"].alias("name"), s["value"].alias("value")))


def _pct1(x: Column) -> Column:
    return F.format_string("%.1f%%", F.round(x * 100.0, 1))


def explanation(is_anomaly: Column, p: Params | None = None) -> Column:
    """Fixed-text rules joined by '; ' (threshold literals are parameters). A row
    without a feature vector (all features null) has an explanation of its own."""
    p = p or Params()
    c = F.col
    factors = F.concat_ws(
        "; ",
        F.when(c("ip_failed_logins") > p.failed_login_threshold,
               F.format_string("High failed login attempts (%d)", c("ip_failed_logins"))),
        F.when(c("ip_unique_users_attempted") > p.unique_users_threshold,
               F.format_string("Scanning multiple users (%d)", c("ip_unique_users_attempted"))),
        F.when(c("ip_failed_to_success_ratio") > p.failure_ratio_threshold,
               F.concat(F.lit("High failure rate ("), _pct1(c("ip_failed_to_success_ratio")), F.lit(")"))),
        F.when(c("user_new_ip_detected"), F.lit("Login from new IP address")),
        F.when(c("user_first_sudo_usage"), F.lit("First sudo usage for user")),
        F.when(c("user_failed_sudo_attempts") > p.failed_sudo_threshold,
               F.format_string("Multiple failed sudo attempts (%d)", c("user_failed_sudo_attempts"))),
        F.when((c("session_login_to_privesc_seconds") > 0) & (c("session_login_to_privesc_seconds") < p.rapid_privesc_seconds),
               F.format_string("Rapid privilege escalation (%ds after login)",
                               c("session_login_to_privesc_seconds").cast("long"))),
        F.when(c("session_lolbin_executed"), F.lit("Potential LOLBin execution detected")),
    )
    return (F.when(~is_anomaly, F.lit(K.EXPLAIN_NORMAL))
            .when(F.coalesce(*[c(n).cast("string") for n in K.FEATURE_NAMES]).isNull(), F.lit(K.EXPLAIN_MISSING))
            .when(factors == "", F.lit(K.EXPLAIN_UNCLEAR))
            .otherwise(F.concat(F.lit(K.EXPLAIN_PREFIX), factors)))


def detect(scored: DataFrame, p: Params | None = None, raw_col: str = "raw_score",
           anomaly_col: str = "is_anomaly") -> DataFrame:
    """Scored feature rows -> anomaly rows (one select; the metadata columns
    stay on the row instead of being paired by list position)."""
    p = p or Params()
    s = anomaly_score(F.col(raw_col), p)
    return (scored
            .withColumn("anomaly_score", s)
            .withColumn("risk_level", risk_level(F.col("anomaly_score"), p))
            .withColumn("confidence", confidence(F.col("anomaly_score")))
            .withColumn("contributing_features", contributions(vector()))
            .withColumn("explanation", explanation(F.col(anomaly_col), p)))
