"""ATT&CK technique mapping: rules, dimension, lookup, enrichment.

The dimension has a fixed size (15 rows), so it is either inlined as a literal
map (enrichment of a technique array: narrow, no join) or broadcast (lookup by
id as a left join). Neither grows with the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import constants as K
from ..params import Params

DIM_SCHEMA = T.StructType([
    T.StructField("technique_id", T.StringType(), False),
    T.StructField("name", T.StringType(), False),
    T.StructField("tactic", T.StringType(), False),
    T.StructField("description", T.StringType(), False),
    T.StructField("detection_indicators", T.ArrayType(T.StringType()), False),
])


def attack_dim(spark: SparkSession) -> DataFrame:
    """All techniques (get_all_techniques)."""
    return spark.createDataFrame([(i, n, t, d, list(ind)) for i, n, t, d, ind in K.TECHNIQUES], DIM_SCHEMA)


def _tech_map() -> Column:
    kv = []
    for i, n, t, d, _ in K.TECHNIQUES:
        kv += [F.lit(i), F.struct(F.lit(i).alias("id"), F.lit(n).alias("name"),
                                  F.lit(t).alias("tactic"), F.lit(d).alias("description"))]
    return F.create_map(*kv)


def attack_lookup(df: DataFrame, id_col: str, dim: DataFrame) -> DataFrame:
    """Technique by id; null columns when the id is absent (broadcast left join
    against the fixed-size dimension)."""
    d = dim.select(F.col("technique_id").alias("_tid"), F.col("name").alias("technique_name"),
                   F.col("tactic").alias("technique_tactic"), F.col("description").alias("technique_description"))
    return df.join(F.broadcast(d), F.col(id_col) == F.col("_tid"), "left").drop("_tid")


def technique_ids(event_type: Column, p: Params | None = None, **feat: Column) -> Column:
    """Rule list in rule order, duplicates kept. ``feat`` may give the columns
    ip_failed_logins, ip_failed_to_success_ratio, user_new_ip_detected,
    user_first_sudo_usage, user_failed_sudo_attempts,
    session_login_to_privesc_seconds, session_lolbin_executed (defaults when
    absent)."""
    p = p or Params()

    def f(name, default):
        c = feat.get(name)
        return F.coalesce(c, F.lit(default)) if c is not None else F.lit(default)
    et = event_type
    privesc = f("session_login_to_privesc_seconds", 0.0)
    empty = F.array().cast("array<string>")

    def rule(cond, *ids):
        return F.when(cond, F.array(*[F.lit(i) for i in ids])).otherwise(empty)
    return F.flatten(F.array(
        rule((et == K.EV_LOGIN_FAILED) & (f("ip_failed_logins", 0) > p.failed_login_threshold), "T1110", "T1110.001"),
        rule(et == K.EV_INVALID_USER, "T1110"),
        rule((et == K.EV_LOGIN_SUCCESS) & (f("ip_failed_to_success_ratio", 0.0) > p.stuffing_ratio_threshold),
             "T1110.004", "T1078"),
        rule((et == K.EV_LOGIN_SUCCESS) & f("user_new_ip_detected", False), "T1078", "T1078.001"),
        rule(F.instr(et, "sudo") > 0, "T1548", "T1548.003"),
        rule((et == K.EV_SUDO_SUCCESS) & f("user_first_sudo_usage", False), "T1548"),
        rule((et == K.EV_SUDO_FAILURE) & (f("user_failed_sudo_attempts", 0) > p.failed_sudo_threshold), "T1548.003"),
        rule((privesc > 0) & (privesc < p.rapid_privesc_seconds), "T1548"),
        rule(f("session_lolbin_executed", False), "T1059.004", "T1105"),
    ))


def technique_ids_from(df: DataFrame, p: Params | None = None, event_type: str = "event_type") -> Column:
    names = ("ip_failed_logins", "ip_failed_to_success_ratio", "user_new_ip_detected", "user_first_sudo_usage",
             "user_failed_sudo_attempts", "session_login_to_privesc_seconds", "session_lolbin_executed")
    return technique_ids(F.col(event_type), p, **{n: F.col(n) for n in names if n in df.columns})


def enrich(ids: Column) -> Column:
    """ids -> array<struct<id, name, tactic, description>> in the same order."""
    m = _tech_map()
    return F.filter(F.transform(ids, lambda x: F.try_element_at(m, x)), lambda s: s.isNotNull())


def tactics(techs: Column) -> Column:
    """Distinct tactic names of an enriched technique array (sorted; the
    reference's set order is undefined)."""
    return F.array_sort(F.array_distinct(F.transform(techs, lambda t: t["tactic"])))
