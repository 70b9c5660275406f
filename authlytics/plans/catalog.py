"""Registered queries (Spark) and their oracle SQL (DuckDB), keyed by the
data Spark derives from them) in full."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K
from ..operators import features as FE
from ..params import Params
from ..session import scratch_path
from ..sources import fixtures as FX
from ..sources import text_logs as TL
from . import oracle_sql as OS

QUERIES: dict = {}
ORACLE: dict = {}

QP = Params(window_seconds=OS.QUERY_WINDOW_SECONDS, bucket_seconds=OS.QUERY_WINDOW_SECONDS)


def register(name: str, sql: str | None = None):
    """Register a query; every registered query first pins the session
    settings the plans rely on (UTC time zone, AQE), whatever session the
    caller passes in."""
    def deco(fn):
        def query(spark, sf, _fn=fn):
            from ..session import apply_defaults
            apply_defaults(spark)
            return _fn(spark, sf)
        query.__name__ = fn.__name__
        query.__doc__ = fn.__doc__
        QUERIES[name] = query
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def r6(c: str):
    return F.round(F.col(c), 6).alias(c)


# ----------------------------------------------------------------- features

def features_df(spark: SparkSession, sf: str, p: Params = QP) -> DataFrame:
    return FE.extract_features(FX.auth_events(spark, sf), p)


def _feature_select(df: DataFrame, cols) -> DataFrame:
    return df.select("event_id", *cols)


def _feature_query(name: str, cols, compat: bool = False):
    sql_cols = ", ".join(["event_id", *cols])
    sql = f"select {sql_cols} from ({OS.features_sql(compat=compat)}) f"
    p = QP.with_(compat=True) if compat else QP

    def q(spark, sf):
        return _feature_select(features_df(spark, sf, p), cols)
    register(name, sql)(q)


_FEATURE_IDS = {
    "feat_ip_failed_logins": ["ip_failed_logins"],
    "feat_ip_unique_users": ["ip_unique_users_attempted"],
    "feat_ip_failure_ratio": ["ip_failed_to_success_ratio"],
    "feat_ip_avg_inter_attempt": ["ip_avg_inter_attempt_seconds"],
    "feat_ip_auth_method_diversity": ["ip_auth_method_variance"],
    "feat_user_login_hour_stddev": ["user_login_time_std_devs"],
    "feat_user_new_ip": ["user_new_ip_detected"],
    "feat_user_first_sudo": ["user_first_sudo_usage"],
    "feat_user_failed_sudo": ["user_failed_sudo_attempts"],
    "feat_session_login_to_privesc": ["session_login_to_privesc_seconds"],
    "feat_session_command_rate": ["session_post_login_command_rate"],
    "feat_session_lolbin": ["session_lolbin_executed"],
    "feat_session_account_changes": ["session_account_changes"],
    "feat_extract_all": list(K.FEATURE_NAMES),
}
for _n, _c in _FEATURE_IDS.items():
    _feature_query(_n, _c)
_feature_query("feat_extract_all_compat", list(K.FEATURE_NAMES), compat=True)


# ----------------------------------------------------------------- sources + parsing

from ..functions.parse import parse_lines, event_to_json  # noqa: E402

_PARSED_SQL = OS.parsed_sql(FX.all_lines_sql("duckdb"))


def parsed_df(spark: SparkSession, sf: str) -> DataFrame:
    return parse_lines(FX.all_lines(spark, sf), year=2024)


def _us(c="event_time"):
    # unknown lines are stamped with ingest time, which differs from run to run
    return F.when(F.col("event_type") != "unknown", F.unix_micros(F.col(c))).alias("event_us")


_SSH_COLS = ["event_id", "username", "source_ip", "source_port", "auth_method", "service"]
_ALL_COLS = ["event_id", "source", "event_type", "username", "source_ip", "source_port", "auth_method",
             "service", "message"]


def _parse_query(name: str, where_sql: str, cols, with_time: bool = False):
    sql_cols = ", ".join(cols + (["case when event_type <> 'unknown' then epoch_us(event_time) end as event_us"]
                                 if with_time else []))
    sql = f"select {sql_cols} from ({_PARSED_SQL}) p where {where_sql}"

    def q(spark, sf):
        df = parsed_df(spark, sf).where(F.expr(where_sql))
        return df.select(*cols, *([_us()] if with_time else []))
    register(name, sql)(q)


_parse_query("parse_ssh_failed", "event_type = 'login_failed'", _SSH_COLS, True)
_parse_query("parse_ssh_success", "event_type = 'login_success'", _SSH_COLS, True)
_parse_query("parse_ssh_invalid_user", "event_type = 'invalid_user_attempt'", _SSH_COLS, True)
_parse_query("parse_ssh_disconnect", "instr(raw_line, 'Disconnected from') > 0",
             ["event_id", "event_type", "username", "source_ip", "source_port", "auth_method", "service"])
_parse_query("parse_sudo_success", "event_type = 'sudo_success'", ["event_id", "username", "source_ip", "auth_method", "service"], True)
_parse_query("parse_sudo_failure", "event_type = 'sudo_failure'", ["event_id", "username", "source_ip", "auth_method", "service"], True)
_parse_query("parse_audit_execve", "source = 'audit_log'",
             ["event_id", "event_type", "username", "message", "auth_method", "service"], True)
_parse_query("parse_unknown_fallback", "event_type = 'unknown'",
             ["event_id", "source", "username", "source_ip", "source_port", "auth_method", "service"])
_parse_query("parse_event_time", "event_type <> 'unknown'", ["event_id", "source"], True)


def _source_query(name: str, source: str | None):
    """The rendered lines are written as text and read by the source operator."""
    cols = [c for c in _ALL_COLS if c != "event_id"] + ["raw_line"]
    where = f"source = '{source}'" if source else "true"
    sql = (f"select {', '.join(cols)}, case when event_type <> 'unknown' then epoch_us(event_time) end as event_us "
           f"from ({_PARSED_SQL}) p where {where}")

    def q(spark, sf):
        paths = FX.write_sources(spark, FX.all_lines(spark, sf), scratch_path(spark, f"logs-{name}"))
        lines = TL.read_source(spark, paths[source], source) if source else TL.read_sources(spark, paths)
        return parse_lines(lines, year=2024).select(*cols, _us())
    register(name, sql)(q)


_source_query("src_auth_log", "auth_log")
_source_query("src_syslog", "syslog")
_source_query("src_audit_log", "audit_log")
_source_query("src_union_all", None)


@register("src_baseline_jsonl", f"select cast(event_id as varchar) as event_id, {', '.join(n + '::double as ' + n for n in K.FEATURE_NAMES)} "
          f"from ({OS.features_sql()}) f")
def q_src_baseline_jsonl(spark, sf):
    """Feature rows written as JSON lines (flags as true/false) and read back."""
    path = scratch_path(spark, "baseline")
    features_df(spark, sf).select("event_id", *K.FEATURE_NAMES).write.json(path)
    return TL.read_baseline_jsonl(spark, path)


@register("parse_drop_blank", f"""select source, event_type, count(*)::bigint as n, count(distinct raw_line)::bigint as n_lines
  from ({_PARSED_SQL}) p group by source, event_type""")
def q_parse_drop_blank(spark, sf):
    return (parsed_df(spark, sf).groupBy("source", "event_type")
            .agg(F.count(F.lit(1)).alias("n"), F.countDistinct("raw_line").alias("n_lines")))


_JSON_COLS = ["source", "event_type", "username", "source_ip", "auth_method", "service", "message", "raw_line", "host"]


@register("event_to_json", f"select event_id, {', '.join(_JSON_COLS)}, source_port from ({_PARSED_SQL}) p")
def q_event_to_json(spark, sf):
    j = event_to_json(parsed_df(spark, sf))
    back = F.from_json("json", ", ".join(f"{c} string" for c in _JSON_COLS) + ", source_port int")
    return j.select("event_id", back.alias("j")).select("event_id", "j.*")


# ----------------------------------------------------------------- remaining feature ids

from ..operators import attack as AT  # noqa: E402
from ..operators import detect as DT  # noqa: E402
from ..operators import forest as FO  # noqa: E402
from ..operators import ops as OP  # noqa: E402
from ..operators import report as RP  # noqa: E402
from ..operators import response as RS  # noqa: E402
from ..session import apply_defaults  # noqa: E402

_FSQL = OS.features_sql()


@register("feat_extract_all_hot", f"select event_id, {', '.join(K.FEATURE_NAMES)} from ({_FSQL}) f")
def q_feat_extract_all_hot(spark, sf):
    """All features with every bucket of more than ten rows worked on in blocks."""
    p = QP.with_(hot_rows=10)
    return _feature_select(FE.extract_features(FX.auth_events(spark, sf), p), list(K.FEATURE_NAMES))


@register("feat_window_history", f"select event_id, ip_window_events, user_window_events from ({_FSQL}) f")
def q_feat_window_history(spark, sf):
    return features_df(spark, sf).select("event_id", "ip_window_events", "user_window_events")


def nation_prefixes(spark: SparkSession, sf: str) -> DataFrame:
    """ASN prefix table derived from ``nation``: nation n owns 10.0.0.(4n)..(4n+3)."""
    return FX.read_table(spark, sf, "nation").selectExpr(
        "167772160 + 4 * n_nationkey as lo", "167772160 + 4 * n_nationkey + 3 as hi",
        "concat('AS', cast(64500 + n_nationkey as string)) as asn")


@register("feat_user_new_asn", f"""
with f as ({_FSQL}),
pre as (select 167772160 + 4 * n_nationkey as lo, 167772160 + 4 * n_nationkey + 3 as hi,
          'AS' || cast(64500 + n_nationkey as varchar) as asn from nation),
x as (select f.event_id, f.ts, f.username, pre.asn,
        cast(split_part(f.source_ip, '.', 1) as bigint) * 16777216 + cast(split_part(f.source_ip, '.', 2) as bigint) * 65536
        + cast(split_part(f.source_ip, '.', 3) as bigint) * 256 + cast(split_part(f.source_ip, '.', 4) as bigint) as ipl
      from f join pre on true
      where f.source_ip is not null and f.username is not null),
m as (select event_id, ts, username, asn from x
      where ipl between (select lo from pre p where p.asn = x.asn) and (select hi from pre p where p.asn = x.asn)),
firsts as (select event_id from (select event_id, row_number() over (partition by username, asn order by ts, event_id) as rn from m) q where rn = 1)
select f.event_id, f.event_id in (select event_id from firsts) as user_login_from_new_asn from f""")
def q_feat_user_new_asn(spark, sf):
    df = FE.extract_features(FX.auth_events(spark, sf), QP, asn_prefixes=nation_prefixes(spark, sf))
    return df.select("event_id", "user_login_from_new_asn")


def nested_prefixes(spark, sf):
    """Prefixes of both families, narrow ones of every other nation inside wide ones."""
    n = FX.read_table(spark, sf, "nation").selectExpr("n_nationkey as n", "concat('AS', cast(64500 + n_nationkey as string)) as asn").where("n % 2 = 0")
    wide = spark.createDataFrame([("10.0.0.0/25", "wide4"), ("10.0.0.0/8", "widest4"), ("2001:DB8::/32", "wide6"), ("2001:db8::40/122", "narrower6")],
                                 "prefix string, asn string")
    return (n.selectExpr("concat('10.0.0.', cast(n * 4 as string), '/30') as prefix", "asn")
            .unionByName(n.selectExpr("concat('2001:0db8::', lower(hex(n * 16)), '/124') as prefix", "asn")).unionByName(wide))


@register("feat_user_new_asn_nested", f"""
with a as ({FX.auth_sql('duckdb')}),
m as (select event_id, ts, username, case
    when event_id % 2 = 0 and (k // 4) % 2 = 0 and k // 4 < 25 then 'AS' || (64500 + k // 4)::varchar
    when event_id % 2 = 0 then 'wide4'
    when (k // 16) % 2 = 0 and k // 16 < 25 then 'AS' || (64500 + k // 16)::varchar
    when k between 64 and 127 then 'narrower6' else 'wide6' end as asn
  from a where source_ip is not null and username is not null),
firsts as (select event_id from (select event_id, row_number() over (partition by username, asn order by ts, event_id) as rn from m) q where rn = 1)
select event_id, event_id in (select event_id from firsts) as user_login_from_new_asn from a""")
def q_feat_user_new_asn_nested(spark, sf):
    """New ASNs of users where every other event comes from an IPv6 address."""
    ev = FX.auth_events(spark, sf)
    v6 = F.concat(F.lit("2001:db8:0::"), F.lower(F.hex("k")))
    ev = ev.withColumn("source_ip", F.when(F.col("source_ip").isNotNull() & (F.col("event_id") % 2 == 1), v6).otherwise(F.col("source_ip")))
    df = FE.extract_features(ev, QP, asn_prefixes=nested_prefixes(spark, sf))
    return df.select("event_id", "user_login_from_new_asn")


@register("feat_event_id", f"""select event_id, concat_ws('_', coalesce(source_ip, 'unknown'), coalesce(username, 'unknown'),
  cast(cast(cast(epoch_us(ts) as decimal(20,0)) / 1000000 as decimal(20,6)) as varchar)) as ref_event_id from ({_FSQL}) f""")
def q_feat_event_id(spark, sf):
    return features_df(spark, sf).select("event_id", "ref_event_id")


@register("feat_vector_assemble", f"""select event_id, [{', '.join(n + '::double' for n in K.FEATURE_NAMES)}] as vector
  from ({_FSQL}) f""")
def q_feat_vector_assemble(spark, sf):
    return features_df(spark, sf).select("event_id", DT.vector().alias("vector"))


@register("feat_metadata_project", f"""select event_id, concat_ws('_', coalesce(source_ip, 'unknown'), coalesce(username, 'unknown'),
  cast(cast(cast(epoch_us(ts) as decimal(20,0)) / 1000000 as decimal(20,6)) as varchar)) as ref_event_id,
  coalesce(source_ip, 'unknown') as source_ip, coalesce(username, 'unknown') as username, event_type,
  strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') as timestamp from ({_FSQL}) f""")
def q_feat_metadata_project(spark, sf):
    return features_df(spark, sf).select(
        "event_id", "ref_event_id", F.coalesce("source_ip", F.lit("unknown")).alias("source_ip"),
        F.coalesce("username", F.lit("unknown")).alias("username"), "event_type",
        F.date_format("event_time", RP.ISO).alias("timestamp"))


# ----------------------------------------------------------------- scored fixture (no forest)

def scored_df(spark: SparkSession, sf: str, p: Params = QP) -> DataFrame:
    apply_defaults(spark)
    f = FE.extract_features(FX.auth_events(spark, sf), p, carry=("value",))
    f = f.selectExpr("*", *FX.SCORE_COLS)
    return DT.detect(f, p, raw_col="raw_score", anomaly_col="anomaly_fixture").withColumnRenamed(
        "anomaly_fixture", "is_anomaly")


_SCORED = OS.scored_sql()


@register("ml_risk_level", f"select event_id, anomaly_score, {OS.risk_sql('anomaly_score')} as risk_level from ({_SCORED}) s")
def q_ml_risk_level(spark, sf):
    return scored_df(spark, sf).select("event_id", "anomaly_score", "risk_level")


@register("ml_confidence", f"select event_id, least(anomaly_score * 1.5, 1.0) as confidence from ({_SCORED}) s")
def q_ml_confidence(spark, sf):
    return scored_df(spark, sf).select("event_id", "confidence")


@register("ml_logistic_score", f"""select event_id, round(1.0 / (1.0 + exp(raw_score)), 6) as logistic,
  {OS.risk_sql('1.0 / (1.0 + exp(raw_score))')} as risk_level from ({_SCORED}) s""")
def q_ml_logistic_score(spark, sf):
    s = scored_df(spark, sf)
    lg = DT.logistic(F.col("raw_score"))
    return s.select("event_id", F.round(lg, 6).alias("logistic"), DT.risk_level(lg).alias("risk_level"))


@register("ml_contributions", f"""select event_id, array_to_string(list_transform(c, lambda x: x.name), ',') as contrib_names,
  len(c)::bigint as contrib_n, round(coalesce(list_sum(list_transform(c, lambda x: x.value)), 0.0), 6) as contrib_sum
  from (select event_id, {OS.contributions_list_sql()} as c from ({_FSQL}) f) q""")
def q_ml_contributions(spark, sf):
    c = DT.contributions(DT.vector())
    return features_df(spark, sf).select(
        "event_id", F.array_join(F.transform(c, lambda x: x["name"]), ",").alias("contrib_names"),
        F.size(c).cast("long").alias("contrib_n"),
        F.round(F.aggregate(F.transform(c, lambda x: x["value"]), F.lit(0.0), lambda a, b: a + b), 6).alias("contrib_sum"))


@register("ml_explanation", f"select event_id, {OS.explanation_sql()} as explanation from ({_SCORED}) s")
def q_ml_explanation(spark, sf):
    return scored_df(spark, sf).select("event_id", "explanation")


@register("ml_contamination_cut", """with s as (select event_id, -(value / (value + 50.0)) as raw_score from events),
q as (select quantile_cont(raw_score, 0.1) as off from s)
select event_id, raw_score < off as is_anomaly, round(off, 6) as offset from s, q""")
def q_ml_contamination_cut(spark, sf):
    s = FX.read_table(spark, sf, "events").selectExpr("event_id", "-(value / (value + 50.0)) as raw_score")
    off = FO.exact_quantile(s, "raw_score", QP.contamination)
    return s.select("event_id", (F.col("raw_score") < F.lit(off)).alias("is_anomaly"),
                    F.round(F.lit(off), 6).alias("offset"))


@register("ml_scaler_fit", " union all ".join(
    f"select '{n}' as feature, round(avg({n}::double), 6) as mean, round(stddev_pop({n}::double), 6) as std from ({_FSQL}) f"
    for n in K.FEATURE_NAMES))
def q_ml_scaler_fit(spark, sf):
    f = features_df(spark, sf)
    mean, std = FO.fit_scaler(f, FO.FEATURES)
    t = FO.scaler_table(spark, FO.FEATURES, mean, std)
    return t.select("feature", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@register("ml_scaler_apply", "select event_id, " + ", ".join(
    f"round(({n}::double - avg({n}::double) over ()) / case when stddev_pop({n}::double) over () = 0 then 1.0 "
    f"else stddev_pop({n}::double) over () end, 6) as z_{n}" for n in K.FEATURE_NAMES) + f" from ({_FSQL}) f")
def q_ml_scaler_apply(spark, sf):
    f = features_df(spark, sf)
    mean, std = FO.fit_scaler(f, FO.FEATURES)
    z = FO.apply_scaler(f, FO.FEATURES, mean, std, suffix="__z")
    return z.select("event_id", *[F.round(F.col(n + "__z"), 6).alias("z_" + n) for n in FO.FEATURES])


# ----------------------------------------------------------------- forest (rows-only checks)

from . import pipelines as PL  # noqa: E402

_MODELS: dict = {}


def trained_model(spark: SparkSession, sf: str, p: Params = Params()):
    key = (spark.sparkContext.applicationId, sf, repr(p))
    if key not in _MODELS:
        apply_defaults(spark)
        feats = FE.extract_features(FX.auth_events(spark, sf), p)
        _MODELS[key] = PL.train(spark, feats, p, enforce_guard=False)
    return _MODELS[key]


#: The forest over the features of the checked queries, restated in SQL.
_FOREST = "with " + OS.forest_sql(_FSQL, QP)


@register("ml_forest_fit", f"""{_FOREST}
select tree::int as tree_id, node::int as node_id, feature::int as feature, round(threshold, 6) as threshold, depth::int as depth, n::int as n from nodes""")
def q_ml_forest_fit(spark, sf):
    m = trained_model(spark, sf, QP)
    return (spark.createDataFrame(m.nodes, FO.NODE_SCHEMA)
            .select("tree_id", "node_id", "feature", F.round("threshold", 6).alias("threshold"), "depth", "n"))


@register("pipe_train", f"""{_FOREST}
select (select psi from rate)::int as psi, {QP.n_trees} as n_trees, round((select cut_at from cut), 6) as offset, (select count(*) from nodes)::bigint as n_nodes""")
def q_pipe_train(spark, sf):
    m = trained_model(spark, sf, QP)
    return spark.createDataFrame([(m.psi, m.n_trees, round(float(m.offset), 6), len(m.nodes))],
                                 "psi int, n_trees int, offset double, n_nodes long")


@register("ml_score_samples", f"{_FOREST} select event_id, round(raw, 6) as raw_score from scores")
def q_ml_score_samples(spark, sf):
    m = trained_model(spark, sf, QP)
    z = [c + "__z" for c in FO.FEATURES]
    xs = FO.apply_scaler(features_df(spark, sf).select("event_id", *FO.FEATURES), FO.FEATURES, m.mean, m.std, suffix="__z")
    return FO.score(xs.select("event_id", *z), m, z).select("event_id", F.round("raw_score", 6).alias("raw_score"))


_BASELINE_FEATURES = " union all ".join(
    f"select '{n}' as feature, count(*)::bigint as n, round(avg({n}::double), 6) as mean, round(stddev_pop({n}::double), 6) as std from f" for n in K.FEATURE_NAMES)


@register("pipe_train_jsonl", f"""{_FOREST}, t as ({_BASELINE_FEATURES})
select t.*, (select count(*) from nodes)::bigint as n_nodes, round((select cut_at from cut), 6) as offset from t""")
def q_pipe_train_jsonl(spark, sf):
    """Training from three stored baselines (JSON lines) whose moments merge: the same scaler
    and the same forest as from all rows at once."""
    rows = features_df(spark, sf).select(F.col("event_id").cast("string").alias("event_id"), *K.FEATURE_NAMES)
    root = scratch_path(spark, "baselines")
    for k in range(3):
        rows.where(F.pmod(F.col("event_id").cast("long"), F.lit(3)) == k).write.json(f"{root}/part{k}")
    m, state = PL.train_from_baselines(spark, [f"{root}/part{k}" for k in range(3)], QP, enforce_guard=False)
    std = F.round(F.sqrt(F.greatest(F.col("m2"), F.lit(0.0)) / F.col("n")), 6)
    return state.select("feature", "n", F.round("mean", 6).alias("mean"), std.alias("std"),
                        F.lit(len(m.nodes)).cast("long").alias("n_nodes"), F.lit(round(float(m.offset), 6)).alias("offset"))


def detections_df(spark, sf, p: Params = Params()):
    m = trained_model(spark, sf, p)
    return PL.score_features(FE.extract_features(FX.auth_events(spark, sf), p), m, p)


_DETECT_SQL = f"""select event_id, event_type, raw_score, anomaly_score, is_anomaly, {OS.risk_sql('anomaly_score')} as risk_level,
  least(anomaly_score * 1.5, 1.0) as confidence, {OS.explanation_sql()} as explanation,
  array_to_string(list_transform({OS.contributions_list_sql()}, lambda x: x.name || '=' || round(x.value, 6)::decimal(12, 6)::varchar), ',') as contributing_features from ({_SCORED}) s"""


@register("ml_detect", _DETECT_SQL)
def q_ml_detect(spark, sf):
    named = F.transform("contributing_features", lambda x: F.concat(x["name"], F.lit("="), F.round(x["value"], 6).cast("decimal(12,6)").cast("string")))
    return scored_df(spark, sf).select("event_id", "event_type", "raw_score", "anomaly_score", "is_anomaly", "risk_level",
                                       "confidence", "explanation", F.array_join(named, ",").alias("contributing_features"))


@register("ml_filter_anomalies", f"select event_id, event_type, anomaly_score, risk_level from ({_DETECT_SQL}) d where is_anomaly")
def q_ml_filter_anomalies(spark, sf):
    return scored_df(spark, sf).where("is_anomaly").select("event_id", "event_type", "anomaly_score", "risk_level")


_GUARD = "case when n >= 1000 then 'ok' else 'insufficient' end as status, n < 1000 as refused"


@register("ml_train_guard", f"""with c as (select event_type as part, count(*) as n from events group by 1
  union all select 'all', count(*) from events union all select 'user ' || (user_id % 3), count(*) from events where user_id < 3 group by 1)
select part, n as n_rows, {_GUARD} from c""")
def q_ml_train_guard(spark, sf):
    """The guard on all rows, on each event type and on a few users' rows."""
    p = Params()
    ev = FX.read_table(spark, sf, "events")
    few = ev.where("user_id < 3").groupBy(F.concat(F.lit("user "), (F.col("user_id") % 3).cast("string")).alias("part")).count()
    parts = ev.groupBy(F.col("event_type").alias("part")).count().unionByName(ev.agg(F.count(F.lit(1)).alias("count")).withColumn("part", F.lit("all"))).unionByName(few)
    out = []
    for r in parts.collect():
        try:
            PL.training_guard(r["count"], p)
            refused = False
        except PL.TrainingDataError:
            refused = True
        out.append((r["part"], r["count"], PL.training_guard(r["count"], p, enforce=False), refused))
    return spark.createDataFrame(out, "part string, n_rows long, status string, refused boolean")


@register("ml_model_store", f"""{_FOREST}
select tree::int as tree_id, node::int as node_id, feature::int as feature, round(threshold, 6) as threshold, depth::int as depth, n::int as n, round((select cut_at from cut), 6) as offset from nodes""")
def q_ml_model_store(spark, sf):
    """The model as it comes back from the store."""
    m = trained_model(spark, sf, QP)
    path = scratch_path(spark, "model")
    PL.save_model(spark, m, path)
    back = PL.load_model(spark, path)
    return (spark.createDataFrame(back.nodes, FO.NODE_SCHEMA)
            .select("tree_id", "node_id", "feature", F.round("threshold", 6).alias("threshold"), "depth", "n", F.lit(round(float(back.offset), 6)).alias("offset")))


_INFER = f"""{_FOREST}, d as (select event_id, raw, raw < (select cut_at from cut) as is_anomaly from scores)
select event_id, round(raw, 6) as raw_score, is_anomaly, {OS.risk_sql('-raw')} as risk_level from d"""


@register("pipe_infer", _INFER)
def q_pipe_infer(spark, sf):
    m = trained_model(spark, sf, QP)
    path = scratch_path(spark, "model")
    PL.save_model(spark, m, path)
    return (PL.infer(spark, features_df(spark, sf), QP, model_path=path)
            .select("event_id", F.round("raw_score", 6).alias("raw_score"), "is_anomaly", "risk_level"))


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """The batch detection cycle, from log lines in text files to incidents with
    ATT&CK, actions and explanation."""
    apply_defaults(spark)
    p = Params(log_year=2024)
    m = trained_model(spark, sf, p)
    lines = FX.log_lines(spark, sf)
    paths = FX.write_sources(spark, lines, scratch_path(spark, "logs-cycle"))
    events = TL.ingest_all(spark, {s: paths[s] for s in ("auth_log", "audit_log")}, p.log_year)
    return PL.cycle(spark, events, m, p).incidents


@register("pipe_cycle_batch")
def q_pipe_cycle_batch(spark, sf):
    return flagship(spark, sf)


# ----------------------------------------------------------------- ATT&CK

_RULES = OS.rules_sql()


def _techs(df: DataFrame):
    return AT.technique_ids_from(df, QP)


@register("attack_rules", f"select event_id, {_RULES} as techniques from ({_FSQL}) f")
def q_attack_rules(spark, sf):
    f = features_df(spark, sf)
    return f.select("event_id", F.array_join(_techs(f), ",").alias("techniques"))


_TECH_ROWS = f"""with f as ({_FSQL}), r as (select event_id, {_RULES} as ids from f),
u as (select event_id, unnest(string_split(ids, ',')) as tid, generate_subscripts(string_split(ids, ','), 1) as pos from r where ids <> ''),
d as ({OS.dim_sql()}),
j as (select u.event_id, u.pos, d.* from u join d on d.technique_id = u.tid)"""


@register("attack_enrich", _TECH_ROWS + """
select event_id, string_agg(name, '|' order by pos) as technique_names, string_agg(tactic, '|' order by pos) as technique_tactics
from j group by event_id""")
def q_attack_enrich(spark, sf):
    f = features_df(spark, sf)
    t = AT.enrich(_techs(f))
    return (f.select("event_id", t.alias("t")).where(F.size("t") > 0)
            .select("event_id", F.array_join(F.transform("t", lambda x: x["name"]), "|").alias("technique_names"),
                    F.array_join(F.transform("t", lambda x: x["tactic"]), "|").alias("technique_tactics")))


@register("attack_tactics", _TECH_ROWS + """
select event_id, array_to_string(list_sort(list_distinct(list(tactic))), ',') as tactics from j group by event_id""")
def q_attack_tactics(spark, sf):
    f = features_df(spark, sf)
    t = AT.enrich(_techs(f))
    return (f.select("event_id", t.alias("t")).where(F.size("t") > 0)
            .select("event_id", F.array_join(AT.tactics(F.col("t")), ",").alias("tactics")))


@register("attack_dim", _TECH_ROWS + """
select d.technique_id, d.name, d.tactic, d.description, coalesce(h.hits, 0)::bigint as hits
from d left join (select technique_id, count(*) as hits from j group by technique_id) h using (technique_id)""")
def q_attack_dim(spark, sf):
    f = features_df(spark, sf)
    hits = (f.select(F.explode(_techs(f)).alias("technique_id")).groupBy("technique_id")
            .agg(F.count(F.lit(1)).alias("hits")))
    dim = AT.attack_dim(spark)
    return (dim.join(F.broadcast(hits), "technique_id", "left")
            .select("technique_id", "name", "tactic", "description",
                    F.coalesce("hits", F.lit(0)).cast("long").alias("hits")))


@register("attack_lookup", f"""with e as ({FX.auth_sql('duckdb')}), d as ({OS.dim_sql()})
select e.event_id, 'T' || cast(1100 + e.k as varchar) as lookup_id, d.name as technique_name, d.tactic as technique_tactic
from e left join d on d.technique_id = 'T' || cast(1100 + e.k as varchar)""")
def q_attack_lookup(spark, sf):
    e = FX.auth_events(spark, sf).select("event_id", F.concat(F.lit("T"), (F.lit(1100) + F.col("k")).cast("string")).alias("lookup_id"))
    return AT.attack_lookup(e, "lookup_id", AT.attack_dim(spark)).select(
        "event_id", "lookup_id", "technique_name", "technique_tactic")


# ----------------------------------------------------------------- response

def actions_df(spark, sf, p: Params = QP) -> DataFrame:
    return RS.decide(scored_df(spark, sf, p).where("is_anomaly"), p)


_ACTS = "with " + OS.actions_sql(_SCORED).strip()
_ACTS_REC = "with recursive " + OS.actions_sql(_SCORED).strip()


@register("resp_severity_at_least", f"""with l as (select event_id, {OS.risk_sql('anomaly_score')} as risk_level from ({_SCORED}) s),
o as (select *, case risk_level when 'NORMAL' then 1 when 'LOW' then 2 when 'MEDIUM' then 3 when 'HIGH' then 4 when 'CRITICAL' then 5 end as lv from l)
select event_id, risk_level, lv >= 3 as at_least_medium, lv >= 4 as at_least_high, lv >= 5 as at_least_critical,
  false as at_least_unknown from o""")
def q_resp_severity_at_least(spark, sf):
    s = scored_df(spark, sf)
    lvl = F.col("risk_level")
    return s.select("event_id", "risk_level", RS.severity_at_least(lvl, "MEDIUM").alias("at_least_medium"),
                    RS.severity_at_least(lvl, "HIGH").alias("at_least_high"),
                    RS.severity_at_least(lvl, "CRITICAL").alias("at_least_critical"),
                    RS.severity_at_least(lvl, "SEVERE").alias("at_least_unknown"))


@register("resp_decide", _ACTS + " select event_id, seq, action_type, target, reason, severity from acts")
def q_resp_decide(spark, sf):
    return actions_df(spark, sf).select("event_id", F.col("seq").cast("int").alias("seq"), "action_type", "target",
                                        "reason", "severity")


@register("resp_cooldown_param", _ACTS + """ select event_id, seq, action_type,
  case action_type when 'lock_account' then 300 when 'block_ip' then 600 when 'terminate_session' then 180 else 300 end::bigint as cooldown_seconds
  from acts""")
def q_resp_cooldown_param(spark, sf):
    a = actions_df(spark, sf)
    return a.select("event_id", F.col("seq").cast("int").alias("seq"), "action_type",
                    RS.cooldown_seconds(F.col("action_type"), QP).alias("cooldown_seconds"))


_QPX = QP.with_(enable_actions=True)


@register("resp_cooldown", _ACTS_REC + "," + OS.cooldown_sql(True).strip()
          + " select event_id, seq, action_type, target, allowed from cooled")
def q_resp_cooldown(spark, sf):
    a = RS.apply_cooldown(actions_df(spark, sf), _QPX)
    return a.select("event_id", F.col("seq").cast("int").alias("seq"), "action_type", "target", "allowed")


@register("resp_outcome", _ACTS_REC + "," + OS.cooldown_sql(False).strip() + "," + OS.outcome_sql().strip()
          + " select event_id, seq, status, status = 'executed' as success, result_message from outc")
def q_resp_outcome(spark, sf):
    o = RS.outcome(RS.apply_cooldown(actions_df(spark, sf), QP), QP)
    return o.select("event_id", F.col("seq").cast("int").alias("seq"), "status", "success", "result_message")


@register("resp_reversal_text", _ACTS_REC + "," + OS.cooldown_sql(True).strip() + "," + OS.outcome_sql().strip()
          + " select event_id, seq, status, result_message, reversal_command from outc")
def q_resp_reversal_text(spark, sf):
    o = RS.outcome(RS.apply_cooldown(actions_df(spark, sf, _QPX), _QPX), _QPX)
    return o.select("event_id", F.col("seq").cast("int").alias("seq"), "status", "result_message", "reversal_command")


@register("resp_audit_record", _ACTS_REC + "," + OS.cooldown_sql(False).strip() + "," + OS.outcome_sql().strip()
          + """ select event_id, seq, action_type, target, severity, true as success, result_message,
  'authlytics_engine' as executed_by, reversal_command, strftime(ts, '%Y-%m-%d') as date from outc where status = 'executed'""")
def q_resp_audit_record(spark, sf):
    o = RS.outcome(RS.apply_cooldown(actions_df(spark, sf), QP), QP)
    a = RS.audit_records(o)
    return a.select("action.event_id", F.col("action.seq").cast("int").alias("seq"), "action.action_type",
                    "action.target", "action.severity", "success", "result_message", "executed_by",
                    "reversal_command", F.date_format("date", "yyyy-MM-dd").alias("date"))


# ----------------------------------------------------------------- reports

def anomalies_df(spark, sf):
    return scored_df(spark, sf).where("is_anomaly")


def incidents_df(spark, sf):
    return RP.incidents(anomalies_df(spark, sf), QP)


_ANOM = f"select * from ({_SCORED}) s where is_anomaly"


@register("rep_incident_id", f"select event_id, {OS.incident_id_sql()} as incident_id from ({_ANOM}) a")
def q_rep_incident_id(spark, sf):
    return RP.incident_ids(anomalies_df(spark, sf)).select("event_id", "incident_id")


@register("rep_feature_subset", f"""select event_id, ip_failed_logins, ip_unique_users_attempted, ip_failed_to_success_ratio,
  user_new_ip_detected, user_first_sudo_usage, user_failed_sudo_attempts, session_login_to_privesc_seconds,
  session_lolbin_executed from ({_ANOM}) a""")
def q_rep_feature_subset(spark, sf):
    return anomalies_df(spark, sf).select("event_id", RP.feature_subset().alias("f")).select("event_id", "f.*")


@register("rep_kill_chain", f"""select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || ' ' || event_type || ': ' ||
  coalesce(source_ip, 'unknown') || ' -> ' || coalesce(username, 'unknown') as kill_chain from ({_ANOM}) a""")
def q_rep_kill_chain(spark, sf):
    a = anomalies_df(spark, sf)
    kc = RP.kill_chain(F.col("event_time"), F.col("event_type"), F.col("source_ip"), F.col("username"))
    return a.select("event_id", F.array_join(F.transform(kc, lambda e: F.concat_ws(" ", e["timestamp"], e["description"])), ";")
                    .alias("kill_chain"))


@register("rep_alert", f"""select {OS.incident_id_sql()} as incident_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') as timestamp,
  {OS.risk_sql('anomaly_score')} as severity, event_type, source_ip, username, anomaly_score,
  {OS.explanation_sql()} as explanation from ({_ANOM}) a""")
def q_rep_alert(spark, sf):
    al = RP.alerts(incidents_df(spark, sf))
    return al.withColumn("timestamp", F.date_format("timestamp", RP.ISO))


def _text_sql() -> str:
    eq, dash = "=" * 80, "-" * 80
    contrib = OS.contributions_list_sql()
    return f"""{_TECH_ROWS.replace('with f as (' + _FSQL + ')', 'with f as (' + _ANOM + ')')},
techs as (select event_id, string_agg('  - ' || technique_id || ': ' || name || ' (' || tactic || ')', chr(10) order by pos) as tl,
            array_to_string(list_sort(list_distinct(list(tactic))), ', ') as tac from j group by event_id),
a as (select src.*, {OS.incident_id_sql()} as incident_id, {OS.risk_sql('anomaly_score')} as severity,
        least(anomaly_score * 1.5, 1.0) as confidence, {OS.explanation_sql()} as explanation, {contrib} as c
      from f src)
select a.incident_id, concat_ws(chr(10),
  '{eq}', 'SECURITY INCIDENT REPORT', '{eq}', '',
  'Incident ID: ' || a.incident_id, 'Timestamp: ' || strftime(a.ts, '%Y-%m-%dT%H:%M:%S.%f'), 'Severity: ' || a.severity, '',
  'INCIDENT SUMMARY', '{dash}', 'Event Type: ' || a.event_type,
  case when coalesce(a.source_ip, '') <> '' then 'Source IP: ' || a.source_ip end,
  case when coalesce(a.username, '') <> '' then 'Target User: ' || a.username end,
  'Anomaly Score: ' || printf('%.3f', round(a.anomaly_score, 3)),
  'ML Confidence: ' || printf('%.1f%%', round(a.confidence * 100.0, 1)), '',
  'MITRE ATT&CK COVERAGE', '{dash}', 'Tactics: ' || coalesce(t.tac, ''), '', 'Techniques:', t.tl, '',
  'KILL CHAIN TIMELINE', '{dash}',
  '1. [' || strftime(a.ts, '%Y-%m-%dT%H:%M:%S.%f') || '] ' || a.event_type || ': ' || coalesce(a.source_ip, 'unknown') || ' -> ' || coalesce(a.username, 'unknown'),
  '', 'MACHINE LEARNING ANALYSIS', '{dash}', 'Explanation: ' || a.explanation, '', 'Contributing Features:',
  case when len(a.c) > 0 then array_to_string(list_transform(a.c, lambda x: '  - ' || x.name || ': ' || printf('%.3f', round(x.value, 3))), chr(10)) end,
  '', '{eq}') as text
from a left join techs t using (event_id)"""


@register("rep_text", _text_sql())
def q_rep_text(spark, sf):
    return incidents_df(spark, sf).select("incident_id", RP.text_report().alias("text"))


_INC_COLS = "incident_id, severity, event_type, source_ip, username, anomaly_score, confidence, explanation"
_INC_SQL = f"""select {OS.incident_id_sql()} as incident_id, strftime(ts, '%Y-%m-%d') as date, event_id,
  {OS.risk_sql('anomaly_score')} as severity, event_type, source_ip, username, anomaly_score,
  least(anomaly_score * 1.5, 1.0) as confidence, {OS.explanation_sql()} as explanation from ({_ANOM}) a"""
_INC_SCHEMA = ("incident_id string, severity string, event_type string, source_ip string, username string, anomaly_score double, "
               "confidence double, explanation string, mitre_techniques array<struct<id:string>>, mitre_tactics array<string>")
_INC_TECHS = f"""{_TECH_ROWS.replace('with f as (' + _FSQL + ')', 'with f as (' + _ANOM + ')')},
t as (select event_id, string_agg(technique_id, ',' order by pos) as techniques,
        array_to_string(list_sort(list_distinct(list(tactic))), ',') as tactics from j group by event_id),
i as ({_INC_SQL})
select {{}}, coalesce(techniques, '') as techniques, coalesce(tactics, '') as tactics from i left join t using (event_id)"""


def _inc_columns(df: DataFrame, *more: str) -> DataFrame:
    return df.select(*more, *_INC_COLS.split(", "), F.array_join(F.transform("mitre_techniques", lambda t: t["id"]), ",").alias("techniques"),
                     F.array_join("mitre_tactics", ",").alias("tactics"))


@register("rep_incident", _INC_TECHS.format("event_id, " + _INC_COLS))
def q_rep_incident(spark, sf):
    return _inc_columns(incidents_df(spark, sf), "event_id")


@register("rep_json", _INC_TECHS.format(_INC_COLS))
def q_rep_json(spark, sf):
    j = RP.report_json(incidents_df(spark, sf))
    return _inc_columns(j.select(F.from_json("json", _INC_SCHEMA).alias("j")).select("j.*"))


from ..sinks import files as SK  # noqa: E402


def _sink_roundtrip(spark, sf, fmt):
    root = scratch_path(spark, "reports")
    SK.save_reports(incidents_df(spark, sf), root, fmt)
    return root


@register("sink_report_json", _INC_TECHS.format("date, " + _INC_COLS))
def q_sink_report_json(spark, sf):
    back = spark.read.schema(_INC_SCHEMA + ", date string").json(_sink_roundtrip(spark, sf, "json") + "/json")
    return _inc_columns(back, "date")


@register("sink_report_text", f"select unnest(string_split(text, chr(10))) as value from ({_text_sql()}) t")
def q_sink_report_text(spark, sf):
    return spark.read.text(_sink_roundtrip(spark, sf, "text") + "/text").select("value")


@register("sink_report_format", f"""with d as (select date, count(*)::bigint as count from ({_INC_SQL}) i group by date)
select 'json' as format, * from d union all select 'text', * from d""")
def q_sink_report_format(spark, sf):
    root = _sink_roundtrip(spark, sf, "both")
    j = spark.read.schema("incident_id string, date string").json(root + "/json").select(F.lit("json").alias("format"), "date")
    t = spark.read.text(root + "/text").where(F.col("value").startswith("Incident ID: ")).select(F.lit("text").alias("format"), F.col("date").cast("string").alias("date"))
    return j.unionByName(t).groupBy("format", "date").count()


_ALERT_COLS = "incident_id, severity, event_type, source_ip, username, anomaly_score, explanation"


@register("sink_alert_jsonl", f"select {_ALERT_COLS} from ({_INC_SQL}) i union all select {_ALERT_COLS} from ({_INC_SQL}) i")
def q_sink_alert_jsonl(spark, sf):
    path = scratch_path(spark, "alerts")
    al = RP.alerts(incidents_df(spark, sf))
    SK.append_alerts(al, path)
    SK.append_alerts(al, path)  # append twice: the stream only grows
    return spark.read.schema(_ALERT_COLS.replace(",", " string,").replace("anomaly_score string", "anomaly_score double") + " string").json(path)


@register("sink_response_jsonl", _ACTS_REC + "," + OS.cooldown_sql(False).strip() + "," + OS.outcome_sql().strip()
          + """ select event_id, seq, action_type, target, severity, true as success, result_message,
  'authlytics_engine' as executed_by, reversal_command, strftime(ts, '%Y-%m-%d') as date from outc where status = 'executed'""")
def q_sink_response_jsonl(spark, sf):
    path = scratch_path(spark, "audit")
    o = RS.outcome(RS.apply_cooldown(actions_df(spark, sf), QP), QP)
    SK.append_audit(RS.audit_records(o), path)
    back = spark.read.schema("action struct<event_id:bigint,seq:int,action_type:string,target:string,severity:string>, success boolean, "
                             "result_message string, executed_by string, reversal_command string, date string").json(path)
    return back.select("action.*", "success", "result_message", "executed_by", "reversal_command", "date")


@register("ops_incident_count", f"select count(*)::bigint as incidents from ({_ANOM}) a")
def q_ops_incident_count(spark, sf):
    return SK.incident_count(spark, _sink_roundtrip(spark, sf, "json"))


# ----------------------------------------------------------------- ops tables

_MET = FX.metrics_sql()


def metrics_df(spark, sf):
    apply_defaults(spark)
    return FX.metrics(spark, sf)


def _stats_sql(where: str = "true") -> str:
    return f"""select component, count(*)::bigint as total_calls, round(sum(duration_ms), 6) as total_time_ms,
  min(duration_ms) as min_time_ms, max(duration_ms) as max_time_ms, count(*) filter (where not success)::bigint as errors,
  round(sum(duration_ms) / count(*), 6) as avg_time_ms, (count(*) - count(*) filter (where not success)) / count(*) as success_rate
  from ({_MET}) m where {where} group by component"""


def _stats_spark(df):
    return df.select("component", "total_calls", F.round("total_time_ms", 6).alias("total_time_ms"), "min_time_ms",
                     "max_time_ms", "errors", F.round("avg_time_ms", 6).alias("avg_time_ms"), "success_rate")


@register("ops_component_stats", _stats_sql())
def q_ops_component_stats(spark, sf):
    return _stats_spark(OP.component_stats(metrics_df(spark, sf)))


@register("ops_component_filter", _stats_sql("component = 'error'"))
def q_ops_component_filter(spark, sf):
    return _stats_spark(OP.component_filter(metrics_df(spark, sf), "error"))


@register("ops_top_bottlenecks", f"""select component, operation, duration_ms, strftime(timestamp, '%Y-%m-%dT%H:%M:%S.%f') as timestamp
  from ({_MET}) m where success order by duration_ms desc, timestamp, event_id limit 5""")
def q_ops_top_bottlenecks(spark, sf):
    return OP.top_bottlenecks(metrics_df(spark, sf)).withColumn("timestamp", F.date_format("timestamp", RP.ISO))


@register("ops_retention", f"""select event_id, component, duration_ms from ({_MET}) m
  where timestamp >= (select max(timestamp) from ({_MET}) x) - INTERVAL 3600 SECONDS""")
def q_ops_retention(spark, sf):
    return OP.retention(metrics_df(spark, sf), 3600).select("event_id", "component", "duration_ms")


@register("ops_latest_n", f"select event_id, component from ({_MET}) m order by timestamp desc, event_id desc limit 2500")
def q_ops_latest_n(spark, sf):
    return OP.latest_n(metrics_df(spark, sf), 2500).select("event_id", "component")


@register("ops_recommendations", f"""with s as (select component, count(*) as n, count(*) filter (where not success) as e,
    sum(duration_ms) / count(*) as avg_ms from ({_MET}) m group by component),
r as (select component, printf('Component ''%s'' has error rate %s%%. Review error logs for issues.', component,
        printf('%.1f', round((1.0 - (n - e) / n) * 100.0, 1))) as recommendation from s where (n - e) / n < 0.95
      union all select component, printf('Component ''%s'' has high latency (%sms avg). Consider optimization.', component,
        printf('%.0f', round(avg_ms, 0))) from s where avg_ms > 100)
select * from r union all select null, 'System performing normally.' where not exists (select 1 from r)""")
def q_ops_recommendations(spark, sf):
    return OP.recommendations(metrics_df(spark, sf))


def cycles_df(spark, sf):
    """Hourly detection cycles derived from the metrics view."""
    m = metrics_df(spark, sf)
    return (m.groupBy(F.date_trunc("hour", "timestamp").alias("cycle_id"))
            .agg(F.min("timestamp").alias("started_at"), F.max("timestamp").alias("ended_at"),
                 (F.count_if(~F.col("success")) > 0).alias("failed"),
                 F.count_if(F.col("duration_ms") > 100).alias("anomalies")))


@register("ops_cycle_stats", f"""with c as (select date_trunc('hour', timestamp) as cycle_id, min(timestamp) as started_at,
    max(timestamp) as ended_at, count(*) filter (where not success) > 0 as failed,
    count(*) filter (where duration_ms > 100) as anomalies from ({_MET}) m group by 1)
select count(*)::bigint as cycles_completed, count(*) filter (where failed)::bigint as cycles_failed,
  sum(anomalies)::bigint as anomalies_detected,
  (epoch(max(ended_at)) - epoch(min(started_at)))::bigint as uptime_seconds,
  (count(*) - count(*) filter (where failed)) / greatest(count(*), 1) as success_rate from c""")
def q_ops_cycle_stats(spark, sf):
    return OP.cycle_stats(cycles_df(spark, sf)).select(
        "cycles_completed", "cycles_failed", "anomalies_detected", F.col("uptime_seconds").cast("long").alias("uptime_seconds"),
        "success_rate")


@register("ops_recent_alerts", f"""select * from (select {OS.incident_id_sql()} as incident_id, ts,
  {OS.risk_sql('anomaly_score')} as severity, event_type from ({_ANOM}) a) q order by ts desc, incident_id desc limit 10""")
def q_ops_recent_alerts(spark, sf):
    al = RP.alerts(incidents_df(spark, sf))
    return OP.recent(al, 10).select("incident_id", F.col("timestamp").cast("timestamp_ntz").alias("ts"), "severity", "event_type")


# ----------------------------------------------------------------- streaming

from pyspark.sql import types as T  # noqa: E402

from ..streaming import stream as ST  # noqa: E402
from ..sources import tail as TL2  # noqa: E402
from ..streaming.state import state_partitions, streaming_features  # noqa: E402

N_SEGMENTS = 5


def land(rows: DataFrame, root: str) -> None:
    """Write ``rows`` below their segments, ``root/seg=i``, as files that all tasks share in."""
    rows.write.partitionBy("seg").parquet(root)


def write_segments(df: DataFrame, ts_col: str, root: str, n: int = N_SEGMENTS) -> str:
    """Land ``df`` as n time-ordered segments ``root/seg=i``. It is computed once."""
    stored = scratch_path(df.sparkSession, "unlanded")
    df.write.parquet(stored)
    df = df.sparkSession.read.schema(df.schema).parquet(stored)
    t = F.unix_micros(F.col(ts_col).cast("timestamp"))
    lo, hi = df.agg(F.min(t), F.max(t)).first()
    step = (hi - lo) // n + 1
    land(df.withColumn("seg", F.floor((t - F.lit(lo)) / F.lit(step)).cast("int")), root)
    return root


def arrivals(spark, sf, heartbeat_ip: str | None = None):
    """The events as files in five time-ordered segments, as they may come in: a seventh of
    them one segment late, lines that no pattern matches (stamped at ingest) among them,
    and at the end a heartbeat, whose stamp lets the last ones go. Copies of some events
    come three segments late, behind the watermark. Ids of all but the events are negative.
    Returns (schema, folder, seconds that a segment takes)."""
    ev = FX.auth_events(spark, sf).select(*ST.EVENT_COLS)
    t = F.unix_micros("event_time")
    lo, hi = ev.agg(F.min(t), F.max(t)).first()
    step = (hi - lo) // N_SEGMENTS + 1
    seg = F.floor((t - F.lit(lo)) / F.lit(step)).cast("int")
    last = F.lit(N_SEGMENTS)
    on_time = ev.withColumn("seg", F.least(seg + (F.col("event_id") % 7 == 3).cast("int"), last - 1))
    unmatched = ev.where("event_id % 50 = 0").withColumns({
        "event_id": -F.col("event_id") - 10, "event_time": F.current_timestamp(), "source_ip": F.lit(None).cast("string"), "username": F.lit(None).cast("string"),
        "auth_method": F.lit("unknown"), "event_type": F.lit("unknown"), "time_source": F.lit("ingest"), "seg": seg})
    too_late = ev.where((F.col("event_id") % 20 == 1) & (seg < N_SEGMENTS - 3)).withColumns({"event_id": -F.col("event_id") - 10, "seg": seg + 3})
    heartbeat = ev.limit(1).withColumns({
        "event_id": F.lit(-1).cast("long"), "event_time": F.timestamp_micros(F.lit(hi + 3 * step)), "source_ip": F.lit(heartbeat_ip).cast("string"),
        "username": F.lit(None).cast("string"), "seg": last})
    rows = on_time.unionByName(unmatched).unionByName(too_late).unionByName(heartbeat)
    root = scratch_path(spark, "arrivals")
    land(rows.repartition(spark.sparkContext.defaultParallelism), root)
    return ev.schema, root, step / 1e6


def _run_by_segment(spark, stream, out: str, ck: str, root: str, schema, n: int):
    """Runs ``stream`` over the first of ``n`` segments until it stops, and again on its
    checkpoint for each that has come since: a micro-batch takes all files of a segment."""
    for i in range(n):
        src = spark.readStream.format("parquet").schema(schema).load(f"{root}/seg=[0-{i}]")
        with state_partitions(spark):
            q = (stream(src).writeStream.format("parquet").option("path", out).option("checkpointLocation", ck)
                 .trigger(availableNow=True).start())
        q.awaitTermination()


@register("stream_features", f"select event_id, {', '.join(K.FEATURE_NAMES)} from ({_FSQL}) f")
def q_stream_features(spark, sf):
    """Streaming = batch, on keyed state: the events come as ``arrivals`` tells; the query is
    stopped after each segment and started again on its checkpoint."""
    apply_defaults(spark)
    schema, root, seconds = arrivals(spark, sf)
    out = scratch_path(spark, "stream-features")
    _run_by_segment(spark, lambda s: streaming_features(s, QP, lateness_seconds=seconds, in_order=True), out, scratch_path(spark, "ck-features"),
                    root, schema, N_SEGMENTS + 1)
    return _feature_select(spark.read.parquet(out).where("event_id >= 0"), list(K.FEATURE_NAMES))


def log_phases(spark, sf, n: int):
    """The log lines of two hosts a source (source, host, n, value), with the phase (from 0) in
    which they are written, by time."""
    ev = FX.auth_events(spark, sf)
    t = F.unix_micros("event_time")
    lo, hi = ev.agg(F.min(t), F.max(t)).first()
    phase = F.floor((t - F.lit(lo)) / F.lit((hi - lo) // n + 1)).cast("int")
    return ev.select("source", (F.col("event_id") % 2).alias("host"), F.struct(t, "event_id").alias("n"), F.col("raw_line").alias("value"), phase.alias("phase"))


@register("src_incremental", f"""select source, event_type, username, source_ip, source_port, auth_method, service, raw_line
  from ({OS.parsed_sql(f"select event_id * 10 as event_id, raw_line as value, source from ({FX.events_sql('duckdb')}) e")}) p""")
def q_src_incremental(spark, sf):
    """Growing log files followed by byte position: lines are appended in five phases, some
    left unfinished until the next; files are rotated twice, once while the query is
    stopped; a batch takes a seventh of the lines of a phase at most."""
    apply_defaults(spark)
    phases = log_phases(spark, sf, N_SEGMENTS)
    folder, out, ck = (scratch_path(spark, f"incremental-{x}") for x in ("logs", "out", "ck"))
    bound = max(1, phases.count() // (7 * N_SEGMENTS))
    q = None
    for i in range(N_SEGMENTS):
        patterns = FX.grow_logs(phases.where(F.col("phase") == i), folder, unfinished=i in (0, 2))
        if q is None:
            q = (parse_lines(TL2.tail_sources(spark, patterns, max_lines=bound), year=2024).writeStream.format("parquet")
                 .option("path", out).option("checkpointLocation", ck).trigger(processingTime="0 seconds").start())
        q.processAllAvailable()
        if i == 1:
            FX.rotate_logs(folder)
        if i == 3:
            q.stop()
            FX.rotate_logs(folder)
            q = None
    q.processAllAvailable()
    q.stop()
    return spark.read.parquet(out).select("source", "event_type", "username", "source_ip", "source_port",
                                          "auth_method", "service", "raw_line")


@register("stream_ip_window_agg", f"""with a as ({FX.auth_sql('duckdb')}),
w as (select a.*, date_trunc('minute', ts) - to_minutes(g.k) as ws from a, (select unnest(range(0, 5)) as k) g
      where a.source_ip is not null)
select epoch_us(ws) as window_start_us, source_ip, count(*)::bigint as events,
  sum(case when instr(event_type, 'failed') > 0 then 1 else 0 end)::bigint as failed,
  count(distinct username)::bigint as unique_users from w group by ws, source_ip""")
def q_stream_ip_window_agg(spark, sf):
    """Closed windows in append mode. The events come as ``arrivals`` tells: what is late
    within the watermark counts, what is behind it doesn't, and the heartbeat closes all
    windows but its own."""
    apply_defaults(spark)
    schema, root, seconds = arrivals(spark, sf, heartbeat_ip="0.0.0.0")
    out = scratch_path(spark, "win-out")
    _run_by_segment(spark, lambda s: ST.ip_window_counts(s, watermark=f"{int(seconds) + 1} seconds"), out, scratch_path(spark, "ck-win"),
                    root, schema, N_SEGMENTS + 1)
    return spark.read.parquet(out).select(
        F.unix_micros(F.col("w.start")).alias("window_start_us"), "source_ip",
        F.col("events").cast("long").alias("events"), F.col("failed").cast("long").alias("failed"),
        F.col("unique_users").cast("long").alias("unique_users"))


@register("stream_cooldown", _ACTS_REC + "," + OS.cooldown_sql(True).strip()
          + " select event_id, seq, action_type, target, allowed from cooled")
def q_stream_cooldown(spark, sf):
    """Cooldown on keyed state over five segments, stopped and started again after each."""
    apply_defaults(spark)
    acts = actions_df(spark, sf, _QPX).select("event_id", F.col("seq").cast("int").alias("seq"),
                                               "action_type", "target", "event_time")
    root = write_segments(acts, "event_time", scratch_path(spark, "landing-acts"))
    out = scratch_path(spark, "cool-out")
    _run_by_segment(spark, lambda s: ST.cooldown_stream(s, _QPX), out, scratch_path(spark, "ck-cool"), root, acts.schema, N_SEGMENTS)
    return spark.read.parquet(out).select("event_id", "seq", "action_type", "target", "allowed")


@register("stream_score", _INFER)
def q_stream_score(spark, sf):
    """The forest applied to streaming features: the same scores as the batch."""
    apply_defaults(spark)
    p = QP
    m = trained_model(spark, sf, p)
    schema, root, seconds = arrivals(spark, sf)
    out = scratch_path(spark, "score-out")
    _run_by_segment(spark, lambda s: PL.score_features(streaming_features(s, p, lateness_seconds=seconds, in_order=True), m, p), out,
                    scratch_path(spark, "ck-score"), root, schema, N_SEGMENTS + 1)
    return (spark.read.parquet(out).where("event_id >= 0")
            .select("event_id", F.round("raw_score", 6).alias("raw_score"), "is_anomaly", "risk_level"))


def _cycle_stream(spark, sf, trigger, n: int = 3):
    """Incidents of the streaming cycle over logs that grow in phases: one run a phase, or
    one that goes on and is held while a phase is written: the hosts' files grow one after the
    other, and lines of the later ones would be behind the watermark."""
    apply_defaults(spark)
    p = Params(log_year=2024)
    m = trained_model(spark, sf, p)
    phases = log_phases(spark, sf, n)
    folder, out = scratch_path(spark, "cycle-logs"), scratch_path(spark, "cycle-out")
    q = None
    for i in range(n):
        patterns = FX.grow_logs(phases.where(F.col("phase") == i), folder)
        if q is None:
            q = ST.detection_stream(spark, patterns, m, out, p, trigger=trigger, hold=FX.hold_file(folder))
        if "availableNow" in trigger:
            q.awaitTermination()
            q = None
        else:
            q.processAllAvailable()
    if q is not None:
        q.stop()
    return ST.committed(spark, out, "reports/json", schema=_INC_SCHEMA + ", date string").drop("date")


@register("pipe_cycle_once")
def q_pipe_cycle_once(spark, sf):
    return _cycle_stream(spark, sf, {"availableNow": True})


@register("pipe_monitor")
def q_pipe_monitor(spark, sf):
    return _cycle_stream(spark, sf, {"processingTime": "0 seconds"})
