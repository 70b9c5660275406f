"""Adapter: the driver's ``events`` table read as authentication events.

The same SQL text feeds Spark (``selectExpr``) and the DuckDB oracle; only the
three dialect-specific expressions differ (JSON field, month name, clock).
Everything here is a per-row projection of ``events``, so its work grows with
the table.
"""

from __future__ import annotations

from itertools import groupby

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DIALECT = {
    "spark": {"K": "cast(get_json_object(props, '$.k') as int)",
              "MON": "date_format(ts, 'MMM')", "HMS": "date_format(ts, 'HH:mm:ss')",
              "EPOCH": "unix_seconds(cast(ts as timestamp))"},
    "duckdb": {"K": "cast(json_extract(props, '$.k') as int)",
               "MON": "strftime(ts, '%b')", "HMS": "strftime(ts, '%H:%M:%S')",
               "EPOCH": "epoch_us(ts) // 1000000"},
}

ET_EXPR = """case when event_type = 'error' then 'login_failed'
     when event_type = 'click' and event_id % 4 = 0 then 'invalid_user_attempt'
     when event_type = 'click' then 'login_failed'
     when event_type = 'view' then 'login_success'
     when event_type = 'signup' and event_id % 3 = 0 then 'sudo_failure'
     when event_type = 'signup' then 'sudo_success'
     else 'process_execution' end"""

AUTH_COLS = [
    "event_id", "ts", "k", "value", "et as event_type",
    "case when et like 'sudo%' or et = 'process_execution' then null "
    "else concat('10.0.0.', cast(k as string)) end as source_ip",
    "case when et = 'process_execution' then null else concat('user', cast(user_id as string)) end as username",
    "case when et like 'sudo%' then 'sudo' when et = 'process_execution' then 'exec' "
    "when et = 'login_success' and event_id % 2 = 0 then 'publickey' else 'password' end as auth_method",
]

EXE_EXPR = "case event_id % 4 when 0 then '/usr/bin/curl' when 1 then '/usr/sbin/logrotate' when 2 then '/bin/bash' else '/usr/lib/git-core/hook' end"
CMD_EXPR = ("case event_id % 6 when 0 then '/bin/systemctl restart nginx' when 1 then '/usr/sbin/useradd deploy' "
            "when 2 then '/bin/bash' when 3 then '/usr/bin/passwd root' when 4 then '/bin/cat /var/log/syslog' else '/usr/bin/tar cf /tmp/x' end")
LINE_EXPR = """concat({MON}, ' ', lpad(cast(day(ts) as string), 2, ' '), ' ', {HMS}, ' web1 ',
  case event_type
    when 'login_failed' then concat('sshd[', cast(event_id as string), ']: Failed password for ', username, ' from ', source_ip, ' port ', cast(40000 + k as string), ' ssh2')
    when 'invalid_user_attempt' then concat('sshd[', cast(event_id as string), ']: Invalid user ', username, ' from ', source_ip, ' port ', cast(40000 + k as string))
    when 'login_success' then concat('sshd[', cast(event_id as string), ']: Accepted ', auth_method, ' for ', username, ' from ', source_ip, ' port ', cast(40000 + k as string), ' ssh2')
    when 'sudo_success' then concat('sudo: ', username, ' : TTY=pts/0 ; PWD=/home/', username, ' ; USER=root ; COMMAND=', {CMD})
    when 'sudo_failure' then concat('sudo: ', username, ' : command not allowed ; TTY=pts/0 ; PWD=/tmp')
    else concat('audispd: type=EXECVE msg=audit(', cast({EPOCH} as string), '.179:', cast(event_id as string), '): argc=1 exe="', {EXE}, '"')
  end)"""

# message as the parser would produce it: the line, or "Executed: <exe>" for audit
MESSAGE_EXPR = f"case when event_type = 'process_execution' then concat('Executed: ', {EXE_EXPR}) else raw_line end"
SOURCE_EXPR = "case when event_type = 'process_execution' then 'audit_log' else 'auth_log' end"


def auth_sql(dialect: str = "duckdb") -> str:
    d = DIALECT[dialect]
    return (f"select {', '.join(AUTH_COLS)} from (select event_id, ts, user_id, {d['K']} as k, "
            f"{ET_EXPR} as et, value from events) q")


def events_sql(dialect: str = "duckdb") -> str:
    """auth + rendered line + message + source (one row per driver event)."""
    d = DIALECT[dialect]
    line = LINE_EXPR.format(**d, CMD=CMD_EXPR, EXE=EXE_EXPR)
    return (f"select *, {MESSAGE_EXPR} as message, {SOURCE_EXPR} as source from "
            f"(select *, {line} as raw_line from ({auth_sql(dialect)}) a) b")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def auth_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as typed authentication events (Spark side of ``events_sql``).

    Adds ``event_time`` (TIMESTAMP, session zone UTC) next to the driver's
    ``ts`` (TIMESTAMP_NTZ) and ``source_port``.
    """
    d = DIALECT["spark"]
    ev = read_table(spark, sf_dir, "events")
    a = (ev.selectExpr("event_id", "ts", "user_id", f"{d['K']} as k", f"{ET_EXPR} as et", "value")
           .selectExpr(*AUTH_COLS))
    b = a.selectExpr("*", f"{LINE_EXPR.format(**d, CMD=CMD_EXPR, EXE=EXE_EXPR)} as raw_line")
    return (b.selectExpr("*", f"{MESSAGE_EXPR} as message", f"{SOURCE_EXPR} as source")
             .withColumn("event_time", F.col("ts").cast("timestamp"))
             .withColumn("time_source", F.lit("line"))
             .withColumn("source_port", F.when(F.col("source_ip").isNotNull(), F.lit(40000) + F.col("k"))))


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rendered log lines: (event_id, value, source). Audit lines go to the
    audit source, all others to auth.log."""
    return auth_events(spark, sf_dir).select("event_id", F.col("raw_line").alias("value"), "source")


METRICS_COLS = [
    "event_type as component", "concat('user', cast(user_id as string)) as operation",
    "value as duration_ms", "ts as timestamp", "(event_id % 10 <> 0) as success",
    "case when event_id % 10 <> 0 then null else concat('error in ', event_type) end as error_msg",
    "event_id",
]


# Deterministic stand-in scores for the detection/response/report queries
# (no transcendental function, so both engines compute identical doubles).
SCORE_COLS = ["-(value / (value + 50.0)) as raw_score", "value / (value + 50.0) as score_fixture",
              "value >= 50.0 as anomaly_fixture"]


def metrics_sql() -> str:
    return f"select {', '.join(METRICS_COLS)} from events"


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events read as an operational metrics table."""
    return read_table(spark, sf_dir, "events").selectExpr(*METRICS_COLS)


# Extra lines derived per event, for the parser branches the rendered auth
# lines never reach: a disconnect line (matched, yields "unknown"), a line no
# pattern matches, a blank and a whitespace-only line, an audit record that is
# not EXECVE and an audit line without "type=" (both dropped). Line id =
# event_id * 10 + variant.
STAMP_EXPR = "concat({MON}, ' ', lpad(cast(day(ts) as string), 2, ' '), ' ', {HMS}, ' web1 ')"
EXTRA_VARIANTS = (
    (1, "auth_log", "case when source_ip is not null then concat({STAMP}, 'sshd[', cast(event_id as string), ']: Disconnected from ', source_ip, ' port ', cast(40000 + k as string)) end"),
    (2, "auth_log", "concat({STAMP}, 'CRON[', cast(event_id as string), ']: pam_unix(cron:session): session opened for user ', coalesce(username, 'root'))"),
    (3, "auth_log", "''"),
    (4, "syslog", "'   '"),
    (5, "audit_log", "concat('type=SYSCALL msg=audit(1704067807.179:', cast(event_id as string), '): arch=c000003e syscall=59 success=yes')"),
    (6, "audit_log", "concat({STAMP}, 'audispd: node=web1 msg=audit(1704067807.179:', cast(event_id as string), '): op=login')"),
)


def extra_lines_sql(dialect: str = "duckdb") -> str:
    d = DIALECT[dialect]
    stamp = STAMP_EXPR.format(**d)
    parts = [f"select event_id * 10 + {v} as event_id, {expr.format(STAMP=stamp)} as value, '{src}' as source from a"
             for v, src, expr in EXTRA_VARIANTS]
    return f"with a as ({auth_sql(dialect)}) select * from (" + " union all ".join(parts) + ") x where value is not null"


def _line_structs(d: dict, variants) -> str:
    stamp = STAMP_EXPR.format(**d)
    return ", ".join(
        f"named_struct('event_id', event_id * 10 + {v}, 'value', {expr.format(STAMP=stamp)}, 'source', {src})"
        for v, src, expr in variants)


def all_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rendered line (id = event_id * 10), a syslog mirror of the
    non-audit lines (rsyslog commonly writes auth events to both files), and
    the extra variants (id = event_id * 10 + variant), from one pass over
    ``events``. The lines come out of one ``inline`` (a generator), so each is
    computed once and the parser sees a plain column instead of the rendering
    expression inlined into every pattern test."""
    d = DIALECT["spark"]
    ev = read_table(spark, sf_dir, "events")
    a = (ev.selectExpr("event_id", "ts", "user_id", f"{d['K']} as k", f"{ET_EXPR} as et", "value")
           .selectExpr(*AUTH_COLS))
    line = "LINE"
    variants = ([(0, SOURCE_EXPR, line),
                 (0, "'syslog'", f"case when event_type <> 'process_execution' then {line} end")]
                + [(v, f"'{src}'", expr) for v, src, expr in EXTRA_VARIANTS])
    structs = _line_structs(d, variants).replace("LINE", LINE_EXPR.format(**d, CMD=CMD_EXPR, EXE=EXE_EXPR))
    out = a.selectExpr(f"inline(array({structs}))").where(F.col("value").isNotNull())
    # a small table arrives as one split; the rendered lines are spread before the
    # regex work
    return out.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def write_sources(spark: SparkSession, lines: DataFrame, root: str) -> dict[str, str]:
    """Write (value, source) lines as one text folder per source: source -> path."""
    lines.select("value", "source").write.partitionBy("source").text(root)
    return {s: f"{root}/source={s}" for s in ("auth_log", "syslog", "audit_log")}


def all_lines_sql(dialect: str = "duckdb") -> str:
    base = f"select event_id * 10 as event_id, raw_line as value, source from ({events_sql(dialect)}) e"
    return (f"select * from ({base}) b union all "
            f"select event_id, value, 'syslog' as source from ({base}) m where source <> 'audit_log' "
            f"union all select * from ({extra_lines_sql(dialect)}) x")


def hold_file(folder: str) -> str:
    """The file that holds the readers of ``folder`` while logs in it are appended to."""
    return f"{folder}/.appending"


def grow_logs(lines: DataFrame, folder: str, unfinished: bool = False) -> dict[str, str]:
    """Append (source, host, n, value) lines to one file per source and host, in the order of
    ``n``; returns source -> pattern of its files. ``unfinished``: the line end after the
    last line of each file comes with the next call. ``hold_file`` is there meanwhile."""
    def append(batches):
        from .tail import _open
        out, now = None, None
        for b in batches:
            values = iter(b["value"].to_pylist())
            for (source, host), of in groupby(zip(b["source"].to_pylist(), b["host"].to_pylist(), strict=True)):
                text = "\n".join([next(values) for _ in of]).encode()        # the batch's lines of one file
                fs, path = _open(f"{folder}/{source}-{host}.log")
                if path != now:
                    if out is not None:
                        finish(out)
                    info = fs.get_file_info(path)
                    tail = b"\n"
                    if info.size:
                        with fs.open_input_file(path) as f:
                            tail = f.read_at(1, info.size - 1)
                    out, now = fs.open_append_stream(path), path
                    out.write(b"" if tail == b"\n" else b"\n")
                    out.write(text)
                else:
                    out.write(b"\n" + text)
        if out is not None:
            finish(out)
        yield from ()

    def finish(out):
        if not unfinished:
            out.write(b"\n")
        out.close()

    from .tail import _open
    fs, path = _open(folder)
    fs.create_dir(path)
    _, held = _open(hold_file(folder))
    fs.open_output_stream(held).close()
    try:
        by_file = lines.repartition("source", "host").sortWithinPartitions("source", "host", "n").select("source", "host", "value")
        by_file.mapInArrow(append, "n long").write.format("noop").mode("overwrite").save()
    finally:
        fs.delete_file(held)
    return {s: f"{folder}/{s}-*.log*" for s in ("auth_log", "audit_log")}


def rotate_logs(folder: str) -> None:
    """Rename each log to its name with .1, as logrotate does (older ones move on)."""
    from .tail import _open
    fs, path = _open(folder)
    from pyarrow.fs import FileSelector
    for f in sorted(fs.get_file_info(FileSelector(path)), key=lambda f: f.base_name, reverse=True):
        base, number = (f.path, 0) if f.path.endswith(".log") else (f.path.rpartition(".")[0], int(f.extension))
        fs.move(f.path, f"{base}.{number + 1}")
