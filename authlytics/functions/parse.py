"""Log line -> authentication event, as column expressions (no UDF).

The reference tries its patterns in a fixed order and keeps the first hit; that
precedence is one coalesce. Each regex is guarded by a literal it needs, so most lines
are classified without running a regex at all. Java regex semantics apply
(``\\w`` and ``\\d`` are ASCII; immaterial for syslog text).

``event_time`` is null when a matched line's stamp can't be read (such rows are
rejects, see ``features.rejects``); ``time_source`` tells ``line`` from ``ingest``
(lines without a stamp of their own).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import constants as K

AUTH_SOURCES = ("auth_log", "syslog")
AUDIT_SOURCE = "audit_log"

# kind codes
_FAILED, _SUCCESS, _INVALID, _SUDO_OK, _SUDO_FAIL, _UNKNOWN, _EXEC = 1, 2, 3, 4, 5, 6, 7

# Java's "." excludes \r and other line separators; (?d) makes \n the only
# terminator, as in the reference's Python patterns.
_UNIX = "(?d)"
_SEP = "\u0001"

# pattern -> (kind, number of capture groups, literal that every match holds)
_PATTERNS = (
    (K.RE_SSH_FAILED, _FAILED, 4, "Failed password for "),   # stamp, user, ip, port
    (K.RE_SSH_SUCCESS, _SUCCESS, 5, "ccepted "),             # stamp, method, user, ip, port
    (K.RE_SSH_INVALID, _INVALID, 4, "Invalid user "),        # stamp, user, ip, port
    (K.RE_SUDO_SUCCESS, _SUDO_OK, 6, " ; COMMAND="),         # stamp, user, tty, pwd, runas, command
    (K.RE_SUDO_FAILURE, _SUDO_FAIL, 2, "command not allowed"),  # stamp, user
)


def _replaced(v: Column, pattern: str, kind: int, n: int) -> Column:
    """'<kind>|g1|g2|..' from one anchored replace, or the line itself if nothing matches: the
    lazy prefix finds the leftmost match, exactly like a search, and the test and all
    groups come out of a single regex run."""
    rep = _SEP.join([str(kind), *(f"${i}" for i in range(1, n + 1))])
    return F.regexp_replace(v, f"{_UNIX}^.*?{pattern}.*$", rep)


def with_match(lines: DataFrame, value: Column, source: Column) -> DataFrame:
    """``lines`` with the winning pattern and its groups as one string ``_m``, null when
    the line yields no event. Patterns are tried in the reference's order; a "Disconnected"
    line matches its own pattern but yields no event there, so it falls
    through to the sudo tests and then to unknown. The cleaned line and the outcome of each
    pattern are columns of their own, read by the next projection more than once, so
    each is worked out once."""
    audit = source == F.lit(AUDIT_SOURCE)
    # the separator of the groups can't come from the line itself
    x = lines.withColumn("_v", F.translate(value, _SEP, ""))
    v = F.col("_v")
    tried = {f"_r{kind}": F.when(~audit & (F.instr(v, literal) > 0), _replaced(v, pattern, kind, n)) for pattern, kind, n, literal in _PATTERNS}
    tried["_rx"] = F.when(audit & (F.instr(v, "type=") > 0), _replaced(v, K.RE_AUDIT_EXECVE, _EXEC, 1))
    x = x.withColumns(tried)
    hits = F.coalesce(*[F.when(F.col(c) != v, F.col(c)) for c in tried if c != "_rx"], F.lit(str(_UNKNOWN)))
    found = F.when(v.rlike(r"^\s*$"), F.lit(None)).when(audit, F.when(F.col("_rx") != v, F.col("_rx"))).otherwise(hits)
    return x.withColumn("_m", found).drop("_v", *tried)


def syslog_time(stamp: Column, year: int | None, ingest: Column | None = None) -> Column:
    """'Jan  5 14:32:10' -> TIMESTAMP (null when unparsable) of the given year, or, for
    None, of the latest year that doesn't put the line over a day after its ingest."""
    norm = F.regexp_replace(stamp, " +", " ")

    def of(y: Column) -> Column:
        return F.try_to_timestamp(F.concat(y.cast("string"), F.lit(" "), norm), F.lit("yyyy MMM d HH:mm:ss"))

    if year is not None:
        return of(F.lit(year))
    this, last = of(F.year(ingest)), of(F.year(ingest) - 1)
    return F.when(this <= ingest + F.expr("interval 1 day"), this).otherwise(last)


def audit_time(v: Column) -> Column:
    epoch = F.regexp_extract(v, _UNIX + K.RE_AUDIT_EPOCH, 1)
    micros = (epoch.cast("decimal(24,6)") * F.lit(1000000)).cast("bigint")
    return F.when(epoch != "", F.timestamp_micros(micros))


def parse_lines(lines: DataFrame, year: int | None = 2024, value_col: str = "value",
                source_col: str = "source", ingest_col: str | None = "ingest_time") -> DataFrame:
    """Parse raw lines into events. Extra input columns are carried through.

    Output columns: event_time, time_source, host, source_ip, source_port, username,
    auth_method, event_type, service, message, raw_line (+ passthrough).
    Blank lines and audit lines that are not EXECVE records are dropped.
    The match is computed behind a generator, so the filter on it and the
    columns made from it read one result instead of repeating the CASE.
    """
    v = F.col(value_col)
    passthrough = [c for c in lines.columns if c not in (value_col, ingest_col)]
    ingest = (F.col(ingest_col) if ingest_col and ingest_col in lines.columns
              else F.current_timestamp())
    m = (with_match(lines, v, F.col(source_col)).withColumn("_g", F.explode(F.array(F.split("_m", _SEP))))
         .where(F.col("_g").isNotNull()))
    g = F.col("_g")
    kind = g[0].cast("int")
    ssh = kind.isin(_FAILED, _SUCCESS, _INVALID)
    stamp = F.when(kind.isin(_FAILED, _SUCCESS, _INVALID, _SUDO_OK, _SUDO_FAIL), g[1])
    ip = F.when(kind.isin(_FAILED, _INVALID), g[3]).when(kind == _SUCCESS, g[4])
    port = F.when(kind.isin(_FAILED, _INVALID), g[4]).when(kind == _SUCCESS, g[5])
    user = F.when(kind.isin(_FAILED, _INVALID, _SUDO_OK, _SUDO_FAIL), g[2]).when(kind == _SUCCESS, g[3])
    method = (F.when(kind.isin(_FAILED, _INVALID), F.lit("password"))
              .when(kind == _SUCCESS, g[2])
              .when(kind.isin(_SUDO_OK, _SUDO_FAIL), F.lit("sudo"))
              .when(kind == _EXEC, F.lit("exec"))
              .otherwise(F.lit("unknown")))
    etype = (F.when(kind == _FAILED, F.lit(K.EV_LOGIN_FAILED))
             .when(kind == _SUCCESS, F.lit(K.EV_LOGIN_SUCCESS))
             .when(kind == _INVALID, F.lit(K.EV_INVALID_USER))
             .when(kind == _SUDO_OK, F.lit(K.EV_SUDO_SUCCESS))
             .when(kind == _SUDO_FAIL, F.lit(K.EV_SUDO_FAILURE))
             .when(kind == _EXEC, F.lit(K.EV_PROCESS_EXEC))
             .otherwise(F.lit(K.EV_UNKNOWN)))
    service = (F.when(ssh, F.lit("sshd"))
               .when(kind.isin(_SUDO_OK, _SUDO_FAIL), F.lit("sudo"))
               .when(kind == _EXEC, F.lit("auditd"))
               .otherwise(F.lit("unknown")))
    message = F.when(kind == _EXEC, F.concat(F.lit("Executed: "), g[1])).otherwise(v)
    etime = (F.when(kind == _EXEC, audit_time(v))
             .when(kind == _UNKNOWN, ingest)
             .otherwise(syslog_time(stamp, year, ingest)))
    return m.select(
        *[F.col(c) for c in passthrough],
        etime.alias("event_time"),
        F.when(kind == _UNKNOWN, F.lit("ingest")).otherwise(F.lit("line")).alias("time_source"),
        F.lit("localhost").alias("host"),
        F.nullif(ip, F.lit("")).alias("source_ip"),
        port.try_cast("int").alias("source_port"),
        F.nullif(user, F.lit("")).alias("username"),
        method.alias("auth_method"),
        etype.alias("event_type"),
        service.alias("service"),
        message.alias("message"),
        v.alias("raw_line"),
    )


def event_to_json(events: DataFrame, key: str = "event_id") -> DataFrame:
    """Each event row as one JSON document (``to_json(struct(*))``)."""
    cols = [c for c in events.columns if c != key]
    return events.select(F.col(key), F.to_json(F.struct(*cols)).alias("json"))
