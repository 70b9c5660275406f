"""Behavioural window features per source IP, user and session.

Window: event ``e`` is in the window of time ``t`` when ``t - w < e.ts <= t``
(events with the same timestamp as ``t`` included).

Partitioning for scale
----------------------
A window partitioned by IP alone puts a hot IP (attack traffic is skewed by
nature) into one task. Every trailing-window feature here is computed on
``(key, time bucket)`` partitions instead; bucket length ``B >= w``, and each
event whose window influence crosses into the next bucket is replicated there
once (``explode`` before the exchange), so a partition holds all the history its
own events need. Replica rows never produce output.

Two exact evaluation methods share that layout:

* ``frame``  -- RANGE window frames. Spark re-aggregates the frame buffer per
  row, so cost grows with rows per window.
* ``delta`` (default) -- every event becomes an entry row (+1 at ``ts``) and an
  exit row (-1 at ``ts + w``); a running sum over the time order gives the
  window count. Distinct users / methods per IP use island merging: per
  (ip, user) the union of ``[ts, ts + w)`` intervals contributes +1 at the island
  start and -1 at its end. The earliest timestamp in the window is the
  successor of the last event that has left it. All frames are running
  (UNBOUNDED PRECEDING) frames, linear in rows however dense a window gets.

Unbounded per-user features (login-hour spread, "earlier sudo") use a two-level
prefix: per (user, bucket) partial sums, an exclusive running sum over the small
per-user bucket table, joined back on (user, bucket) -- the key the user side is
already partitioned by. First sighting of (user, ip) uses one marker row per
pair, created by a map-side-combined aggregate and placed in the bucket of the
first sighting.

Exchanges of the event rows: one on (ip, bucket), one on (user, bucket).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import constants as K
from ..params import Params
from ..session import cut_lineage
from . import blocks as BL

FEATURE_COLUMNS = list(K.FEATURE_NAMES)

_LOLBIN_ANY = "(" + "|".join(K.LOLBINS) + ")"
_ACCOUNT_RE = "(" + "|".join(K.ACCOUNT_CHANGE_COMMANDS) + ")"


def _micros(p: Params) -> tuple[int, int]:
    return int(round(p.window_seconds * 1e6)), int(round(p.bucket_seconds * 1e6))


# ------------------------------------------------------------------ per row

def lolbin_expr(message: Column, compat: bool) -> Column:
    """compat: any of the 26 names as a substring of the lower-cased message
    (so ``sh`` hits every ``sshd`` line); intended: the basename of the executed
    command (``COMMAND=...`` of sudo, ``Executed: ...`` of audit) is one of them."""
    m = F.coalesce(message, F.lit(""))
    if compat:
        return F.lower(m).rlike(_LOLBIN_ANY)
    cmd = F.coalesce(
        F.nullif(F.regexp_extract(m, r"COMMAND=(\S+)", 1), F.lit("")),
        F.nullif(F.regexp_extract(m, r"^Executed: (\S+)", 1), F.lit("")))
    base = F.regexp_extract(cmd, r"([^/]+)$", 1)
    return F.coalesce(base.isin(*K.LOLBINS), F.lit(False))


def account_change_expr(message: Column) -> Column:
    return F.coalesce(F.coalesce(message, F.lit("")).rlike(_ACCOUNT_RE), F.lit(False))


def reference_event_id(ip: Column, user: Column, tus: Column) -> Column:
    """``ip_user_epochseconds`` with 'unknown' for missing parts (not unique)."""
    secs = (tus.cast("decimal(20,0)") / F.lit(1000000)).cast("decimal(20,6)").cast("string")
    return F.concat_ws("_", F.coalesce(ip, F.lit("unknown")), F.coalesce(user, F.lit("unknown")), secs)


def prepare(events: DataFrame, p: Params, carry=()) -> DataFrame:
    """Typed, null-normalised event rows with the per-row flags."""
    W, B = _micros(p)
    hist = "coalesce(_hist, false)" if "_hist" in events.columns else "false"
    exprs = [
        "cast(event_id as bigint) as event_id",
        "cast(event_time as timestamp) as event_time",
        "nullif(source_ip, '') as ip",
        "nullif(username, '') as user",
        "auth_method", "event_type", "message",
        "unix_micros(cast(event_time as timestamp)) as tus",
        "cast(instr(event_type, 'failed') > 0 as int) as is_failed",
        f"event_type = '{K.EV_LOGIN_SUCCESS}' as is_login",
        # minute of the day: integer sums, so the spread doesn't depend on their order
        f"case when event_type = '{K.EV_LOGIN_SUCCESS}' then cast(hour(cast(event_time as timestamp)) * 60 "
        f"+ minute(cast(event_time as timestamp)) as bigint) end as login_h",
        "cast(instr(event_type, 'sudo') > 0 as int) as is_sudoish",
        f"cast(event_type = '{K.EV_SUDO_FAILURE}' as int) as is_sudo_fail",
        f"event_type = '{K.EV_SUDO_SUCCESS}' as is_sudo_ok",
        f"cast(event_type in ('{K.EV_SUDO_SUCCESS}', '{K.EV_PROCESS_EXEC}') as int) as is_cmd",
        f"{hist} as hist",
    ]
    return (events.select(
        *[F.expr(e) for e in exprs],
        account_change_expr(F.col("message")).cast("int").alias("is_acct"),
        lolbin_expr(F.col("message"), p.compat).alias("session_lolbin_executed"),
        *[F.col(c) for c in carry],
    ).withColumn("bkt", F.expr(f"(tus - pmod(tus, {B})) div {B}")))


def _with_replicas(df: DataFrame, W: int, B: int) -> DataFrame:
    """Home row in its bucket, plus one replica in the next bucket when the
    event's window influence [ts, ts + w) crosses the bucket end. The payload ``_p``
    rides on rows that produce output only."""
    crosses = F.col("tus") + F.lit(W) > (F.col("bkt") + 1) * F.lit(B)
    others = [c for c in df.columns if c != "bkt"]
    x = df.select(*others, F.col("bkt").alias("_home_bkt"),
                  F.explode(F.when(crosses, F.array(F.col("bkt"), F.col("bkt") + 1))
                            .otherwise(F.array(F.col("bkt")))).alias("bkt"))
    home = F.col("bkt") == F.col("_home_bkt")
    # only home rows of new (non-history) events produce output
    emit = home & ~F.col("hist")
    return x.select(*[F.when(emit, F.col(c)).alias(c) if c == "_p" else c for c in others],
                    "bkt", home.alias("home"), emit.alias("emit"))


# ------------------------------------------------------------------ IP side

def _first_sightings(base: DataFrame, seen_pairs: DataFrame | None = None) -> DataFrame:
    """The first sighting (time and event) of each (ip, user) pair.
    A map-side-combined aggregate: a hot pair costs one partial row per task.
    ``seen_pairs`` (ip, user): pairs known from earlier micro-batches."""
    first = (base.where(F.col("ip").isNotNull() & F.col("user").isNotNull() & ~F.col("hist"))
             .groupBy("ip", "user").agg(F.min(F.struct("tus", "event_id")).alias("f")))
    if seen_pairs is not None:
        first = first.join(seen_pairs.select("ip", "user"), ["ip", "user"], "left_anti")
    return first.select("ip", "user", F.col("f.tus").alias("_ftus"), F.col("f.event_id").alias("_fid"))


def _ip_deltas(x: DataFrame, W: int, B: int) -> DataFrame:
    """Entry, exit and output rows of events that know their neighbours (``prev_*``, ``next_*``)."""
    # entry (+1 at ts), exit (-1 at ts + w), output marker; island starts
    # and ends of (ip, user) and (ip, method) give the distinct counts
    start_u = f"(user is not null and (prev_u is null or tus - prev_u >= {W}))"
    end_u = f"(user is not null and (next_u is null or next_u - tus >= {W}))"
    start_m = f"(prev_m is null or tus - prev_m >= {W})"
    end_m = f"(next_m is null or next_m - tus >= {W})"

    def ev(time, kind, dn, df_, du, dm, nxt):
        return (f"named_struct('time', {time}, 'kind', {kind}, 'dn', cast({dn} as bigint), "
                f"'df', cast({df_} as bigint), 'du', cast({du} as bigint), 'dm', cast({dm} as bigint), "
                f"'nxt', cast({nxt} as bigint))")
    entry = ev("tus", 1, 1, "is_failed", f"cast({start_u} as int)", f"cast({start_m} as int)", "null")
    exit_ = ev(f"tus + {W}", 0, -1, "-is_failed", f"-cast({end_u} as int)", f"-cast({end_m} as int)", "next_any")
    mark = ev("tus", 2, 0, 0, 0, 0, "null")
    arr = F.expr(f"if(emit, array({entry}, {exit_}, {mark}), array({entry}, {exit_}))")
    # the payload rides on the output row only
    payload = F.when(F.col("d.kind") == 2, F.col("_p")).alias("_p")
    y = (x.select("ip", "bkt", "event_id", "new_ip", "_p", F.explode(arr).alias("d"))
          .select("ip", "bkt", "event_id", "new_ip", payload, "d.*")
          # exits past the bucket end cannot reach any output row of this bucket
          .where(F.col("time") < (F.col("bkt") + 1) * F.lit(B)))
    return y


def _ip_side(prep: DataFrame, p: Params, seen_pairs: DataFrame | None = None, hot: DataFrame | None = None) -> DataFrame:
    """IP features for events that have an IP. Returns one row per event with
    the passthrough struct ``_p`` unpacked. ``hot`` (ip, bkt, n_blk): buckets to be
    worked on in blocks."""
    W, B = _micros(p)
    rows = prep.where(F.col("ip").isNotNull())
    passthrough = F.struct(*[c for c in prep.columns if c not in ("ip", "bkt", "tus", "event_id")])
    rows = rows.select("ip", "bkt", "tus", "event_id", "user", "auth_method", "is_failed", "hist",
                       passthrough.alias("_p"))
    rows = _with_replicas(rows, W, B)
    firsts = _first_sightings(prep, seen_pairs)
    if hot is not None:
        return (_ip_side_rows(rows.join(hot, ["ip", "bkt"], "left_anti"), firsts, p)
                .unionByName(_ip_side_hot(rows.join(hot, ["ip", "bkt"]), firsts, W, B)))
    return _ip_side_rows(rows, firsts, p)


def _ip_side_hot(rows: DataFrame, firsts: DataFrame, W: int, B: int) -> DataFrame:
    """The same for hot buckets: neighbours and running totals over blocks."""
    x = BL.in_blocks(rows, "tus", B).withColumns({"mkey": F.coalesce("auth_method", F.lit("\u0000")), "ukey": F.coalesce("user", F.lit("\u0000"))})
    x = x.join(firsts.select(F.col("_fid").alias("event_id"), F.lit(True).alias("_first")), "event_id", "left")
    x = BL.stored(x.withColumn("new_ip", F.col("emit") & F.coalesce("_first", F.lit(False))).drop("_first"))
    for keys, before, after in ((["ip", "bkt", "ukey"], "prev_u", "next_u"), (["ip", "bkt", "mkey"], "prev_m", "next_m"), (["ip", "bkt"], "prev_any", "next_any")):
        x = BL.stored(BL.neighbours(x, keys, before, after))
    y = _ip_deltas(x, W, B).join(rows.select("ip", "bkt", "n_blk").distinct(), ["ip", "bkt"])
    y = BL.running(BL.stored(BL.in_blocks(y, "time", B)), ["ip", "bkt"], ["time", "kind", "event_id"],
                   sums={"n": F.col("dn"), "f": F.col("df"), "u": F.col("du"), "m": F.col("dm")},
                   lasts={"left": F.col("nxt")}, least={"start": F.when(F.col("kind") == 1, F.col("time"))})
    out = y.where(F.col("kind") == 2).select("ip", "event_id", F.col("time").alias("tus"), "kind", "new_ip", "_p", "n", "f", "u", "m",
                                            F.coalesce("left", "start").alias("t_min"))
    return _ip_output(out)


def _ip_side_rows(rows: DataFrame, firsts: DataFrame, p: Params) -> DataFrame:
    W, B = _micros(p)
    rows = rows.withColumn("is_marker", F.lit(False))
    markers = (firsts
               .select("ip", "user",
                       F.expr(f"(_ftus - pmod(_ftus, {B})) div {B}").alias("bkt"),
                       F.lit(True).alias("is_marker"), F.lit(False).alias("home")))
    x = rows.unionByName(markers, allowMissingColumns=True)
    # one exchange on (ip, bkt); every window below is a finer partitioning of it
    x = x.repartition("ip", "bkt")

    w_u = Window.partitionBy("ip", "bkt", "user").orderBy(F.col("tus").asc_nulls_first(),
                                                          F.col("event_id").asc_nulls_first())
    x = (x.withColumns({"prev_u": F.lag("tus").over(w_u), "next_u": F.lead("tus").over(w_u),
                        "after_marker": F.lag("is_marker").over(w_u)})
          .where(~F.col("is_marker"))
          .withColumn("new_ip", F.col("emit") & F.col("user").isNotNull()
                      & F.coalesce(F.col("after_marker"), F.lit(False))))

    if p.window_method == "frame":
        wf = (Window.partitionBy("ip", "bkt").orderBy("tus").rangeBetween(-(W - 1), 0))
        mkey = F.coalesce(F.col("auth_method"), F.lit("\u0000"))
        out = (x.select(
            "ip", "event_id", "tus", "emit", "new_ip", "_p",
            F.count(F.lit(1)).over(wf).alias("n"),
            F.sum("is_failed").over(wf).alias("f"),
            F.size(F.collect_set("user").over(wf)).cast("long").alias("u"),
            F.size(F.collect_set(mkey).over(wf)).cast("long").alias("m"),
            F.min("tus").over(wf).alias("t_min"))
            .where("emit"))
    else:
        x = x.withColumn("mkey", F.coalesce(F.col("auth_method"), F.lit("\u0000")))
        w_m = Window.partitionBy("ip", "bkt", "mkey").orderBy("tus", "event_id")
        w_0 = Window.partitionBy("ip", "bkt").orderBy("tus", "event_id")
        x = x.withColumns({"prev_m": F.lag("tus").over(w_m), "next_m": F.lead("tus").over(w_m),
                           "next_any": F.lead("tus").over(w_0)})
        y = _ip_deltas(x, W, B)
        wr = (Window.partitionBy("ip", "bkt").orderBy("time", "kind", "event_id")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
        out = (y.select(
            "ip", "event_id", F.col("time").alias("tus"), "kind", "new_ip", "_p",
            F.sum("dn").over(wr).alias("n"), F.sum("df").over(wr).alias("f"),
            F.sum("du").over(wr).alias("u"), F.sum("dm").over(wr).alias("m"),
            F.coalesce(F.last("nxt", ignorenulls=True).over(wr),
                       F.min(F.when(F.col("kind") == 1, F.col("time"))).over(wr)).alias("t_min"))
            .where(F.col("kind") == 2))

    return _ip_output(out)


def _ip_output(out: DataFrame) -> DataFrame:
    return out.select("event_id", "tus", "ip", "_p.*", *[c.alias(name) for name, c in ip_measures().items()],
                      F.col("new_ip").alias("user_new_ip_detected"))


def ip_measures() -> dict[str, Column]:
    """The IP features from what a window holds at an event: ``n`` events, ``f`` failed, ``u``
    users, ``m`` methods and the earliest time ``t_min``."""
    n = F.col("n")
    gap = F.when(n >= 2, (F.col("tus") - F.col("t_min")) / F.lit(1e6) / (n - 1)).otherwise(F.lit(0.0))
    return {
        "ip_window_events": n.cast("long"),
        "ip_failed_logins": F.col("f").cast("long"),
        "ip_unique_users_attempted": F.col("u").cast("long"),
        "ip_failed_to_success_ratio": (F.col("f") / n).cast("double"),
        "ip_avg_inter_attempt_seconds": gap.cast("double"),
        "ip_auth_method_variance": (F.col("m") / n).cast("double"),
    }


def _no_ip_rows(prep: DataFrame) -> DataFrame:
    return prep.where(F.col("ip").isNull()).select(
        *[c for c in prep.columns if c != "bkt"],
        F.lit(0).cast("long").alias("ip_window_events"),
        F.lit(0).cast("long").alias("ip_failed_logins"),
        F.lit(0).cast("long").alias("ip_unique_users_attempted"),
        F.lit(0.0).alias("ip_failed_to_success_ratio"),
        F.lit(0.0).alias("ip_avg_inter_attempt_seconds"),
        F.lit(0.0).alias("ip_auth_method_variance"),
        F.lit(False).alias("user_new_ip_detected"))


# ------------------------------------------------------------------ user side

def _user_prefix(prep: DataFrame, B: int, user_base: DataFrame | None = None) -> DataFrame:
    """Exclusive running totals over earlier buckets of each user (small
    table). ``user_base`` (user, sudo, ln, ls, lss): totals carried from
    earlier micro-batches, added to every bucket of the user."""
    agg = (prep.where(F.col("user").isNotNull() & ~F.col("hist"))
           .groupBy("user", "bkt").agg(
               F.sum("is_sudoish").cast("long").alias("b_sudo"),
               F.count("login_h").alias("b_ln"),
               F.sum("login_h").alias("b_ls"),
               F.sum(F.col("login_h") * F.col("login_h")).alias("b_lss")))
    wp = Window.partitionBy("user").orderBy("bkt").rowsBetween(Window.unboundedPreceding, -1)
    out = agg.select(
        "user", "bkt",
        *[F.coalesce(F.sum(c).over(wp), F.lit(0)).alias("base_" + c[2:])
          for c in ("b_sudo", "b_ln", "b_ls", "b_lss")])
    if user_base is not None:
        ub = user_base.select("user", *[F.col(c).alias("_u_" + c) for c in ("sudo", "ln", "ls", "lss")])
        out = out.join(ub, "user", "left")
        for c in ("sudo", "ln", "ls", "lss"):
            out = out.withColumn("base_" + c, F.col("base_" + c) + F.coalesce(F.col("_u_" + c), F.lit(0)))
        out = out.drop(*["_u_" + c for c in ("sudo", "ln", "ls", "lss")])
    return out


def _user_rows(rows: DataFrame) -> DataFrame:
    rows = rows.drop("emit", "home")
    rows = rows.withColumn("ukey", F.coalesce(F.col("user"), F.concat(F.lit("\u0001"), F.col("event_id").cast("string"))))
    keep = ["ukey", "user", "bkt", "tus", "event_id", "is_login", "login_h", "is_sudoish", "is_sudo_fail",
            "is_sudo_ok", "is_cmd", "is_acct", "hist"]
    passthrough = F.struct(*[c for c in rows.columns if c not in ("bkt", "tus", "event_id", "user", "ukey")])
    x = rows.select(*keep, passthrough.alias("_p"))
    return x


def _user_deltas(x: DataFrame, carry: list[str], W: int, B: int) -> DataFrame:
    """Entry, exit and output rows of a user's events; the payload is the last of ``carry``."""
    def ev(time, kind, sub, dn, dfs, dac, dcmd, login_t):
        return (f"named_struct('time', {time}, 'kind', {kind}, 'sub', cast({sub} as int), "
                f"'dun', cast({dn} as bigint), 'dfs', cast({dfs} as bigint), 'dac', cast({dac} as bigint), "
                f"'dcmd', cast({dcmd} as bigint), 'login_t', cast({login_t} as bigint))")
    entry = ev("tus", 1, "is_login", 1, "is_sudo_fail", "is_acct", "is_cmd", "if(is_login, tus, null)")
    exit_ = ev(f"tus + {W}", 0, 0, -1, "-is_sudo_fail", "-is_acct", 0, "null")
    mark = ev("tus", 2, 0, 0, 0, 0, 0, "null")
    arr = F.expr(f"if(emit, array({entry}, {exit_}, {mark}), array({entry}, {exit_}))")
    payload = F.when(F.col("d.kind") == 2, F.col("_p")).alias("_p")
    y = (x.select("ukey", "user", "bkt", *carry, F.explode(arr).alias("d"))
          .select("ukey", "user", "bkt", *carry[:-1], payload, "d.*")
          .where(F.col("time") < (F.col("bkt") + 1) * F.lit(B)))
    return y


def _user_side_hot(x: DataFrame, prefix: DataFrame, p: Params) -> DataFrame:
    """User features of hot buckets (with n_blk): running totals over blocks."""
    W, B = _micros(p)
    blocks = x.select("ukey", "bkt", "n_blk").distinct()
    x = BL.stored(BL.in_blocks(x, "tus", B))
    hl, keys = F.when(F.col("emit"), F.col("login_h")), ["ukey", "bkt"]
    own = F.when(F.col("emit"), F.col("is_sudoish")).otherwise(0)
    x = BL.running(x, keys, ["tus", "event_id"], sums={"sudo_upto": own, "ln": hl.isNotNull().cast("long"), "ls": F.coalesce(hl, F.lit(0)),
                                                       "lss": F.coalesce(hl * hl, F.lit(0))})
    x = x.withColumn("sudo_before", F.col("sudo_upto") - own).drop("sudo_upto", "blk", "n_blk")
    y = _user_deltas(x, ["event_id", "emit", "is_sudo_ok", "sudo_before", "ln", "ls", "lss", "_p"], W, B).join(blocks, keys)
    order = ["time", "kind", "sub", "event_id"]
    y = BL.running(BL.stored(BL.in_blocks(y, "time", B)), keys, order, most={"last_login": F.col("login_t")},
                   sums={"un": F.col("dun"), "fs": F.col("dfs"), "ac": F.col("dac"), "R": F.col("dcmd")})
    y = BL.running(BL.stored(y), keys, order, lasts={"RL": F.when(F.col("login_t").isNotNull(), F.col("R"))})
    return _user_output(y.where(F.col("kind") == 2).withColumnRenamed("time", "tus"), prefix, p)


def _user_side(rows: DataFrame, prefix: DataFrame, p: Params, hot: DataFrame | None = None) -> DataFrame:
    """User features. Rows without a user are keyed by their own event id
    (a singleton key each: spread evenly, never one giant null partition) and
    get zero user features at the end. ``hot`` (user, bkt, n_blk): buckets to be
    worked on in blocks."""
    W, B = _micros(p)
    x = _with_replicas(_user_rows(rows), W, B)
    if hot is not None:
        hot = hot.withColumnRenamed("user", "ukey")
        return (_user_side_rows(x.join(hot, ["ukey", "bkt"], "left_anti"), prefix, p)
                .unionByName(_user_side_hot(x.join(hot, ["ukey", "bkt"]), prefix, p)))
    return _user_side_rows(x, prefix, p)


def _user_side_rows(x: DataFrame, prefix: DataFrame, p: Params) -> DataFrame:
    W, B = _micros(p)
    x = x.repartition("ukey", "bkt")

    w1 = Window.partitionBy("ukey", "bkt").orderBy("tus", "event_id")
    before = w1.rowsBetween(Window.unboundedPreceding, -1)
    upto = w1.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hl = F.when(F.col("emit"), F.col("login_h"))
    x = x.withColumns({
        "sudo_before": F.coalesce(F.sum(F.when(F.col("emit"), F.col("is_sudoish"))).over(before), F.lit(0)),
        "ln": F.count(hl).over(upto),
        "ls": F.coalesce(F.sum(hl).over(upto), F.lit(0)),
        "lss": F.coalesce(F.sum(hl * hl).over(upto), F.lit(0))})

    carry = ["event_id", "emit", "is_sudo_ok", "sudo_before", "ln", "ls", "lss", "_p"]
    if p.window_method == "frame":
        wf = Window.partitionBy("ukey", "bkt").orderBy("tus").rangeBetween(-(W - 1), 0)
        wrun = Window.partitionBy("ukey", "bkt").orderBy("tus").rangeBetween(Window.unboundedPreceding, 0)
        x = x.withColumn("R", F.sum("is_cmd").over(wrun))
        out = (x.select(
            "ukey", "user", "bkt", "tus", *carry,
            F.count(F.lit(1)).over(wf).alias("un"),
            F.sum("is_sudo_fail").over(wf).alias("fs"),
            F.sum("is_acct").over(wf).alias("ac"),
            F.max(F.when(F.col("is_login"), F.col("tus"))).over(wf).alias("last_login"),
            F.col("R"),
            F.max(F.when(F.col("is_login"), F.col("R"))).over(wf).alias("RL"))
            .where("emit"))
    else:
        y = _user_deltas(x, carry, W, B)
        # commands sort before a login at the same instant: R at a login row
        # counts every command up to and including that instant
        wr = (Window.partitionBy("ukey", "bkt").orderBy("time", "kind", "sub", "event_id")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
        y = y.withColumns({"un": F.sum("dun").over(wr), "fs": F.sum("dfs").over(wr),
                           "ac": F.sum("dac").over(wr), "last_login": F.max("login_t").over(wr),
                           "R": F.sum("dcmd").over(wr)})
        y = y.withColumn("RL", F.last(F.when(F.col("login_t").isNotNull(), F.col("R")), ignorenulls=True).over(wr))
        out = y.where(F.col("kind") == 2).withColumnRenamed("time", "tus")

    return _user_output(out, prefix, p)


def _user_output(out: DataFrame, prefix: DataFrame, p: Params) -> DataFrame:
    out = out.join(prefix, ["user", "bkt"], "left")
    total = {c: F.coalesce(F.col("base_" + c), F.lit(0)) + F.col(own)
             for c, own in (("sudo", "sudo_before"), ("ln", "ln"), ("ls", "ls"), ("lss", "lss"))}
    out = out.withColumns({"all_" + c: x for c, x in total.items()})
    return out.select("event_id", "tus", "user", "_p.*", *user_measures(p))


def user_measures(p: Params) -> list[Column]:
    """The user and session features from what is known at an event: in the window ``un``
    events, ``fs`` failed sudo, ``ac`` account changes, the ``last_login`` and the commands
    up to now ``R`` and up to that login ``RL``; over all time the earlier sudo events
    ``all_sudo`` and the count, sum and sum of squares of login minutes ``all_l*``."""
    W, _ = _micros(p)
    t, ll = F.col("tus"), F.col("last_login")
    in_win = ll.isNotNull() & (ll > t - F.lit(W))
    n, s, ss = F.col("all_ln"), F.col("all_ls"), F.col("all_lss")
    wide = "decimal(38,0)"
    spread = (n.cast("decimal(18,0)") * ss.cast("decimal(18,0)")).cast(wide) - (s.cast("decimal(18,0)") * s.cast("decimal(18,0)")).cast(wide)
    std = F.when(n >= 2, F.sqrt(spread.cast("double") / (n.cast("double") * (n - 1).cast("double"))) / 60.0).otherwise(F.lit(0.0))
    privesc = F.when(F.col("is_sudo_ok") & in_win, (t - ll) / F.lit(1e6)).otherwise(F.lit(0.0))
    rate = F.when(in_win & (t > ll), (F.col("R") - F.col("RL")) / ((t - ll) / F.lit(60e6))).otherwise(F.lit(0.0))
    first_sudo = F.col("is_sudo_ok") & (F.col("all_sudo") == 0)
    has = F.col("user").isNotNull()

    def z(expr, zero):
        return F.when(has, expr).otherwise(zero)
    return [
        z(F.col("un").cast("long"), F.lit(0).cast("long")).alias("user_window_events"),
        z(std.cast("double"), F.lit(0.0)).alias("user_login_time_std_devs"),
        (F.lit(False) if p.compat else z(first_sudo, F.lit(False))).alias("user_first_sudo_usage"),
        z(F.col("fs").cast("long"), F.lit(0).cast("long")).alias("user_failed_sudo_attempts"),
        z(privesc.cast("double"), F.lit(0.0)).alias("session_login_to_privesc_seconds"),
        (F.lit(0.0) if p.compat else z(rate.cast("double"), F.lit(0.0))).alias("session_post_login_command_rate"),
        (F.lit(0).cast("long") if p.compat else z(F.col("ac").cast("long"), F.lit(0).cast("long"))).alias("session_account_changes"),
    ]


# ------------------------------------------------------------------ assembly

OUTPUT_COLUMNS = ["event_id", "event_time", "source_ip", "username", "event_type", "ref_event_id"] + FEATURE_COLUMNS


def rejects(events: DataFrame) -> DataFrame:
    """The rows that ``extract_features`` leaves out, with a ``reason``: those without a
    readable time, which belong to no window."""
    return events.where(F.col("event_time").isNull()).withColumn("reason", F.lit("no event_time"))


def extract_features(events: DataFrame, p: Params | None = None,
                     asn_prefixes: DataFrame | None = None,
                     user_base: DataFrame | None = None,
                     seen_pairs: DataFrame | None = None,
                     seen_asn: DataFrame | None = None,
                     carry=()) -> DataFrame:
    """All 14 features for every event, in one plan.

    ``events`` needs: event_id, event_time, source_ip, username, auth_method,
    event_type, message. ``asn_prefixes`` (lo, hi, asn) is optional; without it
    the new-ASN slot is false, as in the reference. Rows without a time are left out;
    ``rejects`` gives them.

    Streaming state (see ``streaming``): rows with ``_hist = true`` are
    history -- they feed the trailing windows but produce no output and do
    not count toward the all-time per-user totals, which come from
    ``user_base``; ``seen_pairs`` and ``seen_asn`` list the (ip, user) and
    (user, asn) pairs seen before.
    """
    p = p or Params()
    W, B = _micros(p)
    # the message has given its flags; it needn't ride through every exchange
    prep = prepare(events.where(F.col("event_time").isNotNull()), p, carry).drop("message")
    hot_ips = hot_users = None
    if p.hot_rows is not None:
        prep = cut_lineage(prep)           # counted first, then read by both sides
        hot_ips, hot_users = (cut_lineage(BL.hot_buckets(prep, key, p.hot_rows)) for key in ("ip", "user"))
        hot_ips, hot_users = (None if x.isEmpty() else x for x in (hot_ips, hot_users))
    ip_part = _ip_side(prep, p, seen_pairs, hot_ips)
    ip_cols = [c for c in ip_part.columns]
    with_ip = ip_part.unionByName(_no_ip_rows(prep.where(~F.col("hist"))).select(*ip_cols))
    # re-derive the user bucket and the user key for the second side
    with_ip = with_ip.withColumn("bkt", F.expr(f"(tus - pmod(tus, {B})) div {B}"))
    prefix = _user_prefix(prep, B, user_base)
    # history rows re-enter the user side so its windows see them
    hist_rows = prep.where(F.col("hist") & F.col("user").isNotNull()).select(*[
        F.col(c) if c in prep.columns else F.lit(None).cast(ip_part.schema[c].dataType).alias(c)
        for c in ip_cols]).withColumn("bkt", F.expr(f"(tus - pmod(tus, {B})) div {B}"))
    allrows = _user_side(with_ip.unionByName(hist_rows), prefix, p, hot_users)
    if asn_prefixes is not None and not p.compat:
        allrows = allrows.join(new_asn_flags(prep, asn_prefixes, seen_asn), "event_id", "left")
    return assembled(allrows, p, carry)


def assembled(rows: DataFrame, p: Params, carry=()) -> DataFrame:
    """The output columns from the measures of both sides; ``_new_asn`` may be missing."""
    new_ip = F.col("user").isNull() | F.col("ip").isNull() if p.compat else F.col("user_new_ip_detected")
    out = rows.withColumn("user_new_ip_detected", new_ip)
    new_asn = F.coalesce(F.col("_new_asn"), F.lit(False)) if "_new_asn" in rows.columns and not p.compat else F.lit(False)
    return out.select(
        "event_id", "event_time",
        F.col("ip").alias("source_ip"), F.col("user").alias("username"), "event_type",
        reference_event_id(F.col("ip"), F.col("user"), F.col("tus")).alias("ref_event_id"),
        *[F.col(c) for c in FEATURE_COLUMNS[:9]],
        new_asn.alias("user_login_from_new_asn"),
        *[F.col(c) for c in FEATURE_COLUMNS[10:]],
        "ip_window_events", "user_window_events",
        *[F.col(c) for c in carry],
    )


# ------------------------------------------------------------------ ASN (longest prefix)

def ip_to_hex(ip: Column) -> Column:
    """32 hex digits of an IPv6 address, or of an IPv4 one as its mapped form; null if it's
    neither."""
    v4 = F.regexp_extract_all(ip, F.lit(r"(?:^|\.)(\d{1,3})(?=\.|$)"), F.lit(1))
    octets = F.transform(v4, lambda x: x.cast("int"))
    is_v4 = ip.rlike(r"^\d{1,3}(\.\d{1,3}){3}$") & ~F.exists(octets, lambda x: x > 255)
    mapped = F.concat(F.lit("0" * 20 + "ffff"), F.array_join(F.transform(octets, lambda x: F.lpad(F.lower(F.hex(x)), 2, "0")), ""))
    sides = F.split(ip, "::", -1)

    def groups(side: Column) -> Column:
        return F.transform(F.filter(F.split(side, ":"), lambda g: g != ""), lambda g: F.lpad(F.lower(g), 4, "0"))

    head, tail = groups(sides[0]), F.when(F.size(sides) == 2, groups(sides[1])).otherwise(F.array().cast("array<string>"))
    fill = F.lit(8) - F.size(head) - F.size(tail)
    whole = F.array_join(F.concat(head, F.array_repeat(F.lit("0000"), fill), tail), "")
    is_v6 = ip.rlike(r"^[0-9a-fA-F:]+$") & (F.size(sides) == F.when(ip.contains("::"), 2).otherwise(1)) \
        & (ip.contains("::") | (fill == 0)) & (F.length(whole) == 32)
    return F.when(is_v4, mapped).when(is_v6, whole)


def network(address: Column, bits: int) -> Column:
    """The first ``bits`` bits of 32 hex digits, as text."""
    whole, rest = divmod(bits, 4)
    text = F.substring(address, 1, whole)
    if rest:
        text = F.concat(text, F.lower(F.hex(F.shiftright(F.conv(F.substring(address, whole + 1, 1), 16, 10).cast("int"), 4 - rest))))
    return text


def prefix_blocks(prefixes: DataFrame) -> DataFrame:
    """(bits, address, width, asn): the aligned blocks of all prefixes, which are either IPv4
    ranges ``lo``, ``hi`` (a range is cut into blocks of powers of two) or texts ``prefix``
    (address/bits, both families). ``width``: bits of the block, or of a range the size."""
    if "prefix" in prefixes.columns:
        parts = F.split("prefix", "/")
        address = ip_to_hex(parts[0])
        bits = parts[1].cast("int") + F.when(parts[0].contains(":"), 0).otherwise(96)
        return prefixes.select(bits.alias("bits"), address.alias("address"), F.pow(F.lit(2.0), 128 - bits).alias("width"), "asn")
    size = "length(bin({0})) - 1"
    cut = f"""aggregate(sequence(1, 64), named_struct('lo', lo, 'out', cast(array() as array<struct<lo:bigint,k:int>>)),
        (a, i) -> if(a.lo > hi, a, named_struct(
            'lo', a.lo + shiftleft(1L, least(if(a.lo = 0, 32, {size.format('a.lo & -a.lo')}), {size.format('hi - a.lo + 1')})),
            'out', concat(a.out, array(named_struct('lo', a.lo, 'k', least(if(a.lo = 0, 32, {size.format('a.lo & -a.lo')}), {size.format('hi - a.lo + 1')})))))),
        a -> a.out)"""
    x = prefixes.select(F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi"), "asn").where("lo <= hi")
    x = x.select("asn", (F.col("hi") - F.col("lo") + 1).cast("double").alias("width"), F.explode(F.expr(cut)).alias("b"))
    return x.select((F.lit(128) - F.col("b.k")).alias("bits"), F.concat(F.lit("0" * 20 + "ffff"), F.lpad(F.lower(F.hex("b.lo")), 8, "0")).alias("address"), "width", "asn")


def asn_lookup(df: DataFrame, prefixes: DataFrame, ip_col: str = "ip") -> DataFrame:
    """``df`` with column ``asn`` (null where no prefix holds the address); every row stays.
    One equi-join for each length that occurs among the prefixes (129 at most): an address
    meets at most one block of a length. The narrowest prefix wins (ties: the smaller asn).
    Nothing is grouped, so ``df`` may be a stream."""
    blocks = cut_lineage(prefix_blocks(prefixes))
    lengths = sorted(r.bits for r in blocks.select("bits").distinct().collect())
    x = df.withColumn("_address", ip_to_hex(F.col(ip_col)))
    for n in lengths:
        own = (blocks.where(F.col("bits") == n).groupBy(network(F.col("address"), n).alias("_net"))
               .agg(F.min(F.struct("width", "asn")).alias(f"_found{n}")))
        x = x.withColumn("_net", network(F.col("_address"), n)).join(own, "_net", "left").drop("_net")
    found = [F.col(f"_found{n}") for n in lengths]
    best = F.least(*found) if len(found) > 1 else found[0] if found else F.lit(None).cast("struct<width:double,asn:string>")
    return x.withColumn("asn", best["asn"]).drop("_address", *[f"_found{n}" for n in lengths])


def _asn_pairs(prep: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(user, asn, f): first sighting of each pair by (time, id). Addresses are looked up once
    each; a hot pair or address is combined before it meets anything."""
    pairs = (prep.where(F.col("ip").isNotNull() & F.col("user").isNotNull() & ~F.col("hist"))
             .groupBy("ip", "user").agg(F.min(F.struct("tus", "event_id")).alias("f")))
    found = asn_lookup(pairs.select("ip").distinct(), prefixes).where("asn is not null")
    return pairs.join(found, "ip").groupBy("user", "asn").agg(F.min("f").alias("f"))


def new_asn_flags(prep: DataFrame, prefixes: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """(event_id, _new_asn): first sighting of (user, asn), ordered by (ts, id); pairs in
    ``seen`` are known from before."""
    first = _asn_pairs(prep, prefixes)
    if seen is not None:
        first = first.join(seen.select("user", "asn"), ["user", "asn"], "left_anti")
    return first.select(F.col("f.event_id").alias("event_id"), F.lit(True).alias("_new_asn"))
