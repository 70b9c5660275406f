"""Response decisions as data: actions, cooldown, outcome, reversal, audit.

Nothing is executed; every decision is a row.

Cooldown (greedy): an action on ``action:target`` is allowed when at least the
cooldown C has passed since the last action on that key that was allowed *and
executed* (dry-run actions never start a cooldown). That is a chain, not a window
function, but a stretch of a key's times can be summed up without knowing where the
chain enters it: as a function from the time ``e`` from which actions are free again to
that time after the stretch. It is a step function with a step at some of the
stretch's times, and the identity beyond its last one. Scaling:

1. Actions become distinct times per key, each with its first action (the others of the
   same instant are blocked); time buckets that hold more than ``SLICE`` times are cut into
   narrower slices, so a hot key is many stretches however dense it is.
2. Every slice's function is made by itself; functions of ``FAN`` neighbours are composed
   into one, level by level, and then the known state before the first is handed down, which
   gives each slice its ``e``.
3. Every slice follows its own piece of the chain, one binary search per allowed action.

Only times, row numbers and step functions take part; the actions themselves meet the list
of allowed rows in one join at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from ..functions import constants as K
from ..params import Params
from ..session import cut_lineage


def severity_at_least(level: Column, threshold: str | Column) -> Column:
    """Ordinal compare over NORMAL < LOW < MEDIUM < HIGH < CRITICAL; unknown
    levels compare false."""
    levels = F.array(*[F.lit(x) for x in K.SEVERITY_LEVELS])
    th = F.lit(threshold) if isinstance(threshold, str) else threshold
    a, b = F.array_position(levels, level), F.array_position(levels, th)
    return F.coalesce((a > 0) & (b > 0) & (a >= b), F.lit(False))


def _fmt2(x: Column) -> Column:
    return F.format_string("%.2f", F.round(x, 2))


def decide(anomalies: DataFrame, p: Params | None = None, carry=()) -> DataFrame:
    """One row per action: alert always; block IP and lock account at >= HIGH;
    terminate sessions at CRITICAL (in that order, ``seq`` 0..3). ``carry``: columns of
    the anomaly that each of its actions gets."""
    p = p or Params()
    c = F.col
    ip = F.coalesce(c("source_ip"), F.lit("unknown"))
    user = F.coalesce(c("username"), F.lit("unknown"))
    lvl = c("risk_level")

    def act(kind, target, reason, cond):
        return F.when(cond, F.struct(F.lit(kind).alias("action_type"), target.alias("target"),
                                     reason.alias("reason"), F.lit(True).alias("is_reversible")))
    acts = F.array(
        act("alert_only", user, F.concat(F.lit("Anomaly detected: "), c("event_type"), F.lit(" (score: "),
                                         _fmt2(c("anomaly_score")), F.lit(")")), F.lit(True)),
        act("block_ip", ip, F.concat(F.lit("Blocking IP after "), c("event_type")), severity_at_least(lvl, p.block_ip_at)),
        act("lock_account", user, F.concat(F.lit("Locking account after "), c("event_type")),
            severity_at_least(lvl, p.lock_account_at)),
        act("terminate_session", user, F.concat(F.lit("Terminating sessions for "), user, F.lit(" (CRITICAL)")),
            severity_at_least(lvl, p.terminate_session_at)),
    )
    kept = F.filter(acts, lambda a: a.isNotNull())
    return (anomalies.select("event_id", "event_time", c("risk_level").alias("severity"), *carry, F.posexplode(kept).alias("seq", "a"))
            .select("event_id", "seq", "a.action_type", "a.target", "a.reason", "severity", "event_time",
                    "a.is_reversible", *carry))


def cooldown_seconds(action_type: Column, p: Params | None = None) -> Column:
    p = p or Params()
    expr = F.lit(p.default_cooldown)
    for a, s in sorted(p.cooldowns.items()):
        expr = F.when(action_type == a, F.lit(s)).otherwise(expr)
    return expr.cast("long")


def executes(action_type: Column, p: Params) -> Column:
    """Would the action run when allowed? alert_only always; others only with
    automated actions enabled (else dry-run, which never starts a cooldown)."""
    return (action_type == "alert_only") | F.lit(bool(p.enable_actions))


#: Times of a slice, about, and functions composed at once.
SLICE, FAN = 4096, 16
#: Step function: up to each ``at`` (and beyond the one before) the state becomes ``to``.
_LONGS = T.ArrayType(T.LongType())
_STEPS = T.StructType([T.StructField("at", _LONGS), T.StructField("to", _LONGS)])
ALWAYS_FREE = -(1 << 62)


def _steps(times: np.ndarray, wait: int) -> tuple[np.ndarray, np.ndarray]:
    """The function of a stretch of distinct, sorted times."""
    following = np.searchsorted(times, times + wait)
    to = times + wait
    for i in range(len(times) - 1, -1, -1):
        if following[i] < len(times):
            to[i] = to[following[i]]
    last = np.append(to[1:] != to[:-1], True)
    return times[last], to[last]


def _through(steps: tuple[np.ndarray, np.ndarray], e: np.ndarray) -> np.ndarray:
    at, to = steps
    k = np.searchsorted(at, e)
    return np.where(k < len(at), to[np.minimum(k, len(at) - 1)], e)


def _composed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    at, to = parts[0]
    for part in parts[1:]:
        beyond = part[0] > at[-1]         # what passes the first unchanged
        at, to = np.concatenate([at, part[0][beyond]]), np.concatenate([_through(part, to), part[1][beyond]])
        last = np.append(to[1:] != to[:-1], True)
        at, to = at[last], to[last]
    return at, to


def _chain(times: np.ndarray, wait: int, e: int) -> list[int]:
    """Indices of the allowed times when actions are free from ``e`` on."""
    found, i = [], int(np.searchsorted(times, e))
    while i < len(times):
        found.append(i)
        i = int(np.searchsorted(times, times[i] + wait)) if wait > 0 else i + 1
    return found


def _lists(column: pa.Array) -> list[np.ndarray]:
    return [np.asarray(x, np.int64) for x in column.to_pylist()]


def _as_steps(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.Array:
    return pa.StructArray.from_arrays([pa.array([f[k] for f in found], pa.list_(pa.int64())) for k in range(2)], names=["at", "to"])


@arrow_udf(_STEPS)
def _steps_of(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for times, wait in batches:
        yield _as_steps([_steps(t, w) for t, w in zip(_lists(times), wait.to_pylist(), strict=True)])


def _functions(group: list[dict]) -> list[tuple[np.ndarray, np.ndarray]]:
    return [(np.asarray(x["at"], np.int64), np.asarray(x["to"], np.int64)) for x in group]


@arrow_udf(_STEPS)
def _composed_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for groups in batches:
        yield _as_steps([_composed(_functions(g)) for g in groups.to_pylist()])


@arrow_udf(_LONGS)
def _handed_down(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """The state before each of a group's stretches, given that before the first."""
    for groups, entry in batches:
        out = []
        for group, e in zip(groups.to_pylist(), entry.to_pylist(), strict=True):
            states = [e]
            for f in _functions(group)[:-1]:
                states.append(int(_through(f, np.array([states[-1]]))[0]))
            out.append(states)
        yield pa.array(out, pa.list_(pa.int64()))


@arrow_udf(_LONGS)
def _allowed_rows(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for times, rows, wait, entry in batches:
        yield pa.array([r[_chain(t, w, e)] for t, r, w, e in zip(_lists(times), _lists(rows), wait.to_pylist(), entry.to_pylist(), strict=True)],
                       pa.list_(pa.int64()))


def apply_cooldown(actions: DataFrame, p: Params | None = None, bucket_seconds: float | None = None,
                   anchors: DataFrame | None = None, slice_rows: int = SLICE) -> DataFrame:
    """Adds ``allowed`` (greedy cooldown per action:target, event time).

    ``anchors`` (action_type, target, last_allowed_us): last executed time per
    key from earlier runs; rows of the key before ``anchor + C`` are
    blocked and the chain continues from the anchor.
    """
    p = p or Params()
    max_cd = max([p.default_cooldown] + list(p.cooldowns.values()))
    B = int(round((bucket_seconds or max(3600.0, float(max_cd))) * 1e6))
    # rows get numbers, which the checkpoint keeps with them
    x = cut_lineage(actions.withColumn("_row", F.monotonically_increasing_id()))
    live = (x.where(executes(F.col("action_type"), p))
            .select(F.concat_ws(":", F.col("action_type"), F.col("target")).alias("_k"),
                    F.unix_micros(F.col("event_time").cast("timestamp")).alias("_t"),
                    (cooldown_seconds(F.col("action_type"), p) * F.lit(1_000_000)).alias("_cd"), "event_id", "seq", "_row"))
    # 1. the first action of every instant; slices of a bucket
    firsts = (live.where("_cd > 0").groupBy("_k", "_cd", "_t").agg(F.min(F.struct("event_id", "seq", "_row")).alias("f"))
              .select("_k", "_cd", "_t", F.col("f._row").alias("_row"), F.expr(f"(_t - pmod(_t, {B})) div {B}").alias("_bkt")))
    firsts = cut_lineage(firsts)
    parts = firsts.groupBy("_k", "_bkt").agg(F.ceil(F.count(F.lit(1)) / F.lit(slice_rows)).alias("_n"))
    sliced = (firsts.join(parts, ["_k", "_bkt"])
              .withColumn("_slice", F.expr(f"pmod(_t, {B}) div ceil({B} / _n)"))
              .groupBy("_k", "_cd", "_bkt", "_slice").agg(F.sort_array(F.collect_list(F.struct("_t", "_row"))).alias("r")))
    order = Window.partitionBy("_k").orderBy("_bkt", "_slice")
    # one row per slice: its place in the key, its times and its function
    slices = cut_lineage(sliced.select("_k", "_cd", (F.row_number().over(order) - 1).cast("long").alias("_at"), F.col("r._t").alias("times"), F.col("r._row").alias("rows"))
                         .withColumn("steps", _steps_of("times", "_cd")))
    # 2. functions of neighbours composed, level by level, and the state handed down
    levels = [slices.select("_k", "_at", "steps")]
    while (levels[-1].agg(F.max("_at")).first()[0] or 0) > 0:
        group = levels[-1].groupBy("_k", F.expr(f"_at div {FAN}").alias("_at")).agg(F.sort_array(F.collect_list(F.struct("_at", "steps"))).alias("g"))
        levels.append(cut_lineage(group.select("_k", "_at", F.col("g.steps").alias("parts")).withColumn("steps", _composed_of("parts"))))
    state = levels[-1].select("_k", "_at")
    if anchors is not None:
        known = anchors.select(F.concat_ws(":", "action_type", "target").alias("_k"),
                               (F.col("last_allowed_us") + cooldown_seconds(F.col("action_type"), p) * F.lit(1_000_000)).alias("_e"))
        state = state.join(known, "_k", "left")
    else:
        state = state.withColumn("_e", F.lit(None).cast("long"))
    state = state.select("_k", "_at", F.coalesce("_e", F.lit(ALWAYS_FREE)).alias("_e"))
    for level in reversed(levels[1:]):
        below = level.join(state, ["_k", "_at"]).select("_k", "_at", F.posexplode(_handed_down("parts", "_e")).alias("i", "_e"))
        state = below.select("_k", (F.col("_at") * FAN + F.col("i")).alias("_at"), "_e")
    # 3. the chain within each slice
    chosen = slices.join(state, ["_k", "_at"]).select(F.explode(_allowed_rows("times", "rows", "_cd", "_e")).alias("_row"))
    free = x.join(chosen.withColumn("_chosen", F.lit(True)), "_row", "left")
    waits = executes(F.col("action_type"), p) & (cooldown_seconds(F.col("action_type"), p) > 0)
    return free.withColumn("allowed", ~waits | F.coalesce("_chosen", F.lit(False))).drop("_row", "_chosen")


def outcome(actions: DataFrame, p: Params | None = None) -> DataFrame:
    """Status and messages per action (after ``apply_cooldown``)."""
    p = p or Params()
    c = F.col
    status = (F.when(~c("allowed"), F.lit("blocked_cooldown"))
              .when(~c("_exec"), F.lit("dry_run"))
              .otherwise(F.lit("executed")))
    tgt = c("target")
    result = (F.when(c("action_type") == "lock_account", F.format_string("Account %s locked (simulated)", tgt))
              .when(c("action_type") == "unlock_account", F.format_string("Account %s unlocked (simulated)", tgt))
              .when(c("action_type") == "block_ip", F.format_string("IP %s blocked (simulated)", tgt))
              .when(c("action_type") == "unblock_ip", F.format_string("IP %s unblocked (simulated)", tgt))
              .when(c("action_type") == "terminate_session", F.format_string("Sessions for %s terminated (simulated)", tgt))
              .otherwise(F.concat(F.lit("Alert: "), c("reason"))))
    reversal = (F.when(c("action_type") == "lock_account", F.format_string("usermod -U %s", tgt))
                .when(c("action_type") == "unlock_account", F.format_string("usermod -L %s", tgt))
                .when(c("action_type") == "block_ip", F.format_string("iptables -D INPUT -s %s -j DROP", tgt))
                .when(c("action_type") == "unblock_ip", F.format_string("iptables -A INPUT -s %s -j DROP", tgt)))
    msg = (F.when(c("status") == "blocked_cooldown",
                  F.format_string(K.MSG_COOLDOWN, (c("_cd_s")).cast("int")))
           .when(c("status") == "dry_run", F.lit(K.MSG_DRY_RUN))
           .otherwise(result))
    return (actions.withColumn("_exec", executes(c("action_type"), p))
            .withColumn("_cd_s", cooldown_seconds(c("action_type"), p))
            .withColumn("status", status)
            .withColumn("success", c("status") == "executed")
            .withColumn("result_message", msg)
            .withColumn("reversal_command", F.when(c("status") == "executed", reversal))
            .drop("_exec", "_cd_s"))


def audit_records(outcomes: DataFrame) -> DataFrame:
    """Audit rows for executed actions only (cooldown-blocked and dry-run
    decisions leave no audit row, as coded in the reference)."""
    c = F.col
    return (outcomes.where(c("status") == "executed")
            .select(F.to_date("event_time").alias("date"),
                    F.struct(c("action_type"), c("target"), c("reason"), c("severity"),
                             c("event_time").alias("timestamp"), c("event_id"), c("seq"),
                             c("is_reversible")).alias("action"),
                    c("success"), c("result_message"), c("event_time").alias("executed_at"),
                    F.lit(K.EXECUTED_BY).alias("executed_by"), c("reversal_command")))
