"""Streaming window features on keyed native state (``transformWithState``).

Two stateful operators in one query: the first holds per source IP the trailing events, the
second per user the trailing events, the all-time totals and the IPs and ASNs seen. Both
work out the measures that the batch operators get from windows, and the same
column expressions (``features.ip_measures``, ``user_measures``, ``assembled``) turn them
into features.

* A key's state is one value: its newest trailing events and whatever else the side keeps,
  so a key costs one read and one write a batch. Events beyond ``SLAB`` move to a map state by
  time slice (``SLICES`` a window), IPs or ASNs beyond ``SLAB`` to a map state of their own:
  what a batch costs follows its rows and the window, whatever came before. An
  event-time timer clears the trailing events of a key that falls silent.
* The watermark follows stamps read from lines. Rows stamped at ingest have none and never
  move it; rows without an address (or user) have nothing to share and are spread over
  ``SPREAD`` keys without state.
* Between Spark and a processor a row is one text of two lines: the JSON of the fields that the
  processor computes with, and that of the whole row, which passes through unread. The
  answers of up to ``CHUNK`` rows come back as one row: these second lines, and the measures as
  one JSON list. A value a column, a row an answer, or a state row a value costs the Python
  worker a multiple of the work itself.
* State is kept in at most ``STATE_TASKS`` partitions a core (``state_partitions``), as each of them
  costs a Python worker and a commit for every operator and batch, with rows or without.
* ``in_order=True`` holds rows back until the watermark has passed them and then takes them
  in event-time order, so rows may arrive in any order within ``lateness_seconds`` and
  the result equals the batch; the last rows leave when a later stamp moves the watermark.
  Held rows lie in texts of ``CHUNK`` rows and are read when the first of them is due.
  ``in_order=False`` answers at once: a row sees all that has arrived before it.
* Rows behind the watermark are dropped and counted by Spark (``numRowsDroppedByWatermark``).
"""

from __future__ import annotations

import datetime
import json
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import accumulate

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from ..operators import features as FE
from ..params import Params

SLICES = 8
SLAB = 256
SPREAD = 64
CHUNK = 1024
STATE_TASKS = 2
NO_KEY = "\u0001"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_EPOCH = datetime.datetime(1970, 1, 1, tzinfo=datetime.timezone.utc)
_STAMPS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
_OUT = "wm_time timestamp, rests array<string>, measures string"


class WindowProcessor(StatefulProcessor):
    """What both sides share: rows held back, trailing rows, timers. A row is (stamped, fields,
    rest): whether it has a stamp, the values of ``fields``, the text that passes through."""

    #: Fields of the input row; the first two are time and id.
    fields: tuple[str, ...] = ()
    #: How many of them, from the first, the window keeps.
    kept: int = 0
    #: The measures that come back, and those of a row without a key.
    out: tuple[str, ...] = ()
    nothing: tuple = ()
    #: What the value holds beside the trailing rows, if this side keeps anything for ever.
    more: str = ""
    empty: tuple = ()

    def __init__(self, window_us: int, in_order: bool):
        self.row = Row("wm_time", "rests", "measures")
        self.window, self.in_order = window_us, in_order
        self.slice = max(1, window_us // SLICES)

    def init(self, handle) -> None:
        self.handle = handle
        self.own = handle.getValueState("own", "trail string, sliced boolean, timer long" + self.more)
        self.slices = handle.getMapState("slices", "slice long, first long", "trail string")
        if self.in_order:
            self.held = handle.getListState("held", "rows string")
            self.first = handle.getValueState("first", "t long")
        self.start(handle)

    def start(self, handle) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        rows = [(r[1] is not None, [*json.loads(own).values()], rest) for r in rows for own, rest in (r[2].split("\n"),)]
        if self.in_order:
            rows = self._due(rows, now)
        if rows:
            yield from self._answers(rows, self._take(key[0], rows, now))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        rows = self._due([], now) if self.in_order else []
        yield from self._answers(rows, self._take(key[0], rows, now, fired=True))

    def _due(self, new: list, now: int) -> list:
        """The rows that the watermark has passed; the others are held."""
        first = self.first.get()[0] if self.first.exists() else None
        reached = first is not None and first // 1000 <= now
        if reached:
            new = [r for (text,) in self.held.get() for r in json.loads(text)] + new
            self.held.clear()
        due, wait = [], []
        for r in new:
            (due if not r[0] or r[1][0] // 1000 <= now else wait).append(r)
        if wait:
            self.held.appendList([(json.dumps(wait[k:k + CHUNK]),) for k in range(0, len(wait), CHUNK)])
            least = min(r[1][0] for r in wait)
            if first is None or reached or least < first:
                self.first.update((least,))
                self.handle.registerTimer(least // 1000 + 1)
        elif reached:
            self.first.clear()
        return due

    def _answers(self, rows: list, measures: Iterator[tuple]) -> Iterator[Row]:
        """What goes out for ``rows``, in the order that ``measures`` gives them, which is that
        of ``rows`` once it has begun. The stamp is the latest of a chunk."""
        found = list(measures)
        for k in range(0, len(found), CHUNK):
            part = rows[k:k + CHUNK]
            last = max((r[1][0] for r in part if r[0]), default=None)
            yield self.row(None if last is None else _EPOCH + datetime.timedelta(microseconds=last), [r[2] for r in part], json.dumps(found[k:k + CHUNK]))

    def _take(self, key: str, rows: list, now: int, fired: bool = False) -> Iterator[tuple]:
        if key.startswith(NO_KEY):
            yield from [self.nothing] * len(rows)
            return
        rows.sort(key=lambda r: r[1][:2])
        trail, sliced, timer, *more = self.own.get() if self.own.exists() else ("[]", False, None, *self.empty)
        gone = now * 1000 - self.window           # rows still to come are later than the watermark
        old = [tuple(x) for x in json.loads(trail)]
        seen = old
        if sliced:
            parts = {tuple(k): v[0] for k, v in self.slices.iterator()}
            seen = old + [tuple(x) for v in parts.values() for x in json.loads(v)]
            passed = [k for k in parts if (k[0] + 1) * self.slice <= gone]
            for k in passed:
                self.slices.removeKey(k)
            sliced = len(passed) < len(parts)
        new = [tuple(r[1][:self.kept]) for r in rows]
        if rows:
            first = rows[0][1][0] - self.window
            seen = [x for x in seen if x[0] > first]
            yield from self.measure(rows, sorted(seen + new, key=lambda x: x[:2]) if seen else new, more)
        kept = [x for x in old + new if x[0] > gone]
        if fired:
            timer = None
        if timer is None and (kept or sliced):    # when the watermark gets there, none of these is in a window any more
            timer = max(x[0] for x in kept or [(now * 1000,)]) // 1000 + self.window // 1000 + 1
            self.handle.registerTimer(timer)
        if len(kept) > SLAB:
            groups: dict[tuple[int, int], list] = {}
            for x in kept:
                s = x[0] // self.slice
                groups.setdefault(s, []).append(x)
            for s, part in groups.items():
                name = s, part[0][1]              # ids are those of rows: no other part has this name
                self.slices.updateValue(name, (json.dumps(part),))
            kept, sliced = [], True
        if kept or sliced or self.more:
            self.own.update((json.dumps(kept), sliced, timer, *more))
        else:
            self.own.clear()

    def measure(self, rows: list, seen: list[tuple], more: list) -> Iterator[tuple]:
        """The measures of ``rows``; ``seen``: they and the trailing rows, in order; ``more``:
        the rest of the value, changed in place."""
        raise NotImplementedError

    def close(self) -> None:
        pass


class IpProcessor(WindowProcessor):
    fields = ("tus", "event_id", "is_failed", "user", "auth_method")
    kept = 5
    out = ("n", "f", "u", "m", "t_min")
    nothing = (0, 0, 0, 0, 0)

    def measure(self, rows, seen, more):
        times = [x[0] for x in seen]
        failed = [0, *accumulate(x[2] for x in seen)]
        users, methods = Counter(), Counter()
        low = high = bisect_right(times, rows[0][1][0] - self.window)
        for r in rows:
            t = r[1][0]
            while high < len(seen) and times[high] <= t:
                users[seen[high][3]] += 1
                methods[seen[high][4]] += 1
                high += 1
            while times[low] <= t - self.window:
                for counted, value in ((users, seen[low][3]), (methods, seen[low][4])):
                    counted[value] -= 1
                    if not counted[value]:
                        del counted[value]
                low += 1
            yield high - low, failed[high] - failed[low], len(users) - (None in users), len(methods), times[low]


class UserProcessor(WindowProcessor):
    fields = ("tus", "event_id", "is_sudo_fail", "is_acct", "is_cmd", "is_login", "login_h", "is_sudoish", "ip", "asn")
    kept = 6
    out = ("un", "fs", "ac", "last_login", "R", "RL", "all_sudo", "all_ln", "all_ls", "all_lss", "user_new_ip_detected", "_new_asn")
    nothing = (0, 0, 0, None, 0, 0, 0, 0, 0, 0, 0, 0)
    more = ", sudo long, ln long, ls long, lss long, ips string, ips_moved boolean, asns string, asns_moved boolean"
    empty = (0, 0, 0, 0, "[]", False, "[]", False)

    def start(self, handle) -> None:
        self.moved = {c: handle.getMapState(f"{c}_moved", "name string", "known boolean") for c in ("ips", "asns")}

    def _first(self, kind: str, known: dict, moved: bool, name: str | None) -> bool:
        """Whether ``name`` is seen for the first time; notes it."""
        if name is None or name in known or (moved and self.moved[kind].containsKey((name,))):
            return False
        known[name] = True
        return True

    def measure(self, rows, seen, more):
        times = [x[0] for x in seen]
        fails, acts, commands = [[0, *accumulate(x[k] for x in seen)] for k in (2, 3, 4)]
        logins = [x[0] for x in seen if x[5]]
        sudo, n, s, ss, ips, ips_moved, asns, asns_moved = more
        ips, asns = dict.fromkeys(json.loads(ips)), dict.fromkeys(json.loads(asns))
        for r in rows:
            t, minute, is_sudoish, ip, asn = r[1][0], *r[1][6:]
            if minute is not None:
                n, s, ss = n + 1, s + minute, ss + minute * minute
            high, low = bisect_right(times, t), bisect_right(times, t - self.window)
            k = bisect_right(logins, t)
            login = logins[k - 1] if k and logins[k - 1] > t - self.window else None
            yield (high - low, fails[high] - fails[low], acts[high] - acts[low], login,
                   commands[high], commands[bisect_right(times, login)] if login is not None else 0, sudo, n, s, ss,
                   int(self._first("ips", ips, ips_moved, ip)), int(self._first("asns", asns, asns_moved, asn)))
            sudo += is_sudoish
        for kind, known in (("ips", ips), ("asns", asns)):
            if len(known) > SLAB:
                for name in known:
                    self.moved[kind].updateValue((name,), (True,))
                known.clear()
                ips_moved, asns_moved = ips_moved or kind == "ips", asns_moved or kind == "asns"
        more[:] = [sudo, n, s, ss, json.dumps([*ips]), ips_moved, json.dumps([*asns]), asns_moved]


def _spread(key: str):
    return F.coalesce(F.col(key), F.concat(F.lit(NO_KEY), F.pmod(F.xxhash64("event_id"), F.lit(SPREAD)).cast("string")))


@contextmanager
def state_partitions(spark: SparkSession) -> Iterator[None]:
    """Streams that are started within keep their state in at most ``STATE_TASKS`` partitions a
    core; those that have a checkpoint keep the number that it names."""
    name = "spark.sql.shuffle.partitions"
    given = spark.conf.get(name)
    spark.conf.set(name, min(int(given), STATE_TASKS * spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        spark.conf.set(name, given)


def use_rocksdb(spark: SparkSession) -> None:
    """The state store that keyed state needs, committing what a batch changed."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


def streaming_features(events: DataFrame, p: Params | None = None, lateness_seconds: float = 600.0, in_order: bool = False,
                       asn_prefixes: DataFrame | None = None, carry=()) -> DataFrame:
    """``features.extract_features`` of a stream of events (append mode). ``events`` as
    there, with ``time_source``: rows that aren't 'line' don't move the watermark, which lies
    on ``wm_time``. If ``carry`` names it, the result has it for operators that follow: not
    before the row's own stamp, nor the watermark."""
    p = p or Params()
    window = FE._micros(p)[0]
    use_rocksdb(events.sparkSession)
    stamp = F.when(F.col("time_source") == "line", F.col("event_time").cast("timestamp"))
    x = FE.prepare(events.where(F.col("event_time").isNotNull()).withColumn("wm_time", stamp), p, carry=("wm_time",)).drop("bkt", "hist", "message")
    x = x.withColumn("event_time", F.unix_micros("event_time")).withWatermark("wm_time", f"{int(lateness_seconds * 1e6)} microseconds")
    if asn_prefixes is not None and not p.compat:
        x = FE.asn_lookup(x, asn_prefixes).withColumn("asn", F.when(F.col("user").isNotNull(), F.col("asn")))
    else:
        x = x.withColumn("asn", F.lit(None).cast("string"))

    def keyed(rows: DataFrame, kind: type[WindowProcessor], key: str, hold: bool) -> DataFrame:
        """``rows`` with the measures of ``kind``, as numbers."""
        rest = T.StructType([f for f in rows.schema.fields if f.name != "wm_time"])
        fields = F.struct(*[F.col(c).alias(chr(97 + k)) for k, c in enumerate(kind.fields)])
        packed = rows.select(_spread(key).alias("_key"), "wm_time", F.concat_ws("\n", F.to_json(fields, {"ignoreNullFields": "false"}),
                                                                               F.to_json(F.struct(*rest.names), _STAMPS)).alias("row"))
        found = packed.groupBy("_key").transformWithState(kind(window, hold), _OUT, "Append", "EventTime", eventTimeColumnName="wm_time")
        found = found.select("wm_time", F.explode(F.arrays_zip("rests", F.from_json("measures", "array<array<bigint>>").alias("m"))).alias("x"))
        found = found.select("wm_time", F.from_json("x.rests", rest, _STAMPS).alias("r"), F.col("x.m").alias("m"))
        return found.select("wm_time", "r.*", *[F.col("m")[k].alias(c) for k, c in enumerate(kind.out)])

    x = keyed(x, IpProcessor, "ip", in_order)
    has = F.col("ip").isNotNull()             # without an address the measures are zero, as in the batch
    x = x.select("*", *[F.when(has, c).otherwise(F.lit(0)).alias(name) for name, c in FE.ip_measures().items()]).drop("n", "f", "u", "m", "t_min")
    x = keyed(x, UserProcessor, "user", False).withColumns({c: F.col(c) == 1 for c in ("user_new_ip_detected", "_new_asn")})
    x = x.select("*", *FE.user_measures(p)).withColumn("event_time", F.timestamp_micros("event_time"))
    return FE.assembled(x, p, carry)

