"""Structured Streaming jobs: the detection cycle, window counts, cooldown.

* ``detection_stream``: growing log files (``sources.tail``) -> parse -> keyed features
  (``state.streaming_features``) -> scoring -> decisions -> keyed cooldown -> sinks, one
  query whose state is Spark's own. ``foreachBatch`` only writes: each sink gets a folder
  per batch, replaced if the batch runs again, and one row in ``commits`` at the end makes
  all of them visible together (``committed`` reads no others). That row carries the last
  incident number of every day, so numbers go on where the batch before ended.
* ``ip_window_counts``: per-IP counts of closed sliding windows by two native aggregations,
  per (window, IP, user), then per (window, IP): no set of users is ever held.
* ``cooldown_stream``: the greedy cooldown on keyed state.
"""

from __future__ import annotations

import datetime
import heapq
import json
import time
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from ..functions.parse import parse_lines
from ..operators import features as FE
from ..operators import report as RP
from ..operators import response as RS
from ..params import Params
from ..plans import pipelines as PL
from ..sinks import files as SK
from ..sources.tail import tail_sources
from .state import state_partitions, streaming_features, use_rocksdb

EVENT_COLS = ["event_id", "event_time", "source_ip", "username", "auth_method", "event_type", "message", "time_source"]
#: Rows of a key sorted at once, and rows of a stored run read at once.
RUN, PAGE = 4096, 256


def _utc(seconds: float) -> datetime.datetime:
    return datetime.datetime.fromtimestamp(seconds, tz=datetime.timezone.utc)


# ------------------------------------------------------------------ cooldown state

class CooldownProcessor(StatefulProcessor):
    """Greedy cooldown per action:target over micro-batches; state: the last time that was
    allowed and executed, until the watermark has passed it by the cooldown.

    A key's rows of a batch come in any order and number. They are sorted in runs of ``RUN``;
    if there is more than one, runs go to a map state in pages of ``PAGE`` rows and are
    merged from there, so a hot key never has all its rows in memory."""

    def __init__(self, fields: list[str], cooldowns: dict, default: int, enable_actions: bool):
        self.at = {c: k for k, c in enumerate(fields)}
        self.out = Row(*fields, "allowed")
        self.cooldowns, self.default, self.enable = cooldowns, default, enable_actions

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last_allowed", "t long")
        self.runs = handle.getMapState("runs", "run long, page long", "rows string")

    def _order(self, row) -> tuple:
        return tuple(row[self.at[c]] for c in ("t", "event_id", "seq"))

    def _sorted(self, rows: Iterator) -> Iterable:
        run, n = [], 0
        for row in rows:
            run.append(tuple(row))
            if len(run) == RUN:
                run.sort(key=self._order)
                for page in range(0, RUN, PAGE):
                    self.runs.updateValue((n, page // PAGE), (json.dumps(run[page:page + PAGE]),))
                run, n = [], n + 1
        run.sort(key=self._order)
        return heapq.merge(*[self._stored(k) for k in range(n)], run, key=self._order) if n else run

    def _stored(self, run: int) -> Iterator[tuple]:
        for page in range(RUN // PAGE):
            rows = json.loads(self.runs.getValue((run, page))[0])
            self.runs.removeKey((run, page))
            yield from map(tuple, rows)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        action = key[0]
        live = action == "alert_only" or self.enable
        wait = int(self.cooldowns.get(action, self.default)) * 1_000_000
        before = last = int(self.last.get()[0]) if live and self.last.exists() else None
        for row in self._sorted(rows):
            t = row[self.at["t"]]
            allowed = not live or last is None or t >= last + wait
            if live and allowed:
                last = t
            yield self.out(*row, allowed)
        if last != before:
            self.last.update((last,))
            self.handle.registerTimer((last + wait) // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.last.exists():
            wait = int(self.cooldowns.get(key[0], self.default)) * 1_000_000
            if self.last.get()[0] + wait <= timerValues.getCurrentWatermarkInMs() * 1000:
                self.last.clear()         # it can block nothing that is still to come
        return iter(())

    def close(self) -> None:
        pass


def cooldown_stream(actions: DataFrame, p: Params | None = None, lateness_seconds: float | None = 600.0, carry: Iterable[str] = ()) -> DataFrame:
    """actions stream (event_id, seq, action_type, target, event_time) -> event_id, seq,
    action_type, target, t (microseconds), the columns of ``carry`` and allowed.
    ``lateness_seconds`` None: ``actions`` has a watermark on ``wm_time`` already. ``carry``
    columns must be strings or numbers."""
    p = p or Params()
    use_rocksdb(actions.sparkSession)
    stamp = "wm_time"
    x = actions
    if lateness_seconds is not None:
        x = x.withColumn(stamp, F.col("event_time").cast("timestamp")).withWatermark(stamp, f"{int(lateness_seconds * 1e6)} microseconds")
    x = x.select("event_id", F.col("seq").cast("int").alias("seq"), "action_type", "target",
                 F.unix_micros(F.col("event_time").cast("timestamp")).alias("t"), *carry, stamp)
    # the stamp decides about lateness and timers alone; rows carry their time as a number
    names = [c for c in x.columns if c != stamp]
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in x.schema.fields if f.name != stamp])
    out = T.StructType([*schema.fields, T.StructField("allowed", T.BooleanType())])
    x = x.withColumns({"_action": F.col("action_type"), "_target": F.col("target")})
    processor = _Narrow(names, dict(p.cooldowns), p.default_cooldown, p.enable_actions)
    return x.groupBy("_action", "_target").transformWithState(processor, out, "Append", "EventTime")


class _Narrow(CooldownProcessor):
    """Takes the fields it knows from the input row, which holds the stamp besides."""

    def handleInputRows(self, key, rows, timerValues):
        names = [*self.at]
        return super().handleInputRows(key, (tuple(r[c] for c in names) for r in rows), timerValues)


# ------------------------------------------------------------------ window counts

def ip_window_counts(events: DataFrame, window: str = "5 minutes", slide: str = "1 minute", watermark: str = "10 minutes") -> DataFrame:
    """Per-IP counts of sliding windows that the watermark has closed (append mode): w,
    source_ip, events, failed, unique_users. Later rows are dropped and counted by Spark."""
    per_user = (events.where(F.col("source_ip").isNotNull())
                .withWatermark("event_time", watermark)
                .groupBy(F.window("event_time", window, slide).alias("w"), "source_ip", "username")
                .agg(F.count(F.lit(1)).alias("events"), F.sum(F.when(F.instr("event_type", "failed") > 0, 1).otherwise(0)).alias("failed")))
    # windows end a slide apart, so the slide that a window's last moment is in tells it
    at = F.window(F.window_time("w"), slide)
    found = (per_user.groupBy(at.alias("last"), "source_ip")
             .agg(F.sum("events").alias("events"), F.sum("failed").alias("failed"), F.count("username").alias("unique_users")))
    w = F.struct((F.col("last.end") - F.expr(f"interval {window}")).alias("start"), F.col("last.end").alias("end"))
    return found.select(w.alias("w"), "source_ip", "events", "failed", "unique_users")


# ------------------------------------------------------------------ detection cycle

def committed(spark: SparkSession, out_root: str, path: str, fmt: str = "json", schema: str | None = None) -> DataFrame:
    """What the committed batches of a detection stream wrote to the sink ``path`` below its
    output folder (reports/json, reports/text, alerts, audit, actions)."""
    reader = spark.read if schema is None else spark.read.schema(f"{schema}, batch long")
    return reader.format(fmt).load(f"{out_root}/{path}").join(spark.read.parquet(f"{out_root}/commits").select("batch").distinct(), "batch", "left_semi").drop("batch")


def detection_stream(spark: SparkSession, sources: dict[str, str], model, out_root: str, p: Params | None = None, trigger: dict | None = None,
                     checkpoint: str | None = None, max_lines: int | None = None, lateness_seconds: float = 600.0, in_order: bool = False,
                     asn_prefixes: DataFrame | None = None, hold: str | None = None):
    """Start the streaming detection cycle. ``sources``: source -> pattern of its (growing)
    files. ``trigger``: e.g. {"availableNow": True} (one cycle of at most ``max_lines`` lines)
    or {"processingTime": "5 seconds"} (continuous monitoring). Started again with the same
    ``out_root``, it resumes where it stopped. Without a model only ``features`` are written.
    While the file ``hold`` exists, no batch takes new lines."""
    p = p or Params()
    lines = tail_sources(spark, sources, max_lines, hold=hold)
    feats = streaming_features(parse_lines(lines, year=p.log_year), p, lateness_seconds, in_order, asn_prefixes, carry=("wm_time",))
    ck = checkpoint or f"{out_root}/_checkpoint"
    trigger = trigger or {"availableNow": True}
    if model is None:
        with state_partitions(spark):
            return (feats.drop("wm_time").writeStream.format("parquet").option("path", f"{out_root}/features")
                    .option("checkpointLocation", ck).trigger(**trigger).start())
    det = PL.score_features(feats, model, p)
    kept = [c for c in det.columns if c != "wm_time"]
    anomaly = T.StructType([f for f in det.schema.fields if f.name in kept])
    # the anomaly rides on its first action (every one has an alert), as text
    acts = RS.decide(det.where("is_anomaly").withColumn("anomaly", F.to_json(F.struct(*kept), {"timestampFormat": RP.ISO})), p, carry=("anomaly", "wm_time"))
    acts = acts.withColumn("anomaly", F.when(F.col("seq") == 0, F.col("anomaly"))).withColumn("is_reversible", F.col("is_reversible").cast("int"))
    cooled = cooldown_stream(acts, p, None, carry=("reason", "severity", "is_reversible", "anomaly"))
    spark.createDataFrame([], "date date, last long").write.mode("append").parquet(f"{out_root}/commits/batch=-1")

    def run(batch: DataFrame, batch_id: int) -> None:
        # the batch's own session runs without AQE: whatever is read back, the caller's plans
        sp, started = spark, time.time()
        rows = batch.withColumns({"event_time": F.timestamp_micros("t"), "is_reversible": F.col("is_reversible") == 1}).drop("t")
        # read by several sinks: written once
        RS.outcome(rows, p).write.mode("overwrite").parquet(f"{out_root}/actions/batch={batch_id}")
        acted = sp.read.parquet(f"{out_root}/actions/batch={batch_id}")
        before = last_numbers(sp, out_root, batch_id)
        numbers, n = before, 0
        # a batch that only ends timers has nothing for the sinks, whose folders the first one makes
        if batch_id == 0 or not acted.isEmpty():
            found = acted.where("anomaly is not null").select(F.from_json("anomaly", anomaly, {"timestampFormat": RP.ISO}).alias("a")).select("a.*")
            inc = RP.incidents(found, p, actions=acted, carried=before)
            SK.save_reports(inc, f"{out_root}/reports", "json", batch_id)
            # the other sinks read the reports that were written: their ids are given once
            inc = sp.read.schema(inc.schema).json(f"{out_root}/reports/json/batch={batch_id}")
            SK.save_reports(inc, f"{out_root}/reports", "text", batch_id)
            SK.append_alerts(RP.alerts(inc), f"{out_root}/alerts", batch_id)
            SK.append_audit(RS.audit_records(acted), f"{out_root}/audit", batch_id)
            n = inc.count()
            numbers = before.unionByName(inc.select(F.to_date("timestamp").alias("date"), F.element_at(F.split("incident_id", "-"), -1).cast("long").alias("last")))
        cycle = sp.createDataFrame([(batch_id, _utc(started), _utc(time.time()))], "cycle_id long, started_at timestamp, ended_at timestamp")
        cycle.withColumns({"failed": F.lit(False), "anomalies": F.lit(n).cast("long")}).write.mode("overwrite").parquet(f"{out_root}/cycles/batch={batch_id}")
        numbers = numbers.groupBy("date").agg(F.max("last").alias("last")).unionByName(sp.createDataFrame([(None, 0)], "date date, last long"))
        numbers.coalesce(1).write.mode("overwrite").parquet(f"{out_root}/commits/batch={batch_id}")

    with state_partitions(spark):
        return cooled.writeStream.foreachBatch(run).option("checkpointLocation", ck).trigger(**trigger).start()


def last_numbers(spark: SparkSession, out_root: str, batch_id: int) -> DataFrame:
    """(date, last): the last incident number of every day before this batch."""
    commits = spark.read.schema("date date, last long, batch long").parquet(f"{out_root}/commits").where(F.col("batch") < batch_id)
    newest = commits.agg(F.max("batch")).first()[0]
    return commits.where((F.col("batch") == F.lit(newest)) & F.col("date").isNotNull()).select("date", "last")
