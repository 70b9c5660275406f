"""Streaming on keyed state: equal to the batch, whatever the order, stops and rotations."""

import datetime as dt
import json
import os

import pytest
from authlytics.functions.parse import parse_lines
from authlytics.operators import features as FE
from authlytics.operators import response as RS
from authlytics.params import Params
from authlytics.plans import catalog as C
from authlytics.plans import pipelines as PL
from authlytics.sources import fixtures as FX
from authlytics.sources.tail import read_growing
from authlytics.streaming import state as S
from authlytics.streaming import stream as ST
from pyspark.sql import functions as F

T0 = dt.datetime(2024, 1, 15, 12, 0, 0)
COLS = "event_id long, event_time timestamp, source_ip string, username string, auth_method string, event_type string, message string, time_source string"


def event(i, seconds, ip="203.0.113.5", user="eve", kind="login_failed", source="line", message="x"):
    return (i, T0 + dt.timedelta(seconds=seconds), ip, user, "password", kind, message, source)


def run(spark, tmp, batches, build, schema=COLS, name="s"):
    """The result of ``build`` over the batches, each a file, and the progress."""
    for k, rows in enumerate(batches):
        df = spark.createDataFrame(rows, schema) if isinstance(rows, list) else rows
        df.coalesce(1).write.mode("overwrite").parquet(f"{tmp}/{name}/in/seg={k}")
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp}/{name}/in/seg=*")
    q = (build(src).writeStream.format("parquet").option("path", f"{tmp}/{name}/out").option("checkpointLocation", f"{tmp}/{name}/ck")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(f"{tmp}/{name}/out"), q.recentProgress


def mixed(n):
    kinds = ["login_failed", "login_success", "sudo_success", "sudo_failure", "process_execution"]
    return [event(i, 7 * i + i % 3, None if i % 5 > 1 else f"10.0.0.{i % 3}", None if i % 5 == 4 else f"u{i % 4}", kinds[i % 5],
                  message="COMMAND=/bin/bash" if i % 5 == 2 else "line") for i in range(n)]


@pytest.mark.parametrize("in_order, slab", [(False, 256), (True, 256), (True, 5)])
def test_equal_to_the_batch(spark, tmp_path, monkeypatch, in_order, slab):
    monkeypatch.setattr(S, "SLAB", slab)
    rows = mixed(240)
    parts = [rows[:80], rows[80:160], rows[160:]]
    if in_order:       # rows of a part come one part later, others are long past
        parts = [[r for r in rows if min(2, r[0] // 80 + (r[0] % 4 == 1)) == k] for k in range(3)]
        parts += [[event(-2, 0), event(-1, 10 ** 6, None, None)]]
    p = Params()
    got, progress = run(spark, tmp_path, parts, lambda s: S.streaming_features(s, p, lateness_seconds=700, in_order=in_order))
    want = FE.extract_features(spark.createDataFrame(rows, COLS), p)
    got = got.where("event_id >= 0").select(want.columns)
    assert got.count() == 240 and want.exceptAll(got).count() == 0
    dropped = sum(o["numRowsDroppedByWatermark"] for x in progress for o in x["stateOperators"])
    assert dropped == (1 if in_order else 0)


def test_ingest_stamps_do_not_move_the_watermark(spark, tmp_path):
    """Lines that no pattern matches carry their ingest time; 28 failures stay 28."""
    fails = [event(i, i) for i in range(28)]
    cron = [(100 + i, dt.datetime.now(), None, None, "unknown", "unknown", "CRON", "ingest") for i in range(2)]
    got, _ = run(spark, tmp_path, [fails[:20] + cron, fails[20:] + cron, cron], lambda s: S.streaming_features(s, Params()))
    by = {r.event_id: r for r in got.collect()}
    assert by[27].ip_failed_logins == 28 and got.count() == 34


def test_silent_keys_leave_no_window(spark, tmp_path):
    rows = [[event(i, i, f"10.0.0.{i}", None) for i in range(5)], [event(10, 5000, "10.9.9.9", None)], [event(11, 9000, "10.9.9.9", None)]]
    _, progress = run(spark, tmp_path, rows, lambda s: S.streaming_features(s, Params()))
    kept = [sum(o["numRowsTotal"] for o in x["stateOperators"]) for x in progress]
    assert kept[0] == 5 and kept[-1] == 1          # a value each; at the end that of the last address


def test_new_asn(spark, tmp_path):
    prefixes = spark.createDataFrame([(FE_LONG("10.0.0.0"), FE_LONG("10.0.255.255"), "A"), (FE_LONG("10.0.0.2"), FE_LONG("10.0.0.2"), "B")], "lo long, hi long, asn string")
    rows = mixed(100)
    p = Params()
    got, _ = run(spark, tmp_path, [rows[:50], rows[50:]], lambda s: S.streaming_features(s, p, asn_prefixes=prefixes))
    want = FE.extract_features(spark.createDataFrame(rows, COLS), p, asn_prefixes=prefixes)
    assert want.exceptAll(got.select(want.columns)).count() == 0 and want.where("user_login_from_new_asn").count() > 4


def FE_LONG(ip):
    a, b, c, d = map(int, ip.split("."))
    return ((a * 256 + b) * 256 + c) * 256 + d


def test_windows_close_and_late_rows_are_counted(spark, tmp_path):
    parts = [[event(0, 0, user="a"), event(1, 30, user="b"), event(2, 31, user="b"), event(3, 40, user=None, kind="login_success")],
             [event(4, 3600)], [event(7, 3601)], [event(5, 1)], [event(6, 7200)]]
    got, progress = run(spark, tmp_path, parts, lambda s: ST.ip_window_counts(s))
    rows = {r.w.start: r for r in got.collect()}
    first = rows[T0]
    assert (first.events, first.failed, first.unique_users) == (4, 3, 2) and first.w.end == T0 + dt.timedelta(minutes=5)
    assert len(rows) == 10        # five windows hold the first minute, five that of the fourth row; the last row's are open
    dropped = sum(o["numRowsDroppedByWatermark"] for x in progress for o in x["stateOperators"])
    assert dropped == 5           # one late row in five windows


ACTIONS = "event_id long, seq int, action_type string, target string, event_time timestamp"


def test_cooldown_in_stored_runs_and_expiry(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ST, "RUN", 8)
    monkeypatch.setattr(ST, "PAGE", 4)
    p = Params(enable_actions=True)
    rows = [(i, i % 2, ["block_ip", "lock_account", "alert_only"][i % 3], "x", T0 + dt.timedelta(seconds=37 * i)) for i in range(200)]
    df = spark.createDataFrame(rows, ACTIONS)
    shuffled = [df.where(f"event_id < 100").orderBy(F.rand(1)), df.where("event_id >= 100").orderBy(F.rand(2)),
                [(1000, 0, "alert_only", "y", T0 + dt.timedelta(days=1))], [(1001, 0, "alert_only", "y", T0 + dt.timedelta(days=2))]]
    got, progress = run(spark, tmp_path, shuffled, lambda s: ST.cooldown_stream(s, p), ACTIONS)
    want = RS.apply_cooldown(df, p).select("event_id", "seq", "action_type", "target", "allowed")
    got = got.where("event_id < 1000").select(want.columns)
    assert want.exceptAll(got).count() == 0 and got.count() == 200
    assert progress[-1]["stateOperators"][0]["numRowsTotal"] == 1         # y's last time


@pytest.fixture(scope="module")
def cycle(spark, tmp_path_factory):
    """A model, log phases, and the batch cycle over all of them."""
    sf = "/root/testdata/sf0.001"
    p = Params(enable_actions=True, contamination=0.3, log_year=2024)
    m = PL.train(spark, FE.extract_features(FX.auth_events(spark, sf), p), p, enforce_guard=False)
    folder = str(tmp_path_factory.mktemp("logs"))
    return p, m, C.log_phases(spark, sf, 3), folder


def same(a, b):
    cols = [c for c in C._INC_SCHEMA.replace(" ", "").split(",")] and ["incident_id", "severity", "event_type", "source_ip", "username", "anomaly_score", "explanation"]
    a, b = a.select(cols), b.select(cols)
    return a.count() == b.count() and a.exceptAll(b).count() == 0


def test_cycle_equals_the_batch_and_shows_only_committed_batches(spark, cycle, tmp_path):
    p, m, phases, folder = cycle
    out = str(tmp_path / "out")
    for k in range(3):
        patterns = FX.grow_logs(phases.where(F.col("phase") == k), folder, unfinished=k == 0)
        if k == 1:
            FX.rotate_logs(folder)
        q = ST.detection_stream(spark, patterns, m, out, p)
        q.awaitTermination()
    batch = PL.cycle(spark, parse_lines(read_growing(spark, patterns), year=p.log_year), m, p)
    reports = ST.committed(spark, out, "reports/json", schema=C._INC_SCHEMA + ", date string")
    assert same(reports, batch.incidents) and reports.count() > 50
    ids = [r.incident_id for r in reports.collect()]
    assert len(set(ids)) == len(ids) and all(len(i) == len("INC-20240101-000001") for i in ids)
    assert ST.committed(spark, out, "alerts").count() == len(ids)
    audit = ST.committed(spark, out, "audit").count()
    assert audit == batch.audit.count()
    # a batch that was killed before its commit: its files are there, nothing shows them
    last = max(int(x.split("=")[1]) for x in os.listdir(f"{out}/commits") if x.startswith("batch="))
    for f in os.listdir(f"{out}/commits/batch={last}"):
        os.remove(f"{out}/commits/batch={last}/{f}")
    left = {name: ST.committed(spark, out, name).count() for name in ("reports/json", "alerts", "audit")}
    assert left["reports/json"] == left["alerts"] < len(ids) and left["audit"] <= audit


def test_features_alone_and_restart(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    for k in range(2):
        with open(logs / "auth.log", "a") as f:
            f.write("".join(f"Mar  3 09:0{k}:{s:02d} box sshd[77]: Failed password for mallory from 198.18.0.7 port 9 ssh2\n" for s in range(15)))
        q = ST.detection_stream(spark, {"auth_log": f"{logs}/auth.log*"}, None, str(tmp_path / "out"))
        q.awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out" / "features"))
    assert out.count() == 30 and out.agg({"ip_failed_logins": "max"}).first()[0] == 30


class Kept:
    """A list or value state that tells how often it is read and what it holds."""

    def __init__(self):
        self.values, self.reads = [], 0

    def get(self):
        self.reads += 1
        return iter(self.values) if not isinstance(self.values, tuple) else self.values

    def exists(self):
        return bool(self.values)

    def appendList(self, more):
        self.values += more

    def update(self, value):
        self.values = value

    def clear(self):
        self.values = []

    def registerTimer(self, at):
        pass


def test_held_rows_are_few_values_and_read_when_due():
    held = S.IpProcessor(300_000_000, True)
    held.handle, held.held, held.first = Kept(), Kept(), Kept()
    rows = [(True, [i * 1_000_000, i, 1, "u", "password"], "{}") for i in range(3000)]
    assert held._due(rows, -1) == [] and len(held.held.values) == 3
    assert held._due([], -1) == [] and held.held.reads == 0         # the first isn't due yet
    due = held._due([], 999_999)
    assert len(due) == 1000 and held.held.reads == 1
    assert sorted(r[1][1] for r in due + held._due([], 10 ** 9)) == [*range(3000)] and not held.held.values and not held.first.exists()


def test_segments_are_written_by_all_tasks(spark, tmp_path):
    df = spark.createDataFrame([(i, T0 + dt.timedelta(seconds=i)) for i in range(100)], "event_id long, event_time timestamp").repartition(4)
    C.write_segments(df, "event_time", str(tmp_path / "in"), n=2)
    files = [[f for f in os.listdir(tmp_path / "in" / f"seg={k}") if f.endswith(".parquet")] for k in range(2)]
    assert min(map(len, files)) > 1
    assert [sorted(r.event_id for r in spark.read.parquet(str(tmp_path / "in" / f"seg={k}")).collect()) for k in range(2)] == [[*range(50)], [*range(50, 100)]]


def test_answers_of_many_rows_are_few_rows():
    ip = S.IpProcessor(300_000_000, False)
    ip.handle, ip.own, ip.slices = Kept(), Kept(), Kept()
    ip.slices.updateValue = lambda name, value: None
    rows = [("10.0.0.1", T0, json.dumps({"a": i * 1_000_000, "b": i, "c": 1, "d": "u", "e": "password"}) + "\n" + json.dumps({"event_id": i}), ) for i in range(3000)]
    out = list(ip.handleInputRows(("10.0.0.1",), iter(rows), type("Now", (), {"getCurrentWatermarkInMs": lambda self: 0})()))
    assert len(out) == 3 and [json.loads(x)["event_id"] for r in out for x in r.rests] == [*range(3000)]
    assert [m[0] for r in out for m in json.loads(r.measures)] == [min(i + 1, 300) for i in range(3000)]
    assert out[0].wm_time.timestamp() == 1023


def test_state_lies_in_partitions_by_core(spark):
    name = "spark.sql.shuffle.partitions"
    given = spark.conf.get(name)
    try:
        spark.conf.set(name, 600)
        with S.state_partitions(spark):
            assert int(spark.conf.get(name)) == S.STATE_TASKS * spark.sparkContext.defaultParallelism
        assert spark.conf.get(name) == "600"
    finally:
        spark.conf.set(name, given)


def test_batches_without_actions_write_no_reports(spark, cycle, tmp_path):
    """A batch that only moves the watermark commits the numbers of the one before."""
    p, m, phases, _ = cycle
    logs, out = str(tmp_path / "logs"), str(tmp_path / "out")
    patterns = FX.grow_logs(phases.where("phase = 0"), logs)
    q = ST.detection_stream(spark, patterns, m, out, p, trigger={"processingTime": "0 seconds"}, hold=FX.hold_file(logs))
    q.processAllAvailable()
    q.stop()
    assert {f for f in os.listdir(f"{out}/commits") if f.startswith("batch=")} == {"batch=-1", "batch=0", "batch=1"}
    assert [f for f in os.listdir(f"{out}/reports/json") if f.startswith("batch=")] == ["batch=0"]
    last = ST.last_numbers(spark, out, 2)
    assert last.exceptAll(ST.last_numbers(spark, out, 1)).count() == 0 and last.count() > 0
