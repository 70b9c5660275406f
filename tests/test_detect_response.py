"""Mapping, detection expressions, response decisions, cooldown, reports."""

import datetime as dt

from pyspark.sql import functions as F

from authlytics.operators import attack as AT
from authlytics.operators import detect as DT
from authlytics.operators import report as RP
from authlytics.operators import response as RS
from authlytics.params import Params

T0 = dt.datetime(2024, 1, 15, 12, 0, 0)


def test_attack_rules_and_lookup(spark):
    df = spark.createDataFrame([("login_failed", 10), ("sudo_success", 0)], "event_type string, ip_failed_logins int")
    ids = [r[0] for r in df.select(AT.technique_ids_from(df)).collect()]
    assert "T1110" in ids[0] and "T1548" in ids[1]
    dim = AT.attack_dim(spark)
    assert dim.count() == 15
    look = AT.attack_lookup(spark.createDataFrame([("T1110",), ("T0000",)], "tid string"), "tid", dim)
    got = {r["tid"]: r["technique_name"] for r in look.collect()}
    assert got == {"T1110": "Brute Force", "T0000": None}


def test_risk_levels_monotone(spark):
    df = spark.range(101).select((F.col("id") / 100.0).alias("s"))
    lv = [r[0] for r in df.orderBy("s").select(DT.risk_level(F.col("s"))).collect()]
    order = ["NORMAL", "LOW", "MEDIUM", "HIGH", "CRITICAL"]
    assert [order.index(x) for x in lv] == sorted(order.index(x) for x in lv)
    assert DT.logistic  # range (0.5, 0.731] for scores in [-1, 0)


def test_decide_high(spark):
    a = spark.createDataFrame([(1, T0, "HIGH", 0.85, "login_failed", "203.0.113.99", "admin")],
                              "event_id long, event_time timestamp, risk_level string, anomaly_score double, "
                              "event_type string, source_ip string, username string")
    acts = [r["action_type"] for r in RS.decide(a).orderBy("seq").collect()]
    assert acts == ["alert_only", "block_ip", "lock_account"]


def test_cooldown_blocks_second_lock(spark):
    p = Params(enable_actions=True)
    rows = [(1, 0, "lock_account", "alice", T0), (2, 0, "lock_account", "alice", T0 + dt.timedelta(seconds=10)),
            (3, 0, "lock_account", "alice", T0 + dt.timedelta(seconds=400)),
            (4, 0, "lock_account", "alice", T0 + dt.timedelta(seconds=650))]
    df = spark.createDataFrame(rows, "event_id long, seq int, action_type string, target string, event_time timestamp")
    got = {r["event_id"]: r["allowed"] for r in RS.apply_cooldown(df, p).collect()}
    # greedy: 1 allowed; 2 within 300 s; 3 at +400 allowed; 4 at +650 (250 s after 3) blocked
    assert got == {1: True, 2: False, 3: True, 4: False}


def test_cooldown_gaps_property(spark):
    """Allowed actions of one key are at least the cooldown apart, and every
    blocked action is within the cooldown of the last allowed one."""
    import random
    rnd = random.Random(7)
    t, rows = 0, []
    for i in range(400):
        t += rnd.choice([5, 40, 120, 290, 301, 700])
        rows.append((i, 0, "alert_only", "bob", T0 + dt.timedelta(seconds=t)))
    df = spark.createDataFrame(rows, "event_id long, seq int, action_type string, target string, event_time timestamp")
    res = sorted((r["event_time"], r["allowed"]) for r in RS.apply_cooldown(df, Params()).collect())
    last = None
    for ts, ok in res:
        if ok:
            assert last is None or (ts - last).total_seconds() >= 300
            last = ts
        else:
            assert (ts - last).total_seconds() < 300


def test_incident_ids_per_day(spark):
    rows = [(i, T0 + dt.timedelta(hours=5 * i)) for i in range(10)]
    df = spark.createDataFrame(rows, "event_id long, event_time timestamp")
    ids = [r["incident_id"] for r in RP.incident_ids(df).orderBy("event_id").collect()]
    assert ids[0] == "INC-20240115-000001" and ids[1] == "INC-20240115-000002"
    assert ids[2] == "INC-20240115-000003" and ids[3] == "INC-20240116-000001" and ids[4] == "INC-20240116-000002"


def greedy(rows, wait, start=None):
    """Allowed (event_id, seq) of one key's (t, event_id, seq) rows."""
    last, out = start, set()
    for t, i, q in sorted(rows):
        if last is None or t >= last + wait:
            out.add((i, q))
            last = t
    return out


def test_cooldown_without_a_quiet_gap(spark):
    """One key, times closer than the cooldown all along, cut into many slices; another
    with ties; one with an anchor; a cooldown of zero."""
    import random
    r = random.Random(3)
    p = Params(enable_actions=True, cooldowns={"block_ip": 50, "lock_account": 7, "terminate_session": 0})
    rows, t = [], 0
    for i in range(3000):
        t += r.randrange(1, 9)
        rows.append((i, 0, "block_ip", "hot", t))
        rows.append((i, 1, "lock_account", "u", t // 5 * 5))
        rows.append((i, 2, "block_ip", "anchored", t))
        if i < 100:
            rows.append((i, 3, "terminate_session", "z", t // 20))
    df = spark.createDataFrame(rows, "event_id long, seq int, action_type string, target string, s long").withColumn("event_time", F.timestamp_seconds("s"))
    anchors = spark.createDataFrame([("block_ip", "anchored", 10_000_000)], "action_type string, target string, last_allowed_us long")
    for kw in ({"slice_rows": 10}, {"slice_rows": 100, "bucket_seconds": 60}, {}):
        got = {(x.event_id, x.seq) for x in RS.apply_cooldown(df, p, anchors=anchors, **kw).where("allowed").collect()}
        own = [(t, i, q) for i, q, _, _, t in rows]
        want = greedy([x for x in own if x[2] == 0], 50) | greedy([x for x in own if x[2] == 2], 50, 10)
        want |= greedy([(t // 5 * 5, i, q) for t, i, q in [x for x in own if x[2] == 1]], 7) | {(i, 3) for i in range(100)}
        assert got == want
