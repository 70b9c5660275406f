"""Window features: golden scenarios, variant equality, skew layout, plan shape."""

import datetime as dt

from pyspark.sql import functions as F

from authlytics.operators import attack as AT
from authlytics.operators import features as FE
from authlytics.params import Params
from authlytics.sources import fixtures as FX

from conftest import SF

T0 = dt.datetime(2024, 1, 15, 12, 0, 0)
COLS = "event_id long, event_time timestamp, source_ip string, username string, auth_method string, event_type string, message string"


def _brute_force(spark):
    rows = [(i, T0 + dt.timedelta(seconds=2 * i), "203.0.113.99", f"u{i % 5}", "password", "login_failed",
             f"sshd[1]: Failed password for u{i % 5} from 203.0.113.99 port 1 ssh2") for i in range(50)]
    return spark.createDataFrame(rows, COLS)


def test_brute_force_scenario(spark):
    for method in ("delta", "frame"):
        f = FE.extract_features(_brute_force(spark), Params(window_method=method)).where("event_id = 49").first()
        assert f["ip_failed_logins"] == 50
        assert f["ip_unique_users_attempted"] == 5
        assert f["ip_failed_to_success_ratio"] == 1.0
        assert abs(f["ip_avg_inter_attempt_seconds"] - 2.0) < 1e-9
        assert abs(f["ip_auth_method_variance"] - 0.02) < 1e-12


def test_account_abuse_scenario(spark):
    rows = [(1, T0 - dt.timedelta(days=3), "10.1.1.1", "alice", "sudo", "sudo_success",
             "sudo: alice : TTY=pts/0 ; PWD=/ ; USER=root ; COMMAND=/bin/ls"),
            (2, T0, "198.51.100.45", "alice", "publickey", "login_success", "Accepted publickey for alice"),
            (3, T0 + dt.timedelta(seconds=5), None, "alice", "sudo", "sudo_success",
             "sudo: alice : TTY=pts/0 ; PWD=/home/alice ; USER=root ; COMMAND=/bin/bash")]
    f = {r["event_id"]: r for r in FE.extract_features(spark.createDataFrame(rows, COLS), Params()).collect()}
    assert f[2]["user_new_ip_detected"] is True
    assert f[3]["session_login_to_privesc_seconds"] == 5.0
    assert f[3]["user_first_sudo_usage"] is False
    assert f[1]["user_first_sudo_usage"] is True
    assert f[3]["session_lolbin_executed"] is True
    df = FE.extract_features(spark.createDataFrame(rows, COLS), Params())
    ids = {r["event_id"]: r["t"] for r in df.select("event_id", AT.technique_ids_from(df).alias("t")).collect()}
    assert ids[2][:2] == ["T1078", "T1078.001"]
    assert ids[3] == ["T1548", "T1548.003", "T1548", "T1059.004", "T1105"]


def test_delta_equals_frame_on_fixture(spark):
    ev = FX.auth_events(spark, SF)
    for w, b in ((300.0, 600.0), (86400.0, 86400.0)):
        a = FE.extract_features(ev, Params(window_seconds=w, bucket_seconds=b, window_method="delta"))
        c = FE.extract_features(ev, Params(window_seconds=w, bucket_seconds=b, window_method="frame"))
        cols = [x for x in a.columns if x != "event_time"]
        assert a.select(cols).exceptAll(c.select(cols)).count() == 0
        assert c.select(cols).exceptAll(a.select(cols)).count() == 0


def test_bucket_size_does_not_change_results(spark):
    """The (key, bucket) split with replicated tails must equal one bucket per key."""
    ev = FX.auth_events(spark, SF)
    w = 86400.0
    small = FE.extract_features(ev, Params(window_seconds=w, bucket_seconds=w))
    huge = FE.extract_features(ev, Params(window_seconds=w, bucket_seconds=400 * 86400.0))
    assert small.exceptAll(huge).count() == 0


def test_hot_ip_splits_across_buckets(spark):
    """One IP with a third of all rows: the window exchange is keyed by
    (ip, bucket), so the hot IP lands in many partitions."""
    rows = [(i, T0 + dt.timedelta(seconds=30 * i), "203.0.113.7" if i % 3 == 0 else f"10.0.{i % 50}.1",
             f"u{i % 7}", "password", "login_failed", "x") for i in range(3000)]
    ev = spark.createDataFrame(rows, COLS)
    prep = FE.prepare(ev, Params())
    n_keys = prep.where("ip = '203.0.113.7'").select("bkt").distinct().count()
    assert n_keys >= 8


def test_plan_has_two_row_exchanges(spark):
    df = FE.extract_features(FX.auth_events(spark, SF), Params())
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_COL") == 2          # (ip, bkt) and (ukey, bkt)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_null_keys_get_zero_features(spark):
    rows = [(1, T0, None, None, "exec", "process_execution", "Executed: /usr/bin/curl")]
    f = FE.extract_features(spark.createDataFrame(rows, COLS), Params()).first()
    assert f["ip_failed_logins"] == 0 and f["user_failed_sudo_attempts"] == 0
    assert f["user_new_ip_detected"] is False and f["session_lolbin_executed"] is True


def test_constant_login_hour_has_no_spread(spark):
    rows = [(i, T0 + dt.timedelta(days=i), "10.0.0.1", "bo", "password", "login_success", "x") for i in range(9)]
    f = FE.extract_features(spark.createDataFrame(rows, COLS), Params())
    assert {r[0] for r in f.select("user_login_time_std_devs").collect()} == {0.0}


def test_rows_without_time_are_rejects(spark):
    rows = [(1, T0, "10.0.0.1", "bo", "password", "login_failed", "x"), (2, None, "10.0.0.1", "bo", "password", "login_failed", "x")]
    ev = spark.createDataFrame(rows, COLS)
    assert [r["event_id"] for r in FE.extract_features(ev, Params()).collect()] == [1]
    assert [(r["event_id"], r["reason"]) for r in FE.rejects(ev).collect()] == [(2, "no event_time")]


def test_asn_lookup_keeps_every_row(spark):
    ips = spark.createDataFrame([(1, "10.0.0.5"), (2, "10.0.9.9"), (3, None), (4, "bad"), (5, "10.0.0.5"), (6, "10.0.0.200")], "event_id long, ip string")
    pre = spark.createDataFrame([(167772160, 167772415, "wide"), (167772160, 167772170, "narrow")], "lo long, hi long, asn string")
    got = {r["event_id"]: r["asn"] for r in FE.asn_lookup(ips, pre).collect()}
    assert got == {1: "narrow", 2: None, 3: None, 4: None, 5: "narrow", 6: "wide"}


def test_addresses_of_both_families(spark):
    rows = ["10.0.0.1", "255.255.255.255", "256.1.1.1", "1.2.3", "::1", "::", "2001:db8::8:800:200C:417A", "FF01:0:0:0:0:0:0:101", "1::2::3", "host", "", None, "1:2:3:4:5:6:7"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, ip string").select("i", FE.ip_to_hex(F.col("ip")).alias("h"))
    got = [r.h for r in df.orderBy("i").collect()]
    assert got == ["0" * 20 + "ffff0a000001", "0" * 20 + "ffffffffffff", None, None, "0" * 31 + "1", "0" * 32, "20010db80000000000080800200c417a",
                   "ff010000000000000000000000000101", None, None, None, None, None]


def test_ranges_become_blocks(spark):
    ranges = [(5, 21), (0, 0), (0, 2 ** 32 - 1), (7, 7), (2 ** 31, 2 ** 32 - 2)]
    df = spark.createDataFrame([(lo, hi, str(i)) for i, (lo, hi) in enumerate(ranges)], "lo long, hi long, asn string")
    by = {}
    for r in FE.prefix_blocks(df).collect():
        lo = int(r.address[24:], 16)
        assert lo % (1 << 128 - r.bits) == 0
        by.setdefault(int(r.asn), []).append((lo, lo + (1 << 128 - r.bits)))
    for i, (lo, hi) in enumerate(ranges):
        blocks = sorted(by[i])
        assert blocks[0][0] == lo and blocks[-1][1] == hi + 1 and all(a[1] == b[0] for a, b in zip(blocks, blocks[1:]))


def test_hot_keys_in_blocks(spark):
    """One address and two users have nearly all rows; blocks of a few rows give the same."""
    import random
    r = random.Random(9)
    kinds = ["login_failed", "login_success", "sudo_success", "sudo_failure", "process_execution"]
    t0 = dt.datetime(2024, 1, 15, 12)
    rows = [(i, t0 + dt.timedelta(seconds=r.choice([i // 3, i, 7 * i]) % 5000), r.choice(["9.9.9.9"] * 8 + [None, "1.1.1.1"]), r.choice(["root"] * 6 + ["eve"] * 3 + [None]),
             r.choice(["password", "publickey", None]), r.choice(kinds), r.choice(["COMMAND=/bin/bash", "useradd x", "line"])) for i in range(1500)]
    ev = spark.createDataFrame(rows, "event_id long, event_time timestamp, source_ip string, username string, auth_method string, event_type string, message string")
    p = Params()
    want = FE.extract_features(ev, p)
    for hot in (40, 400, 10 ** 6):
        got = FE.extract_features(ev, p.with_(hot_rows=hot)).select(want.columns)
        assert want.exceptAll(got).count() == 0 and got.count() == 1500
    prep = FE.prepare(ev, p)
    assert FE.BL.hot_buckets(prep, "ip", 40).count() >= 1
    assert hash(p) == hash(Params()) and p == Params() and len({p, Params(), p.with_(hot_rows=4)}) == 2


def test_blocks_are_stored_as_parquet(spark):
    df = spark.range(10).withColumn("t", F.lit(None).cast("string"))
    x = FE.BL.stored(df)
    assert x.inputFiles() and all(f.endswith(".parquet") for f in x.inputFiles())
    assert x.dtypes == df.dtypes and x.exceptAll(df).count() == 0


def test_exchanges_begin_with_many_partitions_and_without_the_message(spark):
    assert int(spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum")) >= 512
    plan = FE.extract_features(_brute_force(spark), Params())._jdf.queryExecution().optimizedPlan().toString()
    above = plan.split("RepartitionByExpression")
    assert len(above) == 3 and not any("message" in x.split("\n")[0] for x in above[1:]) and "message, message" not in plan


def test_tasks_of_an_exchange_read_a_bounded_size(spark):
    # 64 MB that don't compress: a share per core would be 16 MB
    x = spark.range(2_000_000).withColumn("x", F.unhex(F.sha2(F.col("id").cast("string"), 256)))
    parts = x.repartition("id").groupBy(F.spark_partition_id().alias("part")).agg(F.max("x"), F.count(F.lit(1)).alias("n")).collect()
    assert sum(r["n"] for r in parts) == 2_000_000 and max(r["n"] for r in parts) <= 300_000


def test_payload_rides_on_rows_with_output_only(spark):
    rows = [(1, 0, 0, False), (2, 90, 0, False), (3, 95, 0, True)]      # bucket of 100, window of 20: the last two reach the next
    x = spark.createDataFrame(rows, "event_id long, tus long, bkt long, hist boolean").withColumn("_p", F.struct("event_id", "tus"))
    got = sorted((r["event_id"], r["bkt"], r["emit"], r["_p"] and tuple(r["_p"])) for r in FE._with_replicas(x, 20, 100).collect())
    assert got == [(1, 0, True, (1, 0)), (2, 0, True, (2, 90)), (2, 1, False, None), (3, 0, False, None), (3, 1, False, None)]
