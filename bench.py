"""Benchmark the headline queries; prints one JSON line.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Each query is fully executed with the ``noop`` sink (no collect); times are
wall-clock seconds of a warm session (one untimed warm-up run of the feature
plan first, so JVM start and code generation are not billed to one query).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from authlytics.operators import features as FE  # noqa: E402
from authlytics.operators import response as RS  # noqa: E402
from authlytics.params import Params  # noqa: E402
from authlytics.plans import catalog as C  # noqa: E402
from authlytics.plans import pipelines as PL  # noqa: E402
from authlytics.session import get_spark, scratch_path  # noqa: E402
from authlytics.sources import fixtures as FX  # noqa: E402
from authlytics.streaming.state import streaming_features  # noqa: E402


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = get_spark(f"local[{cpus}]", max(cpus, 8))
    p = Params()                      # production window: 5 minutes
    n_events = FX.read_table(spark, sf_dir, "events").count()

    run(FE.extract_features(FX.auth_events(spark, sf_dir), p))   # warm-up

    times: dict[str, float] = {}

    def timed(name, fn):
        t = time.time()
        fn()
        times[name] = round(time.time() - t, 3)

    timed("parse_all_sources", lambda: run(C.parsed_df(spark, sf_dir)))
    timed("features_5min", lambda: run(FE.extract_features(FX.auth_events(spark, sf_dir), p)))
    timed("features_7d", lambda: run(C.features_df(spark, sf_dir)))
    timed("features_5min_frame", lambda: run(FE.extract_features(FX.auth_events(spark, sf_dir),
                                                                  p.with_(window_method="frame"))))
    # the same events eight times over, each copy with addresses and users of its own
    copies = FX.auth_events(spark, sf_dir).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(7))))
    for c in ("source_ip", "username"):
        copies = copies.withColumn(c, F.concat(F.col(c), F.lit("-"), F.col("c").cast("string")))
    copies = copies.withColumn("event_id", F.col("event_id") * 8 + F.col("c")).drop("c")
    timed("features_5min_x8", lambda: run(FE.extract_features(copies, p)))
    # one address and one user have all events, 30 ms apart: one bucket in one task, and in blocks
    one = FX.auth_events(spark, sf_dir).withColumns({
        "source_ip": F.lit("10.0.0.1"), "username": F.lit("root"), "event_time": F.timestamp_millis(F.lit(1_704_067_200_000) + F.col("event_id") * 30)})
    timed("features_one_key", lambda: run(FE.extract_features(one, p)))
    timed("features_one_key_blocks", lambda: run(FE.extract_features(one, p.with_(hot_rows=10_000))))
    dense = one.select("event_id", F.lit(0).alias("seq"), F.lit("block_ip").alias("action_type"), F.lit("10.0.0.1").alias("target"), "event_time")
    timed("cooldown_one_key", lambda: run(RS.apply_cooldown(dense, p.with_(enable_actions=True, cooldowns={"block_ip": 1}))))
    holder = {}
    timed("train_forest", lambda: holder.update(model=PL.train(
        spark, FE.extract_features(FX.auth_events(spark, sf_dir), p), p, enforce_guard=False)))
    model = holder["model"]
    timed("score_detect", lambda: run(PL.score_features(
        FE.extract_features(FX.auth_events(spark, sf_dir), p), model, p)))
    timed("cycle_incidents", lambda: run(PL.cycle(spark, FX.auth_events(spark, sf_dir), model, p).incidents))
    timed("attack_rules", lambda: run(C.QUERIES["attack_rules"](spark, sf_dir)))
    timed("cooldown_all_actions", lambda: run(RS.apply_cooldown(
        C.actions_df(spark, sf_dir, C._QPX), C._QPX)))
    timed("report_text", lambda: run(C.QUERIES["rep_text"](spark, sf_dir)))
    timed("stream_features", lambda: run(C.QUERIES["stream_features"](spark, sf_dir)))
    # the same stream answered at once: seconds of each micro-batch (a fifth of the events)
    ev = FX.auth_events(spark, sf_dir).select(*C.ST.EVENT_COLS)
    root = C.write_segments(ev, "event_time", scratch_path(spark, "bench-stream"))
    out, ck, batches = scratch_path(spark, "bench-out"), scratch_path(spark, "bench-ck"), []
    for k in range(C.N_SEGMENTS):
        src = spark.readStream.schema(ev.schema).parquet(f"{root}/seg=[0-{k}]")
        q = (streaming_features(src, C.QP).writeStream.format("parquet").option("path", out).option("checkpointLocation", ck)
             .trigger(availableNow=True).start())
        q.awaitTermination()
        batches += [round(x["durationMs"]["triggerExecution"] / 1000, 2) for x in q.recentProgress]
    timed("ops_component_stats", lambda: run(C.QUERIES["ops_component_stats"](spark, sf_dir)))
    timed("ops_top_bottlenecks", lambda: run(C.QUERIES["ops_top_bottlenecks"](spark, sf_dir)))

    total = round(sum(times.values()), 3)
    rates = {k: round(n_events / v, 1) for k, v in times.items() if v > 0}
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", ""),
                      "events": n_events, "slope_x8": round(times["features_5min_x8"] / times["features_5min"], 2), "stream_batch_sec": batches, "events_per_sec": rates, "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
