"""Summarise the physical plans of the headline queries (exchanges, joins,
windows, Python hops) from ``explain("formatted")``; writes docs/plans.md."""

from __future__ import annotations

import contextlib
import io
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from authlytics.operators import features as FE  # noqa: E402
from authlytics.params import Params  # noqa: E402
from authlytics.plans import catalog as C  # noqa: E402
from authlytics.session import get_spark  # noqa: E402
from authlytics.sources import fixtures as FX  # noqa: E402

KEEP = ("Exchange", "BroadcastExchange", "SortMergeJoin", "BroadcastHashJoin", "ShuffledHashJoin", "Window",
        "MapInPandas", "ArrowEvalPython", "FlatMapGroupsInPandas", "Generate", "HashAggregate", "TakeOrderedAndProject",
        "BroadcastNestedLoopJoin", "CartesianProduct")


def summary(df) -> list[str]:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    text = buf.getvalue()
    ops = [m.group(1) for m in re.finditer(r"^\(\d+\) (\w+)", text, re.M)]
    args = re.findall(r"^Arguments: (hashpartitioning\([^)]*\)[^\n]*|SinglePartition[^\n]*)", text, re.M)
    counts = {k: ops.count(k) for k in KEEP if ops.count(k)}
    parts = sorted({re.sub(r"#\d+L?", "", a.split(", ENSURE")[0].split(", REPARTITION")[0]) for a in args})
    scans = re.findall(r"ReadSchema: (struct<[^>]*>)", text)
    return [f"operators: {counts}", f"shuffle keys: {parts}", f"scan read schemas: {sorted(set(scans))}"]


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_spark("local[8]", 8)
    p = Params()
    model = C.trained_model(spark, sf, p)
    from authlytics.plans import pipelines as PL
    items = {
        "features (5 min, delta)": FE.extract_features(FX.auth_events(spark, sf), p),
        "features (5 min, frame)": FE.extract_features(FX.auth_events(spark, sf), p.with_(window_method="frame")),
        "features (5 min, hot buckets in blocks of 100)": FE.extract_features(FX.auth_events(spark, sf), p.with_(hot_rows=100, bucket_seconds=7 * 86400)),
        "new ASN (both families)": C.QUERIES["feat_user_new_asn_nested"](spark, sf),
        "parse all sources": C.parsed_df(spark, sf),
        "score + detect": PL.score_features(FE.extract_features(FX.auth_events(spark, sf), p), model, p),
        "cooldown": C.QUERIES["resp_cooldown"](spark, sf),
        "incidents (fixture score)": C.incidents_df(spark, sf),
        "ops top bottlenecks": C.QUERIES["ops_top_bottlenecks"](spark, sf),
        "ops component filter": C.QUERIES["ops_component_filter"](spark, sf),
    }
    out = ["# Physical plans of the headline queries", "",
           "Generated by `tools/plan_summary.py` from `explain(\"formatted\")` (AQE initial plans, sf0.01).", ""]
    for name, df in items.items():
        out.append(f"## {name}")
        out += [f"- {line}" for line in summary(df)]
        out.append("")
    open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "docs", "plans.md"), "w").write("\n".join(out))
    spark.stop()


if __name__ == "__main__":
    main()
