"""Isolation Forest: determinism, depth limit, planted outliers, exact quantile."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from authlytics.operators import forest as FO
from authlytics.params import Params


def _data(spark, n=3000, outliers=30):
    rng = np.random.default_rng(1)
    X = rng.normal(0, 1, size=(n, 3))
    X[:outliers] += 8.0
    rows = [(int(i), *map(float, X[i])) for i in range(n)]
    return spark.createDataFrame(rows, "id long, a double, b double, c double")


def test_forest_deterministic_and_planted_outliers(spark):
    df = _data(spark)
    p = Params(n_trees=50)
    m1 = FO.fit_forest(spark, df, "id", ["a", "b", "c"], df.count(), p)
    m2 = FO.fit_forest(spark, df, "id", ["a", "b", "c"], df.count(), p)
    assert m1.nodes.sort_values(["tree_id", "node_id"]).reset_index(drop=True).equals(
        m2.nodes.sort_values(["tree_id", "node_id"]).reset_index(drop=True))
    assert m1.nodes["depth"].max() <= 8
    s = FO.score(df, m1, ["a", "b", "c"])
    top = s.orderBy("raw_score").limit(300).where("id < 30").count()
    assert top == 30          # all planted outliers in the lowest decile
    assert s.agg(F.max("raw_score")).first()[0] < 0


def test_exact_quantile_matches_numpy(spark):
    rng = np.random.default_rng(3)
    v = np.concatenate([rng.normal(size=50000), np.full(5000, 0.25)])
    df = spark.createDataFrame([(float(x),) for x in v], "v double")
    for q in (0.1, 0.5, 0.9):
        for accuracy in (64, 100_000):
            got = FO.exact_quantile(df, "v", q, accuracy)
            assert abs(got - float(np.percentile(v, 100 * q))) < 1e-12
    assert FO.exact_quantile(df.limit(0), "v", 0.5) is None
    assert FO.exact_quantile(df.limit(1), "v", 0.5) == float(v[0])


def test_moments_merge(spark):
    df = _data(spark, 1000)
    parts = [df.where(f"id % 3 = {k}") for k in range(3)] + [df.limit(0)]
    states = FO.moments(parts[0], ["a", "b", "c"])
    for x in parts[1:]:
        states = states.unionByName(FO.moments(x, ["a", "b", "c"]))
    merged = FO.scaler_of(FO.merged_moments(states), ["a", "b", "c"])
    assert np.allclose(merged, FO.fit_scaler(df, ["a", "b", "c"]), atol=1e-12)


def test_forest_does_not_depend_on_order_or_partitions(spark):
    df, p = _data(spark, 800), Params(n_trees=10)
    one, other = (FO.fit_forest(spark, x, "id", ["a", "b", "c"], 800, p).nodes for x in (df.coalesce(1), df.repartition(7).orderBy(F.rand(4))))
    key = ["tree_id", "node_id"]
    assert one.sort_values(key).reset_index(drop=True).equals(other.sort_values(key).reset_index(drop=True))


def test_scoring_looks_path_lengths_up(monkeypatch):
    """By node, once a forest: not again for every row. A missing value goes to the right."""
    names = ("a", "b")
    nodes = pd.DataFrame([(t, 1, t % 2, 0.5, 2, 3, 0, 9) for t in range(4)] + [(t, k, -1, 0.0, -1, -1, 1, 3 * k - 3) for t in range(4) for k in (2, 3)],
                         columns=[f.name for f in FO.NODE_SCHEMA.fields])
    trees = FO.ForestModel(nodes, 9, 4, names).arrays()
    asked, c = [], FO.avg_path_length
    monkeypatch.setattr(FO, "avg_path_length", lambda n: asked.append(np.size(n)) or c(n))
    X = np.array([[0.0, 0.0], [0.0, 1.0], [1.0, 0.0], [np.nan, 1.0]] * 50)
    got = FO._score_batch(X, trees, 9)
    low, high = 1 + c([3])[0], 1 + c([6])[0]
    want = [-2.0 ** (-h / c([9])[0]) for h in (low, (low + high) / 2, (low + high) / 2, high)] * 50
    assert np.allclose(got, want, rtol=0, atol=1e-15) and sum(asked) == 1
