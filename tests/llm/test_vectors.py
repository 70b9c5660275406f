from llm_fixtures import prepared, vocab  # noqa: F401
import numpy as np
import pandas as pd
import pytest
from authlytics.llm import topk as T
from authlytics.llm.ann import ann_search
from authlytics.llm.topk import accumulate, exact_topk
from pyspark.sql import functions as F


CASES = [(0, [1.0, 0.5]), (1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [1.0, 0.5]),
         (6, [0.0, 0.0]), (7, [1.0]), (7, [1.0]), (8, []), (20, [1.0, 0.5]), (40, [-3.0, 2.0]), (None, [1.0, 1.0])]
SCHEMA = "vec_id long, embedding array<double>, score string"


def frame(spark, rows=CASES):
    return spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)


def brute_topk(rows, k):
    ok = [(i, [int(np.floor(64 * c)) for c in v]) for i, v in rows if i is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)]
    out = []
    for i, q in ok:
        if i % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(q, v, strict=False)), j) for j, v in ok if j != i)[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("rows", [1 << 16, 3])
def test_topk(spark, monkeypatch, rows):
    monkeypatch.setattr(T, "ROWS", rows)
    got = exact_topk(frame(spark), F.col("vec_id") % 20 == 0, 4)
    assert sorted(map(tuple, got.select("query_id", "rank", "vec_id", "score").collect())) == brute_topk(CASES, 4)
    assert exact_topk(frame(spark, []), F.col("vec_id") % 20 == 0).count() == 0
    assert exact_topk(frame(spark), F.lit(False)).count() == 0


def test_topk_deals_a_hot_id_to_all_blocks(spark, monkeypatch):
    """The largest candidate group of a cell, read by a cell function put in its place."""
    monkeypatch.setattr(T, "ROWS", 500)
    rows = spark.range(4000).select(F.when(F.col("id") % 4 < 3, 7).otherwise(F.col("id")).alias("vec_id"), F.array(F.col("id") % 50 + 0.5).alias("embedding"))
    cells = []
    from pyspark.sql.pandas.group_ops import PandasCogroupedOps
    real = PandasCogroupedOps.applyInPandas

    def counted(self, cell, schema):
        count = lambda cands, queries: pd.DataFrame({"n": [len(cands)]})
        cells.extend(r.n for r in real(self, count, "n bigint").collect())
        return real(self, cell, schema)

    monkeypatch.setattr(PandasCogroupedOps, "applyInPandas", counted)
    got = exact_topk(rows, F.col("vec_id") == 7, 1).collect()
    assert sum(cells) == 4000 and max(cells) < 1000
    assert len(got) == 3001 and {r.vec_id for r in got} == {99}


def test_accumulate_is_exact():
    rng = np.random.default_rng(0)
    a, b = rng.integers(-40, 40, (200, 16)), rng.integers(-40, 40, (9, 16))
    a[rng.random(a.shape) < 0.7] = 0
    assert (accumulate(a, b) == a @ b.T).all()
    big = np.array([[1 << 30, 7]])
    assert accumulate(big, big)[0, 0] == (1 << 60) + 49


def test_topk_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    got = exact_topk(df, F.col("vec_id") % 20 == 0, 20)
    assert sorted(map(tuple, got.collect())) == brute_topk(rows, 20)


def test_neighbours_cases(spark):
    got = ann_search(frame(spark), F.col("vec_id") % 20 == 0, 3).orderBy("query_id", "rank").collect()
    near = {}
    for r in got:
        near.setdefault(r.query_id, []).append((r.vec_id, round(r.score, 6)))
    assert near[0] == [(5, 0.0), (20, 0.0), (7, 0.5)] and near[20] == [(0, 0.0), (5, 0.0), (7, 0.5)]
    assert [i for i, _ in near[40]] == [0, 5, 20]
    assert ann_search(frame(spark, []), F.lit(True)).count() == 0
    assert ann_search(frame(spark), F.lit(False)).count() == 0


def test_recall(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 16))
    x[500:1500] = x[7]                     # a very common vector
    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(3000), "embedding": list(x)}))
    got = ann_search(df, F.col("vec_id") % 100 == 0, 10, sample=1000, effort=3.0).toPandas()
    hits = []
    for q, g in got.groupby("query_id"):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        want = np.lexsort((np.arange(3000), d))[:10]
        g = g.sort_values("rank")
        assert np.allclose(d[g["vec_id"]], g["score"]) and list(g["rank"]) == list(range(1, 11))
        hits.append(len(set(want) & set(g["vec_id"])) / 10)
    assert len(hits) == 30 and np.mean(hits) >= 0.9


def brute_neighbours(rows, q, k):
    x = dict.fromkeys(rows)
    own = [v for i, v in x if i == q]
    near = {}
    for i, v in x:
        if i != q:
            d = min(float(np.sqrt(sum((a - b) ** 2 for a, b in zip(v, o, strict=True)))) for o in own)
            near[i] = min(d, near.get(i, d))
    return sorted((round(d, 6), i) for i, d in near.items())[:k]


@pytest.mark.parametrize("copies", ["every row twice", "one row twenty times", "one id with many vectors"])
def test_repeated_rows_take_one_place(spark, copies):
    rng = np.random.default_rng(3)
    rows = [(i, tuple(map(float, v))) for i, v in enumerate(rng.normal(size=(60, 4)))]
    if copies == "every row twice":
        rows += rows
    elif copies == "one row twenty times":
        rows += [rows[0]] * 19 + [rows[20]] * 19
    else:
        rows += [(59, tuple(c + 0.001 * n for c in rows[0][1])) for n in range(1, 31)]
    df = spark.createDataFrame([(i, list(v), "x") for i, v in rows], SCHEMA).repartition(4)
    got = {}
    for r in ann_search(df, F.col("vec_id") % 20 == 0, 10, effort=60.0).collect():
        got.setdefault(r.query_id, set()).add((r["rank"], round(r.score, 6), r.vec_id))
    assert got == {q: {(n + 1, *x) for n, x in enumerate(brute_neighbours(rows, q, 10))} for q in (0, 20, 40)}
