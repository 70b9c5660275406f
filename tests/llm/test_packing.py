from llm_fixtures import prepared, vocab  # noqa: F401
import bisect

import numpy as np
import pandas as pd
import pytest
from authlytics.llm.common import stored
from authlytics.llm.packing import _carry, best_fit_packing, cut, pack


def best_fit_decreasing(sizes, capacity):
    gaps, n = [], 0
    for x in sorted(sizes, reverse=True):
        i = bisect.bisect_left(gaps, x)
        if i == len(gaps):
            n, gap = n + 1, capacity
        else:
            gap = gaps.pop(i)
        if gap > x:
            bisect.insort(gaps, gap - x)
    return n


def check(rows, capacity):
    rows = rows.sort_values(["sequence_id", "offset"])
    sums = rows.groupby("sequence_id")["size"].cumsum()
    assert (sums - rows["size"] == rows["offset"]).all() and (sums <= capacity).all()
    return rows["sequence_id"].nunique()


RNG = np.random.default_rng(5)


@pytest.mark.parametrize("sizes", [RNG.integers(1, 60, 3000), np.concatenate([RNG.integers(1, 2049, 800), np.full(600, 700)]),
                                   np.full(500, 1), np.array([2048, 1024, 1024, 1])], ids=["short", "mixed", "ones", "exact"])
def test_against_sequential_best_fit(spark, sizes):
    df = spark.createDataFrame(pd.DataFrame({"uid": np.arange(len(sizes)), "size": sizes.astype(np.int32)}))
    got = pack(stored(df, "t")).toPandas().merge(pd.DataFrame({"uid": np.arange(len(sizes)), "size": sizes}), on="uid")
    assert len(got) == len(sizes)
    assert check(got, 2048) <= 1.02 * best_fit_decreasing(sizes.tolist(), 2048) + 1


def test_carry_is_one_sweep_over_all_ranges():
    assert _carry([(0, 0, 3), (1, 2, 2), (2, 3, 0)]) == [(1, 0, 2, 0, 2), (2, 0, 2, 1, 1), (2, 2, 1, 0, 0)]
    assert _carry([]) == [] and _carry([(0, 5, 0)]) == []


def test_cut():
    assert cut(5, 2) == [(0, 1), (1, 2), (3, 2)] and cut(4, 2) == [(0, 2), (2, 2)] and cut(0, 2) == []


def test_operator_cases(spark, vocab):
    df = spark.createDataFrame([(1, None, 9), (1, "a b c", 9), (1, "a b c", 9), (None, "x " * 50, 9)], "doc_id long, text string, size int")
    got = best_fit_packing(df, vocab, capacity=16).toPandas()
    assert check(got.rename(columns={"length": "size"}), 16) == -(-got["length"].sum() // 16)
    assert sorted(got["length"][got["doc_id"] == 1]) == [1, 4, 4]
    assert best_fit_packing(df.limit(0), vocab).count() == 0
