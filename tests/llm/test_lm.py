import zlib
from collections import Counter
from math import isclose, log2, log10

import numpy as np
import pytest
from authlytics.llm.lm import ADD, CLASSES, GRID, _Numbers, choose_weights, cut_blocks, fit, pack, score_documents, unpack
from authlytics.llm.queries import QUERIES
from llm_fixtures import prepared  # noqa: F401
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


class Brute:
    """The model with dictionaries and plain loops."""

    def __init__(self, texts, order):
        self.order, self.c = order, Counter()
        self.texts = [self.tokens(t) for t in texts]
        for t in self.texts:
            for k in range(1, order + 1):
                self.c.update(tuple(t[i - k + 1:i + 1]) for i in range(k - 1, len(t)))
        self.n = sum(len(t) - 1 for t in self.texts)
        self.v = sum(len(g) == 1 for g in self.c) - bool(self.texts)
        self.weights = []
        for k in range(2, order + 1):
            sums = np.zeros((CLASSES, len(GRID)))
            for t in self.texts:
                for i in range(k - 1, len(t)):
                    g = tuple(t[i - k + 1:i + 1])
                    h = self.c[g[:-1]] - 1
                    if h > 0:
                        lower = self.p(g[1:], 1)
                        sums[int(log2(h))] += np.log10((self.c[g] - 1 + GRID * lower) / (h + GRID))
            self.weights.append(choose_weights(sums))

    @staticmethod
    def tokens(text):
        return ["<s>", *(text or "").encode().lower().split(), "</s>"]

    def p(self, g, out=0):
        """Probability of the last token after the others, ``out`` occurrences left out."""
        if len(g) == 1:
            return (self.c[g] - out + ADD) / (self.n - out + ADD * (self.v + 1))
        lower, h = self.p(g[1:], out), self.c[g[:-1]] - out
        if h <= 0:
            return lower
        m = self.weights[len(g) - 2][int(log2(h))]
        return (self.c[g] - out + m * lower) / (h + m)

    def score(self, text):
        t = self.tokens(text)
        return sum(log10(self.p(tuple(t[max(0, i - self.order + 1):i + 1]))) for i in range(1, len(t)))

    def base(self, text):
        return sum(log10(self.p((w,))) for w in self.tokens(text)[1:])


def check(got, rows, order, learned):
    b = Brute([t for i, t in rows if learned(i)], order)
    assert len(got) == len(rows)
    want = sorted((str(i), len(b.tokens(t)) - 1, sum(b.c[(w,)] > 0 for w in b.tokens(t)[1:]), round(b.base(t), 6), round(b.score(t), 6)) for i, t in rows)
    have = sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in got)
    for x, y in zip(want, have, strict=True):
        assert x[:3] == y[:3] and isclose(x[3], y[3], abs_tol=2e-6) and isclose(x[4], y[4], abs_tol=2e-6), (x, y)
    assert all(r.train_tokens == b.n for r in got)
    return b


def test_pack():
    for a in (np.arange(1000, dtype=np.uint64) ** 3, np.empty(0, np.int64), np.array([5], np.uint32)):
        assert (unpack(pack(a), a.dtype.type) == a).all() and unpack(pack(a), a.dtype.type).dtype == a.dtype
    assert [_Numbers()[b"x"], choose_weights(np.zeros((CLASSES, len(GRID))))[0]] == [0, GRID[len(GRID) // 2]]


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_against_brute_force(spark, order):
    rows = [(r.doc_id, r.text[:1500]) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    rows += [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "A a\x0bA é É a"), (1003, "A a\x0bA é É a"), (None, "the end begin end"), (1004, "the of " * 2000)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, learn string, n int").repartition(5)
    learn = F.crc32(F.col("doc_id").cast("string")) % 4 != 0
    got = score_documents(df, learn, order=order, block_tokens=3000, bucket=5000).collect()
    b = check(got, rows, order, lambda i: i is not None and zlib.crc32(str(i).encode()) % 4 != 0)
    if order == 3:                      # a probability for every kind and one for all others
        kinds = [g for g in b.c if len(g) == 1 and g != ("<s>",)] + [("unseen",)]
        for h in [("<s>",), (b"the", b"of"), (b"nowhere",), (b"a", b"a")]:
            assert isclose(sum(b.p(h + w) for w in kinds), 1, abs_tol=1e-9)


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = QUERIES["op13_lm_scoring"](spark, SF).collect()
    check(got, rows, 2, lambda i: zlib.crc32(str(i).encode()) % 10 != 0)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 10 == 0) for r in got)


def test_better_than_single_tokens_on_held_out_documents(spark):
    got = QUERIES["op13_lm_scoring"](spark, "/root/testdata/sf0.01").where("held_out").agg(
        F.sum("score").alias("s"), F.sum("base_score").alias("b"), F.sum("n_tokens").alias("n")).first()
    print(got.s / got.n, got.b / got.n)
    assert got.s > got.b


def test_edges(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id string, text string")
    none = score_documents(docs, F.lit(None).cast("boolean")).collect()
    assert [(r.score, r.base_score, r.n_known, r.train_tokens) for r in none] == [(0.0, 0.0, 0, 0)] * 2 and {r.doc_id for r in none} == {"1", "2"}
    assert score_documents(docs.limit(0), F.lit(True)).count() == 0
    model, joined = fit(cut_blocks(spark.createDataFrame([(i, "same words in every text") for i in range(500)], "doc_id long, text string"), "doc_id", "text", F.lit(True)))
    assert (model.tokens, model.kinds) == (3000, 6) and joined.count() >= 1
