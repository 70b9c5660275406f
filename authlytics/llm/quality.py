"""Quality classifier trained by weak labels.

Overlapping heuristic labellers vote good, bad or abstain on a document. A two-class
model (how often each labeller casts each vote on bad and on good documents, which gives
its accuracy) is fitted by expectation-maximisation: posteriors from vote probabilities,
vote probabilities and the share of good documents from posteriors. The posteriors are the soft labels of a linear scorer over
hashed features: character-class 4-grams and binned text statistics.

Three passes over whole texts: the votes of all documents, summed per vote pattern (at
most 3^labellers patterns, whatever the corpus); the features of the training sample;
the scores of all documents. The sample is about ``SAMPLE`` documents, drawn row by row
whatever their ids and texts, so that repeated ids or rows have the share they have in the
corpus; it is the only bounded part: the accuracies come from all documents. Draws are
seeded per partition, so which rows a corpus over ``SAMPLE`` gives depends on how it is
split. No table of the corpus is shuffled.

Defined results: a text that is null or has no word is bad without a vote (posterior and
score 0, not kept). A score of just ``KEEP_FROM`` is kept. Repeated rows are judged each, all
alike. The result column takes the name it is given, which replaces a column of that name.
An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

#: Documents the linear scorer is fitted on, about.
SAMPLE = 20_000
SEED = 11
FEATURES = 1 << 12
KEEP_FROM = 0.5
EM_ROUNDS = 100
SMOOTHING = 1.0
#: A labeller is taken to call at most this share of good documents bad.
FALSE_ALARMS = 0.004
CHARS_AT_ONCE = 1 << 20

#: Text statistics, and the upper edges of the bins that the scorer sees.
STATS = ("words", "distinct", "repeats", "upper", "symbols", "lone", "short", "exclaims", "mean")
BINS = {
    "words": (3, 10, 20, 50, 200, 1000), "distinct": (0.05, 0.15, 0.3, 0.45, 0.55, 0.62, 0.7),
    "repeats": (0.01, 0.03, 0.06, 0.1, 0.3, 0.6), "upper": (0.03, 0.06, 0.1, 0.2, 0.3, 0.6),
    "symbols": (0.002, 0.01, 0.03, 0.05, 0.1, 0.2), "lone": (0.002, 0.01, 0.03, 0.05, 0.1, 0.3),
    "short": (0.05, 0.1, 0.15, 0.2, 0.45, 0.55, 0.7), "exclaims": (0.01, 0.05, 0.2, 0.5),
    "mean": (3, 3.5, 4.3, 6.2, 6.6, 7.2, 9),
}
#: Labellers: statistic, test of a bad text, test of a good one, fewest words to vote.
LABELLERS = (
    ("symbols", lambda x: x > 0.05, lambda x: False, 5),
    ("distinct", lambda x: x < 0.45, lambda x: x > 0.62, 20),
    ("repeats", lambda x: x > 0.08, lambda x: x < 0.03, 20),
    ("upper", lambda x: x > 0.30, lambda x: False, 5),
    ("short", lambda x: x < 0.10 or x > 0.60, lambda x: False, 20),
    ("exclaims", lambda x: x > 0.20, lambda x: False, 5),
    ("mean", lambda x: x > 6.8 or x < 3.5, lambda x: False, 20),
    ("lone", lambda x: x > 0.05, lambda x: False, 5),
)


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Class of every character: 0 space, 1 line end, 2 lower, 3 upper, 4 other letter,
    5 digit, 6 full stop or question mark, 7 exclamation mark, 8 other prose
    punctuation, 9 symbol."""
    out = np.full(0x110000, 9, np.uint8)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            out[i] = 2 if c.islower() else 3 if c.isupper() else 4
        elif c.isnumeric():
            out[i] = 5
        elif c.isspace():
            out[i] = 1 if c in "\n\r" else 0
    for chars, k in ((".?…", 6), ("!", 7), (",;:'\"-()’‘“”„«»–—¿¡", 8)):
        out[[ord(c) for c in chars]] = k
    return out


def _class_chunks(text: str) -> Iterator[np.ndarray]:
    """Character classes in chunks that overlap by three characters."""
    for k in range(0, max(1, len(text) - 3), CHARS_AT_ONCE):
        part = text[k:k + CHARS_AT_ONCE + 3]
        yield _classes()[np.frombuffer(part.encode("utf-32-le", "replace"), "<u4")]


def analyse(text: str | None) -> tuple[dict[str, float], np.ndarray] | None:
    """Statistics and the counts of the 16 character classes; None without a word."""
    words = (text or "").split()
    n = len(words)
    if not n:
        return None
    lens = np.fromiter(map(len, words), np.int64, n)
    classes = np.zeros(16, np.int64)
    for k, c in enumerate(_class_chunks(text)):
        c = c if k == 0 else c[3:]
        classes += np.bincount(c, minlength=16)
    lone = sum(1 for w in words if len(w) == 1 and not w.isalnum())
    chars = int(lens.sum())
    cased = int(classes[2] + classes[3])
    lettered = max(1, n - lone)
    stats = {"words": n, "distinct": len(set(words)) / n, "repeats": sum(map(eq, words, words[1:])) / max(1, n - 1),
             "upper": classes[3] / max(1, cased), "symbols": classes[9] / max(1, chars), "lone": lone / n,
             "short": (int((lens <= 3).sum()) - lone) / lettered, "exclaims": classes[7] / n,
             "mean": (chars - lone) / lettered}
    return stats, classes


def votes(stats: dict[str, float]) -> list[int]:
    """-1 bad, 1 good, 0 no vote, for each labeller."""
    return [0 if stats["words"] < least else -1 if bad(x := stats[name]) else 1 if good(x) else 0
            for name, bad, good, least in LABELLERS]


def pattern(v: list[int]) -> int:
    code = 0
    for x in reversed(v):
        code = code * 3 + x + 1
    return code


def unpattern(code: np.ndarray) -> np.ndarray:
    return (code[:, None] // 3 ** np.arange(len(LABELLERS))) % 3 - 1


def _hashed(tokens: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = tokens.astype(np.uint32) * np.uint32(0x9E3779B1)
        return ((h ^ h >> np.uint32(15)) * np.uint32(0x85EBCA6B) >> np.uint32(20)).astype(np.int64)


def features(text: str, stats: dict[str, float]) -> tuple[np.ndarray, np.ndarray]:
    """(ids, values): share of each hashed class 4-gram, and one feature per statistic."""
    counts = np.zeros(FEATURES, np.int64)
    for c in _class_chunks(text):
        c = c.astype(np.uint32)
        if len(c) > 3:
            counts += np.bincount(_hashed(c[:-3] << 12 | c[1:-2] << 8 | c[2:-1] << 4 | c[3:]), minlength=FEATURES)
    ids = np.flatnonzero(counts)
    bins = np.array([(k + 1) << 20 | int(np.searchsorted(BINS[s], stats[s])) for k, s in enumerate(STATS)])
    share = 10 * counts[ids] / max(1, counts.sum())
    return np.concatenate([ids, _hashed(bins)]), np.concatenate([share, np.ones(len(bins))])


@dataclass
class LabelModel:
    """How each labeller votes on bad and on good documents, and the share of good ones."""
    table: np.ndarray     # class (bad, good) x labeller x vote (-1, 0, 1): probability
    good: float

    @property
    def accuracy(self) -> np.ndarray:
        """Probability that a labeller is right when it votes."""
        bad, good = (1 - self.good) * self.table[0], self.good * self.table[1]
        return (bad[:, 0] + good[:, 2]) / (bad[:, 0] + good[:, 2] + bad[:, 2] + good[:, 0])

    def posterior(self, v: np.ndarray) -> np.ndarray:
        like = np.log(self.table)[:, np.arange(len(LABELLERS)), v + 1].sum(-1)
        logit = np.log(self.good / (1 - self.good)) + like[1] - like[0]
        return 1 / (1 + np.exp(-np.clip(logit, -50, 50)))


def fit_labellers(codes: np.ndarray, counts: np.ndarray) -> LabelModel:
    """Expectation-maximisation over vote patterns and how often each occurs. It starts
    from the belief that a document with a bad vote is bad with probability 0.8, one
    without 0.05; counts are smoothed, so a labeller that never votes says nothing.
    ``FALSE_ALARMS`` keeps a rare kind of bad document from passing for good ones."""
    v = unpattern(codes)
    p = np.where((v < 0).any(1), 0.2, 0.95)
    hits = (v[:, :, None] == np.array([-1, 0, 1])).astype(float)
    model = None
    for _ in range(EM_ROUNDS):
        weight = np.stack([counts * (1 - p), counts * p])
        n = np.einsum("cp,plv->clv", weight, hits) + SMOOTHING
        total = weight.sum(1) + SMOOTHING
        n[1, :, 0] = np.minimum(n[1, :, 0], FALSE_ALARMS * n[1].sum(1))
        model = LabelModel(n / n.sum(2, keepdims=True), float(total[1] / total.sum()))
        new = model.posterior(v)
        done = len(p) == 0 or np.abs(new - p).max() < 1e-6
        p = new
        if done:
            break
    return model


def fit_linear(ids: list[np.ndarray], values: list[np.ndarray], target: np.ndarray,
               rounds: int = 150, rate: float = 0.05, decay: float = 1e-5) -> np.ndarray:
    """Logistic regression on soft labels (Adam, whole sample a step); the last weight
    is the intercept."""
    w, m, s = (np.zeros(FEATURES + 1) for _ in range(3))
    if not ids:
        return w
    flat, val = np.concatenate(ids), np.concatenate(values)
    row = np.repeat(np.arange(len(ids)), [len(i) for i in ids])
    for k in range(1, rounds + 1):
        z = np.bincount(row, w[flat] * val, len(ids)) + w[-1]
        err = (1 / (1 + np.exp(-z)) - target) / len(ids)
        g = np.bincount(flat, err[row] * val, FEATURES + 1) + decay * w
        g[-1] = err.sum()
        m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
        w = w - rate * (m / (1 - 0.9 ** k)) / (np.sqrt(s / (1 - 0.99 ** k)) + 1e-9)
    return w


@dataclass
class QualityModel:
    labels: LabelModel
    weights: np.ndarray

    def judge(self, text: str | None) -> tuple[float, float]:
        """(posterior of the weak label, score of the linear scorer), of being good."""
        if (a := analyse(text)) is None:
            return 0.0, 0.0
        ids, values = features(text, a[0])
        z = float(self.weights[ids] @ values + self.weights[-1])
        return float(self.labels.posterior(np.array(votes(a[0])))), float(1 / (1 + np.exp(-np.clip(z, -50, 50))))


def pattern_column(text: str | Column) -> Column:
    """The vote pattern as an int; null where there is no word."""

    @arrow_udf("int")
    def codes(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([pattern(votes(a[0])) if (a := analyse(t)) else None for t in texts.to_pylist()], pa.int32())

    return codes.asNondeterministic()(text)


def _features_column(text: Column) -> Column:
    @arrow_udf("struct<code:int,ids:array<int>,vals:array<double>>")
    def extract(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            codes, ids, vals = [], [], []
            for t in texts.to_pylist():
                a = analyse(t)
                f = features(t, a[0]) if a else (None, None)
                codes.append(pattern(votes(a[0])) if a else None)
                ids.append(f[0])
                vals.append(f[1])
            yield pa.StructArray.from_arrays([pa.array(codes, pa.int32()), pa.array(ids, pa.list_(pa.int32())),
                                              pa.array(vals, pa.list_(pa.float64()))], names=["code", "ids", "vals"])

    return extract.asNondeterministic()(text)


def training_sample(docs: DataFrame, n: float, sample: int = SAMPLE) -> DataFrame:
    """About ``sample`` of ``docs``, of which ``n`` count. Each row is drawn by itself: a
    hash of its values would take or leave all equal rows at once."""
    return docs.where(F.rand(SEED) < min(1.0, sample / max(1.0, n)))


def fit_quality(docs: DataFrame, id: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> QualityModel:
    """The model of ``docs``; ``id`` plays no part in it."""
    found = (docs.select(pattern_column(F.col(text)).alias("code")).where("code is not null")
             .groupBy("code").count().toPandas())
    codes, counts = found["code"].to_numpy(np.int64), found["count"].to_numpy(float)
    labels = fit_labellers(codes, counts)
    rows = (training_sample(docs, counts.sum(), sample).select(_features_column(F.col(text)).alias("f"))
            .where("f.code is not null").select("f.*").toPandas())
    target = labels.posterior(unpattern(rows["code"].to_numpy(np.int64)))
    weights = fit_linear([np.asarray(x, np.int64) for x in rows["ids"]], [np.asarray(x) for x in rows["vals"]], target)
    return QualityModel(labels, weights)


def quality_column(docs: DataFrame, model: QualityModel, text: str | Column = "text") -> Column:
    shared = docs.sparkSession.sparkContext.broadcast((model.labels.table, model.labels.good, model.weights))

    @arrow_udf("struct<weak_label:double,score:double>")
    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        votes_by_class, good, weights = shared.value
        m = QualityModel(LabelModel(votes_by_class, good), weights)
        for texts in batches:
            found = [m.judge(t) for t in texts.to_pylist()]
            yield pa.StructArray.from_arrays([pa.array([x[i] for x in found], pa.float64()) for i in range(2)],
                                             names=["weak_label", "score"])

    return judge.asNondeterministic()(text)


def classify_quality(docs: DataFrame, id: str = "doc_id", text: str = "text", sample: int = SAMPLE, into: str = "__quality") -> DataFrame:
    """``docs`` with column __quality, or as named: weak_label, score (both 0 to 1, of being good)."""
    model = fit_quality(docs, id, text, sample)
    return docs.withColumn(into, quality_column(docs, model, F.col(text)))
