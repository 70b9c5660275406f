"""Isolation Forest as Spark jobs (Liu, Ting, Zhou 2008).

Randomness is counter-based: every draw is a hash of seed, tree and row or node (52 bits of
an MD5), so the forest is a function of the rows, whatever their order or partitioning, and
SQL can restate it.

* sampling: a draw per (row, tree) keeps a row in a tree's sample with probability
  ``min(1, 1.5 psi / n)``; a first draw per row keeps only rows that can land in
  any tree, so the per-tree hashing touches about ``1.5 psi T`` rows, not ``n T``. The
  ``psi`` rows of the least second draw stay.
* fit: ``groupBy(tree_id).applyInPandas`` builds one tree per group (at most about 1.5 psi
  rows each) -> node table. Nodes are numbered as in a heap (root 1, children 2i and 2i+1); a
  node splits on the feature of the least draw among those that vary in it, at a drawn
  share of their range.
* score: the node table (at most T * (2^(d+1) - 1) rows) is a broadcast variable, traversal
  is vectorised over an Arrow batch.
* offset: the contamination quantile of the training scores, exact, in two passes: a
  mergeable sketch brackets the ranks, then the values in the bracket are counted.

Scores follow the paper / scikit-learn convention: ``score_samples`` is
``-2^(-E[h(x)] / c(psi))`` in [-1, 0), lower = more anomalous.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import constants as K
from ..params import Params

NODE_SCHEMA = T.StructType([
    T.StructField("tree_id", T.IntegerType()),
    T.StructField("node_id", T.IntegerType()),
    T.StructField("feature", T.IntegerType()),
    T.StructField("threshold", T.DoubleType()),
    T.StructField("left", T.IntegerType()),
    T.StructField("right", T.IntegerType()),
    T.StructField("depth", T.IntegerType()),
    T.StructField("n", T.IntegerType()),
])

DIGITS = 13
RANGE = float(1 << 4 * DIGITS)
EULER = 0.5772156649


def avg_path_length(n):
    """c(n): average path length of an unsuccessful BST search."""
    n = np.asarray(n, dtype=np.float64)
    out = np.zeros_like(n)
    two = n == 2
    big = n > 2
    out[two] = 1.0
    out[big] = 2.0 * (np.log(n[big] - 1.0) + EULER) - 2.0 * (n[big] - 1.0) / n[big]
    return out


def _draw(*parts) -> F.Column:
    """A number in [0, 1) that depends on the parts alone."""
    text = F.concat_ws(":", *[F.lit(x) if isinstance(x, int) else x.cast("string") for x in parts])
    return F.conv(F.substring(F.md5(text), 1, DIGITS), 16, 10).cast("long") / F.lit(RANGE)


def _drawn(*parts) -> float:
    """``_draw`` of plain values."""
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:DIGITS], 16) / RANGE


def sample_rates(n_rows: int, p: Params) -> tuple[int, float, float]:
    """(rows of a tree's sample, share of rows in any sample's reach, share of those per tree)."""
    psi = min(p.max_samples, n_rows)
    p_tree = min(1.0, 1.5 * psi / max(n_rows, 1))
    q = min(1.0, p_tree * p.n_trees)
    return psi, q, p_tree / q


def draw_samples(X: DataFrame, key: str, n_rows: int, p: Params) -> DataFrame:
    """Rows of each tree's sample: (tree_id, draw, key, features...)."""
    _, q, r = sample_rates(n_rows, p)
    x = X.where(_draw(p.seed, F.col(key)) < F.lit(q)) if q < 1.0 else X
    trees = F.filter(F.sequence(F.lit(0), F.lit(p.n_trees - 1)),
                     lambda t: _draw(p.seed, t, F.col(key)) < F.lit(r))
    return (x.withColumn("tree_id", F.explode(trees))
             .withColumn("draw", _draw(p.seed + 1, F.col("tree_id"), F.col(key))))


def _build_tree(rows: np.ndarray, seed: int, tree: int, max_depth: int) -> list[tuple]:
    """(node, feature, threshold, depth, n) of every node."""
    out, todo = [], [(1, np.arange(len(rows)), 0)]
    while todo:
        node, idx, d = todo.pop()
        f, threshold = -1, 0.0
        if d < max_depth and len(idx) > 1:
            sub = rows[idx]
            lo, hi = sub.min(axis=0), sub.max(axis=0)
            vary = np.flatnonzero(hi > lo).tolist()
            if vary:
                f = min(vary, key=lambda k: (_drawn(seed, tree, node, k), k))
                threshold = float(lo[f] + _drawn(seed, tree, node) * (hi[f] - lo[f]))
                left = sub[:, f] <= threshold
                todo += [(2 * node, idx[left], d + 1), (2 * node + 1, idx[~left], d + 1)]
        out.append((node, f, threshold, d, len(idx)))
    return sorted(out)


def make_tree_builder(feature_cols, psi: int, max_depth: int, seed: int):
    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        tree_id = int(pdf["tree_id"].iloc[0])
        pdf = pdf.sort_values(["draw", "_key"], kind="mergesort").head(psi)
        rows = pdf[list(feature_cols)].to_numpy(dtype=np.float64)
        node, f, t, d, n = map(np.array, zip(*_build_tree(rows, seed, tree_id, max_depth)))
        inner = f >= 0
        return pd.DataFrame({"tree_id": tree_id, "node_id": node.astype(np.int32),
                             "feature": f.astype(np.int32), "threshold": t.astype(np.float64),
                             "left": np.where(inner, 2 * node, -1).astype(np.int32), "right": np.where(inner, 2 * node + 1, -1).astype(np.int32),
                             "depth": d.astype(np.int32), "n": n.astype(np.int32)})
    return build


@dataclass
class ForestModel:
    nodes: pd.DataFrame          # NODE_SCHEMA rows
    psi: int
    n_trees: int
    feature_names: tuple
    offset: float | None = None
    mean: tuple | None = None    # scaler: population mean / std per feature
    std: tuple | None = None

    def arrays(self):
        """Per tree, by node: feature, threshold, the left child (of a leaf: itself), what is to be
        added for the right one (of a leaf: 0), path length; and the tree's depth."""
        nd = self.nodes.sort_values(["tree_id", "node_id"])
        trees = []
        for _, g in nd.groupby("tree_id", sort=True):
            at, columns = g["node_id"].to_numpy(), []
            inner = g["feature"] >= 0
            for c, dtype in ((g["feature"].where(inner, 0), np.int64), (g["threshold"], np.float64), (g["left"].where(inner, g["node_id"]), np.int64),
                             ((g["right"] - g["left"]).where(inner, 0), np.int64), (g["depth"] + avg_path_length(g["n"]), np.float64)):
                column = np.zeros(int(at.max()) + 1, dtype)
                column[at] = c
                columns.append(column)
            trees.append((*columns, int(g["depth"].max())))
        return trees


def fit_forest(spark: SparkSession, Xs: DataFrame, key: str, feature_cols, n_rows: int, p: Params) -> ForestModel:
    psi = min(p.max_samples, n_rows)
    max_depth = int(math.ceil(math.log2(max(psi, 2))))
    samples = draw_samples(Xs.select(F.col(key).alias("_key"), *feature_cols), "_key", n_rows, p)
    nodes = (samples.groupBy("tree_id")
             .applyInPandas(make_tree_builder(feature_cols, psi, max_depth, p.seed), NODE_SCHEMA))
    # bounded by n_trees * (2^(max_depth+1) - 1) rows: the model itself
    pdf = nodes.toPandas()
    return ForestModel(nodes=pdf, psi=psi, n_trees=p.n_trees, feature_names=tuple(feature_cols))


def _score_batch(X: np.ndarray, trees, psi: int) -> np.ndarray:
    m = X.shape[0]
    total = np.zeros(m)
    rows, values = np.arange(m), X.T.ravel()
    for feat, thr, left, right, path, deep in trees:
        node, column = np.ones(m, dtype=np.int64), feat * m
        for _ in range(deep):
            beyond = ~(values.take(column.take(node) + rows) <= thr.take(node))
            node = left.take(node) + right.take(node) * beyond
        total += path.take(node)
    mean_h = total / len(trees)
    return -np.power(2.0, -mean_h / avg_path_length(np.array([psi]))[0])


def score(df: DataFrame, model: ForestModel, feature_cols, out_col: str = "raw_score") -> DataFrame:
    """Adds ``out_col`` (score_samples) to every row. Only the feature columns go to
    Python and one double comes back."""
    spark = df.sparkSession
    bc = spark.sparkContext.broadcast((model.arrays(), model.psi))

    @F.pandas_udf("double")
    def raw(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        trees, psi = bc.value
        for cols in batches:
            X = np.column_stack([c.to_numpy(dtype=np.float64) for c in cols])
            yield pd.Series(_score_batch(X, trees, psi) if len(X) else np.zeros(0))

    return df.withColumn(out_col, raw.asNondeterministic()(*[F.col(c) for c in feature_cols]))


# ------------------------------------------------------------------ exact quantile

def exact_quantile(df: DataFrame, col: str, q: float, accuracy: int = 100_000) -> float | None:
    """Linear-interpolated quantile (numpy / DuckDB ``quantile_cont``), exact.

    Two passes whatever the size: a mergeable sketch (``percentile_approx``, rank error at
    most n / accuracy) gives values on both sides of the wanted ranks; then the values
    between them are counted, those below as one number. What is left to order is about
    4 n / accuracy values. A sketch that misses the ranks would widen the bracket.
    """
    base = df.select(F.col(col).cast("double").alias("v")).where(F.col("v").isNotNull())
    reach = 2.0 / accuracy
    while True:
        bounds = F.percentile_approx("v", [max(0.0, q - reach), min(1.0, q + reach)], accuracy)
        n, found, lowest, highest = base.agg(F.count("v"), bounds, F.min("v"), F.max("v")).first()
        if not n:
            return None
        pos = q * (n - 1)
        k_lo, k_hi = int(math.floor(pos)), int(math.ceil(pos))
        a, b = (lowest, highest) if reach >= 1 else found
        # null stands for all values below the bracket, which sort first
        cells = base.where(F.col("v") <= F.lit(b)).groupBy(F.when(F.col("v") >= F.lit(a), F.col("v")).alias("v")).agg(F.count(F.lit(1)).alias("c"))
        cells = cells.withColumn("upto", F.sum("c").over(Window.orderBy(F.col("v").asc_nulls_first())))
        below, upto, v_lo, v_hi = cells.agg(
            F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("c"))), F.lit(0)), F.max("upto"),
            *[F.min(F.when(F.col("upto") > F.lit(k), F.col("v"))) for k in (k_lo, k_hi)]).first()
        if below <= k_lo and k_hi < upto:
            return v_lo + (v_hi - v_lo) * (pos - k_lo)
        reach *= 8


# ------------------------------------------------------------------ scaler

def fit_scaler(X: DataFrame, cols) -> tuple[tuple, tuple]:
    """Per-feature mean and population std, one aggregate (one row back)."""
    row = X.agg(*[F.avg(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(cols)],
                *[F.stddev_pop(F.col(c).cast("double")).alias(f"s{i}") for i, c in enumerate(cols)]).first()
    k = len(cols)
    mean = tuple(float(row[f"m{i}"] or 0.0) for i in range(k))
    std = tuple(float(row[f"s{i}"] or 0.0) for i in range(k))
    return mean, std


def moments(X: DataFrame, cols) -> DataFrame:
    """(feature, n, mean, m2) of each feature: a state that merges with others."""
    row = X.agg(*[F.struct(F.count(F.col(c)).alias("n"), F.avg(F.col(c).cast("double")).alias("mean"),
                           (F.var_pop(F.col(c).cast("double")) * F.count(F.col(c))).alias("m2")).alias(c) for c in cols])
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"{c}.n").alias("n"), F.col(f"{c}.mean").alias("mean"),
                                                   F.col(f"{c}.m2").alias("m2")) for c in cols])).alias("s")).select("s.*")


def merged_moments(states: DataFrame) -> DataFrame:
    """One state per feature from any number of them; empty ones say nothing."""
    some = states.where("n > 0")
    whole = some.groupBy("feature").agg(F.sum("n").alias("all_n"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("all_mean"))
    apart = F.col("mean") - F.col("all_mean")
    return (some.join(whole, "feature").groupBy("feature", F.col("all_n").alias("n"), F.col("all_mean").alias("mean"))
            .agg(F.sum(F.col("m2") + F.col("n") * apart * apart).alias("m2")))


def scaler_of(state: DataFrame, cols) -> tuple[tuple, tuple]:
    """(means, population stds) of a merged state: one row a feature."""
    by = {r["feature"]: (float(r["mean"]), math.sqrt(max(0.0, r["m2"]) / r["n"])) for r in state.collect()}
    return tuple(by.get(c, (0.0, 0.0))[0] for c in cols), tuple(by.get(c, (0.0, 0.0))[1] for c in cols)


def scaler_table(spark: SparkSession, cols, mean, std) -> DataFrame:
    return spark.createDataFrame([(c, m, s) for c, m, s in zip(cols, mean, std)],
                                 "feature string, mean double, std double")


def apply_scaler(X: DataFrame, cols, mean, std, suffix: str = "") -> DataFrame:
    """z-score with std 0 -> 1; the parameters are literals (one per feature)."""
    out = X
    for c, m, s in zip(cols, mean, std):
        s = s if s != 0 else 1.0
        out = out.withColumn(c + suffix, (F.col(c).cast("double") - F.lit(m)) / F.lit(s))
    return out


FEATURES = list(K.FEATURE_NAMES)
