"""Approximate nearest neighbours: a forest of random-projection trees.

Trees are built from a bounded sample (about ``SAMPLE`` rows): a node splits its points
half way between two centres found from two random points. Every row is then routed to
its leaf in every tree. A query walks all trees through one priority queue ordered by the
distance to the split planes crossed so far, and collects leaves until they hold
``EFFORT`` * rows^0.75 rows; the candidates are ranked again by exact distance in double
precision. The effort follows the table's size, since the share of rows near a query
falls more slowly than the table grows (measured recall: README).

The forest (trees * sample leaves * dimensions) is bounded by the sample and broadcast.
Equal vectors are one entry with its k + 1 smallest ids, which is all that a ranking by
distance and id can show, and equal queries are searched once; so a very common vector is
no hot leaf. Leaves next to each other in a tree form buckets of about ``BUCKET`` rows;
rows and queries meet per bucket.

Defined results: vectors that are null, zero, or hold null or non-finite components take
no part; shorter vectors are continued by zeros; neighbours are ids: one that is repeated,
with the same vector or with others, is a neighbour once, at the distance of its nearest
row, and takes one of the k places (the effort counts its rows with different vectors
one by one); rows with the query's id are never its neighbours; a
repeated query row is answered each time; ties go to the smaller id; no queries or no
candidates give no rows.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

SAMPLE = 1 << 15
TREES, LEAF_ROWS = 16, 32
EFFORT = 6.0
BUCKET = 1 << 14
SPLIT_SAMPLE, SPLIT_STEPS = 256, 4


@dataclass
class Tree:
    normal: np.ndarray     # split node x dimension
    offset: np.ndarray
    child: np.ndarray      # split node x (below, above); a leaf is -1 - its number
    rows: np.ndarray       # sample rows of each leaf, numbered in order

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each row of a matrix."""
        out = np.zeros(len(x), np.int32)
        todo = [(0 if len(self.offset) else -1, np.arange(len(x)))]
        while todo:
            node, at = todo.pop()
            if node < 0:
                out[at] = -1 - node
            elif len(at):
                above = x[at] @ self.normal[node] >= self.offset[node]
                todo += [(self.child[node, 0], at[~above]), (self.child[node, 1], at[above])]
        return out


def build_tree(x: np.ndarray, seed: int, leaf: int) -> Tree:
    rng = np.random.default_rng(seed)
    normal, offset, child, rows = [], [], [], []

    def split(at: np.ndarray) -> tuple | None:
        for _ in range(3):
            s = x[at if len(at) <= SPLIT_SAMPLE else rng.choice(at, SPLIT_SAMPLE)]
            a, b = s[rng.choice(len(s), 2, replace=False)]
            for _ in range(SPLIT_STEPS):
                near = ((s - a) ** 2).sum(1) < ((s - b) ** 2).sum(1)
                if near.all() or not near.any():
                    break
                a, b = s[near].mean(0), s[~near].mean(0)
            n = (a - b).astype(np.float32)
            if (size := np.linalg.norm(n)) > 0:
                n /= size
                o = np.float32((a + b) @ n / 2)
                above = x[at] @ n >= o
                if above.any() and not above.all():
                    return n, o, at[~above], at[above]
        return None

    def grow(at: np.ndarray) -> int:
        if len(at) <= leaf or (cut := split(at)) is None:
            rows.append(len(at))
            return -len(rows)
        me = len(offset)
        normal.append(cut[0])
        offset.append(cut[1])
        child.append(None)
        child[me] = (grow(cut[2]), grow(cut[3]))
        return me

    grow(np.arange(len(x)))
    d = x.shape[1]
    return Tree(np.array(normal, np.float32).reshape(-1, d), np.array(offset, np.float32), np.array(child, np.int32).reshape(-1, 2), np.array(rows))


def search(forest: list[Tree], q: np.ndarray, want: float, scale: float) -> list[tuple[int, int]]:
    """(tree, leaf) in the order of the shared queue, until they hold ``want`` rows."""
    heap = [(-np.inf, t, 0 if len(tree.offset) else -1) for t, tree in enumerate(forest)]
    heapq.heapify(heap)
    found, held = [], 0.0
    while heap and held < want:
        far, t, node = heapq.heappop(heap)
        tree = forest[t]
        while node >= 0:
            d = float(tree.normal[node] @ q) - float(tree.offset[node])
            near, other = tree.child[node][::-1] if d >= 0 else tree.child[node]
            heapq.heappush(heap, (max(far, abs(d)), t, int(other)))
            node = int(near)
        found.append((t, -1 - node))
        held += tree.rows[-1 - node] * scale
    return found


def _pack(m: np.ndarray) -> list[bytes]:
    return [r.tobytes() for r in np.ascontiguousarray(m, "<f8")]


def _unpack(s: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(s), "<f8").reshape(len(s), -1)


def _matrix(vectors: pd.Series, dim: int) -> np.ndarray:
    out = np.zeros((len(vectors), dim))
    for i, v in enumerate(vectors):
        out[i, :len(v)] = v
    return out


def entries(df: DataFrame, id: str, vector: str, k: int) -> DataFrame:
    """(v, ids): every different valid vector with its k smallest different ids, ascending.
    Repeated rows are dropped and each group is limited in the map tasks, so no group
    gathers more."""
    x = F.transform(vector, lambda c: c.cast("double"))
    ok = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(x, lambda c: c != 0)
    rows = df.where(F.col(id).isNotNull() & F.coalesce(ok, F.lit(False))).select(F.col(id).cast("long").alias("id"), x.alias("v")).distinct()
    nth = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    return (rows.withColumn("nth", nth).where(F.col("nth") <= k).groupBy("v")
            .agg(F.sort_array(F.collect_list("id")).alias("ids")))


def nearest_ids(d: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[float, int]]:
    """(distance, id) of the k nearest different ids of rows with distances ``d`` and
    arrays ``ids``, each at its smallest distance."""
    most = k
    while True:
        near = d <= np.partition(d, most - 1)[most - 1] if len(d) > most else np.ones(len(d), bool)
        best: dict[int, float] = {}
        for x, a in zip(d[near].tolist(), ids[near], strict=True):
            for i in a:
                best[int(i)] = min(x, best.get(int(i), x))
        if len(best) >= k or len(d) <= most:
            return heapq.nsmallest(k, ((x, i) for i, x in best.items()))
        most *= 4       # few ids have the nearest rows


def ann_search(df: DataFrame, is_query: Column, k: int = 10, id: str = "vec_id", vector: str = "embedding",
               trees: int = TREES, leaf_rows: int = LEAF_ROWS, effort: float = EFFORT, sample: int = SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for every row for which
    ``is_query`` holds; score is the Euclidean distance."""
    spark = df.sparkSession
    sc = spark.sparkContext
    rows = stored(entries(df, id, vector, k + 1), "ann-entries")
    asked = df.where(is_query)
    # every id of a query vector is needed to answer it: rows, not entries
    ask_rows = asked.select(F.col(id).cast("long").alias("query_id"), F.transform(vector, lambda c: c.cast("double")).alias("v"))
    asks = stored(entries(asked, id, vector, 1).select("v").withColumn("qid", F.monotonically_increasing_id()), "ann-queries")
    n, dim = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    share = min(1.0, sample / max(1, n))
    picked = rows.where(F.pmod(F.xxhash64("v"), F.lit(1 << 30)) < int(share * (1 << 30))).select("v").toPandas()["v"]
    points = sc.broadcast(_matrix(picked, dim).astype(np.float32))
    scale = max(1.0, n / max(1, len(picked)))
    leaf = max(2, int(leaf_rows / scale))

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for t in b["id"]:
                yield pd.DataFrame({"t": [t], "tree": [pickle.dumps(build_tree(points.value, int(t), leaf))]})

    grown = spark.range(trees).repartition(trees, "id").mapInPandas(build, "t bigint, tree binary").toPandas().sort_values("t")
    forest = [pickle.loads(t) for t in grown["tree"]]
    # leaves in order, cut into buckets of about BUCKET rows
    bucket = [(np.cumsum(t.rows) - t.rows) * scale // BUCKET for t in forest]
    model = sc.broadcast((forest, [b.astype(np.int32) for b in bucket]))
    want = effort * n ** 0.75

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forest, bucket = model.value
        for b in batches:
            if not len(b):
                continue
            m = _matrix(b["v"], dim)
            packed, near = _pack(m), m.astype(np.float32)
            for t, tree in enumerate(forest):
                at = tree.leaves(near)
                yield pd.DataFrame({"tree": t, "bucket": bucket[t][at], "leaf": at, "ids": b["ids"], "v": packed})

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forest, bucket = model.value
        for b in batches:
            m = _matrix(b["v"], dim)
            for qid, packed, q in zip(b["qid"], _pack(m), m.astype(np.float32), strict=True):
                to: dict[tuple[int, int], list[int]] = {}
                for t, leaf in search(forest, q, want, scale):
                    to.setdefault((t, int(bucket[t][leaf])), []).append(leaf)
                yield pd.DataFrame({"tree": [t for t, _ in to], "bucket": [x for _, x in to], "leaves": list(to.values()), "qid": qid, "v": [packed] * len(to)})

    def rank(held: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        out = {"qid": [], "vec_id": [], "score": []}
        if len(held) and len(asks):
            held = held.sort_values("leaf", kind="stable")
            leaf, m, ids = held["leaf"].to_numpy(), _unpack(held["v"]), held["ids"].to_numpy()
            for qid, leaves, q in zip(asks["qid"], asks["leaves"], _unpack(asks["v"]), strict=True):
                lo, hi = np.searchsorted(leaf, leaves, side="left"), np.searchsorted(leaf, leaves, side="right")
                at = np.concatenate([np.arange(a, b) for a, b in zip(lo, hi, strict=True)])
                d = m[at] - q
                d = np.sqrt(np.einsum("ij,ij->i", d, d))
                best = nearest_ids(d, ids[at], k + 1)
                out["qid"] += [qid] * len(best)
                out["vec_id"] += [i for _, i in best]
                out["score"] += [x for x, _ in best]
        return pd.DataFrame(out)

    held = rows.mapInPandas(route, "tree int, bucket int, leaf int, ids array<bigint>, v binary")
    probes = asks.repartition(max(1, sc.defaultParallelism * 2), "qid").mapInPandas(ask, "tree int, bucket int, leaves array<int>, qid bigint, v binary")
    found = held.groupBy("tree", "bucket").cogroup(probes.groupBy("tree", "bucket")).applyInPandas(rank, "qid bigint, vec_id bigint, score double")
    order = Window.partitionBy("qid").orderBy("score", "vec_id")
    best = (found.groupBy("qid", "vec_id").agg(F.min("score").alias("score")).withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)
            .groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("score", "vec_id"))).alias("near")))
    answers = asks.join(best, "qid").select("v", "near")
    mine = ask_rows.join(answers, "v").withColumn(
        "near", F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k))
    return mine.select("query_id", F.posexplode("near").alias("p", "x")).select(
        "query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))
