"""Scores of a backoff n-gram language model, learned from the documents themselves.

The model: of single tokens p(w) = (c(w) + ADD) / (N + ADD * (V + 1)), V known kinds and one
for all others; of longer n-grams p(w | h) = (c(hw) + m * p(w | h')) / (c(h) + m), where h' is
h without its first token. The smoothing weight m depends on the size class of c(h) (powers
of two); of the weights in ``GRID`` each class takes the one that gives the training tokens,
each left out of the counts in turn, the highest likelihood. So every history's
probabilities sum to one, and what m may be worth is decided by the whole corpus.

As an automaton: a state is a history that was seen (the longest known end of what has been
read), an arc a known n-gram with its log-probability, and a failure arc leads to the state
of h' with weight log(m / (c(h) + m)). A text is read once from left to right; where the
state has no arc for the token, failure arcs are taken until one has. Many texts, or
stretches of a long one, are read side by side.

Scale. Documents are cut into blocks of about ``BLOCK_TOKENS`` tokens, each written as one row
of packed arrays. A block sends every distinct n-gram of its texts once, with how often its
training texts hold it, to the n-gram's bucket; the bucket adds up and answers with the
counts in the order asked. So the counts of the corpus are spread over the buckets, nothing
of them is broadcast, a frequent n-gram costs at most one entry a block, and a block builds
just that part of the automaton which its texts can reach. N-grams travel as sorted 64-bit
hashes, packed by the byte. Every step reads written tables, so a lost executor costs the
recomputation of its own tasks. To the driver come N, V and one sum per size class and weight.

Tokens are the text's words in lower case (A-Z only), separated by space, tab, LF, VT, FF
and CR, then one end, which is a token; before the first one stands a begin, which is no
token but a history. Two different n-grams with equal 64-bit hashes would share their counts.

Defined results: a null text is empty (its one token is the end). Documents that
``learn`` is null for are not learned from. Repeated rows count and score as documents each.
Without training tokens every token has probability one. Other columns of the input
play no part; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import released, stored

ORDER = 2
ADD = 0.1
GRID = 4.0 ** np.arange(-3, 13)
CLASSES = 48
BLOCK_TOKENS = 1 << 20
#: Entries of a bucket, about.
BUCKET = 1 << 21
#: Tokens of a text that one lane of the automaton reads.
STRETCH = 512
BEGIN, END = 0, 1


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def pack(a: np.ndarray) -> bytes:
    """Compressed by bytes of equal weight: sorted or small numbers get short."""
    raw = np.ascontiguousarray(a)
    return zstandard.ZstdCompressor(level=1).compress(raw.view(np.uint8).reshape(len(raw), -1).T.tobytes() if len(raw) else b"")


def unpack(data: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).reshape(-1) if len(raw) else np.empty(0, kind)


def _mixed(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Hash of an n-gram from those of its history and its last token."""
    with np.errstate(over="ignore"):
        x = (h ^ h >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15) + w
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        return x ^ x >> np.uint64(31)


@dataclass
class Level:
    """The distinct n-grams of one length in a block."""
    at: np.ndarray          # n-gram that ends at each place; -1: the text begins too late
    history: np.ndarray     # the n-gram without its last token, one level below
    shorter: np.ndarray     # the n-gram without its first token, one level below
    word: np.ndarray        # last token
    key: np.ndarray         # hash
    count: np.ndarray | None = None     # in all training texts


@dataclass
class Block:
    """Some documents: tokens with a begin before each text and an end after it."""
    learn: np.ndarray
    sizes: np.ndarray
    tokens: np.ndarray
    hashes: np.ndarray

    def __post_init__(self):
        self.first = np.concatenate([[0], np.cumsum(self.sizes)])[:-1]
        self.doc = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.place = np.arange(len(self.tokens)) - self.first[self.doc]

    def levels(self, order: int) -> list[Level]:
        words = np.arange(len(self.hashes))
        none = np.zeros(len(words), np.int64)
        out = [Level(self.tokens.astype(np.int64), none, none, words, self.hashes)]
        for k in range(2, order + 1):
            below = out[-1]
            places = np.flatnonzero(self.place >= k - 1)
            code = below.at[places - 1] * len(self.hashes) + self.tokens[places]
            code, where, inverse = np.unique(code, return_index=True, return_inverse=True)
            at = np.full(len(self.tokens), -1, np.int64)
            at[places] = inverse
            history, word = np.divmod(code, max(1, len(self.hashes)))
            out.append(Level(at, history, below.at[places[where]], word, _mixed(below.key[history], self.hashes[word])))
        return out

    def in_training(self, level: Level) -> np.ndarray:
        """How often the training texts of this block hold each n-gram."""
        at = level.at[self.learn[self.doc] & (level.at >= 0)]
        return np.bincount(at, minlength=len(level.key))


def _blocks(id_type: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("block", T.LongType()), T.StructField("ids", T.ArrayType(id_type)),
                         T.StructField("learn", T.BinaryType()), T.StructField("sizes", T.BinaryType()), T.StructField("tokens", T.BinaryType()),
                         T.StructField("hashes", T.BinaryType()), T.StructField("n", T.LongType()), T.StructField("n_learn", T.LongType()),
                         T.StructField("texts_learn", T.LongType())])


def cut_blocks(docs: DataFrame, id: str, text: str, learn: Column, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """The documents as rows of packed blocks, written once."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        made, numbers, ids, learned, texts, n = 0, _Numbers(), [], [], [], 0

        def block() -> pa.RecordBatch:
            flags, sizes = np.array(learned, bool), np.array([len(x) for x in texts], np.int64)
            hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in numbers), np.uint64, len(numbers))
            own = pa.array(ids, ids_type)
            row = [pa.array([part << 32 | made]), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), own),
                   *[pa.array([pack(x)], pa.binary()) for x in (flags.astype(np.uint8), sizes, np.concatenate(texts), hashes)],
                   pa.array([n - len(ids)]), pa.array([int((sizes - 1)[flags].sum())]), pa.array([int(flags.sum())])]
            return pa.RecordBatch.from_arrays(row, names=schema.names)

        for batch in batches:
            ids_type = batch.column(0).type
            for i, t, l in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if not numbers:
                    numbers.update({b" begin": BEGIN, b" end": END})        # no words: they hold a space
                words = [numbers[w] for w in (t or b"").lower().split()]
                texts.append(np.array([BEGIN, *words, END], np.int32))
                ids.append(i)
                learned.append(bool(l))
                n += len(texts[-1])
                if n >= block_tokens:
                    yield block()
                    made, numbers, ids, learned, texts, n = made + 1, _Numbers(), [], [], [], 0
        if ids:
            yield block()

    x = docs.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"))
    schema = _blocks(x.schema["id"].dataType)
    return stored(x.mapInArrow(cut, schema), "lm-blocks")


def _read(row: dict) -> Block:
    return Block(unpack(row["learn"], np.uint8).astype(bool), unpack(row["sizes"], np.int64), unpack(row["tokens"], np.int32), unpack(row["hashes"], np.uint64))


def _rows(batches: Iterator[pa.RecordBatch], skip: tuple = ()) -> Iterator[dict]:
    for batch in batches:
        names = [c for c in batch.schema.names if c not in skip]
        for k in range(batch.num_rows):
            yield {c: batch.column(c)[k].as_py() for c in names}


def count_grams(blocks: DataFrame, order: int, tokens: int, bucket: int = BUCKET) -> DataFrame:
    """For every block and order, the corpus counts of the block's n-grams in the order of
    their hashes, bucket by bucket; ``known``: distinct n-grams of the bucket in training texts (on one row of it). Written once."""
    buckets = max(1, -(-tokens // bucket))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = np.array([(b << 64) // buckets for b in range(1, buckets)], np.uint64)
        for row in _rows(batches, ("ids",)):
            block = _read(row)
            for k, level in enumerate(block.levels(order), 1):
                by = np.argsort(level.key, kind="stable")
                keys, counts = level.key[by], block.in_training(level)[by].astype(np.uint32)
                cuts = np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])
                some = [b for b in range(buckets) if cuts[b] < cuts[b + 1]]
                parts = [slice(cuts[b], cuts[b + 1]) for b in some]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k] * len(some), pa.int32()), pa.array(some, pa.int32()), pa.array([row["block"]] * len(some), pa.int64()),
                     pa.array([pack(np.diff(keys[p], prepend=np.uint64(0))) for p in parts], pa.binary()),
                     pa.array([pack(counts[p]) for p in parts], pa.binary())], names=["level", "bucket", "block", "keys", "counts"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def total(level: int, b: int, rows: list[tuple]) -> pa.RecordBatch:
            keys = [np.cumsum(unpack(r[1], np.uint64), dtype=np.uint64) for r in rows]
            counts = np.concatenate([unpack(r[2], np.uint32) for r in rows])
            distinct, inverse = np.unique(np.concatenate(keys), return_inverse=True)
            sums = np.bincount(inverse, counts, len(distinct)).astype(np.int64)
            ends = np.cumsum([len(x) for x in keys])[:-1]
            parts = np.split(sums[inverse], ends)
            known = [int((sums > 0).sum())] + [0] * (len(rows) - 1)
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([level] * len(rows), pa.int32()), pa.array([b] * len(rows), pa.int32()),
                 pa.array([pack(x) for x in parts], pa.binary()), pa.array(known, pa.int64())], names=["block", "level", "bucket", "answer", "known"])

        now, rows = None, []
        for row in _rows(batches):
            here = row["level"], row["bucket"]
            if here != now and rows:
                yield total(*now, rows)
                rows = []
            now = here
            rows.append((row["block"], row["keys"], row["counts"]))
        if rows:
            yield total(*now, rows)

    asked = blocks.mapInArrow(ask, "level int, bucket int, block long, keys binary, counts binary")
    asked = asked.repartition("level", "bucket").sortWithinPartitions("level", "bucket")
    return stored(asked.mapInArrow(answer, "block long, level int, bucket int, answer binary, known long"), "lm-counts")


def with_counts(blocks: DataFrame, counts: DataFrame, order: int) -> DataFrame:
    """The blocks, each with its counts (one packed array an order). Written once."""
    schema = T.StructType([*blocks.schema.fields, T.StructField("counts", T.ArrayType(T.BinaryType()))])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, parts = None, []

        def done() -> pa.RecordBatch:
            found = [pack(np.concatenate([unpack(x, np.int64) for x in p])) for p in parts]
            return pa.RecordBatch.from_arrays([*own.columns, pa.array([found], pa.list_(pa.binary()))], names=schema.names)

        for batch in batches:
            for k in range(batch.num_rows):
                if (level := batch.column("level")[k].as_py()) == 0:
                    if own is not None:
                        yield done()
                    own = batch.select(blocks_names).slice(k, 1)
                    parts = [[] for _ in range(order)]
                else:
                    parts[level - 1].append(batch.column("answer")[k].as_py())
        if own is not None:
            yield done()

    blocks_names = blocks.columns
    both = blocks.withColumn("level", F.lit(0)).unionByName(counts.drop("known"), allowMissingColumns=True)
    return stored(both.repartition("block").sortWithinPartitions("block", "level", "bucket").mapInArrow(join, schema), "lm-joined")


def size_class(c: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(c, 1)).astype(np.int64), CLASSES - 1)


@dataclass
class Model:
    """What scoring needs besides the counts."""
    tokens: int = 0
    kinds: int = 0
    weights: list[np.ndarray] = field(default_factory=list)     # by size class, for lengths 2, 3, ...

    def single(self, c: np.ndarray) -> np.ndarray:
        return (c + ADD) / (self.tokens + ADD * (self.kinds + 1))

    def left_out(self, levels: list[Level], k: int, grams: np.ndarray) -> np.ndarray:
        """Probability of the last token of ``grams`` (of length k) with one occurrence of
        them left out of the counts; lengths up to k have weights."""
        level = levels[k - 1]
        if k == 1:
            return (level.count[grams] - 1 + ADD) / (self.tokens - 1 + ADD * (self.kinds + 1))
        lower = self.left_out(levels, k - 1, level.shorter[grams])
        h = levels[k - 2].count[level.history[grams]] - 1
        m = self.weights[k - 2][size_class(h)]
        return np.where(h > 0, (level.count[grams] - 1 + m * lower) / (h + m), lower)


def _counted(row: dict, order: int) -> tuple[Block, list[Level]]:
    block = _read(row)
    levels = block.levels(order)
    for level, data in zip(levels, row["counts"], strict=False):
        level.count = np.empty(len(level.key), np.int64)
        level.count[np.argsort(level.key, kind="stable")] = unpack(data, np.int64)
    return block, levels


def _likelihoods(joined: DataFrame, model: Model, k: int) -> np.ndarray:
    """Log-likelihood of the training tokens, each left out, by class and weight."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((CLASSES, len(GRID)))
        for row in _rows(batches, ("ids",)):
            block, levels = _counted(row, k)
            level, n = levels[-1], block.in_training(levels[-1])
            h = levels[-2].count[level.history] - 1
            g = np.flatnonzero((n > 0) & (h > 0))
            lower, h, c, n, of = model.left_out(levels, k - 1, level.shorter[g]), h[g], level.count[g] - 1, n[g], size_class(h[g])
            for x, m in enumerate(GRID):
                sums[:, x] += np.bincount(of, n * np.log10((c + m * lower) / (h + m)), CLASSES)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(sums.reshape(-1)[at])], names=["cell", "value"])

    found = joined.mapInArrow(measure, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect()
    out = np.zeros((CLASSES, len(GRID)))
    for r in found:
        out.reshape(-1)[r.cell] = r.value
    return out


def choose_weights(likelihood: np.ndarray) -> np.ndarray:
    """The best weight of each class; a class without tokens takes that of the class below,
    the first ones that of the first class with tokens."""
    best = np.where((likelihood < 0).any(1), likelihood.argmax(1), -1)
    some = best[best >= 0]
    last = some[0] if len(some) else len(GRID) // 2
    for c in range(CLASSES):
        last = best[c] = best[c] if best[c] >= 0 else last
    return GRID[best]


@dataclass
class Automaton:
    """The part of the model that a block can reach. State 0 is the empty history."""
    states: list[np.ndarray]    # state of each n-gram as a history, by length; -1: not known
    arcs: np.ndarray            # state * words + token, sorted
    weight: np.ndarray
    target: np.ndarray
    failure: np.ndarray
    failure_weight: np.ndarray
    words: int

    @classmethod
    def build(cls, model: Model, levels: list[Level]) -> Automaton:
        words, order = len(levels[0].key), len(levels)
        states, made = [], 1
        for level in levels[:max(1, order - 1)]:
            known = (level.count > 0) & (order > 1)
            states.append(np.where(known, made + np.cumsum(known) - 1, -1))
            made += int(known.sum())
        failure, failure_weight = np.zeros(made, np.int64), np.zeros(made)
        p = model.single(levels[0].count)
        arcs, weight, target = [levels[0].word], [np.log10(p)], [np.maximum(states[0], 0)]
        for k in range(2, order + 1):
            level, below = levels[k - 1], levels[k - 2]
            h = below.count[level.history]
            m = model.weights[k - 2][size_class(h)]
            p = np.where(h > 0, (level.count + m * p[level.shorter]) / (h + m), p[level.shorter])
            g = np.flatnonzero(level.count > 0)
            arcs.append(states[k - 2][level.history[g]] * words + level.word[g])
            weight.append(np.log10(p[g]))
            target.append(states[k - 1][g] if k < order else states[k - 2][level.shorter[g]])
            known = np.flatnonzero(below.count > 0)      # the histories of this length
            m = model.weights[k - 2][size_class(below.count[known])]
            failure_weight[states[k - 2][known]] = np.log10(m / (below.count[known] + m))
            failure[states[k - 2][known]] = states[k - 3][below.shorter[known]] if k > 2 else 0
        arc = np.concatenate(arcs)
        by = np.argsort(arc, kind="stable")
        return cls(states, arc[by], np.concatenate(weight)[by], np.concatenate(target)[by], failure, failure_weight, words)

    def step(self, state: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(weights, next states) of one token for each of many readers."""
        total, following, at = np.zeros(len(state)), np.zeros(len(state), np.int64), np.arange(len(state))
        while len(at):
            wanted = state * self.words + token
            k = np.minimum(np.searchsorted(self.arcs, wanted), len(self.arcs) - 1)
            hit = self.arcs[k] == wanted
            total[at[hit]] += self.weight[k[hit]]
            following[at[hit]] = self.target[k[hit]]
            at, state, token = at[~hit], state[~hit], token[~hit]
            total[at] += self.failure_weight[state]
            state = self.failure[state]
        return total, following

    def read(self, block: Block, levels: list[Level]) -> np.ndarray:
        """Log-probability of each text of the block."""
        order = len(levels)
        begin = np.concatenate([np.arange(f + 1, f + s, STRETCH) for f, s in zip(block.first, block.sizes, strict=True)] or [np.empty(0, np.int64)]).astype(np.int64)
        doc = block.doc[begin]
        length = np.minimum(begin + STRETCH, block.first[doc] + block.sizes[doc]) - begin
        by = np.argsort(-length, kind="stable")
        begin, doc, length = begin[by], doc[by], length[by]
        state = np.zeros(len(begin), np.int64)
        for k in range(1, order):           # the longest known history before each stretch
            at = levels[k - 1].at[begin - 1]
            own = np.where(at >= 0, self.states[k - 1][np.maximum(at, 0)], -1)
            state = np.where(own >= 0, own, state)
        score = np.zeros(len(begin))
        for t in range(int(length[0]) if len(length) else 0):
            live = int(np.searchsorted(-length, -t))        # stretches longer than t
            w, state[:live] = self.step(state[:live], levels[0].at[begin[:live] + t])
            score[:live] += w
        return np.bincount(doc, score, len(block.sizes))


def fit(blocks: DataFrame, order: int = ORDER, bucket: int = BUCKET) -> tuple[Model, DataFrame]:
    """(model, blocks with the counts of their n-grams). ``blocks`` itself is given up."""
    size = blocks.agg(F.sum("n").alias("n"), F.sum("n_learn").alias("learn"), F.sum("texts_learn").alias("texts")).first()
    counts = count_grams(blocks, order, size.n or 0, bucket)
    kinds = counts.where("level = 1").agg(F.sum("known")).first()[0] or 0
    model = Model(size.learn or 0, kinds - bool(size.texts))       # the begin is no token
    joined = with_counts(blocks, counts, order)
    released(blocks, counts)
    for k in range(2, order + 1):
        model.weights.append(choose_weights(_likelihoods(joined, model, k)))
    return model, joined


def score_documents(docs: DataFrame, learn: Column, id: str = "doc_id", text: str = "text", order: int = ORDER,
                    block_tokens: int = BLOCK_TOKENS, bucket: int = BUCKET) -> DataFrame:
    """One row per row of ``docs``: id, n_tokens, n_known, train_tokens, base_score (single
    tokens alone) and score, both log10 probabilities of the whole text; learned from the
    rows that ``learn`` is true for."""
    blocks = cut_blocks(docs, id, text, learn, block_tokens)
    model, joined = fit(blocks, order, bucket)
    schema = T.StructType([T.StructField(id, blocks.schema["ids"].dataType.elementType), *[T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known", "train_tokens")],
                           T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                part = batch.slice(k, 1)
                block, levels = _counted(next(_rows([part], ("ids",))), order)
                total = Automaton.build(model, levels).read(block, levels)
                token = block.place > 0
                doc, word = block.doc[token], block.tokens[token]
                n = len(block.sizes)
                known = np.bincount(doc, levels[0].count[word] > 0, n).astype(np.int64)
                base = np.bincount(doc, np.log10(model.single(levels[0].count))[word], n)
                yield pa.RecordBatch.from_arrays([part.column("ids").flatten(), pa.array(block.sizes - 1), pa.array(known),
                                                  pa.array(np.full(n, model.tokens, np.int64)), pa.array(base), pa.array(total)], names=schema.names)

    return joined.mapInArrow(score, schema)
