"""Periodic runs of words by maximal pairs, and the texts with their repeats collapsed.

A run is a stretch of consecutive words with smallest period q, at least ``min_length``
words and ``min_periods`` periods long, that no neighbouring word extends. Two places i and
i + q of a run, i its start, are a maximal pair: the words before them differ, and so do
those after their longest common prefix of l words. Turned round, a maximal pair with
l >= (min_periods - 1) * q and l + q >= min_length is a run of l + q words with period q,
so nothing has to be extended.

Maximal pairs come from the tree of LCP intervals of the suffix array, bottom-up: each
interval of value l holds its places in order, and by the word on their left (class lists).
When a child joins its parent, each place of the smaller one looks in the larger one for
places at a distance that l allows and of another class. As l is at least twice the
distance, places of one interval that near to each other are a stretch of equal distances:
all but its first place have the same left word, so a look-up meets at most two classes
and costs a binary search besides the pairs it finds. A run whose period is no multiple of
a smaller one is kept; multiples have the same start and length.

Only places whose next words repeat in their text matter, as many as the least l allowed
(16 with the defaults): the suffix array is built by prefix doubling over all texts of a
batch at once, and places that turn out unique leave it. LCP values are compared word by
word only where left words differ, the others follow from the place before.

Nothing is shuffled: a text is a unit, in memory about a hundred bytes a word.

Defined results: a null text, an empty one or one without a word has no run and collapses
to the empty text; words are separated by space, tab, LF, VT, FF and CR alone. Repeated rows
are texts each; other columns of the input stay as they are, and the result column takes the
name it is given; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

MIN_LENGTH, MIN_PERIODS = 24, 3
#: Texts are taken together up to about this number of words.
WORDS_AT_ONCE = 1 << 18
RESULT = "struct<runs:array<struct<start:bigint,length:bigint,period:bigint>>,collapsed:string>"


def split_words(text: bytes | None) -> list[bytes]:
    """Words of a text in UTF-8 (bytes know no separators but the six of ASCII)."""
    return (text or b"").split()


def _least_prefix(min_length: int, min_periods: int) -> int:
    """The least l that some distance allows."""
    return min(max((min_periods - 1) * q, min_length - q) for q in range(1, min_length + 1))


class _Places:
    """Places of an interval in order, and by left word."""
    __slots__ = ("order", "classes")

    def __init__(self, i: int, left: int):
        self.order, self.classes = [i], {left: [i]}

    def add(self, i: int, left: int) -> None:
        for into in (self.order, self.classes.setdefault(left, [])):
            if not into or into[-1] < i:
                into.append(i)
            else:
                insort(into, i)


def _suffix_groups(first: np.ndarray, end: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(places in suffix order, their group): places whose next ``least`` words, rounded
    down to a power of two, occur more than once. ``first``: number of each word, distinct between texts;
    ``end``: end of the text of each place."""
    n = len(first)
    order = np.argsort(first, kind="stable")
    values = first[order]
    rank = np.empty(n, np.int64)
    base = np.zeros(n, np.int64)
    active, kept, group = order, np.empty(0, np.int64), None
    k = 0
    while True:
        # ranks are places in suffix order; equal prefixes share that of the first
        change = np.ones(len(values), bool)
        change[1:] = values[1:] != values[:-1]
        at = np.arange(len(values))
        if k == 0:
            rank[active] = np.maximum.accumulate(np.where(change, at, 0))
        else:
            fresh = np.ones(len(values), bool)
            fresh[1:] = base[1:] != base[:-1]
            rank[active] = base + np.maximum.accumulate(np.where(change, at, 0)) - np.maximum.accumulate(np.where(fresh, at, 0))
        k = 2 * k or 1
        single = change.copy()
        single[:-1] &= change[1:]
        active = active[~single]
        if group is None and 2 * k > least:
            kept, group = active, rank[active]
        if not len(active):
            break
        base = rank[active]
        follow = active + k
        inside = follow < end[active]
        values = base * (n + 1) + np.where(inside, rank[np.minimum(follow, n - 1)] + 1, 0)
        by = np.argsort(values, kind="stable")
        active, base, values = active[by], base[by], values[by]
    if group is None or not len(kept):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    by = np.argsort(rank[kept], kind="stable")
    return kept[by], group[by]


def _common(words: np.ndarray, i: int, j: int, end: int, known: int) -> int:
    """Length of the common prefix of the places i and j of one text."""
    limit, step = end - max(i, j), 64
    while known < limit:
        m = min(step, limit - known)
        other = words[i + known:i + known + m] != words[j + known:j + known + m]
        if other.any():
            return known + int(other.argmax())
        known, step = known + m, min(2 * step, 1 << 16)
    return limit


def _prefixes(words: np.ndarray, left: np.ndarray, end: np.ndarray, places: np.ndarray, group: np.ndarray, least: int) -> np.ndarray:
    """Common prefix of each place with the one before it in suffix order (0: none)."""
    same = np.zeros(len(places), bool)
    same[1:] = group[1:] == group[:-1]
    at, before = places[same], places[np.flatnonzero(same) - 1]
    by = np.argsort(at)
    at, before = at[by], before[by]
    compared = left[at] != left[before]
    value = np.zeros(len(at), np.int64)
    for x in np.flatnonzero(compared).tolist():
        value[x] = _common(words, int(at[x]), int(before[x]), int(end[at[x]]), least)
    origin = np.maximum.accumulate(np.where(compared, np.arange(len(at)), 0))
    value = value[origin] - (at - at[origin])
    out = np.zeros(len(places), np.int64)
    out[np.flatnonzero(same)[by]] = value
    return out


def _maximal_pairs(places: list[int], lcp: list[int], left: list[int], least: int, min_length: int, min_periods: int) -> list[tuple[int, int, int]]:
    """(first place, distance, common prefix) of the maximal pairs that are runs."""
    found: list[tuple[int, int, int]] = []

    def join(a: _Places, b: _Places, l: int) -> _Places:
        small, large = (a, b) if len(a.order) < len(b.order) else (b, a)
        low, high = max(1, min_length - l), l // (min_periods - 1)
        if low <= high:
            order = large.order
            for i in small.order:
                own = left[i]
                k = bisect_left(order, i - high)        # only the first one in reach can be of another class
                if k < len(order) and order[k] <= i - low and left[order[k]] != own:
                    found.append((order[k], i - order[k], l))
                k = bisect_left(order, i + low)         # all in reach are of one class
                if k < len(order) and order[k] <= i + high and (other := left[order[k]]) != own:
                    members = large.classes[other]
                    for k in range(bisect_left(members, i + low), len(members)):
                        if members[k] > i + high:
                            break
                        found.append((i, members[k] - i, l))
        for i in small.order:
            large.add(i, left[i])
        return large

    stack: list[tuple[int, _Places]] = []
    for t, i in enumerate(places):
        node = _Places(i, left[i])
        if t == 0:
            current = node
            continue
        l = lcp[t]
        while stack and stack[-1][0] > l:
            value, parent = stack.pop()
            current = join(parent, current, value)
        if stack and stack[-1][0] == l:
            stack[-1] = l, join(stack[-1][1], current, l)
        elif l >= least:
            stack.append((l, current))
        current = node
    while stack:
        value, parent = stack.pop()
        current = join(parent, current, value)
    return found


def find_runs(texts: list[list[bytes]], min_length: int = MIN_LENGTH, min_periods: int = MIN_PERIODS) -> list[list[tuple[int, int, int]]]:
    """Runs (start, length, period) of each text, by start, then period."""
    if min_periods < 3 or min_length < 1:
        raise ValueError("a run takes three periods at least")
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    sizes = np.array([len(x) for x in texts], np.int64)
    n = int(sizes.sum())
    if n == 0:
        return out
    number: dict[bytes, int] = {}
    words = np.fromiter((number.setdefault(w, len(number)) for x in texts for w in x), np.int64, n)
    begin = np.concatenate([[0], np.cumsum(sizes)])
    text = np.repeat(np.arange(len(texts)), sizes)
    end = np.repeat(begin[1:], sizes)
    left = np.empty(n, np.int64)
    left[1:] = words[:-1]
    left[begin[:-1][sizes > 0]] = -1
    least = _least_prefix(min_length, min_periods)
    places, group = _suffix_groups(text * len(number) + words, end, least)
    if not len(places):
        return out
    lcp = _prefixes(words, left, end, places, group, 1 << least.bit_length() - 1)
    smallest: dict[tuple[int, int], int] = {}
    for start, period, l in _maximal_pairs(places.tolist(), lcp.tolist(), left.tolist(), least, min_length, min_periods):
        key = start, l + period
        smallest[key] = min(period, smallest.get(key, period))
    for (start, length), period in smallest.items():
        t = int(text[start])
        out[t].append((start - int(begin[t]), length, period))
    for x in out:
        x.sort(key=lambda r: (r[0], r[2]))
    return out


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run repeats: of each run the first period stays."""
    if not runs:
        return b" ".join(words)
    depth = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        depth[start + period] += 1
        depth[start + length] -= 1
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0).tolist()])


def _together(texts: list[bytes | None]) -> Iterator[list[list[bytes]]]:
    some, n = [], 0
    for t in texts:
        some.append(split_words(t))
        n += len(some[-1])
        if n >= WORDS_AT_ONCE:
            yield some
            some, n = [], 0
    if some:
        yield some


def runs_column(text: str | Column = "text", min_length: int = MIN_LENGTH, min_periods: int = MIN_PERIODS) -> Column:
    """Struct of the runs (start, length, period) and the collapsed text."""

    @arrow_udf(RESULT)
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            flat, counts, collapsed = [], [], []
            for some in _together(batch.cast(pa.binary()).to_pylist()):
                for words, runs in zip(some, find_runs(some, min_length, min_periods), strict=True):
                    flat += runs
                    counts.append(len(runs))
                    collapsed.append(collapse(words, runs))
            parts = np.array(flat, np.int64).reshape(-1, 3)
            rows = pa.StructArray.from_arrays([pa.array(parts[:, k]) for k in range(3)], names=["start", "length", "period"])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), rows)
            yield pa.StructArray.from_arrays([lists, pa.array(collapsed, pa.binary()).cast(pa.string())], names=["runs", "collapsed"])

    return find.asNondeterministic()(text)


def periodic_runs(docs: DataFrame, text: str = "text", into: str = "runs", min_length: int = MIN_LENGTH,
                  min_periods: int = MIN_PERIODS) -> DataFrame:
    """``docs`` with column ``into``: struct of runs and collapsed text. A column of that name is replaced."""
    return docs.withColumn(into, runs_column(F.col(f"`{text}`"), min_length, min_periods))


def runs_digest(found: DataFrame, id: str = "doc_id", runs: str = "runs") -> DataFrame:
    """Per row of ``found``: the number of runs, the one with the greatest exponent, hashes."""
    r = F.col(f"{runs}.runs")

    def first(x: Column, y: Column) -> Column:
        a, b = x["length"] * y["period"], y["length"] * x["period"]       # exponents by cross products
        tie = F.when(x["start"] != y["start"], F.when(x["start"] < y["start"], -1).otherwise(1)) \
            .otherwise(F.when(x["period"] < y["period"], -1).when(x["period"] > y["period"], 1).otherwise(0))
        return F.when(a != b, F.when(a > b, -1).otherwise(1)).otherwise(tie)

    best = F.reduce(r, F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"),
                    lambda best, x: F.when(best.isNull() | (first(x, best) < 0), x).otherwise(best))
    line = F.transform(r, lambda x: F.concat(F.concat_ws(",", x["start"].cast("string"), x["length"].cast("string"), x["period"].cast("string")), F.lit("\n")))
    rows = found.select(id, F.size(r).cast("long").alias("n_runs"), best.alias("best"), F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"),
                        F.sha2(F.col(f"{runs}.collapsed"), 256).alias("collapsed_sha256"))
    return rows.select(id, "n_runs", F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
                       F.floor(F.lit(1000) * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
                       "runs_sha256", "collapsed_sha256")
