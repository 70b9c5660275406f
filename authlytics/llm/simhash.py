"""SimHash near-duplicates with Golay-code fuzzy hashing.

A text's fingerprint has a bit set where over half of its shingles' hashes have it. Two
fingerprints link at no more than ``max_bits`` (at most 2) differing bits.

The 64 bits are three segments of 21, 21 and 22 bits, each taken as a 23-bit word of the
perfect binary Golay code. Every word is within 3 bits of exactly one codeword, and
within 4 bits of that one alone or, at distance 3, of five more. Two words that differ
in at most 2 bits both lie within 4 bits of the codeword nearest to a word halfway
between them, so their sets of nearby codeword indices (1 or 6) meet. Pigeonhole: with 2
errors in three segments one segment has none. So each fingerprint gets, for each
segment, the keys (that segment, an index of the next segment): 3 to 18 keys of 33 to 34
bits. Fingerprints that link share a key; candidates are verified bit by bit.

Exact copies are one fingerprint before any key is made. A key's bucket is read as a
sorted stream and checked in blocks, giving at most one link a member (to the smallest
member it reaches in the bucket). The members of a bucket over ``BUCKET`` are joined by
another exact way: each probes itself and its 64 one-bit neighbours; two fingerprints
link within 2 bits if and only if they share a probe, and at most 65 fingerprints share
one.

Defined results: a null text has no words; a text without words has fingerprint zero,
which links like any other; repeated rows are copies; a group whose ids are all null has
a null component; an empty table gives no rows; other columns of the input play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import fresh, stored
from .components import connected_components

#: Generator polynomial of the (23, 12) Golay code: x^11+x^10+x^6+x^5+x^4+x^2+1.
GOLAY = 0b110001110101
SEGMENTS = ((0, 21), (21, 21), (42, 22))
#: Members of a bucket that are compared in one block; larger ones are probed.
BUCKET = 1024
SHINGLES_AT_ONCE = 1 << 16


# ---------------------------------------------------------------- fingerprints

def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """Unsigned 64-bit fingerprint of a whole text."""
    w = (text or "").encode("utf-8", "replace").lower().split()   # bytes: A-Z only, ASCII white space
    if not w:
        return 0
    shingles = map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False)) if len(w) >= words else [b" ".join(w)]
    h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), np.uint64)
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), SHINGLES_AT_ONCE):
        part = h[k:k + SHINGLES_AT_ONCE].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprint_column(text: str | Column, words: int = 3, seed: int = 42) -> Column:
    """The fingerprint as a signed long with the same bits."""

    @arrow_udf("bigint")
    def fp(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(np.array([fingerprint(t, words, seed) for t in texts.to_pylist()], np.uint64).view(np.int64))

    return fp.asNondeterministic()(text)


def hex_column(fp: str | Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


# ---------------------------------------------------------------- Golay keys

def _remainder(word: np.ndarray) -> np.ndarray:
    """Remainder of 23-bit words by the generator polynomial."""
    word = word.copy()
    for bit in range(22, 10, -1):
        word = np.where(word >> bit & 1, word ^ (GOLAY << (bit - 11)), word)
    return word


@lru_cache(maxsize=1)
def golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """Syndrome of each value of the 12 upper bits, and per syndrome the errors of at most
    4 bits that lead to a codeword: 1, or 6 if the lightest has 3 bits (-1: none)."""
    upper = _remainder(np.arange(1 << 12) << 11)
    errors = np.full((2048, 6), -1, np.int64)
    filled = np.zeros(2048, np.int64)
    for w in range(5):
        words = np.array([sum(1 << b for b in bits) for bits in combinations(range(23), w)], np.int64)
        s = _remainder(words)
        order = np.argsort(s, kind="stable")
        words, s = words[order], s[order]
        nth = np.arange(len(s)) - np.searchsorted(s, s)
        errors[s, filled[s] + nth] = words
        filled += np.bincount(s, minlength=2048)
    return upper, errors


def nearby_indices(word: np.ndarray) -> np.ndarray:
    """Indices (12 message bits) of the codewords within 4 bits of each 23-bit word,
    six columns, -1 where there are fewer."""
    upper, errors = golay_tables()
    err = errors[upper[word >> 11] ^ (word & 0x7FF)]
    return np.where(err >= 0, (word[:, None] ^ err) >> 11, -1)


def fuzzy_keys(fp: np.ndarray) -> np.ndarray:
    """18 columns of keys for each unsigned fingerprint, -1 where there are fewer."""
    seg = [((fp >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    near = [nearby_indices(s) for s in seg]
    keys = []
    for x in range(3):
        idx = near[(x + 1) % 3]
        keys.append(np.where(idx >= 0, np.int64(x) << 34 | seg[x][:, None] << 12 | idx, -1))
    return np.concatenate(keys, axis=1)


def keys_column(fp: str | Column) -> Column:
    @arrow_udf("array<bigint>")
    def keys(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in batches:
            k = fuzzy_keys(part.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
            ends = np.concatenate([[0], np.cumsum((k >= 0).sum(1))])
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(k[k >= 0]))

    return keys.asNondeterministic()(fp)


# ---------------------------------------------------------------- links

def bucket_links(key: np.ndarray, fp: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within whole buckets (equal keys are adjacent): each member with the
    smallest member that it reaches."""
    n = len(key)
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if n else np.zeros(0, int)
    left = np.repeat(np.concatenate([first[1:], [n]]), np.diff(np.concatenate([first, [n]]))) - np.arange(n)
    ai, bi = [], []
    at, d = np.arange(n), 1
    while len(at := at[left[at] > d]):
        ok = np.bitwise_count(fp[at] ^ fp[at + d]) <= max_bits
        ai.append(at[ok])
        bi.append(at[ok] + d)
        d += 1
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (ai, bi))
    signed = fp.view(np.int64)
    low = signed.copy()
    while len(a):
        least = np.minimum(low[a], low[b])
        if (least == low[a]).all() and (least == low[b]).all():
            break
        np.minimum.at(low, a, least)
        np.minimum.at(low, b, least)
    moved = low != signed
    return signed[moved], low[moved]


def _sweep(max_bits: int):
    """Sorted (key, fp) rows in; links (a, b) out, or (a, null) for a member of a bucket
    that is over ``BUCKET``. Holds one batch and at most one such bucket."""

    def out(a, b=None):
        return pd.DataFrame({"a": a, "b": pd.array([None] * len(a) if b is None else b, dtype="Int64")})

    def sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, fp, large = np.zeros(0, np.int64), np.zeros(0, np.int64), None
        for batch in _with_end(batches):
            if batch is not None:
                k, f = batch["key"].to_numpy(np.int64), batch["fp"].to_numpy(np.int64)
                if large is not None:
                    n = int(np.searchsorted(k, large, side="right"))
                    if n:
                        yield out(f[:n])
                    k, f = k[n:], f[n:]
                    if not len(k):
                        continue
                    large = None
                key, fp = np.concatenate([key, k]), np.concatenate([fp, f])
            if not len(key):
                continue
            done = len(key) if batch is None else int(np.searchsorted(key, key[-1], side="left"))
            if len(key) - done > BUCKET:
                large = key[-1]
                yield out(fp[done:])
                key, fp = key[:done], fp[:done]
            k, f, key, fp = key[:done], fp[:done], key[done:], fp[done:]
            if len(k):
                size = np.searchsorted(k, k, side="right") - np.searchsorted(k, k, side="left")
                if (big := size > BUCKET).any():
                    yield out(f[big])
                    k, f = k[~big], f[~big]
                a, b = bucket_links(k, f.view(np.uint64), max_bits)
                if len(a):
                    yield out(a, b)

    return sweep


def _with_end(batches):
    yield from batches
    yield None


def probe_links(fps: DataFrame, max_bits: int) -> DataFrame:
    """Links among distinct fingerprints (column fp) by shared one-bit neighbours."""
    probes = F.expr("concat(array(fp), transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i)))")
    if max_bits < 2:
        # one bit apart: a fingerprint is itself a probe of its neighbour
        near = fps.select("fp", F.explode(probes).alias("b")).where("fp <> b")
        return near.join(fps.select(F.col("fp").alias("b")), "b").select(F.col("fp").alias("a"), "b")
    group = fps.select("fp", F.explode(probes).alias("probe")).groupBy("probe").agg(F.collect_list("fp").alias("g"))
    return group.where("size(g) > 1").select(F.explode("g").alias("a"), F.array_min("g").alias("b")).where("a <> b")


def fingerprint_components(fps: DataFrame, max_bits: int = 2) -> DataFrame:
    """(fp, root) for every fingerprint of column fp that reaches a smaller one (as a
    signed number); a root has no row of its own."""
    if not 0 <= max_bits <= 2:
        raise ValueError("the code's indices meet for at most 2 differing bits")
    if max_bits == 0:
        return fps.sparkSession.createDataFrame([], "fp bigint, root bigint")
    keys = fps.select("fp").distinct().select("fp", F.explode(keys_column("fp")).alias("key"))
    found = stored(keys.repartition("key").sortWithinPartitions("key", "fp")
                   .mapInPandas(_sweep(max_bits), "a bigint, b bigint"), "simhash-links", small=True)
    large = found.where("b is null").select(F.col("a").alias("fp")).distinct()
    links = found.where("b is not null").unionByName(probe_links(large, max_bits))
    return connected_components(links, "simhash-cc").select(F.col("node").alias("fp"), "root")


def simhash_groups(docs: DataFrame, id: str = "doc_id", text: str = "text", words: int = 3,
                   max_bits: int = 2) -> tuple[DataFrame, DataFrame]:
    """(rows, groups): rows has (id, fp) of every document; groups has (fp, root,
    component): the fingerprint's group and the smallest id in it."""
    rows = stored(docs.select(F.col(id).alias("id"), fingerprint_column(F.col(text), words).alias("fp")), "simhash-fp")
    by_fp = rows.groupBy("fp").agg(F.min("id").alias("low"))
    roots = fingerprint_components(by_fp, max_bits)
    by_fp = by_fp.join(roots, "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    low = by_fp.groupBy("root").agg(F.min("low").alias("component"))
    return rows, stored(by_fp.join(low, "root").select("fp", "root", "component"), "simhash-groups", small=True)


def simhash_components(docs: DataFrame, id: str = "doc_id", text: str = "text", words: int = 3,
                       max_bits: int = 2) -> DataFrame:
    """One row per document: id, fingerprint (16 hex digits), component_id."""
    rows, groups = simhash_groups(docs, id, text, words, max_bits)
    return rows.join(groups, "fp").select(F.col("id").alias(id), hex_column("fp").alias("fingerprint"),
                                          F.col("component").alias("component_id"))


def simhash_dedup(docs: DataFrame, id: str = "doc_id", text: str = "text", words: int = 3,
                  max_bits: int = 2) -> DataFrame:
    """``docs`` with one document of each group: the one of the smallest id (a group
    without ids keeps one row, repeated rows of that id count once). Keeps all columns;
    a whole row is shuffled once, by fingerprint and id, which no group makes hot."""
    rows, groups = simhash_groups(docs, id, text, words, max_bits)
    fp, own, key, none = fresh(docs, "__fp", "__id", "__one", "__none")
    best = (rows.join(groups, "fp").groupBy("root")
            .agg(F.min(F.struct(F.col("id").isNull().alias("n"), "id", "fp")).alias("best"))
            .select(F.col("best.id").alias("id"), F.col("best.fp").alias(fp)))
    full = docs.withColumns({fp: fingerprint_column(F.col(text), words), own: F.col(f"`{id}`")})
    full = full.withColumn(key, F.coalesce(F.col(own).cast("string"), F.lit("")))
    best = best.select(fp, F.coalesce(F.col("id").cast("string"), F.lit("")).alias(key), F.col("id").isNull().alias(none))
    kept = full.join(best, [fp, key]).where(F.col(own).isNull() == F.col(none))
    return kept.dropDuplicates([fp, key]).select(*[F.col(f"`{c}`") for c in docs.columns])
