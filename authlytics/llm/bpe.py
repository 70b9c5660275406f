"""Byte-level BPE with a segment tree over adjacent pair ranks.

A word's bytes are leaves; leaf i of the tree holds ``rank * size + i`` of the pair
(token i, next token), so the root is the leftmost pair of lowest rank. A merge
changes three leaves (the merged token, its right neighbour, its left neighbour) and
their ancestors, which is logarithmic in the word's length. It ends when the root
holds no mergeable pair. Short words run as one numpy batch (a tree per row), long
ones one by one; both forms give the same ids.

Words are the pre-tokenizer's matches. A worker keeps the ids of words it has met in a
bounded cache, so each distinct word is merged about once per worker.

Defined results: a null text is the empty text (no ids, decodes to ""); the special
token's string in a text is that token; ids outside the vocabulary decode to nothing;
bytes that are no UTF-8 decode to U+FFFD.
"""

from __future__ import annotations

import json
import re
import threading
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

INF = np.int64(1) << 60
NONE = np.int32(2 ** 31 - 1)
#: Words up to this many bytes are merged in numpy batches.
BATCHED_BYTES = 64
#: Entries of a worker's word cache; beyond that the words seen least are dropped.
CACHE_WORDS = 400_000
#: Characters that are split into words at once; longer texts are cut at a space.
CHARS_AT_ONCE = 1 << 20
#: White space of Unicode, as the pre-tokenizer's pattern means it.
SPACE = "\t-\r \x85\xa0  -     　"


def _byte_alphabet() -> dict[str, int]:
    """Character that stands for each byte in a byte-level vocabulary: printable
    Latin-1 stands for itself, the other bytes follow from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


@lru_cache(maxsize=2)
def _splitter(top: int) -> re.Pattern:
    """The pre-tokenizer's pattern for ``re`` over characters below ``top``, with its
    letter and number classes spelled out from Unicode. Up to U+FFFF ``re`` keeps a
    class as a bit map, which is about four times as fast as ``regex``."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, top)]))

    def cls(prop: str) -> str:
        runs = (m.group() for m in regex.finditer(rf"\p{{{prop}}}+", every))
        return "".join(re.escape(r[0]) + ("-" + re.escape(r[-1]) if len(r) > 1 else "") for r in runs)

    letters, numbers = cls("L"), cls("N")
    return re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+|"
                      rf" ?[^{SPACE}{letters}{numbers}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")


#: A space between other characters begins a word whatever stands around it.
_CUT = re.compile(f"(?<=[^{SPACE}]) (?=[^{SPACE}])")


def slices(text: str) -> Iterator[str]:
    """A text in parts of about ``CHARS_AT_ONCE`` that have the words of the whole."""
    at = 0
    while len(text) - at > CHARS_AT_ONCE and (m := _CUT.search(text, at + CHARS_AT_ONCE)):
        yield text[at:m.start()]
        at = m.start()
    yield text[at:] if at else text


def pretokens(text: str) -> list[str]:
    narrow = text.isascii() or len(text.encode("utf-16-le", "replace")) == 2 * len(text)
    return _splitter(0x10000 if narrow else 0x110000).findall(text)


class Bpe:
    """Encoder and decoder of one vocabulary; built from plain arrays (``tables``)."""

    def __init__(self, tables: dict):
        self.byte_id: np.ndarray = tables["byte_id"]
        self.keys: np.ndarray = tables["keys"]          # sorted a << 32 | b
        self.ranks: np.ndarray = tables["ranks"]        # rank of the pair at the same place
        self.new_id: np.ndarray = tables["new_id"]      # token made by a rank
        self.tok_bytes: list[bytes] = tables["tok_bytes"]
        self.specials: dict[str, int] = tables["specials"]
        self.tok_len = np.array([len(b) for b in self.tok_bytes], np.int64)
        self.tok_start = np.concatenate([[0], np.cumsum(self.tok_len)])
        self.tok_flat = np.frombuffer(b"".join(self.tok_bytes), np.uint8)
        self.pair = dict(zip(self.keys.tolist(), self.ranks.tolist(), strict=True))
        self.special_re = re.compile("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        self.reset()

    @staticmethod
    def load(path: str) -> dict:
        """Tables of a byte-level BPE file of the tokenizers library."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, alphabet = spec["model"]["vocab"], _byte_alphabet()
        specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        n = max([*vocab.values(), *specials.values()]) + 1
        tok_bytes = [b""] * n
        for s, i in vocab.items():
            tok_bytes[i] = bytes(alphabet[c] for c in s) if all(c in alphabet for c in s) else s.encode()
        for s, i in specials.items():
            tok_bytes[i] = s.encode()
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        by_byte = {b: c for c, b in alphabet.items()}
        return {"byte_id": np.array([vocab[by_byte[b]] for b in range(256)], np.int64), "keys": keys[order],
                "ranks": order.astype(np.int32), "new_id": np.array([vocab[a + b] for a, b in merges], np.int32),
                "tok_bytes": tok_bytes, "specials": specials}

    # ------------------------------------------------------------ word cache

    def reset(self) -> None:
        self.code: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, np.int32)
        self.starts = np.zeros(1 << 14, np.int64)
        self.lens = np.zeros(1 << 14, np.int64)
        self.seen = np.zeros(1 << 14, np.int32)
        self.used = 0
        if self.specials:
            self._add(list(self.specials), np.array(list(self.specials.values()), np.int32), np.ones(len(self.specials), np.int64))

    def _add(self, words: list[str], ids: np.ndarray, lens: np.ndarray) -> None:
        n, m = len(self.code), len(words)
        while n + m > len(self.starts):
            self.starts, self.lens, self.seen = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lens, self.seen))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used:self.used + len(ids)] = ids
        self.starts[n:n + m] = self.used + np.concatenate([[0], np.cumsum(lens)[:-1]])
        self.lens[n:n + m] = lens
        self.used += len(ids)
        self.code.update(zip(words, range(n, n + m), strict=True))

    def trim(self) -> None:
        """Keep the half of the cache that was seen most often; its counts are halved."""
        n = len(self.code)
        seen = self.seen[:n].copy()
        seen[:len(self.specials)] = np.iinfo(np.int32).max
        keep = np.flatnonzero(seen >= max(2, np.partition(seen, n // 2)[n // 2] + 1))
        words, lens = list(self.code), self.lens[keep]
        words = [words[i] for i in keep.tolist()]
        ends = np.cumsum(lens)
        ids = self.flat[np.repeat(self.starts[keep] - (ends - lens), lens) + np.arange(ends[-1])]
        self.specials, specials = {}, self.specials
        self.reset()
        self.specials = specials
        self._add(words, ids, lens)
        self.seen[:len(keep)] = seen[keep] // 2

    # ------------------------------------------------------------ merging

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def merge_batch(self, words: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of at most ``size`` (a power of two) bytes. Word w has places
        w * size .. and a tree at w * 2 * size .. of flat 32-bit arrays."""
        w = len(words)
        lens = np.fromiter(map(len, words), np.int64, w)
        live = np.arange(size) < lens[:, None]
        tok = np.full((w, size), -1, np.int32)
        tok[live] = self.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        nxt = np.tile(np.arange(1, size + 1, dtype=np.int32), (w, 1))
        nxt[nxt >= lens[:, None]] = size
        prv = np.tile(np.arange(-1, size - 1, dtype=np.int32), (w, 1))
        tree = np.full((w, 2 * size), NONE, np.int32)
        r, c = np.nonzero(live[:, 1:])
        rank = self._rank(tok[r, c], tok[r, c + 1])
        tree[r, size + c] = np.where(rank < NONE // size, rank * size + c, NONE)
        for node in range(size - 1, 0, -1):
            np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1], out=tree[:, node])
        tok, nxt, prv, live_at, tree = (x.ravel() for x in (tok, nxt, prv, live, tree))
        act = np.flatnonzero(tree[1::2 * size] < NONE)
        while len(act):
            place, base = act * size, act * (2 * size)
            root = tree[base + 1]
            at, new = root % size, self.new_id[root // size]
            here = place + at
            right = nxt[here]
            after, before = nxt[place + right], prv[here]
            tok[here], nxt[here], live_at[place + right] = new, after, False
            tree[base + size + right] = NONE
            leaf = np.full(len(act), NONE, np.int32)
            ok = np.flatnonzero(after < size)
            then = place[ok] + after[ok]
            prv[then] = at[ok]
            rank = self._rank(new[ok], tok[then])
            leaf[ok] = np.where(rank < NONE // size, rank * size + at[ok], NONE)
            tree[base + size + at] = leaf
            ok = np.flatnonzero(before >= 0)
            rank = self._rank(tok[place[ok] + before[ok]], new[ok])
            tree[base[ok] + size + before[ok]] = np.where(rank < NONE // size, rank * size + before[ok], NONE)
            nodes = [size + at, size + right, size + np.maximum(before, 0)]
            for _ in range(size.bit_length() - 1):
                nodes = [x >> 1 for x in nodes]
                for x in nodes:
                    left = base + 2 * x
                    tree[base + x] = np.minimum(tree[left], tree[left + 1])
            act = act[tree[base + 1] < NONE]
        return tok[live_at], live.sum(1)

    def merge_one(self, word: bytes) -> list[int]:
        """The same for one word of any length."""
        n, inf = len(word), int(INF)
        size = 1 << max(1, (n - 1).bit_length())
        tok, nxt, prv = self.byte_id[np.frombuffer(word, np.uint8)].tolist(), [*range(1, n + 1)], [*range(-1, n - 1)]
        get = self.pair.get
        tree = [inf] * (2 * size)
        for i in range(n - 1):
            if (r := get(tok[i] << 32 | tok[i + 1])) is not None:
                tree[size + i] = r * size + i
        for node in range(size - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])
        gone = bytearray(n)

        def put(i: int, value: int) -> None:
            node = size + i
            tree[node] = value
            node >>= 1
            while node:
                low = min(tree[2 * node], tree[2 * node + 1])
                if tree[node] == low:
                    break
                tree[node] = low
                node >>= 1

        while (root := tree[1]) < inf:
            at, right = root % size, nxt[root % size]
            after, before = nxt[right], prv[at]
            tok[at], nxt[at], gone[right] = int(self.new_id[root // size]), after, 1
            put(right, inf)
            r = None
            if after < n:
                prv[after] = at
                r = get(tok[at] << 32 | tok[after])
            put(at, inf if r is None else r * size + at)
            if before >= 0:
                r = get(tok[before] << 32 | tok[at])
                put(before, inf if r is None else r * size + before)
        return [t for t, g in zip(tok, gone, strict=True) if not g]

    def learn(self, words: list[str]) -> None:
        """Add distinct new words to the cache."""
        raw = [w.encode("utf-8", "replace") for w in words]
        size = np.fromiter((len(b) for b in raw), np.int64, len(raw))
        for low, top in ((0, 4), (4, 8), (8, 16), (16, 32), (32, BATCHED_BYTES)):
            at, step = np.flatnonzero((size > low) & (size <= top)), (1 << 18) // top
            for k in range(0, len(at), step):
                part = at[k:k + step]
                self._add([words[i] for i in part], *self.merge_batch([raw[i] for i in part], top))
        for i in np.flatnonzero(size > BATCHED_BYTES):
            ids = self.merge_one(raw[i])
            self._add([words[i]], np.array(ids, np.int32), np.array([len(ids)]))

    # ------------------------------------------------------------ texts

    def words(self, text: str) -> list[str]:
        split = pretokens
        if self.special_re is None or not any(s in text for s in self.specials):
            return split(text)
        return [w for part in self.special_re.split(text) for w in ([part] if part in self.specials else split(part))]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and the number of ids of each text."""
        ids, counts, owner, group, chars = [], [], [], [], 0
        for i, t in enumerate(texts):
            for part in slices(t or ""):
                if group and chars + len(part) > CHARS_AT_ONCE:
                    for out, x in zip((ids, counts), self._encode(group), strict=True):
                        out.append(x)
                    group, chars = [], 0
                group.append(part)
                owner.append(i)
                chars += len(part)
        if group:
            for out, x in zip((ids, counts), self._encode(group), strict=True):
                out.append(x)
        if not counts:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        return np.concatenate(ids), np.bincount(owner, np.concatenate(counts), len(texts)).astype(np.int64)

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.code) > CACHE_WORDS:
            self.trim()
        per = [self.words(t) for t in texts]
        code, counts = self.code, np.fromiter(map(len, per), np.int64, len(per))
        words = list(chain.from_iterable(per))
        at = np.fromiter(map(code.get, words, repeat(-1)), np.int64, len(words))
        miss = np.flatnonzero(at < 0)
        if len(miss):
            new = [words[i] for i in miss.tolist()]
            self.learn(list(dict.fromkeys(new)))
            at[miss] = np.fromiter(map(code.__getitem__, new), np.int64, len(new))
        self.seen[:len(self.code)] += np.bincount(at, minlength=len(self.code)).astype(np.int32)
        lens = self.lens[at]
        ends = np.cumsum(lens)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.repeat(self.starts[at] - (ends - lens), lens) + np.arange(total)]
        bound = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        return ids, np.diff(bound)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        known = (ids >= 0) & (ids < len(self.tok_bytes))
        at = np.where(known, ids, 0).astype(np.int64)
        lens = np.where(known, self.tok_len[at], 0)
        ends = np.cumsum(lens)
        total = int(ends[-1]) if len(ends) else 0
        raw = self.tok_flat[np.repeat(self.tok_start[at] - (ends - lens), lens) + np.arange(total)].tobytes()
        bound = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])].tolist()
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip(bound, bound[1:], strict=False)]


_WORKER = threading.local()


def worker_bpe(key: str, tables) -> Bpe:
    """The worker's encoder for a broadcast vocabulary; kept between tasks."""
    if getattr(_WORKER, "key", None) != key:
        _WORKER.key, _WORKER.bpe = key, Bpe(tables.value)
    return _WORKER.bpe


def vocabulary(spark: SparkSession, path: str):
    """Broadcast tables of the vocabulary file (1.5 MB; its size does not depend on
    the data), read on the driver, so executors need no such file."""
    return spark.sparkContext.broadcast(Bpe.load(path))


def encode_column(spark: SparkSession, text: str | Column, path: str) -> Column:
    """array<int> of the text's ids."""
    tables = vocabulary(spark, path)

    @arrow_udf("array<int>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = worker_bpe(path, tables)
        for texts in batches:
            ids, counts = bpe.encode(texts.to_pylist())
            ends = np.concatenate([[0], np.cumsum(counts)])
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))

    return encode.asNondeterministic()(text)


def decode_column(spark: SparkSession, ids: str | Column, path: str) -> Column:
    """Text of an array<int> of ids; null ids are no ids."""
    tables = vocabulary(spark, path)

    @arrow_udf("string")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = worker_bpe(path, tables)
        for lists in batches:
            counts = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = lists.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
            yield pa.array(bpe.decode(flat, counts), pa.string())

    return decode.asNondeterministic()(ids)


def bpe_encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds column ``ids`` (replacing one of that name); one narrow pass, no shuffle."""
    return df.withColumn(ids, encode_column(df.sparkSession, F.col(text), path))


def bpe_decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Adds column ``text`` (replacing one of that name); one narrow pass, no shuffle."""
    return df.withColumn(text, decode_column(df.sparkSession, F.col(ids), path))
