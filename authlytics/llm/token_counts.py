"""Token counts of a document's sections by offset mapping.

A whole document is encoded once. Every token has a character span (a token that holds
part of a character spans that character), and sections are character spans too. The two
sorted lists are joined by interval; a token is allocated by an explicit rule:

* ``majority`` (default): the section that holds most of its characters, the earlier one
  on a tie;
* ``start``: the section that holds its first character;
* ``split``: a share of the token to each section it meets, by characters.

Tokens that meet no section are counted as outside. One narrow pass; only the small rows
of sections leave it.

Defined results: a null text is empty; null or no sections give no rows; sections are cut
to the text, sorted by start, and must not overlap (an overlap is an error); an empty
section has no tokens.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .bpe import Bpe, vocabulary, worker_bpe

RULES = ("majority", "start", "split")


def token_spans(bpe: Bpe, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Character span of each token of a text."""
    ends = np.cumsum(bpe.tok_len[ids])
    starts = ends - bpe.tok_len[ids]
    if text.isascii():
        return starts, ends
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    char = np.cumsum((raw & 0xC0) != 0x80) - 1
    return char[starts], char[ends - 1] + 1


def allocate(starts: np.ndarray, ends: np.ndarray, sec_start: np.ndarray, sec_end: np.ndarray, rule: str) -> np.ndarray:
    """Tokens of each section (sorted, without overlaps); the last number: outside."""
    n = len(sec_start)
    out = np.zeros(n + 1)
    if not n:
        out[0] = len(starts)
        return out
    if (sec_start[1:] < sec_end[:-1]).any():
        raise ValueError("sections overlap")
    first = np.searchsorted(sec_end, starts, side="right")
    last = np.searchsorted(sec_start, ends, side="left") - 1
    meets = np.maximum(last - first + 1, 0)
    tok = np.repeat(np.arange(len(starts)), meets)
    sec = first[tok] + np.arange(len(tok)) - np.repeat(np.cumsum(meets) - meets, meets)
    shared = np.minimum(ends[tok], sec_end[sec]) - np.maximum(starts[tok], sec_start[sec])
    tok, sec, shared = (x[shared > 0] for x in (tok, sec, shared))
    if rule == "split":
        part = shared / (ends - starts)[tok]
    elif rule == "start":
        part = (sec_start[sec] <= starts[tok]).astype(float)
    else:
        order = np.lexsort((sec, -shared, tok))
        part = np.zeros(len(tok))
        part[order[np.concatenate([[True], tok[order][1:] != tok[order][:-1]])] if len(tok) else order] = 1
    out[:n] = np.bincount(sec, part, n)
    out[n] = len(starts) - out[:n].sum()
    return out


def count_column(docs: DataFrame, path: str, text: str | Column, sections: str | Column, rule: str = "majority") -> Column:
    """struct<total, outside, sections: array<struct<section, start, end, n_tokens>>>;
    ``sections`` is an array of structs with start and end (characters, end excluded)."""
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    tables = vocabulary(docs.sparkSession, path)
    one = pa.struct([("section", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("n_tokens", pa.float64())])

    @arrow_udf("struct<total:bigint,outside:double,sections:array<struct<section:int,start:bigint,end:bigint,n_tokens:double>>>")
    def attribute(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        bpe = worker_bpe(path, tables)
        for texts, secs in batches:
            texts = [t or "" for t in texts.to_pylist()]
            ids, counts = bpe.encode(texts)
            at = np.concatenate([[0], np.cumsum(counts)])
            bounds = np.concatenate([[0], np.cumsum(secs.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(int)
            flat = secs.flatten()
            s_all, e_all = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
            total, outside, nth, starts, ends, n_tok = [], [], [], [], [], []
            for k, t in enumerate(texts):
                s, e = (np.clip(x[bounds[k]:bounds[k + 1]], 0, len(t)) for x in (s_all, e_all))
                order = np.lexsort((e, s))
                s, e = s[order], e[order]
                got = allocate(*token_spans(bpe, t, ids[at[k]:at[k + 1]]), s, e, rule)
                total.append(int(counts[k]))
                outside.append(float(got[-1]))
                nth.append(order)
                starts.append(s)
                ends.append(e)
                n_tok.append(got[:-1])
            join = lambda x, kind: pa.array(np.concatenate(x) if x else [], kind)
            rows = pa.StructArray.from_arrays([join(nth, pa.int32()), join(starts, pa.int64()), join(ends, pa.int64()), join(n_tok, pa.float64())], fields=list(one))
            yield pa.StructArray.from_arrays([pa.array(total, pa.int64()), pa.array(outside, pa.float64()),
                                              pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), rows)],
                                             names=["total", "outside", "sections"])

    return attribute.asNondeterministic()(text, sections)


def line_sections(text: str | Column) -> Column:
    """The lines of a text, each with its line feed, as sections. A text without a line
    feed is one section; a null or empty one has none."""

    @arrow_udf("array<struct<start:bigint,end:bigint>>")
    def lines(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            starts, ends, bounds = [], [], [0]
            for t in texts.to_pylist():
                lens = np.fromiter(map(len, (t or "").split("\n")), np.int64) + 1
                lens[-1] -= 1
                lens = lens[lens > 0]
                ends.append(np.cumsum(lens))
                starts.append(ends[-1] - lens)
                bounds.append(bounds[-1] + len(lens))
            flat = [pa.array(np.concatenate(x) if x else [], pa.int64()) for x in (starts, ends)]
            yield pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.StructArray.from_arrays(flat, names=["start", "end"]))

    return lines.asNondeterministic()(text)


def token_counts(docs: DataFrame, path: str, sections: Column, id: str = "doc_id", text: str = "text",
                 rule: str = "majority") -> DataFrame:
    """One row per document and section: id, section (its place in the array), start,
    end, n_tokens, and the document's total and outside."""
    out = docs.select(F.col(id).alias(id), count_column(docs, path, F.col(text), sections, rule).alias("t"))
    return out.select(id, "t.total", "t.outside", F.explode("t.sections").alias("s")).select(
        id, "s.section", "s.start", "s.end", "s.n_tokens", "total", "outside")
