"""Language identification as multilingual mixture inference.

A model is the trigram distribution of each language (trigrams of lower-cased letters,
other characters as one space, hashed to ``BUCKETS``). A document is a mixture: its
trigrams come from languages with unknown proportions, which expectation-maximisation
estimates, or from a background under which all trigrams are equally likely: what no
learned language explains better than chance falls to it. The set of languages is selected
by penalised likelihood: beside the background the languages are
taken in the order of their proportion in the full mixture, and one more is taken only
if it raises the log-likelihood by more than ``PENALTY`` * log(number of trigrams).
The score of a language is its share of the text, so texts in a script or language that
was not learned get a low one.

Training reads every document once and sends at most languages * ``BUCKETS`` counts per
task, summed by Spark; the model is that table (its size depends on the number of
languages alone) and is broadcast. Prediction is one narrow pass over the whole texts.

Defined results: a text that is null or has no letter is ``und`` with score 0 and no
languages; a text with letters gets ``und`` only when nothing could be learned. Documents
without language or text teach nothing. Repeated rows are documents each. Ties go to the
language that sorts first. The result columns take the names they are given, which replace
columns of the same name; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

BUCKETS = 1 << 16
SMOOTHING = 0.5
PENALTY = 1.0
ROUNDS, CLOSE = 15, 2e-3
CHARS_AT_ONCE = 1 << 20
UNDETERMINED = "und"


@lru_cache(maxsize=1)
def _is_letter() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def _trigrams(codes: np.ndarray) -> np.ndarray:
    """Buckets of the trigrams around each letter; other characters are one space."""
    letter = _is_letter()[codes]
    c = np.where(letter, codes, 32).astype(np.uint32)
    keep = letter.copy()
    keep[:1] = True
    keep[1:] |= letter[:-1]
    c, letter = c[keep], letter[keep]
    with np.errstate(over="ignore"):
        h = c[:-2] * np.uint32(0x9E3779B1) ^ c[1:-1] * np.uint32(0x85EBCA6B) ^ c[2:] * np.uint32(0xC2B2AE35)
        h = (h ^ h >> np.uint32(15)) * np.uint32(0x27D4EB2F)
    return (h >> np.uint32(16))[letter[1:-1]].astype(np.int32)


def text_trigrams(text: str | None) -> tuple[np.ndarray, np.ndarray | None]:
    """(buckets, weights) of a whole text; weights None means one each. Texts with many
    trigrams are counted by bucket, so the arrays never exceed ``BUCKETS`` rows."""
    text = " " + (text or "").lower() + " "
    if len(text) <= CHARS_AT_ONCE:
        ids = _trigrams(np.frombuffer(text.encode("utf-32-le", "replace"), "<u4"))
        if len(ids) < 4096:
            return ids, None
        counts = np.bincount(ids, minlength=BUCKETS)
    else:
        counts = np.zeros(BUCKETS, np.int64)
        for k in range(0, len(text) - 2, CHARS_AT_ONCE):
            part = text[k:k + CHARS_AT_ONCE + 2]
            counts += np.bincount(_trigrams(np.frombuffer(part.encode("utf-32-le", "replace"), "<u4")), minlength=BUCKETS)
    ids = np.flatnonzero(counts)
    return ids, counts[ids].astype(np.float32)


@dataclass
class LanguageModel:
    langs: list[str]
    prob: np.ndarray      # BUCKETS x languages, float32

    def infer(self, text: str | None) -> tuple[list[str], list[float]]:
        """Languages selected for a text with their proportions, largest first."""
        ids, w = text_trigrams(text)
        if not len(ids) or not self.langs:
            return [], []
        p = np.column_stack([self.prob[ids], np.full(len(ids), 1 / BUCKETS, np.float32)])      # the last one is the background
        n = len(ids) if w is None else float(w.sum())

        def total(q: np.ndarray) -> float:
            q = np.log(q)
            return float(q.sum(dtype=np.float64) if w is None else q @ w)

        def em(pm: np.ndarray, mix: np.ndarray, rounds: int) -> np.ndarray:
            for _ in range(rounds):
                q = pm @ mix
                new = mix * ((1 / q if w is None else w / q) @ pm) / np.float32(n)
                moved = np.abs(new - mix).max()
                mix = new
                if moved < CLOSE:
                    break
            return mix / mix.sum()

        k = len(self.langs)
        mix = em(p, np.full(k + 1, 1 / (k + 1), np.float32), ROUNDS)
        order = np.argsort(-mix[:k], kind="stable")
        best, best_score, at_most = None, -np.inf, total(p @ mix)
        for size in range(1, k + 1):
            if best is not None and at_most - PENALTY * (size - 1) * np.log(n) <= best_score:
                break       # the full mixture is at least as likely as any set
            chosen = np.append(order[:size], k)
            part = em(p[:, chosen], mix[chosen] / max(mix[chosen].sum(), 1e-9), ROUNDS)
            score = total(p[:, chosen] @ part) - PENALTY * (size - 1) * np.log(n)
            if score <= best_score:
                break
            best, best_score = (chosen[:-1], part[:-1]), score
        chosen, part = best
        rank = np.lexsort((chosen, -part))
        return [self.langs[i] for i in chosen[rank]], [min(1.0, max(0.0, float(x))) for x in part[rank]]


def fit_languages(docs: DataFrame, text: str = "text", lang: str = "lang") -> LanguageModel:
    """Trigram distributions from every document of ``docs`` that has text and language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for t, l in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids, w = text_trigrams(t)
                into = sums.setdefault(l, np.zeros(BUCKETS, np.int64))
                if w is None:
                    np.add.at(into, ids, 1)
                else:
                    into[ids] += w.astype(np.int64)
        for l, c in sums.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([l] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(c[at])],
                                             names=["lang", "bucket", "n"])

    rows = (docs.select(F.col(text).alias("t"), F.col(lang).cast("string").alias("l")).where("t is not null and l is not null")
            .mapInArrow(count, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas())
    langs = sorted(rows["lang"].unique())
    counts = np.zeros((BUCKETS, len(langs)))
    counts[rows["bucket"], np.searchsorted(langs, rows["lang"]) if langs else []] = rows["n"]
    prob = (counts + SMOOTHING) / (counts.sum(0) + SMOOTHING * BUCKETS)
    return LanguageModel([str(x) for x in langs], np.ascontiguousarray(prob, np.float32))


RESULT = "struct<lang_pred:string,score:double,languages:array<string>,proportions:array<double>>"


def language_column(docs: DataFrame, model: LanguageModel, text: str | Column = "text") -> Column:
    """Struct with the largest language, its proportion (of the whole text, background and
    all), and the whole selected mixture."""
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.prob))

    @arrow_udf(RESULT)
    def infer(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = LanguageModel(*shared.value)
        for texts in batches:
            found = [m.infer(t) for t in texts.to_pylist()]
            yield pa.StructArray.from_arrays(
                [pa.array([l[0] if l else UNDETERMINED for l, _ in found], pa.string()),
                 pa.array([s[0] if s else 0.0 for _, s in found], pa.float64()),
                 pa.array([l for l, _ in found], pa.list_(pa.string())),
                 pa.array([s for _, s in found], pa.list_(pa.float64()))],
                names=["lang_pred", "score", "languages", "proportions"])

    return infer.asNondeterministic()(text)


def held_out(id: str | Column = "doc_id") -> Column:
    """True for a quarter of the documents, which the model doesn't learn from; false
    for a null id (which isn't learned from either)."""
    return F.coalesce(F.crc32(F.col(id).cast("string") if isinstance(id, str) else id) % 4 == 2, F.lit(False))


def identify_languages(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang",
                       into: str = "__lang", held_out_into: str = "held_out") -> DataFrame:
    """``docs`` with columns held_out and __lang, or as named (the struct of
    ``language_column``); learned from those that aren't held out and have an id."""
    model = fit_languages(docs.where(F.col(id).isNotNull() & ~held_out(id)), text, lang)
    return docs.withColumns({into: language_column(docs, model, F.col(text)), held_out_into: held_out(id)})
