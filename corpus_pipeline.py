"""The corpus pipeline: language ID, quality, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns what it keeps of ``docs`` with all
columns as they were; the last returns the packed pieces. A stage's result is written as
Parquet in the shared checkpoint folder and read again as the next one's ``docs``.

Defined results: null and empty texts go at the first stage; whole texts are judged, however
long. Repeated rows are judged alike by the first two stages, and one of them stays at the
third. Null ids, languages and sources are values like others: a document without id isn't
learned from, and of a group without ids one row stays. Ties at a limit are kept. Columns
of any other name, also those that the operators use themselves, come out unchanged. An
empty table gives empty results."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from authlytics.llm.common import fresh, prepare, stored, table
from authlytics.llm.langid import fit_languages, held_out, language_column
from authlytics.llm.packing import best_fit_packing
from authlytics.llm.quality import KEEP_FROM, classify_quality
from authlytics.llm.queries import BPE_FILE, CAPACITY, SIMHASH_BITS, SIMHASH_WORDS
from authlytics.llm.simhash import simhash_dedup


def _columns(df: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in df.columns]


#: A text stays if the learned languages explain at least this share of it better than chance.
LEAST_SHARE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter, and those whose letters are no learned language:
    the mixture leaves more than half of the text to its background. Where no language could
    be learned, every text with a letter stays."""
    prepare(spark)
    model = fit_languages(docs.where(F.col("doc_id").isNotNull() & ~held_out("doc_id")))
    if not model.langs:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    (found,) = fresh(docs, "__lang")
    shares = F.reduce(F.col(f"{found}.proportions"), F.lit(0.0), lambda total, x: total + x)
    return docs.withColumn(found, language_column(docs, model)).where(shares >= LEAST_SHARE).select(*_columns(docs))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that the classifier scores below ``KEEP_FROM``."""
    prepare(spark)
    (found,) = fresh(docs, "__quality")
    return classify_quality(docs, into=found).where(F.col(f"{found}.score") >= KEEP_FROM).select(*_columns(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each group."""
    prepare(spark)
    return simhash_dedup(docs, words=SIMHASH_WORDS, max_bits=SIMHASH_BITS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences."""
    prepare(spark)
    return best_fit_packing(docs, public_tokenizers.path(BPE_FILE), capacity=CAPACITY)


STAGES = [("language_id", language_id), ("quality_classifier", quality), ("simhash_dedup", near_dedup), ("best_fit_packing", packing)]

#: Three stages run models or tokenizers, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
