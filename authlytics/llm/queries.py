"""The registered queries: each operator over its whole table, with the digest columns
derived from the operator's real output."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .ann import ann_search
from .bpe import bpe_decode, bpe_encode
from .chat import chat_digest, format_chat
from .common import stored, table
from .langid import identify_languages
from .lm import score_documents
from .packing import best_fit_packing
from .quality import KEEP_FROM, classify_quality
from .registry import ORACLE, QUERIES, register  # noqa: F401
from .repair import audits, number_turns, repaired_hashes
from .runs import periodic_runs, runs_digest, split_words
from .token_counts import line_sections, token_counts
from .topk import exact_topk
from .sharding import extendible_shards
from .simhash import simhash_components

BPE_FILE = "byte_bpe_50k.json"
#: Shards are the unit a streaming loader fetches.
SHARD_BYTES = 1 << 20
NEAREST = 10
CAPACITY = 2048
TOP_K = 20
SIMHASH_WORDS, SIMHASH_BITS = 3, 2


@register("op2_bpe")
def op2_bpe(spark, sf_dir):
    """Encode and decode every document."""
    path = public_tokenizers.path(BPE_FILE)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = bpe_decode(bpe_encode(docs, path), path)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                      F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
                      F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


@register("op8_simhash_dedup")
def op8_simhash_dedup(spark, sf_dir):
    """Near-duplicate groups of all documents."""
    return simhash_components(table(spark, sf_dir, "documents"), words=SIMHASH_WORDS, max_bits=SIMHASH_BITS)


@register("op3_quality_classifier")
def op3_quality_classifier(spark, sf_dir):
    """Quality of every document, learned without labels."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = classify_quality(docs)
    return out.select("doc_id", F.col("__quality.weak_label").alias("weak_label"), F.col("__quality.score").alias("score"),
                      (F.col("__quality.score") >= KEEP_FROM).alias("keep"))


@register("op7_language_id")
def op7_language_id(spark, sf_dir):
    """Language of every document, learned from three quarters of them."""
    out = identify_languages(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return out.select("doc_id", "held_out", "__lang.*")


@register("op10_best_fit_packing")
def op10_best_fit_packing(spark, sf_dir):
    """All documents in sequences of 2048 tokens."""
    return best_fit_packing(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path(BPE_FILE),
                            capacity=CAPACITY)


@register("op6_token_counts")
def op6_token_counts(spark, sf_dir):
    """Tokens of every line of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = token_counts(docs, public_tokenizers.path(BPE_FILE), line_sections("text"))
    return out.select("doc_id", F.col("section").alias("line"), "start", "end", F.col("n_tokens").cast("long").alias("n_tokens"))


TOPK_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.vec_id query_id, c.vec_id,
         list_sum(list_transform(range(1, least(len(q.v), len(c.v)) + 1), lambda i: q.v[i] * c.v[i]))::bigint score
  from v q join v c on q.vec_id % 20 = 0 and q.vec_id <> c.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int rank from s)
select query_id, rank, vec_id, score from r where rank <= 20
"""


@register("op1_exact_topk", TOPK_SQL)
def op1_exact_topk(spark, sf_dir):
    """The 20 best rows for a twentieth of the vectors."""
    return exact_topk(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, TOP_K)


@register("op9_ann_search")
def op9_ann_search(spark, sf_dir):
    """The 10 nearest rows found for a hundredth of the vectors."""
    return ann_search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, NEAREST)


CHAT_SQL = r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e as (
  select *, replace(replace(replace(replace(replace(replace(replace(text, '\', '\\'), '<|im_start|>', '<\|im_start|>'),
    '<|im_end|>', '<\|im_end|>'), '<s>', '<\s>'), '</s>', '<\/s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]') esc from t),
p as (
  select *, length('<|im_start|>') + length(url_encode(role)) + 1 + length(esc) + length('<|im_end|>') + 1 n,
         row_number() over (partition by conv_id order by turn, role, text) k, count(*) over (partition by conv_id) m from e),
s as (select *, sum(n) over (partition by conv_id order by k) upto from p)
select conv_id, count(*)::bigint n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by k)) turns_sha256,
       coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint loss_chars,
       sha256(coalesce(string_agg(text, '' order by k) filter (role = 'assistant'), '')) loss_sha256,
       (sum(upto) filter (role = 'assistant' or k = m))::bigint formatted_chars
from s group by conv_id
"""


@register("op4_chat_format", CHAT_SQL)
def op4_chat_format(spark, sf_dir):
    """Prefix-target examples of every conversation, read back."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.sql("""select -7L conv_id, 0L turn, 'user' role, '</s>[INST] ok [/INST]' text
                        union all select -7L, 1L, 'assistant', '</s>[INST] ok [/INST]'""")
    return chat_digest(format_chat(turns.unionByName(more)))


SHARD_SQL = f"""
with r as (select doc_id, coalesce(strlen(text), 0) bytes, ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 15))::bigint h from documents),
p as (select r.*, d, h >> (60 - d) prefix from r, range(0, 61) x(d)),
s as (select d, prefix, sum(bytes)::bigint shard_bytes, count(*)::bigint shard_docs from p group by d, prefix),
f as (select p.doc_id, p.bytes, p.d, p.prefix, s.shard_bytes, s.shard_docs,
             row_number() over (partition by p.doc_id order by p.d) k
      from p join s using (d, prefix) where shard_bytes <= {SHARD_BYTES} or shard_docs = 1)
select doc_id, bytes::bigint bytes, case when d = 0 then '' else lpad(bin(prefix), d::int, '0') end shard, d::int depth,
       shard_bytes, shard_docs, shard_bytes > {SHARD_BYTES} oversize
from f where k = 1
"""


@register("op5_sharding", SHARD_SQL)
def op5_sharding(spark, sf_dir):
    """A shard for every document."""
    return extendible_shards(table(spark, sf_dir, "documents").select("doc_id", "text"), SHARD_BYTES)


def planted_column(id: Column, text: Column) -> Column:
    """The text of a tenth of the documents with its tail made periodic (op11's contract)."""

    @arrow_udf("string")
    def plant(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for ids, texts in batches:
            out = []
            for i, t in zip(ids.to_pylist(), texts.cast(pa.binary()).to_pylist(), strict=True):
                h = None if i is None else zlib.crc32(i.encode())
                if h is not None and h % 10 == 0 and (words := split_words(t)):
                    n, g = len(words), h // 10
                    a = g % n
                    p = 1 + (n - a) // (3 + g % 8)
                    t = b" ".join(words[:a] + (words[a:a + p] * (-(-(n - a) // p)))[:n - a])
                out.append(t)
            yield pa.array(out, pa.binary()).cast(pa.string())

    return plant.asNondeterministic()(id.cast("string"), text)


@register("op11_periodic_runs")
def op11_periodic_runs(spark, sf_dir):
    """Runs of words of every document, periodic tails planted in a tenth of them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", planted_column(F.col("doc_id"), F.col("text")).alias("text"))
    return runs_digest(periodic_runs(docs))


def damaged(turns):
    """Turns with the damage of op12's contract."""
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    x = turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
                     (F.crc32(name) % 20).alias("d"))
    text = F.when(F.col("d") == 1, "").when(F.col("d") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("d") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return x.where("d <> 0").select("conv_id", "turn", F.when(F.col("d") == 4, "user").otherwise(F.col("role")).alias("role"),
                                    text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


@register("op12_conversation_repair")
def op12_conversation_repair(spark, sf_dir):
    """Audits and repairs of all conversations, damaged first."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    numbered = number_turns(damaged(turns))
    found = stored(audits(numbered), "audits", small=True)
    one = found.join(repaired_hashes(numbered, found).withColumnRenamed("conv", "_c"), F.col("conv").eqNullSafe(F.col("_c")))
    every = turns.select("conv_id").distinct().join(one, F.col("conv_id").eqNullSafe(F.col("conv")), "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"),
                        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


@register("op13_lm_scoring")
def op13_lm_scoring(spark, sf_dir):
    """Language-model scores of every document, learned from nine tenths of them."""
    tenth = F.crc32(F.col("doc_id").cast("string")) % 10
    out = score_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), tenth != 0)
    return out.withColumn("held_out", F.coalesce(tenth == 0, F.lit(False)))
