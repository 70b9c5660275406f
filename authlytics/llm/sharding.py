"""Sharding by extendible hashing; built-in functions only.

A directory is indexed by the leading bits of a row's hash. A shard over the byte limit
splits on the next bit, and only that shard, until every shard fits or holds one row. A
round settles several bits at once: rows are summed per cell (the shards' next bits, a few
times as many cells as shards, combined on the map side), the cells' sums add up to those of
every prefix (again combined first, so the short prefixes are no hot keys), and a shard is a
prefix that fits below one that doesn't. Cells with no such
prefix go to the next round with the rows in them.

The bits are 60 of the id's hash, then 60 of a number of the row itself, so rows that
share an id split too. Only ids and sizes are shuffled, never texts; the directory stays
a table.

Defined results: a null text has 0 bytes; null ids hash like the empty string; one row
over the limit is a shard of its own with oversize true; repeated rows are rows each;
other columns of the input play no part; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

HASH_BITS = 60
#: Most bits settled in one round, and bits beyond those an even spread would need.
ROUND_BITS, SPARE_BITS = 20, 3


def hash_bits(key: Column) -> Column:
    """The first 60 bits of the key's MD5 as a long."""
    return F.conv(F.substr(F.md5(F.coalesce(key.cast("string"), F.lit(""))), F.lit(1), F.lit(15)), 16, 10).cast("long")


def _bits(at: int, n: int) -> str:
    """SQL of bits at .. at + n of (h1, h2) as a long; a round stays within one of both."""
    h, at = ("h1", at) if at < HASH_BITS else ("h2", at - HASH_BITS)
    return f"shiftright({h}, {HASH_BITS - at - n}) & {(1 << n) - 1}L"


def extendible_shards(docs: DataFrame, limit_bytes: int, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, bytes, shard (its prefix as a string of bits), depth,
    shard_bytes, shard_docs, oversize."""
    number = F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 64 - HASH_BITS)
    rows = stored(docs.select(F.col(id).alias("id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("bytes"))
                  .withColumn("h1", hash_bits(F.col("id"))).withColumn("h2", number).withColumn("parent", F.lit("")), "shard-rows")
    done, at = None, 0
    largest = rows.agg(F.sum("bytes")).first()[0] or 0
    while largest is not None:
        end = HASH_BITS if at < HASH_BITS else 2 * HASH_BITS
        n = min(end - at, ROUND_BITS, max(1, math.ceil(math.log2(max(1, largest / limit_bytes))) + SPARE_BITS))
        final = at + n >= 2 * HASH_BITS
        rows = rows.withColumn("cell", F.expr(_bits(at, n)))
        cells = rows.groupBy("parent", "cell").agg(F.sum("bytes").alias("b"), F.count(F.lit(1)).alias("c"))
        first = 0 if at == 0 else 1
        prefixes = cells.select("parent", "b", "c", "cell", F.explode(F.sequence(F.lit(first), F.lit(n))).alias("d"))
        sums = stored(prefixes.groupBy("parent", "d", F.expr(f"shiftright(cell, {n} - d)").alias("prefix"))
                      .agg(F.sum("b").alias("pb"), F.sum("c").alias("pc")), f"shard-prefixes-{at}", small=True)
        fits = (F.col("pb") <= limit_bytes) | (F.col("pc") == 1) | (F.lit(final) & (F.col("d") == n))
        # a shard is a prefix that fits below one that doesn't
        over = sums.where(~fits).select("parent", (F.col("d") + 1).alias("d"), F.col("prefix").alias("above"))
        small = sums.where(fits).withColumn("above", F.shiftright("prefix", 1))
        shards = small.where(F.col("d") == first).unionByName(small.where(F.col("d") > first).join(over, ["parent", "d", "above"], "left_semi"))
        bits = F.when(F.col("d") > 0, F.lpad(F.conv(F.col("prefix").cast("string"), 10, 2), F.col("d"), "0")).otherwise("")
        within = F.expr(f"sequence(shiftleft(prefix, {n} - d), shiftleft(prefix + 1, {n} - d) - 1)")
        found = shards.select("parent", F.explode(within).alias("cell"), F.struct("d", "prefix", "pb", "pc").alias("s"), F.concat("parent", bits).alias("shard"))
        rest = sums.where(~fits & (F.col("d") == n)).select("parent", F.col("prefix").alias("cell"), F.lit(None).cast(found.schema["s"].dataType).alias("s"),
                                                            F.concat("parent", bits).alias("shard"), F.col("pb").alias("b"))
        directory = stored(found.unionByName(rest, allowMissingColumns=True), f"shard-directory-{at}", small=True)
        dealt = rows.join(directory.drop("b"), ["parent", "cell"])
        settled = dealt.where("s is not null").select("id", "bytes", "shard", F.length("shard").alias("depth"),
                                                      F.col("s.pb").alias("shard_bytes"), F.col("s.pc").alias("shard_docs"))
        done = settled if done is None else done.unionByName(settled)
        largest = directory.where("s is null").agg(F.max("b")).first()[0]
        at += n
        if largest is not None:
            rows = stored(dealt.where("s is null").select("id", "bytes", "h1", "h2", F.col("shard").alias("parent")), f"shard-rows-{at}")
    return done.select(F.col("id").alias(id), "bytes", "shard", "depth", "shard_bytes", "shard_docs",
                       (F.col("shard_bytes") > limit_bytes).alias("oversize"))


def shard_directory(shards: DataFrame, bits: int) -> DataFrame:
    """The directory over the first ``bits`` (at most 20) bits: (entry, shard, depth). A
    shallow shard has 2^(bits - depth) entries, a deeper one is listed under its first
    bits, so a look-up reads the rows of one entry."""
    if not 0 <= bits <= 20:
        raise ValueError("a directory has at most 2^20 entries")
    each = shards.select("shard", "depth").distinct()
    head = F.coalesce(F.conv(F.substr("shard", F.lit(1), F.lit(bits)), 2, 10).cast("long"), F.lit(0))
    spread = F.expr(f"shiftleft(1L, greatest(0, {bits} - depth))")
    return each.select(F.explode(F.sequence(head * spread, head * spread + spread - 1)).alias("entry"), "shard", "depth")
