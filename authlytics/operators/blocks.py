"""Running totals of hot keys, spread over blocks.

A running window over (key, bucket) is one sorted task, however many rows a hot key has in
one bucket. Here such a bucket is cut into blocks of time (column ``blk``): windows run inside
(key, bucket, block), every block is summed up as one row, and what the blocks before
bring along (sums, the last value, the smallest, the largest, the nearest neighbour) is
carried over that small table and joined back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path


def hot_buckets(rows: DataFrame, key: str, most: int) -> DataFrame:
    """(key, bkt, n_blk): the buckets of a key with more than ``most`` rows, and the blocks
    to cut them into. At most rows / ``most`` rows."""
    return (rows.where(F.col(key).isNotNull()).groupBy(key, "bkt").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)
            .select(key, "bkt", F.ceil(F.col("n") / F.lit(most)).cast("long").alias("n_blk")))


def in_blocks(rows: DataFrame, time: str, bucket: int) -> DataFrame:
    """``rows`` (with bkt, n_blk) with the block of ``time``; times before the bucket, which are
    those of copies from the one before, belong to the first."""
    since = F.col(time) - F.col("bkt") * F.lit(bucket)
    width = F.ceil(F.lit(bucket) / F.col("n_blk"))
    return rows.withColumn("blk", F.greatest(F.lit(0), F.floor(since / width)).cast("long"))


def neighbours(x: DataFrame, keys: list[str], before: str, after: str) -> DataFrame:
    """Times of the events before and after each one among those of equal ``keys``, in (tus,
    event_id) order. ``x`` is read twice."""
    local = Window.partitionBy(*keys, "blk").orderBy("tus", "event_id")
    across = Window.partitionBy(*keys).orderBy("blk")
    edges = x.groupBy(*keys, "blk").agg(F.min("tus").alias("_lo"), F.max("tus").alias("_hi"))
    edges = edges.select(*keys, "blk", F.lag("_hi").over(across).alias("_before"), F.lead("_lo").over(across).alias("_after"))
    x = x.withColumns({before: F.lag("tus").over(local), after: F.lead("tus").over(local)}).join(edges, [*keys, "blk"])
    return x.withColumns({before: F.coalesce(before, "_before"), after: F.coalesce(after, "_after")}).drop("_before", "_after")


def running(y: DataFrame, keys: list[str], order: list[str], sums: dict | None = None, lasts: dict | None = None,
            least: dict | None = None, most: dict | None = None) -> DataFrame:
    """``y`` with running values over ``keys`` in ``order``, up to and with each row: sums, last
    non-null values, minima and maxima (name -> expression). ``y`` is read twice."""
    sums, lasts, least, most = (x or {} for x in (sums, lasts, least, most))
    upto = Window.partitionBy(*keys, "blk").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*keys).orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    place = F.struct(*order)
    whole = [F.sum(e).alias(c) for c, e in sums.items()] + [F.max_by(e, F.when(e.isNotNull(), place)).alias(c) for c, e in lasts.items()]
    whole += [F.min(e).alias(c) for c, e in least.items()] + [F.max(e).alias(c) for c, e in most.items()]
    blocks = y.groupBy(*keys, "blk").agg(*whole)
    carried = [F.sum(c).over(before).alias("_" + c) for c in sums] + [F.last(c, ignorenulls=True).over(before).alias("_" + c) for c in lasts]
    carried += [F.min(c).over(before).alias("_" + c) for c in least] + [F.max(c).over(before).alias("_" + c) for c in most]
    blocks = blocks.select(*keys, "blk", *carried)
    own = {c: F.sum(e).over(upto) for c, e in sums.items()} | {c: F.last(e, ignorenulls=True).over(upto) for c, e in lasts.items()}
    own |= {c: F.min(e).over(upto) for c, e in least.items()} | {c: F.max(e).over(upto) for c, e in most.items()}
    y = y.withColumns(own).join(blocks, [*keys, "blk"])
    y = y.withColumns({c: F.coalesce(c, F.lit(0)) + F.coalesce("_" + c, F.lit(0)) for c in sums} | {c: F.coalesce(c, "_" + c) for c in lasts}
                      | {c: F.least(c, "_" + c) for c in least} | {c: F.greatest(c, "_" + c) for c in most})
    return y.drop(*["_" + c for c in (*sums, *lasts, *least, *most)])


def stored(df: DataFrame) -> DataFrame:
    """Rows that two plans read: written once, as Parquet (a checkpoint's rows are neither
    compressed nor read by column)."""
    path = scratch_path(df.sparkSession, "blocks")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
