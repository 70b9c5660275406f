"""Best-fit packing of token sequences by bulk-synchronous rounds.

Documents are encoded, closed by an end token and cut into pieces of at most ``capacity``
tokens (the first piece takes the remainder). Pieces over half the capacity, which can't
share a sequence, open one each. Then, in rounds:

1. open gaps offer slots (a gap that holds several of the longest pieces left is split
   into that many equal slots); pieces and slots are range-sorted by size, largest first;
2. each range is swept: a piece takes the smallest slot of at least its length that is
   still free, its successor in the order. A sweep leaves pieces for which its range has
   no slot and slots that no piece of its range took;
3. conflicts between ranges are resolved by rank: the counts of what each range left (one
   small row a range) say which ranks of left pieces meet which ranks of left slots, the
   nearest larger range first. Together this is what one sweep over the whole order would
   match;
4. gaps shrink by what they took, and the round repeats with the pieces left.

When the pieces left outweigh the gaps, or fit none, as many empty sequences are opened as
the excess needs at least. Every round places a piece, and rounds end when none is left.
No step gathers pieces in one task or the driver; the driver sees one row a range and one
row of sums a round. All state is written to the shared checkpoint folder.

Defined results: a null text is empty and gives one piece that holds the end token; an
empty table gives no rows; repeated rows are packed each; other columns of the input
play no part.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .bpe import vocabulary, worker_bpe
from .common import stored

PIECES = "array<struct<piece:int,start:bigint,length:int,ids_crc32:bigint{}>>"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: whole ones, and the rest in front."""
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))] if n else []


def pieces(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text", capacity: int = 2048,
           end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]) of every document."""
    tables = vocabulary(docs.sparkSession, path)

    @arrow_udf(PIECES.format(",ids:array<int>" if with_ids else ""))
    def make(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = worker_bpe(path, tables)
        for texts in batches:
            ids, counts = bpe.encode(texts.to_pylist())
            ends = np.cumsum(counts)
            ends_out, flat = [0], {"piece": [], "start": [], "length": [], "ids_crc32": [], "ids": []}
            for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True):
                own = np.append(ids[a:b], end_id).astype("<u4")
                for k, (s, n) in enumerate(cut(len(own), capacity)):
                    flat["piece"].append(k)
                    flat["start"].append(s)
                    flat["length"].append(n)
                    flat["ids_crc32"].append(zlib.crc32(own[s:s + n].tobytes()))
                    flat["ids"].append(own[s:s + n].astype(np.int32) if with_ids else None)
                ends_out.append(len(flat["piece"]))
            kinds = {"piece": pa.int32(), "start": pa.int64(), "length": pa.int32(), "ids_crc32": pa.int64()}
            if with_ids:
                kinds["ids"] = pa.list_(pa.int32())
            rows = pa.StructArray.from_arrays([pa.array(flat[k], t) for k, t in kinds.items()], names=list(kinds))
            yield pa.ListArray.from_arrays(pa.array(ends_out, pa.int32()), rows)

    cut_up = docs.select(F.col(id).alias("id"), make.asNondeterministic()(F.col(text)).alias("p"))
    return cut_up.select("id", F.explode("p").alias("p")).select("id", "p.*")


# ---------------------------------------------------------------- rounds

SWEPT = "part int, kind int, uid bigint, size int, seq bigint, slot int, rank bigint"
MATCHED, PIECE_LEFT, SLOT_LEFT = 0, 1, 2


def _sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One range in order, largest first, slots before pieces of their size. The stack
    holds the free slots, the smallest on top."""
    part = TaskContext.get().partitionId()
    stack, left = [], 0

    def out(kind, rows):
        uid, size, seq, slot, rank = zip(*rows, strict=True) if rows else ([],) * 5
        return pd.DataFrame({"part": part, "kind": kind, "uid": uid, "size": size, "seq": seq, "slot": slot, "rank": rank})

    for batch in batches:
        matched, missed = [], []
        for is_piece, uid, size, slot in zip(*(batch[c].tolist() for c in ("is_piece", "uid", "size", "slot")), strict=True):
            if not is_piece:
                stack.append((uid, slot, size))
            elif stack:
                seq, nth, _ = stack.pop()
                matched.append((uid, size, seq, nth, 0))
            else:
                missed.append((uid, size, -1, -1, left))
                left += 1
        if matched:
            yield out(MATCHED, matched)
        if missed:
            yield out(PIECE_LEFT, missed)
    if stack:
        yield out(SLOT_LEFT, [(-1, size, seq, nth, k) for k, (seq, nth, size) in enumerate(stack)])


def _carry(left: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """Which left pieces of a range meet which left slots of the ranges before it.
    left: (range, pieces, slots) in order. Gives (piece range, first piece rank, number,
    slot range, slot rank of the first; later pieces take lower ranks)."""
    stack, out = [], []
    for part, n_pieces, n_slots in left:
        rank = 0
        while rank < n_pieces and stack:
            of, top = stack.pop()
            n = min(n_pieces - rank, top)
            out.append((part, rank, n, of, top - 1))
            rank += n
            if top > n:
                stack.append((of, top - n))
        if n_slots:
            stack.append((part, n_slots))
    return out


def _round(pieces: DataFrame, gaps: DataFrame, longest: int, name: str) -> tuple[DataFrame, DataFrame]:
    """(matches (uid, seq, slot, size), pieces left (uid, size)) of one round."""
    spark = pieces.sparkSession
    slots = gaps.select(F.col("seq").alias("uid"), F.expr(f"greatest(1, least(gap div {longest}, most))").alias("n"), "gap")
    slots = slots.select("uid", F.expr("cast(gap div n as int)").alias("size"), F.explode(F.expr("sequence(1, cast(n as int))")).alias("slot"))
    both = (slots.select(F.lit(False).alias("is_piece"), "uid", "size", "slot")
            .unionByName(pieces.select(F.lit(True).alias("is_piece"), "uid", "size", F.lit(0).alias("slot"))))
    order = [F.desc("size"), F.asc("is_piece"), F.asc("uid"), F.asc("slot")]
    swept = stored(both.repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(_sweep, SWEPT), f"{name}-swept")
    left = (swept.where(f"kind <> {MATCHED}").groupBy("part")
            .agg(F.sum(F.expr(f"int(kind = {PIECE_LEFT})")).alias("p"), F.sum(F.expr(f"int(kind = {SLOT_LEFT})")).alias("s"))
            .orderBy("part").collect())
    meets = _carry([tuple(r) for r in left])
    matches = swept.where(f"kind = {MATCHED}").select("uid", "seq", "slot", "size")
    rest = swept.where(f"kind = {PIECE_LEFT}").select("part", "rank", "uid", "size")
    if meets:
        # at most two rows a range
        meet = F.broadcast(spark.createDataFrame(meets, "part int, first bigint, n bigint, slot_part int, top bigint"))
        rest = rest.join(meet, (rest["part"] == meet["part"]) & (rest["rank"] >= meet["first"])
                         & (rest["rank"] < meet["first"] + meet["n"]), "left").select(
            "uid", "size", "slot_part", (F.col("top") - F.col("rank") + F.col("first")).alias("slot_rank"))
        free = swept.where(f"kind = {SLOT_LEFT}").select(F.col("part").alias("slot_part"), F.col("rank").alias("slot_rank"), "seq", "slot")
        matches = matches.unionByName(rest.where("slot_part is not null").join(free, ["slot_part", "slot_rank"]).select("uid", "seq", "slot", "size"))
        rest = rest.where("slot_part is null")
    return matches, rest.select("uid", "size")


def pack(sized: DataFrame, capacity: int = 2048) -> DataFrame:
    """``sized``: (uid bigint unique, size int from 1 to capacity). Returns (uid,
    sequence_id, offset): places without gaps or overlaps."""
    spark = sized.sparkSession
    half = capacity // 2
    placed = [sized.where(f"size > {half}").select("uid", F.col("uid").alias("seq"), F.lit(0).alias("round"), F.lit(0).alias("slot"), "size")]
    gaps = stored(sized.where(f"size > {half} and size < {capacity}").select(F.col("uid").alias("seq"), (capacity - F.col("size")).alias("gap")), "pack-gaps")
    left = sized.where(f"size <= {half}").select("uid", "size")
    opened, matched = 0, None
    for k in count(1):
        n, total, longest, shortest = left.agg(F.count(F.lit(1)), F.sum("size"), F.max("size"), F.min("size")).first()
        if not n:
            break
        usable = gaps.where(f"gap >= {shortest}")
        n_gaps, room = usable.agg(F.count(F.lit(1)), F.coalesce(F.sum("gap"), F.lit(0))).first()
        need = max(0, -(-(total - room) // capacity)) if matched != 0 else max(1, -(-total // capacity))
        if need:
            # sequences that start empty have negative numbers; those of long pieces have their uid
            new = spark.range(opened + 1, opened + 1 + need).select((-F.col("id")).alias("seq"), F.lit(capacity).alias("gap"))
            usable, opened = usable.unionByName(new), opened + need
        most = -(-n // max(1, n_gaps + need)) + 1
        matches, rest = _round(left, usable.withColumn("most", F.lit(most)), longest, f"pack-{k}")
        matches = stored(matches.withColumn("round", F.lit(k)).select("uid", "seq", "round", "slot", "size"), f"pack-{k}-placed", small=True)
        placed.append(matches)
        taken = matches.groupBy("seq").agg(F.sum("size").alias("taken"), F.count(F.lit(1)).alias("n"))
        left = stored(rest, f"pack-{k}-left", small=True)
        gaps = stored(usable.join(taken, "seq", "left").select("seq", F.expr("int(gap - coalesce(taken, 0))").alias("gap")).where("gap > 0"), f"pack-{k}-gaps", small=True)
        matched = matches.count()
    every = placed[0]
    for m in placed[1:]:
        every = every.unionByName(m)
    from pyspark.sql import Window
    before = Window.partitionBy("seq").orderBy("round", "slot", "uid").rowsBetween(Window.unboundedPreceding, -1)
    return every.select("uid", F.col("seq").alias("sequence_id"), F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"))


def best_fit_packing(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text", capacity: int = 2048,
                     end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, [ids,] sequence_id, offset."""
    cut_up = stored(pieces(docs, path, id, text, capacity, end_id, with_ids)
                    .withColumn("uid", F.monotonically_increasing_id()), "pack-pieces")
    places = pack(cut_up.select("uid", F.col("length").alias("size")), capacity)
    out = cut_up.join(places, "uid").withColumnRenamed("id", id)
    return out.select(id, "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32",
                      *(["ids"] if with_ids else []), "sequence_id", F.col("offset").cast("long").alias("offset"))
