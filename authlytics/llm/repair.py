"""Repair of conversations by aligning their turns with the grammar of roles.

The role initials of a sound conversation read ``(s?(ua)+)?``. Edits of a turn: keep (0),
rerole to user or assistant (3), delete (4), and between turns insert an empty user or
assistant turn (3). Blank turns and repeats of an earlier role and text must be deleted;
a turn cut off in mid-sentence that isn't deleted adds 3. The audit is the string of the
edits' initials of a cheapest repair, the ASCII-least of those.

Method: Wagner-Fischer alignment against every feasible length of the alternating string.
Targets with the same end differ in their beginning alone, so one table of the costs of the
last r characters from turn i on serves all lengths; it is filled row by row inside
Ukkonen's band: a greedy repair gives the incumbent cost, and a cell that takes more
insertions or deletions than that leaves room for isn't looked at. Each length of least cost
is traced, and the audits are compared.

Conversations are aligned in blocks of ``BLOCK`` turns, for each state of the grammar that a
block may begin and end in; the blocks' costs are then added from the end, and the audits
chosen from the start. An insertion between two blocks belongs to the later one, so two
audits of a block for different ends always differ at some turn of the block and the
choice is exact. Time and memory are linear in the number of turns.

Spark moves the texts once by conversation to number the turns and mark the repeats, and
once to put the repaired turns in order; a conversation of any length is read as a sorted
stream, its texts are never collected. Only one letter a turn is gathered per conversation.

Defined results: a null role or text is one space. Turns are ordered by turn (nulls first),
ties by role and text; repeated rows are turns each. A null conversation id is a
conversation. Other columns of the input play no part; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from .common import stored

REROLE, DELETE, INSERT, CUT_OFF = 3, 4, 3, 3
BLOCK = 256
SPACE = " \t\n\x0b\x0c\r"
LEGAL = ("su", "ua", "au")
ROLES = {"u": "user", "a": "assistant"}
#: States of the grammar: nothing yet, after the system turn, after user, after assistant.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
FAR = 1 << 40
#: A turn as the alignment sees it: role initial (o: another), upper case if cut off, x if
#: it must be deleted.
MUST_GO = "x"


class _Table:
    """Costs of all targets that end in ``end``, from every turn of a block on."""

    def __init__(self, codes: str, end: int, last: bool, up: int, down: int):
        n = len(codes)
        self.codes, self.end, self.last = codes, end, last
        width = up + down + 1
        left = 0                                   # turns from here on that may stay
        at = np.arange(width) - down               # r of each column
        row = np.where(at == 0, 0, np.where((at > 0) & last, INSERT * at, FAR))
        self.rows, self.first = [None] * (n + 1), [0] * (n + 1)
        self.rows[n], self.first[n] = row, -down
        for i in range(n - 1, -1, -1):
            if codes[i] == MUST_GO:
                new = row + DELETE
            else:
                left += 1
                at = at + 1
                new = np.empty(width, np.int64)
                new[:-1] = row[1:] + DELETE
                new[-1] = FAR
                odd, even = (self.place(i, r)[0] for r in (1, 2))
                new = np.minimum(new, row + np.where(at % 2 == 1, odd, even))
            new[at < 0] = FAR
            new = np.minimum.accumulate(new - INSERT * at) + INSERT * at
            row = np.where(new >= FAR // 2, FAR, new)
            self.rows[i], self.first[i] = row, int(at[0])

    def role(self, r: int) -> str:
        """The target's character with r left to make."""
        return "a" if (r % 2 == 1) == (self.end == ASSISTANT) else "u"

    def place(self, i: int, r: int) -> tuple[int, str]:
        """(cost, edit) of putting turn i on the target's character."""
        c = self.codes[i]
        cut = CUT_OFF if c.isupper() else 0
        return (cut, "K") if c.lower() == self.role(r) else (REROLE + cut, "R")

    def cost(self, i: int, r: int) -> int:
        k = r - self.first[i]
        return int(self.rows[i][k]) if r >= 0 and 0 <= k < len(self.rows[i]) else FAR

    def least(self, i: int, begin: str, some: bool) -> tuple[int, list[int]]:
        """(least cost from turn i, lengths of that cost) of targets beginning with ``begin``;
        ``some``: the target isn't empty."""
        row, at = self.rows[i], self.first[i] + np.arange(len(self.rows[i]))
        odd = (self.role(1) == begin)
        fits = (at % 2 == (1 if odd else 0)) & (at >= (1 if some else 0))
        if not fits.any():
            return FAR, []
        best = int(row[fits].min())
        return best, at[fits & (row == best)].tolist() if best < FAR else []

    def trace(self, i: int, r: int) -> str:
        """The ASCII-least audit of least cost from turn i on for the last r characters."""
        out, n, here = [], len(self.codes), self.cost(i, r)
        while i < n or r > 0:
            if i < n and (c := self.cost(i + 1, r)) + DELETE == here:
                out.append("D")
                i += 1
            elif r > 0 and (i < n or self.last) and (c := self.cost(i, r - 1)) + INSERT == here:
                out.append("I")
                r -= 1
            else:
                step, edit = self.place(i, r)
                c = self.cost(i + 1, r - 1)
                assert c + step == here and self.codes[i] != MUST_GO
                out.append(edit)
                i, r = i + 1, r - 1
            here = c
        return "".join(out)


def _incumbent(codes: str) -> int:
    """What a greedy repair costs beyond what every repair costs, whatever the states at
    both ends: a turn that doesn't fit gets an inserted one before it."""
    need, extra = "u", 0
    for c in codes.lower():
        if c == MUST_GO:
            continue
        if c != need:
            extra += 1
            need = "a" if need == "u" else "u"
        if c in "ua":
            need = "a" if c == "u" else "u"
    return max(INSERT, REROLE) * (extra + 3)


@lru_cache(maxsize=1 << 14)
def _block(codes: str, first: bool, last: bool) -> dict[tuple[int, int], tuple[int, str]]:
    """(cost, audit) for each state that the block may begin in and end in."""
    n = len(codes)
    extra = _incumbent(codes)
    cut = sum(c.isupper() for c in codes)          # deleting such a turn costs but 1 more than leaving it
    down = min(cut, extra) + max(0, extra - cut) // DELETE
    down, up = min(down, n), extra // INSERT
    found: dict[tuple[int, int], tuple[int, str]] = {}

    def offer(begin: int, end: int, cost: int, audit: str) -> None:
        found[begin, end] = min(found.get((begin, end), (FAR, "")), (cost, audit))

    begins = (NOTHING,) if first else (NOTHING, SYSTEM, USER, ASSISTANT)
    systems = [t for t, c in enumerate(codes) if c in "sS"]
    for state in (NOTHING, SYSTEM):
        if state in begins:
            offer(state, state, DELETE * n, "D" * n)
    for t in systems:
        offer(NOTHING, SYSTEM, DELETE * (n - 1) + (CUT_OFF if codes[t] == "S" else 0), "D" * t + "K" + "D" * (n - 1 - t))
    for end in (USER, ASSISTANT):
        if last and end != ASSISTANT:
            continue
        table = _Table(codes, end, last, up, down)
        for begin in begins:
            cost, lengths = table.least(0, "a" if begin == USER else "u", begin != end)
            for r in lengths:
                offer(begin, end, cost, table.trace(0, r))
        best = found.get((NOTHING, end), (FAR, ""))[0]
        for t in systems:
            before = DELETE * t + (CUT_OFF if codes[t] == "S" else 0)
            if before > best:
                break
            cost, lengths = table.least(t + 1, "u", True)
            if before + cost <= best:
                best = before + cost
                for r in lengths:
                    offer(NOTHING, end, best, "D" * t + "K" + table.trace(t + 1, r))
    return found


def align(codes: str, block: int = BLOCK) -> tuple[int, str]:
    """(cost, audit) of the turns of one conversation."""
    if not codes:
        return 0, ""
    cuts = range(0, len(codes), block)
    blocks = [_block(codes[k:k + block], k == 0, k + block >= len(codes)) for k in cuts]
    after = {NOTHING: 0, ASSISTANT: 0}
    to_go = [after]
    for b in reversed(blocks):
        before: dict[int, int] = {}
        for (begin, end), (cost, _) in b.items():
            if end in after:
                before[begin] = min(before.get(begin, FAR), cost + after[end])
        after = before
        to_go.append(after)
    to_go.reverse()
    state, audits = NOTHING, []
    for k, b in enumerate(blocks):
        audit, state = min((audit, end) for (begin, end), (cost, audit) in b.items()
                           if begin == state and end in to_go[k + 1] and cost + to_go[k + 1][end] == to_go[k][state])
        audits.append(audit)
    return to_go[0][NOTHING], "".join(audits)


def number_turns(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Every turn with its number in the conversation (``at``, from 0), first ``fault``
    (blank, duplicate, truncated or null), ``code`` for the alignment, ``illegal`` (the role
    may not follow the one before) and ``fresh`` (a turn value not seen before). Written once."""
    x = turns.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(role, F.lit(" ")).alias("role"),
                     F.coalesce(text, F.lit(" ")).alias("text")).repartition("conv")
    order = [F.col("turn").asc_nulls_first(), "role", "text"]
    own = Window.partitionBy("conv").orderBy(*order)
    same = Window.partitionBy("conv", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    initial = F.substring("role", 1, 1)
    ended = F.right(F.rtrim("text", F.lit(SPACE)), F.lit(1))
    x = x.withColumn("seen", F.row_number().over(same) > 1)
    x = x.select("conv", "turn", "role", "text", (F.row_number().over(own) - 1).cast("long").alias("at"),
                 F.when(ended == "", "blank").when(F.col("seen"), "duplicate").when(~ended.isin(".", "!", "?"), "truncated").alias("fault"),
                 F.coalesce(~F.concat(F.lag(initial).over(own), initial).isin(*LEGAL), F.lit(False)).alias("illegal"),
                 (F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.lag("turn").over(own))).alias("fresh"))
    code = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    code = F.when(F.col("fault").isin("blank", "duplicate"), F.lit(MUST_GO)).when(F.col("fault") == "truncated", F.upper(code)).otherwise(code)
    return stored(x.withColumn("code", code), "turns")


def audits(numbered: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per conversation: gaps, blank, duplicate, truncated, illegal, cost, audit."""

    @arrow_udf("struct<cost:bigint,audit:string>")
    def aligned(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for codes in batches:
            done = [align(c, block) for c in codes.to_pylist()]
            yield pa.StructArray.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.string())],
                                             names=["cost", "audit"])

    def count(test: Column, name: str) -> Column:
        return F.count_if(test).cast("long").alias(name)

    codes = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "code"))), lambda x: x["code"]), "")
    span = F.max("turn") - F.min("turn") + 1 - F.count_if("fresh")
    found = numbered.groupBy("conv").agg(
        F.coalesce(span, F.lit(0)).cast("long").alias("gaps"), *[count(F.coalesce(F.col("fault") == f, F.lit(False)), f) for f in ("blank", "duplicate", "truncated")],
        count(F.col("illegal"), "illegal"), codes.alias("codes"))
    return found.withColumn("done", aligned.asNondeterministic()("codes")).select(
        "conv", "gaps", "blank", "duplicate", "truncated", "illegal", "done.cost", "done.audit")


def _in_order(numbered: DataFrame, found: DataFrame) -> DataFrame:
    """The audit of a conversation, then its turns, conversation by conversation."""
    head = found.select("conv", F.lit(-1).cast("long").alias("at"), "audit")
    both = numbered.select("conv", "at", "role", "text").unionByName(head, allowMissingColumns=True)
    return both.repartition("conv").sortWithinPartitions("conv", "at")


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv, None) at the begin of each conversation, then (conv, (edit, role, text)) of
    every turn of its repair; only the audit is held."""
    conv, audit, k, made, system = None, "", 0, 0, False

    def inserted():
        nonlocal k, made
        while k < len(audit) and audit[k] == "I":
            yield conv, ("I", ROLES["ua"[(made - system) % 2]], "")
            k, made = k + 1, made + 1

    for batch in batches:
        for c, at, role, text, own in zip(*(batch.column(x).to_pylist() for x in ("conv", "at", "role", "text", "audit")), strict=True):
            if at < 0:
                yield from inserted()
                conv, audit, k, made = c, own, 0, 0
                system = sum(map(audit.count, "KRI")) % 2
                yield conv, None
                continue
            yield from inserted()
            edit, k = audit[k], k + 1
            if edit != "D":
                yield conv, (edit, role if edit == "K" else ROLES["ua"[(made - system) % 2]], text)
                made += 1
    yield from inserted()


def _typed(batches: Iterator[pa.RecordBatch], fields: dict[str, pa.DataType]) -> tuple[pa.Schema, Iterator[tuple]]:
    """(schema of the result: conv as it comes in, then ``fields``; the edited turns)."""
    first = next(batches, None)
    if first is None:
        return pa.schema(fields), iter(())
    return pa.schema({"conv": first.schema.field("conv").type, **fields}), _edited(chain([first], batches))


def _batch(columns: Iterable, kind: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, kind, strict=True)], schema=kind)


def repaired_turns(numbered: DataFrame, found: DataFrame) -> DataFrame:
    """The repaired conversations: conv, at (from 0), edit (K, R or I), role, text."""
    schema = T.StructType([numbered.schema["conv"], T.StructField("at", T.LongType()),
                           *[T.StructField(c, T.StringType()) for c in ("edit", "role", "text")]])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, turns = _typed(batches, {"at": pa.int64(), "edit": pa.string(), "role": pa.string(), "text": pa.string()})
        rows, at, size = [], 0, 0
        for c, turn in turns:
            if turn is None:
                at = 0
                continue
            rows.append((c, at, *turn))
            at, size = at + 1, size + len(turn[2])
            if len(rows) >= 256 or size > 1 << 22:
                yield _batch(zip(*rows), kind)
                rows, size = [], 0
        if rows:
            yield _batch(zip(*rows), kind)

    return _in_order(numbered, found).mapInArrow(make, schema)


def repaired_hashes(numbered: DataFrame, found: DataFrame) -> DataFrame:
    """conv, repaired_sha256: hash of ``role:text`` of the repaired turns, newline-joined."""
    schema = T.StructType([numbered.schema["conv"], T.StructField("repaired_sha256", T.StringType())])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, turns = _typed(batches, {"repaired_sha256": pa.string()})
        ids, hashes, now, empty = [], [], None, True
        for c, turn in turns:
            if turn is None:
                if now is not None:
                    hashes.append(now.hexdigest())
                if len(hashes) >= 4096:
                    yield _batch((ids, hashes), kind)
                    ids, hashes = [], []
                ids.append(c)
                now, empty = hashlib.sha256(), True
                continue
            now.update(f"{'' if empty else chr(10)}{turn[1]}:{turn[2]}".encode())
            empty = False
        if now is not None:
            yield _batch((ids, [*hashes, now.hexdigest()]), kind)

    return _in_order(numbered, found).mapInArrow(digest, schema)


def repair_conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                         text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(audits, repaired turns) of all conversations."""
    numbered = number_turns(turns, conv, turn, role, text)
    found = stored(audits(numbered), "audits", small=True)
    return found.withColumnRenamed("conv", conv), repaired_turns(numbered, found).withColumnRenamed("conv", conv)
