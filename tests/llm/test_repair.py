import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest
from authlytics.llm.queries import QUERIES
from authlytics.llm.repair import align, audits, number_turns, repair_conversations, repaired_hashes
from llm_fixtures import prepared  # noqa: F401

SF = "/root/testdata/sf0.001"
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def brute(codes):
    """Least (cost, audit) over the states of the grammar, all edits tried at every turn."""
    @lru_cache(None)
    def go(i, state, inserted):
        best = (0, "") if i == len(codes) and state in (0, 3) else (10 ** 9, "")
        if inserted < 3:
            for c in "ua":
                if (state, c) in NEXT:
                    cost, audit = go(i, NEXT[state, c], inserted + 1)
                    best = min(best, (cost + 3, "I" + audit))
        if i < len(codes):
            code = codes[i]
            cost, audit = go(i + 1, state, 0)
            best = min(best, (cost + 4, "D" + audit))
            if code != "x":
                cut = 3 if code.isupper() else 0
                for c in "sua":
                    if (state, c) in NEXT and (c == code.lower() or c != "s"):
                        cost, audit = go(i + 1, NEXT[state, c], 0)
                        same = c == code.lower()
                        best = min(best, (cost + cut + (0 if same else 3), ("K" if same else "R") + audit))
        return best

    return go(0, 0, 0)


def codes_of(r, n):
    if r.random() < 0.5:                     # a sound conversation with damage
        out = []
        for i in range(n):
            c = "ua"[i % 2]
            out += {0: [], 1: ["x"], 2: [c.upper()], 3: [c, "x"], 4: ["u"], 5: ["o"], 6: ["s"]}.get(r.randrange(12), [c])
        return "".join((["s"] if r.random() < 0.5 else []) + out)
    return "".join(r.choice("suaoSUAOx") for _ in range(n))


@pytest.mark.parametrize("block", [1, 2, 3, 5, 256])
def test_alignment_against_all_edits(block):
    r = random.Random(block)
    for _ in range(700):
        codes = codes_of(r, r.randrange(14))
        assert align(codes, block) == brute(codes), codes


def test_long_alignments():
    r = random.Random(1)
    for _ in range(5):
        codes = codes_of(r, 200)
        assert align(codes) == brute(codes) == align(codes, 64)
    codes = codes_of(r, 100_000)
    cost, audit = align(codes)
    assert align(codes, 100) == (cost, audit) and len(re.sub("I", "", audit)) == len(codes)
    assert cost == sum(4 if e == "D" else 0 if e == "K" else 3 for e in audit) + sum(
        3 for c, e in zip(codes, audit.replace("I", ""), strict=True) if c.isupper() and e != "D")


def by_hand(rows):
    """Columns of the result for rows (turn, role, text) of one conversation."""
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, codes, faults = set(), "", {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in rows:
        solid = re.sub("[ \t-\r]", "", text)
        fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else None
        seen.add((role, text))
        code = role[:1] if role[:1] in ("s", "u", "a") else "o"
        codes += "x" if fault in ("blank", "duplicate") else code.upper() if fault else code
        if fault:
            faults[fault] += 1
    cost, audit = brute(codes)
    made, k = [], 0
    odd = sum(audit.count(c) for c in "KRI") % 2
    for e in audit:
        role = "user" if (len(made) - odd) % 2 == 0 else "assistant"
        if e == "I":
            made.append((role, ""))
            continue
        if e != "D":
            made.append((rows[k][1] if e == "K" else role, rows[k][2]))
        k += 1
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    text = "\n".join(f"{r}:{t}" for r, t in made)
    return dict(gaps=gaps, **faults, illegal=illegal, cost=cost, audit=audit, repaired_sha256=hashlib.sha256(text.encode()).hexdigest()), made


def damage(c, t, role, text):
    d = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
    role, text = " " if role is None else role, " " if text is None else text
    if d == 1:
        text = ""
    if d == 2:
        text = re.sub("[.!?]", "", text)
    return [] if d == 0 else [(t, "user" if d == 4 else role, text)] * (2 if d == 3 else 1)


def check(rows, got):
    by = {}
    for c, *turn in rows:
        by.setdefault(c, []).extend(damage(c, *turn))
    assert {r.conv_id for r in got} == set(by) and len(got) == len(by)
    for r in got:
        want, _ = by_hand(by[r.conv_id])
        assert {k: r[k] for k in want} == want, r


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    check(rows, QUERIES["op12_conversation_repair"](spark, SF).collect())


def some_rows():
    r = random.Random(5)
    rows = [(c, r.choice([None, *range(6)]), r.choice([None, "", "user", "assistant", "system", "unknown", "tool"]),
             r.choice([None, "", " \t", "yes.", "yes. ", "no", "a\nb!", "?"])) for c in [None, *range(60)] for _ in range(r.randrange(9))]
    return rows + rows[:30] + [(1000, 0, "user", "long " * 100_000)] + [(1001, t, "user", f"{t}.") for t in range(40)]


def test_nulls_repeats_and_long_texts(spark, tmp_path):
    rows = some_rows()
    spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, conv long, fault string") \
        .write.parquet(f"{tmp_path}/conversations.parquet")
    check(rows, QUERIES["op12_conversation_repair"](spark, str(tmp_path)).collect())
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/e/conversations.parquet")
    assert QUERIES["op12_conversation_repair"](spark, f"{tmp_path}/e").count() == 0


def test_operator(spark):
    rows = some_rows()
    df = spark.createDataFrame([(None if r[0] is None else f"c{r[0]}", *r[1:]) for r in rows], "c string, turn int, role string, text string")
    found, made = repair_conversations(df, conv="c")
    got = {}
    for r in made.orderBy("c", "at").collect():
        got.setdefault(r.c, []).append((r.role, r.text))
    by = {}
    for c, *turn in rows:
        by.setdefault(None if c is None else f"c{c}", []).append(turn)
    for r in found.collect():
        want, turns = by_hand(by[r.c])
        assert {k: r[k] for k in want if k != "repaired_sha256"} == {k: v for k, v in want.items() if k != "repaired_sha256"}
        assert got.get(r.c, []) == turns and re.fullmatch("(s?(ua)+)?", "".join(x[:1] for x, _ in turns))


def test_one_conversation_of_all_turns(spark):
    df = spark.range(30_000).selectExpr("1L conv_id", "id turn", "if(id % 2 = 0, 'user', 'assistant') role", "if(id % 100 = 7, '', concat(id, '.')) text")
    n = number_turns(df)
    found = audits(n).first()
    assert (found.blank, found.cost) == (300, 300 * 7) and found.audit.count("D") == 300
    assert repaired_hashes(n, audits(n)).count() == 1
