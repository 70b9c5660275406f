import hashlib
import random
import zlib
from fractions import Fraction

import pytest
from authlytics.llm.queries import QUERIES
from authlytics.llm.runs import collapse, find_runs, periodic_runs, runs_digest
from llm_fixtures import prepared  # noqa: F401

SF = "/root/testdata/sf0.001"


def brute(w, min_length=24, min_periods=3):
    """Every period, every maximal stretch; the smallest period of equal stretches."""
    n, best = len(w), {}
    for q in range(1, n // min_periods + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(min_length, min_periods * q):
                best.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted(((s, l, q) for (s, l), q in best.items()), key=lambda r: (r[0], r[2]))


def kept(w, runs):
    return [x for i, x in enumerate(w) if not any(s + q <= i < s + l for s, l, q in runs)]


def some_texts(seed, count):
    r = random.Random(seed)
    for _ in range(count):
        words = [b"%d" % r.randrange(r.choice([1, 2, 3, 8])) for _ in range(r.randrange(120))]
        for _ in range(r.randrange(3)):
            p = [b"%d" % r.randrange(3) for _ in range(r.randrange(1, 12))]
            cut = r.randrange(len(words) + 1)
            words[cut:cut] = (p * r.randrange(1, 14))[:r.randrange(1, 90)]
        yield words


@pytest.mark.parametrize("least, periods", [(24, 3), (9, 3), (6, 4), (1, 3), (40, 5)])
def test_against_all_periods(least, periods):
    texts = list(some_texts(least, 300)) + [[], [b"a"], [b"a"] * 200, [b"a", b"b"] * 60, [b"a"] * 24 + [b"b"] + [b"a"] * 24, [b"a"] * 23]
    for w, runs in zip(texts, find_runs(texts, least, periods), strict=True):
        assert runs == brute(w, least, periods), w
        assert collapse(w, runs) == b" ".join(kept(w, runs))


def test_two_periods_are_refused():
    with pytest.raises(ValueError):
        find_runs([[b"a"]], 24, 2)


def test_long_texts():
    square = [b"%d" % (i * i % 1009) for i in range(200_000)]         # period 1009
    assert find_runs([square])[0] == [(0, 200_000, 1009)]
    line = [b"x%d" % i for i in range(20)]
    page = [w for i in range(3000) for w in [b"n%d" % i, *line]]      # a passage that comes 3000 times, far apart
    assert find_runs([page])[0] == []
    assert find_runs([[b"a"] * 300_000])[0] == [(0, 300_000, 1)]


def test_operator(spark):
    rows = [(1, None, 5), (2, "", 5), (3, " \t\n", 5), (4, "a b " * 20, 5), (4, "a b " * 20, 5), (None, " x " * 30, 5), (6, "é " * 24 + "x" * 100_000, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start int")
    got = periodic_runs(df, into="found").collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and got[0].asDict().keys() == {"doc_id", "text", "start", "found"}
    assert [by[i].found.collapsed for i in (1, 2, 3, 4)] == ["", "", "", "a b"] and by[None].found.collapsed == " x"
    assert [tuple(x) for x in by[4].found.runs] == [(0, 40, 2)] and by[6].found.collapsed == "é " + "x" * 100_000
    d = runs_digest(periodic_runs(df)).where("doc_id = 1").first()
    assert (d.n_runs, d.start, d.exponent_milli, d.runs_sha256) == (0, None, None, hashlib.sha256(b"").hexdigest())
    assert runs_digest(periodic_runs(df.limit(0))).count() == 0
    assert [d.exponent_milli for d in runs_digest(periodic_runs(df)).where("doc_id = 4").collect()] == [20000, 20000]


def test_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = QUERIES["op11_periodic_runs"](spark, SF).collect()
    assert len(got) == len(docs)
    planted = 0
    for r in got:
        w = (docs[r.doc_id] or "").encode().split()
        h, n = zlib.crc32(str(r.doc_id).encode()), len(w)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i if i < a else a + (i - a) % p] for i in range(n)]
            planted += 1
        runs = brute(w) if n < 3000 else find_runs([w])[0]
        best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=(None,) * 3)
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (None if not runs else 1000 * best[1] // best[2])
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{l},{q}\n" for s, l, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(b" ".join(kept(w, runs))).hexdigest()
    assert planted > 5
