from llm_fixtures import prepared, vocab  # noqa: F401
import numpy as np
import pandas as pd
import pytest
import xxhash
from authlytics.llm import simhash as S


def brute_fingerprint(text):
    import re
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not w:
        return 0
    sh = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_roots(f, bits):
    f = np.asarray(f, np.uint64)
    near = np.bitwise_count(f[:, None] ^ f[None, :]) <= bits
    low = np.arange(len(f))
    while True:
        new = np.array([low[near[i]].min() for i in range(len(f))])
        if (new == low).all():
            return low
        low = new


def test_nearby_indices_meet_within_two_bits():
    rng = np.random.default_rng(1)
    v = rng.integers(0, 1 << 23, 3000)
    for bits in range(3):
        e = np.zeros(3000, np.int64)
        for _ in range(bits):
            e ^= np.int64(1) << rng.integers(0, 23, 3000)
        a, b = S.nearby_indices(v), S.nearby_indices(v ^ e)
        assert all(set(x[x >= 0]) & set(y[y >= 0]) for x, y in zip(a, b, strict=True))
    assert set((a >= 0).sum(1)) <= {1, 6}


@pytest.mark.parametrize("text", [None, "", " \t\n", "One", "one TWO", "a b c", "É é \x1f x\x0by  z" * 9, "w " * 5000])
def test_fingerprint(text):
    assert S.fingerprint(text) == brute_fingerprint(text)


@pytest.mark.parametrize("bucket", [1024, 3])
@pytest.mark.parametrize("bits", [2, 1])
def test_components_against_all_pairs(spark, monkeypatch, bucket, bits):
    monkeypatch.setattr(S, "BUCKET", bucket)
    rng = np.random.default_rng(3)
    f = [0, 1, 2, 4, 7]
    for base in rng.integers(0, 2 ** 63, 25, dtype=np.uint64):
        for _ in range(rng.integers(1, 20)):
            x = base
            for _ in range(rng.integers(0, 5)):
                x = x ^ np.uint64(1 << int(rng.integers(0, 64)))
            f.append(x)
    f = np.unique(np.array(f, np.uint64).view(np.int64))
    low = brute_roots(f.view(np.uint64), bits)
    got = S.fingerprint_components(spark.createDataFrame(pd.DataFrame({"fp": f})), bits).toPandas()
    got = dict(zip(got["fp"], got["root"], strict=True))
    assert [got.get(x, x) for x in f] == f[low].tolist()


def test_operator_cases(spark):
    t = "the quick brown fox jumps over the lazy dog again and again until night falls " * 4
    rows = [(5, t, "x"), (3, t.upper(), "y"), (3, t.upper(), "y"), (9, "something else entirely here", None),
            (7, None, None), (2, "", None), (None, t, None), (None, "alone with no id at all", None), (None, "alone with no id at all", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, root string")
    got = S.simhash_components(df).collect()
    assert sorted((r.doc_id, r.component_id) for r in got if r.doc_id) == [(2, 2), (3, 3), (3, 3), (5, 3), (7, 2), (9, 9)]
    assert {r.fingerprint for r in got if r.component_id == 2} == {"0" * 16}
    assert sorted(str(r.component_id) for r in got if r.doc_id is None) == ["3", "None", "None"]
    kept = S.simhash_dedup(df)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["2", "3", "9", "None"]
    assert S.simhash_components(df.limit(0)).count() == 0 and S.simhash_dedup(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        S.fingerprint_components(df.limit(0).selectExpr("1L as fp"), 3)
