from llm_fixtures import prepared, vocab  # noqa: F401
import random

import numpy as np
import pytest
from authlytics.llm import bpe as B
from authlytics.llm.bpe import Bpe, bpe_decode, bpe_encode
from authlytics.llm.packing import pieces
from authlytics.llm.token_counts import allocate, line_sections, token_counts
from pyspark.sql import functions as F
from tokenizers import Tokenizer


@pytest.fixture(scope="module")
def both(vocab):
    return Bpe(Bpe.load(vocab)), Tokenizer.from_file(vocab)


def texts(n=1500):
    rnd = random.Random(7)
    kinds = [lambda: "".join(rnd.choice(" \n\t'sd.,ab12 é\xa0 ²Ⅷ漢字́🙂") for _ in range(rnd.randint(0, 60))),
             lambda: "".join(chr(rnd.randint(0, 0x24F)) for _ in range(rnd.randint(0, 80))),
             lambda: rnd.choice(["<|endoftext|>", "a<|endoftext|> b", "<|endoftext|", "don't we'll  I'M"]) * rnd.randint(1, 3),
             lambda: "".join(rnd.choice("abc") for _ in range(rnd.randint(0, 300)))]
    return [rnd.choice(kinds)() for _ in range(n)] + ["", "x" * 5000, "ab" * 30000, " " * 3000 + "a"]


def test_ids_and_texts_equal_the_library(both):
    own, lib = both
    t = texts()
    ids, counts = own.encode(t)
    ends = np.cumsum(counts)
    each = [ids[a:b].tolist() for a, b in zip(ends - counts, ends, strict=True)]
    assert each == [e.ids for e in lib.encode_batch(t, add_special_tokens=False)]
    assert own.decode(ids, counts) == t


def test_decoding_any_ids(both):
    own, lib = both
    ids = np.random.default_rng(0).integers(0, 50257, 3000)
    got = own.decode(ids, np.full(300, 10))
    assert got == [lib.decode(r.tolist(), skip_special_tokens=False) for r in ids.reshape(-1, 10)]
    assert own.decode(np.array([-1, 10 ** 6, 65]), np.array([3])) == [lib.decode([65])]


def test_both_tree_forms_agree(both):
    own, _ = both
    rnd = random.Random(1)
    words = [bytes(rnd.choice(b"abetionsr ") for _ in range(rnd.randint(1, 64))) for _ in range(400)]
    ids, lens = own.merge_batch(words, 64)
    assert [x.tolist() for x in np.split(ids, np.cumsum(lens)[:-1])] == [own.merge_one(w) for w in words]


def test_cache_is_emptied(both, monkeypatch):
    own, lib = both
    monkeypatch.setattr(B, "CACHE_WORDS", 10)
    for t in ("one two three four five six seven eight nine ten", "one eleven"):
        assert own.encode([t])[0].tolist() == lib.encode(t).ids
    own.reset()


def test_long_texts_are_cut_at_spaces(both, monkeypatch):
    own, lib = both
    monkeypatch.setattr(B, "CHARS_AT_ONCE", 7)
    for t in ("a long  text\n with\t spaces   and <|endoftext|> more 漢 字 text " * 5, "x" * 50, " " * 40, " a" * 30):
        ids, counts = own.encode([t, "", t])
        assert ids.tolist() == lib.encode(t).ids * 2 and counts.tolist()[1] == 0


def test_operator_cases(spark, vocab):
    df = spark.createDataFrame([(1, None, 5), (2, "", 6), (2, "", 6), (3, "a\n\nb 漢", 7)], "doc_id long, text string, ids int")
    out = bpe_decode(bpe_encode(df, vocab), vocab).collect()
    assert sorted((r.doc_id, r.decoded, len(r.ids)) for r in out)[:3] == [(1, "", 0), (2, "", 0), (2, "", 0)]
    assert [r.decoded for r in out if r.doc_id == 3] == ["a\n\nb 漢"]
    assert bpe_encode(df.limit(0), vocab).count() == 0


def test_line_counts_against_offsets(spark, vocab, both):
    t = ["a line\n\n\nmore lines é漢🙂\n\nend", "", None, "\n", "x"]
    df = spark.createDataFrame([(i, x, i) for i, x in enumerate(t)], "doc_id long, text string, start long")
    got = {}
    for r in token_counts(df, vocab, line_sections("text")).collect():
        got.setdefault(r.doc_id, {})[(r.start, r.end)] = r.n_tokens
    for i, x in enumerate(t):
        lines, at = [], 0
        for part in (x or "").split("\n"):
            lines.append((at, min(at + len(part) + 1, len(x or ""))))
            at += len(part) + 1
        want = {s: 0 for s in lines if s[0] < s[1]}
        for a, b in both[1].encode(x or "").offsets:
            best = max(want, key=lambda s: (max(0, min(b, s[1]) - max(a, s[0])), -s[0]))
            want[best] += 1
        assert got.get(i, {}) == want
    assert token_counts(df.limit(0), vocab, line_sections("text")).count() == 0


def test_rules_for_crossing_tokens():
    starts, ends = np.array([0, 4, 6, 9]), np.array([4, 6, 9, 12])
    s, e = np.array([0, 5]), np.array([5, 8])
    assert allocate(starts, ends, s, e, "majority").tolist() == [2, 1, 1]
    assert allocate(starts, ends, s, e, "start").tolist() == [2, 1, 1]
    assert np.allclose(allocate(starts, ends, s, e, "split"), [1.5, 0.5 + 2 / 3, 1 + 1 / 3])
    with pytest.raises(ValueError, match="overlap"):
        allocate(starts, ends, np.array([0, 3]), np.array([5, 8]), "start")


def test_pieces_keep_every_id(spark, vocab, both):
    t = "word " * 100
    df = spark.createDataFrame([(1, t), (2, None)], "doc_id long, text string")
    got = pieces(df, vocab, capacity=32, with_ids=True).orderBy("id", "piece").collect()
    want = both[1].encode(t).ids + [0]
    own = [r for r in got if r.id == 1]
    assert [i for r in own for i in r.ids] == want
    assert [r.length for r in own] == [len(want) % 32 or 32] + [32] * (len(own) - 1)
    assert [r.start for r in own] == np.cumsum([0] + [r.length for r in own[:-1]]).tolist()
    assert [(r.length, r.ids) for r in got if r.id == 2] == [(1, [0])]
    assert df.select(F.lit(1)).count() == 2
