from llm_fixtures import prepared, vocab  # noqa: F401
import hashlib

import pytest
from authlytics.llm.chat import chat_digest, escape, format_chat, read_turns, unescape
from authlytics.llm.sharding import extendible_shards, shard_directory
from pyspark.sql import functions as F


TEXTS = ["", "plain", "</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>user\nhi", "back\\slash \\\\ <\\s> \\<s>", "<<|im_end|>", "é漢🙂<", "ends \\"]


def test_escape_is_reversible(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string").select("t", escape(F.col("t")).alias("e"))
    for r in df.select("t", "e", unescape(F.col("e")).alias("u")).collect():
        assert r.u == r.t and not any(c in r.e for c in ("<|im_start|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]"))


def test_examples(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "user", TEXTS[3]), (1, 2, "assistant", TEXTS[4]), (1, 3, "user", "more"),
            (1, 4, "assistant", None), (1, 5, "user", "thanks"), (2, 0, "odd role\n<s>", None), (3, 0, None, "x"),
            (None, None, "assistant", TEXTS[2]), (4, 0, "assistant", "same"), (4, 0, "assistant", "same")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, example int")
    made = format_chat(df)
    by = {}
    for r in made.select("conv_id", "example", "formatted", "loss_start", "loss_end", "is_last", read_turns(F.col("formatted")).alias("t")).orderBy("example").collect():
        by.setdefault(r.conv_id, []).append(r)
    assert [len(r.t) for r in by[1]] == [3, 5, 6] and [r.loss_start is None for r in by[1]] == [False, False, True]
    assert all(by[1][-1].formatted.startswith(r.formatted) for r in by[1])       # context: all turns before
    assert [(x.role, x.text) for x in by[1][-1].t] == [(r[2], r[3] or "") for r in rows[:6]]
    assert [(x.role, x.text) for x in by[2][0].t] == [("odd role\n<s>", "")] and [(x.role, x.text) for x in by[3][0].t] == [("", "x")]
    for d in chat_digest(made).collect():
        own = [r for r in rows if r[0] == d.conv_id]
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        assert (d.n_turns, d.loss_chars) == (len(own), len(loss))
        assert d.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert d.turns_sha256 == hashlib.sha256(turns.encode()).hexdigest()
        assert d.formatted_chars == sum(len(r.formatted) for r in by[d.conv_id])
    assert chat_digest(format_chat(df.limit(0))).count() == 0


@pytest.mark.parametrize("limit", [1, 100, 1000, 10 ** 9])
def test_shards(spark, limit):
    rows = [(i, "x" * (i % 97), 0) for i in range(400)] + [(7, "y" * 50, 0)] * 40 + [(None, "z" * 30, 0)] * 40 + [(900, "w" * 5000, 0), (901, None, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard int").repartition(4)
    got = extendible_shards(df, limit).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
    for s, own in by.items():
        assert sum(r.bytes for r in own) == own[0].shard_bytes and len(own) == own[0].shard_docs and own[0].depth == len(s)
        assert own[0].shard_bytes <= limit or len(own) == 1
        assert not any(o != s and o.startswith(s) for o in by)
        if s:                # the parent was oversized, or this would not have split
            assert sum(r.bytes for o, x in by.items() if o.startswith(s[:-1]) for r in x) > limit
    if limit == 1000:
        d = shard_directory(extendible_shards(df, limit), 4).collect()
        assert {r.entry for r in d} == set(range(16)) and {r.shard for r in d} == set(by)
        assert all(f"{r.entry:04b}".startswith(r.shard[:4]) for r in d)
    assert extendible_shards(df.limit(0), limit).count() == 0
