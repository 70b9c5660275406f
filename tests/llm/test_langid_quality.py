from llm_fixtures import prepared, vocab  # noqa: F401
import pytest
from authlytics.llm import quality
from authlytics.llm.langid import fit_languages, held_out, identify_languages
from authlytics.llm.quality import (KEEP_FROM, LABELLERS, analyse, classify_quality, fit_labellers, pattern, unpattern, votes)
from pyspark.sql import functions as F


DATA = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = identify_languages(docs).where("held_out").selectExpr("lang", "__lang.lang_pred p", "__lang.score s").collect()
    assert len(got) > 200 and sum(r.lang == r.p for r in got) / len(got) > 0.98
    assert all(0 <= r.s <= 1 for r in got)


def test_mixture(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = fit_languages(docs)
    en, fr = (docs.where(f"lang = '{x}' and n_chars between 2000 and 4000").orderBy("doc_id").first().text for x in ("en", "fr"))
    langs, parts = model.infer(en + " " + fr)
    assert set(langs[:2]) == {"en", "fr"} and min(parts[:2]) > 0.2
    assert model.infer(en)[0][0] == "en"
    long = model.infer(en * 300)            # over CHARS_AT_ONCE or counted by bucket: the same mixture
    assert long[0][0] == "en"


def plain_em(prob, ids, k, rounds):
    """The mixture by plain loops: prob[bucket][component], the last one the background."""
    mix = [1 / k] * k
    for _ in range(rounds):
        new = [0.0] * k
        for b in ids:
            q = [mix[c] * prob[b][c] for c in range(k)]
            for c in range(k):
                new[c] += q[c] / sum(q)
        mix = [x / len(ids) for x in new]
    return mix


def test_mixture_against_plain_loops(spark):
    """Trigram counts, smoothing and proportions recomputed with dictionaries."""
    from collections import Counter
    from authlytics.llm import langid
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.orderBy("doc_id").limit(40).collect()
    model = fit_languages(docs.where(F.col("doc_id").isin([r.doc_id for r in rows])))
    counts = {l: Counter() for l in model.langs}
    for r in rows:
        counts[r.lang].update(i for i, n in zip(*whole(r.text)) for _ in range(int(n)))
    totals = {l: sum(c.values()) + langid.SMOOTHING * langid.BUCKETS for l, c in counts.items()}
    for text in [rows[0].text, rows[0].text[:400] + " " + next(r.text for r in rows if r.lang != rows[0].lang)[:400], "λόγος και μέτρο", "xyzzy the"]:
        langs, parts = model.infer(text)
        ids = [i for i, n in zip(*whole(text)) for _ in range(int(n))]
        prob = {b: [(counts[l][b] + langid.SMOOTHING) / totals[l] for l in langs] + [1 / langid.BUCKETS] for b in set(ids)}
        mix = plain_em(prob, ids, len(langs) + 1, 60)
        assert max(abs(a - b) for a, b in zip(mix, parts)) < 0.05       # its rounds end when shares move by little


def whole(text):
    import numpy as np
    from authlytics.llm.langid import text_trigrams
    ids, w = text_trigrams(text)
    return ids.tolist(), (np.ones(len(ids)) if w is None else w).tolist()


def test_scores_of_unlearned_scripts(spark):
    model = fit_languages(spark.read.parquet(f"{DATA}/documents.parquet"))
    for text in ("Η γρήγορη αλεπού πηδάει πάνω από το σκυλί", "我们今天在河边看见了许多鸟"):
        langs, parts = model.infer(text * 10)
        assert langs[0] in model.langs and sum(parts) < 0.5


def test_language_cases(spark):
    rows = [(1, "der hund und die katze", "de", "x"), (2, "the dog and the cat", "en", "x"), (3, "the dog and the cat", None, "x"),
            (4, None, "en", "x"), (5, "", "de", "x"), (6, "12 34 !?", "de", "x"), (None, "the cat", "en", "x"), (8, "é", "de", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = {r.doc_id: r for r in identify_languages(df).select("doc_id", "held_out", "__lang.*").collect()}
    assert {i for i, r in got.items() if r.lang_pred == "und"} == {4, 5, 6}
    assert all(got[i].score == 0 for i in (4, 5, 6)) and got[None].held_out is False
    empty = identify_languages(df.limit(0))
    assert empty.count() == 0 and "score" in empty.columns
    nothing = identify_languages(df.withColumn("lang", F.lit(None).cast("string"))).select("__lang.lang_pred").distinct().collect()
    assert [r[0] for r in nothing] == ["und"]
    assert df.select(held_out("doc_id").alias("h")).where("h is null").count() == 0


def test_quality_against_labels(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    got = classify_quality(docs).join(labels, "doc_id").selectExpr("quality", f"__quality.score >= {KEEP_FROM} keep").collect()
    good, bad = ([r.keep for r in got if r.quality == q] for q in (1, 0))
    assert sum(good) / len(good) > 0.98 and sum(bad) / len(bad) < 0.15


def test_votes_and_patterns():
    prose = "Several travellers waited beside the harbour, while a quiet morning wind carried the smell of salt over every roof of the old town."
    assert -1 not in votes(analyse(prose)[0])
    assert votes(analyse("the " * 200)[0]).count(-1) >= 2
    assert votes(analyse("WORD!! " * 3 + "THIS!! IS!! ALL!!")[0]).count(-1) >= 2
    import numpy as np
    v = [[-1, 0, 1, 0, -1, 1, 0, 0], [0] * len(LABELLERS)]
    assert unpattern(np.array([pattern(x) for x in v])).tolist() == v
    assert analyse(None) is None and analyse(" \n") is None


def test_em_finds_accuracies():
    import numpy as np
    rng = np.random.default_rng(0)
    good = rng.random(20000) < 0.8
    rate = np.linspace(0.3, 0.7, len(LABELLERS))
    v = np.where(good[:, None], (rng.random((20000, len(rate))) > 0.002).astype(int), np.where(rng.random((20000, len(rate))) < rate, -1, 1))
    codes, counts = np.unique([pattern(x.tolist()) for x in v], return_counts=True)
    m = fit_labellers(codes, counts.astype(float))
    assert abs(m.good - 0.8) < 0.02 and np.abs(m.table[0, :, 0] - rate).max() < 0.03
    assert m.posterior(unpattern(np.array([], int))).tolist() == []


@pytest.mark.parametrize("n", [0, 1])
def test_quality_cases(spark, n):
    rows = [(1, None, 1.0), (2, "", 1.0), (None, "a word", 1.0), (4, "x" * 50000, 1.0), (4, "x" * 50000, 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score double")
    got = classify_quality(df if n else df.limit(0)).select("doc_id", "score", "__quality.*").collect()
    assert len(got) == n * len(rows)
    assert all(r["weak_label"] == 0 for r in got if r.doc_id in (1, 2))


@pytest.mark.parametrize("key", ["null id", "repeated id", "equal rows"])
def test_hot_ids_keep_to_their_share_of_the_sample(spark, monkeypatch, key):
    n, fitted, fit = 6000, [], quality.fit_linear
    monkeypatch.setattr(quality, "fit_linear", lambda ids, *a: fitted.append(len(ids)) or fit(ids, *a))
    hot, each = F.col("id") % 3 == 0, F.col("id").cast("string")
    # a threshold on a hash of values takes or leaves a hot key as a whole: several keys
    for same in range(5) if key != "null id" else [None]:
        one = F.lit(same).cast("long")
        text = F.concat(F.lit("some words of document "), F.when(hot & F.lit(key == "equal rows"), "x").otherwise(each))
        quality.fit_quality(spark.range(n).select(F.when(hot, one).otherwise(F.col("id") + 10).alias("doc_id"), text.alias("text")), sample=3000)
    assert all(2700 < k < 3300 for k in fitted), fitted
