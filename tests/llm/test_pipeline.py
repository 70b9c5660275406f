from llm_fixtures import prepared, vocab  # noqa: F401
import corpus_pipeline
from authlytics.llm import quality
from authlytics.llm.common import stored
from authlytics.llm.langid import fit_languages, held_out
from authlytics.llm.quality import fit_quality
from authlytics.llm.simhash import fingerprint
from pyspark.sql import functions as F
from test_packing import check
from test_simhash import brute_roots


def test_pipeline_against_its_stages_by_hand(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = corpus_pipeline.run(spark, sf).toPandas()
    texts = {r.doc_id: r.text for r in docs.collect()}
    langs = fit_languages(docs.where(~held_out("doc_id")))
    with_letter = {i for i, t in texts.items() if sum(langs.infer(t)[1]) >= corpus_pipeline.LEAST_SHARE}
    model = fit_quality(docs.where(docs.doc_id.isin(sorted(with_letter))))
    good = sorted(i for i in with_letter if model.judge(texts[i])[1] >= quality.KEEP_FROM)
    low = brute_roots([fingerprint(texts[i]) for i in good], 2)
    assert set(got["doc_id"]) == {good[k] for k in low}
    check(got.rename(columns={"length": "size"}), 2048)


def test_stages_keep_the_columns_and_take_empty_tables(spark):
    docs = stored(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0), "t")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality_classifier", "simhash_dedup", "best_fit_packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, None)
        assert out.columns == docs.columns and out.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, None).count() == 0


OWN = ("held_out", "__lang", "__quality", "__fp", "__id", "__one", "score", "fp", "component")


def test_stages_leave_columns_of_any_name_alone(spark):
    """Names that the operators use, nulls in every column, repeated rows, no languages."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    more = docs.withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in OWN})
    more = more.unionByName(more.limit(20)).withColumn("doc_id", F.when(F.col("doc_id") % 19 != 0, F.col("doc_id")))
    more = more.withColumn("source", F.when(F.col("doc_id") % 3 == 0, F.col("source"))).withColumn("lang", F.when(F.col("doc_id") % 4 != 0, F.col("lang")))
    more = stored(more.unionByName(more.limit(1).withColumns({c: F.lit(None).cast(t) for c, t in more.dtypes})), "t")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stored(stage(spark, more, None), "t")
        assert kept.columns == more.columns and 0 < kept.count() < more.count()
        assert kept.exceptAll(more).count() == 0
        more = kept
    assert corpus_pipeline.STAGES[-1][1](spark, more, None).count() >= more.count()


def test_language_stage(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    greek, chinese = "Η γρήγορη αλεπού πηδάει πάνω από το σκυλί " * 20, "我们今天在河边看见了许多鸟 " * 20
    extra = spark.createDataFrame([(-1, greek), (-2, chinese), (-3, "12 34"), (-4, None)], "doc_id long, text string")
    both = docs.unionByName(extra, allowMissingColumns=True)
    kept = {r.doc_id for r in corpus_pipeline.language_id(spark, both, None).collect()}
    lettered = {r.doc_id for r in docs.where(F.col("text").rlike(r"\p{L}")).collect()}
    assert not kept & {-1, -2, -3, -4} and len(lettered - kept) <= 0.02 * len(lettered)
    untaught = both.withColumn("lang", F.lit(None).cast("string"))
    assert {r.doc_id for r in corpus_pipeline.language_id(spark, untaught, None).collect()} == lettered | {-1, -2}
