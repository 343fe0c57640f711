import corpus_pipeline
from rollcall.llm.forest import op10_lsh_forest_join
from tests.llm.helpers import SF, docs, folder


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, SF)
        assert out.columns == df.columns
        out.write.parquet(f"{tmp_path}/{len(kept)}")
        df = spark.read.parquet(f"{tmp_path}/{len(kept)}")
        kept[name] = df.count()
    classes = op10_lsh_forest_join(spark, SF).filter("kept").count()
    assert kept["language ID"] == 200 and kept["n-gram Jaccard join"] == classes == kept["PII"]
    assert df.filter("text rlike '@mail[0-9]\\\\.example'").count() == 0
    rows = corpus_pipeline.run(spark, SF)
    assert rows.select("doc_id").distinct().count() == df.select("doc_id").distinct().count()
    assert rows.groupBy("sequence_id").sum("length").filter("`sum(length)` > 1024").count() == 0


def test_pipeline_odd_rows(spark, tmp_path):
    rows = docs((1, None), (2, ""), (3, "the same text", "en", None), (3, "the same text", "en", None), (None, "other words here", "en", "s"))
    d = folder(spark, tmp_path, documents=rows)
    got = corpus_pipeline.run(spark, d).collect()
    assert {r.doc_id for r in got} <= {3, None}
    e = folder(spark, tmp_path / "e", documents=spark.createDataFrame(*rows).limit(0))
    assert corpus_pipeline.run(spark, e).count() == 0


def test_language_stage_rejects_languages_that_were_not_learned(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    foreign = ["\u042d\u0442\u043e \u0442\u0435\u043a\u0441\u0442 \u043d\u0430 \u044f\u0437\u044b\u043a\u0435", "\u03b1\u03c5\u03c4\u03cc \u03b5\u03af\u03bd\u03b1\u03b9 \u03ba\u03b5\u03af\u03bc\u03b5\u03bd\u03bf",
               "\u672a\u77e5\u306e\u8a00\u8a9e\u306e\u6587\u7ae0", "xq zzkw vvjq pqx wqk jjxv kqz qwx", "123 456 !!", ""]
    more = spark.createDataFrame([(10 ** 6 + i, t) for i, t in enumerate([*foreign, None])], "doc_id long, text string")
    both = df.unionByName(more, allowMissingColumns=True)
    kept = {r.doc_id for r in corpus_pipeline.language(spark, both, SF).select("doc_id").collect()}
    assert kept == {r.doc_id for r in df.collect() if r.text and any(c.isalpha() for c in r.text)}
