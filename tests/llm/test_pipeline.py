"""The pipeline's stages over the smallest tables."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).persist()
        out.append((name, docs))
    return dict(out)


def test_columns_of_documents_until_the_last(spark, stages):
    want = spark.read.parquet(f"{SF}/documents.parquet").dtypes
    for name, df in list(stages.items())[:-1]:
        assert df.dtypes == want, name


def test_each_decision_takes_effect(spark, stages):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n = {name: df.count() for name, df in stages.items()}
    assert n["near_dedup"] <= n["toxicity"] <= docs.count() and n["secrets"] == n["near_dedup"] and n["tokens"] == n["mixing"]
    kept = stages["near_dedup"]
    assert kept.count() == kept.select("doc_id").distinct().count()
    assert stages["secrets"].where(F.length("text") != F.col("n_chars")).count() == 0
    assert stages["mixing"].groupBy("doc_id").count().where("count > 2").count() == 0


def test_tokens_decode_to_the_texts(stages):
    t, m = stages["tokens"], stages["mixing"]
    both = t.select("doc_id", "decoded_sha256").distinct().join(m.select("doc_id", F.sha2(F.encode("text", "UTF-8"), 256).alias("want")).distinct(), "doc_id")
    assert both.where("decoded_sha256 <> want").count() == 0 and both.count() == m.select("doc_id").distinct().count()


def test_run_equals_the_stages(spark, stages):
    columns = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    a, b = (sorted(map(tuple, df.select(*columns).collect())) for df in (corpus_pipeline.run(spark, SF), stages["tokens"]))
    assert a == b


ROWS = [
    (1, "a plain text of some words here", "en", "s1", 31), (1, "a plain text of some words here", "en", "s1", 31), (2, None, None, None, None), (None, "text without an id but with words", "en", "s2", 33),
    (3, "", "en", "s1", 0), (4, "key password = 'q9X2m7Kd81' " + "long " * 20_000, "en", None, 1), (5, "A plain text of some words here", "en", "s2", 31), (6, "\n \n", "de", "s3", 3),
]


@pytest.mark.parametrize("rows", [[], ROWS])
def test_stages_on_odd_rows(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("score", F.lit("clash"))
    counts = []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).persist()
        counts.append(docs.count())
    if not rows:
        assert counts == [0] * 5
        return
    # texts 1, 1, 5 are one group; the null, empty and blank texts another
    assert counts[:3] == [8, 4, 4] and counts[3] == counts[4] >= 4
