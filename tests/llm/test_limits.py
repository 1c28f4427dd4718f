"""Nothing is lost to a length, a column's name or a missing shared folder."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from matchlake import scratch
from matchlake.llm import decontamination, extraction, pii, secrets


def test_hidden_addresses_of_any_length_are_candidates(spark):
    rows = [(1, "reach jane at " + "a" * 90 + " dot com"), (2, "reach jane at work\n dot com"), (3, "JANE AT HOST DOT COM"), (4, "at noon")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    guard = {r["key"]: r["kind"] for r in pii.candidates(df).where("kind = 'address'").collect()}
    assert guard.get(1) == "address" and 4 not in guard


def test_long_key_headers_are_found(spark):
    rows = [(1, "-----BEGIN " + "VERY LONG KIND OF 2 " * 4 + "PRIVATE KEY-----"), (2, "-----BEGIN PRIVATE KEY-----"), (3, "-----BEGIN PUBLIC KEY-----")]
    found = secrets.scan_secrets(spark.createDataFrame([(*r, "o") for r in rows], "doc_id long, text string, source string"))
    kinds = {r["doc_id"]: [s["kind"] for s in r["spans"]] for r in found.collect()}
    assert "pem" in kinds[1] and "pem" in kinds[2] and "pem" not in kinds[3]


def test_columns_of_any_name_stay(spark):
    item = "gamma delta epsilon zeta eta theta iota kappa"
    docs = spark.createDataFrame([(1, item, "a", 1, "r"), (2, "something else altogether", "b", 2, "s"), (None, None, "c", 3, "t")], "doc_id long, text string, `__key` string, its_key int, row string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    kept = decontamination.keep_unleaked(docs, bench)
    assert kept.columns == docs.columns and sorted((r["__key"], r["its_key"], r["row"]) for r in kept.collect()) == [("b", 2, "s"), ("c", 3, "t")]
    pages = spark.createDataFrame([(7, "http://a.example/x", "<p>" + "word " * 60 + "</p>")], "`__text` long, url string, html string")
    assert extraction.extract_pages(pages, key="__text").columns == ["__text", "url", "text", "n_chars"]


def test_a_cluster_without_a_shared_folder_is_an_error(spark, monkeypatch):
    class Conf:
        def get(self, name):
            return None

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

    with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
        scratch.shared_dir(Session())
    assert scratch.shared_dir(spark)
    assert scratch.written(spark.range(3).select(F.col("id")), "test").count() == 3


def test_the_pipeline_hands_python_few_documents_at_once(spark):
    """From the first stage on; a session with smaller batches keeps them."""
    before = spark.conf.get(scratch.ARROW_ROWS)
    try:
        for given, wanted in (("10000", corpus_pipeline.BATCH_ROWS), ("0", corpus_pipeline.BATCH_ROWS), ("500", 500)):
            spark.conf.set(scratch.ARROW_ROWS, given)
            corpus_pipeline.drop_toxic(spark, spark.createDataFrame([(1, "some text")], "doc_id long, text string"), "/root/testdata/sf0.001")
            assert int(spark.conf.get(scratch.ARROW_ROWS)) == wanted
    finally:
        spark.conf.set(scratch.ARROW_ROWS, before)
