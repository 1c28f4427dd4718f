"""Nulls in any column, empty and very long texts, ties, repeated rows, empty tables and clashing column names, for every operator and stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from matchlake.llm import decontamination, extraction, language_model, ngram_join, packing, pii, quality, secrets, sharding, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, `row` int, words string, score int, start int, spans string, found string, n int, label string, kept int"
LONG = " ".join(f"word{i % 977}x{i % 31}" for i in range(60_000))
ROWS = [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu", "en", "s1"), (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu", "en", "s1"),
        (2, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu", None, None), (3, "", "en", "s1"), (4, None, None, None), (5, " \n\t ", "xx", ""), (None, "no key here but a few words", "de", "s2"),
        (None, None, None, None), (6, "one", "en", "s1"), (7, LONG, "en", "s1"), (8, "idiot moron mail me at a.b@c.example.org or 10.0.0.1 card 4111 1111 1111 1111 call +1 (555) 555-1234 token = abcdef0123456789abcdef", "en", "s3"),
        (9, "\x00 ퟿ \U0001f600 ａｂｃ  double  spaces\r\n\x85end", "fr", "s4")]


def frame(spark, rows=ROWS):
    return spark.createDataFrame([(*r, len(r[1] or ""), "k", 1, "w", 2, 3, "s", "f", 4, "l", 5) for r in rows], SCHEMA)


def labels(spark, empty=False):
    return spark.createDataFrame([] if empty else [(8, 1, 1), (1, 1, 0), (None, None, None), (2, 0, None), (8, 1, 1), (6, 1, 0)], "doc_id long, quality int, toxic int")


def benchmark(spark, empty=False):
    return spark.createDataFrame([] if empty else [(1, "gamma delta epsilon zeta eta theta iota kappa"), (2, None), (None, "alpha beta gamma delta epsilon"), (3, ""), (4, "one"), (5, "gamma delta epsilon zeta eta theta iota kappa")],
                                 "item_id long, text string")


def pages(df):
    return df.select(F.col("doc_id").alias("page_id"), F.col("source").alias("url"), F.col("text").alias("html"), "key", "found", "score")


OPERATORS = {
    "toxicity": lambda s, d, e: toxicity.score(d, toxicity.train(d, labels(s, e))),
    "sharding": lambda s, d, e: sharding.shard_by_bytes(d, shards=4),
    "ngram_join": lambda s, d, e: ngram_join.similar_sets(d),
    "extraction": lambda s, d, e: extraction.extract_pages(pages(d)),
    "packing": lambda s, d, e: packing.pack_documents(d),
    "quality": lambda s, d, e: quality.quality_rules(d),
    "language_model": lambda s, d, e: language_model.language_scores(d),
    "secrets": lambda s, d, e: secrets.scan_secrets(d),
    "pii": lambda s, d, e: pii.find_pii(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_every_row_gets_a_result(spark, name):
    found = OPERATORS[name](spark, frame(spark), False).collect()
    assert len(found) == len(ROWS) if name != "packing" else len(found) >= len(ROWS)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark, frame(spark, []), True).collect() == []


@pytest.mark.parametrize("name", ["toxicity", "quality", "language_model", "ngram_join", "secrets", "extraction"])
def test_repeated_rows_get_equal_results(spark, name):
    found = [tuple(map(str, r)) for r in OPERATORS[name](spark, frame(spark), False).collect() if r[0] == 1]
    assert len(found) == 2 and found[0] == found[1]


def test_leaks(spark):
    found = {(r["key"], r["item"]) for r in decontamination.find_leaks(frame(spark), benchmark(spark)).collect()}
    assert found == {(1, 1), (1, 5), (2, 1), (2, 5), (6, 4)}
    assert decontamination.find_leaks(frame(spark, []), benchmark(spark)).collect() == []
    assert decontamination.find_leaks(frame(spark), benchmark(spark, True)).collect() == []


def test_redaction_keeps_rows_columns_and_nulls(spark):
    docs = frame(spark)
    out = pii.redact(docs)
    assert out.columns == docs.columns
    rows = out.collect()
    assert len(rows) == len(ROWS) and sum(r["text"] is None for r in rows) == 2
    (hit,) = [r["text"] for r in rows if r["doc_id"] == 8]
    assert "a.b@c.example.org" not in hit and "10.0.0.1" not in hit and "4111" not in hit and "555-1234" not in hit and hit.startswith("idiot moron mail me at [")


@pytest.mark.parametrize("empty", [False, True])
def test_stages(spark, tmp_path, empty):
    folder = str(tmp_path)
    labels(spark, empty).write.parquet(f"{folder}/labels.parquet")
    benchmark(spark, empty).write.parquet(f"{folder}/benchmark.parquet")
    docs = frame(spark, [] if empty else ROWS)
    columns = docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns, name
        out.write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        assert empty == (docs.count() == 0), name


def test_one_of_each_group_stays(spark):
    kept = corpus_pipeline.drop_near_copies(spark, frame(spark), "")
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(1) == 1 and 2 not in ids and ids.count(3) == 1 and 4 not in ids and 6 in ids and 7 in ids and ids.count(None) == 1
