"""Fill-in-middle against plain slicing and exact round trips."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from matchlake.llm import fill_in_middle as fim
from matchlake.llm import queries as Q


def expected(key, text):
    text = text or ""
    x = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h = [int(x[8 * i:8 * i + 8], 16) for i in range(4)]
    n = len(text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", text, None, None
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if h[3] % 100 < 20:
        return n, "spm", "<S>" + text[b:] + "<P>" + text[:a] + "<M>" + text[a:b], a, b - a
    return n, "psm", "<P>" + text[:a] + "<S>" + text[b:] + "<M>" + text[a:b], a, b - a


def some_texts():
    rng = random.Random(3)
    kinds = "ab \n\r\t\x00\x85é́ß漢字\U0001f600\U0001f468‍<PSM>/"
    fixed = [None, "", "x", "<", "<P", "a<P>b", "a<S>b", "<M>", "<<P", "ends with <", "<S", "é" * 255, "漢" * 256, "\U0001f600" * 257, "a" * 512, "b" * 513, "\r\n" * 400, "word " * 60_000]
    return fixed + ["".join(rng.choice(kinds) for _ in range(rng.choice([1, 2, 7, 200, 256, 300, 1000]))).replace("<P>", "<P").replace("<S>", "<S").replace("<M>", "<M") for _ in range(200)]


@pytest.mark.parametrize("text", ["", "a", "é漢\U0001f600\n\r\n\x00", "x" * fim.BLOCK, "x" * (fim.BLOCK + 1), "é" * (3 * fim.BLOCK), "ab\U0001f600" * 300])
def test_units_are_code_points(text):
    units = fim.Units(text)
    assert units.n == len(text)
    assert [units.start(i) for i in {0, 1, len(text) // 2, max(0, len(text) - 1), len(text)} if i <= len(text)] == [i for i in {0, 1, len(text) // 2, max(0, len(text) - 1), len(text)} if i <= len(text)]
    assert fim.offsets(text) == [(i, i + 1) for i in range(len(text))]


def test_forms_outputs_and_round_trips(spark):
    rows = list(enumerate(some_texts())) + [(None, "no key"), (None, None), (5, "a text again"), (5, "a text again")]
    df = spark.createDataFrame([(k, t, "clash", 1) for k, t in rows], "doc_id long, text string, made string, n int")
    out = fim.fill_in_middle(df)
    assert out.columns == ["doc_id", "n", "form", "output", "prefix_chars", "middle_chars"]
    found = out.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert sorted(map(str, [tuple(r)[:6] for r in found])) == sorted(str((k, *expected(k, t))) for k, t in rows)
    assert sorted(r["back"] for r in found) == sorted(t or "" for _, t in rows)
    assert {r["form"] for r in found} == {"plain", "psm", "spm"}


def test_seed_and_shares_matter(spark):
    df = spark.createDataFrame([(i, f"text number {i} " * 3) for i in range(400)], "doc_id long, text string")
    shares = fim.fill_in_middle(df, plain_percent=50, spm_percent=100).groupBy("form").count().collect()
    assert {r["form"] for r in shares} == {"plain", "spm"} and all(150 < r["count"] < 250 for r in shares)
    one, two = ({r["doc_id"]: r["prefix_chars"] for r in fim.fill_in_middle(df, seed=s).collect()} for s in (1, 2))
    assert one != two


def test_empty_table(spark):
    assert fim.fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_query_digests(spark, tmp_path):
    rows = list(enumerate(some_texts()))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["doc_id"]: r for r in Q.op11_split_offsets(spark, str(tmp_path)).collect()}
    for key, text in rows:
        n, form, output, a, b = expected(key, text)
        assert tuple(found[key]) == (key, n, form, a, b, hashlib.sha256(output.encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())
