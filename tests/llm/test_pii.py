"""Hidden personal data: planted forms must be found, look-alikes left alone, base spans never change."""

import random

import pytest
from pyspark.sql import functions as F

from matchlake.llm import pii


def numbers(rng, n):
    return "".join(str(rng.randrange(10)) for _ in range(n))


def corpus(seed, docs=900):
    """Rows, and by row the hidden values and the look-alikes; one document in three holds a plain base match."""
    rng = random.Random(seed)
    words = "the a river stone walks under green light while people read old books about ships and wind".split()
    rows, hidden, alike = [], {}, {}
    for i in range(docs):
        def prose():
            return " ".join(rng.choice(words) for _ in range(rng.randrange(4, 20)))  # noqa: B023

        name, host = "".join(rng.choice("abcdefgh") for _ in range(6)), "".join(rng.choice("klmnop") for _ in range(5))
        area, mid, last = numbers(rng, 3), numbers(rng, 3), numbers(rng, 4)
        value, kind = "", i % 6
        if kind in (0, 1):
            value = rng.choice([f"{name}@{host}.com", f"{name}.{host}@mail{i % 7}.{host}.org", f"+1 ({area}) {mid}-{last}", f"+49 {area} {mid}{last}", f"{rng.randrange(1, 255)}.{rng.randrange(255)}.{rng.randrange(255)}.{rng.randrange(255)}"])
        elif kind == 2:
            value = rng.choice([f"{name} (at) {host} (dot) com", f"{name}[at]{host}[dot]org", f"{name} at {host} dot com", f"{name} @ {host}.net", f"call ({area}) {mid}-{last}", f"tel {area}-{mid}-{last}"])
            hidden[i] = value.removeprefix("call ").removeprefix("tel ")
        elif kind == 3:
            value = rng.choice([f"20{numbers(rng, 2)}-0{rng.randrange(1, 10)}-1{rng.randrange(10)} 1{rng.randrange(10)}:3{rng.randrange(10)}", f"{numbers(rng, 7)}", f"1{numbers(rng, 11)}", "see (at) noon", "look (at) page 7"])
            alike[i] = value
        rows.append((i, f"{prose()} {value} {prose()}"))
    return rows, hidden, alike


@pytest.fixture(scope="module")
def found(spark):
    rows, hidden, alike = corpus(7)
    spans = {r["key"]: r["spans"] for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    return {i: [t[s["start"]:s["end"]] for s in spans[i] if not s["base"]] for i, t in rows}, hidden, alike


def test_hidden_values_are_added(found):
    added, hidden, _ = found
    hits = sum(any(v in a or a in v for a in added[i]) for i, v in hidden.items())
    assert hits / len(hidden) >= 0.9, [(v, added[i]) for i, v in hidden.items() if not added[i]][:20]


def test_what_is_added_is_hidden_data(found):
    added, hidden, alike = found
    every = [(i, a) for i, own in added.items() for a in own]
    good = sum(i in hidden and (a in hidden[i] or hidden[i] in a) for i, a in every)
    assert good / len(every) >= 0.95, [x for x in every if x[0] not in hidden][:20]


def test_hidden_values_of_a_real_table_are_added(spark):
    """The test tables hold none, so some are put into a few documents."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    name = F.concat(F.translate(F.hex("doc_id"), "0123456789", "klmnopqrst"), F.lit("abc"))
    put = (F.when(F.col("doc_id") % 80 == 3, F.concat("text", F.lit(" write to "), name, F.lit(" (at) example (dot) org today")))
           .when(F.col("doc_id") % 80 == 4, F.concat("text", F.lit(" call (212) 555-0"), F.lpad(F.col("doc_id").cast("string"), 3, "0"), F.lit(" now"))).otherwise(F.col("text")))
    both = pii.find_pii(docs.withColumn("text", put)).collect()
    asked = [r for r in both if r["key"] % 80 in (3, 4)]
    hits = sum(any(not s["base"] for s in r["spans"]) for r in asked)
    wrong = sum(any(not s["base"] for s in r["spans"]) for r in both if r["key"] % 80 not in (3, 4))
    assert hits / len(asked) >= 0.85 and wrong <= 0.01 * len(both), (hits, len(asked), wrong)


def test_every_candidate_teaches_the_trees(spark, monkeypatch):
    """What the trees and thresholds are learnt from counts all base matches, each hidden in all ways, and all wide candidates."""
    kept = {}

    def spy(df, label):
        kept[label] = real(df, label)
        return kept[label]

    real = pii.written
    monkeypatch.setattr(pii, "written", spy)
    base = spark.range(4000).select(F.col("id").alias("text_hash"), F.lit("ip").alias("kind"), F.lit(0).cast("long").alias("start"), F.lit(8).cast("long").alias("end"), F.concat(F.lit("10.20."), F.col("id") % 200, F.lit(".7")).alias("hit"),
                                    F.lit("").alias("number"), F.lit("at ").alias("before"), F.lit(" x").alias("after"))
    wide = spark.range(9000).select(F.col("id").alias("text_hash"), F.lit("number").alias("kind"), F.lit(0).cast("long").alias("start"), F.lit(9).cast("long").alias("end"), F.lpad(F.col("id").cast("string"), 9, "1").alias("hit"), F.lit("no ").alias("before"), F.lit(" x").alias("after"))
    assert pii._learnt(base, wide, 2, 2, 0.9) is not None
    assert {r["label"]: r["n"] for r in kept["pii-sample"].groupBy("label").agg(F.sum("times").alias("n")).collect()} == {1.0: 4000 * len(pii.HIDDEN["ip"]) * 2, 0.0: 9000}
