"""Wider spans and ownership over a planted corpus, against counts made by hand."""

import collections
import random
import time

from matchlake.llm import secrets

LETTERS = "ABCDEFGHJKLMNPQRSTUVWXYZabcdefghjkmnpqrstuvwxyz23456789"


def planted(seed=3):
    rng = random.Random(seed)

    def value(n):
        return "".join(rng.choice(LETTERS) for _ in range(n - 2)) + "a7"

    forms = [lambda v: f"ghp_{v}", lambda v: f"glpat-{v}", lambda v: f"bearer {v}", lambda v: f"client_id = '{v}'", lambda v: v]
    # (owners, documents of each): live are those of one owner in at most three documents
    plans = [(1, 1), (1, 2), (1, 3), (1, 4), (1, 40), (2, 1), (5, 1), (3, 2)] * 6
    rows, wanted = [], collections.defaultdict(set)
    for owners, each in plans:
        form, v = rng.choice(forms), value(30)
        names = rng.sample(range(40), owners)
        for name in names:
            for _ in range(each):
                before = " ".join(rng.choice(["plain", "words", "café", "of prose"]) for _ in range(rng.randrange(1, 9))) + " "
                rows.append((len(rows), before + form(v) + " after it", f"o{name}"))
                if owners == 1 and each <= 3:
                    wanted[len(rows) - 1].add(v)
    return rows, wanted


def test_planted_values_are_found_and_copied_ones_are_not(spark):
    rows, wanted = planted()
    found = {r["doc_id"]: r["spans"] for r in secrets.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    texts = {i: t for i, t, _ in rows}
    for i in texts:
        got = [texts[i][s["start"]:s["end"]] for s in found[i]]
        assert len(got) == len(wanted[i]) and all(any(v in g for g in got) for v in wanted[i]), (texts[i], got)
    assert sum(map(len, wanted.values())) == 36


def test_a_value_in_many_documents_of_one_owner_is_copied(spark):
    rows = [(i, f'token = "{"a1b2c3d4" * 5}"', "one") for i in range(5)]
    for r in secrets.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect():
        assert [(s["base"], s["owners"], s["repositories"], s["live"]) for s in r["spans"]] == [(True, 1, 5, False)] * 2


def test_values_that_are_everywhere_are_judged_alike(spark, monkeypatch):
    rows, _ = planted()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    light = sorted(map(str, secrets.scan_secrets(docs).collect()))
    monkeypatch.setattr(secrets, "HEAVY", 2)
    assert sorted(map(str, secrets.scan_secrets(docs).collect())) == light


def test_long_runs_of_spaces_and_letters_take_no_time():
    began = time.time()
    for text in ("auth" + " " * 200_000, "password" + " " * 200_000 + "x", "x" * 400_000, "auth " * 50_000, "a/" * 100_000):
        secrets.wide_matches(text, secrets.base_matches(text))
    assert time.time() - began < 5
    (found,) = secrets.wide_matches("qrstuvwxyz" * 30 + "rstuvwxyz0abcdefgh", [])  # the first digit comes late
    assert found[:3] == ("mixed", 0, 318)
