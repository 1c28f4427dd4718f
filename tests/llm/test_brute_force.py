"""Corpus operators against brute force, exact round trips, held-out accuracy and independent rules."""

import collections
import hashlib
import itertools
import math
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchlake.llm import decontamination, extraction, language_model, ngram_join, packing, pii, quality, secrets, sharding, toxicity
from matchlake.llm import queries as Q

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
WORD = re.compile("[^\x20\x09-\x0d]+")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}


def crc(key):
    return zlib.crc32(str(key).encode())


# --- 1 toxicity


def test_pu_learning_separates_and_never_uses_held_out_labels(spark):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(3000):
        words = [f"w{rng.randrange(300)}" + "abcdefgh"[rng.randrange(8)] for _ in range(30)]
        words = ["".join(chr(97 + int(c)) if c.isdigit() else c for c in w) for w in words]
        toxic = i % 10 == 0
        if toxic:
            words[rng.randrange(30)] = rng.choice(["grukko", "blarno", "snivex"])
        rows.append((i, " ".join(words)))
        if crc(i) % 3 == 1 or i % 4 < 3:
            labels.append((i, int(toxic) if crc(i) % 3 != 1 else int(not toxic)))  # held-out labels are lies
    docs, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    found = toxicity.score(docs, toxicity.train(docs, lab)).toPandas()
    held = found[found["held_out"]]
    truth = held["doc_id"] % 10 == 0
    assert ((held["predicted"] == 1) == truth).mean() > 0.98
    assert found["score"].between(0, 1).all()
    assert (found["held_out"] == [crc(i) % 3 == 1 for i in found["doc_id"]]).all()


def test_nonnegative_risk_keeps_the_negative_part_up():
    rng = np.random.default_rng(0)

    def rows(n):
        row, column = np.nonzero(rng.random((n, 60)) < 0.5)
        return toxicity.Rows(row, column, n)

    p, u = rows(40), rows(80)
    w = toxicity.nonnegative_pu(p, u, 60, 0.5)
    assert np.isfinite(w).all() and np.logaddexp(0, u.dot(w)).mean() - 0.5 * np.logaddexp(0, p.dot(w)).mean() > -0.5


def test_gradients_of_the_risk_match_differences():
    rng = np.random.default_rng(1)
    x = (rng.random((9, 4)) < 0.5).astype(float)
    rows, w = toxicity.Rows(*np.nonzero(x), 9), rng.normal(size=5)
    assert np.allclose(rows.dot(w), x @ w[:4] + w[4])
    slope = rng.normal(size=9)
    assert np.allclose(rows.back(slope, 4), np.append(x.T @ slope, slope.sum()) / 9)
    keep, columns = rng.random(9) < 0.6, np.array([1, -1, 0, -1])
    small = rows.only(keep, columns)
    assert np.allclose(small.dot(np.array([2.0, 3.0, 0.5])), x[keep][:, [2, 0]] @ [2.0, 3.0] + 0.5)


def test_scores_are_the_sums_of_levels_by_hand():
    weights = {h: tuple(0.1 * (h % 7 + k) for k in range(4)) for w in ("idiot", "other", "the") for h in toxicity.word_features(w)}
    model = toxicity.Model(weights, -1.0, 2.0, 0.5)
    for text in ("", "the idiot", "The 1D10T the other " * 3 + "x " * 400, "the " * 70 + "y " * 500, None):
        ids = toxicity._Features().of(text).tolist()
        wanted = 2 * (-1.0 + sum(weights[i & ~3][i & 3] for i in ids if i & ~3 in weights)) + 0.5
        assert math.isclose(model.logit(text, {}), wanted, rel_tol=1e-9)


@pytest.mark.parametrize("folder,recall,precision", [("sf0.01", 0.6, 0.95), ("sf0.1", 0.9, 0.95)])
def test_held_out_toxic_documents_are_found(spark, folder, recall, precision):
    if not os.path.isdir(f"/root/testdata/{folder}"):
        pytest.skip("no such tables here")
    found = {r["doc_id"]: r["predicted"] for r in Q.op1_nonnegative_pu(spark, f"/root/testdata/{folder}").where("held_out").collect()}
    truth = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"/root/testdata/{folder}/labels.parquet").collect() if r["doc_id"] in found}
    hits = sum(found[i] for i, t in truth.items() if t)
    assert hits / sum(truth.values()) >= recall and hits / sum(found[i] for i in truth) >= precision


# --- 2 sharding


def test_shards(spark, docs, texts):
    rows = Q.op2_sampled_splitters(spark, FOLDER).collect()
    assert {r["doc_id"] for r in rows} == set(texts) and len(rows) == len(texts)
    total, by = 0, collections.defaultdict(list)
    for r in rows:
        data = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 8, zlib.crc32(data), "bytes", None)
        by[r["shard"]].append(r)
        total += r["size"]
    most = max(r["size"] for r in rows)
    for shard, own in by.items():
        assert 0 <= shard < 24 and sorted(r["slot"] for r in own) == list(range(len(own)))
        assert abs(sum(r["size"] for r in own) - total / 24) <= most


def test_shards_of_one_hot_key_and_one_giant(spark):
    rows = [(1, "x" * 100)] * 500 + [(2, "y" * 5000)]
    found = sharding.shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string"), shards=5).collect()
    sizes = collections.Counter()
    for r in found:
        sizes[r["shard"]] += r["size"]
    assert len(found) == 501 and max(sizes.values()) - min(sizes.values()) <= 2 * 5008


@pytest.mark.parametrize("kind", ["long", "string"])
def test_ranges_of_too_many_rows_are_cut(spark, monkeypatch, kind):
    """One hot key, a null one and equal rows, in ranges of a few rows each: the law holds as before."""
    monkeypatch.setattr(sharding, "RANGE_ROWS", 20)
    rng = random.Random(3)
    rows = [(1, "y" * rng.randrange(200)) for _ in range(300)] + [(None, "z" * rng.randrange(50)) for _ in range(200)] + [(2, "same")] * 200 + [(i, "x" * rng.randrange(300)) for i in range(3, 200)]
    rows = [(None if k is None else str(k) if kind == "string" else k, t) for k, t in rows]
    found = sharding.shard_by_bytes(spark.createDataFrame(rows, f"doc_id {kind}, text string"), shards=7).collect()
    sizes, slots = collections.Counter(), collections.defaultdict(list)
    for r in found:
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert sorted((str(r["doc_id"]), r["size"]) for r in found) == sorted((str(k), len(t) + 8) for k, t in rows)
    assert max(sizes.values()) - min(sizes.values()) <= 2 * 308 and len(sizes) == 7
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


# --- 3 n-gram join


def shingle_set(text, size):
    w = ngram_join.words_of(text)
    return frozenset(zip(*[w[i:] for i in range(size)])) if len(w) >= size else frozenset([tuple(w)] if w else [])


def components_of(sets, percent):
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations([i for i in sets if sets[i]], 2):
        k = len(sets[a] & sets[b])
        if 100 * k >= percent * (len(sets[a]) + len(sets[b]) - k):
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


@pytest.mark.parametrize("size,percent", [(3, 90), (5, 80)])
def test_components_match_all_pairs(spark, size, percent):
    rng = random.Random(size)
    rows = []
    for g in range(12):
        base = [f"g{rng.randrange(40)}" for _ in range(rng.choice([3, 8, 30, 80, 400]))]
        for _ in range(rng.choice([1, 2, 30])):
            w = list(base)
            for _ in range(rng.randrange(0, max(2, len(w) // 25))):
                at = rng.randrange(len(w))
                w[at:at + rng.randrange(2)] = [f"e{rng.randrange(30)}"] * rng.randrange(2)
            rows.append(" ".join(w))
    rows += ["license to copy this passage here " + " ".join(f"u{i}x{j}" for j in range(20)) for i in range(30)] + ["", "a", "a", "a b"]
    rng.shuffle(rows)
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    sets = {i: shingle_set(t, size) for i, t in enumerate(rows)}
    wanted = components_of(sets, percent)
    for r in ngram_join.similar_sets(docs, size=size, percent=percent).collect():
        assert (r["n_shingles"], r["component_id"]) == (len(sets[r["doc_id"]]), wanted[r["doc_id"]])


def test_sketches_never_overstate_a_difference():
    rng = np.random.default_rng(2)
    for n in (5, 200, 3000):
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[n // 3:], rng.integers(0, 1 << 63, n // 4).astype(np.uint64)]))
        x, y = ngram_join._sketch(a), ngram_join._sketch(b)
        while len(x) != len(y):
            x, y = (x, y) if len(x) > len(y) else (y, x)
            x = bytes(p ^ q for p, q in zip(x[:len(x) // 2], x[len(x) // 2:], strict=True))
        assert sum(bin(p ^ q).count("1") for p, q in zip(x, y, strict=True)) <= len(set(a) ^ set(b))


# --- 4 extraction


def test_articles_of_the_pages(spark):
    from html import unescape

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()}
    for r in Q.op4_minimum_cut(spark, FOLDER).collect():
        inner = re.search(r"<article>(.*?)</article>", pages[r["page_id"]], re.S)[1]
        parts = [" ".join(unescape(re.sub("<[^>]+>", "", p)).split()) for p in re.split(r"</?(?:p|h1)>", inner)]
        assert r["text"] == "\n\n".join(p for p in parts if p) and r["n_chars"] == len(r["text"])


def test_boilerplate_of_a_richer_page():
    page = """<html><head><title>T</title><script>var a="<p>no</p>";</script></head><body><header><a href=/>Home</a></header><div class="cookie-notice">We use cookies. Accept them all now please.</div>
    <main><h1>Title &amp; more</h1><p>First paragraph of the story, long enough to be read.</p><aside class=ad>Buy this</aside><p>Second  paragraph<br>goes on&nbsp;here, with a <a href=x>link</a>.</main>
    <section id=comments><p>Great post, I agree with every word of it!</p></section><form><label>Mail</label><input><button>Send</button></form><footer>&copy; 2024</footer>"""
    assert extraction.main_text(page) == "Title & more\n\nFirst paragraph of the story, long enough to be read.\n\nSecond paragraph goes on here, with a link."


def test_minimum_cut_equals_the_best_of_all_labellings():
    rng = random.Random(4)
    for _ in range(40):
        n = rng.randrange(2, 8)
        s, t = [rng.random() * rng.randrange(2) for _ in range(n)], [rng.random() for _ in range(n)]
        edges = [(a, b, rng.random()) for a, b in itertools.combinations(range(n), 2) if rng.random() < 0.5]

        def cost(side):
            return sum(t[i] if side[i] else s[i] for i in range(n)) + sum(c for a, b, c in edges if side[a] != side[b])  # noqa: B023

        assert math.isclose(cost(extraction.minimum_cut(s, t, edges)), min(cost(x) for x in itertools.product([False, True], repeat=n)), abs_tol=1e-6)


# --- 5 packing


def test_packing_round_trip(spark, docs, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = packing.pack_documents(docs, keep_ids=True).collect()
    parts, bins = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
        parts[r["doc_id"]].append(r)
        bins[r["sequence_id"]].append(r)
    for i, text in texts.items():
        ids = whole.encode(text, add_special_tokens=False).ids + [2]
        own = sorted(parts[i], key=lambda r: r["piece"])
        assert b"".join(r["ids"] for r in own) == np.array(ids, "<u4").tobytes()
        assert [r["start"] for r in own] == [sum(x["length"] for x in own[:k]) for k in range(len(own))]
        assert all(r["length"] == 1024 for r in own[1:]) and (len(ids) > 1024 or len(own) == 1)
    for own in bins.values():
        place = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == place
            place += r["length"]
        assert place <= 1024
    assert len(bins) <= 1.01 * sum(r["length"] for r in rows) / 1024 + 1


@pytest.mark.parametrize("text", ["a  b", " lead", "trail ", "tab\tx \n y", "<|endoftext|> x", "it's we'll 12 34", "é\x85 x", "日本 語", "", "a　b c", "x" * 3000])
def test_encoder_equals_the_tokenizer(text):
    encode = packing.encoder("byte_bpe_50k")
    assert encode(text) == np.array(encode.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_evolution_is_no_worse_than_best_fit_and_places_all():
    rng = random.Random(9)
    lengths = [rng.randrange(200, 700) for _ in range(300)]
    plain = packing._packed([], list(range(300)), lengths, 1024)
    best = packing.evolve(lengths, 1024, 1, None, [[512, 512], [lengths[0], lengths[1]]], 6, 40)
    assert sorted(x for g in best.items for x in g) == list(range(300))
    assert len(best.items) <= len(plain.items) and all(sum(lengths[x] for x in g) <= 1024 for g in best.items)


# --- 6 decontamination


def test_leaks_match_all_windows(spark):
    rng = random.Random(6)
    items = [(i, " ".join(f"b{rng.randrange(60)}" for _ in range(rng.choice([7, 30, 70])))) for i in range(12)]
    rows = []
    for i in range(80):
        w = [f"d{rng.randrange(500)}" for _ in range(rng.randrange(5, 120))]
        if i % 2:
            own = rng.choice(items)[1].upper().split()
            for _ in range(i % 3):
                own[rng.randrange(len(own))] = "edit"
            at = rng.randrange(len(w))
            w[at:at] = own
        rows.append((i, " ".join(w)))
    of = collections.Counter()
    sets = {}
    for i, t in items:
        w = t.lower().split()
        sets[i] = (len(w), {tuple(w[k:k + 5]) for k in range(len(w) - 4)})
        of.update(sets[i][1])
    wanted = {}
    for d, t in rows:
        w = t.lower().split()
        for i, (n, own) in sets.items():
            for s in range(len(w) - n + 1):
                x = {tuple(w[s + k:s + k + 5]) for k in range(n - 4)}
                j = sum(1 / of[h] for h in x & own) / (sum(1 / of[h] for h in own) + len(x - own))
                if j >= 0.8:
                    wanted[(d, i)] = max(wanted.get((d, i), 0), j)
    found = {(r["key"], r["item"]): r["similarity"] for r in decontamination.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert found.keys() == wanted.keys() and all(abs(found[k] - wanted[k]) < 1e-9 for k in wanted) and len(wanted) > 10


def leaks_by_hand(rows, items):
    """(document, item) -> the best similarity of 0.8 or more over all windows."""
    of = collections.Counter()
    sets = {}
    for i, t in items:
        w = t.lower().split()
        sets[i] = (len(w), {tuple(w[k:k + 5]) for k in range(len(w) - 4)})
        of.update(sets[i][1])
    wanted = {}
    for d, t in rows:
        w = t.lower().split()
        for i, (n, own) in sets.items():
            for s in range(max(len(w) - n, 0) + 1):  # a text shorter than the item is one window
                x = {tuple(w[k:k + 5]) for k in range(s, min(s + n, len(w)) - 4)}
                j = sum(1 / of[h] for h in x & own) / (sum(1 / of[h] for h in own) + len(x - own))
                if j >= 0.8:
                    wanted[(d, i)] = max(wanted.get((d, i), 0), j)
    return wanted


def leaks_found(spark, rows, items):
    found = decontamination.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    return {(r["key"], r["item"]): r["similarity"] for r in found.collect()}


def test_leaks_with_clipped_edges_are_found(spark):
    rng = random.Random(66)
    items = [(i, " ".join(f"b{rng.randrange(900)}" for _ in range(rng.randrange(42, 60)))) for i in range(40)]
    every = [w for _, t in items for w in t.split()]
    rows = []
    for first, last in ((0, 4), (2, 2), (2, 3), (0, 5), (5, 0)):
        for _, t in items:
            w = t.split()
            w[:first] = rng.choices(every, k=first)
            w[len(w) - last:] = rng.choices(every, k=last)
            rows.append((len(rows), " ".join([*rng.choices(every, k=9), *w, *rng.choices(every, k=9)])))
    found, wanted = leaks_found(spark, rows, items), leaks_by_hand(rows, items)
    assert found.keys() == wanted.keys() and all(abs(found[k] - wanted[k]) < 1e-9 for k in wanted)
    assert sum(j < 0.83 for j in wanted.values()) > 20


def test_leaks_of_texts_shorter_than_the_item_are_found(spark):
    rng = random.Random(67)
    items = [(i, " ".join(f"b{rng.randrange(900)}" for _ in range(rng.choice([6, 20, 45, 59])))) for i in range(40)]
    rows = [(100 * i + cut, " ".join(t.split()[cut * side:len(t.split()) - cut * (1 - side)])) for i, t in items for cut in (1, 4, 9, 13) for side in [i % 2] if cut < len(t.split())]
    found, wanted = leaks_found(spark, rows, items), leaks_by_hand(rows, items)
    assert found.keys() == wanted.keys() and all(abs(found[k] - wanted[k]) < 1e-9 for k in wanted) and len(wanted) > 40


# --- 7 quality


def test_base_rules(spark, texts):
    for r in Q.op7_distribution_divergence(spark, FOLDER).collect():
        text = texts[r["doc_id"]]
        w = WORD.findall(text)
        grams = collections.Counter(tuple(w[k:k + 5]) for k in range(len(w) - 4))
        twice = {k + j for k in range(len(w) - 4) if grams[tuple(w[k:k + 5])] > 1 for j in range(5)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        failed = len(w) < 10 or 100 * len(twice) > 20 * len(w)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == (
            len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(twice), failed)
        assert not (failed and r["kept"])


def test_verdict_finds_junk_and_keeps_prose(spark):
    found = {r["doc_id"]: r for r in quality.quality_rules(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()}
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()
    good = [found[r["doc_id"]]["kept"] for r in labels if r["quality"] == 1 and not found[r["doc_id"]]["base_failed"]]
    bad = [found[r["doc_id"]]["kept"] for r in labels if r["quality"] == 0]
    assert sum(good) / len(good) > 0.99 and sum(bad) / len(bad) < 0.4


# --- 8 language model


def test_language_model(spark, texts):
    rows = Q.op8_hierarchical_pitman_yor(spark, FOLDER).collect()
    counts = collections.Counter()
    for i, t in texts.items():
        if crc(i) % 5 != 1:
            counts.update([*ngram_join.words_of(t), b"\n"])
    n, v = sum(counts.values()), len(counts)
    assert len(rows) == len(texts)
    for r in rows:
        w = [*ngram_join.words_of(texts[r["doc_id"]]), b"\n"]
        base = sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (crc(r["doc_id"]) % 5 == 1, len(w), sum(x in counts for x in w), n)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_predictions_sum_to_one():
    rng = np.random.default_rng(1)
    k = np.unique((rng.integers(1, 400, 3000).astype(np.uint64) << np.uint64(6)) | rng.integers(0, 5, 3000).astype(np.uint64))
    c = rng.integers(1, 9, len(k))
    words = np.unique(k >> np.uint64(6))
    start = np.nonzero(np.concatenate([[True], (k >> np.uint64(6))[1:] != (k >> np.uint64(6))[:-1]]))[0]
    context = (k & np.uint64(63)).astype(int)
    t = np.minimum(c, 2)
    served = np.add.reduceat(t, start)
    totals = language_model.Totals(np.bincount(context, c, 64).astype(float), np.bincount(context, t, 64).astype(float)[None], np.array([float(len(start))]), len(words), int(c.sum()), 0.6, 0.7)
    bucket = language_model._Bucket(language_model._pack(k=k, c=c, t0=t, r0=np.minimum(served, 1)), totals)
    for u in range(5):
        _, logs = bucket((words << np.uint64(6)) | np.uint64(u))
        unknown = totals.escape(0)[u] * totals.root_escape(0) / (len(words) + 1)
        assert math.isclose((10**logs).sum() + unknown, 1, rel_tol=1e-9)


# --- 9 secrets


def test_base_secrets(spark, texts):
    for r in Q.op9_ownership_frequency(spark, FOLDER).collect():
        text, found = texts[r["doc_id"]], []
        for m in re.finditer(r"(?ai:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text):
            found += [("assign", *m.span())] * (len(m[2]) >= 12)
        found += [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
        found += [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
        found.sort(key=lambda x: (x[1], ("assign", "access", "hex").index(x[0])))
        listed = ["%s:%d:%d" % x for x in found]
        assert r["base_sha256"] == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(x[0] == k for x in found) for k in ("assign", "access", "hex")]
        assert set(listed) <= set(r["spans"].split(",")) | {""}


def test_copied_examples_are_told_from_live_values(spark):
    live, example = "ghp_" + "a1B2c3D4e5F6g7H8i9J0k1L2", "ghp_" + "Z9y8X7w6V5u4T3s2R1q0P9o8"
    rows = [(i, f"use {example} as shown", f"owner{i}") for i in range(5)] + [(9, f"{live} and {example}", "me"), (10, f"again {live}", "me"), (11, "token: zyxwzyxwzyxwzyxw", "me")]
    found = {r["doc_id"]: r["spans"] for r in secrets.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(not found[i] for i in range(5))
    assert [(s["kind"], s["start"], s["live"], s["owners"], s["repositories"]) for s in found[9]] == [("vendor", 0, True, 1, 2)]
    assert [(s["kind"], s["base"], s["live"]) for s in found[11]] == [("assign", True, True)]


# --- 10 personal data


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def base_pii(text):
    found = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        found += [("card", *m.span())] * (13 <= len(digits) <= 19 and luhn(digits))
    return found + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


TRICKY = ["a@b.c_d@e.f.g x@y", "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.004 1..2.3.4", "4111 1111-1111 1111 2 4111111111111111", "+1 (555) 555-1234 +49.30.1234567- +1--", "a.b%c+d@e-f.g.h@i.j", "9" * 40 + " é\U0001f600 q@r.st",
          "+" * 50 + "1 2 3 4 5 6 7 8 9", "@@@ a@ @b.c", " ".join(str(i % 10) for i in range(3000)), "a" * 20000 + "@"]


def test_base_personal_data(spark, docs, texts):
    extra = {10_000 + i: t for i, t in enumerate(TRICKY)}
    both = docs.select("doc_id", "text").unionByName(spark.createDataFrame(list(extra.items()), "doc_id long, text string"))
    known = {**texts, **extra}
    for r in pii.find_pii(both).collect():
        wanted = base_pii(known[r["key"]])
        assert [(s["kind"], s["start"], s["end"]) for s in r["spans"] if s["base"]] == wanted
        taken = sorted((s["start"], s["end"]) for s in r["spans"] if not s["base"])
        assert all(e <= s for (_, e), (s, _) in zip(taken, taken[1:])) and all(e <= s or f <= b for b, e in taken for _, s, f in wanted)


def test_redaction_removes_every_base_span(spark, docs):
    for r in pii.redact(docs).select("text").collect():
        assert not base_pii(r["text"])
