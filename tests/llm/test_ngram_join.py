"""Links of shared and null keys in any order of rows, long lists in parts, and candidates against all pairs."""

import itertools
import random
import tracemalloc

import numpy as np
import pytest

from matchlake import scratch
from matchlake.llm import ngram_join


def shingle_set(text, size):
    w = ngram_join.words_of(text)
    return frozenset(zip(*[w[i:] for i in range(size)])) if len(w) >= size else frozenset([tuple(w)] if w else [])


def ids_by_hand(rows, size, percent):
    """The smallest key over rows that link or share a key, null where there is none."""
    sets, up = [shingle_set(t, size) for _, t in rows], list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        k = len(sets[a] & sets[b])
        if (sets[a] and sets[b] and 100 * k >= percent * len(sets[a] | sets[b])) or (sets[a] and sets[b] and rows[a][0] is not None and rows[a][0] == rows[b][0]):
            up[find(a)] = find(b)
    least = {}
    for i, (key, _) in enumerate(rows):
        if sets[i] and key is not None:
            least[find(i)] = min(least.get(find(i), key), key)
    return sorted(((k, len(s), least.get(find(i)) if s else k) for i, ((k, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def found(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted((tuple(r) for r in ngram_join.similar_sets(docs, **options).collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_shared_and_null_keys_in_any_order(spark, seed):
    rng = random.Random(seed)
    bases = [" ".join(f"w{rng.randrange(5000)}" for _ in range(200)) for _ in range(8)]

    def near(text):
        w = text.split()
        w[rng.randrange(len(w))] = f"e{rng.randrange(99)}"
        return " ".join(w)

    rows = [(5, bases[0]), (5, bases[1]), (7, near(bases[1])), (3, near(bases[0])), (None, near(bases[1])), (None, near(bases[2])), (None, bases[2]), (9, near(bases[3])), (9, bases[3]), (8, bases[4]), (None, near(bases[4])),
            (None, None), (11, ""), (11, bases[5]), (12, near(bases[5]))]
    wanted = ids_by_hand(rows, 3, 90)
    for _ in range(2):
        rng.shuffle(rows)
        assert found(spark, rows) == wanted


def test_long_lists_in_parts(spark, monkeypatch):
    """Lists longer than a group, with one large component, several small ones and sets that link with nothing."""
    monkeypatch.setattr(ngram_join, "CHUNK", 16)
    monkeypatch.setattr(ngram_join, "LEADERS", 3)
    monkeypatch.setattr(ngram_join, "BATCH", 2)
    rng = random.Random(4)
    core = [f"c{j}" for j in range(60)]
    rows = []
    for i in range(150):
        w = list(core)
        for _ in range(rng.choice([0, 1, 1, 2, 4, 8])):
            w[rng.randrange(len(w))] = f"e{rng.randrange(40)}"
        rows.append((i, " ".join(w)))
    assert found(spark, rows, size=3, percent=80) == ids_by_hand(rows, 3, 80)


@pytest.mark.parametrize("num", [60, 80, 90])
def test_candidates_are_never_lost(num):
    rng = np.random.default_rng(num)
    base = np.unique(rng.integers(0, 1 << 62, 300).astype(np.uint64))
    sets = []
    for _ in range(260):
        keep = rng.random(len(base)) > rng.choice([0.0, 0.02, 0.1, 0.3])
        sets.append(np.unique(np.concatenate([base[keep], rng.integers(0, 1 << 62, rng.choice([0, 5, 40, 400])).astype(np.uint64)])))
    token = base[int(np.argmax(sum(np.isin(base, s).astype(int) for s in sets)))]
    sets = [s for s in sets if token in s]
    pos = np.array([int(np.searchsorted(s, token)) for s in sets])
    n = np.array([len(s) for s in sets])
    a, b, _ = ngram_join._survivors(pos, n, [ngram_join._sketch(s) for s in sets], num, 100)
    got = [tuple(sorted(x)) for x in zip(a.tolist(), b.tolist(), strict=True)]
    wanted = {(x, y) for x, y in itertools.combinations(range(len(sets)), 2) if 100 * len(np.intersect1d(sets[x], sets[y])) >= num * len(np.union1d(sets[x], sets[y]))}
    assert wanted <= set(got) and wanted
    assert len(set(got)) < len(sets) * (len(sets) - 1) / 2 or num == 60


def test_one_row_of_each_group_stays(spark):
    rng = random.Random(8)
    bases = [" ".join(f"w{rng.randrange(5000)}" for _ in range(100)) for _ in range(4)]
    rows = [(5, bases[0], "x"), (5, bases[1], "y"), (7, bases[1] + " end", "z"), (None, bases[1], "u"), (None, bases[2], "u"), (None, bases[2], "v"), (6, "", "a"), (4, None, "b"), (4, "", "c"), (9, " ", "d"), (8, bases[3], "e"), (8, bases[3], "f")]
    for _ in range(2):
        rng.shuffle(rows)
        kept = ngram_join.keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string, doc string"))
        assert kept.columns == ["doc_id", "text", "doc"]
        got = sorted(((r["doc_id"], r["text"] or "") for r in kept.collect()), key=str)
        assert got == sorted([(5, bases[0]), (5, bases[1]), (None, bases[2]), (4, ""), (9, " "), (8, bases[3])], key=str)


def test_pairs_of_lists_of_one_task_are_told_once():
    """Two lists with the same sets propose each pair once, and a list with pairs left tells its token."""
    import pandas as pd

    rows = pd.DataFrame([(token, 0, 0, 1, rep, 40, bytes(32), rep) for token in (7, 8) for rep in (1, 2, 3)], columns=["token", "i", "j", "pos", "rep", "n", "sketch", "label"])
    told = pd.concat(list(ngram_join._pair_rows(90, 100, 64)(iter([rows]))))
    assert sorted(map(tuple, told.to_numpy().tolist())) == [(1, 2), (1, 3), (2, 3)]
    twins = rows.assign(label=[1, 1, 2, 1, 1, 2])
    left = pd.concat(list(ngram_join._pair_rows(90, 100, 1)(iter([twins]))))
    assert sorted(set(left[left["a"] == -1]["b"])) == [7, 8]


def test_components_that_more_edges_extend(spark):
    """New edges join known components, lone nodes and each other; the smallest node names each."""
    def table(pairs):
        return spark.createDataFrame(pairs, "a long, b long")

    labels = ngram_join.components(table([(2, 3), (3, 4), (7, 8), (10, 11)]))
    more = table([(4, 9), (9, 7), (20, 21), (1, 11), (2, 4)])
    wanted = {1: 1, 10: 1, 11: 1, 20: 20, 21: 20} | dict.fromkeys([2, 3, 4, 7, 8, 9], 2)
    assert dict(map(tuple, ngram_join.extended(labels, more).collect())) == wanted
    assert dict(map(tuple, ngram_join.extended(labels, table([(3, 2)])).collect())) == dict(map(tuple, labels.collect()))


def test_sketches_are_not_written_with_the_lists(spark, monkeypatch):
    """A list's rows are shuffled several times and kept; the sketches, most of their bytes, join them last."""
    kept = {}

    def spy(df, label):
        kept.setdefault(label, []).append(df.columns)
        return real(df, label)

    real = ngram_join.written
    monkeypatch.setattr(ngram_join, "written", spy)
    rows = [(i, " ".join(f"w{j}" for j in range(40)) + f" e{i}") for i in range(6)]
    assert found(spark, rows, size=3, percent=80) == ids_by_hand(rows, 3, 80)
    assert kept["join-lists"] and all("sketch" not in columns for columns in kept["join-lists"])


def test_a_long_list_of_long_sketches_is_read_in_bounded_memory():
    """All pairs of a full list at once are 250 MB of sketches and more of what is made of them."""
    rng = np.random.default_rng(5)
    one = rng.integers(0, 256, 2048, dtype=np.uint8)
    rows = np.repeat(one[None], 350, axis=0)
    rows[np.arange(350), rng.integers(0, 2048, 350)] ^= 1
    pos, n = np.zeros(350, np.int64), np.full(350, 8000)
    tracemalloc.start()
    a, b, far = ngram_join._survivors(pos, n, [r.tobytes() for r in rows], 80, 100)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 64 << 20
    assert len({(min(x, y), max(x, y)) for x, y in zip(a.tolist(), b.tolist(), strict=True)}) == len(a) == 350 * 349 // 2
    bits = rows.view(np.uint64)
    assert all(f == int(np.bitwise_count(bits[x] ^ bits[y]).sum()) for x, y, f in zip(a[:500], b[:500], far[:500], strict=True))


def test_python_steps_hold_few_rows_at_once(spark, monkeypatch):
    """The steps that read texts or sketches get small batches; the session's own number stands afterwards."""
    seen = {}

    def spy(df, label):
        seen.setdefault(label, set()).add(int(spark.conf.get(scratch.ARROW_ROWS)))
        return real(df, label)

    real, before = ngram_join.written, spark.conf.get(scratch.ARROW_ROWS)
    monkeypatch.setattr(ngram_join, "written", spy)
    rows = [(i, " ".join(f"w{j}" for j in range(40)) + f" e{i}") for i in range(6)]
    assert found(spark, rows, size=3, percent=80) == ids_by_hand(rows, 3, 80)
    assert all(seen[label] == {ngram_join.BATCH_ROWS} for label in ("join-words", "join-rows", "join-sets"))
    assert ngram_join.BATCH_ROWS in seen["join-pairs"] and spark.conf.get(scratch.ARROW_ROWS) == before
