"""Token counts against the libraries' own encoding of whole texts."""

import os
import random

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from matchlake.llm import queries as Q
from matchlake.llm import token_counts as tc

FOLDER = "/root/testdata/sf0.001"
FIXED = ["", " ", "  ", "a", " a", "a ", "  a  b   c    ", "don't we'll I'M", "x\n\n y\t z \r\n", "tab\t space", "  b", "a  b", "a   b", "᠎  b", "a​  b", "\x1c  b", "\x85 \x85  a",
         "　 漢字 かな", "﻿  bom", "<|endoftext|>", "a<|endoftext|>b", " <|endoftext|> <|endoftext|><|endoftext|>", "<|endoftext|", "< |endoftext|>", "\U0001f468‍\U0001f469 \U0001f600  x", "é é", "\x00 \x00", "1234567 12 3",
         "ſ ß İ ı", "٣٤ Ⅷ ½", "א ב", "a" * 5000, "ab " * 5000, "漢" * 3000, "-" * 4000, " " * 4000, "\n" * 3000, "𝒜𝒷  𝟘", "͸ ೝ \U0001e4d0 \U00011f00 a"]


def random_texts():
    rng = random.Random(11)
    marks = ["a", "Be", "the", " ", "  ", "\n", "\t", "'s", "'", "1", "23", ".", "...", "é", "漢", " ", " ", "\x85", "\x1f", "᠎", "​", "<|endoftext|>", "_", "\U0001f600", "́", "http://", "\r\n"]
    plain = ["".join(rng.choice("aB z'sltrevmd019.,!?_-~ ") for _ in range(rng.choice([3, 10, 60]))) for _ in range(3000)]
    return plain + ["".join(rng.choice(marks) for _ in range(rng.choice([3, 10, 60]))) for _ in range(3000)]


@pytest.fixture(scope="module", params=["byte_bpe_50k.json", "word_bpe_49k.json"])
def pair(request):
    return tc.JsonCounter(public_tokenizers.path(request.param)), Tokenizer.from_file(public_tokenizers.path(request.param))


def test_counts_equal_the_library(pair):
    count, library = pair
    for text in FIXED + random_texts():
        assert count(text) == len(library.encode(text, add_special_tokens=False)), repr(text[:80])


def test_every_proved_string_is_one_token(pair):
    count, library = pair
    ends = "</w>" if "!</w>" in library.get_vocab() else ""
    assert len(count.whole) > 0.99 * sum(s.endswith(ends) for s in library.get_vocab())
    assert all(len(library.model.tokenize(s)) == 1 for s in random.Random(1).sample(sorted(count.whole), 2000))
    assert "<|endoftext|>" not in count.whole


def test_proof_decides_what_is_merged(pair, monkeypatch):
    """A proved pre-token never reaches the merges, the others do, and without a proof the counts are the same."""
    count, _ = pair
    seen = []
    merges = count.tokenize
    monkeypatch.setattr(count, "tokenize", lambda s: seen.append(s) or merges(s))
    monkeypatch.setattr(count, "counts", {})
    text = "the house is on fire zzqxjk and the antidisestablishmentarianistically house"
    n = count(text)
    assert seen and not set(seen) & count.whole
    monkeypatch.setattr(count, "whole", frozenset())
    monkeypatch.setattr(count, "counts", {})
    assert count(text) == n and len(seen) > 10


def test_a_full_cache_is_emptied(monkeypatch):
    monkeypatch.setattr(tc, "CACHED", 10)
    count = tc.JsonCounter(public_tokenizers.path("byte_bpe_50k.json"))
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    text = " ".join(f"w{i}" for i in range(500))
    assert count(text) == len(library.encode(text, add_special_tokens=False).ids) and len(count.counts) <= 10 and len(count.older) <= 10


def test_pieces():
    count = tc.PieceCounter(public_tokenizers.path("piece_bpe_32k.model"))
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert all(count(t) == len(library.encode(t)) for t in FIXED[:20])


def test_edges(spark):
    rows = [(1, None), (2, ""), (None, "no key"), (3, "word " * 513), (3, "word " * 513), (4, " ".join(["a"] * 512)), (5, " ".join(["a"] * 513)), (6, "é漢\U0001f600")]
    df = spark.createDataFrame([(k, t, 7, "x") for k, t in rows], "doc_id long, text string, n_tokens int, key string")
    out = tc.count_tokens(df)
    assert out.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    wanted = [(k, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False)), n > 512) for k, t in rows]
    assert sorted(str(tuple(r)) for r in out.collect()) == sorted(map(str, wanted))
    assert tc.count_tokens(df.where("false")).collect() == []


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
def test_query_on_whole_table(spark):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    found = Q.op13_whole_tokens(spark, FOLDER).collect()
    assert len(found) == len(texts)
    assert all(r["n_tokens"] == len(library.encode(texts[r["doc_id"]], add_special_tokens=False)) for r in found)
