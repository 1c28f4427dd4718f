"""Token counts by whole tokens: a pre-token that the vocabulary is proved to encode as one token counts one, the rest is merged.

The proof is made once a worker: every string of the vocabulary is encoded alone by the library's model, and those that
give one token are kept. The merges see one pre-token at a time, so the proof holds in any text. Pre-tokens come from
the library's own pre-tokenizer. Where its pattern never puts a space behind other than white space in one pre-token,
a text is cut at such spaces, and the counts of short stretches are kept in a bounded cache. A stretch of printable
ASCII after at most one space is cut by the same pattern with ASCII classes, which says the same of such characters.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CACHED = 200_000  # stretches of each of two generations; the older one goes when the younger is full
CACHED_CHARS = 48  # of the longest stretch that is kept
#: A space behind something that no Unicode version and no engine takes for white space.
_CUT = re.compile(" (?<=[^\\s\x1c-\x1f\x85\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u2064\u3000\ufeff] )")
#: Stretches whose pre-tokens the pattern below gives, and that pattern: byte-level vocabularies write them as they are, but for the space.
_PLAIN = re.compile("Ġ?[!-~]+")
_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|Ġ?[A-Za-z]+|Ġ?[0-9]+|Ġ?[^A-Za-z0-9Ġ]+")


class JsonCounter:
    """Tokens of a text by a vocabulary of the tokenizers library, without special tokens around it."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        said = json.loads(self.library.to_str())
        model, before = said["model"], said["pre_tokenizer"] or {}
        self.tokenize, self.split, self.normalizer = self.library.model.tokenize, self.library.pre_tokenizer, self.library.normalizer
        self.added = [t["content"] for t in said["added_tokens"]]
        #: Strings of added tokens that stand for themselves wherever they are: the text is cut there.
        self.plain = all(not any(t[k] for k in ("single_word", "lstrip", "rstrip", "normalized")) for t in said["added_tokens"])
        #: The pattern of this kind starts a pre-token at a space behind other than white space.
        self.by_spaces = self.normalizer is None and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space")
        #: Only such models see each pre-token alone and unchanged by chance.
        self.proves = model["type"] == "BPE" and not model.get("dropout") and self.split is not None
        self.whole = self._proved(model.get("end_of_word_suffix") or "") if self.proves else frozenset()
        self.counts: dict[str, int] = {}
        self.older: dict[str, int] = {}
        self.cuts = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None

    def _proved(self, suffix: str) -> frozenset[str]:
        strings = (s.removesuffix(suffix) for s in self.library.get_vocab() if s.endswith(suffix))
        return frozenset(s for s in strings if s and len(self.tokenize(s)) == 1)

    def _merged(self, stretch: str) -> int:
        """Tokens of a stretch whose pre-tokens do not depend on what is around it."""
        return self._counted([p for p, _ in self.split.pre_tokenize_str(stretch)])

    def _counted(self, pre_tokens: list[str]) -> int:
        whole, tokenize = self.whole, self.tokenize
        return sum([1 if p in whole else len(tokenize(p)) for p in pre_tokens])

    def _kept(self, stretch: str, space: bool) -> int:
        """The count of a stretch without its space, from the older generation or counted now, and kept if it is short."""
        name = f" {stretch}" if space else stretch
        n = self.older.get(name)
        if n is None:
            written = f"Ġ{stretch}" if space else stretch
            n = self._counted(_ASCII.findall(written)) if stretch.isascii() and _PLAIN.fullmatch(written) else self._merged(name)
        if len(name) <= CACHED_CHARS:
            if len(self.counts) >= CACHED:
                self.older, self.counts = self.counts, {}
            self.counts[name] = n
        return n

    def _stretches(self, text: str) -> int:
        first, *rest = _CUT.split(text)
        total = self._kept(first, False) if first else 0
        for stretch in rest:
            n = self.counts.get(f" {stretch}")
            total += self._kept(stretch, True) if n is None else n
        return total

    def __call__(self, text: str) -> int:
        special = self.cuts is not None and self.cuts.search(text) is not None
        if not text:
            return 0
        if not self.proves or special and not self.plain:
            return len(self.library.encode(text, add_special_tokens=False))
        parts = self.cuts.split(text) if special else [text]
        if self.by_spaces:
            return len(parts) - 1 + sum(map(self._stretches, parts))
        if self.normalizer is not None:
            parts = [self.normalizer.normalize_str(p) for p in parts]
        return len(parts) - 1 + sum(map(self._merged, parts))


class PieceCounter:
    """Tokens of a text by a model of the sentencepiece library, which has no pre-tokens: all is merged."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)

    def __call__(self, text: str) -> int:
        return len(self.library.encode(text, num_threads=1))


@lru_cache(maxsize=4)
def counter(vocabulary: str) -> JsonCounter | PieceCounter:
    """One counter a worker process."""
    import public_tokenizers

    path = public_tokenizers.path(vocabulary)
    return PieceCounter(path) if vocabulary.endswith(".model") else JsonCounter(path)


def count_tokens(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = "byte_bpe_50k.json", limit: int = 512) -> DataFrame:
    """key, n_bytes (UTF-8), n_tokens and over_limit (more tokens than the limit) of every row.

    Tokens are those of the whole text, without begin, end, truncation or padding; a special token's string in a text
    is that token, as the tokenizers library has it by default.

    - null texts are empty: no bytes, no tokens. Keys are passed on, null ones too.
    - equal rows get equal results; an empty table gives an empty result; other columns are ignored.
    """
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(counter(vocabulary)).astype("int64")

    bare = F.coalesce(F.col(text), F.lit(""))
    found = df.select(F.col(key).alias("key"), F.octet_length(bare).cast("long").alias("n_bytes"), F.pandas_udf(run, "long")(bare).alias("n_tokens"))
    return found.select(F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
