"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over hashed words and character n-grams learns from confirmed toxic texts and from unlabelled ones.
The risk of the unlabelled part is corrected by the class prior; where the corrected part falls below zero, which only
overfitting can cause, the step goes up instead of down. Logits are calibrated by cross-fitting: each fifth of the
sample is scored by a classifier, and features, that never saw it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchlake.llm.common import in_fold, written

_WORD = re.compile(r"[\w@$]+")
# Characters that stand for letters in mixed spellings.
_FOLD = str.maketrans("013457@$", "oieastas")
GRAM = 5
#: A feature has four levels: it occurs; it occurs twice or more and in at least one of 256, 128, 64 words.
RATES = (1 / 256, 1 / 128, 1 / 64)
HELD_FEATURES = 2_000_000
CACHED_WORDS = 100_000
FITS = 5
WEAK, FIRM = 8.0, 16.0  # likelihood ratios: to be collected, and to be used by a fit


def word_features(word: str) -> list[int]:
    """Hashes, multiples of four, of a lower-case word, its folded spelling and the n-grams of that within its bounds."""
    plain = word.translate(_FOLD)
    bound = f"<{plain}>"
    names = {"w" + word, "w" + plain, *("g" + bound[i:i + GRAM] for i in range(len(bound) - GRAM + 1))}
    return [xxhash.xxh3_64_intdigest(n.encode("utf-8", "replace")) & ~3 for n in names]


class _Features(dict):
    """word -> the hashes of its features; bounded."""

    def __missing__(self, word: str) -> np.ndarray:
        if len(self) > CACHED_WORDS:
            self.clear()
        self[word] = found = np.array(word_features(word), np.uint64)
        return found

    def of(self, text: str | None) -> np.ndarray:
        """Features of a text, each with its level in the lowest two bits; a level implies those below it."""
        words = Counter(_WORD.findall((text or "").lower()))
        if not words:
            return np.empty(0, np.uint64)
        each = [self[w] for w in words]
        times = np.repeat(np.fromiter(words.values(), np.int64, len(words)), [len(e) for e in each])
        ids, at = np.unique(np.concatenate(each), return_inverse=True)
        count = np.bincount(at, times)
        rate = np.where(count > 1, count / count_words(words), 0)
        return np.concatenate([ids, *(ids[rate >= r] + np.uint64(level) for level, r in enumerate(RATES, 1))])


def count_words(words: Counter) -> int:
    return max(1, sum(words.values()))


@dataclass
class Model:
    """Linear logit over the levels of features; `scale` and `shift` calibrate it."""

    weights: dict[int, tuple[float, ...]] = field(default_factory=dict)  # hash -> what each level adds
    bias: float = 0.0
    scale: float = 1.0
    shift: float = 0.0

    def logit(self, text: str | None, known: dict[str, list[int]]) -> float:
        """`known` remembers which features of the model a word has; bounded."""
        words = Counter(_WORD.findall((text or "").lower()))
        count: Counter = Counter()
        for word, times in words.items():
            own = known.get(word)
            if own is None:
                if len(known) > CACHED_WORDS:
                    known.clear()
                known[word] = own = [f for f in word_features(word) if f in self.weights]
            for f in own:
                count[f] += times
        total, n = self.bias, count_words(words)
        for f, times in count.items():
            first, *rest = self.weights[f]
            total += first
            if times > 1:
                total += sum(w for w, r in zip(rest, RATES, strict=True) if times / n >= r)
        return self.scale * total + self.shift


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Rows:
    """Which features each of n rows holds, as parallel arrays."""

    row: np.ndarray
    column: np.ndarray
    n: int

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.column], self.n) + w[-1]

    def back(self, slope: np.ndarray, d: int) -> np.ndarray:
        return np.append(np.bincount(self.column, slope[self.row], d), slope.sum()) / max(self.n, 1)

    def only(self, keep: np.ndarray, columns: np.ndarray) -> Rows:
        """Rows of the mask, numbered anew; columns >= 0 of the map."""
        use = keep[self.row] & (columns[self.column] >= 0)
        return Rows((np.cumsum(keep) - 1)[self.row[use]], columns[self.column[use]], int(keep.sum()))


def nonnegative_pu(positive: Rows, unlabelled: Rows, d: int, prior: float, steps: int = 400, rate: float = 0.05, decay: float = 1e-2) -> np.ndarray:
    """d weights and a bias that minimise the non-negative PU risk with logistic loss, by Adam on whole batches."""
    w, m, v = np.zeros(d + 1), np.zeros(d + 1), np.zeros(d + 1)
    w[d] = np.log(prior / (1 - prior))
    for t in range(1, steps + 1):
        fp, fu = positive.dot(w), unlabelled.dot(w)
        negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        g_minus = unlabelled.back(sigmoid(fu), d) - prior * positive.back(sigmoid(fp), d)
        g = prior * positive.back(sigmoid(fp) - 1, d) + g_minus if negative >= 0 else -g_minus
        g[:d] += decay * w[:d]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def _platt(logits: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Scale and shift by Newton steps; labels are softened so that separable data stay finite."""
    n1, n0 = labels.sum(), (1 - labels).sum()
    target = np.where(labels > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = sigmoid(a * logits + b)
        r, s = p - target, np.maximum(p * (1 - p), 1e-9)
        g = np.array([(r * logits).sum() + 1e-3 * a, r.sum()])
        h = np.array([[(s * logits * logits).sum() + 1e-3, (s * logits).sum()], [(s * logits).sum(), s.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - float(np.clip(step[0], -2, 2)), b - float(np.clip(step[1], -2, 2))
    return max(a, 0.05), b


def likelihood_ratio(p: np.ndarray, u: np.ndarray, n_p: float, n_u: float) -> np.ndarray:
    """G of held or not against positive or unlabelled: how far from chance a feature's share differs, either way."""
    n, share = p + u, n_p / (n_p + n_u)
    cells = ((p, n * share), (u, n * (1 - share)), (n_p - p, n_p - n * share), (n_u - u, n_u - n * (1 - share)))
    return 2 * sum(np.where(o > 0, o * np.log(np.maximum(o, 1e-12) / np.maximum(e, 1e-12)), 0) for o, e in cells)


def _count_features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """How many positive and how many unlabelled texts of each fold hold each feature, handed on before they grow large."""
    features = _Features()
    held: dict[tuple[int, int], list[np.ndarray]] = {}
    size = 0

    def out() -> Iterator[pd.DataFrame]:
        for (role, fold), parts in held.items():
            ids, n = np.unique(np.concatenate(parts), return_counts=True)
            yield pd.DataFrame({"feature": ids.view(np.int64), "role": role, "fold": fold, "n": n})
        held.clear()

    for batch in batches:
        for role, fold, text in zip(batch["role"], batch["fold"], batch["text"], strict=True):
            if role in (1, 2):
                found = features.of(text)
                held.setdefault((role, fold), []).append(found)
                size += len(found)
            if size > HELD_FEATURES:
                yield from out()
                size = 0
    yield from out()


def _picked(ids: np.ndarray):
    """Places in the ascending ids of the features of each text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        features = _Features()
        for batch in batches:
            found = []
            for text in batch["text"]:
                own = features.of(text)
                at = np.minimum(np.searchsorted(ids, own), max(len(ids) - 1, 0))
                found.append(at[ids[at] == own] if len(ids) else at[:0])
            yield pd.DataFrame({"role": batch["role"], "fold": batch["fold"], "found": found})
    return run


def _sample(docs: DataFrame, labels: DataFrame, key: str, text: str, toxic: str, folds: int, held_out: int, most: dict[int, int]) -> tuple[DataFrame | None, float]:
    """Texts of the bounded sample by role (1 positive, 2 unlabelled, 3 negative) and fold; the class prior."""
    known = (labels.where(~in_fold(F.col(key), folds, held_out) & F.col(toxic).isNotNull())
             .groupBy(F.col(key).alias("key")).agg(F.max(toxic).alias("toxic")))
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    n_pos, n_neg = counts.get(1, 0), counts.get(0, 0)
    if not n_pos:
        return None, 0.5
    whole = 1 << 24

    def drawn(share: float | Column, salt: int) -> Column:
        return F.pmod(F.xxhash64("key", F.lit(salt)), F.lit(whole)) < share * F.lit(float(whole))

    share = F.when(F.col("toxic") == 1, F.lit(most[1] / n_pos)).otherwise(F.lit(most[3] / max(1, n_neg)))
    chosen = known.where(drawn(share, 1)).select("key", F.when(F.col("toxic") == 1, 1).otherwise(3).alias("role"))
    free = docs.where(~in_fold(F.col(key), folds, held_out)).select(F.col(key).alias("key"), F.col(text).alias("text"))
    spare = drawn(F.lit(most[2] / max(1, free.select("key").count())), 2)
    none = F.array().cast("array<int>")
    both = free.join(F.broadcast(chosen), "key", "left").withColumn("roles", F.concat(F.when(F.col("role").isNotNull(), F.array("role")).otherwise(none), F.when(spare, F.array(F.lit(2))).otherwise(none)))
    rows = both.where(F.size("roles") > 0).select("text", F.explode("roles").alias("role")).dropDuplicates(["role", "text"])
    return written(rows.withColumn("fold", F.pmod(F.xxhash64("text"), F.lit(FITS)).cast("int")), "toxicity-sample"), min(0.9, max(0.005, n_pos / (n_pos + n_neg)))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", toxic: str = "toxic", folds: int = 3, held_out: int = 1,
          max_positive: int = 2000, max_unlabelled: int = 4000, max_negative: int = 2000, features: int = 2000) -> Model:
    """A model from labelled rows outside the held-out fold and unlabelled texts outside it.

    max_positive, max_unlabelled and max_negative bound the rows of the sample, drawn by a hash of the key; negatives
    serve calibration only. `features` bounds the model: those whose share among positives differs from that among
    unlabelled texts, either way, beyond chance, the clearest first. Without any positive or unlabelled row the model
    scores every text at the prior, 0.5 without labels.
    """
    sample, prior = _sample(docs, labels, key, text, toxic, folds, held_out, {1: max_positive, 2: max_unlabelled, 3: max_negative})
    if sample is None:
        return Model()
    sizes = np.zeros((4, FITS))
    for r in sample.groupBy("role", "fold").count().collect():
        sizes[r["role"], r["fold"]] = r["count"]
    if not sizes[1].any() or not sizes[2].any():
        return Model(bias=float(np.log(prior / (1 - prior))))
    of = [F.sum(F.when((F.col("role") == role) & (F.col("fold") == k), F.col("n")).otherwise(0)).alias(f"c{role}{k}") for role in (1, 2) for k in range(FITS)]
    counts = sample.mapInPandas(_count_features, "feature long, role int, fold int, n long").groupBy("feature").agg(*of)
    p, u = (sum(F.col(f"c{role}{k}") for k in range(FITS)) for role in (1, 2))
    n_p, n_u = (float(sizes[role].sum()) for role in (1, 2))
    n, s = p + u, n_p / (n_p + n_u)
    cells = ((p, n * s), (u, n * (1 - s)), (F.lit(n_p) - p, F.lit(n_p) - n * s), (F.lit(n_u) - u, F.lit(n_u) - n * (1 - s)))
    ratio = 2 * sum((F.when(o > 0, o * F.log(o / e)).otherwise(0.0) for o, e in cells), F.lit(0.0))
    table = (counts.where(n >= 3).withColumn("ratio", ratio).where(F.col("ratio") >= WEAK)
             .orderBy(F.desc("ratio"), "feature").limit(4 * features).drop("ratio").toPandas())
    table = table.iloc[np.argsort(table["feature"].to_numpy().view(np.uint64))]
    ids = table["feature"].to_numpy().view(np.uint64)
    held = np.stack([[table[f"c{role}{k}"].to_numpy(np.float64) for k in range(FITS)] for role in (1, 2)])  # role, fold, feature
    rows = sample.mapInPandas(_picked(ids), "role int, fold int, found array<int>").toPandas()
    lengths = rows["found"].map(len).to_numpy()
    every = Rows(np.repeat(np.arange(len(rows)), lengths), np.concatenate([*rows["found"], []]).astype(np.int64), len(rows))
    role, fold = rows["role"].to_numpy(), rows["fold"].to_numpy()

    def fit(without: int | None) -> tuple[np.ndarray, np.ndarray]:
        """The place of each used feature, else -1, and the weights, from all folds but one."""
        use = np.array([k != without for k in range(FITS)])
        if not (sizes[1:3, use].sum(axis=1) > 0).all():
            use[:] = True
        g = likelihood_ratio(*held[:, use].sum(axis=1), *sizes[1:3, use].sum(axis=1))
        best = np.argsort(-g, kind="stable")[:features]
        best = best[g[best] >= FIRM]
        place = np.full(len(ids), -1, np.int64)
        place[best] = np.arange(len(best))
        mine = use[fold]
        return place, nonnegative_pu(every.only(mine & (role == 1), place), every.only(mine & (role == 2), place), len(best), prior)

    logits, truth = [], []
    for k in range(FITS):
        asked = (fold == k) & (role != 2)
        if asked.any():
            place, w = fit(k)
            logits.append(every.only(asked, place).dot(w))
            truth.append((role[asked] == 1).astype(float))
    scale, shift = 1.0, 0.0
    if (role == 3).any():
        scale, shift = _platt(np.concatenate(logits), np.concatenate(truth))
    place, w = fit(None)
    weights: dict[int, list[float]] = {}
    for i, at in zip(ids.tolist(), place.tolist(), strict=True):
        if at >= 0:
            weights.setdefault(i & ~3, [0.0] * (1 + len(RATES)))[i & 3] = float(w[at])
    return Model({f: tuple(x) for f, x in weights.items()}, float(w[-1]), scale, shift)


def _scorer(docs: DataFrame, model: Model):
    """Score of a text column; only the text goes through Python."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, list[int]] = {}
        for texts in batches:
            yield pd.Series(sigmoid(np.array([shared.value.logit(t, known) for t in texts], np.float64)))

    return F.pandas_udf(run, "double").asNondeterministic()


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", folds: int = 3, held_out: int = 1, threshold: float = 0.7) -> DataFrame:
    """key, held_out, score (0 to 1) and predicted of every row, from the whole text alone.

    Null and empty texts hold no feature and score by the bias; a null key is in the fold of the text ''. Repeated rows
    get equal scores. Other columns are ignored.
    """
    scored = docs.select(F.col(key), _scorer(docs, model)(F.col(text)).alias("score"))
    return scored.select(key, in_fold(F.col(key), folds, held_out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows of docs, all columns as they are, whose score is below the threshold."""
    return docs.where(_scorer(docs, model)(F.col(text)) < threshold)
