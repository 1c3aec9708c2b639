"""Quality classifier: weak labels reconciled by expectation-maximisation train a hashed linear scorer."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.shared import table
from tallyforge.llm.shingles import _SPACE, _word_numbers, batch_words, mix, slices

#: The overlapping labellers. Each looks at one share of the whole text and votes 1 (junk) at or above the first
#: number, 0 (fine) at or below the second where there is one, else 2: it abstains.
LABELLERS = {
    "signs_in_text": (0.06, 0.02),
    "words_ending_in_signs": (0.40, None),
    "capitals": (0.40, None),
    "words_of_capitals": (0.40, None),
    "lone_signs": (0.12, None),
    "repeated_neighbours": (0.15, 0.02),
    "pairs_seen_before": (0.60, None),
}
#: Rows on which the scorer is fitted, at most; the labellers' accuracies are estimated on all rows.
TRAIN_ROWS = 4000
DIMS = 1024
#: Words added to every text's count, so that a few odd words in a short text weigh little.
SHORT_TEXT = 4
EM_STEPS = 60
CUT = 0.5
#: Byte kinds: a letter, A capital, 9 digit, others themselves; a run of one kind counts once in a word's shape.
_KIND = np.arange(256, dtype=np.uint8)
_KIND[97:123] = ord("a")
_KIND[128:] = ord("a")
_KIND[65:91] = ord("A")
_KIND[48:58] = ord("9")
_SIGN = np.zeros(256, dtype=bool)
_SIGN[[b for b in range(33, 127) if not chr(b).isalnum()]] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True
_SAME = np.arange(256, dtype=np.uint8)
#: What a sentence or a compound word may hold counts as a sign only at a word's end in pairs.
_PLAIN = np.zeros(256, dtype=bool)
_PLAIN[[ord(c) for c in ".,;:'\"-()?"]] = True


def _per(values, starts, ends):
    sums = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return sums[ends] - sums[starts]


def shares(texts: pa.Array) -> np.ndarray:
    """One row per text, one column per labeller; NaN for texts without words, where all abstain."""
    n = len(texts)
    words, doc, starts, ends, data = batch_words(texts, _SAME, _SPACE)
    out = np.full((n, len(LABELLERS)), np.nan)
    if not len(words):
        return out
    sign = _SIGN[data] & ~_PLAIN[data]
    size = ends - starts
    signs, uppers, letters, any_sign = (_per(x, starts, ends) for x in (sign, _UPPER[data], _LETTER[data], _SIGN[data]))
    total = lambda x: np.bincount(doc, weights=x, minlength=n)
    with np.errstate(invalid="ignore", divide="ignore"):
        count = total(np.ones(len(words)))
        again = np.zeros(len(words))
        again[1:] = (words[1:] == words[:-1]) & (doc[1:] == doc[:-1])
        with np.errstate(over="ignore"):
            keyed = mix(words[1:] * np.uint64(3) + words[:-1] + doc[1:].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        inside = doc[1:] == doc[:-1]
        _, first = np.unique(keyed[inside], return_index=True)
        fresh = np.bincount(doc[1:][inside][first], minlength=n)
        out[:, 0] = total(signs) / total(size)
        out[:, 1] = total(sign[ends - 1]) / count
        out[:, 2] = total(uppers) / np.maximum(total(letters), 1)
        out[:, 3] = total((uppers == letters) & (letters > 1)) / count
        out[:, 4] = total(any_sign == size) / count
        out[:, 5] = total(again) / count
        out[:, 6] = np.where(count >= 20, 1 - fresh / (count - 1), np.nan)
    return out


def vote(texts: pa.Array) -> np.ndarray:
    """Each text's votes as one base-3 number, the first labeller's the lowest digit."""
    x = shares(texts)
    junk, fine = np.array([(j, -1 if f is None else f) for j, f in LABELLERS.values()]).T
    votes = np.where(np.isnan(x), 2, np.where(x >= junk, 1, np.where(x <= fine, 0, 2)))
    return votes @ (3 ** np.arange(len(LABELLERS)))


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(doc, dim, value)`` of hashed word shapes and neighbouring pairs of them, as shares of a text's words."""
    words, doc, starts, ends, data = batch_words(texts, _SAME, _SPACE)
    if not len(words):
        return doc, doc, np.zeros(0)
    kind = _KIND[data]
    keep = ~_SPACE[data]
    keep[1:] &= (kind[1:] != kind[:-1]) | _SPACE[data[:-1]]
    keep[starts] = True
    place = np.concatenate(([0], np.cumsum(keep)))
    shapes = _word_numbers(kind[keep], place[starts], place[ends])
    inside = doc[1:] == doc[:-1]
    with np.errstate(over="ignore"):
        same = words[1:] == words[:-1]
        pairs = mix(shapes[:-1] * np.uint64(31) + shapes[1:] * np.uint64(17) + same.astype(np.uint64))[inside]
    count = np.bincount(doc, minlength=int(doc[-1]) + 1)
    both, where = np.concatenate((shapes, pairs)), np.concatenate((doc, doc[1:][inside]))
    key, n = np.unique(where * DIMS + (both % np.uint64(DIMS)).astype(np.int64), return_counts=True)
    return key // DIMS, key % DIMS, n / (count[key // DIMS] + SHORT_TEXT)


@dataclass(frozen=True)
class QualityModel:
    """The label model's share of junk and accuracies of the labellers; weights and bias of the scorer."""

    prior: float
    accuracy: np.ndarray
    weights: np.ndarray
    bias: float

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """The chance of junk for vote patterns."""
        return _posterior(patterns, self.prior, self.accuracy)

    def scores(self, texts: pa.Array) -> np.ndarray:
        """The chance that each text is fine; texts without words get the scorer's view of no features."""
        doc, dim, value = features(texts)
        z = np.bincount(doc, weights=self.weights[dim] * value, minlength=len(texts)) + self.bias if len(doc) else np.full(len(texts), self.bias)
        return 1 / (1 + np.exp(np.clip(z, -60, 60)))


def _digits(patterns: np.ndarray) -> np.ndarray:
    return patterns[:, None] // 3 ** np.arange(len(LABELLERS)) % 3


def _posterior(patterns, prior, accuracy):
    votes = _digits(patterns)
    each = np.arange(len(LABELLERS))
    odds = np.log(prior / (1 - prior)) + (np.log(accuracy[1, each, votes]) - np.log(accuracy[0, each, votes])).sum(axis=1)
    return 1 / (1 + np.exp(-np.clip(odds, -60, 60)))


def fit_labels(patterns: np.ndarray, counts: np.ndarray, steps: int = EM_STEPS) -> tuple[float, np.ndarray]:
    """EM over vote patterns: the share of junk, and each labeller's chance of each vote for fine and junk texts.

    Posteriors of the texts' classes (E) weigh how often each labeller gives which vote to which class (M); an
    abstention is an outcome like the votes, as labellers abstain on fine texts far more often than on junk.
    The start takes every labeller to find a third of the junk and to accuse one fine text in a hundred; a
    thousandth of all texts, voting like that start, stays in every table as smoothing.
    """
    votes = _digits(patterns)
    start = np.empty((2, len(LABELLERS), 3))
    start[0], start[1] = (0.50, 0.01, 0.49), (0.33, 0.34, 0.33)
    prior, accuracy = 0.15, start.copy()
    smooth = counts.sum() / 1000
    for _ in range(steps):
        junk = _posterior(patterns, prior, accuracy)
        for c, belief in ((0, (1 - junk) * counts), (1, junk * counts)):
            for v in range(3):
                accuracy[c, :, v] = ((votes == v) * belief[:, None]).sum(axis=0) + smooth * start[c, :, v]
            accuracy[c] /= accuracy[c].sum(axis=1, keepdims=True)
        prior = float(np.clip((junk * counts).sum() / max(counts.sum(), 1), 1e-3, 0.9))
    return prior, accuracy


def _fit_scorer(doc, dim, value, target, steps: int = 200, decay: float = 1e-4):
    """Logistic regression on soft targets by Adam over the whole bounded sample."""
    x = np.zeros((len(target), DIMS + 1), dtype=np.float32)
    x[doc, dim] = value
    x[:, DIMS] = 1
    w = np.zeros(DIMS + 1, dtype=np.float32)
    balance = np.where(target > 0.5, 0.5 / max((target > 0.5).mean(), 1e-3), 0.5 / max((target <= 0.5).mean(), 1e-3))
    balance = np.sqrt(balance).astype(np.float32)
    target = target.astype(np.float32)
    m = v = np.zeros(DIMS + 1, dtype=np.float32)
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -60, 60)))
        g = x.T @ ((p - target) * balance) / len(target) + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w[:DIMS].astype(np.float64), float(w[DIMS])


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS) -> QualityModel:
    """Votes on every text, EM over the counts of vote patterns (3**7 at most), then the scorer.

    The scorer is fitted on about ``train_rows`` distinct texts (twice as many at most), the ones with the smallest
    hashes, against the label model's posteriors.  An empty table gives a model that keeps everything.
    """

    def votes(batches):
        for batch in batches:
            for a, b in slices(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(vote(batch.column(0).slice(a, b - a)).astype(np.int32))], ["pattern"])

    texts = docs.select(F.col(text_col).alias("text"))
    counts = texts.mapInArrow(votes, "pattern int").groupBy("pattern").count().toPandas()
    patterns, n = counts["pattern"].to_numpy(np.int64), counts["count"].to_numpy(np.float64)
    if not len(patterns):
        return QualityModel(0.2, np.full((2, len(LABELLERS), 3), 1 / 3), np.zeros(DIMS), -1.0)
    prior, accuracy = fit_labels(patterns, n)
    # Drawn by hashes of distinct texts, so that no text that is repeated without end fills the sample.
    distinct = texts.select(F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash"))
    kinds = distinct.agg(F.approx_count_distinct("hash", 0.01).alias("n")).first()["n"]
    share = min(1.0, train_rows / max(kinds, 1))
    near = F.pmod("hash", F.lit(1 << 40)) < int(share * (1 << 40))
    drawn = distinct.where(near).groupBy("hash").agg(F.min("text").alias("text")).select("text")

    def featured(batches):
        for batch in batches:
            for a, b in slices(batch.column(0)):
                part = batch.column(0).slice(a, b - a)
                doc, dim, value = features(part)
                cut = np.searchsorted(doc, np.arange(len(part) + 1))
                rows = [(dim[i:j].astype(np.int32), value[i:j]) for i, j in zip(cut[:-1], cut[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(vote(part).astype(np.int32)), pa.array([r[0] for r in rows], pa.list_(pa.int32())), pa.array([r[1] for r in rows], pa.list_(pa.float64()))], ["pattern", "dim", "value"])

    sample = drawn.mapInArrow(featured, "pattern int, dim array<int>, value array<double>").limit(2 * train_rows).toPandas()
    if not len(sample):
        return QualityModel(prior, accuracy, np.zeros(DIMS), -1.0)
    doc = np.repeat(np.arange(len(sample)), sample["dim"].map(len))
    weights, bias = _fit_scorer(doc, np.concatenate(sample["dim"].to_list()).astype(np.int64), np.concatenate(sample["value"].to_list()), _posterior(sample["pattern"].to_numpy(np.int64), prior, accuracy))
    return QualityModel(prior, accuracy, weights, bias)


def quality(text: Column, model: QualityModel) -> Column:
    """The chance that a text is fine, in [0, 1]; null texts count as empty."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        array = pa.array(texts, pa.string(), from_pandas=True)
        found = [model.scores(array.slice(a, b - a)) for a, b in slices(array)]
        return pd.Series(np.concatenate(found) if found else np.zeros(0))

    return score(F.coalesce(text, F.lit("")))


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cut: float = CUT) -> DataFrame:
    """The rows of ``docs`` that the classifier fitted on them does not reject; all columns stay, nothing moves.

    Null, empty and wordless texts have no features: the scorer's bias decides on them, which keeps them unless
    most texts are junk.  Repeated rows are judged alike.
    """
    return docs.where(quality(F.col(text_col), fit(docs, id_col, text_col)) >= cut)


def op1_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    scored = docs.select("doc_id", quality(F.col("text"), fit(docs)).alias("score"))
    return scored.select("doc_id", "score", (F.col("score") >= CUT).alias("kept"))


QUERIES = {"op1_quality": op1_quality}
ORACLES: dict[str, str] = {}
