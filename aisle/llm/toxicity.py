"""Toxicity by a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Features are hashed n-grams of 3 to 6 bytes of each word between marks of its start and
end; a feature's value is the number of distinct words of the text that hold it. Each is
scaled by the log ratio of its smoothed counts in toxic and other texts, and logistic
regression is fitted on the scaled values. The score of a text is a sum over its distinct
words, so a worker works a word out once and long texts cost a lookup a word.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aisle.llm.common import fold

BUCKETS = 1 << 18
SIZES = (3, 4, 5, 6)
#: Labelled rows of each class that are fitted on; the bound that keeps the fit on the driver small.
ROWS_PER_CLASS = 1500
PENALTY = 3e-3
ROUNDS = 60
RATE = 0.02
PIECE = 256
CACHED_WORDS = 300_000
BATCH_CHARS = 4_000_000

LETTERS = regex.compile(r"\p{L}+")


def word_features(word: str) -> np.ndarray:
    """Distinct buckets of a word's n-grams."""
    raw = f"_{word}_".encode()
    return np.unique(np.array([zlib.crc32(raw[i : i + n]) % BUCKETS for n in SIZES for i in range(len(raw) - n + 1)], np.int32))


def distinct_words(text: str | None) -> set[str]:
    return set(LETTERS.findall(text.lower())) if text else set()


def _features(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Buckets and values of each labelled text."""
    known: dict[str, np.ndarray] = {}
    for frame in frames:
        buckets, values = [], []
        for text in frame["text"]:
            found = []
            for word in distinct_words(text):
                of = known.get(word)
                if of is None:
                    of = word_features(word)
                    if len(known) < CACHED_WORDS:
                        known[word] = of
                found.append(of)
            ids, counts = np.unique(np.concatenate(found), return_counts=True) if found else (np.empty(0, np.int32), np.empty(0, np.int64))
            buckets.append(ids.astype("<i4").tobytes())
            values.append(counts.astype("<f4").tobytes())
        yield pd.DataFrame({"toxic": frame["toxic"], "buckets": buckets, "counts": values})


class Model:
    """A weight for each bucket and an offset."""

    def __init__(self, weights: np.ndarray, offset: float) -> None:
        self.weights, self.offset = weights, offset


def fit(buckets: list[np.ndarray], values: list[np.ndarray], toxic: np.ndarray) -> Model:
    """Logistic regression on scaled counts, both classes weighing the same; full steps with Adam.

    With one class only, or no rows, the score is that class's share, 0.5 for no rows.
    """
    if not len(toxic) or toxic.min() == toxic.max():
        share = 0.5 if not len(toxic) else float(np.clip(toxic.mean(), 0.01, 0.99))
        return Model(np.zeros(BUCKETS), float(np.log(share / (1 - share))))
    number = np.array([len(b) for b in buckets])
    cuts = np.concatenate([[0], np.cumsum(number)])
    index = np.concatenate(buckets).astype(np.int32)
    # Rows are worked through in pieces, so that what a step makes beside the features stays small.
    pieces = [(i, min(i + PIECE, len(toxic))) for i in range(0, len(toxic), PIECE)]
    counts = np.zeros((2, BUCKETS))
    for i, j in pieces:
        of = np.repeat(toxic[i:j], number[i:j])
        for c in (0, 1):
            counts[c] += np.bincount(index[cuts[i] : cuts[j]][of == c], minlength=BUCKETS)
    n_pos, n_neg = int(toxic.sum()), int((1 - toxic).sum())
    ratio = np.log((counts[1] + 1) / (n_pos + 2)) - np.log((counts[0] + 1) / (n_neg + 2))
    x = np.concatenate(values)
    x *= ratio.astype(np.float32)[index]
    share = np.where(toxic == 1, 0.5 / n_pos, 0.5 / n_neg)
    w, m, v = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    for step in range(1, ROUNDS + 1):
        slope = np.append(PENALTY * w[:-1], 0.0)
        for i, j in pieces:
            at, of = slice(cuts[i], cuts[j]), np.repeat(np.arange(j - i), number[i:j])
            z = w[-1] + np.bincount(of, weights=w[index[at]] * x[at], minlength=j - i)
            error = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - toxic[i:j]) * share[i:j]
            slope[:-1] += np.bincount(index[at], weights=error[of] * x[at], minlength=BUCKETS)
            slope[-1] += error.sum()
        m = 0.9 * m + 0.1 * slope
        v = 0.99 * v + 0.01 * slope * slope
        w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Model(ratio * w[:-1], float(w[-1]))


def train(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, rows_per_class: int = ROWS_PER_CLASS) -> Model:
    """Fit on labelled rows outside the held-out fold: ``rows_per_class`` of each class, those of smallest id hash.

    Only ids and labels are ranked and broadcast, 2 x ``rows_per_class`` rows at most; the
    texts are read where they lie.
    """
    usable = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), folds) != held_out))
    usable = usable.select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    picked = None
    for c in (0, 1):
        of = usable.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows_per_class)
        picked = of if picked is None else picked.unionByName(of)
    sample = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("text", "toxic")
    rows = sample.mapInPandas(_features, "toxic int, buckets binary, counts binary").toPandas()
    # Rows come in any order; sorted, the sums of the fit do not depend on it.
    rows = rows.sort_values(["toxic", "buckets", "counts"], kind="stable")
    buckets, values = ([np.frombuffer(b, kind) for b in rows[c]] for c, kind in (("buckets", "<i4"), ("counts", "<f4")))
    return fit(buckets, values, rows["toxic"].to_numpy(np.int64))


def _scorer(docs: DataFrame, model: Model):
    """A column function: the score of a text. Words' sums are kept by each worker up to a bound."""
    weights, offset = docs.sparkSession.sparkContext.broadcast(model.weights.astype(np.float32)), model.offset

    def scores(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, float] = {}
        for series in texts:
            out = []
            for text in series:
                words = distinct_words(text)
                new = [w for w in words if w not in known]
                if len(known) + len(new) > CACHED_WORDS:
                    known.clear()
                    new = list(words)
                for word in new:
                    known[word] = float(weights.value[word_features(word)].sum(dtype=np.float64))
                # Sorted, so that equal texts have equal scores to the last bit.
                z = offset + sum(sorted(map(known.__getitem__, words)))
                out.append(1 / (1 + np.exp(-np.clip(z, -500, 500))))
            yield pd.Series(out, dtype=float)

    scores.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(scores, "double")


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Rows (doc_id, score) for every row: 0 to 1. A null or empty text, or one without letters, has the offset's score."""
    return docs.select("doc_id", _scorer(docs, model)("text").alias("score"))


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0) -> DataFrame:
    """Score every row of ``docs`` by a classifier trained on ``labels`` (doc_id, toxic) outside the held-out fold.

    Cases: null and empty texts are scored like texts without words; labels that are null
    or neither 0 nor 1 teach nothing; without labels every score is 0.5; repeated rows are
    scored each; an empty table gives no rows; extra columns are ignored. Returns doc_id,
    held_out, score, predicted.
    """
    model = train(docs, labels, folds, held_out)
    return score(docs, model).select(
        "doc_id",
        (fold(F.col("doc_id"), folds) == held_out).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, whose text is not predicted toxic; a null text stays."""
    return docs.where(F.col("text").isNull() | (_scorer(docs, train(docs, labels))("text") < 0.5))
