"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A trigram's vector binds its letters: the
first rotated by two places, the second by one, the third as it is, multiplied place by
place. Texts and languages are bundles, that is sums, of their trigrams' vectors, and a
text belongs to the language whose prototype has the largest cosine with it. Since
bundling is a sum, a text's product with a prototype is the sum of its words' products;
workers keep those per word and never write out a text's own vector.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aisle.llm.common import fold

DIMENSIONS = 4096
GRAM = 3
#: Words whose products a worker keeps, and grams it counts before it bundles them.
CACHED_WORDS = 300_000
COUNTED_GRAMS = 300_000
#: Characters of text whose words are held at once.
BATCH_CHARS = 4_000_000
#: Grams turned into vectors at once: 1024 x 4096 bytes.
BLOCK = 1024

LETTERS = regex.compile(r"\p{L}+")
UNKNOWN = "und"


class Letters:
    """Random vectors of letters, the same on every machine, in their three rotations."""

    def __init__(self) -> None:
        self.rows: dict[str, int] = {}
        self.rotated = [np.empty((64, DIMENSIONS), np.int8) for _ in range(GRAM)]

    def row(self, letter: str) -> int:
        at = self.rows.get(letter)
        if at is None:
            at = self.rows[letter] = len(self.rows)
            if at == len(self.rotated[0]):
                self.rotated = [np.concatenate([m, np.empty_like(m)]) for m in self.rotated]
            vector = np.random.Generator(np.random.PCG64(ord(letter))).integers(0, 2, DIMENSIONS, np.int8) * 2 - 1
            for turn, matrix in enumerate(self.rotated):
                matrix[at] = np.roll(vector, GRAM - 1 - turn)
        return at

    def bind(self, grams: list[str]) -> np.ndarray:
        """One row for each gram."""
        out = None
        for place in range(GRAM):
            rows = [self.row(g[place]) for g in grams]
            picked = self.rotated[place][rows]
            out = picked if out is None else out * picked
        return out


LETTER_VECTORS = Letters()


def word_grams(word: str) -> list[str]:
    """Trigrams of a word between blanks, so that starts and ends of words count."""
    padded = f" {word} "
    return [padded[i : i + GRAM] for i in range(len(padded) - GRAM + 1)]


def _batches(texts: list[str]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= BATCH_CHARS:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _bundle(counts: dict[str, Counter], sums: dict[str, np.ndarray]) -> None:
    """Add the counted grams of each language to its running sum."""
    grams = sorted(set().union(*counts.values()))
    for start in range(0, len(grams), BLOCK):
        block = grams[start : start + BLOCK]
        vectors = LETTER_VECTORS.bind(block).astype(np.float64)
        for lang, of in counts.items():
            weights = np.fromiter((of.get(g, 0) for g in block), np.float64, len(block))
            sums[lang] = sums.get(lang, 0) + (weights @ vectors).astype(np.int64)
    counts.clear()


def _partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The task's bundle for each language: whole numbers, so the order of adding does not matter."""
    sums: dict[str, np.ndarray] = {}
    grams: dict[str, Counter] = {}

    def count_grams(words: dict[str, Counter]) -> None:
        for lang, of in words.items():
            target = grams.setdefault(lang, Counter())
            for word, n in of.items():
                for gram in word_grams(word):
                    target[gram] += n
        words.clear()
        if sum(map(len, grams.values())) > COUNTED_GRAMS:
            _bundle(grams, sums)

    words: dict[str, Counter] = {}
    for frame in frames:
        for text, lang in zip(frame["text"], frame["lang"], strict=True):
            words.setdefault(lang, Counter()).update(LETTERS.findall(text.lower()))
            if sum(map(len, words.values())) > CACHED_WORDS:
                count_grams(words)
    count_grams(words)
    if grams:
        _bundle(grams, sums)
    if sums:
        yield pd.DataFrame({"lang": list(sums), "bundle": [v.tolist() for v in sums.values()]})


def prototypes(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order and their prototypes, from rows (text, lang) without nulls.

    The sums are formed by Spark from one bundle a task and language; what reaches the
    driver is one vector of 4096 numbers a language. From each prototype, brought to
    length one, the mean of all is taken, so that what languages share does not count.
    """
    bundles = labelled.select("text", "lang").mapInPandas(_partial, "lang string, bundle array<long>")
    sums = bundles.select("lang", F.posexplode("bundle").alias("place", "value")).groupBy("lang", "place").agg(F.sum("value").alias("value"))
    rows = sums.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("place", "value"))).alias("v")).orderBy("lang").collect()
    names = [r.lang for r in rows]
    matrix = np.array([[p.value for p in r.v] for r in rows], np.float64).reshape(len(names), DIMENSIONS)
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    if len(names) > 1:
        matrix = unit(matrix)
        matrix = unit(matrix - matrix.mean(axis=0))
    elif names:
        matrix = unit(matrix)
    return names, matrix


class WordProducts(dict):
    """Word -> place of its products with the prototypes in ``table``; grams are kept as well."""

    def __init__(self, matrix: np.ndarray) -> None:
        super().__init__()
        self.matrix = matrix
        self.clear_all()

    def clear_all(self) -> None:
        self.clear()
        self.grams: dict[str, np.ndarray] = {}
        self.table = np.zeros((1024, len(self.matrix)))

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self]
        if len(self) + len(new) > CACHED_WORDS:
            self.clear_all()
            new = list(words)
        unknown = sorted({g for w in new for g in word_grams(w)} - self.grams.keys())
        for start in range(0, len(unknown), BLOCK):
            block = unknown[start : start + BLOCK]
            self.grams.update(zip(block, LETTER_VECTORS.bind(block).astype(np.float64) @ self.matrix.T, strict=True))
        if len(self) + len(new) > len(self.table):
            bigger = np.zeros((2 * (len(self) + len(new)), len(self.matrix)))
            bigger[: len(self.table)] = self.table
            self.table = bigger
        for word in new:
            at = self[word] = len(self)
            self.table[at] = sum(map(self.grams.__getitem__, word_grams(word)))


def predict(docs: DataFrame, names: list[str], matrix: np.ndarray) -> DataFrame:
    """Rows (doc_id, lang_pred, score) for every row.

    ``score`` is half of one plus the lead of the best cosine over the second, relative to
    the larger of the two: 0.5 for a tie, up to 1. A text's own length is common to all its
    cosines and falls out. Cases: a null text, or one without a letter, is ``und`` with
    score 0, as is everything when no language was learned; a tie goes to the language
    that sorts first; with a single language the score is 1.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordProducts(matrix)
        for frame in frames:
            texts = [t or "" for t in frame["text"]]
            best = [UNKNOWN] * len(texts)
            score = [0.0] * len(texts)
            for start, stop in _batches(texts) if names else ():
                words = [LETTERS.findall(t.lower()) for t in texts[start:stop]]
                known.learn(set().union(*words))
                for i, of in enumerate(words, start):
                    if not of:
                        continue
                    products = known.table[np.fromiter(map(known.__getitem__, of), np.int64, len(of))].sum(axis=0)
                    order = np.argsort(-products, kind="stable")
                    best[i] = names[order[0]]
                    if len(names) == 1:
                        score[i] = 1.0
                        continue
                    first, second = products[order[0]], products[order[1]]
                    score[i] = float(0.5 + 0.5 * min(1.0, (first - second) / max(abs(first), abs(second), 1e-12)))
            yield pd.DataFrame({"doc_id": frame["doc_id"], "lang_pred": best, "score": score})

    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, lang_pred string, score double")


def identify(docs: DataFrame, folds: int = 4, held_out: int = 2) -> DataFrame:
    """Learn prototypes from the rows outside the held-out fold that bear a language, and predict all rows.

    Cases as in ``predict``; rows with null text or lang teach nothing; repeated rows count as
    often as they are there; an empty table gives no rows; extra columns are ignored.
    Returns doc_id, held_out, lang_pred, score.
    """
    teach = docs.where((fold(F.col("doc_id"), folds) != held_out) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    names, matrix = prototypes(teach)
    return predict(docs, names, matrix).select("doc_id", (fold(F.col("doc_id"), folds) == held_out).alias("held_out"), "lang_pred", "score")
