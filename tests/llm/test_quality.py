"""Base counts against plain loops; outliers planted among ordinary texts; estimates against all subsets of small groups."""

import math
import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from aisle.llm import quality
from tests.llm.cases import TEXTS, odd_documents


def counts(text):
    text = text or ""
    words = [w.decode() for w in text.encode().split()]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if x.encode().split()]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def corpus(seed, n=400):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(rng.randrange(2, 9)))
    rows = []
    for i in range(n):
        words = [word() for _ in range(rng.randrange(60, 300))]
        rows.append((i, ("\n" if i % 3 else " ").join(words), "ab"[i % 2], "s"))
    # Long strings of signs, and ordinary words of forty letters: far out in two statistics.
    rows.append((9001, " ".join(word() + "#$%&" * 30 for _ in range(100)), "a", "s"))
    rows.append((9002, " ".join(word() * 12 for _ in range(100)), "b", "s"))
    return rows


def test_counts(spark):
    texts = [*TEXTS, "a b c a b c a b", "x\n\nx\n \nx", "a a a a", "<<>> a\tb\r\nb"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality.base_counts(docs, ["doc_id"]).collect():
        assert tuple(r)[1:] == counts(texts[r.doc_id]), texts[r.doc_id][:50]


def test_verdicts(spark):
    rows = corpus(1)
    found = quality.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4)).collect()
    assert sorted(r.doc_id for r in found) == sorted(r[0] for r in rows)
    texts = {r[0]: r[1] for r in rows}
    for r in found:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts(texts[r.doc_id])
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
    dropped = {r.doc_id for r in found if not r.kept and not r.base_failed}
    assert {9001, 9002} <= dropped and len(dropped) <= 6


def test_outliers_do_not_hide_each_other(spark):
    """A fifth of a source is far out; a plain mean and covariance would stretch to it."""
    rows = corpus(2, 200)[:200]
    bad = [(5000 + i, " ".join("longwordslongwords" * 4 + str(i * k % 97) for k in range(80)) + " ####" * 40, "a", "s") for i in range(25)]
    found = quality.quality(spark.createDataFrame(rows + bad, "doc_id long, text string, lang string, source string")).collect()
    kept = {r.doc_id for r in found if r.kept}
    assert not kept & {b[0] for b in bad if not next(r for r in found if r.doc_id == b[0]).base_failed}
    assert sum(d < 5000 for d in kept) >= 190


def test_odd_rows(spark):
    docs = odd_documents(spark)
    found = quality.quality(docs).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_words) for r in found) == sorted(
        (r.doc_id is None, r.doc_id or 0, counts(r.text)[0]) for r in docs.collect()
    )
    assert all(r.kept is not None for r in found)
    assert quality.quality(docs.limit(0)).count() == 0


def quartiles(values):
    """Centre and spread of each column as a histogram of 32 steps gives them."""
    bins = np.sort(values // 32, axis=0)
    low, mid, high = [(bins[math.ceil(len(bins) * q) - 1] + 0.5) * 32 / quality.SCALE for q in (0.25, 0.5, 0.75)]
    return mid, np.maximum((high - low) / 1.349, list(quality.LEAST_SPREAD.values()))


def fitted(rows, prior):
    """Logarithm of the determinant, centre and factor of chosen rows and the language's pseudo-rows."""
    floor = np.array(list(quality.LEAST_SPREAD.values())) ** 2
    t, u = prior
    weight = len(rows) + quality.PRIOR_ROWS
    mean = (rows.sum(0) + quality.PRIOR_ROWS * t) / weight
    pseudo = np.outer(t, t) + np.diag(u**2) / quality.CONSISTENCY
    cov = ((rows.T @ rows + quality.PRIOR_ROWS * pseudo) / weight - np.outer(mean, mean)) * quality.CONSISTENCY
    np.fill_diagonal(cov, np.maximum(cov.diagonal(), floor))
    lower = np.zeros((5, 5))
    for i in range(5):
        for j in range(i + 1):
            rest = cov[i, j] - lower[i, :j] @ lower[j, :j]
            lower[i, j] = np.sqrt(max(rest, floor[i] / 2)) if i == j else rest / lower[j, j]
    return 2 * np.log(lower.diagonal()).sum(), mean, lower


def all_subsets(x, prior):
    """The estimate of the smallest determinant among all subsets of three quarters of the rows."""
    rows = x / quality.SCALE
    return min((fitted(rows[list(c)], prior) for c in combinations(range(len(x)), len(x) * 3 // 4)), key=lambda e: e[0])


def distances(x, estimate):
    return np.linalg.norm(np.linalg.solve(estimate[2], (x / quality.SCALE - estimate[1]).T), axis=0)


def test_smallest_determinant_of_all_subsets(spark, monkeypatch):
    """Correlated statistics with a quarter of outliers on one side; the second source holds no more than its floors."""
    monkeypatch.setattr(quality, "PRIOR_ROWS", 3)
    rng = np.random.default_rng(4)
    groups = {}
    for source in "abc":
        base = rng.normal(size=(16, 5)) @ (np.eye(5) + 0.6 * rng.normal(size=(5, 5))) * 2
        base[:3] += rng.normal(9, 1, (3, 5))
        groups[source] = np.rint((base * (source != "b") + 20) * quality.SCALE).astype(int)
    prior = quartiles(np.concatenate(list(groups.values())))
    rows = [("l", s, *map(int, r)) for s, x in groups.items() for r in x]
    columns = ", ".join(f"x_{n} long" for n in quality.NAMES)
    found = quality.estimates(spark.createDataFrame(rows, f"lang_key string, source_key string, {columns}").repartition(5)).collect()
    assert sorted(r.source_key for r in found) == ["a", "b", "c"]
    for r in found:
        logdet, mean, lower = all_subsets(groups[r.source_key], prior)
        assert r.logdet == pytest.approx(logdet, abs=1e-9)
        assert [r.est[f"m_{n}"] for n in quality.NAMES] == pytest.approx(mean, abs=1e-9)
        assert [r.est[f"l_{b}_{a}"] for a, b in quality.PAIRS] == pytest.approx([lower[j, i] for i in range(5) for j in range(i, 5)], abs=1e-9)


def test_distances_and_verdicts_of_the_best_subset(spark):
    """A quarter of each language is far out, so that one subset alone is the best."""
    rows = corpus(3, 30)[:30]
    rows += [(100 + i, " ".join("longwordslongwords" * 3 + f"{k * k % 89}#$" * (1 + k % 5) for k in range(60 + 20 * i)), "ab"[i % 2], "s") for i in range(10)]
    found = {r.doc_id: r for r in quality.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not any(r.base_failed for r in found.values())
    for lang in "ab":
        ids = [r[0] for r in rows if r[2] == lang]
        assert len(ids) == 20
        x = []
        for r in map(found.get, ids):
            values = (
                math.log(r.n_words), math.log(r.word_chars / r.n_words), math.log1p(1000 * r.n_symbols / r.word_chars),
                math.log1p(1000 * r.n_dup_lines / r.n_words), math.log1p(100 * r.n_repeat_words / r.n_words),
            )
            x.append([round(v * quality.SCALE) for v in values])
        x = np.array(x)
        best = fitted(x[:15] / quality.SCALE, quartiles(x))
        wanted = distances(x, best)
        assert all(fitted(np.delete(x, list(c), 0) / quality.SCALE, quartiles(x))[0] > best[0] for c in combinations(range(20), 5) if min(c) < 15)
        assert [found[i].distance for i in ids] == pytest.approx(list(wanted), rel=1e-6)
        assert [found[i].kept for i in ids] == [d * d <= quality.CUTOFF for d in wanted]
        assert [found[i].kept for i in ids] == [i < 100 for i in ids]
