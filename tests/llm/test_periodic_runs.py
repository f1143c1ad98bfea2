"""Runs against every period of every stretch; extensions against the table of all pairs."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from aisle.llm import periodic_runs
from aisle.llm.lce import Extensions
from tests.llm.cases import odd_documents


def plain_runs(words):
    """Maximal stretches by the definition: for each period the stretches of equal words that far apart."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        start = 0
        while start + q < n:
            if words[start] != words[start + q]:
                start += 1
                continue
            end = start + q
            while end < n and words[end] == words[end - q]:
                end += 1
            if end - start >= max(12, 2 * q):
                found.setdefault((start, end - start), q)
            start = end - q + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def expected(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = sorted(plain_runs(words), key=lambda r: (r[0], r[2]))
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + m for s, m, q in runs)]
    listed = "".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()
    four = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    return (doc_id, len(runs), *four, hashlib.sha256(listed).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest())


def texts(seed):
    rng = random.Random(seed)
    out = []
    for i in range(160):
        words = [rng.choice("ab" if i % 3 else "abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(70))]
        for _ in range(i % 4):
            at, p = rng.randrange(len(words) + 1), rng.randrange(1, 9)
            words[at:at] = [rng.choice("abcd") for _ in range(p)] * rng.randrange(2, 9)
        out.append((i, " ".join(words)))
    return out


@pytest.mark.parametrize(("seed", "words", "pairs"), [(1, None, None), (2, 100, 64)])
def test_as_all_periods(spark, seed, words, pairs, monkeypatch):
    if words:
        monkeypatch.setattr(periodic_runs, "BATCH_WORDS", words)
        monkeypatch.setattr(periodic_runs, "PAIRS", pairs)
    rows = texts(seed)
    described = periodic_runs._described([(d, t.encode().split()) for d, t in rows])
    assert [(d, *r[:7]) for (d, _), r in zip(rows, described, strict=True)] == [expected(d, t) for d, t in rows]
    if not words:
        found = periodic_runs.report(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
        assert sorted(map(tuple, found.collect())) == [expected(d, t) for d, t in rows]


def test_odd_rows(spark):
    docs = odd_documents(spark)
    short = docs.where("text IS NULL OR length(text) < 10000")
    wanted = sorted((expected(r.doc_id, r.text) for r in short.collect()), key=repr)
    assert sorted(map(tuple, periodic_runs.report(short).collect()), key=repr) == wanted
    assert periodic_runs.report(docs).count() == docs.count()
    assert periodic_runs.report(docs.limit(0)).count() == 0
    assert periodic_runs.runs_of(docs.limit(0)).count() == 0


def test_spans(spark):
    rows = texts(3)
    found = periodic_runs.runs_of(spark.createDataFrame(rows, "doc_id long, text string")).groupBy("doc_id").count()
    assert {tuple(r) for r in found.collect()} == {(d, e[1]) for d, t in rows if (e := expected(d, t))[1]}


def test_long_text():
    """A text of many repeats of one length, and one of a single word."""
    words = [b"w%d" % (i % 1000) for i in range(60_000)]
    (row,) = periodic_runs._described([(None, words)])
    assert row[:5] == (1, 0, 60_000, 1000, 60_000)
    (row,) = periodic_runs._described([(None, [b"x"] * 30_000)])
    assert row[:5] == (1, 0, 30_000, 1, 30_000_000)


def test_extensions():
    rng = np.random.default_rng(0)
    for trial in range(60):
        n = int(rng.integers(1, 90))
        s = rng.integers(0, int(rng.integers(1, 5)), n)
        if trial % 3 == 0 and n > 10:
            s[3:] = s[3 + np.arange(n - 3) % int(rng.integers(1, 6))]
        i, j = (m.ravel() for m in np.meshgrid(np.arange(n), np.arange(n)))
        i, j = i[i != j], j[i != j]
        table = np.zeros((n + 1, n + 1), int)
        for a in range(n - 1, -1, -1):
            for b in range(n - 1, -1, -1):
                table[a, b] = table[a + 1, b + 1] + 1 if s[a] == s[b] else 0
        assert (Extensions(s).of(i, j) == table[i, j]).all()
