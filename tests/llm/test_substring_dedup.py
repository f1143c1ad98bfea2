"""Removed windows against a plain table of all windows; the index against counting."""

import hashlib
import random

import numpy as np
import pytest

from aisle.llm import substring_dedup as sd
from aisle.llm.fm_index import FmIndex, Wavelet
from tests.llm.cases import odd_documents

W = sd.WINDOW


def expected(rows):
    first = {}
    rank = lambda d: sd.LAST if d is None else d
    texts = [(d, (t or "").encode().split()) for d, t in rows]
    for d, w in texts:
        for i in range(len(w) - W + 1):
            key = tuple(w[i : i + W])
            first[key] = min(first.get(key, sd.LAST), rank(d))
    out = []
    for d, w in texts:
        gone = set()
        for i in range(len(w) - W + 1):
            if first[tuple(w[i : i + W])] < rank(d):
                gone.update(range(i, i + W))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def corpus(seed, n=90):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") + str(rng.randrange(300))
    passages = [[word() for _ in range(rng.randrange(45, 130))] for _ in range(5)]
    docs = []
    for _ in range(n):
        kind = rng.random()
        if kind < 0.2 and docs:
            text = list(rng.choice(docs))
            for _ in range(rng.randrange(0, 3)):
                text[rng.randrange(len(text))] = word()
        else:
            text = [word() for _ in range(rng.randrange(1, 100))]
            for _ in range(rng.randrange(0, 3)):
                p = rng.choice(passages)
                a = rng.randrange(0, 10)
                text += p[a:] + [word() for _ in range(rng.randrange(0, 30))]
        if rng.random() < 0.05:
            text = ["same"] * rng.randrange(40, 140)
        docs.append(text)
    ids = rng.sample(range(10 * n), n)
    return [(i, rng.choice([" ", "\n", " \t"]).join(t)) for i, t in zip(ids, docs, strict=True)]


@pytest.mark.parametrize(("seed", "units", "shard"), [(1, None, None), (2, 2, None), (3, None, 400), (4, 3, 2000)])
def test_as_all_windows(spark, seed, units, shard, monkeypatch):
    if units:
        monkeypatch.setattr(sd, "UNITS", units)
    if shard:
        monkeypatch.setattr(sd, "SHARD_WORDS", shard)
    rows = corpus(seed)
    found = sd.report(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert sorted(map(tuple, found), key=repr) == expected(rows)


def test_odd_rows(spark):
    docs = odd_documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(map(tuple, sd.report(docs).collect()), key=repr) == expected(rows)
    assert sd.report(docs.limit(0)).count() == 0


def test_wavelet_counts():
    rng = np.random.default_rng(2)
    symbols = rng.integers(0, 37, 500)
    tree = Wavelet(symbols, 37)
    ask, at = rng.integers(0, 37, 200), rng.integers(0, 501, 200)
    assert tree.rank(ask, at).tolist() == [int((symbols[:a] == s).sum()) for s, a in zip(ask, at, strict=True)]


def test_index_finds_windows():
    rng = np.random.default_rng(3)
    held = [rng.integers(1, 4, rng.integers(3, 30)) for _ in range(20)]
    index = FmIndex(held, 4, 3)
    flat = np.concatenate([np.append(h, 0) for h in held])
    for s, found in zip(held, index.windows(held), strict=True):
        assert len(found) == len(s) - 2
        for i, f in enumerate(found):
            p = index.suffixes[f]
            assert tuple(flat[p : p + 3]) == tuple(s[i : i + 3])
            alike = {int(q) for q in index.suffixes[index.group == index.group[f]]}
            assert alike == {q for q in range(len(flat) - 2) if tuple(flat[q : q + 3]) == tuple(s[i : i + 3])}
