"""Fingerprints against bits counted one by one, components against all pairs, the code against its definition."""

import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from aisle.llm import simhash
from tests.llm.cases import odd_documents


def plain_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    pieces = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(p, seed=42) for p in pieces]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def expected(rows):
    prints = [plain_print(t) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4 and label[i] != label[j]:
                label = [label[j] if x == label[i] else x for x in label]
    least = defaultdict(lambda: None)
    for (d, _), x in zip(rows, label, strict=True):
        if d is not None:
            least[x] = d if least[x] is None else min(d, least[x])
    return sorted(((d, f"{p:016x}", least[x]) for (d, _), p, x in zip(rows, prints, label, strict=True)), key=repr)


def corpus(seed):
    """Texts of a few hundred words with a word or two changed, so that fingerprints differ by few bits; short texts too."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(3000)}"
    rows = []
    for _ in range(25):
        base = [word() for _ in range(rng.randrange(150, 400))]
        for _ in range(rng.randrange(1, 9)):
            copy = list(base)
            for _ in range(rng.randrange(6)):
                copy[rng.randrange(len(copy))] = word().upper()
            rows.append(" ".join(copy))
    rows += [" ".join(word() for _ in range(rng.randrange(6))) for _ in range(40)]
    return list(enumerate(rows, 1))


@pytest.mark.parametrize("paired", [False, True])
def test_as_all_pairs(spark, paired):
    rows = corpus(4)
    wanted = expected(rows)
    assert len({c for *_, c in wanted}) < len({p for _, p, _ in wanted}) < len(rows)
    found = simhash.components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), paired)
    assert sorted(map(tuple, found.collect()), key=repr) == wanted


def test_crowded_anchors(spark, monkeypatch):
    """Anchors cut into chunks link the same points."""
    monkeypatch.setattr(simhash, "TASK_POINTS", 6)
    rows = corpus(5)
    found = simhash.components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert sorted(map(tuple, found.collect()), key=repr) == expected(rows)


def test_odd_rows(spark):
    docs = odd_documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(map(tuple, simhash.components(docs).collect()), key=repr) == expected(rows)
    assert simhash.components(docs.limit(0)).count() == 0


def test_code_is_perfect():
    """Every point is within three bits of one code word, code words are seven bits apart, and all within reach are listed."""
    rng = np.random.default_rng(2)
    words = np.arange(1 << simhash.CODE_BITS)
    words = words[simhash.syndrome(words) == 0]
    assert len(words) == 4096 and np.bitwise_count(words[1:]).min() == 7
    points = rng.integers(0, 1 << simhash.CODE_BITS, 200)
    for beyond in (0, 1, 2):
        row, word, over = simhash.near_words(points, beyond)
        away = np.bitwise_count(points[:, None] ^ words[None, :])
        listed = sorted(zip(row.tolist(), word.tolist(), over.tolist(), strict=True))
        i, j = np.nonzero(away <= 3 + beyond)
        wanted = sorted(zip(i.tolist(), words[j].tolist(), np.maximum(away[i, j].astype(int) - 3, 0).tolist(), strict=True))
        assert listed == wanted
    assert (np.bincount(simhash.near_words(points, 0)[0]) == 1).all()


@pytest.mark.parametrize("paired", [False, True])
def test_every_near_pair_meets(paired):
    """Any fingerprint changed in up to four bits shares an anchor that is home to one of the two."""
    rng = np.random.default_rng(9)
    a = rng.integers(0, 1 << 64, 400, dtype=np.uint64)
    b = a.copy()
    for k in range(400):
        for bit in rng.choice(64, k % 5, replace=False):
            b[k] ^= np.uint64(1) << np.uint64(bit)
    places = [defaultdict(set), defaultdict(set)]
    for side, prints in enumerate((a, b)):
        for row, anchor, over in simhash._anchors(prints.view(np.int64), paired):
            for r, x, o in zip(row.tolist(), anchor.tolist(), over.tolist(), strict=True):
                places[side][r].add((x, o == 0))
    for k in range(400):
        home = {x for x, h in places[0][k] if h}
        assert home & {x for x, _ in places[1][k]}
