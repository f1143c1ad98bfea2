"""Exact duplicates against grouping the texts themselves; the filter against counting."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from aisle.llm import exact_dedup, quotient
from tests.llm.cases import odd_documents


def expected(rows):
    body = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = defaultdict(list)
    for d, t in rows:
        groups[body(t)].append(d)
    out = []
    for d, t in rows:
        of = groups[body(t)]
        keep = min((x for x in of if x is not None), default=None)
        out.append((d, keep, len(of), d == keep, hashlib.sha256(body(t).encode()).hexdigest()))
    return sorted(out, key=repr)


def corpus(seed):
    rng = random.Random(seed)
    base = [" ".join(rng.choice("abc") for _ in range(rng.randrange(6))) for _ in range(60)]
    return [(i, rng.choice(base).replace(" ", rng.choice([" ", "\n", " \t "]))) for i in rng.sample(range(9000), 400)]


@pytest.mark.parametrize(("seed", "filter_size"), [(1, None), (2, 16)])
def test_as_grouping(spark, seed, filter_size, monkeypatch):
    if filter_size:
        monkeypatch.setattr(exact_dedup, "FILTER_SIZE", filter_size)
    rows = corpus(seed)
    found = exact_dedup.exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    assert sorted(map(tuple, found.collect()), key=repr) == expected(rows)


def test_odd_rows(spark):
    docs = odd_documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(map(tuple, exact_dedup.exact_duplicates(docs).collect()), key=repr) == expected(rows)
    assert exact_dedup.exact_duplicates(docs.limit(0)).count() == 0


def test_filters_lose_nothing():
    rng = np.random.default_rng(4)
    parts = [rng.choice(rng.integers(0, 2**64, 300, dtype=np.uint64), 500) for _ in range(3)]
    parts.append(np.array([0, 0, 2**64 - 1, 1 << 40, (1 << 40) - 1], np.uint64))
    parts.append(parts[0][:50])
    built = [quotient.unpack(quotient.pack(*quotient.build(p))) for p in parts]
    values, counts = quotient.merge(built)
    all_values, all_counts = np.unique(np.concatenate(parts), return_counts=True)
    assert values.tolist() == all_values.tolist() and counts.tolist() == all_counts.tolist()
    assert len(quotient.merge([quotient.unpack(quotient.pack(*quotient.build(np.empty(0, np.uint64))))])[0]) == 0
