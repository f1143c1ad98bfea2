"""Dropped lines against templates built from plain sets of lines."""

import random
import re
from collections import Counter, defaultdict

import pytest

from aisle.llm import line_dedup as ld
from tests.llm.cases import odd_documents


def drops(rows):
    """Numbers of the dropped lines of each (doc_id, text)."""
    placed, docs, leaves = [], defaultdict(set), defaultdict(set)
    for d, t in set(rows):
        for no, own in enumerate([] if t is None else t.split("\n")):
            line = re.sub(ld.NUMBERED, ld.FIELD, re.sub(ld.BLANKS, " ", own).strip(" "))
            tokens = line.split(" ")
            if line:
                leaf = (len(tokens), *tokens[: ld.LEADING])
                placed.append((line, (d, t), no))
                docs[line].add((d, t))
                leaves[leaf].add(line)
    first = lambda lines: min((d for x in lines for d, _ in docs[x] if d is not None), default=None)
    found = defaultdict(list)
    for lines in leaves.values():
        weight = Counter()
        for line in lines:
            firm = [t != ld.FIELD for t in line.split(" ")]
            if len(docs[line]) >= ld.LEAST_DOCUMENTS and sum(firm) >= ld.CONSTANT_SHARE * len(firm):
                found[line].append(first([line]))
            for e in enumerate(line.split(" ")):
                weight[e] += len(docs[line])
        templates = defaultdict(list)
        for line in lines if len(lines) > 1 else ():
            constant = [token != ld.FIELD and weight[p, token] >= ld.LEAST_DOCUMENTS for p, token in enumerate(line.split(" "))]
            if sum(constant) / len(constant) >= ld.CONSTANT_SHARE:
                templates[tuple(t if c else ld.FIELD for t, c in zip(line.split(" "), constant, strict=True))].append(line)
        for alike in templates.values():
            if len(set().union(*(docs[line] for line in alike))) >= ld.LEAST_DOCUMENTS:
                for line in alike:
                    found[line].append(first(alike))
    out = defaultdict(set)
    for line, (d, t), no in placed:
        if line in found and d != min((x for x in found[line] if x is not None), default=None):
            out[d, t].add(no)
    return out


def expected(rows):
    gone = drops(rows)
    out = []
    for d, t in rows:
        lines = [] if t is None else t.split("\n")
        kept = None if t is None else "\n".join(x for no, x in enumerate(lines) if no not in gone[d, t])
        out.append((d, len(lines), len(gone[d, t]), kept))
    return sorted(out, key=repr)


def corpus(seed, n=120):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") * rng.randrange(1, 4) + rng.choice("xyz")
    forms = [
        lambda: f"Copyright {rng.randrange(1990, 2030)} by {word()} and others, all rights reserved worldwide",
        lambda: f"Posted on  2024-{rng.randrange(1, 13)}-03 in \t{rng.choice(['news', 'sport'])} by the whole staff today",
        lambda: "Please share this page with your friends.",
        lambda: f"see also {word()}",
        lambda: "short line",
        lambda: "",
    ]
    docs = []
    for i in range(n):
        lines = [rng.choice(forms)() if rng.random() < 0.4 else " ".join(word() for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(1, 9))]
        docs.append((i * 7 % 1000, "\n".join(lines)))
    return docs


@pytest.mark.parametrize("seed", [1, 2])
def test_as_sets_of_lines(spark, seed):
    rows = corpus(seed)
    report = ld.line_report(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    found = sorted(map(tuple, report.collect()), key=repr)
    assert found == expected(rows)
    assert sum(r[2] for r in found) > 30


def test_odd_rows(spark):
    docs = odd_documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(map(tuple, ld.line_report(docs).collect()), key=repr) == expected(rows)
    assert ld.line_report(docs.limit(0)).count() == 0
    cleaned = ld.drop_lines(docs)
    assert cleaned.columns == docs.columns and cleaned.count() == docs.count()


def test_hot_line_without_ids(spark):
    rows = [(None, f"the same line here\nown {i} words of it") for i in range(12)] + [(5, "the same line here")]
    found = ld.line_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, found), key=repr) == expected(rows)


def test_short_lines_and_variants_of_one_document(spark):
    """Short lines and lines without blanks recur like others; numbers alone do not; variants in one document count once."""
    own = [f"own {'abcdefghijkl'[i]}" for i in range(12)]
    rows = [(i, f"Les.\nRead more\n{i}\n全文を読むにはここをクリック\n{own[i]}") for i in range(12)]
    rows.append((50, "\n".join(f"the first words of {c} and nothing else" for c in "abcdefghijkl")))
    found = ld.line_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, found), key=repr) == expected(rows)
    assert {r.n_dropped for r in found if 0 < r.doc_id < 12} == {3} and {r.n_dropped for r in found if r.doc_id in (0, 50)} == {0}
