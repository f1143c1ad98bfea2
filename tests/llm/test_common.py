"""Grouping of linked rows against a plain union-find."""

import random
import time

import pytest
from pyspark.sql import functions as F

from aisle.llm.common import grams, linked, marked, spare, WordHashes
from aisle.session import cut_lineage


def brute(pairs):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("pairs", [
    [],
    [(1, 1)],
    [(5, 1), (5, 2), (5, 3), (5, 4), (1, 5)],
    [(i, i + 1) for i in range(40)],
    [(random.Random(i).randrange(60), random.Random(i + 900).randrange(60)) for i in range(50)],
])
def test_linked(spark, pairs):
    edges = spark.createDataFrame(pairs, "u long, v long")
    found = {r.node: r.root for r in linked(edges).collect()}
    assert found == {k: v for k, v in brute([p for p in pairs if p[0] != p[1]]).items()}


def test_grams_depend_on_the_words_alone():
    words = WordHashes()
    a, b = words.of(b"x a b c d e y".split()), words.of(b"a b c d e".split())
    assert grams(a, 5)[1] == grams(b, 5)[0]
    assert len(grams(b, 6)) == 0


def test_spare(spark):
    df = spark.createDataFrame([(1, 2)], "row int, ROW_ int")
    assert spare(df, "row") == "row__"


def shuffle_files(spark):
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for i in range(found.size()) if (name := found.apply(i).getName()).startswith("shuffle_")}


def test_a_written_table_leaves_no_shuffle_files(spark):
    before = shuffle_files(spark)
    frame = spark.range(5000).repartition(4, "id").groupBy((F.col("id") % 700).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    written = cut_lineage(frame)
    until = time.time() + 20
    while (left := shuffle_files(spark) - before) and time.time() < until:
        time.sleep(0.2)
    assert not left
    assert written.count() == 700 and frame.count() == 700


def test_marked_misses_none_and_flags_few_others(spark):
    rows = spark.createDataFrame([(i if i else None, i, "x") for i in range(5000)], "`a.id` long, _word int, _bits string").withColumnRenamed("a.id", "id")
    found = marked(rows, "id", spark.createDataFrame([(i,) for i in range(1, 5000, 50)], "v long"), "wanted")
    assert found.columns == ["id", "_word", "_bits", "wanted"]
    flagged = {r.id for r in found.collect() if r.wanted}
    assert found.count() == 5000 and flagged >= set(range(1, 5000, 50)) and len(flagged) < 120 and None not in flagged
    assert not marked(rows, "id", spark.createDataFrame([], "v long"), "wanted").where("wanted").count()
