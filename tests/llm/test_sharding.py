"""Placement against a plain descent; what moves when a weight changes or a shard is added."""

import hashlib
import math
import zlib

from pyspark.sql import functions as F

from aisle.llm import sharding
from aisle.llm.queries import GROWN, TREE
from tests.llm.cases import odd_documents


def descent(key, node):
    while node.children:
        draws = []
        for i, c in enumerate(node.children):
            bits = int(hashlib.md5(f"{key}/{c.name}".encode()).hexdigest()[:13], 16)
            draws.append((-math.log((bits + 0.5) / 2**52) / c.weight, i))
        node = node.children[min(draws)[1]] if len(node.children) > 1 else node.children[0]
    return node.shard


def check_rows(rows, texts):
    assert len(rows) == len(texts)
    for r in rows:
        key = "" if r.doc_id is None else str(r.doc_id)
        assert (r.shard, r.grown_shard, r.law) == (descent(key, TREE), descent(key, GROWN), "key")
        assert r.grown_shard in (r.shard, 8)
    sized = sorted(((r.doc_id, r.size, r.text_crc32) for r in rows), key=repr)
    assert sized == sorted(((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in texts), key=repr)
    for shard in range(8):
        slots = sorted(r.slot for r in rows if r.shard == shard)
        assert slots == list(range(len(slots)))


def test_placement(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    rows = sharding.shard_documents(docs, TREE, GROWN).collect()
    check_rows(rows, [(r.doc_id, r.text) for r in docs.collect()])
    number = [sum(r.shard == s for r in rows) for s in range(8)]
    assert max(number) < 1.25 * min(number)
    assert 250 < sum(r.grown_shard == 8 for r in rows) < 420


def test_odd_rows(spark):
    docs = odd_documents(spark)
    check_rows(sharding.shard_documents(docs, TREE, GROWN).collect(), [(r.doc_id, r.text) for r in docs.collect()])
    assert sharding.shard_documents(docs.limit(0), TREE, GROWN).count() == 0


def test_a_weight_moves_rows_into_its_subtree_only(spark):
    def heavier(node):
        if node.shard is not None:
            return sharding.Node(node.name, shard=node.shard, own_weight=3.0 if node.shard == 0 else 1.0)
        return sharding.Node(node.name, tuple(map(heavier, node.children)))

    rows = spark.range(2000).select(
        sharding.descend(F.col("id").cast("string"), TREE).alias("old"), sharding.descend(F.col("id").cast("string"), heavier(TREE)).alias("new")
    ).collect()
    moved = [(r.old, r.new) for r in rows if r.old != r.new]
    assert moved
    for old, new in moved:
        assert new < 4  # into the region whose weight grew
        if old < 4:
            assert new < 2  # within it into the rack
        if old < 2:
            assert new == 0
