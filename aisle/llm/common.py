"""Helpers that the corpus operators share: input, spare names, word hashes, grouping of linked rows."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aisle.session import cut_lineage

#: White space of all word rules here: blank and the control characters 9 to 13. ``bytes.split()`` cuts at the same six.
SPACE = r"[\x20\x09-\x0D]+"

MIX = np.uint64(0x9E3779B97F4A7C15)
FINISH = np.uint64(0xD6E8FEB86659FD93)
HALF = np.uint64(32)

#: Bits of the map by which rows are told that no other table asks for; at most one row for 64 of them is sent to the tasks.
MARKS = 1 << 24

#: Words that a worker keeps the hash of; beyond it hashes are computed anew.
CACHED_WORDS = 400_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spare(df: DataFrame, wanted: str) -> str:
    """A column name that the frame does not have yet, whatever extra columns it brings."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def marked(df: DataFrame, key: str, ids: DataFrame, name: str) -> DataFrame:
    """``df`` with a flag ``name`` that is true for every row whose ``key`` is in the one column of ``ids``, and for few others.

    Rows without it need not be shuffled to meet ``ids``. The map has a fixed number of bits, so the more ids the more others.
    """
    at = lambda c: F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(MARKS))
    word, bits = spare(df, "_word"), spare(df, "_bits")
    slots = ids.select(at(ids.columns[0]).alias("slot"))
    bit = F.expr("shiftleft(1L, cast(slot % 64 as int))")
    marks = slots.groupBy(F.expr("slot div 64").alias(word)).agg(F.bit_or(bit).alias(bits))
    told = df.withColumn(word, F.floor(at(key) / 64)).join(F.broadcast(marks), word, "left")
    own = F.getbit(F.col(bits), F.pmod(at(key), F.lit(64)).cast("int"))
    return told.select(*[F.col(f"`{c}`") for c in df.columns], F.coalesce(own == 1, F.lit(False)).alias(name))


def fold(day: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as empty text."""
    return F.crc32(F.coalesce(day.cast("string"), F.lit("")).cast("binary")) % modulus


class WordHashes(dict):
    """64-bit hash of each word; fills itself up to a bound."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(self) < CACHED_WORDS:
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def finish(values: np.ndarray) -> np.ndarray:
    """Spread the bits of rolling hashes, so that their order is as good as random."""
    values = (values ^ (values >> HALF)) * FINISH
    return values ^ (values >> HALF)


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` word hashes, in order."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    rolled = words[:n].copy()
    for step in range(1, k):
        rolled = rolled * MIX + words[step : step + n]
    return finish(rolled)


def runs(frames: Iterable, key: str) -> Iterator:
    """Cut a stream of pandas frames, sorted by ``key``, into one frame per key value."""
    import pandas as pd

    held: list = []
    for frame in frames:
        if not len(frame):
            continue
        values = frame[key].to_numpy()
        cuts = np.flatnonzero(values[1:] != values[:-1]) + 1
        start = 0
        for stop in [*cuts, len(frame)]:
            piece = frame.iloc[start:stop]
            if held and held[0][key].iloc[0] != piece[key].iloc[0]:
                yield held[0] if len(held) == 1 else pd.concat(held, ignore_index=True)
                held = []
            held.append(piece)
            start = stop
    if held:
        yield held[0] if len(held) == 1 else pd.concat(held, ignore_index=True)


def linked(edges: DataFrame) -> DataFrame:
    """Rows (node, root) for every node of ``edges`` (u, v): root is the smallest node reachable.

    Each round moves every node to its first neighbour's first neighbour and contracts the
    edges; "first" is by hash, so that a long chain of rising ids also shrinks by a constant
    factor. Only edges between different groups go on. Rounds are written to the shared
    folder; nothing is gathered.
    """
    spark = edges.sparkSession
    left = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    left = cut_lineage(left, "edges")
    steps = []
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("v").alias("u"), F.col("u").alias("v")))
        first = F.least(F.min(F.struct(F.xxhash64("v"), "v")), F.min(F.struct(F.xxhash64("u"), F.col("u").alias("v"))))
        near = cut_lineage(both.groupBy(F.col("u").alias("node")).agg(first["v"].alias("up")), "near")
        top = near.select(F.col("node").alias("up"), F.col("up").alias("top"))
        step = cut_lineage(near.join(top, "up").select("node", F.col("top").alias("up")), "step")
        steps.append(step)
        a = step.select(F.col("node").alias("u"), F.col("up").alias("ua"))
        b = step.select(F.col("node").alias("v"), F.col("up").alias("vb"))
        left = left.join(a, "u").join(b, "v").select(F.greatest("ua", "vb").alias("u"), F.least("ua", "vb").alias("v"))
        left = cut_lineage(left.where("u <> v").distinct(), "edges")
    if not steps:
        return spark.createDataFrame([], "node long, root long")
    # All nodes of a round are nodes of the rounds before it, so each round is looked up in the one that follows.
    named = steps[-1]
    for step in reversed(steps[:-1]):
        further = named.select(F.col("node").alias("up"), F.col("up").alias("far"))
        named = step.join(further, "up", "left").select("node", F.coalesce("far", "up").alias("up"))
    named = cut_lineage(named, "named")
    roots = named.groupBy("up").agg(F.min("node").alias("root"))
    return named.join(roots, "up").select("node", "root")
