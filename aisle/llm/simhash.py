"""SimHash near-duplicates by anchor points: a covering code, replicas within its radius plus the threshold, comparison per anchor.

The 64 bits fall into three blocks of 22, 21 and 21. Anchors of a block are the words of
the Golay code of length 23, to which blocks are filled up with zeros: every point is within
three bits of exactly one of them, its home. Of four differing bits at least one block holds
one or none, so two linked fingerprints meet there if each goes to every anchor within three
bits and one more. A large corpus would crowd these 3 x 4096 anchors. Then anchors are pairs of code
words of two blocks (three pairs, 2**24 anchors each); two blocks of the three hold at most
two of the four bits, so each fingerprint goes to all pairs that are at most two bits
beyond the radius, both blocks together. Both ways find every link.

Equal fingerprints fold into one before anything is replicated. At an anchor every home
point is compared with all that are there; groups grow from their members, and what has been
reached is not compared again, so a cluster of near copies is cheap and gives a star of
links instead of all its pairs. An anchor with more points than a task should hold is cut into
chunks, and each two chunks are a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aisle.llm.common import cut_lineage, linked

WIDTH = 4
SEED = 42
#: Differing bits up to which two fingerprints link.
THRESHOLD = 4
#: First bit and number of bits of each block.
BLOCKS = [(0, 22), (22, 21), (43, 21)]
CODE_BITS = 23
RADIUS = 3
#: Share of all fingerprints that one block's anchor sees; above so many points of an anchor, pairs of blocks are used.
ANCHOR_SHARE = 10903 / (1 << 23)
ANCHOR_POINTS = 50_000
#: Points of an anchor in one task; larger anchors are cut into chunks of half of it.
TASK_POINTS = 1_000_000
#: Hashes of a text whose bits are counted at a time.
HASHES = 1 << 15
#: Points that are compared at once.
CELLS = 1 << 21
#: Generator polynomial of the code, highest power first: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101


def fingerprint(text: bytes) -> int:
    """64 bits, as a signed number: each is set in over half of the hashes of the text's 4-word shingles."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= WIDTH:
        starts, stops = [0], [len(joined)]
    else:
        length = np.fromiter(map(len, words), np.int64, len(words))
        stop = np.cumsum(length + 1) - 1
        starts, stops = (stop - length)[: 1 - WIDTH].tolist(), stop[WIDTH - 1 :].tolist()
    counts = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(starts), HASHES):
        pieces = zip(starts[at : at + HASHES], stops[at : at + HASHES], strict=True)
        hashes = np.array([digest(joined[a:b], SEED) for a, b in pieces], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (2 * counts > len(starts)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = [fingerprint(t.as_buffer().to_pybytes()) if t.is_valid else 0 for t in batch["text"]]
        yield pa.record_batch({"doc_id": batch["doc_id"], "fp": pa.array(prints, pa.int64())})


def syndrome(points: np.ndarray) -> np.ndarray:
    """Remainder of 23-bit points by the generator polynomial; equal remainders differ by a code word."""
    rest = points.astype(np.int64)
    for power in range(CODE_BITS - 1, 10, -1):
        rest = np.where((rest >> power) & 1, rest ^ (GENERATOR << (power - 11)), rest)
    return rest


@cache
def cosets(reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Errors of at most ``reach`` bits by syndrome: where each syndrome's begin, the errors, their bits beyond the radius."""
    bits = [1 << k for k in range(CODE_BITS)]
    errors = np.array([sum(some) for size in range(reach + 1) for some in combinations(bits, size)], np.int64)
    errors = errors[np.argsort(syndrome(errors), kind="stable")]
    weight = np.bitwise_count(errors).astype(np.int64)
    starts = np.searchsorted(syndrome(errors), np.arange((1 << 11) + 1))
    return starts, errors, np.maximum(weight - RADIUS, 0)


def near_words(points: np.ndarray, beyond: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All code words within the radius and ``beyond`` bits of each point: row of the point, code word, bits beyond the radius."""
    starts, errors, over = cosets(RADIUS + beyond)
    of = syndrome(points)
    counts = starts[of + 1] - starts[of]
    row = np.repeat(np.arange(len(points)), counts)
    at = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(starts[of], counts)
    return row, points[row] ^ errors[at], over[at]


def block(prints: np.ndarray, number: int) -> np.ndarray:
    first, bits = BLOCKS[number]
    return ((prints.view(np.uint64) >> np.uint64(first)) & np.uint64((1 << bits) - 1)).astype(np.int64)


def _anchors(prints: np.ndarray, paired: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row, anchor and bits beyond the home for each replica of the fingerprints, a block or pair of blocks at a time."""
    if not paired:
        for number in range(3):
            row, word, over = near_words(block(prints, number), 1)
            yield row, (np.int64(number) << 60) | word, over
        return
    for number, (first, second) in enumerate(((0, 1), (0, 2), (1, 2))):
        a, b = near_words(block(prints, first), 2), near_words(block(prints, second), 2)
        # Every word of the second block beside every word of the first one of the same fingerprint.
        starts = np.searchsorted(b[0], np.arange(len(prints) + 1))
        counts = np.diff(starts)[a[0]]
        left = np.repeat(np.arange(len(a[0])), counts)
        right = np.arange(len(left)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(starts[a[0]], counts)
        over = a[2][left] + b[2][right]
        fits = over <= 2
        left, right, over = left[fits], right[fits], over[fits]
        yield a[0][left], (np.int64(number + 3) << 60) | (a[1][left] << CODE_BITS) | b[1][right], over


def _replicas(paired: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = batch["fp"].to_numpy()
            for start in range(0, len(every), 4096):
                prints = every[start : start + 4096]
                for row, anchor, over in _anchors(prints, paired):
                    yield pa.record_batch({"anchor": anchor, "fp": prints[row], "home": over == 0})

    return run


def groups(homes: np.ndarray, guests: np.ndarray) -> np.ndarray:
    """Links (from, to) that tie together all points with a home point at most ``THRESHOLD`` bits away.

    Links between two guests are left to the anchors that are their homes.
    """
    links: list[np.ndarray] = []
    left = homes

    def near(some: np.ndarray, all_: np.ndarray) -> np.ndarray:
        return np.bitwise_count(some[:, None] ^ all_[None, :]) <= THRESHOLD

    while len(left):
        seeds = left[: max(1, CELLS // (len(left) + len(guests)))][:64]
        # Seeds with nobody near are done at once; the group of the first other one is gathered, then the rest goes on.
        close = near(seeds, left)
        tied = (close.sum(1) > 1) | near(seeds, guests).any(1)
        if not tied.any():
            left = left[len(seeds) :]
            continue
        first = int(tied.argmax())
        root = seeds[first]
        left = np.delete(left[first:], 0)
        outside = guests
        front, at = np.array([root]), 0
        while at < len(front):
            some = front[at : at + max(1, min(64, CELLS // (len(left) + len(outside) + 1)))]
            at += len(some)
            met, seen = near(some, left).any(0), near(some, outside).any(0)
            reached = left[met]
            front = np.concatenate([front, reached])
            links.append(np.concatenate([reached, outside[seen]]))
            links[-1] = np.stack([np.full(len(links[-1]), root), links[-1]], 1)
            left, outside = left[~met], outside[~seen]
    return np.concatenate(links) if links else np.empty((0, 2), np.uint64)


def _compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links of each task, of rows sorted by task."""

    def found(task: np.ndarray, prints: np.ndarray, home: np.ndarray) -> pd.DataFrame:
        cuts = np.flatnonzero(np.diff(task)) + 1
        starts, stops = np.append(0, cuts), np.append(cuts, len(task))
        several = stops - starts > 1
        rows = [np.empty((0, 2), np.uint64)]
        for a, b in zip(starts[several].tolist(), stops[several].tolist(), strict=True):
            own, at = prints[a:b], home[a:b]
            rows.append(groups(own[at], own[~at]))
        return pd.DataFrame(np.concatenate(rows).view(np.int64), columns=["u", "v"])

    held = [np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, bool)]
    for frame in frames:
        new = [frame["task"].to_numpy(np.int64), frame["fp"].to_numpy(np.int64).view(np.uint64), frame["home"].to_numpy(bool)]
        held = [np.concatenate(pair) for pair in zip(held, new, strict=True)]
        if len(held[0]) and held[0][0] != held[0][-1]:
            last = int(np.searchsorted(held[0], held[0][-1]))
            yield found(*[h[:last] for h in held])
            held = [h[last:] for h in held]
    if len(held[0]):
        yield found(*held)


def fingerprints(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, fp): the fingerprint of every row as a signed number."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(_fingerprints, f"doc_id {kind}, fp long")


def links(prints: DataFrame, paired: bool | None = None) -> DataFrame:
    """Rows (u, v) that tie all different fingerprints at most four bits apart, over any number of steps.

    ``prints`` holds each fingerprint once. Without ``paired`` the finer anchors are taken where the coarse
    ones would be crowded; the links tie the same groups.
    """
    points = prints.count()
    if paired is None:
        paired = points * ANCHOR_SHARE > ANCHOR_POINTS
    replicas = prints.select("fp").mapInArrow(_replicas(paired), "anchor long, fp long, home boolean")
    placed = replicas.withColumn("task", F.col("anchor"))
    if points > TASK_POINTS:
        # Only here can an anchor have more points than a task should hold.
        sizes = replicas.groupBy("anchor").agg(F.count(F.lit(1)).alias("points")).where(F.col("points") > TASK_POINTS)
        crowded = cut_lineage(sizes.select("anchor", F.ceil(F.col("points") / (TASK_POINTS // 2)).cast("int").alias("chunks")), "crowded")
        own, other = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
        cut = replicas.join(crowded, "anchor").withColumn("own", own).withColumn("other", other)
        cut = cut.withColumn("task", F.xxhash64("anchor", F.least("own", "other"), F.greatest("own", "other")))
        placed = placed.join(crowded, "anchor", "left_anti").unionByName(cut.select("anchor", "fp", "home", "task"))
    placed = placed.select("task", "fp", "home").repartition("task").sortWithinPartitions("task")
    return placed.mapInPandas(_compare, "u long, v long")


def components(docs: DataFrame, paired: bool | None = None) -> DataFrame:
    """Fingerprint and component of every row.

    Rows (doc_id, fingerprint, component_id): 16 hexadecimal digits, and the smallest doc_id
    that links of at most four differing bits reach. Cases: null texts and texts without
    words have fingerprint zero and are linked like any other; fewer than four words are one
    shingle; rows with a null doc_id pass links on and have the component of their
    fingerprint (null if no other id is in it); each of repeated rows gets its row; an empty
    table gives no rows; extra columns are ignored.
    """
    prints = cut_lineage(fingerprints(docs), "prints")
    known = cut_lineage(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "known")
    roots = linked(links(known, paired)).select(F.col("node").alias("fp"), "root")
    named = cut_lineage(known.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "named")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    found = named.select("fp", "root").join(least, "root").select("fp", "component_id")
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return prints.join(found, "fp").select("doc_id", digits, "component_id")
