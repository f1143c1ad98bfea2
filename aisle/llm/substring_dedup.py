"""Substring deduplication: windows of 50 words that an earlier document holds, through FM-indexes of shards.

Equal windows have the same smallest 20-gram at the same place; that gram is their anchor. A
stretch of windows with one anchor, its unit, is compared with the units of that anchor only,
so the corpus falls into shards by anchor and each window goes to one shard. Anchors of one
document need no comparing and equal units fold into the first of them before anything is
shuffled by anchor. What is left of a shard, a bounded number of words, is put into an
FM-index; the units are streamed through it, and windows whose matches include an earlier
document are reported as intervals.

An anchor with very many different units, as in a passage that a third of the corpus quotes,
is cut further: each of its windows is a unit of its own, equal ones fold, and no search is
left to do.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aisle.llm.common import MIX, WordHashes, cut_lineage, finish, grams, runs
from aisle.llm.fm_index import FmIndex

WINDOW = 50
GRAM = 20
SPAN = WINDOW - GRAM + 1
#: Words of a shard's index, about; an anchor's units stay together.
SHARD_WORDS = 150_000
#: Different units of an anchor up to which it is searched in one shard.
UNITS = 256
#: A row without an id is later than all others.
LAST = (1 << 63) - 1

SECOND = np.uint64(0xC2B2AE3D27D4EB4F)


class Rolling:
    """Hash of any stretch of word hashes from two running sums, whatever its place."""

    def __init__(self, base: np.uint64) -> None:
        self.base = base
        self.inverse = np.uint64(pow(int(base), -1, 1 << 64))
        self.up = self.down = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        size = max(n + 1, 2 * len(self.up))
        for name, factor in (("up", self.base), ("down", self.inverse)):
            powers = np.full(size, factor, np.uint64)
            powers[0] = 1
            setattr(self, name, np.cumprod(powers, dtype=np.uint64))

    def of(self, words: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        if len(words) >= len(self.up):
            self._grow(len(words))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * self.up[: len(words)], dtype=np.uint64)])
        raw = (sums[start + length] - sums[start]) * self.down[start]
        return finish(raw + length.astype(np.uint64) * SECOND)


def anchors(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the word hashes of a text: each anchor's gram, first window and number of windows."""
    g = grams(words, GRAM)
    n = len(g) - SPAN + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    best, reach = np.arange(len(g)), 1
    while reach < SPAN:
        step = min(reach, SPAN - reach)
        left, right = best[: len(best) - step], best[step:]
        best, reach = np.where(g[right] < g[left], right, left), reach + step
    starts = np.flatnonzero(np.append(True, best[1:] != best[:-1]))
    return g[best[starts]], starts, np.diff(np.append(starts, n))


def _anchors(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    hashes, rolling = WordHashes(), Rolling(MIX)
    for frame in frames:
        found = []
        for k, text in enumerate(frame["text"]):
            words = hashes.of(text.split())
            anchor, start, windows = anchors(words)
            if len(anchor):
                found.append((np.full(len(anchor), k), anchor, rolling.of(words, start, windows + WINDOW - 1), start, windows))
        if found:
            row, anchor, unit, start, windows = (np.concatenate(c) for c in zip(*found, strict=True))
            yield pd.DataFrame(
                {
                    "anchor": anchor.view(np.int64), "unit": unit.view(np.int64), "id": frame["id"].to_numpy(np.int64)[row],
                    "body": frame["body"].to_numpy(np.int64)[row], "start": start.astype(np.int32), "windows": windows.astype(np.int32),
                }
            )


def _units(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Words of the units of each document; of crowded anchors instead the hashes of each window."""
    hashes, first, second = WordHashes(), Rolling(MIX), Rolling(SECOND)
    zero = np.int64(0)
    for frame in frames:
        for id_, text, units in zip(frame["id"], frame["text"], frame["units"], strict=True):
            tokens = text.split()
            words = None
            plain = [u for u in units if not u["crowded"]]
            if plain:
                yield pd.DataFrame(
                    {
                        "crowded": False, "anchor": [u["anchor"] for u in plain], "unit": [u["unit"] for u in plain], "id": id_,
                        "words": [b" ".join(tokens[u["start"] : u["start"] + u["windows"] + WINDOW - 1]) for u in plain],
                        "place": np.int32(0), "w1": zero, "w2": zero,
                    }
                )
            for u in units:
                if u["crowded"]:
                    words = hashes.of(tokens) if words is None else words
                    at = u["start"] + np.arange(u["windows"])
                    width = np.full(len(at), WINDOW)
                    yield pd.DataFrame(
                        {
                            "crowded": True, "anchor": u["anchor"], "unit": u["unit"], "id": id_, "words": b"",
                            "place": np.arange(u["windows"], dtype=np.int32),
                            "w1": first.of(words, at, width).view(np.int64), "w2": second.of(words, at, width).view(np.int64),
                        }
                    )


def _intervals(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def earlier(units: list[list[bytes]], ids: np.ndarray) -> list[np.ndarray]:
    """For each unit, which of its windows also stand in a unit of a smaller id: one FM-index, all units streamed."""
    names: dict[bytes, int] = {}
    sequences = [np.array([names.setdefault(w, len(names) + 1) for w in unit], np.int64) for unit in units]
    index = FmIndex(sequences, len(names) + 1, WINDOW)
    starts = np.flatnonzero(np.append(True, index.group[1:] != index.group[:-1]))
    least = np.minimum.reduceat(ids[index.owner[index.suffixes]], starts)
    return [least[index.group[at]] < id_ for at, id_ in zip(index.windows(sequences), ids, strict=True)]


def _search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for shard in runs(frames, "shard"):
        flags = earlier([w.split(b" ") for w in shard["words"]], shard["id"].to_numpy(np.int64))
        rows = []
        for anchor, unit, found in zip(shard["anchor"], shard["unit"], flags, strict=True):
            rows += [(anchor, unit, int(a), int(b)) for a, b in zip(*_intervals(found), strict=True)]
        if rows:
            yield pd.DataFrame(rows, columns=["anchor", "unit", "low", "high"])


def _rows(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("binary"), F.lit("").cast("binary"))
    id_ = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))
    return docs.select("doc_id", id_.alias("id"), F.xxhash64(text).alias("body"), text.alias("text"))


def _hits(rows: DataFrame, firsts: DataFrame) -> DataFrame:
    """Rows (anchor, unit, hits): window intervals of each unit that an earlier document holds in another unit."""
    several = firsts.groupBy("anchor").agg(F.count(F.lit(1)).alias("units")).where("units > 1")
    several = cut_lineage(several.select("anchor", (F.col("units") > UNITS).alias("crowded")), "several")
    wanted = cut_lineage(firsts.join(several, "anchor"), "wanted")
    total = wanted.where("NOT crowded").agg(F.coalesce(F.sum(F.col("windows") + WINDOW - 1), F.lit(0)).alias("n")).first()["n"]
    shards = max(1, -(-total // SHARD_WORDS))
    by_doc = wanted.groupBy("id", "body").agg(F.collect_list(F.struct("anchor", "unit", "start", "windows", "crowded")).alias("units"))
    cut = rows.join(by_doc, ["id", "body"]).select("id", "text", "units").mapInPandas(
        _units, "crowded boolean, anchor long, unit long, id long, words binary, place int, w1 long, w2 long"
    )
    cut = cut_lineage(cut, "cut")
    plain = cut.where("NOT crowded").select(F.pmod(F.xxhash64("anchor"), F.lit(shards)).alias("shard"), "anchor", "unit", "id", "words")
    plain = plain.repartition("shard").sortWithinPartitions("shard", "id", "anchor", "unit")
    searched = plain.mapInPandas(_search, "anchor long, unit long, low int, high int")
    single = cut.where("crowded").select("anchor", "unit", "id", "place", "w1", "w2")
    least = cut_lineage(single.groupBy("w1", "w2").agg(F.min("id").alias("least")), "least")
    folded = single.join(least, ["w1", "w2"]).where("least < id").select("anchor", "unit", F.col("place").alias("low"), (F.col("place") + 1).alias("high"))
    return searched.unionByName(folded).groupBy("anchor", "unit").agg(F.collect_set(F.struct("low", "high")).alias("hits"))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """Rows (id, body, spans): word intervals of each text that lie in a window which an earlier document holds.

    ``id`` is the doc_id, the largest number for null; ``body`` is a hash of the text, so
    that rows that repeat an id are told apart. Texts without such a window have no row.
    """
    rows = _rows(docs)
    units = rows.mapInPandas(_anchors, "anchor long, unit long, id long, body long, start int, windows int")
    units = cut_lineage(units, "units")
    shared = units.groupBy("anchor").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("anchor")
    members = cut_lineage(units.join(cut_lineage(shared, "shared"), "anchor"), "members")
    firsts = members.groupBy("anchor", "unit").agg(F.min(F.struct("id", "body", "start", "windows")).alias("at"))
    firsts = cut_lineage(firsts.select("anchor", "unit", "at.*"), "firsts")
    hits = _hits(rows, firsts)
    reach = firsts.select("anchor", "unit", F.col("id").alias("first")).join(hits, ["anchor", "unit"], "left")
    reach = cut_lineage(reach, "reach")
    # A unit that is not the first of its kind stands whole in an earlier document.
    whole = F.array(F.struct(F.col("start").alias("low"), (F.col("start") + F.col("windows") + WINDOW - 1).alias("high")))
    part = F.transform("hits", lambda h: F.struct((F.col("start") + h["low"]).alias("low"), (F.col("start") + h["high"] + WINDOW - 1).alias("high")))
    spans = members.join(reach, ["anchor", "unit"]).select("id", "body", F.explode(F.when(F.col("id") > F.col("first"), whole).otherwise(part)).alias("span"))
    return spans.groupBy("id", "body").agg(F.collect_set("span").alias("spans"))


def _apply(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        n, gone, digests = [], [], []
        for text, spans in zip(frame["text"], frame["spans"], strict=True):
            words = text.split()
            n.append(len(words))
            removed = 0
            if spans is not None and len(spans):
                stay = np.ones(len(words), bool)
                for span in spans:
                    stay[span["low"] : span["high"]] = False
                removed = len(words) - int(stay.sum())
                words = [words[i] for i in np.flatnonzero(stay)]
            gone.append(removed)
            digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
        yield pd.DataFrame({"doc_id": frame["doc_id"], "n_words": n, "n_removed": gone, "kept_sha256": digests})


def report(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, n_words, n_removed, kept_sha256) for every row.

    A word goes if it lies in a window of 50 words that also starts in a document of
    smaller doc_id; windows are those of the input. Cases: a null text has no words; texts
    of fewer than 50 words lose none; within one document, and between rows of one id,
    repeats stay; a null doc_id is later than all others; an empty table gives no rows;
    extra columns are ignored.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    joined = _rows(docs).join(repeated_spans(docs), ["id", "body"], "left").select("doc_id", "text", "spans")
    return joined.mapInPandas(_apply, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string")
