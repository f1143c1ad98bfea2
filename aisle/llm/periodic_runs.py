"""Periodic runs of words: harmonic grids of places, extended both ways by difference-cover extensions.

For each period q the places 0, q, 2q, ... of a text form a grid; a run of period q and
twice its length holds two neighbours of it, so comparing grid neighbours and extending
those that are alike finds every run, with n/1 + n/2 + n/3 + ... comparisons for n words. Texts are
handled many at a time, one after the other with ends that nothing equals. Each text is
one row of one task; work and memory are bounded by a number of words a batch, or by the one
text that is longer, whose grid is walked in pieces.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aisle.llm.lce import Extensions

LEAST = 12
#: Words of texts that are handled together.
BATCH_WORDS = 40_000
#: Pairs of grid neighbours that are compared at a time.
PAIRS = 1 << 20


def planted(doc_id: int, n: int) -> np.ndarray:
    """Which original word stands at each place: of one id in ten, by its checksum, the end repeats its first words."""
    at = np.arange(n)
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        at[a:] = a + np.arange(n - a) % p
    return at


def _grids(starts: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pieces of (place, period) rows: the grid of every period up to half of each text."""
    text = np.repeat(np.arange(len(lengths)), lengths // 2)
    first = np.cumsum(lengths // 2) - lengths // 2
    period = np.arange(len(text)) - first[text] + 1
    counts = (lengths[text] - 1) // period
    ends = np.cumsum(counts)
    cut = 0
    while cut < len(text):
        stop = max(cut + 1, int(np.searchsorted(ends, (ends[cut - 1] if cut else 0) + PAIRS, side="right")))
        some = counts[cut:stop]
        q = np.repeat(period[cut:stop], some)
        step = np.arange(len(q)) - np.repeat(np.cumsum(some) - some, some)
        yield np.repeat(starts[text[cut:stop]], some) + step * q, q
        cut = stop


def find_runs(symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All runs as rows (start, length, period), by start and period, of texts inside ``symbols``.

    Each text is followed by a symbol that stands nowhere else.
    """
    n = len(symbols)
    rows = np.empty((0, 3), np.int64)
    ahead = back = None
    for i, q in _grids(starts, lengths):
        same = symbols[i] == symbols[i + q]
        if not same.any():
            continue
        if ahead is None:
            ahead, back = Extensions(symbols), Extensions(symbols[::-1])
        i, q = i[same], q[same]
        right, left = ahead.of(i, i + q), np.zeros(len(i), np.int64)
        inside = i > 0
        left[inside] = back.of(n - i[inside], n - i[inside] - q[inside])
        long = left + right + q >= np.maximum(LEAST, 2 * q)
        new = np.stack([i - left, left + right + q, q], 1)[long]
        # Multiples of a period span the same stretch; the smallest one is its period.
        rows = np.concatenate([rows, new])
        rows = rows[np.lexsort(rows.T[[2, 1, 0]])]
        if len(rows):
            rows = rows[np.append(True, (rows[1:, :2] != rows[:-1, :2]).any(1))]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def _described(texts: list[tuple[int | None, list[bytes]]]) -> list[tuple]:
    """Runs and digests of each text, of its planted form where the id asks for one."""
    names: dict[bytes, int] = {}
    places = [planted(d, len(words)) if d is not None else np.arange(len(words)) for d, words in texts]
    lengths = np.array([len(words) for _, words in texts], np.int64)
    starts = np.cumsum(lengths + 1) - lengths - 1
    symbols = np.zeros(int(lengths.sum()) + len(texts), np.int64)
    for (_, words), at, start in zip(texts, places, starts.tolist(), strict=True):
        symbols[start : start + len(words)] = np.array([names.setdefault(w, len(names)) for w in words], np.int64)[at] if words else 0
    symbols[starts + lengths] = len(names) + np.arange(len(texts))
    rows = find_runs(symbols, starts, lengths)
    bounds = np.searchsorted(rows[:, 0], np.append(starts, len(symbols)))
    out = []
    for k, (_, words) in enumerate(texts):
        own = rows[bounds[k] : bounds[k + 1]]
        own = own - [starts[k], 0, 0]
        best, at = (None,) * 4, places[k]
        listed = b""
        if len(own):
            start, length, period = own[np.lexsort((own[:, 2], own[:, 0], -own[:, 1]))[0]].tolist()
            best = (start, length, period, 1000 * length // period)
            listed = "".join(f"{a},{b},{c}\n" for a, b, c in own.tolist()).encode()
            gone = np.zeros(len(at) + 1, np.int64)
            np.add.at(gone, own[:, 0] + own[:, 2], 1)
            np.add.at(gone, own[:, 0] + own[:, 1], -1)
            at = at[np.cumsum(gone)[:-1] == 0]
        kept = b" ".join([words[i] for i in at.tolist()])
        out.append((len(own), *best, hashlib.sha256(listed).hexdigest(), hashlib.sha256(kept).hexdigest(), own))
    return out


COLUMNS = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[tuple]]]:
    for batch in batches:
        held, size = [], 0
        for d, t in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
            words = t.as_buffer().to_pybytes().split() if t.is_valid else []
            if held and size + len(words) > BATCH_WORDS:
                yield [h[0] for h in held], _described(held)
                held, size = [], 0
            held.append((d, words))
            size += len(words)
        if held:
            yield [h[0] for h in held], _described(held)


def _report(kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, rows in _batches(batches):
            columns = list(zip(*rows, strict=True))
            types = [pa.int64()] * 5 + [pa.string()] * 2
            arrays = [pa.array(c, t) for c, t in zip(columns[:7], types, strict=True)]
            yield pa.record_batch([pa.array(ids, kind), *arrays], ["doc_id", *COLUMNS])

    return run


def _spans(kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, rows in _batches(batches):
            of = [d for d, r in zip(ids, rows, strict=True) for _ in range(len(r[7]))]
            every = np.concatenate([r[7] for r in rows])
            yield pa.record_batch([pa.array(of, kind), *[pa.array(c) for c in every.T.copy()]], ["doc_id", "start", "length", "period"])

    return run


def _rows(docs: DataFrame) -> tuple[DataFrame, str, pa.DataType]:
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    name = rows.schema["doc_id"].dataType.simpleString()
    return rows, name, {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}[name]


def runs_of(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, start, length, period) of every run of every text, cases as in ``report``."""
    rows, name, kind = _rows(docs)
    return rows.mapInArrow(_spans(kind), f"doc_id {name}, start long, length long, period long")


def report(docs: DataFrame) -> DataFrame:
    """Number of runs, longest run and digests of every row.

    A run is a stretch of words of smallest period q, at least twice as long and of at least
    twelve words, that cannot be extended. Rows (doc_id, n_runs, start, length, period,
    exponent_milli, runs_sha256, collapsed_sha256). Of one id in ten, by the checksum of its
    decimal form, the end of the text is first replaced by repeats. Of runs of equal length the
    first, then the one of smaller period is named; without a run the four numbers are null.

    Cases: a null text and one without words have no run and digests of nothing; a null
    doc_id keeps its text as it is; each of repeated rows gets its row; an empty table gives no
    rows; extra columns are ignored. doc_id is a whole number or a string.
    """
    rows, name, kind = _rows(docs)
    numbers = ", ".join(f"{c} long" for c in COLUMNS[:5])
    return rows.mapInArrow(_report(kind), f"doc_id {name}, {numbers}, runs_sha256 string, collapsed_sha256 string")
