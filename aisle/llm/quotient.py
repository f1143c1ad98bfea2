"""Counting quotient filter over 64-bit fingerprints, as numpy arrays.

A fingerprint splits into a quotient (its high bits) and a remainder (the low ones).
The filter keeps, per occupied quotient, how many remainders it has, all remainders
in sorted order, and a count beside each one. Quotient and remainder together are
the whole fingerprint, so nothing is lost, and two filters merge by merging their
sorted remainders and adding the counts of equal ones. The remainders of one filter are
sorted within each quotient and quotients ascend, so a filter can be cut at any quotient.
"""

from __future__ import annotations

import struct

import numpy as np

QUOTIENT_BITS = 24
REMAINDER_BITS = 64 - QUOTIENT_BITS
LOW = np.uint64((1 << REMAINDER_BITS) - 1)
SHIFT = np.uint64(REMAINDER_BITS)


def build(fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct fingerprints and their counts."""
    values, counts = np.unique(fingerprints, return_counts=True)
    return values, counts.astype(np.uint64)


def pack(values: np.ndarray, counts: np.ndarray) -> bytes:
    """Occupied quotients, run lengths, remainders in five bytes each; counts over one as an exception list."""
    quotients, starts = np.unique(values >> SHIFT, return_index=True)
    lengths = np.diff(np.append(starts, len(values))).astype("<u4")
    remainders = (values & LOW).astype("<u8").view(np.uint8).reshape(-1, 8)[:, : REMAINDER_BITS // 8]
    many = np.flatnonzero(counts > 1)
    return b"".join(
        [
            struct.pack("<3Q", len(quotients), len(values), len(many)),
            quotients.astype("<u4").tobytes(), lengths.tobytes(), remainders.tobytes(),
            many.astype("<u4").tobytes(), counts[many].astype("<u8").tobytes(),
        ]
    )


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    q, n, m = struct.unpack_from("<3Q", blob)
    at = 24
    quotients = np.frombuffer(blob, "<u4", q, at)
    lengths = np.frombuffer(blob, "<u4", q, at := at + 4 * q)
    width = REMAINDER_BITS // 8
    raw = np.frombuffer(blob, np.uint8, n * width, at := at + 4 * q).reshape(-1, width)
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :width] = raw
    values = (np.repeat(quotients.astype(np.uint64), lengths) << SHIFT) | wide.view("<u8").ravel()
    counts = np.ones(n, np.uint64)
    many = np.frombuffer(blob, "<u4", m, at := at + n * width)
    counts[many] = np.frombuffer(blob, "<u8", m, at + 4 * m)
    return values, counts


def merge(filters: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """One filter that counts what all of them count together."""
    values = np.concatenate([v for v, _ in filters])
    counts = np.concatenate([c for _, c in filters])
    order = np.argsort(values, kind="stable")
    values, counts = values[order], counts[order]
    if not len(values):
        return values, counts
    starts = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
    return values[starts], np.add.reduceat(counts, starts)
