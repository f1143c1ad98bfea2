"""Exact duplicates through counting quotient filters, with a check of the bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aisle.llm import quotient
from aisle.llm.common import SPACE, cut_lineage

#: High bits of a fingerprint that name the block it is merged in. A block of 2**34 documents holds a million fingerprints.
BLOCK_BITS = 14
#: Fingerprints that a task gathers before it hands on a filter; bounds its memory at any partition size.
FILTER_SIZE = 1 << 20


def _filters(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A counting quotient filter of the task's fingerprints, cut into blocks of quotients."""

    def cut(held: list[np.ndarray]) -> pd.DataFrame:
        values, counts = quotient.build(np.concatenate(held))
        blocks, starts = np.unique(values >> np.uint64(64 - BLOCK_BITS), return_index=True)
        stops = [*starts[1:], len(values)]
        packed = [quotient.pack(values[a:b], counts[a:b]) for a, b in zip(starts, stops, strict=True)]
        return pd.DataFrame({"block": blocks.astype(np.int32), "filter": packed})

    held: list[np.ndarray] = []
    for frame in frames:
        held.append(frame["fp"].to_numpy(np.int64).view(np.uint64))
        if sum(map(len, held)) >= FILTER_SIZE:
            yield cut(held)
            held = []
    if any(map(len, held)):
        yield cut(held)


def _repeated(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    """Merge the filters of one block and name the fingerprints that it counts more than once."""
    values, counts = quotient.merge([quotient.unpack(b) for b in frame["filter"]])
    return pd.DataFrame({"fp": values[counts > 1].view(np.int64)})


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """For every row the document that stays in its place.

    Texts are equal when identical after each run of white space becomes one blank. Each
    task counts 64-bit fingerprints in a quotient filter; filters merge per block of
    quotients; rows whose fingerprint is counted once are done. The others are grouped
    by their whole normalised text, so equal fingerprints of different texts part again.
    Copies fold before they are shuffled, so a group of any size is one row a task.

    Cases: a null text counts as empty, and all empty texts are one group; of equal texts
    the smallest doc_id stays, and a null doc_id only where no other is there; each of
    repeated rows gets a row, all ``kept`` when their doc_id is the one that stays; an
    empty table gives no rows; extra columns are ignored. Returns doc_id, keep_id,
    group_size, kept, text_sha256.
    """
    body = F.regexp_replace(F.coalesce("text", F.lit("")), SPACE, " ")
    rows = docs.select("doc_id", body.alias("body")).select("doc_id", "body", F.xxhash64("body").alias("fp"))
    blocks = rows.select("fp").mapInPandas(_filters, "block int, filter binary")
    repeated = cut_lineage(blocks.groupBy("block").applyInPandas(_repeated, "fp long"), "repeated")
    groups = (
        rows.join(repeated, "fp", "left_semi")
        .groupBy("fp", "body")
        .agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select("fp", F.sha2(F.col("body").cast("binary"), 256).alias("text_sha256"), "keep_id", "group_size")
    )
    groups = cut_lineage(groups, "groups")
    hashed = rows.select("doc_id", "fp", F.sha2(F.col("body").cast("binary"), 256).alias("text_sha256"))
    return hashed.join(groups, ["fp", "text_sha256"], "left").select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("group_size").isNull() | F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        "text_sha256",
    )


#: DuckDB text of the same rows.
ORACLE = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
  doc_id IS NOT DISTINCT FROM min(doc_id) OVER (PARTITION BY body) AS kept, sha256(body) AS text_sha256
FROM n
"""
