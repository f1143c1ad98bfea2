"""Exact distinct counts over any period from daily bitmaps.

Ids become numbers, and each day keeps one bit per number, 32 768 numbers to a bitmap. Days merge by OR
and groups overlap by AND, so a count over any period reads small bitmaps and never the lines again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aisle.functions.listing import in_order, place_of
from aisle.session import cut_lineage


def grow_dictionary(ids: DataFrame, col: str, known: DataFrame | None = None) -> DataFrame:
    """Rows (col, code): known ids keep their numbers, new ones get the next ones without gaps, in order of the ids."""
    fresh = ids.select(col).where(F.col(col).isNotNull()).distinct()
    base = F.lit(0)
    if known is not None:
        known = cut_lineage(known.select(col, "code"), "codes")
        fresh = fresh.join(known, col, "left_anti")
        base = F.lit(known.agg(F.coalesce(F.max("code"), F.lit(0)).alias("n")).first()["n"])
    numbered = place_of(in_order(fresh, [F.col(col)]), "code").select(col, (F.col("code") + base).alias("code"))
    return numbered if known is None else known.unionByName(numbered)


def daily_bitmaps(lines: DataFrame, day: str, keys: list[str], ids: dict[str, DataFrame | None]) -> DataFrame:
    """Rows (day, keys, what, bucket, bits) from one pass over the lines.

    ``ids`` names the columns to count: whole numbers as they are (None), others with their dictionary. A null id sets no bit.
    """
    rows = lines.select(day, *keys, *ids)
    for col, codes in ids.items():
        if codes is not None:
            rows = rows.join(codes.select(col, F.col("code").alias(f"_{col}")), col, "left")
    number = lambda col: F.col(f"_{col}" if ids[col] is not None else col).cast("long")
    each = F.explode(F.array(*[F.struct(F.lit(col).alias("what"), number(col).alias("code")) for col in ids]))
    listed = rows.select(F.col(day).alias("day"), *keys, each.alias("_e")).where(F.col("_e.code").isNotNull())
    return listed.groupBy("day", *keys, F.col("_e.what").alias("what"), F.bitmap_bucket_number("_e.code").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("_e.code")).alias("bits")
    )


def _merged(bitmaps: DataFrame, by: list[Column | str], start: str, end: str) -> DataFrame:
    inside = bitmaps.where(F.col("day").between(F.lit(start), F.lit(end)))
    return inside.groupBy(*by, "what", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def distinct_counts(bitmaps: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Rows (keys, what, n): different ids of a period; keys of the bitmaps that are left out are merged."""
    merged = _merged(bitmaps, keys, start, end)
    return merged.groupBy(*keys, "what").agg(F.sum(F.bitmap_count("bits")).alias("n"))


def overlap_counts(bitmaps: DataFrame, key: str, groups: dict[str, list], what: str, start: str, end: str) -> DataFrame:
    """One row: for each name how many ids are in all of the listed groups in the period."""
    merged = _merged(bitmaps.where(F.col("what") == what), [key], start, end)

    def member_of(name: str, values: list) -> DataFrame:
        some = merged.where(F.col(key).isin(values)).groupBy("bucket").agg(F.bitmap_and_agg("bits").alias("bits"), F.count(F.lit(1)).alias("n"))
        # A group without a bitmap of this bucket has no ids there.
        return some.where(F.col("n") == len(values)).agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).alias(name))

    return reduce(lambda a, b: a.join(F.broadcast(b)), [member_of(n, v) for n, v in groups.items()])
