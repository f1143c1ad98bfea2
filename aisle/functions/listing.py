"""Sorting, top-k, paging, latest rows, global rank and calendar spines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

from aisle.session import cut_lineage

#: Rows that a page may take through one sorted head; deeper pages seek to their range.
SHALLOW = 10_000
#: Place of a row in a table that ``in_order`` wrote: the range in the high bits, the place inside it in the low ones.
PLACE = "_place"
LOW_BITS = 33


def top_k(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def in_order(df: DataFrame, order: list[Column], ranges: int | None = None) -> DataFrame:
    """The rows in order, written as one sorted file for each range of the order, with their ``_place``.

    Ranges are cut by all order columns and at last by a hash of the row, so however many rows share a value, they
    spread over as many tasks as their number asks for. By default there are as many ranges as shuffle partitions.
    """
    ranges = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    plain = [f.name for f in df.schema if not isinstance(f.dataType, (MapType, VariantType))]
    keys = [*order, F.xxhash64(*plain)]
    ranged = df.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys)
    return cut_lineage(ranged.withColumn(PLACE, F.monotonically_increasing_id()), "ordered")


def _range() -> Column:
    return F.shiftright(PLACE, LOW_BITS)


def _range_sizes(rows: DataFrame) -> DataFrame:
    """Rows before each range; one row a range."""
    sizes = rows.groupBy(_range().alias("_range")).agg(F.count(F.lit(1)).alias("_rows"))
    before = F.sum("_rows").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    return sizes.withColumn("_before", F.coalesce(before, F.lit(0)))


def page(df: DataFrame, order: list[Column], page_no: int, size: int) -> DataFrame:
    """One page of rows; ``page_counts`` gives the totals. For many deep pages of one list see ``ordered_page``."""
    if page_no * size <= SHALLOW:
        return df.orderBy(*order).offset((page_no - 1) * size).limit(size)
    return ordered_page(in_order(df, order), page_no, size)


def ordered_page(rows: DataFrame, page_no: int, size: int) -> DataFrame:
    """One page of a table that ``in_order`` wrote: its places are known from the sizes of the ranges, and only files that hold them are read."""
    first, last = (page_no - 1) * size, page_no * size - 1
    spots = {}
    for r in _range_sizes(rows).toLocalIterator():
        for name, at in (("first", first), ("last", last)):
            if r["_before"] <= at < r["_before"] + r["_rows"]:
                spots[name] = (r["_range"] << LOW_BITS) + at - r["_before"]
    if "first" not in spots:
        return rows.where(F.lit(False)).drop(PLACE)
    wanted = rows.where(F.col(PLACE) >= spots["first"])
    if "last" in spots:
        wanted = wanted.where(F.col(PLACE) <= spots["last"])
    return wanted.orderBy(PLACE).drop(PLACE)


def page_counts(df: DataFrame, size: int) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total")).withColumn(
        "total_pages", F.ceil(F.col("total") / F.lit(size))
    )


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Newest row per key as a hash-partitioned max_by with map-side combine, no sort of the key's rows."""
    payload = F.struct(*[F.col(c) for c in df.columns if c not in keys])
    picked = df.groupBy(*keys).agg(F.max_by(payload, F.struct(*order)).alias("_row"))
    return picked.select(*keys, "_row.*").select(*df.columns)


def latest_snapshot(df: DataFrame, date_col: str, keys: list[str] | None = None) -> DataFrame:
    """Rows of the newest snapshot, over the table or per key."""
    if keys:
        newest = df.groupBy(*keys).agg(F.max(date_col).alias(date_col))
        return df.join(newest, [*keys, date_col], "left_semi")
    newest = df.agg(F.max(date_col).alias(date_col))
    return df.join(F.broadcast(newest), date_col, "left_semi")


def prioritised(col: str, order: list[str]) -> Column:
    """Sort key that follows the listed order, unknown values last."""
    key = F.when(F.col(col) == order[0], 0)
    for position, value in enumerate(order[1:], start=1):
        key = key.when(F.col(col) == value, position)
    return key.otherwise(len(order))


def place_of(rows: DataFrame, out: str) -> DataFrame:
    """Position 1..n of each row of a table that ``in_order`` wrote."""
    inside = F.col(PLACE).bitwiseAND((1 << LOW_BITS) - 1)
    # One row a range.
    before = F.broadcast(_range_sizes(rows).select("_range", "_before"))
    counted = rows.withColumn("_range", _range()).join(before, "_range")
    return counted.withColumn(out, (F.col("_before") + inside + 1).cast("long")).drop("_range", "_before", PLACE)


def global_rank(df: DataFrame, value: str, ties: list[str], out: str = "rank", buckets: int | None = None) -> DataFrame:
    """Position 1..n by ``value`` descending, nulls last, ties by the given keys ascending.

    A plain ``row_number()`` without partition keys sorts everything in one task. Here ranges of
    (value, ties) are sorted side by side and shifted by the sizes of the ranges before.
    """
    # The cuts come from a sample, which reads the rows once more: the facts behind them should be scanned once.
    order = [F.col(value).desc_nulls_last(), *[F.col(t).asc() for t in ties]]
    return place_of(in_order(cut_lineage(df, "rank"), order, buckets), out)


def date_spine(df: DataFrame, date_col: str, keys: list[str]) -> DataFrame:
    """Every day between the first and last one seen, per key."""
    span = df.groupBy(*keys).agg(F.min(date_col).alias("_lo"), F.max(date_col).alias("_hi"))
    return span.select(
        *keys, F.explode(F.sequence("_lo", "_hi", F.expr("interval 1 day"))).alias(date_col)
    )


def hour_spine(spark) -> DataFrame:
    return spark.range(24).select(F.col("id").cast("int").alias("hour"))


def with_hours(df: DataFrame) -> DataFrame:
    """Each row repeated for hours 0..23 (a fixed fan-out, no join)."""
    return df.withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(23))))


def with_dow_hours(df: DataFrame) -> DataFrame:
    """Each row repeated for day of week 0..6 and hour 0..23."""
    return df.withColumn("dow", F.explode(F.sequence(F.lit(0), F.lit(6)))).withColumn(
        "hour", F.explode(F.sequence(F.lit(0), F.lit(23)))
    )
