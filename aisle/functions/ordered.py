"""Running values over long ordered keys, split by bucket.

A window partitioned by a device, member or store puts every row of that key in
one task. These helpers cut each key's rows into ordered buckets (an hour, a
day), run the window inside (key, bucket), run a second window over one summary
row per bucket, and put the two together. A key that holds a third of the table
is then spread over all its buckets.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _before(keys: list[str], bucket: str):
    return Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)


def running_sum(
    df: DataFrame, keys: list[str], bucket: str, order: list[Column], value: Column, out: str
) -> DataFrame:
    local = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    totals = df.groupBy(*keys, bucket).agg(F.sum(value).alias("_total"))
    carried = totals.select(
        *keys, bucket, F.sum("_total").over(_before(keys, bucket)).alias("_carried")
    )
    zero = F.lit(0)
    return (
        df.withColumn("_local", F.sum(value).over(local))
        .join(carried, [*keys, bucket])
        .withColumn(out, F.coalesce("_local", zero) + F.coalesce("_carried", zero))
        .drop("_local", "_carried")
    )


def lower_totals(
    df: DataFrame, keys: list[str], value: str, amount: str, out: str, ranges: int = 64
) -> DataFrame:
    """Per distinct value of a key, the sum of ``amount`` over strictly lower values.

    Equal values are added up first; approximate cuts of each key's values give the
    buckets, so a key with very many values is spread too.
    """
    fractions = [i / ranges for i in range(1, ranges)]
    summed = df.groupBy(*keys, value).agg(F.sum(amount).alias("_amount"))
    cuts = summed.groupBy(*keys).agg(F.percentile_approx(value, fractions, 10 * ranges).alias("_cuts"))
    ranged = summed.join(cuts, keys).withColumn("_range", F.size(F.filter("_cuts", lambda c: c < F.col(value))))
    upto = running_sum(ranged, keys, "_range", [F.col(value)], F.col("_amount"), "_upto")
    return upto.select(*keys, value, (F.col("_upto") - F.col("_amount")).alias(out))


def position(
    df: DataFrame, keys: list[str], bucket: str, order: list[Column], out: str
) -> DataFrame:
    """Row number 1..n per key."""
    return running_sum(df, keys, bucket, order, F.lit(1).cast("long"), out)


def lag_values(
    df: DataFrame, keys: list[str], bucket: str, order: list[Column], values: dict[str, str]
) -> DataFrame:
    """Previous row's columns per key; ``values`` maps source column to output column."""
    local = Window.partitionBy(*keys, bucket).orderBy(*order)
    payload = F.struct(*[F.col(c) for c in values])
    tails = df.groupBy(*keys, bucket).agg(F.max_by(payload, F.struct(*order)).alias("_tail"))
    carried = tails.select(
        *keys,
        bucket,
        F.lag("_tail").over(Window.partitionBy(*keys).orderBy(bucket)).alias("_carried"),
    )
    out = df.withColumn("_prev", F.lag(payload).over(local)).join(carried, [*keys, bucket])
    out = out.withColumn("_prev", F.coalesce("_prev", "_carried"))
    for source, name in values.items():
        out = out.withColumn(name, F.col("_prev")[source])
    return out.drop("_prev", "_carried")


def newest_rows(
    df: DataFrame, keys: list[str], bucket: str, order: list[Column], n: int, out: str = "position"
) -> DataFrame:
    """The last n rows per key, numbered 1..n from the newest.

    Bucket sizes alone decide which buckets can hold a row of the answer, so only
    those are sorted.
    """
    newer = Window.partitionBy(*keys).orderBy(F.col(bucket).desc()).rowsBetween(
        Window.unboundedPreceding, -1
    )
    sizes = df.groupBy(*keys, bucket).agg(F.count(F.lit(1)).alias("_n"))
    needed = sizes.select(
        *keys, bucket, F.coalesce(F.sum("_n").over(newer), F.lit(0)).alias("_newer")
    ).where(F.col("_newer") < n)
    local = Window.partitionBy(*keys, bucket).orderBy(*order)
    return (
        df.join(needed, [*keys, bucket])
        .withColumn(out, F.row_number().over(local) + F.col("_newer"))
        .where(F.col(out) <= n)
        .drop("_newer")
    )


def _points(values: list[str]) -> dict[str, Column]:
    return {v: F.when(F.col(v).isNotNull(), F.struct(F.col("_lp").alias("p"), F.col(v).alias("v"))) for v in values}


def _line(v: str, prev, following, place: Column) -> Column:
    """The value itself, or the one on the line between the known points (``p``, ``v``) around its place."""
    gap = following["p"] - prev["p"]
    line = prev["v"] + (following["v"] - prev["v"]) * (place - prev["p"]) / gap
    return (
        F.when(F.col(v).isNotNull(), F.col(v))
        .when(prev["p"].isNull(), following["v"])
        .when(following["p"].isNull(), prev["v"])
        .otherwise(line)
    )


def interpolate_whole(
    df: DataFrame, values: list[str], keys: list[str], order: list[Column], deal_by: list[str] | None = None
) -> DataFrame:
    """As ``interpolate``, for keys that one task can hold: every key's rows are one window, and nothing is carried over.

    Rows are dealt by ``deal_by``, some of the keys, so that what follows can group by these without a shuffle.
    """
    keyed = reduce(lambda rows, k: rows.where(F.col(k).isNotNull()), keys, df)
    # The numbers go on from key to key in a task; only distances inside a key are used. Numbering and points share one sort.
    so_far = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    to_come = Window.partitionBy(*keys).orderBy(F.desc("_lp")).rowsBetween(Window.unboundedPreceding, 0)
    rows = keyed.repartition(*(deal_by or keys)).sortWithinPartitions(*keys, *order)
    rows = rows.withColumn("_lp", F.monotonically_increasing_id())
    for side, rows_of in (("prev", so_far), ("next", to_come)):
        known = [F.last(F.when(F.col(v).isNotNull(), F.col("_lp")), True).over(rows_of).alias(f"_{side}_p_{v}") for v in values]
        rows = rows.select("*", *known, *[F.last(v, True).over(rows_of).alias(f"_{side}_v_{v}") for v in values])
    for v in values:
        prev, following = ({"p": F.col(f"_{side}_p_{v}"), "v": F.col(f"_{side}_v_{v}")} for side in ("prev", "next"))
        rows = rows.withColumn(v, _line(v, prev, following, F.col("_lp")))
    return rows.select(*df.columns)


def chunk_numbers(df: DataFrame, keys: list[str], bucket: str, rows: int, out: str) -> DataFrame:
    """Per key and bucket the number of the chunk it lies in: neighbouring buckets with about ``rows`` rows together."""
    sizes = df.groupBy(*keys, bucket).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(_before(keys, bucket)), F.lit(0))
    return sizes.select(*keys, bucket, F.floor(before / F.lit(rows)).alias(out))


def interpolate(
    df: DataFrame, values: list[str], keys: list[str], bucket: str, order: list[Column]
) -> DataFrame:
    """Linear fill of nulls by row position inside each key; the ends take the nearest value.

    Rows are numbered inside their bucket; one summary row per bucket carries the
    offset of the numbering and the nearest known points of the buckets around. Rows without key or bucket
    go in the end; those without bucket still count as the first ones of their key.
    """
    # What the join below asks of the keys stands before both of its sides, so that they can be one shuffle.
    keyed = reduce(lambda rows, k: rows.where(F.col(k).isNotNull()), keys, df)
    rows = keyed.withColumn("_lp", F.row_number().over(Window.partitionBy(*keys, bucket).orderBy(*order)))
    point = _points(values)
    ends = rows.groupBy(*keys, bucket).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.min(point[v]).alias(f"_head_{v}") for v in values],
        *[F.max(point[v]).alias(f"_tail_{v}") for v in values],
    )
    # Looking ahead is a running frame over the reverse order: a frame that ends at
    # "unbounded following" would be evaluated anew for every row.
    before = _before(keys, bucket)
    after = Window.partitionBy(*keys).orderBy(F.col(bucket).desc()).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    placed = lambda c: F.when(
        F.col(c).isNotNull(), F.struct((F.col("_offset") + F.col(c)["p"]).alias("p"), F.col(c)["v"].alias("v"))
    )
    around = ends.select(
        *keys,
        bucket,
        "_offset",
        *[F.last(placed(f"_tail_{v}"), ignorenulls=True).over(before).alias(f"_before_{v}") for v in values],
        *[F.last(placed(f"_head_{v}"), ignorenulls=True).over(after).alias(f"_after_{v}") for v in values],
    )
    local = Window.partitionBy(*keys, bucket)
    so_far = local.orderBy("_lp").rowsBetween(Window.unboundedPreceding, 0)
    to_come = local.orderBy(F.desc("_lp")).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.select(
        "*",
        *[F.last(point[v], True).over(so_far).alias(f"_prev_{v}") for v in values],
        *[F.last(point[v], True).over(to_come).alias(f"_next_{v}") for v in values],
    ).join(around, [*keys, bucket])
    for v in values:
        prev = F.coalesce(placed(f"_prev_{v}"), F.col(f"_before_{v}"))
        following = F.coalesce(placed(f"_next_{v}"), F.col(f"_after_{v}"))
        out = out.withColumn(v, _line(v, prev, following, F.col("_offset") + F.col("_lp")))
    return out.select(*df.columns)
