"""Sales and stock anomalies."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aisle.functions.listing import latest_snapshot
from aisle.functions.scalars import money_sum, round_to
from aisle.functions.scope import scope_stores
from aisle.functions.stats import bounded_quantiles
from aisle.session import cut_lineage

MIN_DAYS = 7


def daily_sales(sales: DataFrame, keys: tuple[str, ...] = ("store_id",)) -> DataFrame:
    return sales.groupBy(*keys, "sale_date").agg(money_sum("total_amount").alias("daily_sales"))


def iqr_anomalies(daily: DataFrame, by: str = "store_id", value: str = "daily_sales") -> DataFrame:
    """Days outside the 1.5 IQR fences of their own store; stores under seven days are left out.

    The input holds one row per key and day, so a key's distinct values are bounded by its days.
    """
    peers = Window.partitionBy(by)
    v = F.col(value)
    q1, median, q3 = (F.col("_q")[i] for i in range(3))
    fenced = (
        daily.withColumn("_n", F.count(F.lit(1)).over(peers))
        .withColumn("_q", bounded_quantiles(value, [0.25, 0.5, 0.75]).over(peers))
        .where(F.col("_n") >= MIN_DAYS)
        .withColumn("_iqr", q3 - q1)
        .withColumn("_low", q1 - F.col("_iqr") * 1.5)
        .withColumn("_high", q3 + F.col("_iqr") * 1.5)
        .where((v < F.col("_low")) | (v > F.col("_high")))
        .withColumn("_dev", (v - median) / F.greatest(F.col("_iqr"), F.lit(1.0)))
    )
    return fenced.select(
        by,
        F.col("sale_date").alias("date"),
        F.lit("sales_anomaly").alias("type"),
        F.lit("IQR").alias("method"),
        round_to(v, 2).alias("value"),
        round_to("_low", 2).alias("expected_low"),
        round_to("_high", 2).alias("expected_high"),
        round_to("_dev", 2).alias("deviation"),
        F.when(F.abs("_dev") > 3, "high").otherwise("medium").alias("severity"),
        round_to(F.abs("_dev"), 2).alias("severity_score"),
        F.when(v > F.col("_high"), "above").otherwise("below").alias("direction"),
    )


def yoy_anomalies(daily: DataFrame, start: str, end: str, by: str = "store_id") -> DataFrame:
    """Days that differ by more than half from the same day a year before."""
    current = daily.where(F.col("sale_date").between(F.lit(start), F.lit(end)))
    lower = F.add_months(F.lit(start).cast("date"), -12)
    upper = F.add_months(F.lit(end).cast("date"), -12)
    before = daily.where(F.col("sale_date").between(lower, upper)).select(
        by, F.add_months("sale_date", 12).alias("sale_date"), F.col("daily_sales").alias("_before")
    )
    change = F.try_divide(F.col("daily_sales") - F.col("_before"), F.col("_before"))
    pct = change * 100
    return (
        current.join(before, [by, "sale_date"])
        .where(F.abs(change) > 0.5)
        .select(
            by,
            F.col("sale_date").alias("date"),
            F.lit("yoy_deviation").alias("type"),
            F.lit("YoY").alias("method"),
            round_to("daily_sales", 2).alias("value"),
            round_to("_before", 2).alias("last_year_value"),
            round_to(pct, 1).alias("yoy_change_pct"),
            F.when(F.abs(pct) > 100, "high").otherwise("medium").alias("severity"),
            round_to(F.abs(pct) / 50, 2).alias("severity_score"),
            F.when(pct > 0, "above").otherwise("below").alias("direction"),
        )
    )


def stock_threshold_anomalies(inventory: DataFrame) -> DataFrame:
    """Stock outside [min, max] at the newest snapshot of the table."""
    q = F.col("quantity")
    low = F.coalesce("min_stock", F.lit(0.0))
    high = F.col("max_stock")
    out = latest_snapshot(inventory, "snapshot_date").where(
        (q < F.col("min_stock")) | (high.isNotNull() & (q > high))
    )
    score = F.when(q < low, (low - q) / F.greatest(low, F.lit(1.0))).otherwise(
        F.when(F.coalesce(high, F.lit(0.0)) != 0, (q - high) / F.greatest(high, F.lit(1.0))).otherwise(0.0)
    )
    return out.withColumn("_score", score).select(
        "store_id",
        "item_id",
        "item_name",
        F.col("snapshot_date").alias("date"),
        F.lit("inventory_anomaly").alias("type"),
        F.lit("threshold").alias("method"),
        round_to(q, 2).alias("quantity"),
        round_to(low, 2).alias("min_stock"),
        round_to(high, 2).alias("max_stock"),
        F.when(F.col("_score") > 0.5, "high").otherwise("medium").alias("severity"),
        round_to("_score", 2).alias("severity_score"),
        F.when(q < low, "below_min").otherwise("above_max").alias("direction"),
    )


def anomaly_feed(
    sales: DataFrame, stores: DataFrame, inventory: DataFrame, start: str, end: str, store_ids=None, top: int = 50
) -> DataFrame:
    """The strongest anomalies of all kinds, with the count of all of them beside."""
    year_back = date.fromisoformat(start).replace(day=1)
    since = f"{year_back.year - 1}-{year_back.month:02d}-01"
    daily = daily_sales(
        scope_stores(sales, store_ids).where(F.col("sale_date").between(F.lit(since), F.lit(end)))
    )
    period = daily.where(F.col("sale_date").between(F.lit(start), F.lit(end)))
    merged = (
        iqr_anomalies(period)
        .unionByName(yoy_anomalies(daily, start, end), allowMissingColumns=True)
        .unionByName(
            stock_threshold_anomalies(scope_stores(inventory, store_ids)), allowMissingColumns=True
        )
    )
    merged = cut_lineage(merged, "anomalies")
    total = merged.agg(F.count(F.lit(1)).alias("total_anomalies"))
    worst = merged.orderBy(
        F.desc("severity_score"), "type", "store_id", "date", F.asc_nulls_first("item_id")
    ).limit(top)
    return (
        worst.join(F.broadcast(total))
        .join(stores.select(F.col("id").alias("store_id"), F.col("name").alias("store_name")), "store_id", "left")
    )
