"""Store KPIs, ranking, gaps and report tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aisle.functions.listing import global_rank
from aisle.functions.scalars import UNITS, metric_expr, money_sum, money_units, round_to, safe_div
from aisle.functions.scope import between_dates, scope_stores
from aisle.session import deal


def kpi_summary(
    sales: DataFrame, stores: DataFrame, start: str, end: str, store_ids=None, receipt_key=("receipt_no",)
) -> DataFrame:
    """One row of chain KPIs for a closed date range.

    ``receipt_key=("store_id", "receipt_no")`` counts equal numbers of two stores apart.
    """
    days = (date.fromisoformat(end) - date.fromisoformat(start)).days + 1
    lines = scope_stores(between_dates(sales, "sale_date", start, end), store_ids)
    # Lines fold to receipts first, so the distinct counts expand receipts and not lines.
    receipts = deal(lines, *receipt_key).groupBy(*dict.fromkeys([*receipt_key, "store_id", "member_id"])).agg(
        F.sum(money_units("total_amount")).alias("_g"), F.sum(money_units("discount_amount")).alias("_d")
    )
    total = lambda c: F.coalesce(F.sum(c).cast("double") / UNITS, F.lit(0.0))
    facts = receipts.agg(
        total("_g").alias("_gmv"),
        F.countDistinct(*receipt_key).alias("total_orders"),
        F.countDistinct("store_id").alias("active_stores"),
        F.countDistinct("member_id").alias("active_members"),
        total("_d").alias("_discount"),
    )
    area = scope_stores(stores.where("is_active"), store_ids, "id").agg(
        F.greatest(F.coalesce(F.sum("area_sqm"), F.lit(1.0)), F.lit(1.0)).alias("_area")
    )
    gmv = F.col("_gmv")
    return facts.join(F.broadcast(area)).select(
        round_to(gmv, 2).alias("gmv"),
        "total_orders",
        round_to(safe_div(gmv, "total_orders"), 2).alias("avg_ticket"),
        "active_stores",
        "active_members",
        round_to("_discount", 2).alias("total_discount"),
        round_to(gmv / F.lit(float(max(days, 1))), 2).alias("daily_avg_gmv"),
        round_to(gmv / F.col("_area"), 2).alias("sqm_efficiency"),
        F.lit(days).alias("period_days"),
    )


def store_ranking(
    sales: DataFrame, stores: DataFrame, start: str, end: str, metric: str = "gmv", store_ids=None
) -> DataFrame:
    """Stores by gmv, orders or avg_ticket; sales are aggregated before stores are joined."""
    lines = scope_stores(between_dates(sales, "sale_date", start, end), store_ids)
    per_store = lines.groupBy("store_id").agg(
        money_sum("total_amount").alias("_gmv"), F.countDistinct("receipt_no").alias("orders")
    )
    value = metric_expr(
        metric,
        {
            "gmv": F.col("_gmv"),
            "orders": F.col("orders").cast("double"),
            "avg_ticket": safe_div("_gmv", "orders"),
        },
        "gmv",
    )
    named = per_store.join(stores, F.col("store_id") == F.col("id")).select(
        "store_id",
        F.col("code").alias("store_code"),
        F.col("name").alias("store_name"),
        "city",
        value.alias("_value"),
        round_to("_gmv", 2).alias("gmv"),
        "orders",
    )
    return global_rank(named, "_value", ["store_id"]).select(
        "rank", "store_id", "store_code", "store_name", "city",
        round_to("_value", 2).alias("metric_value"), "gmv", "orders",
    )


def missing_periods(df: DataFrame, date_col: str, keys: list[str]) -> DataFrame:
    """Runs of days without rows between the first and last day of each key.

    The gap sits between two neighbouring days that exist, so a lead over the
    distinct days finds it without building the calendar.
    """
    days = df.select(*keys, date_col).distinct()
    following = F.lead(date_col).over(Window.partitionBy(*keys).orderBy(date_col))
    return (
        days.withColumn("_next", following)
        .withColumn("days", F.datediff("_next", date_col) - 1)
        .where(F.col("days") > 0)
        .select(
            *keys,
            F.date_add(date_col, 1).alias("gap_start"),
            F.date_sub("_next", 1).alias("gap_end"),
            "days",
        )
    )


def missing_period_log(gaps: DataFrame, data_type: str, as_of: str) -> DataFrame:
    """Gap rows in the shape of the quality log table."""
    return gaps.select(
        "store_id",
        F.lit(data_type).alias("data_type"),
        F.col("gap_start").alias("missing_start"),
        F.col("gap_end").alias("missing_end"),
        F.col("days").alias("missing_count"),
        F.lit(as_of).cast("date").alias("detected_at"),
    )


def report_sales_summary(sales: DataFrame, stores: DataFrame, start: str, end: str, store_ids=None) -> DataFrame:
    lines = scope_stores(between_dates(sales, "sale_date", start, end), store_ids)
    daily = lines.groupBy("store_id", "sale_date").agg(
        F.countDistinct("receipt_no").alias("orders"), money_sum("total_amount").alias("_gmv")
    )
    return daily.join(stores, F.col("store_id") == F.col("id")).select(
        F.col("name").alias("store_name"),
        "sale_date",
        "orders",
        round_to("_gmv", 2).alias("gmv"),
        round_to(safe_div("_gmv", "orders"), 2).alias("avg_ticket"),
    )


def report_inventory_status(inventory: DataFrame, stores: DataFrame, start: str, end: str, store_ids=None) -> DataFrame:
    rows = scope_stores(between_dates(inventory, "snapshot_date", start, end), store_ids)
    return rows.join(stores.select("id", F.col("name").alias("store_name")), F.col("store_id") == F.col("id")).select(
        "store_name", "item_id", "item_name", "category", "quantity", "min_stock", "max_stock", "snapshot_date"
    )


def report_daily_gmv(sales: DataFrame, stores: DataFrame, start: str, end: str, store_ids=None) -> DataFrame:
    lines = scope_stores(between_dates(sales, "sale_date", start, end), store_ids)
    daily = lines.groupBy("store_id", "sale_date").agg(money_sum("total_amount").alias("_gmv"))
    return daily.join(stores, F.col("store_id") == F.col("id")).select(
        F.col("name").alias("store_name"), "sale_date", round_to("_gmv", 2).alias("gmv")
    )
