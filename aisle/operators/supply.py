"""Supplier scorecards, stock-outs, adjustments and purchase orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aisle.functions import ordered
from aisle.functions.listing import latest_per_key, page, top_k
from aisle.functions.scalars import money_sum, round_to, safe_div
from aisle.functions.scope import scope_stores
from aisle.session import deal

ORDER_KEYS = ("order_no", "supplier_id")
ITEMS_PER_BUCKET = 1000


def supplier_scorecard(
    orders: DataFrame,
    order_items: DataFrame,
    price_list: DataFrame,
    suppliers: DataFrame,
    as_of: str,
    days: int = 90,
    store_ids=None,
    order_keys: tuple[str, ...] = ORDER_KEYS,
) -> DataFrame:
    """On-time, fulfilment, quality and cost scores of active suppliers over delivered orders."""
    today = F.lit(as_of).cast("date")
    delivered = scope_stores(orders, store_ids).where(
        (F.col("order_date") >= F.date_sub(today, days)) & (F.col("status") == "delivered")
    )
    late_by = F.datediff("actual_delivery_date", "expected_delivery_date")
    per_order = delivered.groupBy("supplier_id").agg(
        F.count(F.lit(1)).alias("total_orders"),
        F.count_if(late_by <= 0).alias("on_time_deliveries"),
        F.count_if(late_by > 0).alias("late_deliveries"),
        F.avg(F.datediff("actual_delivery_date", "order_date")).alias("avg_lead_time_actual"),
    )
    lines = order_items.join(delivered.select(*order_keys).distinct(), list(order_keys), "left_semi")
    listed = price_list.select("supplier_id", "item_id", F.col("unit_cost").alias("_list"))
    received = F.col("received_quantity")
    variance = F.when(
        F.col("_list") > 0, (F.col("_list") - F.col("unit_cost")) / F.col("_list") * 100
    ).otherwise(0.0)
    per_line = (
        lines.join(listed, ["supplier_id", "item_id"], "left")
        .groupBy("supplier_id")
        .agg(
            F.coalesce(F.sum("quantity"), F.lit(0.0)).cast("long").alias("total_items_ordered"),
            F.coalesce(F.sum(received), F.lit(0.0)).cast("long").alias("total_items_received"),
            F.coalesce(F.sum(F.when(F.col("quality_score") < 60, received)), F.lit(0.0))
            .cast("long")
            .alias("defect_items"),
            F.avg(variance).alias("_variance"),
        )
    )
    counts = ["total_orders", "on_time_deliveries", "late_deliveries", "avg_lead_time_actual"] + [
        "total_items_ordered", "total_items_received", "defect_items", "_variance",
    ]
    board = (
        suppliers.where("is_active")
        .select(F.col("id").alias("supplier_id"), F.col("name").alias("supplier_name"))
        .join(per_order, "supplier_id", "left")
        .join(per_line, "supplier_id", "left")
        .fillna(0, counts)
    )
    got = F.col("total_items_received")
    on_time = safe_div("on_time_deliveries", "total_orders") * 100
    fulfilled = safe_div(got, "total_items_ordered") * 100
    quality = F.when(got > 0, (got - F.col("defect_items")) / got * 100).otherwise(100.0)
    cost = F.greatest(F.lit(0.0), 100 - F.abs("_variance") * 5)
    overall = on_time * 0.30 + fulfilled * 0.25 + quality * 0.25 + cost * 0.20
    return board.select(
        "supplier_id", "supplier_name",
        F.date_sub(today, days).alias("period_start"), today.alias("period_end"),
        *counts[:-1],
        round_to(on_time, 1).alias("on_time_rate"),
        round_to(fulfilled, 1).alias("fulfillment_rate"),
        round_to(quality, 1).alias("quality_score"),
        round_to("_variance", 2).alias("cost_variance_pct"),
        round_to(overall, 1).alias("overall_score"),
        F.when(overall >= 80, "green").when(overall >= 60, "yellow").otherwise("red").alias("health_level"),
    )


def supplier_health(scorecard: DataFrame) -> DataFrame:
    level = lambda name: F.count_if(F.col("health_level") == name).alias(name)
    n = F.count(F.lit(1))
    mean = lambda c: round_to(F.coalesce(F.try_divide(money_sum(c), n), F.lit(0.0)), 1)
    return scorecard.agg(
        n.alias("total_suppliers"), level("green"), level("yellow"), level("red"),
        mean("on_time_rate").alias("avg_on_time_rate"), mean("quality_score").alias("avg_quality_score"),
    )


def supplier_trend(performance: DataFrame, periods: int = 6) -> DataFrame:
    """Stored scores of the newest periods; one row per supplier and period comes in."""
    newest = Window.partitionBy("supplier_id").orderBy(F.desc("period_start"))
    rows = performance.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= periods)
    got = F.col("total_items_received")
    return rows.select(
        "supplier_id",
        "period_start",
        round_to(safe_div("on_time_deliveries", "total_orders") * 100, 1).alias("on_time_rate"),
        round_to(safe_div(got, "total_items_ordered") * 100, 1).alias("fulfillment_rate"),
        round_to(safe_div(got - F.col("defect_items"), got, 1.0) * 100, 1).alias("quality_score"),
        F.coalesce("overall_score", F.lit(0.0)).alias("overall_score"),
    )


def stockout_analysis(inventory: DataFrame, as_of: str, days: int = 30, store_ids=None, top: int = 100) -> DataFrame:
    rows = scope_stores(inventory, store_ids).where(
        F.col("snapshot_date") >= F.date_sub(F.lit(as_of).cast("date"), days)
    )
    empty = F.count_if(F.col("quantity") <= 0)
    per_item = (
        rows.groupBy("store_id", "item_id", "item_name")
        .agg(empty.alias("stockout_days"), F.count(F.lit(1)).alias("total_days"))
        .where(F.col("stockout_days") > 0)
        .withColumn("stockout_rate", round_to(F.col("stockout_days") / F.col("total_days") * 100, 1))
    )
    return top_k(per_item, [F.desc("stockout_rate"), F.asc("store_id"), F.asc("item_id")], top)


def adjustment_advice(
    inventory: DataFrame, sales: DataFrame, as_of: str, stock_days: int = 7, sales_days: int = 30,
    store_ids=None, top: int = 50, per_day: bool = False,
) -> DataFrame:
    """Items at or under 1.2 times their minimum, with action and quantity.

    Velocity is the mean quantity of a sale line; ``per_day`` takes the mean of day totals.
    """
    today = F.lit(as_of).cast("date")
    stock = latest_per_key(
        scope_stores(inventory, store_ids)
        .where(F.col("snapshot_date") >= F.date_sub(today, stock_days))
        .select("store_id", "item_id", "item_name", "quantity", "min_stock", "snapshot_date"),
        ["store_id", "item_id"],
        [F.col("snapshot_date")],
    )
    recent = sales.where(F.col("sale_date") >= F.date_sub(today, sales_days))
    keys = ["store_id", "item_id"]
    if per_day:
        recent = recent.groupBy(*keys, "sale_date").agg(F.sum("quantity").alias("quantity"))
    speed = recent.groupBy(*keys).agg(
        (F.sum("quantity") / F.count(F.lit(1))).alias("_v")
    )
    low = stock.where(F.col("quantity") <= F.col("min_stock") * 1.2).join(speed, keys, "left")
    q, least, v = F.col("quantity"), F.coalesce("min_stock", F.lit(0.0)), F.coalesce("_v", F.lit(0.0))
    whole = lambda c: F.floor(c).cast("double")
    gone, half = q <= 0, q <= least * 0.5
    amount = (
        F.when(gone, F.greatest(least * 2, whole(v * 14)))
        .when(half, F.greatest(least, whole(v * 10)))
        .otherwise(F.greatest(least - q, whole(v * 7)))
    )
    rows = low.select(
        *keys,
        "item_name",
        q.alias("current_stock"),
        F.when(gone, "urgent_replenish").when(half, "replenish").otherwise("monitor").alias("recommended_action"),
        F.greatest(F.lit(1.0), amount).alias("recommended_qty"),
        F.when(gone, "stock is used up").otherwise("stock is below the safe level").alias("reason"),
        round_to(v, 1).alias("daily_use"),
        F.when(gone, "critical").when(half, "high").otherwise("medium").alias("priority"),
        F.try_divide(q, F.col("min_stock")).alias("_ratio"),
    )
    return top_k(rows, [F.asc_nulls_last("_ratio"), F.asc("store_id"), F.asc("item_id")], top).drop("_ratio")


def order_totals(order_items: DataFrame, keys: tuple[str, ...] = ORDER_KEYS) -> DataFrame:
    return order_items.groupBy(*keys).agg(
        money_sum(F.col("quantity") * F.col("unit_cost")).alias("total_amount"),
        F.count(F.lit(1)).alias("total_items"),
    )


def apply_receipts(order_items: DataFrame, receipts: DataFrame, keys: tuple[str, ...] = ("order_no", "item_id")) -> DataFrame:
    """Lines with received quantity and, where given, quality score of the newest receipt."""
    newest = receipts.groupBy(*keys).agg(
        F.max_by(F.struct("received_quantity", "quality_score"), "received_at").alias("_r")
    )
    return (
        order_items.join(newest, list(keys), "left")
        .withColumn(
            "received_quantity",
            F.when(F.col("_r").isNotNull(), F.col("_r.received_quantity")).otherwise(F.col("received_quantity")),
        )
        .withColumn("quality_score", F.coalesce("_r.quality_score", "quality_score"))
        .drop("_r")
    )


def orders_with_items(orders: DataFrame, order_items: DataFrame, keys: tuple[str, ...] = ORDER_KEYS) -> DataFrame:
    """Order header with the number of its lines and the lines as an array: one row per order, however long it is."""
    line = F.struct(*[c for c in order_items.columns if c not in keys])
    nested = deal(order_items, *keys).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("lines"), F.array_sort(F.collect_list(line)).alias("items")
    )
    return orders.join(nested, list(keys), "left").fillna(0, ["lines"])


def order_lines(orders: DataFrame, order_items: DataFrame, keys: tuple[str, ...] = ORDER_KEYS) -> DataFrame:
    """Orders and their lines as flat rows with a number; an order without lines is one row without a number.

    Lines are numbered by item through buckets of items, so a very long order is spread.
    """
    bucketed = order_items.withColumn("_bucket", F.floor(F.col("item_id") / ITEMS_PER_BUCKET))
    numbered = ordered.position(
        deal(bucketed, *keys, "_bucket"), list(keys), "_bucket",
        [F.col(c) for c in ("item_id", *[c for c in order_items.columns if c not in (*keys, "item_id")])], "line_no",
    ).drop("_bucket")
    return orders.join(numbered, list(keys), "left")


def list_adjustments(adjustments: DataFrame, store_ids=None, page_no: int = 1, size: int = 20) -> DataFrame:
    """Stored stock adjustments of the caller's stores, newest first."""
    return page(scope_stores(adjustments, store_ids), [F.desc("created_at"), F.asc("id")], page_no, size)
