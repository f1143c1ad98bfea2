"""Reorder points, order quantities and supplier minimums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aisle.functions.listing import latest_per_key, page, top_k
from aisle.functions.scalars import money_sum, round_to
from aisle.functions.scope import scope_stores
from aisle.functions.stats import normal_quantile

KEYS = ["store_id", "item_id"]
# Settings of an item without its own row, and cost assumptions.
DEFAULTS = {
    "service_level": 0.95,
    "review_period_days": 7,
    "max_stock_days": 30,
    "weather_sensitivity": 0.1,
    "promo_boost_factor": 1.3,
}
NO_SUPPLIER = {"lead_time_days": 7, "unit_cost": 10.0, "moq": 1, "packaging_unit": 1}
ORDER_COST = 50.0
HOLDING_RATE = 0.25


def demand_stats(sales: DataFrame, as_of: str, days: int = 60) -> DataFrame:
    """Mean and sample deviation of daily quantity per store and item."""
    recent = sales.where(F.col("sale_date") >= F.date_sub(F.lit(as_of).cast("date"), days))
    daily = recent.groupBy(*KEYS, "sale_date").agg(F.sum("quantity").alias("_q"))
    spread = F.stddev_samp("_q")
    return daily.groupBy(*KEYS).agg(
        (F.sum("_q") / F.count(F.lit(1))).alias("velocity"),
        F.when(spread > 0, spread).otherwise(1.0).alias("demand_std"),
    )


def primary_supplier(supplier_items: DataFrame, suppliers: DataFrame, tiers: DataFrame | None = None) -> DataFrame:
    """The active supplier of each item: primary ones first, then lowest id; with its discount tiers."""
    active = suppliers.where("is_active").select(
        F.col("id").alias("supplier_id"), F.col("name").alias("supplier_name"), "lead_time_days", "min_order_qty"
    )
    offers = supplier_items.join(active, "supplier_id")
    chosen = latest_per_key(offers, ["item_id"], [F.col("is_primary").cast("int"), -F.col("supplier_id")])
    if tiers is None:
        return chosen
    steps = (
        tiers.join(chosen.select("supplier_id", "item_id"), ["supplier_id", "item_id"], "left_semi")
        .groupBy("supplier_id", "item_id")
        .agg(F.array_sort(F.collect_list(F.struct("min_qty", "discount_rate", "tier_price"))).alias("tiers"))
    )
    return chosen.join(steps, ["supplier_id", "item_id"], "left")


def demand_adjustment(
    pairs: DataFrame, promotions: DataFrame, weather: DataFrame, stores: DataFrame, as_of: str
) -> DataFrame:
    """Whether a promotion touches the next 14 days, and whether the coming week is wet, per store and item."""
    today = F.lit(as_of).cast("date")
    running = promotions.where(
        (F.col("status") == "active")
        & (F.col("start_date") <= F.date_add(today, 14))
        & (F.col("end_date") >= today)
    )
    # A store runs few promotions at a time; their targets travel as one small array.
    targets = running.groupBy("store_id").agg(
        F.bool_or(F.col("target_items").isNull()).alias("_all"),
        F.collect_set("target_items").alias("_targets"),
    )
    wet_cities = (
        weather.where(F.col("weather_date").between(today, F.date_add(today, 7)))
        .groupBy("city")
        .agg((F.avg("precipitation") > 10).alias("wet"))
    )
    wet = stores.join(wet_cities, "city").select(F.col("id").alias("store_id"), "wet")
    item = F.col("item_id").cast("string")
    named = F.exists("_targets", lambda target: F.contains(target, item))
    return (
        pairs.join(targets, "store_id", "left")
        .join(wet, "store_id", "left")
        .select(
            *KEYS,
            F.coalesce(F.col("_all") | named, F.lit(False)).alias("promoted"),
            F.coalesce("wet", F.lit(False)).alias("wet"),
        )
    )


def reorder_points(
    inventory: DataFrame, sales: DataFrame, supply: DataFrame, configs: DataFrame, adjustment: DataFrame | None,
    as_of: str, days: int = 60,
) -> DataFrame:
    """Latest stock with adjusted demand, safety stock and reorder point for every store and item."""
    stock = latest_per_key(
        inventory.select(*KEYS, "item_name", "quantity", "min_stock", "snapshot_date"), KEYS, [F.col("snapshot_date")]
    )
    offer = supply.select(
        "item_id", "supplier_id", "lead_time_days", "unit_cost", "moq", "packaging_unit", "min_order_qty", "tiers"
    )
    rows = (
        stock.join(demand_stats(sales, as_of, days), KEYS, "left")
        .join(configs, KEYS, "left")
        .join(offer, "item_id", "left")
    )
    if adjustment is not None:
        rows = rows.join(adjustment, KEYS, "left")
    else:
        rows = rows.withColumn("promoted", F.lit(False)).withColumn("wet", F.lit(False))
    for name, value in {**DEFAULTS, **NO_SUPPLIER}.items():
        rows = rows.withColumn(name, F.coalesce(F.col(name), F.lit(value)))
    rows = rows.withColumn("z", normal_quantile(F.col("service_level")))
    boost = F.when(F.col("promoted"), F.col("promo_boost_factor")).otherwise(1.0)
    damping = F.when(F.col("wet"), 1.0 - F.col("weather_sensitivity")).otherwise(1.0)
    horizon = F.sqrt((F.col("lead_time_days") + F.col("review_period_days")).cast("double"))
    buffer = F.ceil(F.col("z") * F.coalesce("demand_std", F.lit(1.0)) * horizon).cast("double")
    return (
        rows.withColumn("velocity", F.coalesce("velocity", F.lit(0.0)) * boost * damping)
        .withColumn("current_stock", F.coalesce("quantity", F.lit(0.0)))
        .withColumn("safety_stock", F.greatest(buffer, F.coalesce("min_stock", F.lit(0.0))))
        .withColumn(
            "reorder_point",
            F.ceil(F.col("velocity") * F.col("lead_time_days") + F.col("safety_stock")).cast("double"),
        )
        .drop("z", "demand_std", "promoted", "wet", "quantity", "min_stock", "snapshot_date")
    )


def _packs(quantity: Column, pack: Column) -> Column:
    return F.when(pack > 1, F.ceil(quantity / pack) * pack).otherwise(quantity).cast("double")


def _tier_cost(tier: Column, unit_cost: Column) -> Column:
    fixed = F.nullif(tier["tier_price"], F.lit(0.0))
    return F.coalesce(fixed, unit_cost * (1 - tier["discount_rate"]))


def order_quantities(points: DataFrame, as_of: str) -> DataFrame:
    """Order suggestions for items at or under their reorder point.

    Economic quantity, minimum, pack size, step up to the next discount tier when
    it costs little more, cap by stock days, minimum and pack size again.
    """
    v, cost = F.col("velocity"), F.col("unit_cost")
    moq, pack = F.col("moq").cast("double"), F.col("packaging_unit").cast("double")
    stock = F.col("current_stock")
    due = points.where(stock <= F.col("reorder_point"))

    yearly, holding = v * 365, cost * HOLDING_RATE
    top_stock = F.floor(v * F.col("max_stock_days")).cast("double")
    economic = F.when(
        (holding > 0) & (yearly > 0), F.ceil(F.sqrt(yearly * 2 * ORDER_COST / holding)).cast("double")
    ).otherwise(top_stock)
    sized = due.withColumn("_q", _packs(F.greatest(economic, moq), pack))

    q = F.col("_q")
    reached = F.filter("tiers", lambda t: t["min_qty"] <= q)
    ahead = F.filter("tiers", lambda t: t["min_qty"] > q)
    sized = sized.withColumn("_now", F.try_element_at(reached, F.lit(-1))).withColumn(
        "_next", F.try_element_at(ahead, F.lit(1))
    )
    now, nxt = F.col("_now"), F.col("_next")
    next_q = (F.ceil(nxt["min_qty"] / pack) * pack).cast("double")
    next_cost = next_q * _tier_cost(nxt, cost)
    limit = F.when(now.isNotNull(), q * _tier_cost(now, cost) * 1.05).otherwise(q * cost * 1.1)
    sized = sized.withColumn("_up", nxt.isNotNull() & (next_cost <= limit))
    tier = F.when(F.col("_up"), nxt).otherwise(now)
    sized = (
        sized.withColumn("_tier", tier)
        .withColumn("_q", F.when(F.col("_up"), next_q).otherwise(q))
        .withColumn("_price", F.when(F.col("_tier").isNotNull(), _tier_cost(F.col("_tier"), cost)).otherwise(cost))
    )
    capped = F.greatest(F.least(q, F.greatest(top_stock - stock, moq)), moq)
    sized = sized.withColumn("suggested_qty", _packs(capped, pack))
    spare = (stock - F.col("safety_stock")) / v
    days_left = F.when(v > 0, spare.cast("int")).otherwise(999)
    return sized.select(
        *KEYS,
        "item_name",
        "supplier_id",
        "current_stock",
        "safety_stock",
        "reorder_point",
        "suggested_qty",
        F.date_add(
            F.lit(as_of).cast("date"), F.greatest(F.lit(0), days_left - F.col("lead_time_days")).cast("int")
        ).alias("optimal_order_date"),
        round_to(F.col("suggested_qty") * F.col("_price"), 2).alias("estimated_cost"),
        F.col("_tier").isNotNull().cast("int").alias("bulk_discount_applied"),
        round_to(v, 2).alias("demand_velocity"),
        F.lit("pending").alias("status"),
        "packaging_unit",
        "min_order_qty",
    )


def enforce_supplier_moq(suggestions: DataFrame) -> DataFrame:
    """Raise the last item of a store and supplier whose suggestions stay under the supplier's minimum."""
    group = ["store_id", "supplier_id"]
    totals = (
        suggestions.where(F.col("supplier_id").isNotNull())
        .groupBy(*group)
        .agg(
            F.sum("suggested_qty").alias("_sum"),
            F.max("item_id").alias("item_id"),
            F.max("min_order_qty").alias("_min"),
        )
        .where((F.coalesce("_min", F.lit(0.0)) > 0) & (F.col("_sum") < F.col("_min")))
        .select(*group, "item_id", (F.col("_min") - F.col("_sum")).alias("_deficit"))
    )
    pack = F.col("packaging_unit").cast("double")
    added = F.ceil(F.col("_deficit") / pack) * pack
    raised = F.col("suggested_qty") + added
    return (
        suggestions.join(totals, [*group, "item_id"], "left")
        .withColumn(
            "estimated_cost",
            F.when(
                F.col("_deficit").isNotNull(),
                round_to(raised * (F.col("estimated_cost") / F.col("suggested_qty")), 2),
            ).otherwise(F.col("estimated_cost")),
        )
        .withColumn("suggested_qty", F.when(F.col("_deficit").isNotNull(), raised).otherwise(F.col("suggested_qty")).cast("double"))
        .select(*[c for c in suggestions.columns if c not in ("packaging_unit", "min_order_qty")])
    )


def coverage(inventory: DataFrame, store_ids=None) -> DataFrame:
    latest = latest_per_key(
        scope_stores(inventory, store_ids).select(*KEYS, "quantity", "min_stock", "snapshot_date"),
        KEYS, [F.col("snapshot_date")],
    )
    n = F.count(F.lit(1))
    good = F.count_if(F.col("quantity") > F.col("min_stock"))
    return latest.agg(
        n.alias("total_items"),
        good.alias("covered_items"),
        round_to(F.coalesce(F.try_divide(good, n), F.lit(0.0)) * 100, 1).alias("coverage_rate"),
    )


def replenishment_dashboard(suggestions: DataFrame, inventory: DataFrame, store_ids=None) -> DataFrame:
    waiting = F.col("status") == "pending"
    counts = scope_stores(suggestions, store_ids).agg(
        F.count_if(F.col("current_stock") <= 0).alias("items_below_rop"),
        F.coalesce(money_sum(F.when(waiting, F.col("estimated_cost"))), F.lit(0.0)).alias("pending_orders_value"),
        F.count_if(waiting).alias("pending_count"),
        F.count_if(F.col("status") == "approved").alias("approved_count"),
    )
    return counts.join(F.broadcast(coverage(inventory, store_ids).select("coverage_rate")))


def replenishment_timeline(suggestions: DataFrame, suppliers: DataFrame, limit: int = 20) -> DataFrame:
    lead = suppliers.select(F.col("id").alias("supplier_id"), "lead_time_days")
    speed = F.coalesce("demand_velocity", F.lit(0.0))
    rows = (
        suggestions.where(F.col("status") == "pending")
        .join(lead, "supplier_id", "left")
        .select(
            *KEYS, "item_name", "current_stock", speed.alias("daily_consumption"),
            F.when(speed > 0, (F.col("current_stock") / speed).cast("int")).otherwise(999).alias("days_until_stockout"),
            "optimal_order_date",
            F.date_add("optimal_order_date", F.coalesce("lead_time_days", F.lit(7))).alias("expected_delivery"),
            "suggested_qty",
        )
    )
    return top_k(rows, [F.asc("optimal_order_date"), F.asc("store_id"), F.asc("item_id")], limit)


def list_suggestions(suggestions: DataFrame, suppliers: DataFrame, page_no: int = 1, size: int = 20, status=None) -> DataFrame:
    rows = suggestions if status is None else suggestions.where(F.col("status") == status)
    named = rows.join(
        suppliers.select(F.col("id").alias("supplier_id"), F.col("name").alias("supplier_name")), "supplier_id", "left"
    )
    return page(named, [F.desc("optimal_order_date"), F.asc("store_id"), F.asc("item_id")], page_no, size)
