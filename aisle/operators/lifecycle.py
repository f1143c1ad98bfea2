"""Product lifecycle: weekly facts, stage rule, advice and listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aisle.functions.listing import latest_snapshot, page, top_k
from aisle.functions.scalars import clamp, money_sum, round_to
from aisle.functions.scope import scope_stores, where_optional
from aisle.sources.sinks import upsert

FACT_DAYS = 84
VELOCITY_DAYS = 28
STAGES = ["introduction", "growth", "maturity", "decline"]
NO_LAUNCH_WEEKS = 52


def product_weekly(sales: DataFrame, as_of: str, store_ids=None) -> DataFrame:
    """Revenue, quantity, stores and growth per product and week of the last 84 days."""
    recent = scope_stores(sales, store_ids).where(
        F.col("sale_date") >= F.date_sub(F.lit(as_of).cast("date"), FACT_DAYS)
    )
    weekly = recent.groupBy("item_id", F.date_trunc("week", "sale_date").cast("date").alias("week_start")).agg(
        money_sum("total_amount").alias("revenue"),
        F.sum("quantity").alias("quantity"),
        F.countDistinct("store_id").alias("store_count"),
    )
    before = F.lag("revenue").over(Window.partitionBy("item_id").orderBy("week_start"))
    return weekly.withColumn(
        "growth_rate", (F.col("revenue") - before) / F.greatest(before, F.lit(1.0))
    )


def category_velocity(sales: DataFrame, products: DataFrame, as_of: str, store_ids=None, per_day: bool = False) -> DataFrame:
    """Mean quantity per sale line over seven; ``per_day`` uses mean daily quantity instead."""
    recent = scope_stores(sales, store_ids).where(
        F.col("sale_date") >= F.date_sub(F.lit(as_of).cast("date"), VELOCITY_DAYS)
    )
    per_item = recent.groupBy("item_id").agg(F.sum("quantity").alias("_q"), F.count(F.lit(1)).alias("_n"))
    lines = per_item.join(products.select("item_id", "category"), "item_id")
    mean = F.sum("_q") / F.lit(float(VELOCITY_DAYS)) if per_day else F.sum("_q") / F.sum("_n") / 7.0
    return lines.groupBy("category").agg(mean.alias("category_velocity"))


def stage_rule(
    growths: Column, volatility: Column, weeks: Column, adoption: Column, velocity: Column, peers: Column
) -> Column:
    """Stage from the growth history (array, oldest first) and volatility-scaled limits."""
    limit = clamp(volatility * 1.2, 0.03, 0.15)
    band = clamp(volatility * 0.8, 0.03, 0.10)
    floor = F.greatest(F.lit(0.0), peers - volatility * peers)
    recent = F.slice(growths, -4, 4)
    up = F.size(F.filter(recent, lambda g: g > limit))
    down = F.size(F.filter(recent, lambda g: g < -limit))
    stable = F.size(F.filter(recent, lambda g: F.abs(g) <= band))
    return (
        F.when(F.size(growths) < 4, "introduction")
        .when((weeks <= 8) & (adoption < 0.5), "introduction")
        .when((down >= 3) | ((velocity < floor) & (weeks > 26)), "decline")
        .when((up >= 3) & (adoption >= 0.5), "growth")
        .when((stable >= 3) & (velocity > peers * 0.7), "maturity")
        .when(up >= 2, "growth")
        .otherwise("maturity")
    )


def lifecycle_stage(
    sales: DataFrame, products: DataFrame, stores: DataFrame, as_of: str, store_ids=None
) -> DataFrame:
    """Current stage and figures of every active product with sales in the last 84 days.

    A product has at most 13 weekly rows, so its growth history fits one small array.
    """
    weekly = product_weekly(sales, as_of, store_ids)
    last = lambda c: F.max_by(c, "week_start")
    history = weekly.groupBy("item_id").agg(
        F.array_sort(
            F.collect_list(F.when(F.col("growth_rate").isNotNull(), F.struct("week_start", "growth_rate")))
        ).alias("_h"),
        F.stddev_pop("growth_rate").alias("_volatility"),
        last("revenue").alias("weekly_revenue"),
        last("quantity").alias("weekly_quantity"),
        last("store_count").alias("_stores"),
        F.coalesce(last("growth_rate"), F.lit(0.0)).alias("growth_rate"),
    )
    total = stores.agg(F.greatest(F.count_if(F.col("is_active")), F.lit(1)).alias("_all"))
    today = F.lit(as_of).cast("date")
    weeks = F.coalesce(F.floor(F.datediff(today, "launch_date") / 7), F.lit(NO_LAUNCH_WEEKS))
    speeds = category_velocity(sales, products, as_of, store_ids)
    facts = (
        history.join(products.where("is_active"), "item_id")
        .join(speeds, "category", "left")
        .join(F.broadcast(total))
        .withColumn("growth_rates", F.col("_h.growth_rate"))
        .withColumn("weeks_since_launch", weeks)
        .withColumn("adoption_rate", F.col("_stores") / F.col("_all"))
        .withColumn("velocity", F.col("weekly_revenue") / 7.0)
        .withColumn("category_velocity", F.coalesce(F.nullif("category_velocity", F.lit(0.0)), F.lit(1.0)))
    )
    revenue = F.col("weekly_revenue")
    margin = F.when(
        revenue > 0,
        (revenue - F.coalesce("unit_cost", F.lit(0.0)) * F.col("weekly_quantity")) / F.greatest(revenue, F.lit(1.0)),
    ).otherwise(0.0)
    return facts.select(
        F.col("id").alias("product_id"),
        "item_id",
        F.date_trunc("week", today).cast("date").alias("snapshot_week"),
        stage_rule(
            F.col("growth_rates"), F.col("_volatility"), F.col("weeks_since_launch"),
            F.col("adoption_rate"), F.col("velocity"), F.col("category_velocity"),
        ).alias("stage"),
        "weekly_revenue",
        "weekly_quantity",
        "growth_rate",
        "adoption_rate",
        F.lit(0.0).alias("market_share"),
        margin.alias("margin_rate"),
        "velocity",
        "growth_rates",
    )


SNAPSHOT_KEYS = ["product_id", "snapshot_week", "store_id"]
#: What a second run in a week refreshes; the other figures stay as the week's first run found them.
REFRESHED = ["stage", "weekly_revenue", "growth_rate", "velocity"]


def snapshot_lifecycle(path: str, staged: DataFrame, store_id: int | None = None) -> None:
    """Put the stages of a run into the stored weeks, one row per product, week and store (null: all stores together).

    Only the week's folder is rewritten.
    """
    rows = staged.select(
        "product_id", F.lit(store_id).cast("long").alias("store_id"), "snapshot_week", "stage", "weekly_revenue", "weekly_quantity",
        "growth_rate", "adoption_rate", "market_share", "margin_rate", "velocity",
    )
    upsert(path, rows, SNAPSHOT_KEYS, REFRESHED, ["snapshot_week"])


def retirement_advice(staged: DataFrame, as_of: str) -> DataFrame:
    """Phase out, mark down or keep for products in steady decline."""
    falling = F.size(F.filter(F.slice("growth_rates", -4, 4), lambda g: g < -0.05))
    in_decline = staged.where(
        (F.col("stage") == "decline") & (F.size("growth_rates") >= 4) & (falling >= 3)
    )
    loss, slow = F.col("margin_rate") < 0, F.col("velocity") < 0.5
    return in_decline.select(
        "product_id",
        F.when(loss, "phase_out").when(slow, "markdown").otherwise("keep").alias("recommendation"),
        F.when(loss, 0.9).when(slow, 0.75).otherwise(0.5).alias("confidence"),
        F.when(loss, "negative margin").when(slow, "very slow sales").otherwise("still selling").alias("reason"),
        F.col("weekly_revenue").alias("impact_revenue_loss"),
        F.date_add(F.lit(as_of).cast("date"), 14).alias("suggested_action_date"),
    )


def lifecycle_overview(snapshots: DataFrame, products: DataFrame, store_ids=None, category=None) -> DataFrame:
    newest = scope_stores(latest_snapshot(snapshots, "snapshot_week"), store_ids)
    known = where_optional(products, category=category).select(F.col("id").alias("product_id"))
    counts = newest.join(known, "product_id", "left_semi")
    per_stage = counts.groupBy("stage").agg(F.countDistinct("product_id").alias("n"))
    pick = lambda s: F.coalesce(F.sum(F.when(F.col("stage") == s, F.col("n"))), F.lit(0))
    return per_stage.agg(
        *[pick(s).alias(f"{s}_count") for s in STAGES],
        F.coalesce(F.sum(F.when(F.col("stage").isin(STAGES), F.col("n"))), F.lit(0)).alias("total_products"),
    )


def products_with_stage(
    snapshots: DataFrame, products: DataFrame, page_no: int = 1, size: int = 20, stage=None, category=None, store_ids=None
) -> DataFrame:
    newest = where_optional(scope_stores(latest_snapshot(snapshots, "snapshot_week"), store_ids), stage=stage)
    named = newest.join(
        where_optional(products, category=category).withColumnRenamed("id", "product_id"), "product_id"
    )
    weeks = F.greatest(F.lit(1), F.floor(F.datediff("snapshot_week", "launch_date") / 7))
    rows = named.select(
        F.col("product_id").alias("id"), "item_id", "item_name", "category", "store_id",
        F.col("stage").alias("current_stage"), F.coalesce("weekly_revenue", F.lit(0.0)).alias("weekly_revenue"),
        "growth_rate", F.coalesce(weeks, F.lit(0)).cast("int").alias("weeks_in_stage"),
    )
    return page(rows, [F.desc_nulls_first("weekly_revenue"), F.asc("id"), F.asc("store_id")], page_no, size)


def lifecycle_curve(snapshots: DataFrame, products: DataFrame, store_ids=None) -> DataFrame:
    """Weekly revenue, quantity and stage of every product."""
    return (
        scope_stores(snapshots, store_ids)
        .join(products.select(F.col("id").alias("product_id"), "item_name"), "product_id", "left")
        .select(
            "product_id", "item_name", "store_id", "snapshot_week", "stage",
            F.coalesce("weekly_revenue", F.lit(0.0)).alias("revenue"),
            F.coalesce("weekly_quantity", F.lit(0.0)).alias("quantity"),
        )
    )


def stage_transitions(
    snapshots: DataFrame, products: DataFrame, as_of: str, days: int = 30, store_ids=None, top: int | None = 50
) -> DataFrame:
    """Changes of stage per product and store, newest first."""
    recent = scope_stores(snapshots, store_ids).where(
        F.col("snapshot_week") >= F.date_sub(F.lit(as_of).cast("date"), days)
    )
    by_week = Window.partitionBy("product_id", "store_id").orderBy("snapshot_week")
    moved = recent.withColumn("from_stage", F.lag("stage").over(by_week)).where(
        F.col("from_stage") != F.col("stage")
    )
    rows = moved.join(products.select(F.col("id").alias("product_id"), "item_name"), "product_id").select(
        "product_id", "store_id", "item_name", "from_stage",
        F.col("stage").alias("to_stage"), F.col("snapshot_week").alias("transition_date"),
    )
    order = [F.desc("transition_date"), F.asc("product_id"), F.asc("store_id")]
    return top_k(rows, order, top) if top else rows


def stage_kpis(snapshots: DataFrame, store_ids=None) -> DataFrame:
    """Means per stage at the newest week."""
    newest = scope_stores(latest_snapshot(snapshots, "snapshot_week"), store_ids)
    mean = lambda c, d: round_to(F.coalesce(F.avg(c), F.lit(0.0)), d)
    return newest.groupBy("stage").agg(
        F.countDistinct("product_id").alias("product_count"),
        mean("weekly_revenue", 2).alias("avg_weekly_revenue"),
        mean("growth_rate", 4).alias("avg_growth_rate"),
        mean("adoption_rate", 4).alias("avg_adoption_rate"),
        mean("market_share", 4).alias("avg_market_share"),
        mean("margin_rate", 4).alias("avg_margin_rate"),
        mean("velocity", 2).alias("avg_velocity"),
    )


def list_retirement(advice: DataFrame, products: DataFrame, category=None, top: int = 50) -> DataFrame:
    named = advice.join(
        where_optional(products, category=category).select(F.col("id").alias("product_id"), "item_name"), "product_id"
    )
    return top_k(named, [F.desc("confidence"), F.asc("impact_revenue_loss"), F.asc("product_id")], top)
