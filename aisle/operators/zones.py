"""Floor-space facts, rankings and layout advice."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aisle.functions.listing import global_rank, prioritised
from aisle.functions.scalars import metric_expr, money_sum, round_to, safe_div, time_bucket
from aisle.functions.scope import between_dates, scope_stores

MIN_AREA = 0.01
# Limits of the advice rules.
LOW_REVENUE_SHARE = 0.7
LOW_CONVERSION_SHARE = 0.6
LOW_ENTRANCE_SHARE = 0.5


def aggregate_zone_sales(sales: DataFrame, mapping: DataFrame, zones: DataFrame, traffic: DataFrame) -> DataFrame:
    """Daily zone facts: sales mapped by category, and by item where the mapping names one.

    The equality on store and category keeps it a hash join; a store's traffic is
    split evenly over its active zones.
    """
    placed = mapping.select("zone_id", F.col("category").alias("_category"), F.col("item_id").alias("_item")).join(
        zones.select(F.col("id").alias("zone_id"), F.col("store_id").alias("_store")), "zone_id"
    )
    on = (
        (F.col("store_id") == F.col("_store"))
        & (F.col("category") == F.col("_category"))
        & (F.col("_item").isNull() | (F.col("_item") == F.col("item_id")))
    )
    facts = sales.join(placed, on).groupBy("store_id", "zone_id", "sale_date").agg(
        money_sum("total_amount").alias("revenue"),
        F.countDistinct("receipt_no").alias("transaction_count"),
        F.sum("quantity").alias("items_sold"),
    )
    visitors = traffic.groupBy("store_id", F.col("traffic_date").alias("sale_date")).agg(
        F.sum("enter_count").alias("_visitors")
    )
    active = zones.where("is_active").groupBy("store_id").agg(F.count(F.lit(1)).alias("_zones"))
    return (
        facts.join(visitors, ["store_id", "sale_date"], "left")
        .join(active, "store_id", "left")
        .withColumn(
            "traffic_count",
            F.floor(F.coalesce("_visitors", F.lit(0)) / F.greatest(F.coalesce("_zones", F.lit(1)), F.lit(1))),
        )
        .drop("_visitors", "_zones")
    )


def _zone_totals(zones: DataFrame, facts: DataFrame, start: str, end: str, store_ids=None) -> DataFrame:
    """Active zones with period sums; zones without sales keep zeros."""
    sums = between_dates(facts, "sale_date", start, end).groupBy(F.col("zone_id").alias("id")).agg(
        money_sum("revenue").alias("revenue"),
        F.sum("transaction_count").alias("transaction_count"),
        F.sum("items_sold").alias("items_sold"),
        F.sum("traffic_count").alias("traffic_count"),
    )
    return (
        scope_stores(zones.where("is_active"), store_ids)
        .join(sums, "id", "left")
        .fillna(0, ["revenue", "transaction_count", "items_sold", "traffic_count"])
        .withColumnRenamed("id", "zone_id")
        .withColumn("_area", F.greatest("area_sqm", F.lit(MIN_AREA)))
    )


def zone_kpis(zones: DataFrame, facts: DataFrame, start: str, end: str, store_ids=None) -> DataFrame:
    return _zone_totals(zones, facts, start, end, store_ids).select(
        "store_id", "zone_id", "zone_name", "zone_type", "area_sqm",
        round_to("revenue", 2).alias("revenue"),
        "transaction_count",
        round_to("items_sold", 2).alias("items_sold"),
        "traffic_count",
        round_to(F.col("revenue") / F.col("_area"), 2).alias("revenue_per_sqm"),
        round_to(F.col("items_sold") / F.col("_area"), 2).alias("items_per_sqm"),
        round_to(safe_div("transaction_count", "traffic_count"), 4).alias("traffic_conversion"),
    )


def zone_summary(kpis: DataFrame) -> DataFrame:
    """Zones, area, revenue per square metre and best zone of each store."""
    best = F.struct(F.col("revenue_per_sqm"), -F.col("zone_id"))
    return kpis.groupBy("store_id").agg(
        F.count(F.lit(1)).alias("total_zones"),
        round_to(F.sum("area_sqm"), 1).alias("total_area"),
        round_to(safe_div(money_sum("revenue"), F.sum("area_sqm")), 2).alias("avg_revenue_per_sqm"),
        F.max_by("zone_name", best).alias("top_zone_name"),
    )


def zone_heatmap(
    zones: DataFrame, facts: DataFrame, start: str, end: str, floor_plans: DataFrame | None = None, store_ids=None
) -> DataFrame:
    """Zone revenue as a share of the store's best zone, with the plan size of the store."""
    store = Window.partitionBy("store_id")
    extent = lambda a, b: F.coalesce(
        F.nullif(F.max(F.coalesce(a, F.lit(0.0)) + F.coalesce(b, F.lit(0.0))).over(store), F.lit(0.0)), F.lit(100.0)
    )
    peak = F.max("revenue").over(store)
    rows = (
        _zone_totals(zones, facts, start, end, store_ids)
        .withColumn("_peak", F.when(peak == 0, 1.0).otherwise(peak))
        .withColumn("plan_width", extent(F.col("position_x"), F.col("width")))
        .withColumn("plan_height", extent(F.col("position_y"), F.col("height")))
    )
    if floor_plans is not None:
        drawn = floor_plans.where(F.col("floor") == 1).select(
            "store_id", F.col("plan_width").alias("_w"), F.col("plan_height").alias("_h")
        )
        rows = (
            rows.join(drawn, "store_id", "left")
            .withColumn("plan_width", F.coalesce("_w", "plan_width"))
            .withColumn("plan_height", F.coalesce("_h", "plan_height"))
            .drop("_w", "_h")
        )
    return rows.select(
        "store_id", "zone_id", "zone_name", "position_x", "position_y", "width", "height",
        round_to(F.col("revenue") / F.col("_peak"), 4).alias("intensity"),
        round_to("revenue", 2).alias("revenue"), "plan_width", "plan_height",
    )


def zone_ranking(
    zones: DataFrame, stores: DataFrame, facts: DataFrame, start: str, end: str, metric: str = "revenue_per_sqm", store_ids=None
) -> DataFrame:
    per_sqm = F.col("revenue") / F.col("_area")
    value = metric_expr(
        metric,
        {
            "revenue_per_sqm": per_sqm,
            "revenue": F.col("revenue"),
            "transaction_count": F.col("transaction_count").cast("double"),
        },
        "revenue_per_sqm",
    )
    named = (
        _zone_totals(zones, facts, start, end, store_ids)
        .join(stores.select(F.col("id").alias("store_id"), F.col("name").alias("store_name")), "store_id")
        .select("zone_id", "zone_name", "store_name", "zone_type", value.alias("_value"))
    )
    return global_rank(named, "_value", ["zone_id"]).select(
        "zone_id", "zone_name", "store_name", "zone_type", round_to("_value", 2).alias("metric_value"), "rank"
    )


def zone_trends(zones: DataFrame, facts: DataFrame, start: str, end: str, granularity: str = "daily") -> DataFrame:
    rows = between_dates(facts, "sale_date", start, end).groupBy(
        "zone_id", time_bucket("sale_date", granularity).alias("period_date")
    ).agg(
        money_sum("revenue").alias("_revenue"),
        F.sum("transaction_count").alias("transaction_count"),
        round_to(F.sum("items_sold"), 2).alias("items_sold"),
    )
    area = zones.select(F.col("id").alias("zone_id"), F.greatest("area_sqm", F.lit(MIN_AREA)).alias("_area"))
    return rows.join(area, "zone_id", "left").select(
        "zone_id", "period_date", round_to("_revenue", 2).alias("revenue"), "transaction_count", "items_sold",
        round_to(F.col("_revenue") / F.coalesce("_area", F.lit(1.0)), 2).alias("revenue_per_sqm"),
    )


def layout_advice(zones: DataFrame, facts: DataFrame, start: str, end: str, store_ids=None) -> DataFrame:
    """Three rules against the store's own level: low revenue per area, low conversion, quiet entrance."""
    per_store = Window.partitionBy("store_id")
    revenue_sqm = F.col("revenue") / F.col("_area")
    rows = (
        _zone_totals(zones, facts, start, end, store_ids)
        .withColumn("_sqm", revenue_sqm)
        .withColumn("_mean", F.sum(F.col("_sqm").cast("decimal(28,8)")).over(per_store).cast("double") / F.count(F.lit(1)).over(per_store))
        .withColumn("_conv", F.try_divide("transaction_count", "traffic_count"))
        .withColumn(
            "_mean_conv",
            F.sum("transaction_count").over(per_store)
            / F.greatest(F.sum("traffic_count").over(per_store), F.lit(1)),
        )
        .withColumn("_peak", F.max("traffic_count").over(per_store))
    )
    visits = F.col("traffic_count")
    low_revenue = F.when(
        (F.col("_mean") > 0) & (F.col("_sqm") < F.col("_mean") * LOW_REVENUE_SHARE),
        F.struct(
            F.lit("low_revenue_per_sqm").alias("issue"),
            F.lit("high").alias("priority"),
            round_to("_sqm", 2).alias("current_value"),
            round_to("_mean", 2).alias("benchmark"),
            F.round((F.col("_mean") - F.col("_sqm")) * F.col("area_sqm"), 0).alias("estimated_gain"),
            F.lit("change the category or shrink the zone").alias("suggestion"),
        ),
    )
    low_conversion = F.when(
        (visits > 0) & (F.col("_conv") < F.col("_mean_conv") * LOW_CONVERSION_SHARE),
        F.struct(
            F.lit("low_conversion").alias("issue"),
            F.lit("medium").alias("priority"),
            round_to(F.col("_conv") * 100, 1).alias("current_value"),
            round_to(F.col("_mean_conv") * 100, 1).alias("benchmark"),
            F.round(visits * 0.01 * (F.col("revenue") / F.greatest("transaction_count", F.lit(1))), 0).alias("estimated_gain"),
            F.lit("place impulse goods and improve display").alias("suggestion"),
        ),
    )
    quiet_entrance = F.when(
        (F.col("zone_type") == "entrance") & (visits > 0) & (visits < F.col("_peak") * LOW_ENTRANCE_SHARE),
        F.struct(
            F.lit("quiet_entrance").alias("issue"),
            F.lit("high").alias("priority"),
            visits.cast("double").alias("current_value"),
            F.col("_peak").cast("double").alias("benchmark"),
            F.lit(None).cast("double").alias("estimated_gain"),
            F.lit("move traffic-drawing categories to the entrance").alias("suggestion"),
        ),
    )
    advice = F.explode(F.array_compact(F.array(low_revenue, low_conversion, quiet_entrance)))
    return rows.select("store_id", "zone_id", "zone_name", advice.alias("a")).select(
        "store_id", "zone_id", "zone_name", "a.*"
    )


def sorted_advice(advice: DataFrame) -> DataFrame:
    return advice.orderBy(prioritised("priority", ["high", "medium", "low"]), "store_id", "zone_id")


def compare_zone_types(
    zones: DataFrame, stores: DataFrame, facts: DataFrame, start: str, end: str, store_ids=None
) -> DataFrame:
    """Zone types across stores. Areas are summed once per zone, before any daily row is joined."""
    rows = _zone_totals(zones, facts, start, end, store_ids).where(F.col("zone_type").isNotNull())
    grouped = rows.groupBy("zone_type", "store_id").agg(
        money_sum("revenue").alias("_revenue"),
        F.sum("transaction_count").alias("transaction_count"),
        round_to(F.sum("items_sold"), 2).alias("items_sold"),
        F.sum("area_sqm").alias("_total"),
        F.count(F.lit(1)).alias("zone_count"),
    )
    names = stores.select(F.col("id").alias("store_id"), F.col("name").alias("store_name"))
    return grouped.join(names, "store_id").select(
        "zone_type", "store_id", "store_name", round_to("_revenue", 2).alias("revenue"), "transaction_count",
        "items_sold", round_to("_total", 2).alias("total_area_sqm"),
        round_to(F.col("_revenue") / F.greatest("_total", F.lit(MIN_AREA)), 2).alias("revenue_per_sqm"), "zone_count",
    )
