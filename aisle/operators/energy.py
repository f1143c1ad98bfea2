"""Store energy: dashboards, correlation, anomalies, schedules, cost advice, budgets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aisle.functions.listing import top_k, with_dow_hours
from aisle.functions.scalars import money_sum, round_to, safe_div, sunday_dow, time_bucket
from aisle.functions.scope import between_dates, scope_stores, where_optional
from aisle.functions.stats import bounded_quantiles, correlation, pearson_p
from aisle.operators.omnichannel import previous_period

RATE = 0.85
ROLLING_ROWS = 7
LOW_TRAFFIC, PEAK_TRAFFIC, PEAK_DAY = 0.30, 0.8, 1.5
# Share of rated power saved by each rule.
HVAC_LOW, HVAC_PEAK_DAY, LIGHTING_LOW, POS_CLOSED = 0.4, 0.15, 0.5, 0.85


def energy_daily(readings: DataFrame, sample_seconds: int = 1) -> DataFrame:
    """Daily facts per device from single readings."""
    return readings.groupBy("store_id", "equipment_id", F.to_date("reading_time").alias("energy_date")).agg(
        F.sum("energy_kwh").alias("total_kwh"),
        F.max("power_kw").alias("peak_kw"),
        F.avg("power_kw").alias("avg_kw"),
        (F.count_if(F.col("operational_state") != "idle") * sample_seconds / 3600.0).alias("operating_hours"),
        (F.sum("energy_kwh") * RATE).alias("cost"),
    )


def energy_dashboard(
    daily: DataFrame, equipment: DataFrame, stores: DataFrame, sales: DataFrame, start: str, end: str, store_ids=None
) -> DataFrame:
    """One row: consumption, cost per metered area, revenue per kWh, change against the period before."""
    before, _ = previous_period(start, end)
    rows = scope_stores(between_dates(daily, "energy_date", before, end), store_ids)
    now = F.col("energy_date") >= F.lit(start)
    part = lambda c, cond: F.coalesce(money_sum(F.when(cond, F.col(c))), F.lit(0.0))
    facts = rows.agg(
        part("total_kwh", now).alias("_kwh"), part("cost", now).alias("_cost"), part("total_kwh", ~now).alias("_before")
    )
    metered = between_dates(rows, "energy_date", start, end).select(F.col("store_id").alias("id")).distinct()
    area = stores.join(metered, "id", "left_semi").agg(F.coalesce(F.sum("area_sqm"), F.lit(0.0)).alias("_area"))
    revenue = scope_stores(between_dates(sales, "sale_date", start, end), store_ids).agg(
        F.coalesce(money_sum("total_amount"), F.lit(0.0)).alias("_revenue")
    )
    devices = scope_stores(equipment, store_ids).agg(
        F.count_if(F.col("status") == "active").alias("equipment_count")
    )
    joined = facts.join(F.broadcast(area)).join(F.broadcast(revenue)).join(F.broadcast(devices))
    change = F.when(F.col("_before") > 0, (F.col("_kwh") - F.col("_before")) / F.col("_before") * 100).otherwise(0.0)
    return joined.select(
        round_to("_kwh", 2).alias("total_kwh"),
        round_to("_cost", 2).alias("total_cost"),
        round_to(F.col("_cost") / F.when(F.col("_area") > 0, F.col("_area")).otherwise(1.0), 2).alias("cost_per_sqm"),
        round_to(safe_div("_revenue", "_kwh"), 2).alias("revenue_per_kwh"),
        round_to(change, 1).alias("period_kwh_change_pct"),
        "equipment_count",
    )


def energy_by_type(daily: DataFrame, equipment: DataFrame, start: str, end: str, store_ids=None) -> DataFrame:
    """Consumption, cost and share per device type."""
    rows = scope_stores(between_dates(daily, "energy_date", start, end), store_ids)
    per_device = rows.groupBy("equipment_id").agg(money_sum("total_kwh").alias("_k"), money_sum("cost").alias("_c"))
    types = equipment.select(F.col("id").alias("equipment_id"), "equipment_type")
    # Devices without an entry count in the total but have no row of their own.
    by_type = per_device.join(types, "equipment_id", "left").groupBy("equipment_type").agg(
        money_sum("_k").alias("_kwh"), money_sum("_c").alias("_cost"), money_sum("_k").alias("_all")
    )
    everything = Window.partitionBy(F.lit(1))
    total = F.sum(F.col("_all").cast("decimal(28,4)")).over(everything).cast("double")
    return by_type.withColumn("_total", total).where(F.col("equipment_type").isNotNull()).select(
        "equipment_type",
        round_to("_kwh", 2).alias("total_kwh"),
        round_to("_cost", 2).alias("total_cost"),
        round_to(safe_div("_kwh", "_total") * 100, 1).alias("pct"),
    )


def energy_trends(
    daily: DataFrame, equipment: DataFrame, start: str, end: str, granularity: str = "daily", equipment_type=None
) -> DataFrame:
    known = where_optional(equipment, equipment_type=equipment_type).select(F.col("id").alias("equipment_id"))
    rows = between_dates(daily, "energy_date", start, end).join(known, "equipment_id", "left_semi")
    return rows.groupBy("store_id", time_bucket("energy_date", granularity).alias("period_date")).agg(
        round_to(money_sum("total_kwh"), 2).alias("total_kwh"), round_to(money_sum("cost"), 2).alias("total_cost")
    )


def peak_hours(readings: DataFrame, start: str, end: str) -> DataFrame:
    """Mean kWh of a reading per hour of day, 24 rows for every store with readings."""
    rows = readings.where(F.to_date("reading_time").between(F.lit(start), F.lit(end)))
    means = rows.groupBy("store_id", F.hour("reading_time").alias("hour")).agg(F.avg("energy_kwh").alias("_m"))
    # The grid comes from the small per-hour result, one row per store exploded to 24.
    grid = means.select("store_id").distinct().withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(23))))
    value = F.coalesce("_m", F.lit(0.0))
    return grid.join(means, ["store_id", "hour"], "left").select(
        "store_id", "hour", round_to(value, 4).alias("avg_kwh"), round_to(value * RATE, 4).alias("avg_cost")
    )


def weather_energy_points(daily: DataFrame, stores: DataFrame, weather: DataFrame, start: str, end: str) -> DataFrame:
    """Daily kWh (y) against high temperature (x) per store."""
    per_day = between_dates(daily, "energy_date", start, end).groupBy("store_id", "energy_date").agg(
        money_sum("total_kwh").alias("y")
    )
    cities = stores.select(F.col("id").alias("store_id"), "city")
    highs = weather.where(F.col("temp_high").isNotNull()).select(
        "city", F.col("weather_date").alias("energy_date"), F.col("temp_high").alias("x")
    )
    return per_day.join(cities, "store_id").join(highs, ["city", "energy_date"]).select("store_id", "energy_date", "x", "y")


def sales_energy_points(daily: DataFrame, sales: DataFrame, start: str, end: str) -> DataFrame:
    """Daily kWh (y) against daily revenue (x, zero without sales) per store."""
    per_day = between_dates(daily, "energy_date", start, end).groupBy("store_id", "energy_date").agg(
        money_sum("total_kwh").alias("y")
    )
    revenue = between_dates(sales, "sale_date", start, end).groupBy(
        "store_id", F.col("sale_date").alias("energy_date")
    ).agg(money_sum("total_amount").alias("_r"))
    return per_day.join(revenue, ["store_id", "energy_date"], "left").select(
        "store_id", "energy_date", F.coalesce("_r", F.lit(0.0)).alias("x"), "y"
    )


def point_correlation(points: DataFrame) -> DataFrame:
    """Pearson r and two-sided p per store; r = 0 and p = 1 under three points."""
    raw = points.groupBy("store_id").agg(*correlation("x", "y"))
    p = F.when(F.col("points") < 3, 1.0).otherwise(pearson_p(F.col("r"), F.col("points")))
    return raw.select(
        "store_id", round_to("r", 4).alias("correlation_coefficient"), round_to(p, 6).alias("p_value"), "points"
    )


def regression_line(points: DataFrame) -> DataFrame:
    """End points of the least-squares line per store."""
    fit = points.groupBy("store_id").agg(
        F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"),
        F.min("x").alias("x1"), F.max("x").alias("x2"),
    )
    line = lambda x: F.col("slope") * F.col(x) + F.col("intercept")
    return fit.select("store_id", "x1", line("x1").alias("y1"), "x2", line("x2").alias("y2"))


def energy_anomalies(daily: DataFrame, equipment: DataFrame, as_of: str, lookback: int = 30) -> DataFrame:
    """Days above mean + 2 deviations of the device's seven rows before."""
    rows = daily.where(F.col("energy_date") >= F.date_sub(F.lit(as_of).cast("date"), lookback))
    by_day = Window.partitionBy("equipment_id").orderBy("energy_date")
    back = by_day.rowsBetween(-ROLLING_ROWS, -1)
    limit = F.col("_mean") + F.col("_std") * 2
    flagged = (
        rows.withColumn("_i", F.row_number().over(by_day))
        .withColumn("_mean", F.avg("total_kwh").over(back))
        .withColumn("_std", F.stddev_pop("total_kwh").over(back))
        .where((F.col("_i") > ROLLING_ROWS) & (F.col("_std") > 0) & (F.col("total_kwh") > limit))
    )
    names = equipment.select(F.col("id").alias("equipment_id"), F.col("name").alias("equipment_name"))
    return flagged.join(names, "equipment_id").select(
        "store_id", "equipment_id", "equipment_name", F.col("energy_date").alias("date"),
        round_to("total_kwh", 2).alias("actual_kwh"),
        round_to("_mean", 2).alias("expected_kwh"),
        round_to(limit, 2).alias("threshold_kwh"),
    )


def anomaly_alerts(anomalies: DataFrame, now: str) -> DataFrame:
    """Anomalies in the shape of the alert table."""
    return anomalies.select(
        "store_id", "equipment_id", F.lit("anomaly").alias("alert_type"), F.lit("warning").alias("alert_level"),
        F.col("actual_kwh").alias("metric_value"), F.col("threshold_kwh").alias("threshold_value"),
        F.lit(now).cast("timestamp_ntz").alias("alert_time"), F.lit(False).alias("is_acknowledged"),
    )


def peak_days(forecast: DataFrame) -> DataFrame:
    """Days of week (0 = Monday) with a holiday or a forecast over 1.5 times the store's median."""
    store = Window.partitionBy("store_id")
    rows = (
        forecast.withColumn("_base", bounded_quantiles("forecast", [0.5]).over(store)[0])
        .where(F.col("_base") > 0)
        .withColumn("_ratio", F.col("forecast") / F.col("_base"))
        .where((F.col("_ratio") > PEAK_DAY) | F.col("is_holiday"))
    )
    return rows.groupBy("store_id", F.weekday("date").alias("dow")).agg(F.max("_ratio").alias("peak_ratio"))


def schedule_advice(equipment: DataFrame, traffic: DataFrame, forecast: DataFrame) -> DataFrame:
    """Reduced or standby level per active device, day of week and hour."""
    hourly = traffic.groupBy("store_id", "hour").agg((F.sum("enter_count") / F.count(F.lit(1))).alias("_m"))
    ranked = hourly.withColumn("_peak", F.max("_m").over(Window.partitionBy("store_id")))
    # At most 24 hours per store.
    hours = ranked.groupBy("store_id").agg(
        F.collect_set(F.when(F.col("_m") < F.col("_peak") * LOW_TRAFFIC, F.col("hour"))).alias("low_hours"),
        F.collect_set(F.when(F.col("_m") >= F.col("_peak") * PEAK_TRAFFIC, F.col("hour"))).alias("peak_hours"),
    )
    grid = (
        with_dow_hours(equipment.where(F.col("status") == "active"))
        .join(hours, "store_id", "left")
        .join(peak_days(forecast), ["store_id", "dow"], "left")
    )
    none = F.array().cast("array<int>")
    low = F.array_contains(F.coalesce("low_hours", none), F.col("hour"))
    busy = F.coalesce("peak_hours", none)
    near_peak = reduce(lambda a, b: a | b, [F.array_contains(busy, F.col("hour") + k) for k in range(3)])
    peak_day = F.col("peak_ratio").isNotNull()
    kind = F.col("equipment_type")
    closed = (F.col("hour") >= 22) | (F.col("hour") < 7)

    def advice(level: str, saving: float, reason: str):
        return F.struct(F.lit(level).alias("level"), F.lit(saving).alias("saving"), F.lit(reason).alias("reason"))

    picked = (
        F.when((kind == "hvac") & peak_day & ~near_peak, advice("reduced", HVAC_PEAK_DAY, "peak day: mild reduction only"))
        .when((kind == "hvac") & ~peak_day & low, advice("reduced", HVAC_LOW, "low traffic: reduce output"))
        .when((kind == "lighting") & ~peak_day & low, advice("reduced", LIGHTING_LOW, "low traffic: half the lighting"))
        .when((kind == "pos") & closed, advice("standby", POS_CLOSED, "store closed: standby"))
    )
    return (
        grid.withColumn("_a", picked)
        .where(F.col("_a").isNotNull())
        .select(
            "store_id", F.col("id").alias("equipment_id"), F.col("name").alias("equipment_name"),
            F.col("dow").alias("day_of_week"), "hour", F.lit("full").alias("current_level"),
            F.col("_a.level").alias("recommended_level"), F.col("_a.reason").alias("reason"),
            round_to(F.col("rated_power_kw") * F.col("_a.saving"), 3).alias("estimated_saving_kwh"),
        )
    )


def energy_cost_advice(
    daily: DataFrame, readings: DataFrame, equipment: DataFrame, sales: DataFrame, start: str, end: str
) -> DataFrame:
    """Four savings rules per store: load shifting, loaded devices, HVAC share, weekend use."""
    period = between_dates(daily, "energy_date", start, end)
    samples = readings.where(F.to_date("reading_time").between(F.lit(start), F.lit(end)))
    shape = lambda category, priority, subject, metric, saving: [
        F.col("store_id"), F.lit(category).alias("category"), F.lit(priority).alias("priority"),
        subject.cast("long").alias("equipment_id"), round_to(metric, 4).alias("metric_value"),
        round_to(saving, 2).alias("potential_saving"),
    ]
    nobody = F.lit(None)

    day_hours = F.hour("reading_time").between(8, 22)
    load = samples.groupBy("store_id").agg(
        F.sum("energy_kwh").alias("_total"), F.sum(F.when(day_hours, F.col("energy_kwh")).otherwise(0.0)).alias("_peak")
    )
    ratio = safe_div("_peak", "_total")
    shifting = load.where(ratio > 0.6).select(
        *shape("load_shifting", "high", nobody, ratio, F.col("_total") * 0.05 * RATE)
    )

    devices = equipment.select(F.col("id").alias("equipment_id"), "equipment_type", "rated_power_kw", "status")
    per_device = (
        period.groupBy("store_id", "equipment_id")
        .agg(
            F.avg("avg_kw").alias("_kw"), money_sum("total_kwh").alias("_kwh")
        )
        .join(devices, "equipment_id")
    )
    share = safe_div("_kw", "rated_power_kw")
    loaded = per_device.where(
        (F.col("status") == "active") & (F.col("rated_power_kw") > 0) & (F.col("_kw") > F.col("rated_power_kw") * 0.9)
    ).select(*shape("equipment_efficiency", "medium", F.col("equipment_id"), share, F.col("_kwh") * 0.1 * RATE))

    by_type = per_device.groupBy("store_id").agg(
        money_sum("_kwh").alias("_total"),
        F.coalesce(money_sum(F.when(F.col("equipment_type") == "hvac", F.col("_kwh"))), F.lit(0.0)).alias("_hvac"),
    )
    hvac_share = safe_div("_hvac", "_total")
    hvac = by_type.where(hvac_share > 0.5).select(
        *shape("hvac_optimization", "high", nobody, hvac_share, F.col("_hvac") * 0.15 * RATE)
    )

    def week_split(df: DataFrame, day: str, value: str, prefix: str) -> DataFrame:
        per_dow = df.groupBy("store_id", sunday_dow(day).alias("dow")).agg(
            (money_sum(value) / F.count(F.lit(1))).alias("_m")
        )
        weekend = F.col("dow").isin(0, 6)
        return per_dow.groupBy("store_id").agg(
            F.avg(F.when(~weekend, F.col("_m"))).alias(f"{prefix}_wd"), F.avg(F.when(weekend, F.col("_m"))).alias(f"{prefix}_we")
        )

    use = week_split(period, "energy_date", "total_kwh", "e")
    trade = week_split(between_dates(sales, "sale_date", start, end), "sale_date", "total_amount", "s")
    idle = (
        use.join(trade, "store_id")
        .where((F.col("e_wd") > 0) & (F.try_divide("e_we", "e_wd") > 0.85))
        .where((F.col("s_wd") > 0) & (F.try_divide("s_we", "s_wd") < 0.7))
    )
    saving = F.greatest(F.lit(0.0), (F.col("e_we") - F.col("e_wd") * 0.7) * 2 * 4 * RATE)
    weekend = idle.select(
        *shape("weekend_optimization", "medium", nobody, F.try_divide("e_we", "e_wd"), saving)
    )
    return reduce(DataFrame.unionByName, [shifting, loaded, hvac, weekend])


def budget_alerts(daily: DataFrame, budgets: DataFrame, month: str) -> DataFrame:
    """Stores at or over their budget (critical) or its warning share in a month."""
    first = F.lit(f"{month}-01").cast("date")
    # A closed range of dates reaches the scan; a formatted month would not.
    used = (
        daily.where((F.col("energy_date") >= first) & (F.col("energy_date") < F.add_months(first, 1)))
        .groupBy("store_id")
        .agg(money_sum("total_kwh").alias("metric_value"))
    )
    rows = budgets.where(F.col("year_month") == month).join(used, "store_id", "left").fillna(0.0, ["metric_value"])
    pct = safe_div(F.col("metric_value") * 100.0, "budget_kwh")
    over = pct >= 100
    return rows.where(over | (pct >= F.col("alert_threshold_pct"))).select(
        "store_id",
        F.lit("budget_exceeded").alias("alert_type"),
        F.when(over, "critical").otherwise("warning").alias("alert_level"),
        "metric_value",
        F.when(over, F.col("budget_kwh")).otherwise(F.col("budget_kwh") * F.col("alert_threshold_pct") / 100).alias(
            "threshold_value"
        ),
        round_to(pct, 1).alias("usage_pct"),
    )


def list_energy_alerts(alerts: DataFrame, acknowledged: bool | None = None, top: int = 100) -> DataFrame:
    rows = where_optional(alerts, is_acknowledged=acknowledged)
    return top_k(rows, [F.desc("alert_time"), F.asc("store_id"), F.asc_nulls_first("equipment_id")], top)


def list_budgets(budgets: DataFrame, year_month: str | None = None) -> DataFrame:
    return where_optional(budgets, year_month=year_month).orderBy("store_id", F.desc("year_month"))


def list_schedules(schedules: DataFrame) -> DataFrame:
    return schedules.where("is_active").orderBy("store_id", "equipment_id", "day_of_week", "start_hour")
