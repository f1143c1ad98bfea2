"""Daily sales forecast: decomposition, holidays, promotions, weather, interval, back-test.

All stores go through one plan. A store has at most a year of daily rows, so the
windows below hold a bounded number of rows per key; after the one shuffle to
stores no step moves rows again until promotions and weather are joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aisle.functions.scalars import money_sum, round_to
from aisle.session import cut_lineage

PERIOD = 7
SMOOTHING_PASSES = 3
HALF = PERIOD // 2
MIN_ROWS = 14
HISTORY_DAYS = 365
DAMPING = 0.95
BASELINE_DAYS = 14
PROMO_HISTORY = 10
# Holidays as (month, day).
HOLIDAYS = [
    (1, 1), (1, 2), (1, 3),
    (2, 10), (2, 11), (2, 12), (2, 13), (2, 14), (2, 15), (2, 16),
    (4, 4), (4, 5), (4, 6),
    (5, 1), (5, 2), (5, 3), (5, 4), (5, 5),
    (6, 10), (6, 11), (6, 12),
    (9, 15), (9, 16), (9, 17),
    (10, 1), (10, 2), (10, 3), (10, 4), (10, 5), (10, 6), (10, 7),
]


def holiday_keys() -> list[str]:
    return [f"{month:02d}-{day:02d}" for month, day in HOLIDAYS]


def holiday_flag(day: Column) -> Column:
    """1.0 on a holiday, 0.5 on the day before or after one, else 0.0."""
    keys = holiday_keys()
    is_holiday = lambda d: F.date_format(d, "MM-dd").isin(keys)
    beside = is_holiday(F.date_add(day, 1)) | is_holiday(F.date_sub(day, 1))
    return F.when(is_holiday(day), 1.0).when(beside, 0.5).otherwise(0.0)


def daily_series(sales: DataFrame, as_of: str, by: str = "store_id", fill_gaps: bool = False) -> DataFrame:
    """Daily sums of the last 365 days with position ``i`` and length ``n`` per key.

    Days without sales have no row, so the weekly cycle counts rows; ``fill_gaps``
    puts zeros in their place. Keys with fewer than 14 rows give no forecast.
    """
    recent = sales.where(F.col("sale_date") >= F.date_sub(F.lit(as_of).cast("date"), HISTORY_DAYS))
    daily = recent.groupBy(by, "sale_date").agg(money_sum("total_amount").alias("value"))
    return series_of(daily, as_of, by, fill_gaps)


def series_of(daily: DataFrame, as_of: str, by: str = "store_id", fill_gaps: bool = False) -> DataFrame:
    """``daily_series`` from day totals that exist already."""
    daily = daily.where(F.col("sale_date") >= F.date_sub(F.lit(as_of).cast("date"), HISTORY_DAYS)).select(
        by, "sale_date", "value"
    )
    if fill_gaps:
        span = daily.groupBy(by).agg(F.min("sale_date").alias("_lo"), F.max("sale_date").alias("_hi"))
        calendar = span.select(by, F.explode(F.sequence("_lo", "_hi")).alias("sale_date"))
        daily = calendar.join(daily, [by, "sale_date"], "left").fillna(0.0, ["value"])
    return number_rows(daily, by).where(F.col("n") >= MIN_ROWS)


def number_rows(daily: DataFrame, by: str) -> DataFrame:
    key = Window.partitionBy(by)
    return daily.withColumn("i", F.row_number().over(key.orderBy("sale_date")) - 1).withColumn(
        "n", F.count(F.lit(1)).over(key)
    )


def decompose(series: DataFrame, by: str = "store_id") -> DataFrame:
    """Trend by three centred 7-row means, seasonal by row phase, and the rest."""
    rows = Window.partitionBy(by).orderBy("sale_date")
    near = rows.rowsBetween(-HALF, HALF)
    whole = rows.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # Past an end the first or last value stands in for the missing neighbours.
    short_left = F.greatest(F.lit(0), HALF - F.col("i"))
    short_right = F.greatest(F.lit(0), HALF - (F.col("n") - 1 - F.col("i")))
    out = series.withColumn("trend", F.col("value"))
    for _ in range(SMOOTHING_PASSES):
        padded = (
            F.sum("trend").over(near)
            + short_left * F.first("trend").over(whole)
            + short_right * F.last("trend").over(whole)
        )
        out = out.withColumn("_smooth", padded / PERIOD).drop("trend").withColumnRenamed("_smooth", "trend")
    key = Window.partitionBy(by)
    phase = F.col("i") % PERIOD
    rest = F.col("value") - F.col("trend")
    means = F.array(*[F.avg(F.when(phase == p, rest)).over(key) for p in range(PERIOD)])
    centre = F.aggregate("_means", F.lit(0.0), lambda a, x: a + x) / PERIOD
    return (
        out.withColumn("_means", means)
        .withColumn("_centre", centre)
        .withColumn("cycle", F.transform("_means", lambda m: m - F.col("_centre")))
        .withColumn("seasonal", F.col("cycle")[phase])
        .withColumn("residual", F.col("value") - F.col("trend") - F.col("seasonal"))
        .drop("_means", "_centre")
    )


def holiday_effect(value: Column, day: Column) -> Column:
    """Relative lift of full holidays over normal days, an aggregate; 0.25 on thin data."""
    flag = holiday_flag(day)
    full, normal = F.when(flag > 0.5, value), F.when(flag == 0, value)
    base = F.avg(normal)
    lift = F.when(base > 0, F.greatest((F.avg(full) - base) / base, F.lit(0.0))).otherwise(0.25)
    return F.when((F.count(full) < 3) | (F.count(normal) < 7), 0.25).otherwise(lift)


def model(parts: DataFrame, by: str = "store_id") -> DataFrame:
    """What the forecast needs of each key: level, slope, cycle, residual mean and spread."""
    from_end = F.col("n") - F.col("i")
    tail = lambda c, k: F.when(from_end <= k, F.col(c))
    return parts.groupBy(by).agg(
        F.max("n").alias("n"),
        F.max("sale_date").alias("last_date"),
        F.max(tail("trend", 1)).alias("trend_last"),
        F.regr_slope(tail("trend", 14), F.col("i").cast("double")).alias("slope"),
        F.max_by("cycle", "sale_date").alias("cycle"),
        F.avg(tail("residual", 14)).alias("residual_mean"),
        F.stddev_pop(tail("residual", 30)).alias("residual_std"),
        holiday_effect(F.col("value"), F.col("sale_date")).alias("holiday_effect"),
    )


def damped_trend(step: Column) -> Column:
    """Level after ``step`` (1..) with a slope that fades by 0.95 per step."""
    return F.col("trend_last") + F.col("slope") * (1 - F.pow(F.lit(DAMPING), step)) / (1 - DAMPING)


def project(fitted: DataFrame, periods: int) -> DataFrame:
    """Trend, cycle and residual mean for steps 1..periods, before any multiplier."""
    step = F.col("step").cast("double")
    cycle = F.col("cycle")[((F.col("n") + F.col("step") - 1) % PERIOD).cast("int")]
    return fitted.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(periods)))).withColumn(
        "base", damped_trend(step) + cycle + F.col("residual_mean")
    )


def promo_lift(daily: DataFrame, promotions: DataFrame, per_line: bool = False) -> DataFrame:
    """Mean lift of the newest completed promotions per store and type over the 14 days before.

    Promotion windows are short, so their days are listed and met with the daily
    totals by equality. ``daily`` needs store, date, total and lines. By default
    day totals are compared; ``per_line`` takes the mean sale line of the promotion.
    """
    done = promotions.where(F.col("status") == "completed")
    days = done.select(
        "id", "store_id", "promo_type", "start_date", "end_date",
        F.explode(F.sequence(F.date_sub("start_date", BASELINE_DAYS), F.col("end_date"))).alias("sale_date"),
    )
    inside = F.col("sale_date") >= F.col("start_date")
    total = lambda cond: F.sum(F.when(cond, F.col("value").cast("decimal(18,4)"))).cast("double")
    per_promo = (
        days.join(daily, ["store_id", "sale_date"])
        .groupBy("id", "store_id", "promo_type", "end_date")
        .agg(
            total(inside).alias("_sum"),
            F.sum(F.when(inside, F.col("lines"))).alias("_lines"),
            F.count(F.when(inside, 1)).alias("_days"),
            (total(~inside) / F.count(F.when(~inside, 1))).alias("_before"),
        )
        .where(F.col("_days") > 0)
    )
    mean = F.col("_sum") / (F.col("_lines") if per_line else F.col("_days"))
    newest = Window.partitionBy("store_id").orderBy(F.desc("end_date"), F.desc("id"))
    lift = F.greatest((mean - F.col("_before")) / F.col("_before"), F.lit(0.0))
    return (
        per_promo.withColumn("_rank", F.row_number().over(newest))
        .where((F.col("_rank") <= PROMO_HISTORY) & (F.col("_before") > 0) & (mean != 0))
        .groupBy("store_id", "promo_type")
        .agg(round_to(F.avg(lift), 3).alias("lift"))
    )


def promo_factors(promotions: DataFrame, lifts: DataFrame, as_of: str) -> DataFrame:
    """Multiplier per store and future day from active promotions; several multiply."""
    rate, amount = F.col("discount_rate"), F.col("discount_amount")
    guess = F.when(rate > 0, F.least(rate * 0.8, F.lit(0.6))).when(amount > 0, 0.15).otherwise(0.10)
    running = promotions.where(
        (F.col("status") == "active") & (F.col("end_date") >= F.lit(as_of).cast("date"))
    ).join(lifts, ["store_id", "promo_type"], "left")
    length = F.greatest(F.datediff("end_date", "start_date") + 1, F.lit(1))
    into = F.datediff("date", "start_date")
    decay = F.greatest(1.0 - 0.3 * (into / length), F.lit(0.5))
    days = running.withColumn("date", F.explode(F.sequence("start_date", "end_date")))
    return days.groupBy("store_id", "date").agg(
        F.exp(F.sum(F.log(1.0 + F.coalesce("lift", guess) * decay))).alias("promo_factor")
    )


def weather_factor(rain: Column, high: Column) -> Column:
    wet, heat = F.coalesce(rain, F.lit(0.0)), F.coalesce(F.nullif(high, F.lit(0.0)), F.lit(25.0))
    by_rain = F.when(wet > 30, 0.80).when(wet > 15, 0.88).when(wet > 5, 0.94).otherwise(1.0)
    return by_rain * F.when((heat > 38) | (heat < -5), 0.90).otherwise(1.0)


def weather_factors(weather: DataFrame, stores: DataFrame, as_of: str, periods: int, positional: bool = False) -> DataFrame:
    """Factor per store and date; ``positional`` numbers the days after ``as_of`` instead."""
    today = F.lit(as_of).cast("date")
    future = weather.where(
        (F.col("weather_date") > today) & (F.col("weather_date") <= F.date_add(today, HISTORY_DAYS))
    ).select("city", "weather_date", weather_factor(F.col("precipitation"), F.col("temp_high")).alias("weather_factor"))
    cities = stores.select(F.col("id").alias("store_id"), "city")
    if positional:
        order = Window.partitionBy("city").orderBy("weather_date")
        future = future.withColumn("step", F.row_number().over(order)).where(F.col("step") <= periods)
        return cities.join(future, "city").select("store_id", "step", "weather_factor")
    return cities.join(future.withColumnRenamed("weather_date", "date"), "city").select(
        "store_id", "date", "weather_factor"
    )


def sales_forecast(
    sales: DataFrame, as_of: str, periods: int = 30, promotions: DataFrame | None = None,
    weather: DataFrame | None = None, stores: DataFrame | None = None,
    positional_weather: bool = False, per_line_lift: bool = False,
) -> DataFrame:
    """Forecast and interval per store and day: holidays, promotions, weather, floor at zero."""
    if promotions is None:
        series = daily_series(sales, as_of)
    else:
        # Day totals serve the series and the promotion history: one scan of the sales.
        daily = cut_lineage(
            sales.groupBy("store_id", "sale_date").agg(
                money_sum("total_amount").alias("value"), F.count(F.lit(1)).alias("lines")
            ),
            "daily",
        )
        series = series_of(daily, as_of)
    fitted = model(decompose(series))
    grid = project(fitted, periods).withColumn("date", F.date_add("last_date", F.col("step")))
    flag = holiday_flag(F.col("date"))
    grid = grid.withColumn("is_holiday", flag > 0).withColumn(
        "value", F.col("base") * F.when(flag > 0, 1.0 + F.col("holiday_effect") * flag).otherwise(1.0)
    )
    if promotions is not None:
        factors = promo_factors(promotions, promo_lift(daily, promotions, per_line_lift), as_of)
        grid = grid.join(factors, ["store_id", "date"], "left").withColumn(
            "value", F.col("value") * F.coalesce("promo_factor", F.lit(1.0))
        )
    if weather is not None and stores is not None:
        factors = weather_factors(weather, stores, as_of, periods, positional_weather)
        on = ["store_id", "step" if positional_weather else "date"]
        grid = grid.join(factors, on, "left").withColumn(
            "value", F.col("value") * F.coalesce("weather_factor", F.lit(1.0))
        )
    value = F.greatest(F.col("value"), F.lit(0.0))
    margin = F.col("residual_std") * 1.96 * F.sqrt(F.col("step") * 0.08 + 1)
    return grid.withColumn("value", value).select(
        "store_id", "step", "date",
        round_to("value", 2).alias("forecast"),
        round_to(F.greatest(F.col("value") - margin, F.lit(0.0)), 2).alias("lower"),
        round_to(F.col("value") + margin, 2).alias("upper"),
        "is_holiday",
    )


def backtest(series: DataFrame, by: str = "store_id", window: int = PERIOD) -> DataFrame:
    """Forecast the last ``window`` rows from the ones before; MAPE and RMSE per key with 4 windows of rows."""
    enough = series.where(F.col("n") >= window * 4)
    train = enough.where(F.col("i") < F.col("n") - window).withColumn("n", F.col("n") - window)
    test = enough.where(F.col("i") >= F.col("n") - window).select(
        by, "sale_date", F.col("value").alias("actual"), (F.col("i") - F.col("n") + window + 1).cast("int").alias("step")
    )
    guess = project(model(decompose(train, by), by), window).select(by, "step", "base", "holiday_effect")
    flag = holiday_flag(F.col("sale_date"))
    value = F.greatest(
        F.col("base") * F.when(flag > 0, 1.0 + F.col("holiday_effect") * flag).otherwise(1.0), F.lit(0.0)
    )
    error = F.abs(value - F.col("actual"))
    scored = test.join(guess, [by, "step"])
    return scored.groupBy(by).agg(
        round_to(F.avg(error / F.when(F.col("actual") > 0, F.col("actual")).otherwise(1.0)) * 100, 2).alias("mape"),
        round_to(F.sqrt(F.avg(error * error)), 2).alias("rmse"),
    )
