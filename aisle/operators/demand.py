"""Demand forecast with external market signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aisle.functions.listing import top_k
from aisle.functions.scalars import clamp, money_sum, round_to
from aisle.functions.scope import match_or_null, scope_stores, where_optional
from aisle.sources.sinks import merge_rows

# Weights of a store without its own row.
DEFAULT_INTERNAL = 0.7
DEFAULT_EXTERNAL = 0.3


def signal_factor() -> Column:
    """Multiplier of one signal row."""
    v, c = F.col("value"), F.coalesce("confidence", F.lit(1.0))
    price = F.when(v > 1.1, 1.0 + F.least(F.lit(0.10), (v - 1.0) * 0.1) * c).when(
        v < 0.9, 1.0 - F.least(F.lit(0.10), (1.0 - v) * 0.1) * c
    ).otherwise(1.0)
    kind = F.col("signal_type")
    return (
        F.when(kind == "competitor_price", price)
        .when(kind == "market_trend", 1.0 + (v - 1.0) * 0.3 * c)
        .when(kind == "sentiment", 1.0 + v * 0.08 * c)
        .otherwise(1.0)
    )


def external_factor(signals: DataFrame, category: str | None = None) -> DataFrame:
    """Product of the day's signal multipliers, kept within 0.5 and 1.5.

    The product is a sum of logarithms, so it combines before the shuffle; sign
    and zeros are carried beside.
    """
    rows = signals if category is None else match_or_null(signals, "category", category)
    f = F.col("_f")
    size = F.exp(F.sum(F.when(f != 0, F.log(F.abs(f))).otherwise(0.0)))
    sign = F.when(F.count_if(f == 0) > 0, 0.0).when(F.count_if(f < 0) % 2 == 1, -1.0).otherwise(1.0)
    return (
        rows.withColumn("_f", signal_factor())
        .groupBy(F.col("signal_date").alias("date"))
        .agg(clamp(size * sign, 0.5, 1.5).alias("external_factor"))
    )


def baseline_forecast(
    sales: DataFrame, as_of: str, periods: int = 30, stores: DataFrame | None = None
) -> DataFrame:
    """Mean of the last 30 sale days with a small weekly trend. Stores without sales forecast zero."""
    today = F.lit(as_of).cast("date")
    recent = sales.where(F.col("sale_date") >= F.date_sub(today, 90))
    daily = recent.groupBy("store_id", "sale_date").agg(money_sum("total_amount").alias("v"))
    back = Window.partitionBy("store_id").orderBy(F.desc("sale_date"))
    ranked = daily.withColumn("r", F.row_number().over(back))
    upto = lambda lo, hi: F.when(F.col("r").between(lo, hi), F.col("v"))
    facts = ranked.groupBy("store_id").agg(
        F.avg(upto(1, 30)).alias("_mean"),
        F.stddev_pop(upto(1, 30)).alias("_std"),
        F.when(F.count(F.lit(1)) >= 14, F.avg(upto(1, 7)) - F.avg(upto(8, 14))).otherwise(0.0).alias("_trend"),
    )
    if stores is not None:
        facts = stores.select(F.col("id").alias("store_id")).join(facts, "store_id", "left").fillna(0.0)
    step = F.col("step")
    value = F.greatest(F.lit(0.0), F.col("_mean") + F.col("_trend") * step * 0.1)
    margin = F.col("_std") * 1.96 * F.sqrt(1 + (step - 1) * 0.05)
    return (
        facts.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(periods))))
        .withColumn("_value", value)
        .select(
            "store_id",
            F.date_add(today, step).alias("date"),
            round_to("_value", 2).alias("forecast"),
            round_to(F.greatest(F.lit(0.0), F.col("_value") - margin), 2).alias("lower"),
            round_to(F.col("_value") + margin, 2).alias("upper"),
        )
    )


def with_model_weights(df: DataFrame, configs: DataFrame) -> DataFrame:
    """Each store's ensemble weights, or the defaults."""
    own = configs.where(F.col("model_name") == "ensemble").select(
        "store_id", F.col("weight_internal").cast("double").alias("_wi"), F.col("weight_external").cast("double").alias("_we")
    )
    return (
        df.join(own, "store_id", "left")
        .withColumn("weight_internal", F.coalesce("_wi", F.lit(DEFAULT_INTERNAL)))
        .withColumn("weight_external", F.coalesce("_we", F.lit(DEFAULT_EXTERNAL)))
        .drop("_wi", "_we")
    )


def enhanced_forecast(
    baseline: DataFrame, signals: DataFrame, configs: DataFrame, as_of: str, periods: int = 30, category=None
) -> DataFrame:
    """Baseline blended with its signal-adjusted value; the interval widens with the external weight."""
    today = F.lit(as_of).cast("date")
    window = signals.where(F.col("signal_date").between(today, F.date_add(today, periods)))
    rows = with_model_weights(baseline, configs).join(external_factor(window, category), "date", "left")
    factor = F.coalesce("external_factor", F.lit(1.0))
    base = F.col("forecast")
    blended = F.col("weight_internal") * base + F.col("weight_external") * (base * factor)
    margin = (F.col("upper") - base) * (1.0 + F.col("weight_external") * 0.15)
    return rows.withColumn("_v", blended).withColumn("_m", margin).select(
        "store_id",
        "date",
        round_to("_v", 2).alias("forecast"),
        round_to(F.greatest(F.lit(0.0), F.col("_v") - F.col("_m")), 2).alias("lower"),
        round_to(F.col("_v") + F.col("_m"), 2).alias("upper"),
        round_to(factor, 4).alias("external_factor"),
    )


def signals_used(signals: DataFrame, as_of: str, periods: int = 30) -> DataFrame:
    """Signal types of the horizon, when any day's factor differs from one."""
    today = F.lit(as_of).cast("date")
    window = signals.where(F.col("signal_date").between(today, F.date_add(today, periods)))
    moved = external_factor(window).where(F.col("external_factor") != 1.0).agg(F.count(F.lit(1)).alias("_n"))
    return window.select("signal_type").distinct().join(F.broadcast(moved)).where(F.col("_n") > 0).drop("_n")


def forecast_comparison(baseline: DataFrame, enhanced: DataFrame) -> DataFrame:
    names = ["forecast", "lower", "upper"]
    return baseline.select("store_id", "date", *[F.col(c).alias(f"baseline_{c}") for c in names]).join(
        enhanced.select("store_id", "date", *[F.col(c).alias(f"enhanced_{c}") for c in names]), ["store_id", "date"]
    )


def tune_weights(sales: DataFrame, signals: DataFrame, configs: DataFrame, as_of: str) -> DataFrame:
    """Move each store's external weight by how the signals would have done over 30 days.

    Stores with fewer than 14 sale days stay as they are and give no row.
    """
    today = F.lit(as_of).cast("date")
    start = F.date_sub(today, 30)
    daily = (
        sales.where(F.col("sale_date").between(start, today))
        .groupBy("store_id", "sale_date")
        .agg(money_sum("total_amount").alias("v"))
    )
    key = Window.partitionBy("store_id")
    rows = (
        daily.withColumn("_n", F.count(F.lit(1)).over(key))
        .withColumn("_mean", F.sum(F.col("v").cast("decimal(18,4)")).over(key).cast("double") / F.col("_n"))
        .where(F.col("_n") >= 14)
    )
    factors = external_factor(signals.where(F.col("signal_date").between(start, today)))
    rows = with_model_weights(rows, configs).join(factors, F.col("sale_date") == F.col("date"), "left")
    guess = F.col("weight_internal") * F.col("_mean") + F.col("weight_external") * F.col("_mean") * F.coalesce(
        "external_factor", F.lit(1.0)
    )
    share = lambda p: F.avg(F.abs(F.col("v") - p) / F.greatest(F.col("v"), F.lit(1.0))) * 100
    facts = rows.groupBy("store_id").agg(
        share(F.col("_mean")).alias("_base"),
        share(guess).alias("_enh"),
        F.max("weight_external").alias("_old"),
        F.count(F.lit(1)).alias("sample_size"),
    )
    new = (
        F.when(F.col("_enh") < F.col("_base") - 2, F.least(F.lit(0.5), F.col("_old") + 0.05))
        .when(F.col("_enh") > F.col("_base"), F.greatest(F.lit(0.1), F.col("_old") - 0.05))
        .otherwise(F.col("_old"))
    )
    return facts.select(
        "store_id",
        round_to("_base", 2).alias("baseline_mape"),
        round_to("_enh", 2).alias("enhanced_mape"),
        F.col("_old").alias("weight_external_before"),
        new.alias("weight_external_after"),
        "sample_size",
    )


def accuracy_rows(tuned: DataFrame, as_of: str) -> DataFrame:
    """Two log rows per tuned store."""
    pair = F.array(
        F.struct(F.lit("baseline").alias("model_name"), F.col("baseline_mape").alias("mape")),
        F.struct(F.lit("enhanced").alias("model_name"), F.col("enhanced_mape").alias("mape")),
    )
    return tuned.select("store_id", "sample_size", F.explode(pair).alias("p")).select(
        "store_id", "p.model_name", F.lit(as_of).cast("date").alias("evaluation_date"),
        F.lit(30).alias("forecast_horizon"), "p.mape", F.lit(0.0).alias("rmse"), "sample_size",
    )


def tuned_configs(configs: DataFrame, tuned: DataFrame) -> DataFrame:
    """Config table after tuning; only changed stores are written."""
    changed = tuned.where(F.col("weight_external_after") != F.col("weight_external_before")).select(
        "store_id",
        F.lit("ensemble").alias("model_name"),
        (1 - F.col("weight_external_after")).alias("weight_internal"),
        F.col("weight_external_after").alias("weight_external"),
    )
    return merge_rows(configs, changed, ["store_id", "model_name"], ["weight_internal", "weight_external"])


def ingest_signals(signals: DataFrame, batch: DataFrame) -> DataFrame:
    """Signal table after an upsert on type, date and region."""
    return merge_rows(
        signals, batch, ["signal_type", "signal_date", "region"], ["value", "raw_value", "confidence"]
    )


def accuracy_history(log: DataFrame, as_of: str, days: int = 90, store_ids=None, model_name=None) -> DataFrame:
    rows = scope_stores(log, store_ids).where(
        F.col("evaluation_date") >= F.date_sub(F.lit(as_of).cast("date"), days)
    )
    return where_optional(rows, model_name=model_name).orderBy(F.desc("evaluation_date"), "store_id", "model_name")


def list_signals(signals: DataFrame, region=None, signal_type=None, start=None, end=None, top: int = 100) -> DataFrame:
    rows = where_optional(signals, region=region, signal_type=signal_type)
    if start:
        rows = rows.where(F.col("signal_date") >= F.lit(start))
    if end:
        rows = rows.where(F.col("signal_date") <= F.lit(end))
    return top_k(rows, [F.desc("signal_date"), F.asc("id")], top)


def list_experiments(experiments: DataFrame, store_ids=None, status=None) -> DataFrame:
    return where_optional(scope_stores(experiments, store_ids), status=status).orderBy(F.desc("created_at"), "id")
