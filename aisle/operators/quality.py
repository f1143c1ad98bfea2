"""Data-quality scores, checks and alerts. Each dimension is one pass over its table."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aisle.functions.listing import page
from aisle.functions.scalars import round_to
from aisle.functions.scope import scope_stores, where_optional
from aisle.session import cut_lineage
from aisle.sources import hadoop
from aisle.sources.sinks import append_facts, upsert

FRESH_DAYS = 2
# Dimension weights of the overall score.
WEIGHTS = {"completeness": 0.35, "accuracy": 0.40, "timeliness": 0.25}
ALERT_RATE, CRITICAL_RATE = 0.15, 0.3


@dataclass
class Target:
    """A table to check: its rows, date column, nullable columns and violation rules."""

    name: str
    df: DataFrame
    date_col: str
    columns: list[str]
    rules: dict[str, Column] = field(default_factory=dict)


def default_rules(name: str) -> dict[str, Column]:
    c = F.col
    return {
        "sales": {
            "negative_amount": c("total_amount") < 0,
            "negative_quantity": c("quantity") <= 0,
            "price_outlier": c("unit_price") > 100000,
        },
        "inventory": {"negative_stock": c("quantity") < 0, "min_exceeds_max": c("min_stock") > c("max_stock")},
        "traffic": {"negative_count": c("enter_count") < 0, "extreme_count": c("enter_count") > 100000},
    }.get(name, {})


def _upto(target: Target, check_date: str, store_ids=None) -> DataFrame:
    return scope_stores(target.df, store_ids).where(
        F.to_date(target.date_col) <= F.lit(check_date).cast("date")
    )


def completeness(target: Target, check_date: str, store_ids=None) -> DataFrame:
    """Score row: share of filled cells over all columns of the target."""
    columns = target.columns
    nulls = [F.count_if(F.col(c).isNull()).alias(f"_n{i}") for i, c in enumerate(columns)]
    facts = _upto(target, check_date, store_ids).agg(F.count(F.lit(1)).alias("total_records"), *nulls)
    failed = reduce(lambda a, b: a + b, [F.col(f"_n{i}") for i in range(len(columns))], F.lit(0).cast("long"))
    cells = F.col("total_records") * len(columns)
    score = F.when(cells > 0, (1 - failed / cells) * 100).otherwise(100.0)
    return _score_row(facts, target.name, "completeness", score, failed, check_date)


def completeness_columns(target: Target, check_date: str, store_ids=None) -> DataFrame:
    """Null count and rate of each checked column that has nulls."""
    columns = target.columns
    facts = _upto(target, check_date, store_ids).agg(
        F.count(F.lit(1)).alias("_total"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns]
    )
    long = facts.unpivot("_total", columns, "column_name", "null_count")
    return long.where(F.col("null_count") > 0).select(
        F.lit(target.name).alias("target_table"), "column_name", "null_count",
        round_to(F.col("null_count") / F.col("_total"), 4).alias("null_rate"),
    )


def accuracy(target: Target, check_date: str, store_ids=None) -> DataFrame:
    rules = list(target.rules.values())
    facts = _upto(target, check_date, store_ids).agg(
        F.count(F.lit(1)).alias("total_records"), *[F.count_if(r).alias(f"_r{i}") for i, r in enumerate(rules)]
    )
    failed = reduce(lambda a, b: a + b, [F.col(f"_r{i}") for i in range(len(rules))], F.lit(0).cast("long"))
    score = F.when(F.col("total_records") == 0, 100.0).otherwise(
        (1 - failed / F.greatest(F.col("total_records"), F.lit(1))) * 100
    )
    return _score_row(facts, target.name, "accuracy", F.least(score, F.lit(100.0)), failed, check_date)


def accuracy_rules(target: Target, check_date: str, store_ids=None) -> DataFrame:
    """Violations and rate of each rule that is broken."""
    facts = _upto(target, check_date, store_ids).agg(
        F.count(F.lit(1)).alias("_total"), *[F.count_if(r).alias(n) for n, r in target.rules.items()]
    )
    long = facts.unpivot("_total", list(target.rules), "rule", "violations")
    return long.where(F.col("violations") > 0).select(
        F.lit(target.name).alias("target_table"), "rule", "violations",
        round_to(F.col("violations") / F.col("_total"), 4).alias("rate"),
    )


def timeliness(target: Target, check_date: str, store_ids=None) -> DataFrame:
    """100 up to two days of age, 15 points less a day after that, 0 without data."""
    facts = scope_stores(target.df, store_ids).agg(F.to_date(F.max(target.date_col)).alias("_newest"))
    age = F.datediff(F.lit(check_date).cast("date"), "_newest")
    score = (
        F.when(F.col("_newest").isNull(), 0.0)
        .when(age <= FRESH_DAYS, 100.0)
        .otherwise(F.greatest(F.lit(0.0), 100.0 - (age - FRESH_DAYS) * 15))
    )
    rows = facts.withColumn("total_records", F.when(F.col("_newest").isNull(), 0).otherwise(1).cast("long"))
    failed = F.when(age > FRESH_DAYS, 1).otherwise(0).cast("long")
    return _score_row(rows, target.name, "timeliness", score, failed, check_date)


def _score_row(facts: DataFrame, table: str, dimension: str, score: Column, failed: Column, day: str) -> DataFrame:
    return facts.select(
        F.lit(table).alias("target_table"),
        F.lit(dimension).alias("dimension"),
        F.greatest(F.lit(0.0), round_to(score, 2)).alias("score"),
        "total_records",
        failed.alias("failed_records"),
        F.lit(day).cast("date").alias("score_date"),
    )


def table_scores(target: Target, check_date: str, store_ids=None) -> DataFrame:
    """The three score rows of a table from one scan."""
    day = F.lit(check_date).cast("date")
    due = F.to_date(target.date_col) <= day
    columns, rules = target.columns, list(target.rules.values())
    counts = scope_stores(target.df, store_ids).agg(
        F.count_if(due).alias("_n"),
        F.to_date(F.max(target.date_col)).alias("_newest"),
        *[F.count_if(due & F.col(c).isNull()).alias(f"_c{i}") for i, c in enumerate(columns)],
        *[F.count_if(due & r).alias(f"_r{i}") for i, r in enumerate(rules)],
    )
    zero = F.lit(0).cast("long")
    nulls = reduce(lambda a, b: a + b, [F.col(f"_c{i}") for i in range(len(columns))], zero)
    broken = reduce(lambda a, b: a + b, [F.col(f"_r{i}") for i in range(len(rules))], zero)
    n, cells = F.col("_n"), F.col("_n") * len(columns)
    age = F.datediff(day, "_newest")
    fresh = (
        F.when(F.col("_newest").isNull(), 0.0)
        .when(age <= FRESH_DAYS, 100.0)
        .otherwise(F.greatest(F.lit(0.0), 100.0 - (age - FRESH_DAYS) * 15))
    )
    one = F.when(F.col("_newest").isNull(), 0).otherwise(1).cast("long")
    row = lambda name, score, total, failed: F.struct(
        F.lit(name).alias("dimension"),
        F.greatest(F.lit(0.0), round_to(score, 2)).alias("score"),
        total.alias("total_records"),
        failed.alias("failed_records"),
    )
    rows = F.array(
        row("completeness", F.when(cells > 0, (1 - nulls / cells) * 100).otherwise(100.0), n, nulls),
        row("accuracy", F.when(n > 0, F.least((1 - broken / n) * 100, F.lit(100.0))).otherwise(100.0), n, broken),
        row("timeliness", fresh, one, F.when(age > FRESH_DAYS, 1).otherwise(0).cast("long")),
    )
    return counts.select(F.explode(rows).alias("_s")).select(
        F.lit(target.name).alias("target_table"), "_s.*", day.alias("score_date")
    )


def quality_scores(targets: list[Target], check_date: str, store_ids=None) -> DataFrame:
    """Table by dimension grid."""
    return reduce(DataFrame.unionByName, [table_scores(t, check_date, store_ids) for t in targets])


def health(scores: DataFrame, alerts: DataFrame | None = None) -> DataFrame:
    """Weighted overall score of the table means, with open and critical alert counts."""
    mean = lambda d: F.coalesce(F.avg(F.when(F.col("dimension") == d, F.col("score"))), F.lit(100.0))
    means = scores.agg(*[mean(d).alias(f"_{d}") for d in WEIGHTS])
    overall = (
        F.col("_completeness") * WEIGHTS["completeness"]
        + F.col("_accuracy") * WEIGHTS["accuracy"]
        + F.col("_timeliness") * WEIGHTS["timeliness"]
    )
    out = means.select(
        round_to(overall, 2).alias("overall_score"), *[round_to(f"_{d}", 2).alias(f"{d}_score") for d in WEIGHTS]
    )
    if alerts is None:
        return out
    is_open = F.col("status") == "open"
    counts = alerts.agg(
        F.count_if(is_open).alias("alerts_open"),
        F.count_if(is_open & F.col("severity").isin("error", "critical")).alias("alerts_critical"),
    )
    return out.join(F.broadcast(counts))


def new_alerts(scores: DataFrame, alerts: DataFrame, now: str) -> DataFrame:
    """Alerts for fail rates over 15 %, unless an open one of the last day exists.

    The completeness rate counts null cells per row and can pass one; ``cell_rate``
    in ``completeness_columns`` stays below.
    """
    moment = F.lit(now).cast("timestamp")
    rate = F.col("failed_records") / F.greatest(F.col("total_records"), F.lit(1))
    recent = alerts.where(
        (F.col("status") == "open") & (F.col("created_at") > moment - F.expr("interval 24 hours"))
    ).select("target_table", "dimension")
    return (
        scores.withColumn("_rate", rate)
        .where(F.col("_rate") > ALERT_RATE)
        .join(recent, ["target_table", "dimension"], "left_anti")
        .select(
            "target_table",
            "dimension",
            F.when(F.col("_rate") > CRITICAL_RATE, "critical").otherwise("error").alias("severity"),
            round_to("_rate", 4).alias("metric_value"),
            F.lit(ALERT_RATE).alias("threshold_value"),
            F.lit("open").alias("status"),
            moment.alias("created_at"),
        )
    )


def run_summary(scores: DataFrame, raised: DataFrame) -> DataFrame:
    """One row per check run; only alerts that were really added count."""
    facts = scores.agg(
        F.count(F.lit(1)).alias("rules_checked"),
        round_to(F.coalesce(F.avg("score"), F.lit(100.0)), 2).alias("overall_score"),
    )
    return facts.join(F.broadcast(raised.agg(F.count(F.lit(1)).alias("alerts_generated"))))


ALERTS = "target_table string, dimension string, severity string, metric_value double, threshold_value double, status string, created_at timestamp"
SCORE_KEYS = ["target_table", "dimension", "score_date"]


def run_checks(targets: list[Target], root: str, now: str, store_ids=None) -> DataFrame:
    """One check run over all tables: scores of the day upserted, new alerts appended, a run row appended; returns the run row.

    Tables ``scores``, ``alerts`` and ``runs`` lie under ``root``. A second run of a day refreshes score, total and failed
    records and leaves the rest of a score row; it raises no alert again that is open for less than a day.
    """
    spark = targets[0].df.sparkSession
    place = {name: f"{root.rstrip('/')}/{name}" for name in ("scores", "alerts", "runs")}
    scores = cut_lineage(quality_scores(targets, now[:10], store_ids), "scores")
    known = spark.read.schema(ALERTS).parquet(place["alerts"]) if hadoop.exists(spark, place["alerts"]) else spark.createDataFrame([], ALERTS)
    raised = cut_lineage(new_alerts(scores, known, now), "alerts")
    passed = scores.withColumn("passed_records", F.col("total_records") - F.col("failed_records"))
    upsert(place["scores"], passed, SCORE_KEYS, ["score", "total_records", "failed_records"], ["score_date"])
    append_facts(raised, place["alerts"])
    moment = F.lit(now).cast("timestamp_ntz")
    run = cut_lineage(run_summary(scores, raised).select(moment.alias("started_at"), F.lit("completed").alias("status"), "*"), "run")
    append_facts(run, place["runs"])
    return run


def score_trend(scores: DataFrame, as_of: str, days: int = 30, target_table=None, store_ids=None) -> DataFrame:
    rows = where_optional(scope_stores(scores, store_ids), target_table=target_table).where(
        F.col("score_date") >= F.date_sub(F.lit(as_of).cast("date"), days)
    )
    return rows.groupBy("score_date", "dimension").agg(round_to(F.avg("score"), 2).alias("avg_score"))


def list_alerts(alerts: DataFrame, severity=None, status=None, page_no: int = 1, size: int = 20) -> DataFrame:
    rows = where_optional(alerts, severity=severity, status=status)
    return page(rows, [F.desc("created_at"), F.asc("target_table"), F.asc("dimension")], page_no, size)


def list_runs(runs: DataFrame, top: int = 20) -> DataFrame:
    return runs.orderBy(F.desc("started_at")).limit(top)
