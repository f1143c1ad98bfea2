"""Employee scores, ranking, trend and peer comparison."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aisle.functions import ordered
from aisle.functions.listing import global_rank, top_k
from aisle.functions.scalars import clamp, money_sum, round_to
from aisle.functions.scope import scope_stores, where_optional
from aisle.session import cut_lineage

PARTS = ["sales", "service", "attendance", "training"]
# Weights of a store without its own row.
DEFAULT_WEIGHTS = {"sales": 0.40, "service": 0.25, "attendance": 0.20, "training": 0.15}

Periods = list[tuple[str, str, str]]


def _period_array(periods: Periods) -> Column:
    return F.array(
        *[
            F.struct(
                F.lit(label).alias("period"), F.lit(lo).cast("date").alias("lo"), F.lit(hi).cast("date").alias("hi")
            )
            for label, lo, hi in periods
        ]
    )


def _in_periods(df: DataFrame, date_col: str, periods: Periods) -> DataFrame:
    """Each row once per period that holds its date; periods may share a border day."""
    first, last = min(p[1] for p in periods), max(p[2] for p in periods)
    day = F.col(date_col)
    hits = F.filter(_period_array(periods), lambda p: (p["lo"] <= day) & (day <= p["hi"]))
    return df.where(day.between(F.lit(first), F.lit(last))).withColumn("period", F.explode(hits["period"]))


def sales_score(employees: DataFrame, records: DataFrame, periods: Periods) -> DataFrame:
    """Share of store peers with strictly lower revenue, in percent; 75 with one peer, 50 with none."""
    rows = _in_periods(records, "record_date", periods)
    by_store = rows.groupBy("period", "store_id", "employee_id").agg(money_sum("revenue").alias("_v"))
    own = by_store.groupBy("period", "employee_id").agg(money_sum("_v").alias("_own"))
    staff = (
        employees.select(F.col("id").alias("employee_id"), "store_id")
        .withColumn("period", F.explode(_period_array(periods)["period"]))
        .join(own, ["period", "employee_id"], "left")
        .select("period", "store_id", "employee_id", F.coalesce("_own", F.lit(0.0)).alias("_v"), F.lit(0).alias("_peer"))
    )
    group = ["period", "store_id"]
    peers = by_store.withColumn("_peer", F.lit(1))
    everyone = staff.unionByName(peers)
    lower = ordered.lower_totals(everyone, group, "_v", "_peer", "_lower")
    size = peers.groupBy(*group).agg(F.count(F.lit(1)).alias("_peers"))
    ranked = staff.join(lower, [*group, "_v"]).join(size, group, "left").fillna(0, ["_peers"])
    score = (
        F.when(F.col("_peers") == 0, 50.0)
        .when(F.col("_peers") == 1, 75.0)
        .otherwise(F.col("_lower") / F.col("_peers") * 100)
    )
    return ranked.select("period", "employee_id", score.alias("sales_score"))


def _home_rows(df: DataFrame, employees: DataFrame) -> DataFrame:
    home = employees.select(F.col("id").alias("employee_id"), "store_id")
    return df.join(home, ["employee_id", "store_id"], "left_semi")


def service_score(employees: DataFrame, records: DataFrame, periods: Periods) -> DataFrame:
    rows = _in_periods(_home_rows(records, employees), "record_date", periods)
    facts = rows.groupBy("period", "employee_id").agg(
        (F.sum("customer_rating") / F.count("customer_rating")).alias("_rating"),
        F.sum("complaint_count").alias("_bad"),
        F.sum("praise_count").alias("_good"),
    )
    rating = F.coalesce(F.nullif("_rating", F.lit(0.0)), F.lit(3.0))
    score = rating / 5.0 * 80 + F.least(F.lit(20), F.col("_good") * 3) - F.least(F.lit(40), F.col("_bad") * 5)
    return facts.select("period", "employee_id", clamp(score, 0.0, 100.0).alias("service_score"))


def attendance_score(employees: DataFrame, attendance: DataFrame, periods: Periods) -> DataFrame:
    rows = _in_periods(_home_rows(attendance, employees), "attend_date", periods)
    facts = rows.groupBy("period", "employee_id").agg(
        F.sum("is_absent").alias("_absent"),
        F.sum("is_late").alias("_late"),
        F.greatest(
            F.lit(0.0),
            F.coalesce(F.sum("scheduled_hours"), F.lit(0.0)) - F.coalesce(F.sum("actual_hours"), F.lit(0.0)),
        ).alias("_missed"),
    )
    score = 100 - F.col("_absent") * 15 - F.col("_late") * 5 - F.col("_missed") * 2
    return facts.select("period", "employee_id", clamp(score, 0.0, 100.0).alias("attendance_score"))


def training_score(training: DataFrame, periods: Periods) -> DataFrame:
    rows = _in_periods(training, "scheduled_date", periods)
    done = F.col("completed") == 1
    facts = rows.groupBy("period", "employee_id").agg(
        (F.count_if(done) / F.count(F.lit(1))).alias("_rate"),
        F.try_divide(F.sum(F.when(done, F.col("score"))), F.count(F.when(done, F.col("score")))).alias("_score"),
    )
    score = F.col("_rate") * 70 + F.coalesce("_score", F.lit(0.0)) / 100 * 30
    return facts.select("period", "employee_id", score.alias("training_score"))


def with_weights(employees: DataFrame, weights: DataFrame) -> DataFrame:
    """Weights by store and position, else the store's default row, else the constants."""
    columns = [f"weight_{p}" for p in PARTS]
    exact = weights.select(
        "store_id",
        F.col("position").alias("_position"),
        F.struct(*columns).alias("_exact"),
    )
    default = weights.where(F.col("position") == "default").select("store_id", F.struct(*columns).alias("_default"))
    joined = (
        employees.withColumn("_position", F.coalesce("position", F.lit("default")))
        .join(exact, ["store_id", "_position"], "left")
        .join(default, "store_id", "left")
    )
    picked = F.coalesce("_exact", "_default")
    for part in PARTS:
        joined = joined.withColumn(
            f"weight_{part}", F.coalesce(picked[f"weight_{part}"].cast("double"), F.lit(DEFAULT_WEIGHTS[part]))
        )
    return joined.drop("_position", "_exact", "_default")


def employee_scores(
    employees: DataFrame, sales: DataFrame, service: DataFrame, attendance: DataFrame, training: DataFrame,
    weights: DataFrame, periods: Periods,
) -> DataFrame:
    """All sub-scores and the composite of every employee and period, in one plan."""
    on = ["period", "employee_id"]
    base = with_weights(employees, weights).withColumnRenamed("id", "employee_id").withColumn(
        "period", F.explode(_period_array(periods)["period"])
    )
    rows = (
        base.join(sales_score(employees, sales, periods), on, "left")
        .join(service_score(employees, service, periods), on, "left")
        .join(attendance_score(employees, attendance, periods), on, "left")
        .join(training_score(training, periods), on, "left")
        .fillna({"sales_score": 50.0, "service_score": 60.0, "attendance_score": 70.0, "training_score": 70.0})
    )
    total = sum((F.col(f"weight_{p}") * F.col(f"{p}_score") for p in PARTS[1:]), F.col("weight_sales") * F.col("sales_score"))
    return rows.select(
        "period",
        "employee_id",
        F.col("name").alias("employee_name"),
        "position",
        "store_id",
        "is_active",
        round_to(total, 2).alias("composite_score"),
        *[round_to(f"{p}_score", 2).alias(f"{p}_score") for p in PARTS],
    )


def employee_ranking(scores: DataFrame, store_ids=None, position: str | None = None, top: int | None = 20) -> DataFrame:
    """Active employees by composite score; ``neighbour_trend`` compares with the row above, not with time."""
    rows = where_optional(scope_stores(scores.where("is_active"), store_ids), position=position)
    order = [F.desc("composite_score"), F.asc("employee_id")]
    if top is not None:
        best = top_k(rows, order, top)
        ranked = best.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))
    else:
        ranked = global_rank(rows, "composite_score", ["employee_id"])
    first_of_equals = F.row_number().over(Window.partitionBy("composite_score").orderBy("employee_id")) == 1
    return ranked.withColumn(
        "neighbour_trend",
        F.when(F.col("rank") == 1, "up").when(first_of_equals, "down").otherwise("stable"),
    ).drop("is_active", "period")


def month_periods(as_of: str, months: int = 6) -> Periods:
    """Windows of 30 days back from ``as_of``, oldest first."""
    today = date.fromisoformat(as_of)
    ends = [today - timedelta(days=30 * i) for i in range(months - 1, -1, -1)]
    return [(e.isoformat(), (e - timedelta(days=30)).isoformat(), e.isoformat()) for e in ends]


def employee_trend(scores: DataFrame) -> DataFrame:
    """Scores per window; build ``scores`` with ``month_periods``."""
    return scores.select(
        "employee_id", F.col("period").alias("window_end"), F.substring("period", 1, 7).alias("month"),
        "composite_score", *[f"{p}_score" for p in PARTS],
    )


def peer_comparison(scores: DataFrame) -> DataFrame:
    """Each employee beside the mean of the other active ones of the store and of the chain."""
    scores = cut_lineage(scores, "scores")
    own = F.col("is_active").cast("int")

    def totals(scope: str, keys: list[str]) -> DataFrame:
        aggs = [
            F.coalesce(
                F.sum(F.when(F.col("is_active"), F.col(f"{p}_score")).cast("decimal(18,2)")).cast("double"), F.lit(0.0)
            ).alias(f"_{scope}_{p}")
            for p in PARTS
        ]
        return scores.groupBy(*keys).agg(F.count_if("is_active").alias(f"_{scope}_n"), *aggs)

    joined = scores.join(totals("store", ["store_id"]), "store_id").join(F.broadcast(totals("chain", [])))

    def others(scope: str, part: str) -> Column:
        n = F.col(f"_{scope}_n") - own
        rest = F.col(f"_{scope}_{part}") - own * F.col(f"{part}_score")
        return F.when(n > 0, round_to(rest / n, 2)).otherwise(50.0).alias(f"{scope}_avg_{part}")

    return joined.select(
        "employee_id", "employee_name",
        *[F.col(f"{p}_score") for p in PARTS],
        *[others(scope, p) for scope in ("store", "chain") for p in PARTS],
    )


def employee_dashboard(scores: DataFrame, store_ids=None) -> DataFrame:
    rows = scope_stores(scores.where("is_active"), store_ids)
    n = F.count(F.lit(1))
    best = F.struct(F.col("composite_score"), -F.col("employee_id"))
    mean = lambda c: round_to(F.coalesce(F.try_divide(money_sum(c), n), F.lit(0.0)), 2)
    return rows.agg(
        mean("composite_score").alias("avg_score"),
        F.max_by("employee_name", best).alias("top_performer"),
        F.coalesce(F.max("composite_score"), F.lit(0.0)).alias("top_score"),
        mean("attendance_score").alias("avg_attendance_rate"),
        n.alias("total_employees"),
    )
