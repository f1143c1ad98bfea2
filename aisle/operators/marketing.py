"""Member lifecycle, campaign triggers and campaign figures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aisle.functions.scalars import money_sum, round_to, safe_div
from aisle.functions.stats import bounded_quantiles

HISTORY_DAYS = 90
MIN_INTERVALS = 10
NEVER = 9999
# Stage limits in days when history is too short.
DEFAULT_LIMITS = {"active": 30, "declining": 90, "at_risk": 180}
# Execution states that count as contact.
CONTACT_STATES = ["sent", "delivered", "opened", "converted"]
# Levels that can be raised.
UPGRADE_LEVELS = ["silver", "bronze", "普通"]
DEFAULT_COOLDOWN_DAYS = 7
DEFAULT_MAX_TRIGGERS = 3
DEFAULT_MESSAGE = "We have prepared an exclusive offer for you!"


def lifecycle_thresholds(transactions: DataFrame, as_of: str) -> DataFrame:
    """One row of stage limits from the repurchase intervals of the last 90 days.

    Purchases of one day give interval zero and do not count, so distinct days are
    enough; intervals are whole days up to 90, few distinct values for the quantile.
    """
    recent = transactions.where(
        F.col("transaction_date") >= F.date_sub(F.lit(as_of).cast("date"), HISTORY_DAYS)
    )
    days = recent.select("member_id", F.to_date("transaction_date").alias("day")).distinct()
    gaps = days.select(
        F.datediff("day", F.lag("day").over(Window.partitionBy("member_id").orderBy("day"))).alias("gap")
    ).where(F.col("gap") > 0)
    cuts = gaps.agg(F.count(F.lit(1)).alias("n"), bounded_quantiles("gap", [0.5, 0.75, 0.95]).alias("q"))
    whole = lambda c: F.floor(c).cast("int")
    p50, p75, p95 = (whole(F.col("q")[i]) for i in range(3))
    enough = F.col("n") >= MIN_INTERVALS
    active = F.greatest(F.lit(14), whole(p50 * 1.5))
    declining = F.greatest(active + 7, whole(p75 * 1.5))
    at_risk = F.greatest(declining + 14, whole(p95 * 1.2))
    return cuts.select(
        F.when(enough, active).otherwise(DEFAULT_LIMITS["active"]).alias("active"),
        F.when(enough, declining).otherwise(DEFAULT_LIMITS["declining"]).alias("declining"),
        F.when(enough, at_risk).otherwise(DEFAULT_LIMITS["at_risk"]).alias("at_risk"),
    )


def _idle_days(members: DataFrame, transactions: DataFrame, as_of: str) -> DataFrame:
    last = transactions.groupBy(F.col("member_id").alias("id")).agg(F.max("transaction_date").alias("_last"))
    return (
        members.where("is_active")
        .join(last, "id", "left")
        .withColumn("_idle", F.datediff(F.lit(as_of).cast("date"), "_last"))
    )


def member_lifecycle(members: DataFrame, transactions: DataFrame, as_of: str) -> DataFrame:
    limits = lifecycle_thresholds(transactions, as_of)
    days = F.coalesce("_idle", F.lit(NEVER))
    registered = F.coalesce(F.datediff(F.lit(as_of).cast("date"), "register_date"), F.lit(NEVER))
    stage = (
        F.when(registered <= 30, "new")
        .when(days <= F.col("active"), "active")
        .when(days <= F.col("declining"), "declining")
        .when(days <= F.col("at_risk"), "at_risk")
        .otherwise("churned")
    )
    return (
        _idle_days(members, transactions, as_of)
        .join(F.broadcast(limits))
        .select(
            F.col("id").alias("member_id"), "member_no", "name", "level", "total_points",
            days.alias("days_since_last"), stage.alias("lifecycle_stage"),
        )
    )


def lifecycle_distribution(classified: DataFrame) -> DataFrame:
    counts = classified.groupBy(F.col("lifecycle_stage").alias("stage")).agg(F.count(F.lit(1)).alias("count"))
    total = F.sum("count").over(Window.partitionBy(F.lit(1)))
    return counts.select("stage", "count", round_to(F.col("count") / total * 100, 1).alias("percentage"))


def birthday_members(members: DataFrame, as_of: str, by_parts: bool = False) -> DataFrame:
    """Birthday within seven days. ``by_parts`` compares month and day numbers only,
    which finds nobody when the week crosses a month end."""
    today = F.lit(as_of).cast("date")
    active = members.where("is_active")
    if by_parts:
        hit = (F.month("birthday") == F.month(today)) & F.dayofmonth("birthday").between(
            F.dayofmonth(today), F.dayofmonth(F.date_add(today, 7))
        )
    else:
        years = F.year(today) - F.year("birthday")
        this_year = F.add_months("birthday", years * 12)
        upcoming = F.when(this_year >= today, this_year).otherwise(F.add_months("birthday", (years + 1) * 12))
        hit = upcoming <= F.date_add(today, 7)
    return active.where(hit).select(F.col("id").alias("member_id"))


def churn_risk_members(members: DataFrame, transactions: DataFrame, as_of: str) -> DataFrame:
    limits = lifecycle_thresholds(transactions, as_of)
    return (
        _idle_days(members, transactions, as_of)
        .join(F.broadcast(limits))
        .where(F.col("_idle").between(F.col("declining"), F.col("at_risk")))
        .select(F.col("id").alias("member_id"))
    )


def repurchase_candidates(transactions: DataFrame, as_of: str) -> DataFrame:
    """Silent for longer than 1.5 times the own mean interval.

    The intervals between consecutive purchases add up to last minus first, so
    their mean needs no ordering of the purchases.
    """
    seen = transactions.groupBy("member_id").agg(
        F.min("transaction_date").alias("_first"),
        F.max("transaction_date").alias("_last"),
        F.count(F.lit(1)).alias("_n"),
    )
    mean = F.try_divide(F.datediff("_last", "_first"), F.col("_n") - 1)
    idle = F.datediff(F.lit(as_of).cast("date"), "_last")
    return seen.where((F.col("_n") > 1) & (idle > mean * 1.5)).select("member_id")


def upgrade_candidates(members: DataFrame, transactions: DataFrame, as_of: str, levels=None) -> DataFrame:
    spend = (
        transactions.where(F.col("transaction_date") >= F.date_sub(F.lit(as_of).cast("date"), HISTORY_DAYS))
        .groupBy("member_id")
        .agg(money_sum("amount").alias("_spend"))
    )
    eligible = members.where(F.col("is_active") & F.col("level").isin(levels or UPGRADE_LEVELS))
    return (
        eligible.join(spend, F.col("id") == F.col("member_id"))
        .where(F.col("_spend") > F.col("total_points") * 0.8)
        .select("member_id")
    )


def apply_cooldown(candidates: DataFrame, executions: DataFrame, rules: DataFrame, now: str) -> DataFrame:
    """Drop (campaign, member) pairs under the 24-hour lock, the cooldown or the trigger cap."""
    moment = F.lit(now).cast("timestamp_ntz")
    contacted = (
        executions.where(
            (F.col("sent_at") >= moment - F.expr("interval 24 hours")) & F.col("status").isin(CONTACT_STATES)
        )
        .select("member_id")
        .distinct()
    )
    history = executions.groupBy("campaign_id", "member_id").agg(
        F.count(F.lit(1)).alias("_count"), F.max("triggered_at").alias("_last")
    )
    limits = rules.where("is_active").select("campaign_id", "cooldown_days", "max_triggers_per_member")
    cooldown = F.coalesce("cooldown_days", F.lit(DEFAULT_COOLDOWN_DAYS))
    most = F.coalesce("max_triggers_per_member", F.lit(DEFAULT_MAX_TRIGGERS))
    too_soon = F.coalesce(F.col("_last") > moment - F.make_dt_interval(cooldown), F.lit(False))
    return (
        candidates.join(contacted, "member_id", "left_anti")
        .join(history, ["campaign_id", "member_id"], "left")
        .join(limits, "campaign_id", "left")
        .where(F.col("_count").isNull() | ((F.col("_count") < most) & ~too_soon))
        .select("campaign_id", "member_id")
    )


def render_message(template: Column, member: Column) -> Column:
    return F.when(F.coalesce(F.length(template), F.lit(0)) == 0, DEFAULT_MESSAGE).otherwise(
        F.replace(template, F.lit("{member_id}"), member.cast("string"))
    )


def evaluate_campaigns(
    campaigns: DataFrame, members: DataFrame, transactions: DataFrame, executions: DataFrame, rules: DataFrame, now: str
) -> DataFrame:
    """Execution rows of one trigger run.

    Campaigns run in id order and a contact locks the member for the later ones,
    so each member goes to the first campaign it qualifies for.
    """
    as_of = now[:10]
    by_type = {
        "birthday": birthday_members(members, as_of),
        "churn_warning": churn_risk_members(members, transactions, as_of),
        "repurchase": repurchase_candidates(transactions, as_of),
        "upgrade": upgrade_candidates(members, transactions, as_of),
    }
    tagged = reduce(
        DataFrame.unionByName,
        [df.select("member_id").withColumn("campaign_type", F.lit(kind)) for kind, df in by_type.items()],
    )
    running = campaigns.where(F.col("status") == "active")
    pairs = tagged.join(
        running.select(F.col("id").alias("campaign_id"), "campaign_type"), "campaign_type"
    ).select("campaign_id", "member_id")
    chosen = (
        apply_cooldown(pairs, executions, rules, now)
        .groupBy("member_id")
        .agg(F.min("campaign_id").alias("campaign_id"))
    )
    return chosen.join(running, F.col("campaign_id") == F.col("id")).select(
        "campaign_id",
        F.col("name").alias("campaign_name"),
        "campaign_type",
        "member_id",
        "channel",
        render_message(F.col("message_template"), F.col("member_id")).alias("message_content"),
        F.lit("sent").alias("status"),
        F.lit(now).cast("timestamp_ntz").alias("sent_at"),
    )


def trigger_counts(sent: DataFrame) -> DataFrame:
    return sent.groupBy("campaign_id", "campaign_name", F.col("campaign_type").alias("trigger_type")).agg(
        F.count(F.lit(1)).alias("triggered_members")
    )


def campaign_stats(executions: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    won = F.count_if(F.col("status") == "converted")
    return executions.groupBy("campaign_id").agg(
        n.alias("total_sent"), won.alias("converted"), round_to(won / n * 100, 1).alias("conversion_rate")
    )


def campaign_daily(executions: DataFrame, campaigns: DataFrame) -> DataFrame:
    """Daily roll-up per campaign; a later state implies the earlier ones."""
    reached = lambda *states: F.count_if(F.col("status").isin(*states))
    daily = executions.groupBy("campaign_id", F.to_date("sent_at").alias("period_date")).agg(
        F.count(F.lit(1)).alias("total_targeted"),
        reached(*CONTACT_STATES).alias("total_sent"),
        reached(*CONTACT_STATES[1:]).alias("total_delivered"),
        reached(*CONTACT_STATES[2:]).alias("total_opened"),
        reached(*CONTACT_STATES[3:]).alias("total_converted"),
        F.coalesce(money_sum("revenue"), F.lit(0.0)).alias("total_revenue"),
    )
    price = campaigns.select(F.col("id").alias("campaign_id"), "unit_cost")
    cost = F.col("total_sent") * F.coalesce("unit_cost", F.lit(0.0))
    return (
        daily.join(price, "campaign_id", "left")
        .withColumn("total_cost", cost)
        .withColumn("roi", safe_div(F.col("total_revenue") - F.col("total_cost"), "total_cost"))
        .drop("unit_cost")
    )


def campaign_metrics(daily: DataFrame, newest: int = 30) -> DataFrame:
    """Rates of the newest days of each campaign; the input has one row per campaign and day."""
    recent = Window.partitionBy("campaign_id").orderBy(F.desc("period_date"))
    return (
        daily.withColumn("_n", F.row_number().over(recent))
        .where(F.col("_n") <= newest)
        .drop("_n")
        .withColumn("conversion_rate", round_to(safe_div(F.col("total_converted") * 100.0, "total_sent"), 1))
        .withColumn("open_rate", round_to(safe_div(F.col("total_opened") * 100.0, "total_delivered"), 1))
    )


def marketing_dashboard(campaigns: DataFrame, executions: DataFrame, daily: DataFrame, as_of: str) -> DataFrame:
    month_start = F.trunc(F.lit(as_of).cast("date"), "month").cast("timestamp_ntz")
    live = campaigns.agg(F.count_if(F.col("status") == "active").alias("active_campaigns"))
    reached = executions.where(
        (F.col("sent_at") >= month_start) & F.col("status").isin(CONTACT_STATES)
    ).agg(F.countDistinct("member_id").alias("members_reached_month"))
    recent = daily.where(F.col("period_date") >= F.date_sub(F.lit(as_of).cast("date"), 30))
    rate = safe_div(F.col("total_converted") * 100.0, "total_sent")
    gain = safe_div(F.col("total_revenue") - F.col("total_cost"), "total_cost")
    results = recent.agg(
        round_to(F.coalesce(F.avg(rate), F.lit(0.0)), 1).alias("avg_conversion_rate"),
        round_to(F.coalesce(F.sum(gain), F.lit(0.0)), 2).alias("total_roi"),
    )
    return live.join(F.broadcast(reached)).join(F.broadcast(results))
