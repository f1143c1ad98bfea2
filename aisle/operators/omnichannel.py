"""Channel KPIs, attribution, funnel and member journeys."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aisle.functions import bitmaps, ordered
from aisle.functions.listing import latest_snapshot
from aisle.functions.scalars import money_sum, round_to, safe_div, time_bucket
from aisle.functions.scope import between_dates, scope_stores
from aisle.session import cut_lineage

HALF_LIFE_DAYS = 7.0
FUNNEL_STEPS = ["browse", "add_cart", "purchase", "repeat_purchase"]


def previous_period(start: str, end: str) -> tuple[str, str]:
    """The period of equal length that ends the day before ``start``."""
    first, last = date.fromisoformat(start), date.fromisoformat(end)
    length = (last - first).days + 1
    return (first - timedelta(days=length)).isoformat(), (first - timedelta(days=1)).isoformat()


def channel_kpis(channel_sales: DataFrame, start: str, end: str, store_ids=None) -> DataFrame:
    """Channel figures of a period and growth against the period before, in one scan."""
    before, _ = previous_period(start, end)
    lines = scope_stores(between_dates(channel_sales, "sale_date", before, end), store_ids)
    now = F.col("sale_date") >= F.lit(start)
    per_channel = lines.groupBy("channel").agg(
        F.count_if(now).alias("_lines"),
        F.coalesce(money_sum(F.when(now, F.col("total_amount"))), F.lit(0.0)).alias("_gmv"),
        F.coalesce(money_sum(F.when(~now, F.col("total_amount"))), F.lit(0.0)).alias("_before"),
        F.countDistinct(F.when(now, F.col("receipt_no"))).alias("order_count"),
        F.countDistinct(F.when(now, F.col("member_id"))).alias("member_count"),
    ).where(F.col("_lines") > 0)
    # One row per channel: a window over all of them costs less than a second scan.
    everything = Window.partitionBy(F.lit(1))
    return per_channel.select(
        "channel",
        round_to("_gmv", 2).alias("gmv"),
        "order_count",
        round_to(safe_div("_gmv", "order_count"), 2).alias("avg_ticket"),
        "member_count",
        round_to(
            F.when(F.col("_before") > 0, (F.col("_gmv") - F.col("_before")) / F.col("_before") * 100), 2
        ).alias("growth_rate_pct"),
        round_to(F.sum(F.col("_gmv").cast("decimal(28,4)")).over(everything).cast("double"), 2).alias("total_gmv"),
        F.sum("order_count").over(everything).alias("total_orders"),
    )


def channel_trends(
    channel_sales: DataFrame, start: str, end: str, granularity: str = "daily", store_ids=None
) -> DataFrame:
    lines = scope_stores(between_dates(channel_sales, "sale_date", start, end), store_ids)
    return lines.groupBy(time_bucket("sale_date", granularity).alias("period_date"), "channel").agg(
        round_to(F.coalesce(money_sum("total_amount"), F.lit(0.0)), 2).alias("gmv"),
        F.countDistinct("receipt_no").alias("order_count"),
    )


def conversions(channel_sales: DataFrame, start: str, end: str, store_ids=None) -> DataFrame:
    """Member receipts of a period. A receipt with several channels keeps its earliest line's."""
    lines = scope_stores(between_dates(channel_sales, "sale_date", start, end), store_ids).where(
        F.col("member_id").isNotNull()
    )
    return (
        lines.groupBy("receipt_no")
        .agg(
            money_sum("total_amount").alias("amount"),
            F.min(F.struct("sale_date", "channel", "member_id")).alias("_first"),
        )
        .select("receipt_no", "amount", "_first.*")
    )


def touch_state(touches: DataFrame, converted_days: DataFrame, end: str) -> DataFrame:
    """What each member had touched, per channel, up to the end of each conversion day.

    Joining every conversion to every earlier touch grows with the square of a
    busy member's history. Touches are first folded to one row per member,
    channel and day, and a running window carries that state to the conversion days.
    """
    at = F.col("event_date").cast("timestamp_ntz")
    seconds_left = 86400.0 - (
        F.hour(at) * 3600 + F.minute(at) * 60 + F.extract(F.lit("SECOND"), at).cast("double")
    )
    folded = (
        touches.where(F.to_date("event_date") <= F.lit(end).cast("date"))
        .groupBy("member_id", "channel", F.to_date("event_date").alias("day"))
        .agg(
            F.sum(F.pow(F.lit(2.0), -(seconds_left / 86400.0) / HALF_LIFE_DAYS)).alias("_mass"),
            F.min(F.struct("event_date", "id")).alias("_first"),
            F.max(F.struct("event_date", "id")).alias("_last"),
        )
    )
    # Masses are brought to the common end date; the shift cancels in the shares.
    age = F.datediff(F.lit(end).cast("date"), "day")
    folded = cut_lineage(
        folded.withColumn("_mass", F.col("_mass") * F.pow(F.lit(2.0), -age / HALF_LIFE_DAYS)), "touches"
    )
    asked = converted_days.join(folded.select("member_id", "channel").distinct(), "member_id")
    timeline = folded.withColumn("_asked", F.lit(False)).unionByName(
        asked.withColumn("_asked", F.lit(True)), allowMissingColumns=True
    )
    upto = (
        Window.partitionBy("member_id", "channel")
        .orderBy("day")
        .rangeBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        timeline.withColumn("mass", F.sum("_mass").over(upto))
        .withColumn("first", F.min("_first").over(upto))
        .withColumn("last", F.max("_last").over(upto))
        .where(F.col("_asked") & F.col("mass").isNotNull())
        .select("member_id", "day", "channel", "mass", "first", "last")
    )


def _share(model: str) -> Column:
    peers = Window.partitionBy("member_id", "day")
    if model == "first_touch":
        return (F.col("first") == F.min("first").over(peers)).cast("double")
    if model == "linear":
        return F.lit(1.0) / F.count(F.lit(1)).over(peers)
    if model == "time_decay":
        return F.try_divide(F.col("mass"), F.sum("mass").over(peers))
    return (F.col("last") == F.max("last").over(peers)).cast("double")


def attribution(
    channel_sales: DataFrame, events: DataFrame, start: str, end: str, model: str = "last_touch", store_ids=None
) -> DataFrame:
    """Revenue and orders credited to channels: last_touch, first_touch, linear or time_decay."""
    per_day = cut_lineage(
        conversions(channel_sales, start, end, store_ids)
        .groupBy("member_id", F.col("sale_date").alias("day"), F.col("channel").alias("own_channel"))
        .agg(money_sum("amount").alias("amount"), F.count(F.lit(1)).alias("orders")),
        "conversions",
    )
    touches = scope_stores(events, store_ids)
    shares = (
        touch_state(touches, per_day.select("member_id", "day").distinct(), end)
        .withColumn("share", _share(model))
        .where(F.col("share") > 0)
        .select("member_id", "day", "channel", "share")
    )
    credited = per_day.join(shares, ["member_id", "day"], "left").select(
        F.coalesce("channel", "own_channel").alias("channel"),
        (F.col("amount") * F.coalesce("share", F.lit(1.0))).alias("_gmv"),
        (F.col("orders") * F.coalesce("share", F.lit(1.0))).alias("_orders"),
    )
    by_channel = credited.groupBy("channel").agg(F.sum("_gmv").alias("_gmv"), F.sum("_orders").alias("_orders"))
    total = F.sum("_gmv").over(Window.partitionBy(F.lit(1)))
    return by_channel.withColumn("_total", total).select(
        "channel",
        round_to("_gmv", 2).alias("attributed_gmv"),
        F.round(round_to("_orders", 6)).cast("long").alias("attributed_orders"),
        round_to(safe_div("_gmv", "_total"), 4).alias("weight"),
    )


def channel_funnel(events: DataFrame, start: str, end: str, store_ids=None) -> DataFrame:
    """Members per funnel step and step conversion, one row per channel and step."""
    rows = scope_stores(events, store_ids).where(F.to_date("event_date").between(F.lit(start), F.lit(end)))
    is_type = lambda name: F.count_if(F.col("event_type") == name)
    members = rows.groupBy("channel", "member_id").agg(
        is_type("browse").alias("b"), is_type("add_cart").alias("c"), is_type("purchase").alias("p")
    )
    wide = members.groupBy("channel").agg(
        F.count_if(F.col("b") > 0).alias("n1"),
        F.count_if(F.col("c") > 0).alias("n2"),
        F.count_if(F.col("p") > 0).alias("n3"),
        F.count_if(F.col("p") >= 2).alias("n4"),
    )
    steps = F.array(
        *[
            F.struct(
                F.lit(i + 1).alias("step"),
                F.lit(name).alias("step_name"),
                F.col(f"n{i + 1}").alias("count"),
                (
                    round_to(F.when(F.col(f"n{i}") > 0, F.col(f"n{i + 1}") / F.col(f"n{i}") * 100), 2)
                    if i
                    else F.lit(None).cast("double")
                ).alias("conversion_rate"),
            )
            for i, name in enumerate(FUNNEL_STEPS)
        ]
    )
    return wide.select("channel", F.explode(steps).alias("s")).select("channel", "s.*")


def member_journey(events: DataFrame) -> DataFrame:
    """Every event of every member with its step number; days split busy members."""
    rows = events.withColumn("_day", F.to_date("event_date"))
    return ordered.position(rows, ["member_id"], "_day", [F.col("event_date"), F.col("id")], "step").select(
        "member_id", "step", "event_date", "channel", "event_type", "store_id", "amount"
    )


def member_channels(events: DataFrame) -> DataFrame:
    """Channels used, first and last channel and spend by channel, one row per member."""
    spend = F.when(F.col("event_type") == "purchase", F.col("amount"))
    per_channel = events.groupBy("member_id", "channel").agg(
        money_sum(spend).alias("spend"),
        F.min(F.struct("event_date", "id")).alias("_first"),
        F.max(F.struct("event_date", "id")).alias("_last"),
    )
    entry = F.when(F.col("spend").isNotNull(), F.struct("channel", "spend"))
    return per_channel.groupBy("member_id").agg(
        F.array_sort(F.collect_list("channel")).alias("channels_used"),
        F.min_by("channel", "_first").alias("first_channel"),
        F.max_by("channel", "_last").alias("last_channel"),
        F.map_from_entries(F.collect_list(entry)).alias("spend_by_channel"),
    )


def channel_overlap(channel_sales: DataFrame, start: str, end: str, store_ids=None) -> DataFrame:
    lines = scope_stores(between_dates(channel_sales, "sale_date", start, end), store_ids)
    has = lines.where(F.col("member_id").isNotNull()).groupBy("member_id").agg(
        F.bool_or(F.col("channel") == "online").alias("on"),
        F.bool_or(F.col("channel") == "offline").alias("off"),
        F.bool_or(F.col("channel") == "o2o").alias("o2o"),
    )
    on, off, o2o = F.col("on"), F.col("off"), F.col("o2o")
    return has.agg(
        F.count_if(on & ~off & ~o2o).alias("online_only"),
        F.count_if(off & ~on & ~o2o).alias("offline_only"),
        F.count_if(on & off).alias("both_channels"),
        F.count_if(o2o).alias("o2o_members"),
        F.count(F.lit(1)).alias("total_members"),
    )


def reach_bitmaps(channel_sales: DataFrame, members: DataFrame | None = None, receipts: DataFrame | None = None) -> DataFrame:
    """Daily bitmaps of members and receipts per channel, to be kept; ids that are no whole numbers need their dictionaries."""
    return bitmaps.daily_bitmaps(channel_sales, "sale_date", ["channel"], {"member_id": members, "receipt_no": receipts})


def channel_reach(reach: DataFrame, start: str, end: str) -> DataFrame:
    """Different members and receipts per channel over any period, and over all channels (null), from daily bitmaps."""
    each = bitmaps.distinct_counts(reach, ["channel"], start, end)
    together = bitmaps.distinct_counts(reach, [], start, end).withColumn("channel", F.lit(None).cast("string"))
    n = lambda what: F.coalesce(F.max(F.when(F.col("what") == what, F.col("n"))), F.lit(0))
    return each.unionByName(together).groupBy("channel").agg(n("member_id").alias("members"), n("receipt_no").alias("receipts"))


def channel_pairs(reach: DataFrame, start: str, end: str) -> DataFrame:
    """Members that buy on each pair of channels, and on all three, in a period."""
    groups = {"online_offline": ["online", "offline"], "online_o2o": ["online", "o2o"], "offline_o2o": ["offline", "o2o"], "all_three": ["online", "offline", "o2o"]}
    return bitmaps.overlap_counts(reach, "channel", groups, "member_id", start, end)


def channel_inventory(inventory: DataFrame, item_names: DataFrame, snapshot: str | None = None) -> DataFrame:
    """Stock by channel per store and item, at a date or at each store's newest one.

    ``item_names`` may list an item twice; one name is kept so that no quantity doubles.
    """
    rows = (
        inventory.where(F.col("snapshot_date") == F.lit(snapshot))
        if snapshot
        else latest_snapshot(inventory, "snapshot_date", ["store_id"])
    )
    part = lambda qty, ch: F.coalesce(F.sum(F.when(F.col("channel") == ch, F.col(qty))), F.lit(0.0))
    stock = rows.groupBy("store_id", "item_id").agg(
        part("available_qty", "online").alias("online_available"),
        part("available_qty", "offline").alias("offline_available"),
        part("reserved_qty", "online").alias("online_reserved"),
        part("reserved_qty", "offline").alias("offline_reserved"),
    )
    names = item_names.groupBy("item_id").agg(F.max("item_name").alias("item_name"))
    return stock.join(names, "item_id", "left")


def unified_member_stats(channel_sales: DataFrame, start: str, end: str, store_ids=None) -> DataFrame:
    """Member count, cross-channel share and mean spend."""
    lines = scope_stores(between_dates(channel_sales, "sale_date", start, end), store_ids)
    members = lines.where(F.col("member_id").isNotNull()).groupBy("member_id").agg(
        F.countDistinct("channel").alias("channels"), money_sum("total_amount").alias("spend")
    )
    n = F.count(F.lit(1))
    return members.agg(
        n.alias("total_members"),
        round_to(F.coalesce(F.try_divide(F.count_if(F.col("channels") > 1), n) * 100, F.lit(0.0)), 2).alias(
            "cross_channel_pct"
        ),
        round_to(F.coalesce(F.try_divide(money_sum("spend"), n), F.lit(0.0)), 2).alias("avg_ltv"),
    )


def channel_member_stats(
    channel_sales: DataFrame, start: str, end: str, as_of: str, store_ids=None, merge_equal_lines: bool = False
) -> DataFrame:
    """Members, frequency, recency and spend per channel.

    ``merge_equal_lines`` counts lines of one receipt with the same amount once.
    """
    lines = scope_stores(between_dates(channel_sales, "sale_date", start, end), store_ids).where(
        F.col("member_id").isNotNull()
    )
    if merge_equal_lines:
        lines = lines.groupBy("channel", "member_id", "receipt_no", "total_amount").agg(
            F.max("sale_date").alias("sale_date")
        )
    idle = F.datediff(F.lit(as_of).cast("date"), "sale_date")
    facts = lines.groupBy("channel").agg(
        F.countDistinct("member_id").alias("member_count"),
        F.countDistinct("receipt_no").alias("_receipts"),
        F.try_divide(F.sum(idle), F.count(F.lit(1))).alias("_recency"),
        money_sum("total_amount").alias("_spend"),
    )
    return facts.select(
        "channel",
        "member_count",
        round_to(safe_div("_receipts", "member_count"), 2).alias("avg_frequency"),
        round_to(F.coalesce("_recency", F.lit(0.0)), 1).alias("avg_recency_days"),
        round_to(safe_div("_spend", "member_count"), 2).alias("avg_spend"),
    )
