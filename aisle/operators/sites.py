"""Candidate site scores, evaluation and benchmarks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aisle.functions.listing import latest_per_key
from aisle.functions.scalars import clamp, great_circle_km, money_sum, round_to
from aisle.session import cut_lineage

RECENT_DAYS = 30
# Weights of the five scores.
WEIGHTS = {"traffic": 0.25, "competition": 0.20, "demographic": 0.20, "transport": 0.15, "commercial": 0.20}
# Rings in kilometres and the penalty of a rival inside.
RINGS = [(0.5, 15), (1.0, 8), (2.0, 3)]
DEFAULT_REVENUE = 200000.0
CELL_DEGREES = 0.02
KM_PER_DEGREE = 111.195
#: Addresses of a cell that are compared one by one; cells with more are split, at most so many times (to 9 metres).
LEAF_ADDRESSES = 64
DEPTH = 8


def _tier(value: Column, steps: list[tuple[float, float]], otherwise: float) -> Column:
    """First step whose limit the value exceeds."""
    out = F.when(value > steps[0][0], steps[0][1])
    for limit, score in steps[1:]:
        out = out.when(value > limit, score)
    return out.otherwise(otherwise)


def _recent(df: DataFrame, date_col: str, as_of: str) -> DataFrame:
    return df.where(F.col(date_col) >= F.date_sub(F.lit(as_of).cast("date"), RECENT_DAYS))


def store_traffic_means(traffic: DataFrame, as_of: str) -> DataFrame:
    """Mean count of a store's hour rows over 30 days."""
    return _recent(traffic, "traffic_date", as_of).groupBy("store_id").agg(
        (F.sum("enter_count") / F.count(F.lit(1))).alias("mean_traffic")
    )


def store_revenue(sales: DataFrame, as_of: str) -> DataFrame:
    return _recent(sales, "sale_date", as_of).groupBy("store_id").agg(money_sum("total_amount").alias("revenue"))


def _city_mean(per_store: DataFrame, stores: DataFrame, value: str, out: str) -> DataFrame:
    cities = stores.select(F.col("id").alias("store_id"), "city")
    return per_store.join(cities, "store_id").groupBy("city").agg(
        (F.sum(F.col(value).cast("decimal(28,8)")).cast("double") / F.count(F.lit(1))).alias(out)
    )


def _district_stores(stores: DataFrame) -> DataFrame:
    return stores.where("is_active").groupBy("district").agg(F.count(F.lit(1)).alias("_nearby"))


def traffic_score(candidates: DataFrame, stores: DataFrame, traffic: DataFrame, as_of: str) -> DataFrame:
    means = _city_mean(store_traffic_means(traffic, as_of), stores, "mean_traffic", "_mean")
    rows = candidates.join(means, "city", "left").join(_district_stores(stores), "district", "left")
    base = F.when(F.col("city").isNull(), 50.0).when(
        F.coalesce("_mean", F.lit(0.0)) != 0, F.least(F.lit(100.0), F.col("_mean") / 10)
    ).otherwise(50.0)
    lifted = F.when(F.col("city").isNotNull() & (F.col("_nearby") > 0), F.least(F.lit(100.0), base * 1.2)).otherwise(base)
    return rows.select("id", lifted.alias("traffic_score"))


def _cell_row(lat: Column) -> Column:
    return F.floor(lat / CELL_DEGREES)


def _cell_column(lng: Column, row: Column) -> Column:
    """Column of a point in a cell row; cells are as wide in kilometres as they are high."""
    return F.floor(lng * F.cos(F.radians(row * CELL_DEGREES)) / CELL_DEGREES)


def _penalty(km: Column) -> Column:
    penalty = F.when(km <= RINGS[0][0], RINGS[0][1])
    for ring, points_off in RINGS[1:]:
        penalty = penalty.when(km <= ring, points_off)
    return penalty.otherwise(0)


def _quarter(depth: Column | int) -> list[Column]:
    """Column and row, inside its cell, of an address after the cell was halved ``depth`` times."""
    parts = F.pow(F.lit(2.0), F.lit(depth) if isinstance(depth, int) else depth)
    inside = lambda c: F.least(F.floor(F.col(c) * parts), parts - 1).cast("long")
    return [inside("_u").alias("_x"), inside("_v").alias("_y")]


CELL = ["city", "_row", "_col", "_depth", "_x", "_y"]


def _tree(addresses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cells with their rivals and whether they are split, and addresses with the cell at which splitting ends.

    A cell with more addresses than are compared one by one is split into four, and so on.
    """
    crowded = addresses.groupBy("city", "_row", "_col").agg((F.count(F.lit(1)) > LEAF_ADDRESSES).alias("_crowded"))
    depths = F.explode(F.sequence(F.lit(0), F.when(F.col("_crowded"), DEPTH).otherwise(0))).alias("_depth")
    deep = addresses.join(crowded, ["city", "_row", "_col"]).select(*addresses.columns, depths).withColumns(
        dict(zip(("_x", "_y"), _quarter(F.col("_depth")), strict=True))
    )
    cells = deep.groupBy(*CELL).agg(F.sum("_rivals").alias("_all"), F.count(F.lit(1)).alias("_addresses"))
    cells = cut_lineage(cells.withColumn("_split", (F.col("_addresses") > LEAF_ADDRESSES) & (F.col("_depth") < DEPTH)), "cells")
    whole = cells.where(~F.col("_split")).select(*CELL)
    ends = deep.join(whole, CELL, "left_semi").groupBy("city", "_lat", "_lng").agg(
        F.min_by(F.struct("_row", "_col", "_depth", "_x", "_y", "_rivals"), "_depth").alias("_end")
    )
    return cells, ends.select("city", "_lat", "_lng", "_end.*")


def _reach(lat: Column, lng: Column) -> tuple[Column, Column]:
    """Least and greatest distance of a point to a cell in kilometres, a little too far out on both sides."""
    size = F.lit(CELL_DEGREES) / F.pow(F.lit(2.0), F.col("_depth"))
    stretch = F.cos(F.radians(F.col("_row") * CELL_DEGREES))
    south = F.col("_row") * CELL_DEGREES + F.col("_y") * size
    west = (F.col("_col") * CELL_DEGREES + F.col("_x") * size) / stretch
    north, east = south + size, west + size / stretch
    off = lambda p, a, b: F.greatest(a - p, p - b, F.lit(0.0))
    far = lambda p, a, b: F.greatest(F.abs(a - p), F.abs(b - p))
    shrink = [F.cos(F.radians(f(F.abs(lat), F.abs(south), F.abs(north)))) for f in (F.greatest, F.least)]
    km = lambda up, along: F.sqrt(up * up + along * along) * KM_PER_DEGREE
    return (
        km(off(lat, south, north), off(lng, west, east) * shrink[0]) * 0.999 - 0.001,
        km(far(lat, south, north), far(lng, west, east) * shrink[1]) * 1.001 + 0.001,
    )


def nearby_counts(candidates: DataFrame, competitors: DataFrame) -> DataFrame:
    """Penalty for rivals of the same city per ring around every distinct candidate point.

    Addresses lie in cells a little wider than the outer ring, nine of which surround a
    candidate. Dense cells are split. A cell that lies in one ring as a whole counts at once; only
    addresses of undivided cells that a ring cuts are compared, so a dense city costs its rings' edges and not its area.
    """
    spot = ["city", "latitude", "longitude"]
    has_point = lambda: (F.coalesce("latitude", F.lit(0.0)) != 0) & (F.coalesce("longitude", F.lit(0.0)) != 0)
    points = candidates.where(has_point()).select(*spot).distinct()
    addresses = competitors.where(has_point()).groupBy(*spot).agg(F.count(F.lit(1)).alias("_rivals")).select(
        "city", F.col("latitude").alias("_lat"), F.col("longitude").alias("_lng"), "_rivals", _cell_row(F.col("latitude")).alias("_row")
    )
    addresses = addresses.withColumn("_col", _cell_column(F.col("_lng"), F.col("_row"))).withColumns(
        {
            "_u": F.col("_lng") * F.cos(F.radians(F.col("_row") * CELL_DEGREES)) / CELL_DEGREES - F.col("_col"),
            "_v": F.col("_lat") / CELL_DEGREES - F.col("_row"),
        }
    )
    cells, ends = _tree(addresses)
    splits = cells.where("_split").agg(F.coalesce(F.max("_depth") + 1, F.lit(0)).alias("n")).first()["n"]
    steps = F.array(*map(F.lit, (-1, 0, 1)))
    front = (
        points.withColumn("_row", F.explode(F.transform(steps, lambda d: _cell_row(F.col("latitude")) + d)))
        .withColumn("_mid", _cell_column(F.col("longitude"), F.col("_row")))
        .withColumn("_col", F.explode(F.transform(steps, lambda d: F.col("_mid") + d)))
        .select(*spot, "_row", "_col", F.lit(0).alias("_depth"), F.lit(0).cast("long").alias("_x"), F.lit(0).cast("long").alias("_y"))
    )
    penalties, compared = [], []
    for depth in range(splits + 1):
        nearest, farthest = _reach(F.col("latitude"), F.col("longitude"))
        met = front.join(cells, CELL).withColumns({"_in": _penalty(nearest), "_out": _penalty(farthest)})
        same = F.col("_in") == F.col("_out")
        penalties.append(met.where(same & (F.col("_in") > 0)).select(*spot, (F.col("_in") * F.col("_all")).alias("_off")))
        compared.append(met.where(~same & ~F.col("_split")).select(*spot, *CELL[1:]))
        if depth < splits:
            half = F.explode(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x in (0, 1) for y in (0, 1)]))
            front = cut_lineage(met.where(~same & F.col("_split")), "front").withColumn("_half", half).select(
                *spot, "_row", "_col", (F.col("_depth") + 1).alias("_depth"),
                (F.col("_x") * 2 + F.col("_half.x")).alias("_x"), (F.col("_y") * 2 + F.col("_half.y")).alias("_y"),
            )
    pairs = reduce(DataFrame.unionByName, compared).join(ends, CELL)
    km = great_circle_km(F.col("latitude"), F.col("longitude"), F.col("_lat"), F.col("_lng"))
    every = pairs.select(*spot, (_penalty(km) * F.col("_rivals")).alias("_off"))
    return reduce(DataFrame.unionByName, [every, *penalties]).groupBy(*spot).agg(F.sum("_off").alias("penalty"))


def competition_score(candidates: DataFrame, competitors: DataFrame) -> DataFrame:
    contested = competitors.select("city").distinct().withColumn("_contested", F.lit(True))
    rows = candidates.join(contested, "city", "left").join(
        nearby_counts(candidates, competitors), ["city", "latitude", "longitude"], "left"
    )
    known = (F.coalesce("latitude", F.lit(0.0)) != 0) & (F.coalesce("longitude", F.lit(0.0)) != 0)
    score = (
        F.when(~known, 60.0)
        .when(F.col("_contested").isNull(), 85.0)
        .otherwise(F.greatest(F.lit(10.0), 100.0 - F.coalesce("penalty", F.lit(0))))
    )
    return rows.select("id", score.alias("competition_score"))


def demographic_score(candidates: DataFrame, stores: DataFrame, members: DataFrame) -> DataFrame:
    at_store = members.where("is_active").groupBy(F.col("register_store_id").alias("store_id")).agg(
        F.countDistinct("id").alias("_m")
    )
    cities = at_store.join(stores.select(F.col("id").alias("store_id"), "city"), "store_id").groupBy("city").agg(
        F.sum("_m").alias("_members")
    )
    rows = candidates.join(cities, "city", "left")
    tier = _tier(F.coalesce("_members", F.lit(0)), [(10000, 90.0), (5000, 75.0), (1000, 60.0)], 45.0)
    return rows.select("id", F.when(F.col("city").isNull(), 50.0).otherwise(tier).alias("demographic_score"))


def transport_score(candidates: DataFrame, stores: DataFrame) -> DataFrame:
    rows = candidates.join(_district_stores(stores), "district", "left")
    n = F.coalesce("_nearby", F.lit(0))
    return rows.select("id", F.when(n >= 3, 80.0).when(n >= 1, 65.0).otherwise(50.0).alias("transport_score"))


def commercial_score(candidates: DataFrame, stores: DataFrame, sales: DataFrame, as_of: str) -> DataFrame:
    means = _city_mean(store_revenue(sales, as_of), stores, "revenue", "_mean")
    rows = candidates.join(means, "city", "left")
    tier = _tier(F.coalesce("_mean", F.lit(0.0)), [(500000, 90.0), (200000, 75.0), (100000, 60.0)], 50.0)
    return rows.select("id", F.when(F.col("city").isNull(), 50.0).otherwise(tier).alias("commercial_score"))


def evaluate_sites(
    candidates: DataFrame, stores: DataFrame, traffic: DataFrame, sales: DataFrame, members: DataFrame,
    competitors: DataFrame, as_of: str, weights: dict[str, float] | None = None, traffic_as_of: str | None = None,
) -> DataFrame:
    """Scores, expected revenue, payback and confidence of every candidate."""
    w = weights or WEIGHTS
    mean_revenue = store_revenue(sales, as_of).agg(
        F.coalesce(
            F.nullif(F.sum(F.col("revenue").cast("decimal(28,4)")).cast("double") / F.count(F.lit(1)), F.lit(0.0)),
            F.lit(DEFAULT_REVENUE),
        ).alias("_mean_revenue")
    )
    rows = (
        candidates.join(traffic_score(candidates, stores, traffic, traffic_as_of or as_of), "id")
        .join(competition_score(candidates, competitors), "id")
        .join(demographic_score(candidates, stores, members), "id")
        .join(transport_score(candidates, stores), "id")
        .join(commercial_score(candidates, stores, sales, as_of), "id")
        .join(F.broadcast(mean_revenue))
    )
    names = list(WEIGHTS)
    total = sum((F.col(f"{n}_score") * w[n] for n in names[1:]), F.col("traffic_score") * w["traffic"])
    area = F.when(F.coalesce("area_sqm", F.lit(0.0)) != 0, F.least(F.lit(2.0), F.col("area_sqm") / 100.0)).otherwise(1.0)
    revenue = F.greatest(F.lit(0.0), F.col("_mean_revenue") * (F.col("_total") / 70.0) * area)
    rent = F.col("monthly_rent")
    payback = F.when(
        (F.coalesce(rent, F.lit(0.0)) != 0) & (F.col("_revenue") > 0),
        round_to(rent * 12 / (F.col("_revenue") * 0.15), 1),
    )
    return rows.withColumn("_total", total).withColumn("_revenue", revenue).select(
        F.col("id").alias("location_id"),
        F.col("name").alias("location_name"),
        round_to("_total", 1).alias("total_score"),
        *[round_to(f"{n}_score", 1).alias(f"{n}_score") for n in names],
        F.round("_revenue", 0).alias("predicted_monthly_revenue"),
        payback.alias("predicted_payback_months"),
        round_to(clamp(F.col("_total") * 0.8 + 20, 30.0, 100.0), 1).alias("confidence_level"),
    )


def location_factors(evaluations: DataFrame) -> DataFrame:
    """The five scores of an evaluation as rows."""
    factors = F.array(
        *[F.struct(F.lit(n).alias("factor_type"), F.col(f"{n}_score").alias("normalized_score")) for n in WEIGHTS]
    )
    return evaluations.select("location_id", F.explode(factors).alias("f")).select("location_id", "f.*")


def store_benchmark(stores: DataFrame, sales: DataFrame, traffic: DataFrame, as_of: str, traffic_as_of: str | None = None) -> DataFrame:
    active = stores.where("is_active").join(
        store_revenue(sales, as_of).withColumnRenamed("store_id", "id"), "id", "left"
    )
    mean = lambda c: F.coalesce(
        F.try_divide(F.sum(c.cast("decimal(28,8)")).cast("double"), F.count(c)), F.lit(0.0)
    )
    sqm = F.try_divide(F.col("revenue"), F.col("area_sqm"))
    facts = active.agg(
        F.countDistinct("id").alias("store_count"),
        F.round(mean(F.col("revenue")), 0).alias("avg_monthly_revenue"),
        F.round(F.coalesce(F.max("revenue"), F.lit(0.0)), 0).alias("top_store_revenue"),
        round_to(mean(sqm), 1).alias("avg_sqm_efficiency"),
    )
    visits = store_traffic_means(traffic, traffic_as_of or as_of).agg(
        F.round(mean(F.col("mean_traffic")), 0).alias("avg_traffic")
    )
    return facts.join(F.broadcast(visits))


def compare_sites(evaluations: DataFrame, location_ids: list[int] | None = None) -> DataFrame:
    """Newest evaluation of each site, best first."""
    rows = evaluations if location_ids is None else evaluations.where(F.col("location_id").isin(location_ids))
    newest = latest_per_key(rows, ["location_id"], [F.col("evaluated_at")])
    return newest.orderBy(F.desc("total_score"), "location_id")
