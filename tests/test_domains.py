"""Rules of single operators on small hand-made tables."""

import math
import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from aisle.operators import (
    anomaly, demand, employee, energy, forecast, kpi, lifecycle, marketing, omnichannel, port, quality, replenishment, rfm, sites, zones,
)


def days(spark, values, start=date(2024, 3, 1), store=1):
    rows = [(store, start + timedelta(days=i), float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "store_id int, sale_date date, value double")


@pytest.fixture(scope="module")
def series(spark):
    random.seed(4)
    values = [100 + i * 0.5 + [0, 5, -3, 8, 0, -6, -4][i % 7] + random.random() for i in range(60)]
    return forecast.number_rows(days(spark, values), "store_id")


def test_parts_add_up_and_cycle_is_centred(series):
    rows = forecast.decompose(series).orderBy("sale_date").collect()
    assert all(r["trend"] + r["seasonal"] + r["residual"] == pytest.approx(r["value"]) for r in rows)
    assert sum(r["seasonal"] for r in rows[:7]) == pytest.approx(0, abs=1e-9)
    assert all(rows[i]["seasonal"] == rows[i + 7]["seasonal"] for i in range(50))
    shape = [r["seasonal"] for r in rows[:7]]
    assert shape.index(max(shape)) == 3 and shape.index(min(shape)) == 5


def test_backtest_error_is_small(series):
    row = forecast.backtest(series).first()
    assert row["mape"] < 30 and row["rmse"] < 10


def test_short_series_have_no_backtest(spark):
    assert forecast.backtest(forecast.number_rows(days(spark, range(1, 28)), "store_id")).count() == 0


def test_trend_damping(spark):
    row = spark.createDataFrame([(10.0, 2.0)], "trend_last double, slope double").select(
        forecast.damped_trend(F.lit(1.0)).alias("one"), forecast.damped_trend(F.lit(3.0)).alias("three")
    ).first()
    assert row["one"] == pytest.approx(12) and row["three"] == pytest.approx(10 + 2 + 1.9 + 1.805)


@pytest.mark.parametrize("day,flag", [("2024-10-01", 1.0), ("2024-09-30", 0.5), ("2024-10-08", 0.5), ("2024-10-09", 0.0), ("2024-12-31", 0.5), ("2024-02-16", 1.0)])
def test_holiday_flag(spark, day, flag):
    assert spark.range(1).select(forecast.holiday_flag(F.lit(day).cast("date"))).first()[0] == flag


@pytest.mark.parametrize("rain,high,factor", [(31.0, 20.0, 0.8), (16.0, 20.0, 0.88), (6.0, 39.0, 0.94 * 0.9), (None, None, 1.0), (0.0, -6.0, 0.9)])
def test_weather_factor(spark, rain, high, factor):
    df = spark.createDataFrame([(rain, high)], "r double, h double")
    assert df.select(forecast.weather_factor(F.col("r"), F.col("h"))).first()[0] == pytest.approx(factor)


@pytest.mark.parametrize(
    "signals,factor",
    [([("competitor_price", 1.2, 1.0)], 1.02), ([("competitor_price", 0.8, 1.0)], 0.98), ([("competitor_price", 1.05, 1.0)], 1.0),
     ([("sentiment", 0.5, 1.0)], 1.04), ([("sentiment", -0.5, 1.0)], 0.96), ([("market_trend", 1.5, 0.5)], 1.075),
     ([("market_trend", 1.5, None), ("sentiment", 1.0, 1.0)], 1.15 * 1.08), ([("market_trend", 9.0, 1.0)], 1.5), ([("sentiment", -20.0, 1.0)], 0.5)],
)
def test_external_factor(spark, signals, factor):
    rows = [(kind, date(2024, 1, 1), v, c) for kind, v, c in signals]
    df = spark.createDataFrame(rows, "signal_type string, signal_date date, value double, confidence double")
    assert demand.external_factor(df).first()["external_factor"] == pytest.approx(factor)


@pytest.mark.parametrize(
    "growths,weeks,adoption,velocity,peers,stage",
    [([0.1, 0.1], 20, 0.9, 5.0, 5.0, "introduction"), ([0.2] * 5, 6, 0.3, 5.0, 5.0, "introduction"), ([-0.3, -0.2, -0.4, -0.3], 20, 0.8, 5.0, 5.0, "decline"),
     ([0.3, 0.2, 0.4, 0.3], 20, 0.8, 5.0, 5.0, "growth"), ([0.01, 0.0, -0.01, 0.02], 20, 0.8, 5.0, 5.0, "maturity"), ([0.01, 0.0, -0.01, 0.02], 40, 0.8, 1.0, 5.0, "decline")],
)
def test_stage_rule(spark, growths, weeks, adoption, velocity, peers, stage):
    n = len(growths)
    spread = (sum((g - sum(growths) / n) ** 2 for g in growths) / n) ** 0.5
    df = spark.createDataFrame([(growths, spread, weeks, adoption, velocity, peers)], "g array<double>, s double, w int, a double, v double, p double")
    assert df.select(lifecycle.stage_rule(*[F.col(c) for c in "gswavp"])).first()[0] == stage


def test_iqr_needs_seven_days_and_finds_the_spike(spark):
    rows = days(spark, [10, 11, 12, 10, 11, 12, 10, 90]).unionByName(days(spark, [1, 1, 500], store=2)).withColumnRenamed("value", "daily_sales")
    found = anomaly.iqr_anomalies(rows).collect()
    assert [(r["store_id"], r["value"], r["severity"], r["direction"]) for r in found] == [(1, 90.0, "high", "above")]


def test_gaps(spark):
    rows = [(1, date(2024, 2, 27)), (1, date(2024, 3, 1)), (1, date(2024, 3, 1)), (1, date(2024, 3, 5)), (2, date(2024, 1, 1))]
    gaps = kpi.missing_periods(spark.createDataFrame(rows, "store_id int, d date"), "d", ["store_id"])
    assert {tuple(r) for r in gaps.collect()} == {(1, date(2024, 2, 28), date(2024, 2, 29), 2), (1, date(2024, 3, 2), date(2024, 3, 4), 3)}


@pytest.mark.parametrize("code,segment", [((4, 4, 3), "key_value"), ((3, 3, 4), "key_win_back"), ((4, 2, 4), "key_retain"), ((1, 1, 1), "lost"), ((4, 4, 1), "key_retain"), ((2, 3, 1), "general_growth"), ((1, 4, 3), "general_value")])
def test_segments(spark, code, segment):
    df = spark.createDataFrame([code], "r_score int, f_score int, m_score int").withColumn("rfm_score", F.concat("r_score", "f_score", "m_score"))
    assert df.select(rfm.rfm_segment()).first()[0] == segment


def test_birthdays_across_month_end(spark):
    rows = [(1, date(1990, 3, 2), True), (2, date(1992, 2, 29), True), (3, date(1990, 3, 9), True), (4, date(1990, 2, 28), False)]
    members = spark.createDataFrame(rows, "id int, birthday date, is_active boolean")
    ids = lambda d: {r["member_id"] for r in d.collect()}
    assert ids(marketing.birthday_members(members, "2023-02-26")) == {1, 2}
    assert ids(marketing.birthday_members(members, "2023-02-26", by_parts=True)) == set()


def test_few_intervals_give_default_limits(spark):
    rows = [(1, date(2024, 1, 1)), (1, date(2024, 1, 9))]
    limits = marketing.lifecycle_thresholds(spark.createDataFrame(rows, "member_id int, transaction_date date"), "2024-02-01").first()
    assert limits.asDict() == marketing.DEFAULT_LIMITS


@pytest.fixture(scope="module")
def channel_data(spark):
    sales = spark.createDataFrame(
        [("r1", 1, "2024-01-10", "offline", 70.0), ("r1", 1, "2024-01-10", "offline", 30.0), ("r2", 2, "2024-01-10", "o2o", 50.0), ("r3", 1, "2024-01-01", "offline", 20.0)],
        "receipt_no string, member_id int, d string, channel string, total_amount double",
    ).select("receipt_no", "member_id", F.to_date("d").alias("sale_date"), "channel", "total_amount", F.lit(1).alias("store_id"))
    events = spark.createDataFrame(
        [(1, 1, "online", "2024-01-03 23:59:59.999999"), (2, 1, "offline", "2024-01-10 23:59:59.999999"), (3, 1, "online", "2024-01-11 00:00:00"), (4, 1, "online", "2024-01-03 10:00:00")],
        "id int, member_id int, channel string, t string",
    ).select("id", "member_id", "channel", F.col("t").cast("timestamp_ntz").alias("event_date"), F.lit(1).alias("store_id"))
    return sales, events


@pytest.mark.parametrize("model,online,offline", [("last_touch", 0, 120), ("first_touch", 100, 20), ("linear", 50, 70)])
def test_attribution(channel_data, model, online, offline):
    rows = {r["channel"]: r for r in omnichannel.attribution(*channel_data, "2024-01-01", "2024-01-31", model).collect()}
    got = {c: r["attributed_gmv"] for c, r in rows.items()}
    assert got == {k: float(v) for k, v in (("online", online), ("offline", offline), ("o2o", 50)) if v}
    assert sum(r["attributed_gmv"] for r in rows.values()) == 170


def test_decay_halves_in_a_week(channel_data):
    sales, events = channel_data
    rows = {r["channel"]: r for r in omnichannel.attribution(sales, events.where("id < 3"), "2024-01-05", "2024-01-31", "time_decay").collect()}
    assert rows["offline"]["attributed_gmv"] == 66.67 and rows["online"]["attributed_gmv"] == 33.33


def test_one_busy_day_of_touches_is_folded(spark, channel_data):
    sales, _ = channel_data
    many = spark.range(5000).select(
        F.col("id"), F.lit(1).alias("member_id"), F.when(F.col("id") % 4 == 0, "online").otherwise("offline").alias("channel"),
        F.lit("2024-01-05 12:00:00").cast("timestamp_ntz").alias("event_date"), F.lit(1).alias("store_id"))
    state = omnichannel.touch_state(many, omnichannel.conversions(sales, "2024-01-05", "2024-01-31").select("member_id", F.col("sale_date").alias("day")).distinct(), "2024-01-31")
    assert state.count() == 2


def test_sales_score_edges(spark):
    staff = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 2), (5, 3)], "id int, store_id int")
    sold = spark.createDataFrame([(1, 1, 10.0), (2, 1, 20.0), (4, 2, 5.0)], "employee_id int, store_id int, revenue double").withColumn(
        "record_date", F.lit("2024-01-02").cast("date"))
    scores = {r["employee_id"]: r["sales_score"] for r in employee.sales_score(staff, sold, [("p", "2024-01-01", "2024-01-31")]).collect()}
    assert scores == {1: 0.0, 2: 50.0, 3: 0.0, 4: 75.0, 5: 50.0}


def points(spark, **change):
    base = dict(store_id=1, item_id=1, item_name="x", supplier_id=7, current_stock=0.0, safety_stock=10.0, reorder_point=50.0, velocity=10.0,
                unit_cost=10.0, moq=5, packaging_unit=12, max_stock_days=30, lead_time_days=7, min_order_qty=0.0, tiers=None)
    row = {**base, **change}
    schema = ("store_id int, item_id int, item_name string, supplier_id int, current_stock double, safety_stock double, reorder_point double, velocity double,"
              " unit_cost double, moq int, packaging_unit int, max_stock_days int, lead_time_days int, min_order_qty double, tiers array<struct<min_qty:int,discount_rate:double,tier_price:double>>")
    return spark.createDataFrame([tuple(row.values())], schema)


@pytest.mark.parametrize(
    "change,quantity,cost,discount",
    [({}, 300, 3000.0, 0), ({"max_stock_days": 60}, 384, 3840.0, 0), ({"velocity": 0.0, "moq": 30}, 36, 360.0, 0),
     ({"max_stock_days": 60, "tiers": [(300, 0.1, None)]}, 384, 3456.0, 1), ({"max_stock_days": 60, "tiers": [(300, 0.1, None), (400, 0.2, None)]}, 408, 3264.0, 1),
     ({"max_stock_days": 60, "tiers": [(400, 0.2, 9.0)]}, 408, 3672.0, 1), ({"max_stock_days": 60, "tiers": [(900, 0.2, None)]}, 384, 3840.0, 0)],
)
def test_order_quantity(spark, change, quantity, cost, discount):
    row = replenishment.order_quantities(points(spark, **change), "2024-01-01").first()
    assert (row["suggested_qty"], row["estimated_cost"], row["bulk_discount_applied"]) == (quantity, cost, discount)


def test_stock_above_the_reorder_point_orders_nothing(spark):
    assert replenishment.order_quantities(points(spark, current_stock=51.0), "2024-01-01").count() == 0


def greedy(people, shifts, load):
    """Plain loop over one day."""
    taken, out = set(), []
    for shift, needs in shifts:
        for position, count in needs.items():
            free = sorted((load.get(i, 0), i) for i, p in people if p == position and i not in taken)
            for _, person in free[:count]:
                taken.add(person)
                out.append((shift, person))
    return sorted(out)


def test_roster_equals_the_greedy_loop(spark):
    for seed in range(3):
        random.seed(seed)
        people = [(i, random.choice(["a", "b"])) for i in range(30)]
        load = {i: random.randrange(4) for i in range(0, 30, 2)}
        shifts = [(s, {"a": random.randrange(6), "b": random.randrange(8)}) for s in range(4)]
        staff = spark.createDataFrame([(i, p, True) for i, p in people], "id long, position string, is_active boolean")
        table = spark.createDataFrame([(s, f"s{s}", str(n)) for s, n in shifts], "id int, shift_name string, required_positions string")
        loads = spark.createDataFrame(list(load.items()), "personnel_id long, shift_count long")
        roster, gaps = port.assign_horizon(staff, table, loads, "2024-01-01", 2)
        rows = roster.collect()
        for day in (date(2024, 1, 1), date(2024, 1, 2)):
            expected = greedy(people, shifts, load)
            assert sorted((r["shift_id"], r["personnel_id"]) for r in rows if r["schedule_date"] == day) == expected
            for _, person in expected:
                load[person] = load.get(person, 0) + 1
        assert port.double_booked(roster).count() == 0


def test_roster_of_many_days_equals_the_greedy_loop(spark):
    """Loads far apart: who is far below the others works every day until they meet."""
    random.seed(8)
    people = [(i, random.choice(["a", "b", "c"])) for i in range(40)]
    load = {i: random.choice([0, 1, 2, 9, 12]) for i in range(0, 40, 2)}
    shifts = [(s, {"a": random.randrange(4), "b": 2, "c": 9}) for s in range(3)]
    staff = spark.createDataFrame([(i, p, True) for i, p in people], "id long, position string, is_active boolean")
    table = spark.createDataFrame([(s, f"s{s}", str(n)) for s, n in shifts], "id int, shift_name string, required_positions string")
    loads = spark.createDataFrame(list(load.items()), "personnel_id long, shift_count long")
    roster, gaps = port.assign_horizon(staff, table, loads, "2024-01-01", 9)
    rows = roster.collect()
    for day in range(9):
        expected = greedy(people, shifts, load)
        assert sorted((r["shift_id"], r["personnel_id"]) for r in rows if r["schedule_date"] == date(2024, 1, 1 + day)) == expected
        for _, person in expected:
            load[person] = load.get(person, 0) + 1
    assert {r["position"] for r in gaps.collect()} == {"c"} and gaps.count() % 9 == 0


def test_energy_points_and_correlation(spark):
    rows = [(1, float(i), 2.0 * i + 1) for i in range(5)] + [(2, 1.0, 1.0), (2, 2.0, 5.0)] + [(3, 4.0, 1.0), (3, 4.0, 2.0), (3, 4.0, 9.0)]
    out = {r["store_id"]: tuple(r)[1:] for r in energy.point_correlation(spark.createDataFrame(rows, "store_id int, x double, y double")).collect()}
    assert out[1] == (1.0, 0.0, 5) and out[2] == (0.0, 1.0, 2) and out[3][0] == 0.0 and out[3][1] == 1.0


def test_rolling_energy_anomaly(spark):
    rows = [(1, date(2024, 1, 1) + timedelta(days=i), float(v)) for i, v in enumerate([100, 101, 99, 100, 102, 98, 100, 400, 100])]
    daily = spark.createDataFrame(rows, "equipment_id int, energy_date date, total_kwh double").withColumn("store_id", F.lit(1))
    device = spark.createDataFrame([(1, "d")], "id int, name string")
    assert [(r["actual_kwh"], r["expected_kwh"]) for r in energy.energy_anomalies(daily, device, "2024-01-20").collect()] == [(400.0, 100.0)]
    flat = daily.withColumn("total_kwh", F.lit(5.0))
    assert energy.energy_anomalies(flat, device, "2024-01-20").count() == 0


def test_rings_against_every_pair(spark):
    random.seed(9)
    near = lambda: (39.9 + random.random() * 0.05, 116.3 + random.random() * 0.05)
    own, rivals = [near() for _ in range(40)], [near() for _ in range(60)]
    to_df = lambda ps: spark.createDataFrame([(i, "c", a, b) for i, (a, b) in enumerate(ps)], "id int, city string, latitude double, longitude double")
    import math

    def km(p, q):
        (a, b), (c, d) = [tuple(map(math.radians, x)) for x in (p, q)]
        return 6371 * math.acos(min(1, math.sin(a) * math.sin(c) + math.cos(a) * math.cos(c) * math.cos(b - d)))

    got = {r["id"]: r["competition_score"] for r in sites.competition_score(to_df(own), to_df(rivals)).collect()}
    for i, p in enumerate(own):
        off = sum(15 if k <= 0.5 else 8 if k <= 1 else 3 if k <= 2 else 0 for k in (km(p, q) for q in rivals))
        assert got[i] == max(10, 100 - off)


@pytest.mark.parametrize(("leaf", "lat"), [(64, 39.9), (3, -33.9)])
def test_dense_cells_split(spark, monkeypatch, leaf, lat):
    """Most rivals crowd into a few blocks, some at one address; penalties are those of every pair."""
    monkeypatch.setattr(sites, "LEAF_ADDRESSES", leaf)
    random.seed(leaf)
    own = [(lat + random.uniform(-0.02, 0.02), 116.3 + random.uniform(-0.02, 0.02)) for _ in range(25)]
    rivals = [(lat + random.gauss(0, 0.002), 116.3 + random.gauss(0, 0.002)) for _ in range(150)] + [(lat + random.uniform(-0.03, 0.03), 116.3) for _ in range(20)] + [own[0]] * 5
    to_df = lambda ps: spark.createDataFrame([("c", a, b) for a, b in ps], "city string, latitude double, longitude double")

    def km(p, q):
        (a, b), (c, d) = [tuple(map(math.radians, x)) for x in (p, q)]
        h = math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2
        return 2 * 6371 * math.atan2(math.sqrt(h), math.sqrt(1 - h))

    got = {(r["latitude"], r["longitude"]): r["penalty"] for r in sites.nearby_counts(to_df(own), to_df(rivals)).collect()}
    for p in own:
        assert (got.get(p) or 0) == sum(15 if k <= 0.5 else 8 if k <= 1 else 3 if k <= 2 else 0 for k in (km(p, q) for q in rivals))


def test_competition_defaults(spark):
    schema = "id int, city string, latitude double, longitude double"
    sites_df = spark.createDataFrame([(1, "a", None, 1.0), (2, "b", 1.0, 1.0), (3, "a", 0.0, 1.0)], schema)
    rivals = spark.createDataFrame([(9, "a", None, None)], schema)
    assert {r["id"]: r["competition_score"] for r in sites.competition_score(sites_df, rivals).collect()} == {1: 60.0, 2: 85.0, 3: 60.0}


def test_zone_area_counts_once(spark):
    zones_df = spark.createDataFrame([(1, 1, "z", "shelf", 10.0, True), (2, 1, "y", "shelf", 30.0, True)], "id int, store_id int, zone_name string, zone_type string, area_sqm double, is_active boolean")
    facts = spark.createDataFrame([(1, date(2024, 1, d), 100.0, 1, 1.0, 5) for d in range(1, 11)], "zone_id int, sale_date date, revenue double, transaction_count long, items_sold double, traffic_count long")
    stores = spark.createDataFrame([(1, "s")], "id int, name string")
    row = zones.compare_zone_types(zones_df, stores, facts, "2024-01-01", "2024-01-31").first()
    assert (row["total_area_sqm"], row["revenue_per_sqm"], row["zone_count"]) == (40.0, 25.0, 2)


def test_quality_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "d date, a int")
    rows = {r["dimension"]: (r["score"], r["total_records"]) for r in quality.quality_scores([quality.Target("t", empty, "d", ["a"])], "2024-01-01").collect()}
    assert rows == {"completeness": (100.0, 0), "accuracy": (100.0, 0), "timeliness": (0.0, 0)}


def test_container_order_is_event_time(spark):
    rows = [(1, "load", "2024-01-03"), (1, "vessel_arrival", "2024-01-01"), (1, "stack", "2024-01-02"), (1, "inspection", "2024-01-04"), (2, "inspection", "2024-01-01")]
    events = spark.createDataFrame([(c, e, t, i) for i, (c, e, t) in enumerate(rows)], "container_id int, event_type string, t string, event_id int").withColumn(
        "event_time", F.col("t").cast("timestamp_ntz"))
    states = port.container_state(events)
    assert {r["container_id"]: r["status"] for r in states.collect()} == {1: "departed", 2: "en_route"}
    assert port.container_stats(states, "2024-02-01 00:00:00").first()["avg_dwell_hours"] == 48.0


def test_quality_checks_every_column(spark):
    names = [f"c{i}" for i in range(25)]
    df = spark.range(3).select(F.lit("2024-01-01").alias("day"), *[F.lit(None).cast("int").alias(c) for c in names])
    target = quality.Target("wide", df, "day", names)
    assert quality.completeness_columns(target, "2024-02-01").count() == 25
    assert quality.completeness(target, "2024-02-01").first()["failed_records"] == 75


def test_a_long_order_is_one_row(spark):
    """An order of 1 001 lines and more came in several rows, each with a part of its lines."""
    from aisle.operators import supply

    orders = spark.createDataFrame([(1, 7), (2, 7), (3, 7)], "order_no long, supplier_id long")
    items = spark.createDataFrame([(1, 7, i) for i in range(1500)] + [(2, 7, 4)], "order_no long, supplier_id long, item_id long")
    found = {r["order_no"]: r for r in supply.orders_with_items(orders, items).collect()}
    assert len(found) == 3 and {n: r["lines"] for n, r in found.items()} == {1: 1500, 2: 1, 3: 0}
    assert [i["item_id"] for i in found[1]["items"]] == list(range(1500))
