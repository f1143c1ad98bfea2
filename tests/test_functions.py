import math
import random
from datetime import date, datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from aisle.functions import bitmaps, listing, ordered, scalars, scope, stats


@pytest.fixture(scope="module")
def readings(spark):
    """Three keys; key 1 holds most rows, and some of its times are equal."""
    random.seed(5)
    start = datetime(2024, 1, 1)
    rows = []
    for i in range(900):
        key = 1 if i % 5 else 2 + i % 2
        rows.append((key, i, start + timedelta(minutes=random.randrange(3000)), float(random.randrange(1000)) / 4))
    rows = [(k, i, t, None if i % 6 == 0 else v) for k, i, t, v in rows]
    pdf = pd.DataFrame(rows, columns=["k", "id", "t", "v"])
    df = spark.createDataFrame(rows, "k int, id int, t timestamp_ntz, v double")
    return df.withColumn("hour", F.date_trunc("hour", "t")), pdf.sort_values(["k", "t", "id"])


def order():
    return [F.col("t"), F.col("id")]


def test_running_sum_and_position(readings):
    df, pdf = readings
    out = ordered.running_sum(df.fillna(0.0), ["k"], "hour", order(), F.col("v"), "s")
    out = ordered.position(out, ["k"], "hour", order(), "n").toPandas().sort_values(["k", "t", "id"])
    expected = pdf.fillna({"v": 0.0})
    assert np.allclose(out["s"], expected.groupby("k")["v"].cumsum())
    assert (out["n"].to_numpy() == expected.groupby("k").cumcount().to_numpy() + 1).all()


def test_lag_crosses_buckets(readings):
    df, pdf = readings
    out = ordered.lag_values(df, ["k"], "hour", order(), {"id": "before"}).toPandas().sort_values(["k", "t", "id"])
    expected = pdf.groupby("k")["id"].shift(1)
    assert out["before"].fillna(-1).tolist() == expected.fillna(-1).tolist()


def test_newest_rows(readings):
    df, pdf = readings
    out = ordered.newest_rows(df, ["k"], "hour", [F.desc("t"), F.desc("id")], 40)
    got = {(r["k"], r["id"]) for r in out.collect()}
    expected = pdf.groupby("k").tail(40)
    assert got == set(zip(expected["k"], expected["id"]))


def test_interpolation_equals_pandas(readings):
    df, pdf = readings
    out = ordered.interpolate(df, ["v"], ["k"], "hour", order()).toPandas().sort_values(["k", "t", "id"])
    expected = pdf.groupby("k")["v"].transform(lambda s: s.interpolate(method="linear", limit_direction="both"))
    assert np.allclose(out["v"], expected)


def test_lower_totals(spark):
    random.seed(1)
    rows = [(i % 2, float(random.randrange(50)), 1) for i in range(400)]
    df = spark.createDataFrame(rows, "k int, v double, n int")
    for r in ordered.lower_totals(df, ["k"], "v", "n", "lower", ranges=8).collect():
        assert r["lower"] == sum(1 for k, v, _ in rows if k == r["k"] and v < r["v"])


@pytest.mark.parametrize("values", [[3.0], [1.0, 2.0], [5.0] * 40 + [1.0], list(np.random.default_rng(3).normal(size=500))])
def test_exact_quantiles(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    row = stats.exact_quantiles(df, "v", {"a": 0.25, "b": 0.5, "c": 0.95}).first()
    assert np.allclose([row["a"], row["b"], row["c"]], np.percentile(values, [25, 50, 95]))


def test_global_rank_with_ties(spark):
    random.seed(2)
    rows = [(i, float(random.randrange(20))) for i in range(300)] + [(1000, None)]
    ranked = listing.global_rank(spark.createDataFrame(rows, "id int, v double"), "v", ["id"], buckets=8).collect()
    order = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert [r["id"] for r in sorted(ranked, key=lambda r: r["rank"])] == [r[0] for r in order]
    assert sorted(r["rank"] for r in ranked) == list(range(1, len(rows) + 1))


@pytest.mark.parametrize(
    "r,n,p",
    # Table values of the t distribution: |t| with n - 2 degrees of freedom and its two-sided p.
    [(12.706 / math.sqrt(1 + 12.706**2), 3, 0.05), (4.303 / math.sqrt(2 + 4.303**2), 4, 0.05),
     (2.228 / math.sqrt(10 + 2.228**2), 12, 0.05), (2.947 / math.sqrt(15 + 2.947**2), 17, 0.01), (0.0, 9, 1.0)],
)
def test_pearson_p(spark, r, n, p):
    row = spark.createDataFrame([(r, n)], "r double, n long").select(stats.pearson_p(F.col("r"), F.col("n")).alias("p")).first()
    assert row["p"] == pytest.approx(p, abs=2e-4)


def test_scope(spark):
    df = spark.createDataFrame([(i,) for i in range(6)], "store_id long")
    ids = lambda d: sorted(r[0] for r in d.collect())
    assert ids(scope.scope_stores(df, None)) == [0, 1, 2, 3, 4, 5]
    assert ids(scope.scope_stores(df, [])) == []
    assert ids(scope.scope_stores(df, [4, 2, 9])) == [2, 4]
    assert ids(scope.scope_stores(df, range(2, 2000))) == [2, 3, 4, 5]
    permissions = spark.createDataFrame([(7, 1), (7, 3), (8, 2)], "user_id int, store_id long")
    assert ids(scope.scope_stores(df, scope.authorised_stores(permissions, 7))) == [1, 3]
    assert scope.authorised_stores(permissions, 7, is_admin=True) is None


@pytest.mark.parametrize(
    "asked,may,result", [(None, None, None), ([3, 1], None, [1, 3]), (None, [2, 1], [1, 2]), ([1, 5], [1, 2], [1]), ([5], [1], []), (None, [], [])]
)
def test_effective_scope(asked, may, result):
    assert scope.effective_scope(asked, may) == result


def test_scalars(spark):
    row = (
        spark.createDataFrame([("13812345678", "12812345678", "  x" + "y" * 300, date(2024, 5, 15))], "a string, b string, c string, d date")
        .select(
            scalars.valid_phone("a").alias("good"), scalars.valid_phone("b").alias("bad"),
            F.length(scalars.tidy_text("c")).alias("cut"),
            scalars.time_bucket("d", "weekly").alias("week"), scalars.time_bucket("d", "monthly").alias("month"),
            scalars.time_bucket("d", "other").alias("day"), scalars.sunday_dow("d").alias("dow"),
            scalars.safe_div(F.lit(1), F.lit(0), 7.0).alias("guard"), scalars.round_to(F.lit(2.345), 2).alias("r"),
            scalars.great_circle_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("km"),
            scalars.clamp(F.lit(None).cast("double"), 0.0, 1.0).alias("null"),
        )
        .first()
    )
    assert (row["good"], row["bad"], row["cut"], row["dow"], row["guard"]) == (True, False, 200, 3, 7.0)
    assert (row["week"], row["month"], row["day"]) == (date(2024, 5, 13), date(2024, 5, 1), date(2024, 5, 15))
    assert row["km"] == pytest.approx(111.19, abs=0.01) and row["null"] is None


def test_listing(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 6), ("b", 1, 7)], "k string, t int, v int")
    latest = {tuple(r) for r in listing.latest_per_key(df, ["k"], [F.col("t")]).collect()}
    assert latest == {("a", 2, 6), ("b", 1, 7)}
    assert {r["k"] for r in listing.latest_snapshot(df, "t").collect()} == {"a"}
    order = [r["k"] for r in df.select("k").distinct().orderBy(listing.prioritised("k", ["b", "a"])).collect()]
    assert order == ["b", "a"]
    assert listing.page_counts(df, 2).first().asDict() == {"total": 3, "total_pages": 2}
    assert listing.hour_spine(spark).count() == 24
    assert listing.with_dow_hours(df).count() == 3 * 168


def test_ranks_and_deep_pages_of_tied_values(spark):
    """Nine tenths share one value: ranges stay even, ranks and pages are those of the sorted list."""
    rows = [(i * 7919 % 20_011, 5.0 if i % 10 else float(i % 97)) for i in range(20_000)]
    rows[3] = (rows[3][0], None)
    df = spark.createDataFrame(rows, "id long, v double").repartition(7)
    wanted = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    ranked = listing.global_rank(df, "v", ["id"]).collect()
    assert [(r.id, r.v) for r in sorted(ranked, key=lambda r: r.rank)] == wanted and {r.rank for r in ranked} == set(range(1, 20_001))
    order = [F.col("v").desc_nulls_last(), F.col("id").asc()]
    stored = listing.in_order(df, order)
    sizes = [r["_rows"] for r in listing._range_sizes(stored).collect()]
    assert sum(sizes) == 20_000 and max(sizes) < 2 * 20_000 / int(spark.conf.get("spark.sql.shuffle.partitions"))
    for page_no, size in ((1, 50), (399, 50), (400, 50), (401, 50), (3, 6000), (4, 6000)):
        want = wanted[(page_no - 1) * size : page_no * size]
        assert [tuple(r) for r in listing.ordered_page(stored, page_no, size).collect()] == want
        assert [tuple(r) for r in listing.page(df, order, page_no, size).collect()] == want
    files = lambda d: len(d.select(F.col("_metadata.file_path")).distinct().collect())
    assert files(stored) == len(sizes)
    plan = listing.ordered_page(stored, 200, 50)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(_place), GreaterThanOrEqual(_place" in plan


def test_pages_of_nothing_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, 1.0)] * 30, "id long, v double")
    stored = listing.in_order(df, [F.col("v")])
    assert [listing.ordered_page(stored, n, 20).count() for n in (1, 2, 3)] == [20, 10, 0]
    assert listing.ordered_page(listing.in_order(df.limit(0), [F.col("v")]), 1, 20).count() == 0
    assert listing.global_rank(df.limit(0), "v", ["id"]).count() == 0


def test_distinct_ids_of_any_period(spark):
    random.seed(6)
    rows = [(date(2024, 1, 1 + random.randrange(9)), random.choice("ab"), random.choice([None, *range(-40, 70_000, 977)]), f"m{random.randrange(50)}") for _ in range(600)]
    lines = spark.createDataFrame(rows, "d date, c string, n long, name string")
    first = bitmaps.grow_dictionary(lines.where("name < 'm3'"), "name")
    codes = bitmaps.grow_dictionary(lines, "name", first)
    numbers = {r["name"]: r["code"] for r in codes.collect()}
    assert sorted(numbers.values()) == list(range(1, len(numbers) + 1)) and set(numbers) == {r[3] for r in rows}
    assert {r["name"]: r["code"] for r in first.collect()}.items() <= numbers.items()
    daily = bitmaps.daily_bitmaps(lines, "d", ["c"], {"n": None, "name": codes})
    for lo, hi in ((1, 9), (3, 5), (8, 8), (20, 21)):
        span = (f"2024-01-{lo:02d}", f"2024-01-{hi:02d}")
        some = [r for r in rows if lo <= r[0].day <= hi]
        found = {(r["c"], r["what"]): r["n"] for r in bitmaps.distinct_counts(daily, ["c"], *span).collect()}
        wanted = {(c, w): len({r[k] for r in some if r[1] == c} - {None}) for c in "ab" for w, k in (("n", 2), ("name", 3))}
        assert found == {k: v for k, v in wanted.items() if v}
        both = bitmaps.overlap_counts(daily, "c", {"both": ["a", "b"]}, "name", *span).first()["both"]
        assert both == len({r[3] for r in some if r[1] == "a"} & {r[3] for r in some if r[1] == "b"})
