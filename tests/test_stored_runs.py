"""Runs that store their results, and the numbers they rest on."""

import random
from datetime import date, datetime
from statistics import NormalDist, median

import pytest
from pyspark.sql import functions as F

from aisle import schemas
from aisle.functions import scope, stats
from aisle.operators import lifecycle, quality, supply


def test_normal_quantile(spark):
    levels = [1e-300, 1e-20, 1e-9, 0.001, 0.02425, 0.0749999, 0.075, 0.3, 0.5, 0.9, 0.925, 0.95, 0.99, 0.999999, 0.0, 1.0, -1.0, None]
    rows = spark.createDataFrame([(p,) for p in levels], "p double").select("p", stats.normal_quantile(F.col("p")).alias("z")).collect()
    for p, z in rows:
        if p is None or not 0 < p < 1:
            assert z is None or z != z
        else:
            assert z == pytest.approx(NormalDist().inv_cdf(p), rel=1e-13, abs=1e-15)


def test_medians_by_key(spark):
    rng = random.Random(5)
    rows = [(k, rng.choice([None, *range(7)])) for k in "abc" for _ in range(rng.randrange(20, 60))] + [("d", None), ("e", 4)]
    rows = [(k, None if v is None else float(v)) for k, v in rows]
    found = stats.exact_medians(spark.createDataFrame(rows, "k string, v double"), "v", ["k"], "m").collect()
    wanted = {k: median([v for x, v in rows if x == k and v is not None]) for k in "abce"}
    assert {r.k: r.m for r in found} == wanted


def test_store_lists_of_any_kind_and_length(spark):
    rows = spark.range(3000).select(F.col("id").alias("store_id"), F.concat(F.lit("s"), F.col("id")).alias("code"))
    assert scope.scope_stores(rows, range(500, 2900)).count() == 2400
    assert scope.scope_stores(rows, [f"s{i}" for i in range(1500)], "code").count() == 1500
    assert scope.scope_stores(rows, []).count() == 0


def staged(spark, rows):
    columns = "product_id long, snapshot_week date, stage string, weekly_revenue double, weekly_quantity double, growth_rate double, adoption_rate double, market_share double, margin_rate double, velocity double"
    return spark.createDataFrame(rows, columns)


def test_a_second_snapshot_refreshes_some_figures(spark, tmp_path):
    path, week, before = str(tmp_path / "s"), date(2024, 1, 1), date(2023, 12, 25)
    lifecycle.snapshot_lifecycle(path, staged(spark, [(1, before, "growth", 1.0, 1.0, 1.0, 1.0, 0.0, 1.0, 1.0)]))
    lifecycle.snapshot_lifecycle(path, staged(spark, [(1, week, "growth", 2.0, 2.0, 2.0, 2.0, 0.0, 2.0, 2.0)]))
    lifecycle.snapshot_lifecycle(path, staged(spark, [(1, week, "growth", 7.0, 7.0, 7.0, 7.0, 0.0, 7.0, 7.0)]), store_id=5)
    lifecycle.snapshot_lifecycle(path, staged(spark, [(1, week, "decline", 3.0, 3.0, 3.0, 3.0, 0.0, 3.0, 3.0), (2, week, "maturity", 4.0, 4.0, 4.0, 4.0, 0.0, 4.0, 4.0)]))
    rows = spark.read.parquet(path)
    names = ["stage", "weekly_revenue", "growth_rate", "velocity", "weekly_quantity", "adoption_rate", "margin_rate"]
    found = {(r.product_id, str(r.snapshot_week), r.store_id): tuple(r[n] for n in names) for r in rows.collect()}
    assert found == {
        (1, "2023-12-25", None): ("growth", 1.0, 1.0, 1.0, 1.0, 1.0, 1.0),
        (1, "2024-01-01", None): ("decline", 3.0, 3.0, 3.0, 2.0, 2.0, 2.0),
        (1, "2024-01-01", 5): ("growth", 7.0, 7.0, 7.0, 7.0, 7.0, 7.0),
        (2, "2024-01-01", None): ("maturity", 4.0, 4.0, 4.0, 4.0, 4.0, 4.0),
    }


def test_check_runs_store_scores_alerts_and_themselves(spark, tmp_path):
    root = str(tmp_path / "q")
    table = lambda bad: quality.Target(
        "sales", spark.createDataFrame([(i, date(2024, 1, 9), -1.0 if i < bad else 1.0) for i in range(10)], "store_id int, d date, v double"), "d", ["v"], {"v": F.col("v") < 0}
    )
    first = quality.run_checks([table(4)], root, "2024-01-10 12:00:00").first()
    second = quality.run_checks([table(2)], root, "2024-01-10 18:00:00").first()
    third = quality.run_checks([table(2)], root, "2024-01-11 19:00:00").first()
    assert [r.alerts_generated for r in (first, second, third)] == [1, 0, 1] and first.rules_checked == 3
    scores = {(r.dimension, str(r.score_date)): (r.failed_records, r.passed_records) for r in spark.read.parquet(f"{root}/scores").collect()}
    # The second run of the day refreshes what failed; what passed stays as the first run found it.
    assert scores["accuracy", "2024-01-10"] == (2, 6) and scores["accuracy", "2024-01-11"] == (2, 8) and len(scores) == 6
    assert sorted(r.severity for r in spark.read.parquet(f"{root}/alerts").collect()) == ["critical", "error"]
    assert spark.read.parquet(f"{root}/runs").count() == 3


def test_order_lines_are_flat(spark):
    orders = spark.createDataFrame([(1, 1, "x"), (2, 1, "y")], "order_no long, supplier_id long, status string")
    items = spark.createDataFrame([(1, 1, i, float(i)) for i in (2500, 7, 1200)], "order_no long, supplier_id long, item_id long, quantity double")
    rows = supply.order_lines(orders, items).collect()
    assert sorted((r.order_no, r.line_no or 0, r.item_id or 0) for r in rows) == [(1, 1, 7), (1, 2, 1200), (1, 3, 2500), (2, 0, 0)]
    log = spark.createDataFrame([(i, i % 3, datetime(2024, 1, 1 + i)) for i in range(9)], "id long, store_id long, created_at timestamp")
    assert [r.id for r in supply.list_adjustments(log, [1, 2], 2, 4).collect()] == [2, 1]


def test_declared_types(spark, tmp_path):
    rows = spark.createDataFrame([("7", "2024-02-30", "r1", "1.5"), ("x", "2024-02-29", "r2", "n/a")], "store_id string, sale_date string, receipt_no string, quantity string")
    typed = schemas.conform(rows, "sales")
    assert typed.schema == schemas.schema("sales")
    assert [(r.store_id, str(r.sale_date), r.quantity, r.channel) for r in typed.orderBy("receipt_no").collect()] == [
        (7, "None", 1.5, None), (None, "2024-02-29", None, None),
    ]
    typed.write.parquet(f"{tmp_path}/sales")
    assert schemas.load_table(spark, str(tmp_path), "sales").where("quantity = 1.5").count() == 1
    for name in schemas.TABLES:
        assert schemas.conform(rows, name).columns == [f.name for f in schemas.schema(name)]
