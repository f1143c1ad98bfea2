"""Figures that must not grow with the input: folders of an import, maps before shuffles, shuffles, objects of a group."""

import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from aisle.operators import basket, cleaning, kpi, supply
from aisle.plans import forecasting
from aisle.session import checkpoint_root, cut_lineage, passing_tables
from aisle.sources import feeds, sinks
from aisle.sources.standins import Tables
from aisle.streaming import feeds as live

SALES = "store_id string, sale_date string, receipt_no string, item_id string, quantity string, unit_price string, total_amount string"


def _sales(spark, n=300):
    return spark.range(n).select(
        F.col("id").cast("string").alias("store_id"), F.lit("2024-01-01").alias("sale_date"), F.format_string("r%04d", F.col("id")).alias("receipt_no"),
        F.lit("a").alias("item_id"), F.lit("1").alias("quantity"), F.lit("5").alias("unit_price"), F.lit("5").alias("total_amount"),
    )


def _folders(place):
    return {p.parent.name for p in place.rglob("*.parquet")}


def test_import_folders_do_not_grow_with_stores(spark, tmp_path):
    path, target = str(tmp_path / "in"), tmp_path / "out"
    sinks.export_csv(_sales(spark).coalesce(1), path)
    assert cleaning.run_import(spark, path, "sales", str(target))["success_rows"] == 300
    assert len(_folders(target)) <= cleaning.STORE_GROUPS
    assert cleaning.run_import(spark, path, "sales", str(target))["conflict_rows"] == 300
    assert {r["store_id"] for r in spark.read.parquet(str(target)).collect()} == set(range(300))


def test_stream_import_keeps_nothing_but_its_result(spark, tmp_path):
    source, target, root = str(tmp_path / "in"), str(tmp_path / "out"), checkpoint_root(spark)
    before = set(os.listdir(root))
    for _ in range(2):  # the second one meets stored keys
        _sales(spark).coalesce(1).write.mode("append").parquet(source)
        live.stream_import(spark, spark.readStream.schema(SALES).parquet(source), "sales", target, str(tmp_path / "state"))
    assert not set(os.listdir(root)) - before
    counts = live.imports(spark, target).orderBy(live.ARRIVED).collect()
    assert [(r.total_rows, r.success_rows, r.conflict_rows) for r in counts] == [(300, 300, 0), (300, 0, 300)]
    assert live.imported(spark, target).count() == 300


def test_passing_tables_go_after_a_failure(spark):
    with pytest.raises(ValueError), passing_tables(spark, "passing") as outer:
        with passing_tables(spark, "inner") as inner:
            kept = cut_lineage(spark.range(7), "kept", outer)
            cut_lineage(spark.range(5))
            assert len(os.listdir(inner)) == 1
        assert not os.path.exists(inner) and kept.count() == 7
        raise ValueError
    assert not os.path.exists(outer)
    assert cut_lineage(spark.range(3)).inputFiles()[0].startswith(f"file://{checkpoint_root(spark)}/cut-")


def test_stream_import_folders_do_not_grow_with_stores(spark, tmp_path):
    source, target = str(tmp_path / "in"), tmp_path / "out"
    _sales(spark).coalesce(1).write.parquet(source)
    live.stream_import(spark, spark.readStream.schema(SALES).parquet(source), "sales", str(target))
    assert len(_folders(target)) <= cleaning.STORE_GROUPS
    rows = live.imported(spark, str(target))
    assert rows.count() == 300 and "store_group" not in rows.columns


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _dealt_before_grouped(df, scan):
    """Under the dealing by a given number of tasks there is no hash map, only the scan of the column."""
    plan = _plan(df)
    at = plan.find("REPARTITION_BY_NUM")
    return at >= 0 and "Aggregate" not in plan[at : plan.index(scan, at)]


@pytest.fixture(scope="module")
def tables(spark):
    return Tables(spark, "/root/testdata/sf0.001")


def test_summary_deals_lines_before_receipts(spark, tables):
    lines = tables.sales("sale_date", "store_id", "receipt_no", "member_id", "total_amount", "discount_amount")
    assert _dealt_before_grouped(kpi.kpi_summary(lines, tables.stores, "1995-01-01", "2001-11-04"), "l_orderkey")


def test_purchase_orders_are_dealt_before_grouped(spark, tables):
    assert _dealt_before_grouped(supply.supplier_trend(tables("supplier_performance")), "l_orderkey")


@pytest.mark.parametrize("operator", [supply.order_lines, supply.orders_with_items])
def test_order_items_are_dealt_before_grouped(spark, operator):
    orders = spark.createDataFrame([("o1", 1, "x"), ("o2", 1, "y")], "order_no string, supplier_id int, status string")
    items = spark.createDataFrame([("o1", 1, 5, 2.0), ("o1", 1, 4, 1.0)], "order_no string, supplier_id int, item_id int, quantity double")
    found = operator(orders, items)
    assert _dealt_before_grouped(found, "LogicalRDD" if "LogicalRDD" in _plan(found) else "Scan")
    assert found.count() == (3 if operator is supply.order_lines else 2)


def test_promo_days_are_dealt_before_grouped(spark, tables):
    assert _dealt_before_grouped(forecasting.promo_lift(tables), "l_suppkey")


def test_interpolation_shuffles_rows_once(spark):
    plan = _plan(cleaning.clean_rows(_sales(spark), "sales"))
    exchanges = [line for line in plan.split("\n") if "Exchange hashpartitioning" in line]
    # Rows and ends by store and bucket, and the ends by store; AQE finds the two equal ones of the rows when it runs.
    assert len(exchanges) <= 4
    assert sum("store_id" in line and "_bucket" not in line for line in exchanges) == 1


@pytest.mark.parametrize("item", [pa.string(), pa.int64()])
def test_mining_stays_in_arrow(item):
    value = str if item == pa.string() else int
    tails = [[1, 2], [1], [], [1, 2, 3], [2]]
    group = pa.table({
        basket.SLICE: pa.array([7] * 5), "prefix": pa.array([[value(0)]] * 5, pa.list_(item)), "least": pa.array([2.0] * 5),
        "tail": pa.array([[value(x) for x in t] for t in tails], pa.list_(item)),
    })
    parts = pa.concat_tables([group.slice(0, 2), group.slice(2)])
    found = {tuple(r["items"]): r["support_count"] for r in basket._mine(None)(parts).to_pylist()}
    assert found == {(value(0), value(1)): 3, (value(0), value(2)): 3, (value(0), value(1), value(2)): 2}
    rare = basket._mine(None)(group.set_column(2, "least", pa.array([9.0] * 5)))
    assert rare.num_rows == 0 and rare.schema.field("items").type == pa.list_(item)


def test_import_reads_its_file_once_and_shuffles_rows_for_fill_and_keys_once(spark, tmp_path, monkeypatch):
    path, plans, write = str(tmp_path / "in"), {}, cleaning.cut_lineage

    def spy(df, label="cut"):
        plans[label] = _plan(df)
        return write(df, label)

    monkeypatch.setattr(cleaning, "cut_lineage", spy)
    sinks.export_csv(_sales(spark).coalesce(1), path)
    cleaning.run_import(spark, path, "sales", str(tmp_path / "out"))
    assert [label for label, plan in plans.items() if "FileScan csv" in plan] == ["counted"]
    assert plans["clean-sales"].count("Exchange hashpartitioning") == 1 and "min(struct" in plans["clean-sales"]


@pytest.mark.parametrize("whole", [200_000, 40])
def test_large_groups_are_filled_in_chunks_with_the_same_rows(spark, monkeypatch, whole):
    rows = [
        (s, f"2024-01-{1 + i // 10:02d}", f"{i % 10}{i:03d}", "a", None if (i * 7 + j) % 5 < 3 else str(i * i % 37 + 1), None if i % 9 else "4", "5")
        for j, s in enumerate(["1", "1.0", "1.5", "2", "x"]) for i in range(30 if s == "2" else 90)
    ]
    frame = spark.createDataFrame(rows + rows[:20], SALES)
    monkeypatch.setattr(cleaning, "WHOLE", whole)
    found = cleaning.clean_rows(frame, "sales").toPandas()
    # Each store number by position, as numpy does it.
    import numpy as np
    import pandas as pd

    all_rows = pd.DataFrame(rows, columns=[c.split()[0] for c in SALES.split(", ")]).drop_duplicates()
    all_rows = all_rows[all_rows.store_id != "x"].astype({"store_id": float, "quantity": float, "unit_price": float})
    wanted = []
    for store, g in all_rows.groupby("store_id"):
        g = g.sort_values(["sale_date", "receipt_no", "item_id", "quantity", "unit_price"], na_position="first", kind="stable")
        for c in ("quantity", "unit_price"):
            known = g[c].notna().to_numpy()
            at = np.arange(len(g))
            g[c] = np.interp(at, at[known], g[c].to_numpy()[known])
        wanted += [(int(store), str(d), r, round(q, 9), round(u, 9)) for d, r, q, u in zip(g.sale_date, g.receipt_no, g.quantity, g.unit_price)]
    got = [(int(r.store_id), str(r.sale_date), r.receipt_no, round(r.quantity, 9), round(r.unit_price, 9)) for r in found.itertuples()]
    assert sorted(got) == sorted(wanted)


def test_good_lines_of_a_feed_are_no_broken_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,b\n1,2\n"x\ny",3\n4\n5,6,7\n8,9,\n8,9,,\n', encoding="utf-8")
    feed = feeds.read_feed(spark, str(tmp_path / "a.csv"))
    assert sorted((r["a"], r["b"]) for r in feed.collect()) == [("1", "2"), ("4", None), ("8", "9"), ("x\ny", "3")] and feed.count() == 4
    # Only a line of another length is parsed again, so the reader's schema has no field beyond the header's.
    assert "_extra_field" not in _plan(feed)
    (tmp_path / "none.csv").write_text("")
    assert feeds.read_feed(spark, str(tmp_path / "none.csv")).count() == 0
