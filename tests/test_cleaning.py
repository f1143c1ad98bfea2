import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from aisle.operators import cleaning
from aisle.sources import feeds, sinks
from aisle.streaming import feeds as live

SALES = "store_id string, sale_date string, receipt_no string, item_id string, quantity string, unit_price string, total_amount string"


def sale(store="1", day="2024-01-01", receipt="r1", item="a", quantity="2", price="5", total="10"):
    return (store, day, receipt, item, quantity, price, total)


def stats(df, entity):
    return cleaning.clean_stats(df, entity).first().asDict()


def test_sales_rules(spark):
    df = spark.createDataFrame(
        [sale(), sale(), sale(receipt="r2", quantity=None), sale(receipt="r3", quantity="4"), sale("invalid", receipt="r4"),
         sale(day="not-a-date", receipt="r5"), sale(receipt=None), sale(receipt="r6", quantity="-1"), sale(receipt="r7", total="0")],
        SALES,
    )
    rows = {r["receipt_no"]: r for r in cleaning.clean_rows(df, "sales").collect()}
    assert set(rows) == {"r1", "r2", "r3", "r7"}
    assert rows["r2"]["quantity"] == 3.0 and rows["r7"]["total_amount"] == 10.0 and rows["r1"]["discount_amount"] == 0.0
    assert rows["r1"]["sale_date"] == date(2024, 1, 1)
    assert stats(df, "sales") == {"total_rows": 9, "duplicate_rows": 1, "error_rows": 2}


def test_missing_column_rejects_the_batch(spark):
    df = spark.createDataFrame([("1", "2024-01-01")] * 2 + [("2", "2024-01-01")], "store_id string, sale_date string")
    assert cleaning.clean_rows(df, "sales").count() == 0
    assert stats(df, "sales") == {"total_rows": 3, "duplicate_rows": 1, "error_rows": 2}


def test_median_then_zero_for_groups_without_values(spark):
    rows = [sale("1", receipt=f"r{i}", quantity=q) for i, q in enumerate(["1", "2", "9"])] + [sale("2", receipt="s", quantity=None)]
    out = {r["receipt_no"]: r["quantity"] for r in cleaning.clean_rows(spark.createDataFrame(rows, SALES), "sales").collect()}
    assert out["s"] == 2.0
    frame = spark.createDataFrame([("g", 1, None)], "k string, o int, v double")
    assert cleaning.interpolate(frame, ["v"], "k", ["o"], F.lit(1)).first()["v"] == 0.0


def test_headers_empty_rows_and_unknown_entity(spark):
    df = spark.createDataFrame([("p", "x"), (None, None), ("p", "x")], "` Promo Code` string, Name string")
    out = cleaning.clean_rows(df, "promotions")
    assert out.columns == ["promo_code", "name"] and out.count() == 1
    assert stats(df, "promotions") == {"total_rows": 2, "duplicate_rows": 1, "error_rows": 0}


def test_traffic_weather_and_members(spark):
    traffic = spark.createDataFrame(
        [("1", "2024-01-01", "8", "50"), ("1", "2024-01-01", "9", None), ("1", "2024-01-01", "10", "70"), ("1", "2024-01-02", "25", "5")],
        "store_id string, traffic_date string, hour string, enter_count string",
    )
    assert {r["hour"]: r["enter_count"] for r in cleaning.clean_rows(traffic, "traffic").collect()} == {8: 50.0, 9: 60.0, 10: 70.0}
    weather = spark.createDataFrame(
        [("x", "2024-01-01", "10", "150"), ("x", "2024-01-02", None, "-3"), ("x", "2024-02-03", "14", "50")],
        "city string, weather_date string, temp_high string, humidity string",
    )
    out = cleaning.clean_rows(weather, "weather").orderBy("weather_date").collect()
    assert [r["temp_high"] for r in out] == [10.0, 12.0, 14.0] and [r["humidity"] for r in out] == [100.0, 0.0, 50.0]
    members = spark.createDataFrame(
        [("m1", "2024-01-01", "138-1234-5678"), ("m2", "2024/1/2", "123"), ("m3", "never", None)], "member_no string, register_date string, phone string"
    )
    assert {r["member_no"]: r["phone"] for r in cleaning.clean_rows(members, "members").collect()} == {"m1": "13812345678", "m2": None}


def write(path, text):
    path.mkdir(exist_ok=True)
    (path / "a.csv").write_text(text, encoding="utf-8")
    return str(path)


def test_feed_keeps_short_lines_and_skips_long_ones(spark, tmp_path):
    feed = feeds.read_feed(spark, write(tmp_path / "f", "a,b,c\n1,2,3\n4,5\n6,7,8,9\n1,2,3,\n,x,\n"))
    assert sorted((r["a"] or "", r["b"], r["c"]) for r in feed.collect()) == [("", "x", None), ("1", "2", "3"), ("4", "5", None)]
    assert feed.first()["_file"].endswith("a.csv")


def test_competitors_need_a_name_column(spark, tmp_path):
    rows = feeds.read_competitors(spark, write(tmp_path / "c", "name,latitude\nA,1.5\nB,bad\n")).orderBy("name").collect()
    assert [(r["name"], r["latitude"], r["city"], r["data_source"]) for r in rows] == [("A", 1.5, None, "a.csv"), ("B", None, None, "a.csv")]
    with pytest.raises(ValueError):
        feeds.read_competitors(spark, write(tmp_path / "d", "title\nA\n"))


def test_import_twice(spark, tmp_path):
    head = SALES.replace(" string", "").replace(" ", "")
    first = write(tmp_path / "one", head + "\n1,2024-01-01,r1,a,2,5,10\n1,2024-01-01,r1,a,2,5,10\n1,2024-01-01,r2,a,1,5,5\nx,2024-01-01,r3,a,1,5,5\n")
    again = write(tmp_path / "two", head + "\n1,2024-01-01,r1,a,9,5,45\n1,2024-01-02,r9,a,1,5,5\n")
    target = str(tmp_path / "sales")
    assert cleaning.run_import(spark, first, "sales", target) == {
        "total_rows": 4, "processed_rows": 4, "success_rows": 2, "conflict_rows": 0, "error_rows": 1, "duplicate_rows": 1}
    result = cleaning.run_import(spark, again, "sales", target)
    assert (result["success_rows"], result["conflict_rows"]) == (1, 1)
    stored = {r["receipt_no"]: r["quantity"] for r in spark.read.parquet(target).collect()}
    assert stored == {"r1": 2.0, "r2": 1.0, "r9": 1.0}


def test_failed_load_leaves_nothing(spark, tmp_path):
    target = str(tmp_path / "t")
    broken = spark.range(3).select(F.raise_error(F.lit("stop")).cast("string").alias("x"))
    with pytest.raises(Exception):
        sinks.load_atomic(broken, target)
    sinks.load_atomic(spark.range(2), target)
    assert spark.read.parquet(target).count() == 2


def test_merge_refreshes_only_named_columns(spark):
    schema = "k int, region string, a int, b int"
    old = spark.createDataFrame([(1, None, 1, 1), (2, "x", 2, 2)], schema)
    new = spark.createDataFrame([(1, None, 9, 9), (3, "y", 3, 3)], schema)
    rows = {tuple(r) for r in sinks.merge_rows(old, new, ["k", "region"], ["a"]).collect()}
    assert rows == {(1, None, 9, 1), (2, "x", 2, 2), (3, "y", 3, 3)}
    with pytest.raises(ValueError):
        sinks.upsert("/nowhere", new, ["k"], ["a"], ["region"])


def reading(i, device, minute, kw):
    return {"id": i, "store_id": 1, "equipment_id": device, "reading_time": f"2024-01-01T00:{minute:02d}:00.000Z", "power_kw": kw, "energy_kwh": kw / 3600, "operational_state": "active"}


def drop(spark, folder, rows):
    lines = spark.createDataFrame([(json.dumps(r),) for r in rows], "j string")
    parsed = lines.select(F.from_json("j", feeds.READINGS).alias("r")).select("r.*")
    parsed.coalesce(1).write.mode("append").parquet(str(folder))


def test_running_state_survives_a_restart(spark, tmp_path):
    source, out, place = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    drop(spark, source, [reading(1, 1, 1, 36.0), reading(2, 2, 1, 10.0)])
    for _ in range(2):
        live.run_available(live.latest_state(feeds.stream_readings(spark, str(source))), live.batch_folder(out), "update", place)
        drop(spark, source, [reading(3, 1, 5, 72.0)])
    rows = {(r["batch"], r["equipment_id"]): r for r in spark.read.parquet(out).collect()}
    assert rows[1, 1]["cumulative_kwh"] == pytest.approx((36 + 72) / 3600) and rows[1, 1]["power_kw"] == 72.0
    assert (1, 2) not in rows


def test_stream_import_is_repeatable(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([sale(), sale(receipt="r2")], SALES).coalesce(1).write.parquet(source)
    stream = lambda: spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
    live.stream_import(spark, stream(), "sales", target, str(tmp_path / "state"))
    spark.createDataFrame([sale(quantity="7"), sale(receipt="r3")], SALES).coalesce(1).write.mode("append").parquet(source)
    live.stream_import(spark, stream(), "sales", target, str(tmp_path / "state"))
    assert {(r["receipt_no"], r["quantity"]) for r in spark.read.parquet(target).collect()} == {("r1", 2.0), ("r2", 2.0), ("r3", 2.0)}
    # A fresh checkpoint replays everything as batch 0, which owns and rewrites its folder only.
    live.stream_import(spark, stream(), "sales", target, str(tmp_path / "again"))
    assert spark.read.parquet(target).groupBy("receipt_no").count().where("count > 1").count() == 0


def test_gaps_across_batches(spark, tmp_path):
    source, root, place = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")
    schema = "source_id long, seq long, received_at timestamp_ntz"
    for first, seqs in ((True, [1, 2, 5]), (False, [9, 10])):
        rows = [(1, s, f"2024-01-01 0{s % 10}:00:00") for s in seqs] if first else [(1, s, f"2024-01-01 1{s % 10}:00:00") for s in seqs]
        frame = spark.createDataFrame(rows, "source_id long, seq long, received_at string").withColumn("received_at", F.col("received_at").cast("timestamp_ntz"))
        frame.coalesce(1).write.mode("append").parquet(source)
        live.stream_sequence_gaps(spark.readStream.schema(schema).parquet(source), root, place)
    gaps = {(r["previous_seq"], r["seq"], r["dropped"]) for r in spark.read.parquet(f"{root}/gaps").collect()}
    assert gaps >= {(2, 5, 2)}


QUOTED = 'id,name,n\n1,"5"" nail, big",3\n2,"two\nlines",4\n3,plain,5\n4,"too, many",6,7,8\n5,"",\n6,short\n'


def test_quoted_fields(spark, tmp_path):
    found = feeds.read_feed(spark, write(tmp_path / "q", QUOTED)).drop("_file").collect()
    rows = {r["id"]: (r["name"], r["n"]) for r in found}
    assert len(found) == 5
    assert rows == {"1": ('5" nail, big', "3"), "2": ("two\nlines", "4"), "3": ("plain", "5"), "5": (None, None), "6": ("short", None)}


def test_feed_without_line_breaks_stays_split(spark, tmp_path):
    found = feeds.read_feed(spark, write(tmp_path / "q", 'id,name\n1,"a ""b"", c"\n'), line_breaks=False).drop("_file")
    assert [tuple(r) for r in found.collect()] == [("1", 'a "b", c')]


def test_export_reads_back(spark, tmp_path):
    rows = [("1", 'say "hi", twice'), ("2", "line\nbreak"), ("3", "back\\slash"), ("4", '"')]
    sinks.export_csv(spark.createDataFrame(rows, "id string, name string"), str(tmp_path / "out"))
    assert '"say ""hi"", twice"' in "".join(p.read_text() for p in (tmp_path / "out").glob("*.csv"))
    found = feeds.read_feed(spark, str(tmp_path / "out")).drop("_file").collect()
    assert sorted(map(tuple, found)) == rows


def test_upsert_keeps_columns_that_the_update_lacks(spark, tmp_path):
    path = str(tmp_path / "facts")
    stored = spark.createDataFrame([(2024, 1, 5, "a"), (2024, 2, 6, "b"), (2023, 1, 7, "c")], "year int, k int, q int, extra string")
    sinks.upsert(path, stored, ["year", "k"], ["q"], ["year"])
    update = spark.createDataFrame([(2024, 1, 50), (2024, 3, 60)], "year int, k int, q int")
    sinks.upsert(path, update, ["year", "k"], ["q"], ["year"])
    rows = spark.read.parquet(path).select("year", "k", "q", "extra").collect()
    assert sorted(map(tuple, rows), key=str) == sorted(
        [(2023, 1, 7, "c"), (2024, 1, 50, "a"), (2024, 2, 6, "b"), (2024, 3, 60, None)], key=str
    )
    with pytest.raises(ValueError, match="does not have"):
        sinks.upsert(path, update.withColumn("new", F.lit(1)), ["year", "k"], ["q"], ["year"])


def test_slices_are_cleared_whatever_their_names(spark, tmp_path):
    path = str(tmp_path / "slices")
    names = ["Food/Drink", "a b", "100%", "x=y:z", None, "kept"]
    sinks.replace_slice(path, spark.createDataFrame([(n, 1) for n in names], "s string, q int"), ["s"])
    cleared = spark.createDataFrame([(n,) for n in names if n != "kept"], "s string")
    sinks.replace_slice(path, spark.createDataFrame([("kept", 2), ("Food/Drink", 3)], "s string, q int"), ["s"], cleared)
    found = spark.read.schema("s string, q int").parquet(path).select("s", "q").collect()
    assert sorted(map(tuple, found)) == [("Food/Drink", 3), ("kept", 2)]


def test_imports_hand_on_whether_fields_hold_line_breaks(spark, tmp_path, monkeypatch):
    asked, read = [], feeds.read_feed

    def spy(session, path, line_breaks=True):
        asked.append(line_breaks)
        return read(session, path, line_breaks)

    monkeypatch.setattr(feeds, "read_feed", spy)
    monkeypatch.setattr(cleaning, "read_feed", spy)
    path = write(tmp_path / "c", "name,latitude\nA,1.5\n")
    assert feeds.read_competitors(spark, path, line_breaks=False).count() == 1
    cleaning.run_import(spark, path, "competitors", str(tmp_path / "t"), line_breaks=False)
    feeds.read_competitors(spark, path)
    assert asked == [False, False, True]
