"""Live feeds: results do not depend on how files fall into micro-batches, and state ends."""

import os
import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from aisle.operators import cleaning, port
from aisle.sources import sinks
from aisle.streaming import contacts, containers
from aisle.streaming import feeds as live

T0 = datetime(2024, 1, 1)


def drop(spark, path, rows, schema, second):
    """One more file, with a time of its own so that files are taken in this order."""
    before = set(os.listdir(path)) if os.path.isdir(path) else set()
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    for name in set(os.listdir(path)) - before:
        os.utime(f"{path}/{name}", (1_700_000_000 + second, 1_700_000_000 + second))


def stream(spark, path, files):
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files).parquet(path)


def plain_contacts(rows, rules, memory_days):
    """Requests in order of time against all that was sent before."""
    sent, out = defaultdict(list), []
    for at, campaign, member in sorted(rows):
        cooldown, most = rules.get(campaign, (7, 3))
        everything = sent[member]
        own = [t for t, c in everything if c == campaign and t >= at - timedelta(days=memory_days)]
        if any(t >= at - timedelta(hours=24) for t, _ in everything) or len(own) >= most:
            continue
        if own and max(own) > at - timedelta(days=cooldown):
            continue
        everything.append((at, campaign))
        out.append((member, campaign, at))
    return sorted(out)


def requests(seed=1, days=40, members=3):
    rng = random.Random(seed)
    rows = {(T0 + timedelta(minutes=rng.randrange(days * 1440)), rng.randrange(4), m) for m in range(members) for _ in range(90)}
    return sorted(rows)


@pytest.mark.parametrize("files", [1, 20])
def test_contacts_whatever_the_batch(spark, tmp_path, files):
    rows, path = requests(), str(tmp_path / "in")
    for k in range(8):
        drop(spark, path, rows[k * len(rows) // 8 : (k + 1) * len(rows) // 8], "asked_at timestamp_ntz, campaign_id long, member_id long", k)
    rules = spark.createDataFrame([(1, 3, 2, True), (2, 1, 9, True), (3, 1, 1, False)], "campaign_id long, cooldown_days int, max_triggers_per_member int, is_active boolean")
    found = live.collect_stream(contacts.contacts(stream(spark, path, files), rules, memory_days=15), keyed=True)
    newest = max(r[0] for r in rows) - timedelta(minutes=10)
    wanted = plain_contacts([r for r in rows if r[0] <= newest], {1: (3, 2), 2: (1, 9)}, 15)
    assert sorted((r.member_id, r.campaign_id, r.sent_at.replace(tzinfo=None)) for r in found.collect()) == wanted


def test_executions_of_others_lock_and_state_ends(spark, tmp_path):
    path, other = str(tmp_path / "in"), str(tmp_path / "sent")
    ask = lambda hours, campaign=1, member=7: (T0 + timedelta(hours=hours), campaign, member)
    drop(spark, path, [ask(10), ask(23), ask(25), ask(26, 2), (None, 1, 7), (T0, None, 7), (T0, 1, None)], "asked_at timestamp_ntz, campaign_id long, member_id long", 0)
    drop(spark, path, [ask(24 * 200, 1, 8)], "asked_at timestamp_ntz, campaign_id long, member_id long", 1)
    drop(spark, path, [ask(24 * 201, 1, 9)], "asked_at timestamp_ntz, campaign_id long, member_id long", 2)
    schema = "sent_at timestamp_ntz, campaign_id long, member_id long, status string"
    drop(spark, other, [(T0, 5, 7, "delivered"), (T0, 1, 7, "failed"), (T0 + timedelta(days=201), 1, 1, "failed")], schema, 0)
    rules = spark.createDataFrame([(1, 1, 3, True)], "campaign_id long, cooldown_days int, max_triggers_per_member int, is_active boolean")
    sent = []
    made = contacts.contacts(stream(spark, path, 1), rules, stream(spark, other, 1), memory_days=30)
    query = live.run_available(made, lambda df, _: sent.extend(df.collect()), keyed=True)
    # Locked until the 24th hour by another system; then one contact, which locks the next.
    assert [(r.member_id, r.campaign_id) for r in sent] == [(7, 1), (8, 1)]
    assert sent[0].sent_at == T0 + timedelta(hours=25)
    # Nothing of member 7 is left after its memory; members 1, 8 and 9 are recent.
    rows = query.recentProgress[-1].stateOperators[0].numRowsTotal
    assert 0 < rows < 12


EVENTS = "container_id long, event_time timestamp_ntz, event_id long, event_type string"


def container_events(seed=3):
    rng, rows = random.Random(seed), []
    for c in range(6):
        at = T0
        for k in range(30):
            at += timedelta(minutes=rng.choice([20, 300, 5000]))
            rows.append((c, at, k, rng.choice([*port.EVENT_STATUS, "inspection"])))
    return sorted(rows, key=lambda r: r[1])


def plain_board(rows, silence):
    out = {}
    by = defaultdict(list)
    for c, at, k, kind in sorted(rows, key=lambda r: (r[1], r[2])):
        if by[c] and at - by[c][-1][0] > silence:
            by[c].clear()
        by[c].append((at, k, kind))
    for c, events in by.items():
        told = [port.EVENT_STATUS[kind] for _, _, kind in events if kind in port.EVENT_STATUS]
        last = lambda kinds: max((at for at, _, kind in events if kind in kinds), default=None)  # noqa: B023, E731
        out[c] = (events[0][0], told[-1] if told else "en_route", last({"vessel_arrival"}), last({"load", "gate_out"}))
    return out


@pytest.mark.parametrize("files", [1, 20])
def test_board_whatever_the_batch(spark, tmp_path, files):
    rows, path = container_events(), str(tmp_path / "in")
    for k in range(6):
        drop(spark, path, rows[k * 30 : (k + 1) * 30], EVENTS, k)
    board = containers.container_board(stream(spark, path, files), silence_days=3)
    found = live.collect_stream(board, "update", ["container_id"], keyed=True).collect()
    plain = lambda t: t.replace(tzinfo=None) if t else None
    got = {r.container_id: (plain(r.visit_start), r.status, plain(r.arrival_time), plain(r.departure_time)) for r in found}
    assert got == plain_board(rows, timedelta(days=3))


def test_board_state_is_bounded(spark, tmp_path):
    """Containers come and go; the state holds those that were heard of lately."""
    path = str(tmp_path / "in")
    for k in range(5):
        drop(spark, path, [(100 * k + c, T0 + timedelta(days=3 * k, minutes=c), c, "stack") for c in range(40)], EVENTS, k)
    query = live.run_available(containers.container_board(stream(spark, path, 1), silence_days=1), lambda df, _: df.count(), "update", keyed=True)
    sizes = [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators]
    # A visit and a timer for each container of the newest file, and no more than another file's before the watermark moves.
    assert sizes and max(sizes) < 5 * 40 * 2 * 2 and sizes[-1] <= 2 * 40 * 3


def test_yard_hours_wait_for_the_late_feed(spark, tmp_path):
    moves, meters = str(tmp_path / "moves"), str(tmp_path / "meters")
    reading = "id long, equipment_id long, reading_time timestamp_ntz, power_kw double, energy_kwh double, operational_state string"
    hour = lambda h, m=0: T0 + timedelta(hours=h, minutes=m)
    events = [(1, hour(0, 5), 1, "load"), (1, hour(0, 6), 2, "discharge"), (2, hour(0, 7), 3, "stack"), (2, hour(2, 1), 4, "load"), (3, hour(9), 5, "load")]
    drop(spark, moves, events, EVENTS, 0)
    drop(spark, meters, [(1, 1, hour(0, 1), 1.0, 2.0, "idle"), (2, 1, hour(0, 2), 1.0, 3.0, "on")], reading, 0)
    drop(spark, meters, [(3, 1, hour(1, 1), 1.0, 4.0, "on"), (4, 1, hour(4), 1.0, 5.0, "on")], reading, 1)
    found = live.collect_stream(live.yard_hours(stream(spark, moves, 1), stream(spark, meters, 1))).orderBy("metric_time").collect()
    got = [(r.metric_time.replace(tzinfo=None), r.total_containers, r.throughput_teu, r.avg_utilization, r.total_energy_kwh) for r in found]
    # The meters have only come to four o'clock; hour two has no reading, hour one no event.
    assert got == [(hour(0), 2, 2, 50.0, 5.0), (hour(1), 0, 0, 100.0, 4.0), (hour(2), 1, 1, 0.0, 0.0)]


def test_a_silent_source_starts_anew(spark, tmp_path):
    path, root = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "source_id long, seq long, received_at timestamp_ntz"
    drop(spark, path, [(1, 1, T0), (2, 1, T0)], schema, 0)
    drop(spark, path, [(1, 5, T0 + timedelta(days=6))], schema, 1)
    drop(spark, path, [(1, 9, T0 + timedelta(days=20)), (2, 9, T0 + timedelta(days=20))], schema, 2)
    live.stream_sequence_gaps(stream(spark, path, 1), root)
    assert [tuple(r)[:4] for r in spark.read.parquet(f"{root}/gaps").select("source_id", "seq", "previous_seq", "dropped").collect()] == [(1, 5, 1, 3)]
    last = spark.read.parquet(f"{root}/last").where("batch = 2").collect()
    assert sorted((r.source_id, r.seq) for r in last) == [(1, 9), (2, 9)]


SALES = "store_id string, sale_date string, receipt_no string, item_id string, quantity string, unit_price string, total_amount string"


def sale_files():
    """Files with gaps to fill, doubled lines and keys that other files hold too."""
    rng = random.Random(11)
    files = []
    for k in range(4):
        rows = []
        for i in range(40):
            number = rng.choice([None, "2", "3", "-1"])
            rows.append((str(1 + i % 3), f"2024-01-{1 + i % 9:02d}", f"r{rng.randrange(25)}", str(rng.randrange(3)), number, rng.choice(["4", None]), str(5 + k)))
        rows += rows[:3] + [(None, "2024-01-01", "r1", "1", "1", "1", "1"), ("9", "2024-01-01", f"x{k}", "1", None, None, "7")]
        files.append(rows)
    return files


@pytest.mark.parametrize("files", [1, 2, 10])
def test_stream_import_is_one_import_a_file(spark, tmp_path, files):
    path, target, one = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "one")
    counts = []
    for k, rows in enumerate(sale_files()):
        drop(spark, path, rows, SALES, k)
        csv = str(tmp_path / f"f{k}")
        sinks.export_csv(spark.createDataFrame(rows, SALES).coalesce(1), csv)
        counts.append(cleaning.run_import(spark, csv, "sales", one))
    live.stream_import(spark, stream(spark, path, files), "sales", target)
    columns = ["store_id", "sale_date", "receipt_no", "item_id", "quantity", "unit_price", "total_amount", "discount_amount"]
    rows = lambda df: sorted(map(str, df.select(*columns).collect()))
    assert rows(live.imported(spark, target)) == rows(spark.read.parquet(one))
    listed = live.imports(spark, target).orderBy(live.ARRIVED).collect()
    names = ["total_rows", "duplicate_rows", "error_rows", "success_rows", "conflict_rows"]
    assert [[r[n] for n in names] for r in listed] == [[c[n] for n in names] for c in counts]


def _scanned(df):
    """Rows that the file scans of a plan gave out, and the plan's text."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    total, queue = 0, [plan]
    while queue:
        node = queue.pop()
        name = node.nodeName()
        if name.startswith("Scan parquet"):
            total += node.metrics().apply("numOutputRows").value()
        if name == "AdaptiveSparkPlan":
            queue.append(node.executedPlan())
        elif name.endswith("QueryStage"):
            queue.append(node.plan())
        else:
            children = node.children()
            queue += [children.apply(k) for k in range(children.size())]
    return total, plan.toString()


def test_insert_reads_only_what_may_conflict(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(40_000).select((F.col("id") % 4).alias("store_id"), F.format_string("r%06d", F.col("id")).alias("receipt_no"), F.lit(1).alias("n"))
    before = spark.conf.get("spark.sql.files.maxRecordsPerFile", "0")
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "1000")
    try:
        sinks.insert_if_absent(path, rows, ["store_id", "receipt_no"], [F.col("n")], ["store_id"])
    finally:
        spark.conf.set("spark.sql.files.maxRecordsPerFile", before)
    batch = rows.where("store_id = 1 AND id BETWEEN 100 AND 160") if "id" in rows.columns else rows.where("store_id = 1 AND receipt_no BETWEEN 'r000100' AND 'r000160'")
    batch = batch.unionByName(spark.createDataFrame([(1, "r000158x", 1)], "store_id long, receipt_no string, n int"))
    stored = sinks.stored_near(path, batch, ["store_id", "receipt_no"], ["store_id"])
    scanned, plan = _scanned(stored)
    assert "PartitionFilters: [isnotnull(store_id" in plan or "PartitionFilters: [store_id" in plan
    assert "GreaterThanOrEqual(receipt_no" in plan
    assert 15 <= scanned <= 1000 < spark.read.parquet(path).count()
    assert sinks.insert_if_absent(path, batch, ["store_id", "receipt_no"], [F.col("n")], ["store_id"]) == {"inserted": 1, "conflicts": batch.count() - 1}


def test_bloom_filters_are_written(spark, tmp_path):
    path = tmp_path / "t"
    sinks.insert_if_absent(str(path), spark.range(1000).withColumn("k", F.col("id").cast("string")).coalesce(1), ["k"], [F.col("id")])
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for file in path.glob("*.parquet"):
        source = jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(str(file)), conf)
        reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(source)
        columns = reader.getFooter().getBlocks().get(0).getColumns()
        found = {columns.get(k).getPath().toDotString(): columns.get(k).getBloomFilterOffset() for k in range(columns.size())}
        reader.close()
        assert found["k"] > 0 > found["id"]
        # The filter has the size that its keys need, not the largest one.
        assert file.stat().st_size < 200_000
