"""Scope, filter, paging, sink and remaining feed queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from aisle.functions import listing, scope
from aisle.operators import cleaning, demand, energy, port, quality, replenishment
from aisle.plans.feeds import _KEYED, _dirty, _filled, _value
from aisle.plans.meters import _SLOTS
from aisle.plans.registry import query
from aisle.session import checkpoint_root
from aisle.sources import feeds as sources
from aisle.sources import sinks

M = "CAST(sum(CAST({} AS DECIMAL(18,4))) AS DOUBLE)"


def _place(t, label: str) -> str:
    return f"{checkpoint_root(t.spark)}/{label}-{uuid.uuid4().hex}"


@query(
    "scoped_sales",
    "SELECT s_suppkey AS store_id, count(*) AS lines FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE s_nationkey IN (3, 5, 7, 11) AND s_suppkey % 2 = 0 GROUP BY s_suppkey",
)
def scoped_sales(t):
    """Rows of the stores a user may see, by a permission table."""
    permissions = t("supplier").where(F.col("s_suppkey") % 2 == 0).select(
        F.col("s_nationkey").cast("long").alias("user_id"), F.col("s_suppkey").alias("store_id")
    )
    allowed = scope.authorised_stores(permissions.where(F.col("user_id").isin(3, 5, 7, 11)).withColumn("user_id", F.lit(1)), 1)
    return scope.scope_stores(t.sales("store_id"), allowed).groupBy("store_id").agg(F.count(F.lit(1)).alias("lines"))


@query(
    "scope_members",
    "SELECT id AS member_id, name FROM members WHERE id IN (SELECT member_id FROM channel_member_events WHERE store_id IN (2, 4))",
)
def scope_members(t):
    members = t("members").select(F.col("id").alias("member_id"), "name")
    return scope.scope_members(members, t("channel_member_events"), [2, 4])


@query(
    "keyword_search",
    "SELECT id, member_no, level FROM members WHERE (member_no ILIKE '%customer#0000001%' OR name ILIKE '%customer#0000001%') AND level = 'gold'",
)
def keyword_search(t):
    hits = scope.keyword_search(t("members"), ["member_no", "name"], "customer#0000001")
    return scope.where_optional(hits, level="gold", register_store_id=None).select("id", "member_no", "level")


@query("match_or_null", "SELECT doc_id, toxic FROM quality_target WHERE toxic IS NULL OR toxic = 1")
def match_or_null(t):
    return scope.match_or_null(t("quality_target"), "toxic", 1).select("doc_id", "toxic")


@query(
    "targets_item",
    "SELECT id, store_id, target_items LIKE '%7%' AS loose, list_contains(string_split(target_items, ','), '7') AS exact FROM promotions WHERE target_items IS NOT NULL",
)
def targets_item(t):
    rows = t("promotions").where(F.col("target_items").isNotNull())
    target, item = F.col("target_items"), F.lit("7")
    return rows.select(
        "id", "store_id", scope.targets_item(target, item).alias("loose"), scope.targets_item(target, item, exact=True).alias("exact")
    )


@query(
    "sales_page",
    "SELECT receipt_no, item_id, store_id, sale_date, quantity FROM sales WHERE sale_date BETWEEN DATE '2001-03-01' AND DATE '2001-03-31' ORDER BY sale_date DESC, receipt_no, item_id, quantity, store_id LIMIT 50 OFFSET 100",
)
def sales_page(t):
    rows = t.sales("receipt_no", "item_id", "store_id", "sale_date", "quantity", start="2001-03-01", end="2001-03-31")
    order = [F.desc("sale_date"), F.asc("receipt_no"), F.asc("item_id"), F.asc("quantity"), F.asc("store_id")]
    return listing.page(rows, order, 3, 50)


@query(
    "sales_page_deep",
    "SELECT receipt_no, item_id, store_id, sale_date, quantity FROM sales ORDER BY sale_date DESC, receipt_no, item_id, quantity, store_id LIMIT 50 OFFSET 25000",
)
def sales_page_deep(t):
    """The 501st page of all sale lines."""
    rows = t.sales("receipt_no", "item_id", "store_id", "sale_date", "quantity")
    return listing.page(rows, [F.desc("sale_date"), *[F.asc(c) for c in ("receipt_no", "item_id", "quantity", "store_id")]], 501, 50)


@query("page_counts", "SELECT count(*) AS total, CAST(ceil(count(*) / 50.0) AS BIGINT) AS total_pages FROM sales")
def page_counts(t):
    return listing.page_counts(t.sales("receipt_no"), 50)


@query(
    "date_spine",
    "WITH s AS (SELECT store_id, min(sale_date) AS a, max(sale_date) AS b FROM sales GROUP BY store_id) SELECT store_id, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS sale_date FROM s",
)
def date_spine(t):
    return listing.date_spine(t.sales("store_id", "sale_date"), "sale_date", ["store_id"])


@query(
    "latest_stock",
    "SELECT store_id, item_id, snapshot_date, quantity FROM inventory QUALIFY row_number() OVER (PARTITION BY store_id, item_id ORDER BY snapshot_date DESC) = 1",
)
def latest_stock(t):
    rows = t("inventory").select("store_id", "item_id", "snapshot_date", "quantity")
    return listing.latest_per_key(rows, ["store_id", "item_id"], [F.col("snapshot_date")])


_FIRST = "f AS (SELECT l_orderkey AS receipt_no, l_partkey AS item_id, min(l_extendedprice) AS price FROM lineitem WHERE l_linenumber <= 3 GROUP BY ALL)"


@query(
    "insert_if_absent",
    f"""
WITH {_FIRST}, g AS (SELECT l_orderkey AS receipt_no, l_partkey AS item_id, min(l_extendedprice) * 2 AS price FROM lineitem WHERE l_linenumber > 2 GROUP BY ALL)
SELECT * FROM f UNION ALL SELECT * FROM g WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.receipt_no = g.receipt_no AND f.item_id = g.item_id)""",
)
def insert_if_absent(t):
    """Two batches into one stored table; the first writer of a key stays."""
    path = _place(t, "inserted")
    rows = t("lineitem").select(
        F.col("l_orderkey").alias("receipt_no"), F.col("l_partkey").alias("item_id"), F.col("l_extendedprice").alias("price"), "l_linenumber"
    )
    keys, order = ["receipt_no", "item_id"], [F.col("price")]
    sinks.insert_if_absent(path, rows.where("l_linenumber <= 3").drop("l_linenumber"), keys, order)
    again = rows.where("l_linenumber > 2").drop("l_linenumber").withColumn("price", F.col("price") * 2)
    sinks.insert_if_absent(path, again, keys, order)
    return t.spark.read.parquet(path)


@query(
    "upsert_table",
    """
WITH o AS (SELECT CAST(year(l_shipdate) AS INT) AS y, l_suppkey AS k, sum(l_quantity) AS q, count(*) AS n FROM lineitem WHERE l_linenumber <= 4 GROUP BY ALL),
u AS (SELECT CAST(year(l_shipdate) AS INT) AS y, l_suppkey AS k, -sum(l_quantity) AS q, 0 AS n FROM lineitem WHERE l_linenumber > 3 AND year(l_shipdate) >= 2000 GROUP BY ALL)
SELECT coalesce(o.y, u.y) AS year, coalesce(o.k, u.k) AS zone_id, coalesce(u.q, o.q) AS quantity, coalesce(o.n, u.n) AS n FROM o FULL JOIN u ON u.y = o.y AND u.k = o.k""",
)
def upsert_table(t):
    """Stored table by year; only the years of the update are rewritten."""
    path = _place(t, "upserted")
    rows = t("lineitem").select(F.year("l_shipdate").alias("year"), F.col("l_suppkey").alias("zone_id"), "l_quantity", "l_linenumber")
    keys = ["year", "zone_id"]
    stored = rows.where("l_linenumber <= 4").groupBy(*keys).agg(F.sum("l_quantity").alias("quantity"), F.count(F.lit(1)).alias("n"))
    updates = rows.where("l_linenumber > 3 AND year >= 2000").groupBy(*keys).agg(
        (-F.sum("l_quantity")).alias("quantity"), F.lit(0).cast("long").alias("n")
    )
    sinks.upsert(path, stored, keys, ["quantity"], ["year"])
    sinks.upsert(path, updates, keys, ["quantity"], ["year"])
    return sinks._read_like(path, stored)


@query(
    "replace_slice",
    """
SELECT CASE WHEN l_returnflag = 'A' THEN NULL ELSE l_returnflag END AS slice, l_orderkey AS id, CASE WHEN l_returnflag = 'A' THEN 'new' ELSE 'old' END AS version FROM lineitem
WHERE CASE WHEN l_returnflag = 'A' THEN l_linenumber > 3 WHEN l_returnflag = 'R' THEN false ELSE l_linenumber <= 3 END""",
)
def replace_slice(t):
    """The null slice is replaced, one slice is cleared, the rest stays."""
    path = _place(t, "sliced")
    rows = t("lineitem").select(
        F.col("l_orderkey").alias("id"), "l_linenumber", F.when(F.col("l_returnflag") != "A", F.col("l_returnflag")).alias("slice")
    )
    old = rows.where("l_linenumber <= 3").select("id", F.lit("old").alias("version"), "slice")
    sinks.replace_slice(path, old, ["slice"])
    new = rows.where("slice IS NULL AND l_linenumber > 3").select("id", F.lit("new").alias("version"), "slice")
    cleared = rows.where("slice IS NULL OR slice = 'R'").select("slice").distinct()
    sinks.replace_slice(path, new, ["slice"], cleared)
    return sinks._read_like(path, old)


@query(
    "export_csv",
    f"SELECT CAST(store_id AS VARCHAR) AS store_id, CAST(sale_date AS VARCHAR) AS sale_date, CAST(count(*) AS VARCHAR) AS lines FROM sales GROUP BY store_id, sale_date",
)
def export_csv(t):
    """Report written as CSV and read back as a feed."""
    path = _place(t, "report")
    daily = t.sales("store_id", "sale_date").groupBy("store_id", "sale_date").agg(F.count(F.lit(1)).alias("lines"))
    sinks.export_csv(daily, path)
    return sources.read_feed(t.spark, path).drop("_file")


@query(
    "read_competitors",
    "SELECT 'Rival ' || s_suppkey AS name, n_name AS city, CASE WHEN s_suppkey % 4 = 1 THEN NULL ELSE CAST(s_suppkey AS DOUBLE) / 8 END AS latitude, CAST(NULL AS DOUBLE) AS longitude FROM supplier JOIN nation ON n_nationkey = s_nationkey",
)
def read_competitors(t):
    path = _place(t, "rivals")
    rows = t("supplier").join(t("nation"), F.col("n_nationkey") == F.col("s_nationkey")).select(
        F.concat(F.lit("Rival "), F.col("s_suppkey").cast("string")).alias("name"), F.col("n_name").alias("city"),
        F.when(F.col("s_suppkey") % 4 == 1, F.lit("unknown")).otherwise((F.col("s_suppkey") / 8).cast("string")).alias("latitude"),
    )
    sinks.export_csv(rows, path)
    return sources.read_competitors(t.spark, path).select("name", "city", "latitude", "longitude")


@query(
    "run_import",
    f"""
WITH {_KEYED}, g AS (SELECT count(*) AS n, count(DISTINCT (store_id, receipt_no, item_id)) AS k FROM cl)
SELECT store_id, count(DISTINCT (receipt_no, item_id)) AS loaded, (SELECT n - k FROM g) AS conflict_rows FROM cl GROUP BY store_id""",
)
def run_import(t):
    """CSV file with dirty lines through the whole import."""
    path, target = _place(t, "csv"), _place(t, "loaded")
    sinks.export_csv(_dirty(t), path)
    stats = cleaning.run_import(t.spark, path, "sales", target)
    return t.spark.read.parquet(target).groupBy("store_id").agg(
        F.count(F.lit(1)).alias("loaded"), F.lit(stats["conflict_rows"]).cast("long").alias("conflict_rows")
    )


@query(
    "clean_inventory_feed",
    f"""
WITH k AS (SELECT store_id, CAST(item_id AS VARCHAR) AS item_id, snapshot_date, CASE WHEN (store_id + item_id + month(snapshot_date)) % 6 <> 0 THEN quantity END AS q, CASE WHEN (store_id + item_id) % 5 <> 2 THEN CAST(item_id + 3 AS DOUBLE) END AS u
           FROM shop_inventory),
n AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY snapshot_date, store_id) AS pos FROM k), f AS (SELECT *, {_filled('q', 'item_id')}, {_filled('u', 'item_id')} FROM n)
SELECT store_id, item_id, snapshot_date, {_value('q')} AS quantity, {_value('u')} AS unit_cost, ({_value('q')}) * ({_value('u')}) AS total_value FROM f""",
)
def clean_inventory_feed(t):
    store, item = F.col("store_id"), F.col("item_id")
    dirty = t("shop_inventory").select(
        store.cast("string").alias("store_id"), item.cast("string").alias("item_id"), F.col("snapshot_date").cast("string"),
        F.when((store + item + F.month("snapshot_date")) % 6 != 0, F.col("quantity").cast("string")).alias("quantity"),
        F.when((store + item) % 5 != 2, (item + 3).cast("string")).alias("unit_cost"),
    )
    return cleaning.clean_rows(dirty, "inventory")


@query(
    "clean_traffic_feed",
    f"""
WITH k AS (SELECT store_id, traffic_date AS d, CASE WHEN store_id % 13 = 5 AND hour = 7 THEN 25 ELSE hour END AS hour, CASE WHEN (store_id + hour + day(traffic_date)) % 5 <> 0 THEN CAST(enter_count AS DOUBLE) END AS e FROM store_traffic),
n AS (SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY d, hour) AS pos FROM k), f AS (SELECT *, {_filled('e', 'store_id')} FROM n)
SELECT store_id, d AS traffic_date, CAST(hour AS INT) AS hour, {_value('e')} AS enter_count FROM f WHERE hour <= 23""",
)
def clean_traffic_feed(t):
    store, hour = F.col("store_id"), F.col("hour")
    dirty = t("store_traffic").select(
        store.cast("string").alias("store_id"), F.col("traffic_date").cast("string"),
        F.when((store % 13 == 5) & (hour == 7), "25").otherwise(hour.cast("string")).alias("hour"),
        F.when((store + hour + F.dayofmonth("traffic_date")) % 5 != 0, F.col("enter_count").cast("string")).alias("enter_count"),
    )
    return cleaning.clean_rows(dirty, "traffic")


@query(
    "clean_weather_feed",
    f"""
WITH k AS (SELECT city, weather_date, CASE WHEN dayofyear(weather_date) % 7 <> 0 THEN temp_high END AS h, CAST((dayofyear(weather_date) * 3) % 140 - 10 AS DOUBLE) AS humidity FROM weather),
n AS (SELECT *, row_number() OVER (PARTITION BY city ORDER BY weather_date) AS pos FROM k), f AS (SELECT *, {_filled('h', 'city')} FROM n)
SELECT city, weather_date, {_value('h')} AS temp_high, greatest(0, least(100, humidity)) AS humidity FROM f""",
)
def clean_weather_feed(t):
    day = F.dayofyear("weather_date")
    dirty = t("weather").select(
        F.col("city").alias(" City"), F.col("weather_date").cast("string").alias("Weather Date"),
        F.when(day % 7 != 0, F.col("temp_high").cast("string")).alias("temp_high"), ((day * 3) % 140 - 10).cast("string").alias("humidity"),
    )
    return cleaning.clean_rows(dirty, "weather")


@query(
    "clean_members_feed",
    """
SELECT c_name AS member_no, CAST(DATE '2020-01-01' + CAST(c_custkey % 300 AS INTEGER) AS DATE) AS register_date,
       CASE WHEN c_custkey % 5 <> 1 THEN '13' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') END AS phone, c_custkey % 3 <> 0 AS mobile FROM customer WHERE c_custkey % 7 <> 3""",
)
def clean_members_feed(t):
    key = F.col("c_custkey")
    digits = F.lpad(key.cast("string"), 9, "0")
    day = F.date_add(F.lit("2020-01-01").cast("date"), (key % 300).cast("int"))
    dirty = t("customer").select(
        F.col("c_name").alias("member_no"),
        F.when(key % 7 == 3, "soon").otherwise(day.cast("string")).alias("register_date"),
        F.when(key % 5 == 1, F.concat(F.lit("13-"), F.substring(digits, 3, 7))).otherwise(F.concat(F.lit("13-"), digits)).alias("phone"),
        (key % 3 != 0).alias("mobile"),
    )
    return cleaning.clean_rows(dirty, "members")


@query(
    "demand_adjustment",
    """
WITH p AS (SELECT DISTINCT l_suppkey AS store_id, l_partkey AS item_id FROM lineitem),
w AS (SELECT s.id FROM stores s JOIN weather w ON w.city = s.city AND weather_date BETWEEN DATE '2001-11-04' AND DATE '2001-11-11' GROUP BY s.id HAVING avg(precipitation) > 10)
SELECT p.store_id, p.item_id, EXISTS (SELECT 1 FROM promotions r WHERE r.store_id = p.store_id AND r.status = 'active' AND r.start_date <= DATE '2001-11-18' AND r.end_date >= DATE '2001-11-04'
       AND (target_items IS NULL OR target_items LIKE '%' || p.item_id || '%')) AS promoted, p.store_id IN (SELECT id FROM w) AS wet FROM p""",
)
def demand_adjustment(t):
    pairs = t.sales("store_id", "item_id").distinct()
    return replenishment.demand_adjustment(pairs, t("promotions"), t("weather"), t.stores, "2001-11-04")


@query(
    "ingest_signals",
    """
WITH o AS (SELECT signal_type, signal_date, region, max(value) AS value, max(confidence) AS confidence, min(id) AS id FROM market_signals WHERE id % 2 = 0 GROUP BY ALL),
u AS (SELECT signal_type, signal_date, region, min(value) AS value, min(confidence) AS confidence, max(id) AS id FROM market_signals WHERE id % 3 = 0 GROUP BY ALL)
SELECT coalesce(o.signal_type, u.signal_type) AS signal_type, coalesce(o.signal_date, u.signal_date) AS signal_date, coalesce(o.region, u.region) AS region, coalesce(u.value, o.value) AS value,
       coalesce(u.confidence, o.confidence) AS confidence, coalesce(o.id, u.id) AS id FROM o FULL JOIN u ON u.signal_type = o.signal_type AND u.signal_date = o.signal_date AND u.region = o.region""",
)
def ingest_signals(t):
    keys = ["signal_type", "signal_date", "region"]
    rows = t("market_signals")
    stored = rows.where("id % 2 = 0").groupBy(*keys).agg(F.max("value").alias("value"), F.max("confidence").alias("confidence"), F.min("id").alias("id"))
    batch = rows.where("id % 3 = 0").groupBy(*keys).agg(F.min("value").alias("value"), F.min("confidence").alias("confidence"), F.max("id").alias("id"))
    return demand.ingest_signals(stored, batch)


@query(
    "list_experiments",
    "SELECT o_orderkey AS id, o_custkey AS store_id, 'running' AS status, o_orderdate AS created_at FROM orders WHERE o_orderstatus = 'O' AND o_custkey IN (3, 5, 8)",
)
def list_experiments(t):
    rows = t("orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("store_id"),
        F.when(F.col("o_orderstatus") == "O", "running").otherwise("finished").alias("status"), F.col("o_orderdate").alias("created_at"),
    )
    return demand.list_experiments(rows, [3, 5, 8], "running")


_ALERT_ROWS = "SELECT event_id AS id, event_type AS target_table, CASE user_id % 2 WHEN 0 THEN 'accuracy' ELSE 'timeliness' END AS dimension, CASE WHEN value > 250 THEN 'critical' ELSE 'error' END AS severity, 'open' AS status, ts AS created_at FROM events"


@query("list_alerts", f"SELECT * FROM ({_ALERT_ROWS}) WHERE severity = 'critical' ORDER BY created_at DESC, target_table, dimension LIMIT 20 OFFSET 20")
def list_alerts(t):
    rows = t.spark.sql(_ALERT_ROWS.replace("FROM events", "FROM {events}"), events=t("events"))
    return quality.list_alerts(rows, severity="critical", status="open", page_no=2)


@query("list_runs", "SELECT event_id AS id, ts AS started_at, value AS overall_score FROM events ORDER BY started_at DESC LIMIT 20")
def list_runs(t):
    rows = t("events").select(F.col("event_id").alias("id"), F.col("ts").alias("started_at"), F.col("value").alias("overall_score"))
    return quality.list_runs(rows)


@query(
    "list_schedules",
    "SELECT event_id AS id, user_id % 10 AS store_id, user_id % 20 AS equipment_id, CAST(isodow(ts) - 1 AS INT) AS day_of_week, CAST(extract(hour FROM ts) AS INT) AS start_hour, true AS is_active FROM events WHERE event_type <> 'error'",
)
def list_schedules(t):
    rows = t("events").select(
        F.col("event_id").alias("id"), (F.col("user_id") % 10).alias("store_id"), (F.col("user_id") % 20).alias("equipment_id"),
        F.weekday("ts").alias("day_of_week"), F.hour("ts").alias("start_hour"), (F.col("event_type") != "error").alias("is_active"),
    )
    return energy.list_schedules(rows)


@query(
    "violations",
    "SELECT o_orderkey AS id, o_custkey AS personnel_id, o_orderkey % 25 AS shift_id, p.position, CAST(o_orderdate AS DATE) AS schedule_date, o_orderdate AS created_at, p.name AS personnel_name FROM orders JOIN personnel p ON p.id = o_custkey WHERE o_orderdate >= TIMESTAMP '2001-01-01' ORDER BY o_orderdate DESC, o_orderkey % 25, p.position, o_orderkey LIMIT 100",
)
def violations(t):
    people = t("personnel")
    log = t("orders").join(people.select("id", "position"), F.col("id") == F.col("o_custkey")).select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("personnel_id"), (F.col("o_orderkey") % 25).alias("shift_id"), "position",
        F.col("o_orderdate").cast("date").alias("schedule_date"), F.col("o_orderdate").alias("created_at"),
    )
    return port.violations(log, people, start="2001-01-01")


def _greedy_days(days: int) -> str:
    """Day after day: number the people by load, who comes into the slots works, their load grows by one."""
    parts = []
    for d in range(1, days + 1):
        load = "coalesce(shift_count, 0)" if d == 1 else "load + CASE WHEN r <= total THEN 1 ELSE 0 END"
        source = "personnel p LEFT JOIN ld ON ld.personnel_id = p.id WHERE is_active" if d == 1 else f"r{d - 1} JOIN tot USING (position)"
        who = "p.id AS personnel_id" if d == 1 else "personnel_id"
        parts.append(f"l{d} AS (SELECT {who}, position, {load} AS load FROM {source}), r{d} AS (SELECT *, row_number() OVER (PARTITION BY position ORDER BY load, personnel_id) AS r FROM l{d})")
    return ", ".join(parts)


@query(
    "assign_horizon",
    f"""
WITH {_SLOTS}, tot AS (SELECT position, sum(need) AS total FROM nd GROUP BY position), {_greedy_days(3)},
al AS ({" UNION ALL ".join(f"SELECT DATE '2001-07-25' + {d - 1} AS schedule_date, * FROM r{d}" for d in (1, 2, 3))})
SELECT schedule_date, shift_id, personnel_id, nb.position FROM nb JOIN al ON al.position = nb.position AND r > b AND r <= b + need""",
)
def assign_horizon(t):
    """Three days in a row."""
    load = port.recent_load(t("duty_schedules"), "2001-07-25")
    return port.assign_horizon(t("personnel"), t("shifts"), load, "2001-07-25", 3)[0]
