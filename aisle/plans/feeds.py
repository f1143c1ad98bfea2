"""Cleaning and streaming queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from aisle.operators import cleaning
from aisle.plans.registry import query
from aisle.session import checkpoint_root
from aisle.sources import sinks
from aisle.streaming import contacts, containers, feeds

# Sale lines as text with bad cells: missing keys, broken stores and dates, gaps, negative amounts.
DIRTY = """
SELECT CASE WHEN l_orderkey % 97 = 5 THEN 'invalid' ELSE CAST(l_suppkey AS VARCHAR(20)) END AS store_id,
       CASE WHEN l_orderkey % 89 = 3 THEN 'not-a-date' ELSE CAST(CAST(l_shipdate AS DATE) AS VARCHAR(20)) END AS sale_date,
       CASE WHEN l_orderkey % 101 = 7 THEN NULL ELSE CAST(l_orderkey AS VARCHAR(20)) END AS receipt_no, CAST(l_partkey AS VARCHAR(20)) AS item_id,
       CASE WHEN (l_orderkey + l_linenumber) % 11 = 0 THEN NULL WHEN l_orderkey % 83 = 1 THEN '-5' ELSE CAST(CAST(l_quantity AS INT) AS VARCHAR(20)) END AS quantity,
       CASE WHEN l_orderkey % 13 = 2 THEN 'n/a' ELSE CAST(CAST(floor(l_extendedprice / l_quantity) AS INT) AS VARCHAR(20)) END AS unit_price,
       CASE WHEN l_orderkey % 17 = 4 THEN '0' ELSE CAST(CAST(floor(l_extendedprice) AS INT) AS VARCHAR(20)) END AS total_amount
FROM {lineitem}"""
_DIRTY_DUCK = DIRTY.replace("{lineitem}", "lineitem")


def _dirty(t):
    return t.spark.sql(DIRTY, lineitem=t("lineitem"))


@query(
    "coerce_feed",
    f"SELECT TRY_CAST(store_id AS DOUBLE) AS store_id, TRY_CAST(sale_date AS DATE) AS sale_date, TRY_CAST(quantity AS DOUBLE) AS quantity, TRY_CAST(unit_price AS DOUBLE) AS unit_price FROM ({_DIRTY_DUCK})",
)
def coerce_feed(t):
    typed = cleaning.coerce(_dirty(t), ["store_id", "quantity", "unit_price"], ["sale_date"])
    return typed.select("store_id", "sale_date", "quantity", "unit_price")


@query(
    "dedupe_counts",
    f"""
WITH d AS (SELECT store_id, sale_date, receipt_no FROM ({_DIRTY_DUCK})), g AS (SELECT store_id, sale_date, receipt_no, count(*) AS n FROM d GROUP BY ALL)
SELECT CAST(sum(n - 1) AS BIGINT) AS duplicate_rows FROM g""",
)
def dedupe_counts(t):
    return cleaning.drop_exact_duplicates(_dirty(t).select("store_id", "sale_date", "receipt_no"))[1]


def _filled(column: str, key: str) -> str:
    w = f"PARTITION BY {key} ORDER BY pos"
    return f"""last_value({column} IGNORE NULLS) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pv_{column}, first_value({column} IGNORE NULLS) OVER ({w} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nv_{column},
       last_value(CASE WHEN {column} IS NOT NULL THEN pos END IGNORE NULLS) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pp_{column}, first_value(CASE WHEN {column} IS NOT NULL THEN pos END IGNORE NULLS) OVER ({w} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS np_{column}"""


def _value(column: str) -> str:
    return f"CASE WHEN {column} IS NOT NULL THEN {column} WHEN pv_{column} IS NULL THEN nv_{column} WHEN nv_{column} IS NULL THEN pv_{column} ELSE pv_{column} + (nv_{column} - pv_{column}) * (pos - pp_{column}) / (np_{column} - pp_{column}) END"


@query(
    "interpolate_values",
    f"""
WITH e AS (SELECT user_id, event_id, CASE WHEN event_id % 7 <> 0 THEN value END AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events),
f AS (SELECT *, {_filled('v', 'user_id')} FROM e) SELECT user_id, event_id, {_value('v')} AS v FROM f""",
)
def interpolate_values(t):
    rows = t("events").select(
        "user_id", "event_id", "ts", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("v")
    )
    filled = cleaning.interpolate(rows, ["v"], "user_id", ["ts", "event_id"], F.to_date("ts"))
    return filled.select("user_id", "event_id", "v")


_KEYED = f"""
dd AS (SELECT DISTINCT * FROM ({_DIRTY_DUCK})),
kk AS (SELECT TRY_CAST(store_id AS DOUBLE) AS sid, coalesce(TRY_CAST(sale_date AS DATE), DATE '0001-01-01') AS d, * EXCLUDE (quantity, unit_price, total_amount), TRY_CAST(quantity AS DOUBLE) AS q, TRY_CAST(unit_price AS DOUBLE) AS u, TRY_CAST(total_amount AS DOUBLE) AS a
       FROM dd WHERE store_id IS NOT NULL AND sale_date IS NOT NULL AND receipt_no IS NOT NULL AND item_id IS NOT NULL),
nn AS (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY d NULLS FIRST, receipt_no NULLS FIRST, item_id NULLS FIRST, sid, sale_date NULLS FIRST, q NULLS FIRST, u NULLS FIRST, a NULLS FIRST) AS pos FROM kk WHERE sid IS NOT NULL),
ff AS (SELECT *, {_filled('q', 'sid')}, {_filled('u', 'sid')}, {_filled('a', 'sid')} FROM nn),
vv AS (SELECT sid, d, receipt_no, item_id, {_value('q')} AS q, {_value('u')} AS u, {_value('a')} AS a FROM ff),
cl AS (SELECT CAST(sid AS BIGINT) AS store_id, d AS sale_date, receipt_no, item_id, q AS quantity, u AS unit_price, CASE WHEN a = 0 AND u > 0 THEN q * u ELSE a END AS total_amount, CAST(0 AS DOUBLE) AS discount_amount
       FROM vv WHERE q > 0 AND u >= 0 AND a >= 0 AND d <> DATE '0001-01-01')"""


@query("clean_sales_feed", f"WITH {_KEYED} SELECT * FROM cl")
def clean_sales_feed(t):
    return cleaning.clean_rows(_dirty(t), "sales")


@query(
    "clean_sales_counts",
    f"""
WITH g AS (SELECT *, count(*) AS n FROM ({_DIRTY_DUCK}) GROUP BY ALL)
SELECT CAST(sum(n) AS BIGINT) AS total_rows, CAST(sum(n - 1) AS BIGINT) AS duplicate_rows, count(*) FILTER (receipt_no IS NULL OR TRY_CAST(store_id AS DOUBLE) IS NULL) AS error_rows FROM g""",
)
def clean_sales_counts(t):
    return cleaning.clean_stats(_dirty(t), "sales")


@query(
    "upsert_zone_facts",
    """
WITH o AS (SELECT l_suppkey AS k, CAST(l_shipdate AS DATE) AS d, sum(l_quantity) AS q, count(*) AS n FROM lineitem WHERE l_linenumber <= 4 GROUP BY ALL),
u AS (SELECT l_suppkey AS k, CAST(l_shipdate AS DATE) AS d, sum(l_quantity) * 2 AS q, 0 AS n FROM lineitem WHERE l_linenumber > 3 GROUP BY ALL)
SELECT coalesce(o.k, u.k) AS zone_id, coalesce(o.d, u.d) AS sale_date, coalesce(u.q, o.q) AS quantity, coalesce(o.n, u.n) AS n FROM o FULL JOIN u ON u.k = o.k AND u.d = o.d""",
)
def upsert_zone_facts(t):
    lines = t("lineitem").select(
        F.col("l_suppkey").alias("zone_id"), F.col("l_shipdate").cast("date").alias("sale_date"), "l_quantity", "l_linenumber"
    )
    day = ["zone_id", "sale_date"]
    stored = lines.where("l_linenumber <= 4").groupBy(*day).agg(F.sum("l_quantity").alias("quantity"), F.count(F.lit(1)).alias("n"))
    updates = lines.where("l_linenumber > 3").groupBy(*day).agg((F.sum("l_quantity") * 2).alias("quantity"), F.lit(0).cast("long").alias("n"))
    return sinks.merge_rows(stored, updates, day, ["quantity"])


@query(
    "insert_absent_receipts",
    """
WITH b AS (SELECT l_orderkey AS receipt_no, l_partkey AS item_id, min(l_extendedprice) AS price FROM lineitem GROUP BY ALL)
SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = receipt_no AND l.l_partkey = item_id AND l_linestatus = 'O')""",
)
def insert_absent_receipts(t):
    rows = t("lineitem").select(
        F.col("l_orderkey").alias("receipt_no"), F.col("l_partkey").alias("item_id"), F.col("l_extendedprice").alias("price"), "l_linestatus"
    )
    stored = rows.where(F.col("l_linestatus") == "O").select("receipt_no", "item_id").distinct()
    keys = ["receipt_no", "item_id"]
    return sinks.absent_rows(stored, rows.drop("l_linestatus"), keys, [F.col("price")])


def _event_stream(t):
    schema = t("events").schema
    return (
        t.spark.readStream.schema(schema)
        .option("pathGlobFilter", "events.parquet")
        .parquet(t.directory)
    )


def _container_events(stream):
    kind = (
        F.when(F.col("event_type") == "signup", "vessel_arrival")
        .when(F.col("event_type") == "view", "stack")
        .when(F.col("event_type") == "click", "retrieve")
        .when(F.col("event_type") == "purchase", "load")
        .otherwise("inspection")
    )
    return stream.select(
        F.col("user_id").alias("container_id"), F.col("ts").alias("event_time"), "event_id", kind.alias("event_type")
    )


def _readings(stream):
    state = F.when(F.col("event_type").isin("error", "signup"), "idle").otherwise("active")
    return stream.select(
        F.col("event_id").alias("id"), (F.col("user_id") % 10 + 1).alias("store_id"),
        (F.col("user_id") % 20 + 1).alias("equipment_id"), F.col("ts").alias("reading_time"),
        F.col("value").alias("power_kw"), (F.col("value") / 3600).alias("energy_kwh"), state.alias("operational_state"),
    )


@query(
    "stream_container_state",
    """
SELECT container_id, coalesce(arg_max(s, ROW(event_time, event_id)) FILTER (s IS NOT NULL), 'en_route') AS status, max(event_time) FILTER (event_type = 'vessel_arrival') AS arrival_time,
       max(event_time) FILTER (event_type IN ('load', 'gate_out')) AS departure_time
FROM (SELECT *, CASE event_type WHEN 'vessel_arrival' THEN 'arrived' WHEN 'stack' THEN 'stacked' WHEN 'retrieve' THEN 'retrieving' WHEN 'load' THEN 'departed' END AS s FROM container_events) GROUP BY container_id""",
)
def stream_container_state(t):
    states = feeds.container_states(_container_events(_event_stream(t)))
    return feeds.collect_stream(states, "update", ["container_id"])


@query(
    "stream_latest",
    """
SELECT equipment_id, arg_max(power_kw, ROW(reading_time, id)) AS power_kw, arg_max(operational_state, ROW(reading_time, id)) AS operational_state, max(reading_time) AS reading_time,
       CAST(sum(CAST(power_kw AS DECIMAL(18,4))) AS DOUBLE) / 3600 AS cumulative_kwh FROM energy_readings GROUP BY equipment_id""",
)
def stream_latest(t):
    return feeds.collect_stream(feeds.latest_state(_readings(_event_stream(t))), "update", ["equipment_id"])


@query(
    "stream_yard_hourly",
    """
WITH h AS (SELECT date_trunc('hour', reading_time) AS metric_time, count(*) AS samples, CAST(sum(CAST(power_kw AS DECIMAL(18,4))) AS DOUBLE) AS power_sum FROM energy_readings GROUP BY 1)
SELECT * FROM h WHERE metric_time + INTERVAL 1 HOUR <= (SELECT max(reading_time) FROM energy_readings) - INTERVAL 10 MINUTE""",
)
def stream_yard_hourly(t):
    hours = feeds.collect_stream(feeds.hourly_energy(_readings(_event_stream(t))))
    return hours.withColumn("metric_time", F.col("metric_time").cast("timestamp_ntz"))


@query(
    "stream_peak_alarms",
    """
SELECT r.store_id, equipment_id, 'peak_warning' AS alert_type, 'warning' AS alert_level, power_kw AS metric_value, rated_power_kw * 0.9::DOUBLE AS threshold_value, reading_time AS alert_time
FROM energy_readings r JOIN equipment e ON e.id = equipment_id WHERE power_kw > rated_power_kw * 0.9::DOUBLE""",
)
def stream_peak_alarms(t):
    devices = t("equipment")
    return feeds.collect_stream(feeds.peak_alarms(_readings(_event_stream(t)), devices))


@query(
    "stream_sequence_gaps",
    """
WITH k AS (SELECT event_id % 5 AS source_id, event_id // 5 AS seq, ts AS received_at FROM events WHERE event_id % 13 <> 0),
l AS (SELECT *, lag(seq) OVER (PARTITION BY source_id ORDER BY received_at, seq) AS previous_seq FROM k)
SELECT source_id, seq, previous_seq, seq - previous_seq - 1 AS dropped FROM l WHERE previous_seq > 0 AND seq - previous_seq - 1 > 0""",
)
def stream_sequence_gaps(t):
    ticks = _event_stream(t).where(F.col("event_id") % 13 != 0).select(
        (F.col("event_id") % 5).alias("source_id"), F.floor(F.col("event_id") / 5).alias("seq"), F.col("ts").alias("received_at")
    )
    root = f"{checkpoint_root(t.spark)}/ticks-{uuid.uuid4().hex}"
    feeds.stream_sequence_gaps(ticks, root)
    return t.spark.read.parquet(f"{root}/gaps").select("source_id", "seq", "previous_seq", "dropped")


@query(
    "stream_import",
    f"""
WITH {_KEYED} SELECT store_id, receipt_no, item_id, count(*) OVER () AS loaded FROM (SELECT DISTINCT store_id, receipt_no, item_id FROM cl)""",
)
def stream_import(t):
    """The dirty sale lines dropped as one file, loaded by the import stream."""
    root = f"{checkpoint_root(t.spark)}/drop-{uuid.uuid4().hex}"
    dirty = _dirty(t)
    dirty.coalesce(1).write.option("compression", "zstd").parquet(f"{root}/in")
    stream = t.spark.readStream.schema(dirty.schema).parquet(f"{root}/in")
    feeds.stream_import(t.spark, stream, "sales", f"{root}/out")
    loaded = feeds.imported(t.spark, f"{root}/out").select(F.col("store_id").cast("long").alias("store_id"), "receipt_no", "item_id")
    count = loaded.agg(F.count(F.lit(1)).alias("loaded"))
    return loaded.join(F.broadcast(count))


@query(
    "stream_yard_hours",
    """
WITH m AS (SELECT date_trunc('hour', event_time) AS h, count(DISTINCT container_id) AS c, count(*) FILTER (event_type IN ('discharge', 'load')) AS t FROM container_events GROUP BY 1),
e AS (SELECT date_trunc('hour', reading_time) AS h, round(count(*) FILTER (operational_state <> 'idle') * 100.0::DOUBLE / count(*) * 10000) / 10000 AS u, round(sum(energy_kwh) * 1000000) / 1000000 AS k FROM energy_readings GROUP BY 1),
l AS (SELECT least((SELECT max(event_time) FROM container_events), (SELECT max(reading_time) FROM energy_readings)) AS newest)
SELECT coalesce(m.h, e.h) AS metric_time, coalesce(c, 0) AS total_containers, coalesce(t, 0) AS throughput_teu, coalesce(u, 0) AS avg_utilization, coalesce(k, 0) AS total_energy_kwh
FROM m FULL JOIN e ON e.h = m.h CROSS JOIN l WHERE coalesce(m.h, e.h) + INTERVAL 1 HOUR <= newest - INTERVAL 10 MINUTE""",
)
def stream_yard_hours(t):
    """Container moves and meter readings as two live feeds, joined per closed hour."""
    hours = feeds.collect_stream(feeds.yard_hours(_container_events(_event_stream(t)), _readings(_event_stream(t))))
    return hours.withColumn("metric_time", F.col("metric_time").cast("timestamp_ntz"))


@query(
    "stream_container_board",
    """
WITH k AS (SELECT *, CASE event_type WHEN 'vessel_arrival' THEN 'arrived' WHEN 'stack' THEN 'stacked' WHEN 'retrieve' THEN 'retrieving' WHEN 'load' THEN 'departed' END AS s,
       lag(event_time) OVER (PARTITION BY container_id ORDER BY event_time, event_id) AS before FROM container_events),
v AS (SELECT *, sum(CASE WHEN event_time - before > INTERVAL 2 DAY THEN 1 ELSE 0 END) OVER (PARTITION BY container_id ORDER BY event_time, event_id) AS visit FROM k)
SELECT container_id, min(event_time) AS visit_start, coalesce(arg_max(s, ROW(event_time, event_id)) FILTER (s IS NOT NULL), 'en_route') AS status,
       max(event_time) FILTER (event_type = 'vessel_arrival') AS arrival_time, max(event_time) FILTER (event_type IN ('load', 'gate_out')) AS departure_time
FROM (SELECT * FROM v QUALIFY visit = max(visit) OVER (PARTITION BY container_id)) GROUP BY container_id""",
)
def stream_container_board(t):
    """Newest visit of every container; two days of silence end a visit."""
    board = containers.container_board(_container_events(_event_stream(t)), silence_days=2)
    newest = feeds.collect_stream(board, "update", ["container_id"], keyed=True)
    times = [F.col(c).cast("timestamp_ntz").alias(c) for c in ("visit_start", "arrival_time", "departure_time")]
    return newest.select("container_id", "status", *times)


@query(
    "stream_contacts",
    """
WITH RECURSIVE q AS (SELECT user_id AS m, event_id % 25 AS c, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id % 25) AS k FROM events
      WHERE epoch_us(ts) <= (SELECT epoch_ms(max(ts)) - 600000 FROM events) * 1000),
l AS (SELECT campaign_id, cooldown_days, max_triggers_per_member FROM marketing_rules WHERE is_active),
r AS (SELECT q.*, coalesce(cooldown_days, 7) * 86400000000 AS cool, coalesce(max_triggers_per_member, 3) AS most FROM q LEFT JOIN l ON l.campaign_id = q.c),
f(m, k, hist, lock, sent, c, t) AS (
  SELECT DISTINCT m, 0::BIGINT, []::STRUCT(c BIGINT, t BIGINT)[], -1::BIGINT, false, NULL::BIGINT, NULL::BIGINT FROM r
  UNION ALL
  SELECT m, k, CASE WHEN ok THEN list_append(hist, {c: c, t: t}) ELSE hist END, CASE WHEN ok THEN t + 86400000000 ELSE lock END, ok, c, t
  FROM (SELECT r.m, r.k, f.hist, f.lock, r.c, r.t,
          r.t > f.lock AND len(list_filter(f.hist, lambda h: h.c = r.c AND h.t >= r.t - 20 * 86400000000)) < r.most
          AND len(list_filter(f.hist, lambda h: h.c = r.c AND h.t > r.t - r.cool AND h.t >= r.t - 20 * 86400000000)) = 0 AS ok
        FROM f JOIN r ON r.m = f.m AND r.k = f.k + 1))
SELECT m AS member_id, c AS campaign_id, make_timestamp(t) AS sent_at FROM f WHERE sent""",
)
def stream_contacts(t):
    """Every event asks to contact its user by one of 25 campaigns; caps look back 20 days."""
    requests = _event_stream(t).select(
        F.col("user_id").alias("member_id"), (F.col("event_id") % 25).alias("campaign_id"), F.col("ts").alias("asked_at")
    )
    sent = feeds.collect_stream(contacts.contacts(requests, t("marketing_rules"), memory_days=20), keyed=True)
    return sent.select("member_id", "campaign_id", F.col("sent_at").cast("timestamp_ntz").alias("sent_at"))
