"""Retail and port tables derived from the benchmark parquet set.

Each view is one SELECT that runs unchanged in Spark SQL and in DuckDB, so a query
and its check read the same rows. ``{name}`` stands for another view or a raw table.
Where the two dialects differ the entry is a pair (Spark text, DuckDB text).
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aisle.session import deal

RAW_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

SALES_AS_OF = "2001-11-04"
EVENTS_AS_OF = "2024-01-30"

STANDINS: dict[str, str | tuple[str, str]] = {
    "stores": """
SELECT s.s_suppkey AS id, s.s_name AS code, s.s_name AS name, n.n_name AS city, r.r_name AS district,
       CAST(50 + (s.s_suppkey * 37) % 450 AS DOUBLE) AS area_sqm, s.s_acctbal >= 0 AS is_active
FROM {supplier} s JOIN {nation} n ON s.s_nationkey = n.n_nationkey JOIN {region} r ON n.n_regionkey = r.r_regionkey""",
    "sales": """
SELECT l.l_suppkey AS store_id, CAST(l.l_shipdate AS DATE) AS sale_date, l.l_orderkey AS receipt_no, l.l_partkey AS item_id,
       p.p_name AS item_name, p.p_type AS category, p.p_brand AS brand, l.l_quantity AS quantity,
       l.l_extendedprice / l.l_quantity AS unit_price, l.l_extendedprice * (1 - l.l_discount) AS total_amount,
       l.l_extendedprice * l.l_discount AS discount_amount, o.o_custkey AS member_id,
       CASE l.l_returnflag WHEN 'R' THEN 'online' WHEN 'A' THEN 'offline' ELSE 'o2o' END AS channel
FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey JOIN {part} p ON l.l_partkey = p.p_partkey""",
    "members": """
SELECT c.c_custkey AS id, c.c_name AS member_no, c.c_name AS name,
       CASE c.c_custkey % 4 WHEN 0 THEN 'silver' WHEN 1 THEN 'bronze' WHEN 2 THEN 'gold' ELSE 'normal' END AS level,
       CAST(floor(abs(c.c_acctbal)) AS INT) * 20 AS total_points, c.c_custkey % 10 AS register_store_id,
       c.c_custkey % 25 <> 7 AS is_active, DATE '1970-01-01' + CAST((c.c_custkey * 37) % 12000 AS INT) AS birthday,
       CAST(min(o.o_orderdate) AS DATE) AS register_date
FROM {customer} c LEFT JOIN {orders} o ON o.o_custkey = c.c_custkey
GROUP BY c.c_custkey, c.c_name, c.c_acctbal""",
    "member_transactions": """
SELECT o_orderkey AS id, o_custkey AS member_id, CAST(o_orderdate AS DATE) AS transaction_date,
       o_totalprice AS amount, o_orderkey AS receipt_no FROM {orders}""",
    "products": """
SELECT p_partkey AS id, p_partkey AS item_id, p_name AS item_name, p_type AS category, p_brand AS brand,
       p_retailprice AS unit_cost, DATE '2001-11-05' - CAST((p_partkey * 11) % 700 AS INT) AS launch_date,
       p_partkey % 20 <> 3 AS is_active FROM {part}""",
    "inventory": """
SELECT l.l_suppkey AS store_id, l.l_partkey AS item_id, max(p.p_name) AS item_name, max(p.p_type) AS category,
       CAST(date_trunc('month', l.l_shipdate) AS DATE) AS snapshot_date, 40 - sum(l.l_quantity) AS quantity,
       CAST(max(p.p_size) AS DOUBLE) / 4 AS min_stock, CAST(max(p.p_size) AS DOUBLE) AS max_stock
FROM {lineitem} l JOIN {part} p ON l.l_partkey = p.p_partkey
GROUP BY l.l_suppkey, l.l_partkey, CAST(date_trunc('month', l.l_shipdate) AS DATE)""",
    "channel_inventory": """
SELECT l_suppkey AS store_id, l_partkey AS item_id, CAST(date_trunc('month', l_shipdate) AS DATE) AS snapshot_date,
       CASE l_returnflag WHEN 'R' THEN 'online' WHEN 'A' THEN 'offline' ELSE 'o2o' END AS channel,
       sum(l_quantity) AS available_qty, sum(CASE WHEN l_linestatus = 'O' THEN l_quantity ELSE 0.0 END) AS reserved_qty
FROM {lineitem}
GROUP BY l_suppkey, l_partkey, CAST(date_trunc('month', l_shipdate) AS DATE),
         CASE l_returnflag WHEN 'R' THEN 'online' WHEN 'A' THEN 'offline' ELSE 'o2o' END""",
    # Shifted back 25 years so that touches and sales of the same members overlap.
    "channel_member_events": """
SELECT event_id AS id, user_id AS member_id, 1 + user_id % 10 AS store_id, ts - INTERVAL '9131' DAY AS event_date, value AS amount,
       CASE CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) % 3 WHEN 0 THEN 'online' WHEN 1 THEN 'offline' ELSE 'o2o' END AS channel,
       CASE event_type WHEN 'view' THEN 'browse' WHEN 'click' THEN 'add_cart' ELSE event_type END AS event_type
FROM {events}""",
    "traffic": """
SELECT 1 + user_id % 10 AS store_id, CAST(ts AS DATE) AS traffic_date, CAST(extract(hour FROM ts) AS INT) AS hour, count(*) AS enter_count
FROM {events} GROUP BY 1 + user_id % 10, CAST(ts AS DATE), CAST(extract(hour FROM ts) AS INT)""",
    "weather": (
        """
SELECT n_name AS city, d AS weather_date, CAST((dayofyear(d) * 7 + n_nationkey * 13) % 40 AS DOUBLE) AS precipitation,
       CAST((dayofyear(d) * 11) % 60 - 10 AS DOUBLE) AS temp_high
FROM (SELECT *, explode(concat(sequence(DATE '2001-01-01', DATE '2001-12-31'), sequence(DATE '2024-01-01', DATE '2024-01-31'))) AS d
      FROM {nation})""",
        """
SELECT n_name AS city, d AS weather_date, CAST((dayofyear(d) * 7 + n_nationkey * 13) % 40 AS DOUBLE) AS precipitation,
       CAST((dayofyear(d) * 11) % 60 - 10 AS DOUBLE) AS temp_high
FROM (SELECT *, CAST(unnest(list_concat(generate_series(DATE '2001-01-01', DATE '2001-12-31', INTERVAL 1 DAY),
                                        generate_series(DATE '2024-01-01', DATE '2024-01-31', INTERVAL 1 DAY))) AS DATE) AS d
      FROM {nation})""",
    ),
    "promotions": """
SELECT s_suppkey * 3 AS id, s_suppkey AS store_id, 'discount' AS promo_type, DATE '2001-08-01' + CAST(s_suppkey % 20 AS INT) AS start_date,
       DATE '2001-08-10' + CAST(s_suppkey % 20 AS INT) AS end_date, 0.2 AS discount_rate, CAST(NULL AS DOUBLE) AS discount_amount,
       'completed' AS status, CAST(NULL AS VARCHAR(100)) AS target_items FROM {supplier}
UNION ALL
SELECT s_suppkey * 3 + 1, s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'discount' WHEN 1 THEN 'amount_off' ELSE 'bundle' END,
       DATE '2001-09-15' + CAST(s_suppkey % 15 AS INT), DATE '2001-09-24' + CAST(s_suppkey % 15 AS INT),
       CAST(NULL AS DOUBLE), 50.0, 'completed', NULL FROM {supplier}
UNION ALL
SELECT s_suppkey * 3 + 2, s_suppkey, CASE s_suppkey % 2 WHEN 0 THEN 'discount' ELSE 'amount_off' END,
       DATE '2001-11-01' + CAST(s_suppkey % 14 AS INT), DATE '2001-11-10' + CAST(s_suppkey % 14 AS INT),
       CASE s_suppkey % 2 WHEN 0 THEN 0.3 ELSE CAST(NULL AS DOUBLE) END, CASE s_suppkey % 2 WHEN 1 THEN 30.0 ELSE CAST(NULL AS DOUBLE) END,
       'active', CASE s_suppkey % 4 WHEN 0 THEN NULL ELSE concat('7', CAST(s_suppkey % 10 AS VARCHAR(10))) END FROM {supplier}""",
    # The last signal of each kind, day and region; every event is one.
    "market_signals": """
SELECT max(id) AS id, signal_type, signal_date, region, max_by(value, id) AS value, max_by(confidence, id) AS confidence
FROM (SELECT event_id AS id, CASE event_type WHEN 'view' THEN 'competitor_price' WHEN 'click' THEN 'market_trend' WHEN 'purchase' THEN 'sentiment' ELSE 'news' END AS signal_type,
             DATE '2001-10-10' + CAST(extract(day FROM ts) AS INT) + CAST(user_id % 20 AS INT) AS signal_date,
             concat('R', CAST(user_id % 5 AS VARCHAR(10))) AS region,
             CASE event_type WHEN 'purchase' THEN value / 400 - 0.4 ELSE 0.7 + value / 500 END AS value,
             CAST(user_id % 10 AS DOUBLE) / 10 AS confidence
      FROM {events}) e
GROUP BY signal_type, signal_date, region""",
    "forecast_configs": """
SELECT s_suppkey AS store_id, 'ensemble' AS model_name, 0.6 AS weight_internal, 0.4 AS weight_external
FROM {supplier} WHERE s_suppkey % 3 = 1""",
    "suppliers": """
SELECT s_suppkey AS id, s_name AS name, CAST(3 + s_suppkey % 10 AS INT) AS lead_time_days,
       CAST(100 + (s_suppkey % 7) * 400 AS DOUBLE) AS min_order_qty, s_suppkey % 9 <> 4 AS is_active FROM {supplier}""",
    "supplier_items": """
SELECT DISTINCT l.l_suppkey AS supplier_id, l.l_partkey AS item_id, p.p_retailprice * (0.5 + (l.l_suppkey % 5) * 0.1) AS unit_cost,
       CAST(1 + l.l_suppkey % 4 AS INT) AS moq, CAST(1 + l.l_partkey % 6 AS INT) AS packaging_unit,
       (l.l_suppkey + l.l_partkey) % 3 = 0 AS is_primary
FROM {lineitem} l JOIN {part} p ON l.l_partkey = p.p_partkey""",
    "supplier_performance": """
SELECT supplier_id, CAST(date_trunc('quarter', order_date) AS DATE) AS period_start, count(*) AS total_orders,
       sum(CASE WHEN actual_delivery_date <= expected_delivery_date THEN 1 ELSE 0 END) AS on_time_deliveries,
       count(*) * 40 AS total_items_ordered, count(*) * 39 AS total_items_received, count(*) AS defect_items,
       CAST(60 + count(*) % 40 AS DOUBLE) AS overall_score
FROM {purchase_orders} GROUP BY supplier_id, CAST(date_trunc('quarter', order_date) AS DATE)""",
    # Coarser stores and items, so that single items sell on many days.
    "shop_sales": """
SELECT l_suppkey % 5 AS store_id, l_partkey % 40 AS item_id, CAST(l_shipdate AS DATE) AS sale_date, l_quantity AS quantity,
       l_extendedprice * (1 - l_discount) AS total_amount FROM {lineitem}""",
    "shop_inventory": """
SELECT l_suppkey % 5 AS store_id, l_partkey % 40 AS item_id, concat('Item ', CAST(l_partkey % 40 AS VARCHAR(10))) AS item_name,
       CAST(date_trunc('month', l_shipdate) AS DATE) AS snapshot_date, CAST((CAST(sum(l_quantity) AS BIGINT) * 7) % 260 - 5 AS DOUBLE) AS quantity,
       CAST(10 + l_partkey % 40 AS DOUBLE) AS min_stock
FROM {lineitem} GROUP BY l_suppkey % 5, l_partkey % 40, CAST(date_trunc('month', l_shipdate) AS DATE)""",
    "shop_supplier_items": """
SELECT l_suppkey AS supplier_id, l_partkey % 40 AS item_id, CAST(40 + (l_suppkey % 10) * 15 AS DOUBLE) AS unit_cost,
       CAST(1 + l_suppkey % 4 * 10 AS INT) AS moq, CAST(1 + l_partkey % 40 % 6 AS INT) AS packaging_unit,
       (l_suppkey + l_partkey % 40) % 3 = 0 AS is_primary
FROM {lineitem} WHERE l_partkey % 40 <> 39 GROUP BY l_suppkey, l_partkey % 40""",
    "shop_discount_tiers": """
SELECT supplier_id, item_id, CAST(60 + item_id % 30 AS INT) AS min_qty, 0.05 AS discount_rate, CAST(NULL AS DOUBLE) AS tier_price
FROM {shop_supplier_items} WHERE item_id % 4 <> 1
UNION ALL
SELECT supplier_id, item_id, CAST(90 + item_id % 35 AS INT), 0.15, CASE item_id % 5 WHEN 0 THEN unit_cost * 0.7 ELSE CAST(NULL AS DOUBLE) END
FROM {shop_supplier_items} WHERE item_id % 4 <> 1""",
    "shop_configs": """
SELECT l_suppkey % 5 AS store_id, l_partkey % 40 AS item_id,
       CASE l_partkey % 40 % 3 WHEN 0 THEN 0.9 WHEN 1 THEN 0.95 ELSE 0.99 END AS service_level, CAST(5 + l_partkey % 40 % 5 AS INT) AS review_period_days,
       CAST(20 + l_suppkey % 5 * 4 AS INT) AS max_stock_days, 0.2 AS weather_sensitivity, 1.5 AS promo_boost_factor
FROM {lineitem} WHERE l_partkey % 40 % 4 = 1 GROUP BY l_suppkey % 5, l_partkey % 40""",
    # One product per brand and type.
    "style_products": """
SELECT min(p_partkey) AS id, concat(concat(p_brand, ' '), p_type) AS item_id, concat(concat(p_brand, ' '), p_type) AS item_name, p_type AS category,
       min(p_retailprice) * 1.2 AS unit_cost, CASE WHEN min(p_partkey) % 9 = 0 THEN NULL ELSE DATE '2001-11-05' - CAST((min(p_partkey) * 11) % 700 AS INT) END AS launch_date,
       min(p_partkey) % 20 <> 3 AS is_active FROM {part} GROUP BY p_brand, p_type""",
    "product_snapshots": """
SELECT l_partkey % 200 AS product_id, l_suppkey % 5 AS store_id, CAST(date_trunc('week', l_shipdate) AS DATE) AS snapshot_week,
       CASE WHEN sum(l_quantity) < 20 THEN 'introduction' WHEN sum(l_quantity) < 40 THEN 'growth' WHEN sum(l_quantity) < 60 THEN 'maturity' ELSE 'decline' END AS stage,
       CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 4))) AS DOUBLE) AS weekly_revenue, sum(l_quantity) AS weekly_quantity,
       CAST(count(*) AS DOUBLE) / 8 - 0.25 AS growth_rate, CAST(count(*) AS DOUBLE) / 16 AS adoption_rate, 0.0 AS market_share,
       CAST(min(l_linenumber) AS DOUBLE) / 16 AS margin_rate, sum(l_quantity) / 8 AS velocity
FROM {lineitem} GROUP BY l_partkey % 200, l_suppkey % 5, CAST(date_trunc('week', l_shipdate) AS DATE)""",
    "purchase_orders": """
SELECT l.l_orderkey AS order_no, l.l_suppkey AS supplier_id, l.l_suppkey AS store_id, CAST(o.o_orderdate AS DATE) AS order_date,
       CAST(CAST(o.o_orderdate AS DATE) + INTERVAL '60' DAY AS DATE) AS expected_delivery_date, CAST(max(l.l_shipdate) AS DATE) AS actual_delivery_date,
       CASE WHEN l.l_orderkey % 11 = 0 THEN 'pending' ELSE 'delivered' END AS status
FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey GROUP BY l.l_orderkey, l.l_suppkey, CAST(o.o_orderdate AS DATE)""",
    "purchase_order_items": """
SELECT l.l_orderkey AS order_no, l.l_suppkey AS supplier_id, l.l_partkey AS item_id, l.l_quantity AS quantity, l.l_extendedprice / l.l_quantity AS unit_cost,
       CASE WHEN l.l_returnflag = 'R' THEN l.l_quantity - 1 ELSE l.l_quantity END AS received_quantity,
       CASE WHEN l.l_returnflag = 'R' AND l.l_linestatus = 'O' THEN 50.0 ELSE 90.0 END AS quality_score
FROM {lineitem} l""",
    "employees": """
SELECT s_suppkey AS id, s_nationkey AS store_id, s_name AS name,
       CASE s_suppkey % 3 WHEN 0 THEN 'cashier' WHEN 1 THEN 'sales' ELSE 'manager' END AS position, s_suppkey % 13 <> 5 AS is_active FROM {supplier}""",
    "employee_sales_records": """
SELECT s.s_suppkey AS employee_id, s.s_nationkey AS store_id, CAST(l.l_shipdate AS DATE) AS record_date, sum(l.l_extendedprice) AS revenue,
       sum(l.l_quantity) AS quantity_sold, count(*) AS transaction_count
FROM {lineitem} l JOIN {supplier} s ON l.l_suppkey = s.s_suppkey GROUP BY s.s_suppkey, s.s_nationkey, CAST(l.l_shipdate AS DATE)""",
    "employee_service_records": """
SELECT s.s_suppkey AS employee_id, CASE WHEN l.l_partkey % 50 = 0 THEN -1 ELSE s.s_nationkey END AS store_id, CAST(l.l_shipdate AS DATE) AS record_date,
       CAST(1 + l.l_linenumber % 5 AS DOUBLE) AS customer_rating, CASE WHEN l.l_partkey % 40 = 3 THEN 1 ELSE 0 END AS complaint_count,
       CASE WHEN l.l_partkey % 30 = 1 THEN 1 ELSE 0 END AS praise_count
FROM {lineitem} l JOIN {supplier} s ON l.l_suppkey = s.s_suppkey""",
    "employee_attendance": """
SELECT s.s_suppkey AS employee_id, s.s_nationkey AS store_id, CAST(o.o_orderdate AS DATE) AS attend_date,
       CASE WHEN o.o_orderkey % 17 = 0 THEN 1 ELSE 0 END AS is_late, CASE WHEN o.o_orderkey % 61 = 0 THEN 1 ELSE 0 END AS is_absent,
       8.0 AS scheduled_hours, CASE WHEN o.o_orderkey % 29 = 0 THEN 6.5 ELSE 8.0 END AS actual_hours
FROM {orders} o JOIN {supplier} s ON o.o_custkey % 10 = s.s_suppkey""",
    "employee_training": """
SELECT o.o_custkey % 50 AS employee_id, CAST(o.o_orderdate AS DATE) AS scheduled_date, CASE WHEN o.o_orderkey % 3 = 0 THEN 0 ELSE 1 END AS completed,
       CAST(40 + o.o_orderkey % 60 AS DOUBLE) AS score FROM {orders} o""",
    "performance_weights": """
SELECT DISTINCT s_nationkey AS store_id, CASE s_nationkey % 2 WHEN 0 THEN 'default' ELSE 'sales' END AS position,
       0.5 AS weight_sales, 0.2 AS weight_service, 0.2 AS weight_attendance, 0.1 AS weight_training FROM {supplier} WHERE s_nationkey % 3 <> 0""",
    "campaigns": """
SELECT n_nationkey AS id, concat('Campaign ', n_name) AS name,
       CASE n_nationkey % 4 WHEN 0 THEN 'birthday' WHEN 1 THEN 'churn_warning' WHEN 2 THEN 'repurchase' ELSE 'upgrade' END AS campaign_type,
       CASE n_nationkey % 2 WHEN 0 THEN 'sms' ELSE 'app' END AS channel, concat(concat('Offer for ', CAST(n_nationkey AS VARCHAR(10))), ': {{member_id}}') AS message_template,
       CASE WHEN n_nationkey % 5 = 4 THEN 'draft' ELSE 'active' END AS status, 0.5 + n_nationkey * 0.1 AS unit_cost FROM {nation}""",
    "marketing_rules": """
SELECT n_nationkey AS campaign_id, CAST(3 + n_nationkey % 10 AS INT) AS cooldown_days, CAST(1 + n_nationkey % 3 AS INT) AS max_triggers_per_member,
       n_nationkey % 7 <> 6 AS is_active FROM {nation} WHERE n_nationkey % 3 <> 2""",
    "campaign_executions": """
SELECT o_orderkey AS id, o_orderkey % 25 AS campaign_id, o_custkey AS member_id,
       o_orderdate + INTERVAL '90' DAY AS sent_at, o_orderdate + INTERVAL '90' DAY AS triggered_at,
       CASE o_orderkey % 6 WHEN 0 THEN 'failed' WHEN 1 THEN 'converted' WHEN 2 THEN 'opened' WHEN 3 THEN 'delivered' ELSE 'sent' END AS status,
       CASE o_orderkey % 6 WHEN 1 THEN o_totalprice ELSE 0.0 END AS revenue FROM {orders}""",
    "candidates": """
SELECT c.c_custkey AS id, c.c_name AS name, n.n_name AS city, CASE WHEN c.c_custkey % 6 = 0 THEN NULL ELSE r.r_name END AS district,
       CASE WHEN c.c_custkey % 17 = 0 THEN CAST(NULL AS DOUBLE) ELSE 30.0 + n.n_nationkey + ((c.c_custkey * 7919) % 1000) / 10000.0 END AS latitude,
       CASE WHEN c.c_custkey % 17 = 0 THEN CAST(NULL AS DOUBLE) ELSE 110.0 + n.n_nationkey + ((c.c_custkey * 104729) % 1000) / 10000.0 END AS longitude,
       CAST(60 + c.c_custkey % 200 AS DOUBLE) AS area_sqm, CAST(5000 + (c.c_custkey * 13) % 20000 AS DOUBLE) AS monthly_rent
FROM {customer} c JOIN {nation} n ON c.c_nationkey = n.n_nationkey JOIN {region} r ON n.n_regionkey = r.r_regionkey""",
    "competitors": """
SELECT s.s_suppkey AS id, n.n_name AS city, 30.0 + n.n_nationkey + ((s.s_suppkey * 7907) % 1000) / 10000.0 AS latitude,
       110.0 + n.n_nationkey + ((s.s_suppkey * 104723) % 1000) / 10000.0 AS longitude
FROM {supplier} s JOIN {nation} n ON s.s_nationkey = n.n_nationkey WHERE s.s_nationkey <> 3""",
    "store_zones": """
SELECT z.store_id * 10 + z.slot AS id, z.store_id, concat('Zone ', z.category) AS zone_name,
       CASE z.slot % 3 WHEN 0 THEN 'entrance' WHEN 1 THEN 'shelf' ELSE 'checkout' END AS zone_type, z.category,
       CAST(10 + (z.store_id * 7 + z.slot * 13) % 60 AS DOUBLE) AS area_sqm, CAST(z.slot * 10 AS DOUBLE) AS position_x, CAST(z.slot % 2 * 8 AS DOUBLE) AS position_y,
       9.0 AS width, 7.0 AS height, (z.store_id + z.slot) % 11 <> 10 AS is_active
FROM (SELECT DISTINCT l.l_suppkey AS store_id, p.p_type AS category, CAST((ascii(p.p_type) + 4 * length(p.p_type)) % 10 AS INT) AS slot
      FROM {lineitem} l JOIN {part} p ON l.l_partkey = p.p_partkey) z""",
    "zone_item_mapping": """
SELECT id AS zone_id, store_id, category, CASE WHEN id % 7 = 5 THEN store_id * 2 ELSE NULL END AS item_id FROM {store_zones}""",
    "store_traffic": """
SELECT l_suppkey AS store_id, CAST(l_shipdate AS DATE) AS traffic_date, CAST(l_linenumber AS INT) AS hour, count(*) * 12 AS enter_count
FROM {lineitem} GROUP BY l_suppkey, CAST(l_shipdate AS DATE), CAST(l_linenumber AS INT)""",
    "equipment": """
SELECT 1 + user_id % 20 AS id, 1 + user_id % 10 AS store_id, concat('EQ-', CAST(1 + user_id % 20 AS VARCHAR(10))) AS equipment_code,
       concat('Device ', CAST(1 + user_id % 20 AS VARCHAR(10))) AS name,
       CASE (1 + user_id % 20) % 4 WHEN 0 THEN 'hvac' WHEN 1 THEN 'lighting' WHEN 2 THEN 'refrigeration' ELSE 'pos' END AS equipment_type,
       CAST(80 + (1 + user_id % 20) * 2 AS DOUBLE) AS rated_power_kw, CASE WHEN user_id % 20 = 19 THEN 'offline' ELSE 'active' END AS status
FROM {events} GROUP BY user_id % 20, user_id % 10""",
    "energy_readings": """
SELECT event_id AS id, 1 + user_id % 10 AS store_id, 1 + user_id % 20 AS equipment_id, ts AS reading_time, value AS power_kw, value / 3600 AS energy_kwh,
       CASE event_type WHEN 'error' THEN 'idle' WHEN 'signup' THEN 'idle' ELSE 'active' END AS operational_state
FROM {events}""",
    "store_energy_daily": """
SELECT 1 + user_id % 10 AS store_id, 1 + user_id % 20 AS equipment_id, CAST(ts AS DATE) AS energy_date,
       CAST(sum(CAST(value AS DECIMAL(18, 4))) AS DOUBLE) AS total_kwh,
       CAST(sum(CAST(value AS DECIMAL(18, 4))) AS DOUBLE) / count(*) AS avg_kw, max(value) AS peak_kw,
       CAST(sum(CAST(value AS DECIMAL(18, 4))) AS DOUBLE) * 0.85 AS cost
FROM {events} GROUP BY 1 + user_id % 10, 1 + user_id % 20, CAST(ts AS DATE)""",
    # Sales moved by their day of the month to the dates of the meter readings.
    "energy_sales": """
SELECT 1 + l_suppkey % 10 AS store_id, DATE '2024-01-01' + CAST(extract(day FROM l_shipdate) AS INT) - 1 AS sale_date,
       l_extendedprice * (1 - l_discount) AS total_amount FROM {lineitem}""",
    "energy_budgets": """
SELECT DISTINCT 1 + user_id % 10 AS store_id, '2024-01' AS year_month, 15000.0 + (user_id % 10) * 30000.0 AS budget_kwh, 80.0 AS alert_threshold_pct
FROM {events}""",
    "container_events": """
SELECT user_id AS container_id, ts AS event_time, event_id, 1 + user_id % 20 AS equipment_id,
       CASE event_type WHEN 'signup' THEN 'vessel_arrival' WHEN 'view' THEN 'stack' WHEN 'click' THEN 'retrieve' WHEN 'purchase' THEN 'load' ELSE 'inspection' END AS event_type
FROM {events}""",
    "containers": """
SELECT user_id AS container_id, concat('MSKU', CAST(1000000 + user_id AS VARCHAR(10))) AS container_code,
       concat('BL', CAST(user_id % 50 AS VARCHAR(10))) AS bill_of_lading, concat('Vessel ', CAST(user_id % 7 AS VARCHAR(10))) AS vessel_name, min(ts) AS created_at
FROM {events} GROUP BY user_id""",
    "personnel": """
SELECT c_custkey AS id, c_name AS name, CASE c_custkey % 3 WHEN 0 THEN 'crane_operator' WHEN 1 THEN 'truck_driver' ELSE 'planner' END AS position,
       c_custkey % 11 <> 4 AS is_active FROM {customer}""",
    "shifts": """
SELECT n_nationkey AS id, concat('Shift ', n_name) AS shift_name,
       concat(concat('{{"crane_operator": ', CAST(n_nationkey AS VARCHAR(10))), concat(concat(', "truck_driver": ', CAST(2 * n_nationkey AS VARCHAR(10))), ', "planner": 90, "guard": 1}}')) AS required_positions
FROM {nation}""",
    "duty_schedules": """
SELECT o_orderkey AS id, o_custkey AS personnel_id, o_orderkey % 25 AS shift_id, CAST(o_orderdate AS DATE) AS schedule_date,
       CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'active' ELSE 'planned' END AS status FROM {orders}""",
    "quality_target": """
SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id""",
}

#: Views with nearly as many groups as lines, which are dealt by this key before they are grouped.
DEALT = {"purchase_orders": {"lineitem": "l_orderkey"}}

_REF = re.compile(r"(?<!\{)\{(\w+)\}(?!\})")
_PART_COLUMNS = {"item_name", "category", "brand"}


def spark_text(name: str) -> str:
    entry = STANDINS[name]
    return entry if isinstance(entry, str) else entry[0]


def duck_text(name: str) -> str:
    entry = STANDINS[name]
    text = entry if isinstance(entry, str) else entry[1]
    return _REF.sub(r"\1", text).replace("{{", "{").replace("}}", "}")


def references(name: str) -> list[str]:
    entry = STANDINS[name]
    text = entry if isinstance(entry, str) else entry[1]
    return sorted({r for r in _REF.findall(text) if r in STANDINS})


class Tables:
    """Raw tables and stand-in views of one data directory."""

    def __init__(self, spark: SparkSession, directory: str):
        self.spark = spark
        self.directory = directory.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.directory}/{name}.parquet")

    def __call__(self, name: str) -> DataFrame:
        if name in RAW_TABLES:
            return self.raw(name)
        inputs = {ref: self(ref) for ref in set(_REF.findall(spark_text(name)))}
        inputs |= {ref: deal(inputs[ref], key) for ref, key in DEALT.get(name, {}).items()}
        return self.spark.sql(spark_text(name), **inputs)

    def sales(self, *columns: str, start: str | None = None, end: str | None = None) -> DataFrame:
        """Sales lines with only the joins the columns need.

        Every line has its order and its part, so an unused join can be left out.
        A date range is also put on the raw column, where the scan can use it.
        """
        lines = self.raw("lineitem")
        if start:
            lines = lines.where(F.col("l_shipdate") >= F.lit(start).cast("timestamp_ntz"))
        if end:
            lines = lines.where(
                F.col("l_shipdate") < F.date_add(F.lit(end).cast("date"), 1).cast("timestamp_ntz")
            )
        expressions = {
            "store_id": F.col("l_suppkey"),
            "sale_date": F.col("l_shipdate").cast("date"),
            "receipt_no": F.col("l_orderkey"),
            "item_id": F.col("l_partkey"),
            "item_name": F.col("p_name"),
            "category": F.col("p_type"),
            "brand": F.col("p_brand"),
            "quantity": F.col("l_quantity"),
            "unit_price": F.col("l_extendedprice") / F.col("l_quantity"),
            "total_amount": F.col("l_extendedprice") * (1 - F.col("l_discount")),
            "discount_amount": F.col("l_extendedprice") * F.col("l_discount"),
            "member_id": F.col("o_custkey"),
            "channel": F.when(F.col("l_returnflag") == "R", "online")
            .when(F.col("l_returnflag") == "A", "offline")
            .otherwise("o2o"),
        }
        wanted = columns or tuple(expressions)
        if "member_id" in wanted:
            lines = lines.join(self.raw("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        if _PART_COLUMNS & set(wanted):
            lines = lines.join(self.raw("part"), F.col("l_partkey") == F.col("p_partkey"))
        return lines.select(*[expressions[c].alias(c) for c in wanted])

    @cached_property
    def stores(self) -> DataFrame:
        return self("stores")
