"""Supply chain and replenishment queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from aisle.functions import scalars
from aisle.operators import replenishment, supply
from aisle.plans.registry import query

AS_OF = "2001-11-04"

SCORE = f"""
ao AS (SELECT * FROM purchase_orders WHERE order_date >= DATE '{AS_OF}' - 400 AND status = 'delivered'),
om AS (SELECT supplier_id, count(*) AS n, count(*) FILTER (actual_delivery_date <= expected_delivery_date) AS ot, count(*) FILTER (actual_delivery_date > expected_delivery_date) AS late,
       avg(actual_delivery_date - order_date) AS lead FROM ao GROUP BY supplier_id),
im AS (SELECT i.supplier_id, CAST(sum(i.quantity) AS BIGINT) AS ordered, CAST(sum(i.received_quantity) AS BIGINT) AS received,
       CAST(coalesce(sum(i.received_quantity) FILTER (i.quality_score < 60), 0) AS BIGINT) AS defect,
       avg(CASE WHEN s.unit_cost > 0 THEN (s.unit_cost - i.unit_cost) / s.unit_cost * 100 ELSE 0 END) AS var
       FROM purchase_order_items i JOIN ao ON ao.order_no = i.order_no AND ao.supplier_id = i.supplier_id
       LEFT JOIN supplier_items s ON s.supplier_id = i.supplier_id AND s.item_id = i.item_id GROUP BY i.supplier_id),
x AS (SELECT s.id, s.name, coalesce(n, 0) AS n, coalesce(ot, 0) AS ot, coalesce(late, 0) AS late, coalesce(lead, 0) AS lead, coalesce(ordered, 0) AS o, coalesce(received, 0) AS r,
      coalesce(defect, 0) AS d, coalesce(var, 0) AS var FROM suppliers s LEFT JOIN om ON om.supplier_id = s.id LEFT JOIN im ON im.supplier_id = s.id WHERE s.is_active),
y AS (SELECT *, CASE WHEN n > 0 THEN CAST(ot AS DOUBLE) / n ELSE 0 END * 100 AS a, CASE WHEN o > 0 THEN CAST(r AS DOUBLE) / o ELSE 0 END * 100 AS b,
      CASE WHEN r > 0 THEN CAST(r - d AS DOUBLE) / r * 100 ELSE 100 END AS c, greatest(0, 100 - abs(var) * 5) AS e FROM x),
z AS (SELECT *, a * CAST(0.30 AS DOUBLE) + b * CAST(0.25 AS DOUBLE) + c * CAST(0.25 AS DOUBLE) + e * CAST(0.20 AS DOUBLE) AS overall FROM y),
card AS (SELECT id AS supplier_id, name AS supplier_name, DATE '{AS_OF}' - 400 AS period_start, DATE '{AS_OF}' AS period_end, n AS total_orders, ot AS on_time_deliveries, late AS late_deliveries,
       lead AS avg_lead_time_actual, o AS total_items_ordered, r AS total_items_received, d AS defect_items, round(a * 10) / 10 AS on_time_rate, round(b * 10) / 10 AS fulfillment_rate,
       round(c * 10) / 10 AS quality_score, round(var * 100) / 100 AS cost_variance_pct, round(overall * 10) / 10 AS overall_score,
       CASE WHEN overall >= 80 THEN 'green' WHEN overall >= 60 THEN 'yellow' ELSE 'red' END AS health_level FROM z)"""


@query("supplier_scorecard", f"WITH {SCORE} SELECT * FROM card")
def supplier_scorecard(t):
    return supply.supplier_scorecard(
        t("purchase_orders"), t("purchase_order_items"), t("supplier_items"), t("suppliers"), AS_OF, days=400
    )


@query(
    "supplier_health",
    f"""
WITH {SCORE} SELECT count(*) AS total_suppliers, count(*) FILTER (health_level = 'green') AS green, count(*) FILTER (health_level = 'yellow') AS yellow,
       count(*) FILTER (health_level = 'red') AS red, round(CAST(sum(CAST(on_time_rate AS DECIMAL(18,4))) AS DOUBLE) / count(*) * 10) / 10 AS avg_on_time_rate,
       round(CAST(sum(CAST(quality_score AS DECIMAL(18,4))) AS DOUBLE) / count(*) * 10) / 10 AS avg_quality_score FROM card""",
)
def supplier_health(t):
    return supply.supplier_health(supplier_scorecard(t))


@query(
    "supplier_trend",
    """
SELECT supplier_id, period_start, round(CAST(on_time_deliveries AS DOUBLE) / total_orders * 100 * 10) / 10 AS on_time_rate,
       round(CAST(total_items_received AS DOUBLE) / total_items_ordered * 100 * 10) / 10 AS fulfillment_rate,
       round(CAST(total_items_received - defect_items AS DOUBLE) / total_items_received * 100 * 10) / 10 AS quality_score, overall_score
FROM supplier_performance QUALIFY row_number() OVER (PARTITION BY supplier_id ORDER BY period_start DESC) <= 6""",
)
def supplier_trend(t):
    return supply.supplier_trend(t("supplier_performance"))


@query(
    "stockout_analysis",
    f"""
WITH g AS (SELECT store_id, item_id, item_name, count(*) FILTER (quantity <= 0) AS stockout_days, count(*) AS total_days FROM inventory
           WHERE snapshot_date >= DATE '{AS_OF}' - 900 GROUP BY ALL HAVING count(*) FILTER (quantity <= 0) > 0)
SELECT *, round(CAST(stockout_days AS DOUBLE) / total_days * 100 * 10) / 10 AS stockout_rate FROM g ORDER BY stockout_rate DESC, store_id, item_id LIMIT 100""",
)
def stockout_analysis(t):
    return supply.stockout_analysis(t("inventory"), AS_OF, days=900)


@query(
    "adjustment_advice",
    f"""
WITH cs AS (SELECT store_id, item_id, item_name, quantity, min_stock FROM inventory WHERE snapshot_date >= DATE '{AS_OF}' - 700
            QUALIFY row_number() OVER (PARTITION BY store_id, item_id ORDER BY snapshot_date DESC) = 1),
iv AS (SELECT store_id, item_id, sum(quantity) / count(*) AS v FROM sales WHERE sale_date >= DATE '{AS_OF}' - 30 GROUP BY store_id, item_id),
j AS (SELECT cs.*, coalesce(v, 0) AS v FROM cs LEFT JOIN iv ON iv.store_id = cs.store_id AND iv.item_id = cs.item_id WHERE quantity <= min_stock * CAST(1.2 AS DOUBLE))
SELECT store_id, item_id, item_name, quantity AS current_stock,
       CASE WHEN quantity <= 0 THEN 'urgent_replenish' WHEN quantity <= min_stock * 0.5 THEN 'replenish' ELSE 'monitor' END AS recommended_action,
       greatest(1, CASE WHEN quantity <= 0 THEN greatest(min_stock * 2, floor(v * 14)) WHEN quantity <= min_stock * 0.5 THEN greatest(min_stock, floor(v * 10))
                        ELSE greatest(min_stock - quantity, floor(v * 7)) END) AS recommended_qty,
       CASE WHEN quantity <= 0 THEN 'stock is used up' ELSE 'stock is below the safe level' END AS reason, round(v * 10) / 10 AS daily_use,
       CASE WHEN quantity <= 0 THEN 'critical' WHEN quantity <= min_stock * 0.5 THEN 'high' ELSE 'medium' END AS priority
FROM j ORDER BY quantity / nullif(min_stock, 0) NULLS LAST, store_id, item_id LIMIT 50""",
)
def adjustment_advice(t):
    lines = t.sales("store_id", "item_id", "sale_date", "quantity", start="2001-10-01")
    return supply.adjustment_advice(t("inventory"), lines, AS_OF, stock_days=700)


@query(
    "order_totals",
    "SELECT order_no, supplier_id, CAST(sum(CAST(quantity * unit_cost AS DECIMAL(18,4))) AS DOUBLE) AS total_amount, count(*) AS total_items FROM purchase_order_items GROUP BY ALL",
)
def order_totals(t):
    return supply.order_totals(t("purchase_order_items"))


@query(
    "apply_receipts",
    """
WITH r AS (SELECT order_no, item_id, max(quantity) - 2 AS rq, CASE WHEN max(order_no) % 2 = 0 THEN 77.0 END AS qs FROM purchase_order_items WHERE order_no % 3 = 0 GROUP BY order_no, item_id)
SELECT i.order_no, i.item_id, supplier_id, quantity, unit_cost, CASE WHEN r.order_no IS NULL THEN received_quantity ELSE rq END AS received_quantity,
       CAST(coalesce(qs, quality_score) AS DOUBLE) AS quality_score
FROM purchase_order_items i LEFT JOIN r ON r.order_no = i.order_no AND r.item_id = i.item_id""",
)
def apply_receipts(t):
    lines = t("purchase_order_items")
    receipts = (
        lines.where(F.col("order_no") % 3 == 0)
        .groupBy("order_no", "item_id")
        .agg((F.max("quantity") - 2).alias("received_quantity"))
        .withColumn("quality_score", F.when(F.col("order_no") % 2 == 0, F.lit(77.0)))
        .withColumn("received_at", F.lit(1))
    )
    return supply.apply_receipts(lines, receipts).withColumn("quality_score", F.col("quality_score").cast("double"))


@query(
    "orders_with_items",
    """
SELECT o.order_no, o.supplier_id, o.store_id, o.order_date, o.status, count(i.item_id) AS lines, string_agg(CAST(i.item_id AS VARCHAR), ',' ORDER BY i.item_id) AS item_ids
FROM purchase_orders o LEFT JOIN purchase_order_items i ON i.order_no = o.order_no AND i.supplier_id = o.supplier_id GROUP BY ALL""",
)
def orders_with_items(t):
    nested = supply.orders_with_items(t("purchase_orders"), t("purchase_order_items"))
    return nested.select(
        "order_no", "supplier_id", "store_id", "order_date", "status",
        "lines",
        F.array_join(F.transform("items.item_id", lambda i: i.cast("string")), ",").alias("item_ids"),
    )


def _points(t):
    supply_side = replenishment.primary_supplier(t("shop_supplier_items"), t("suppliers"), t("shop_discount_tiers"))
    pairs = t("shop_inventory").select("store_id", "item_id").distinct()
    adjusted = replenishment.demand_adjustment(pairs, t("promotions"), t("weather"), t.stores, AS_OF)
    return replenishment.reorder_points(
        t("shop_inventory"), t("shop_sales"), supply_side, t("shop_configs"), adjusted, AS_OF
    )


DEMAND = f"""
dd AS (SELECT store_id, item_id, sale_date, sum(quantity) AS q FROM shop_sales WHERE sale_date >= DATE '{AS_OF}' - 60 GROUP BY ALL),
ds AS (SELECT store_id, item_id, sum(q) / count(*) AS velocity, CASE WHEN stddev_samp(q) > 0 THEN stddev_samp(q) ELSE 1 END AS demand_std FROM dd GROUP BY ALL)"""
POINTS = f"""
{DEMAND},
inv AS (SELECT * FROM shop_inventory QUALIFY row_number() OVER (PARTITION BY store_id, item_id ORDER BY snapshot_date DESC) = 1),
ps AS (SELECT i.*, s.lead_time_days, s.min_order_qty FROM shop_supplier_items i JOIN suppliers s ON s.id = i.supplier_id AND s.is_active
       QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY is_primary DESC, supplier_id) = 1),
pr AS (SELECT DISTINCT inv.store_id, inv.item_id FROM inv JOIN promotions p ON p.store_id = inv.store_id AND p.status = 'active' AND p.start_date <= DATE '{AS_OF}' + 14
       AND p.end_date >= DATE '{AS_OF}' AND (p.target_items IS NULL OR p.target_items LIKE '%' || inv.item_id || '%')),
wf AS (SELECT s.id AS store_id FROM stores s JOIN weather w ON w.city = s.city AND w.weather_date BETWEEN DATE '{AS_OF}' AND DATE '{AS_OF}' + 7 GROUP BY s.id HAVING avg(precipitation) > 10),
p0 AS (SELECT inv.store_id, inv.item_id, inv.item_name, ps.supplier_id, inv.quantity AS current_stock, inv.min_stock, ps.min_order_qty,
       coalesce(ps.lead_time_days, 7) AS lead, coalesce(ps.unit_cost, 10) AS cost, coalesce(ps.moq, 1) AS moq, coalesce(ps.packaging_unit, 1) AS pack,
       CAST(coalesce(c.service_level, 0.95) AS DOUBLE) AS service_level, coalesce(c.review_period_days, 7) AS review, coalesce(c.max_stock_days, 30) AS max_days,
       coalesce(ds.velocity, 0) * CASE WHEN pr.item_id IS NOT NULL THEN CAST(coalesce(c.promo_boost_factor, 1.3) AS DOUBLE) ELSE CAST(1 AS DOUBLE) END
         * CASE WHEN wf.store_id IS NOT NULL THEN 1 - CAST(coalesce(c.weather_sensitivity, 0.1) AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS v, coalesce(demand_std, 1) AS sd
       FROM inv LEFT JOIN ds ON ds.store_id = inv.store_id AND ds.item_id = inv.item_id LEFT JOIN shop_configs c ON c.store_id = inv.store_id AND c.item_id = inv.item_id
       LEFT JOIN ps ON ps.item_id = inv.item_id LEFT JOIN pr ON pr.store_id = inv.store_id AND pr.item_id = inv.item_id LEFT JOIN wf ON wf.store_id = inv.store_id),
p1 AS (SELECT *, greatest(ceil(CASE service_level WHEN 0.9 THEN 1.2815515655446008 WHEN 0.95 THEN 1.6448536269514715 WHEN 0.99 THEN 2.3263478740408408 END * sd * sqrt(lead + review)), coalesce(min_stock, 0)) AS ss FROM p0),
points AS (SELECT *, ceil(v * lead + ss) AS rop FROM p1)"""
SUGGEST = f"""
{POINTS},
s0 AS (SELECT *, greatest(CASE WHEN cost * 0.25 > 0 AND v > 0 THEN ceil(sqrt(v * 365 * 2 * 50 / (cost * 0.25))) ELSE floor(v * max_days) END, moq) AS q0 FROM points WHERE current_stock <= rop),
s1 AS (SELECT *, CASE WHEN pack > 1 THEN ceil(q0 / pack) * pack ELSE q0 END AS q1 FROM s0),
s2 AS (SELECT s1.*, t1.min_qty AS m1, CAST(coalesce(nullif(t1.tier_price, 0), cost * (1 - CAST(t1.discount_rate AS DOUBLE))) AS DOUBLE) AS c1, t2.min_qty AS m2, CAST(coalesce(nullif(t2.tier_price, 0), cost * (1 - CAST(t2.discount_rate AS DOUBLE))) AS DOUBLE) AS c2
       FROM s1 LEFT JOIN shop_discount_tiers t1 ON t1.supplier_id = s1.supplier_id AND t1.item_id = s1.item_id AND CAST(t1.discount_rate AS DOUBLE) = 0.05
       LEFT JOIN shop_discount_tiers t2 ON t2.supplier_id = s1.supplier_id AND t2.item_id = s1.item_id AND CAST(t2.discount_rate AS DOUBLE) = 0.15),
s3 AS (SELECT *, CASE WHEN q1 >= m2 THEN c2 WHEN q1 >= m1 THEN c1 END AS now_cost, CASE WHEN q1 < m1 THEN m1 WHEN q1 < m2 THEN m2 END AS next_min, CASE WHEN q1 < m1 THEN c1 WHEN q1 < m2 THEN c2 END AS next_cost FROM s2),
s4 AS (SELECT *, ceil(next_min / pack) * pack AS next_q FROM s3),
s5 AS (SELECT *, next_min IS NOT NULL AND next_q * next_cost <= CASE WHEN now_cost IS NOT NULL THEN q1 * now_cost * CAST(1.05 AS DOUBLE) ELSE q1 * cost * CAST(1.1 AS DOUBLE) END AS up FROM s4),
s6 AS (SELECT *, CASE WHEN up THEN next_q ELSE q1 END AS q2, CASE WHEN up THEN next_cost ELSE now_cost END AS tier_cost FROM s5),
s7 AS (SELECT *, greatest(least(q2, greatest(floor(v * max_days) - current_stock, moq)), moq) AS q3 FROM s6),
s8 AS (SELECT *, CAST(CASE WHEN pack > 1 THEN ceil(q3 / pack) * pack ELSE q3 END AS DOUBLE) AS q FROM s7),
sug AS (SELECT store_id, item_id, item_name, supplier_id, current_stock, ss AS safety_stock, rop AS reorder_point, q AS suggested_qty,
       DATE '{AS_OF}' + CAST(greatest(0, CASE WHEN v > 0 THEN CAST(trunc((current_stock - ss) / v) AS INT) ELSE 999 END - lead) AS INT) AS optimal_order_date,
       round(q * coalesce(tier_cost, cost) * 100) / 100 AS estimated_cost, CAST(tier_cost IS NOT NULL AS INT) AS bulk_discount_applied, round(v * 100) / 100 AS demand_velocity,
       'pending' AS status, pack AS packaging_unit, min_order_qty FROM s8)"""
FINAL = f"""
{SUGGEST},
tot AS (SELECT store_id, supplier_id, sum(suggested_qty) AS sq, max(item_id) AS item_id, max(min_order_qty) AS mn FROM sug WHERE supplier_id IS NOT NULL GROUP BY store_id, supplier_id),
fin AS (SELECT s.* EXCLUDE (packaging_unit, min_order_qty) REPLACE (CAST(CASE WHEN t.item_id IS NOT NULL THEN suggested_qty + ceil((mn - sq) / packaging_unit) * packaging_unit ELSE suggested_qty END AS DOUBLE) AS suggested_qty,
        CASE WHEN t.item_id IS NOT NULL THEN round((suggested_qty + ceil((mn - sq) / packaging_unit) * packaging_unit) * (estimated_cost / suggested_qty) * 100) / 100 ELSE estimated_cost END AS estimated_cost)
        FROM sug s LEFT JOIN tot t ON t.store_id = s.store_id AND t.supplier_id = s.supplier_id AND t.item_id = s.item_id AND sq < mn)"""


@query("demand_stats", f"WITH {DEMAND} SELECT store_id, item_id, velocity, round(demand_std * 1000000) / 1000000 AS demand_std FROM ds")
def demand_stats(t):
    stats = replenishment.demand_stats(t("shop_sales"), AS_OF)
    return stats.withColumn("demand_std", F.round(F.col("demand_std") * 1e6) / 1e6)


@query(
    "primary_supplier",
    "SELECT item_id, supplier_id, s.name AS supplier_name, lead_time_days, unit_cost, moq, packaging_unit FROM shop_supplier_items i JOIN suppliers s ON s.id = i.supplier_id AND s.is_active QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY is_primary DESC, supplier_id) = 1",
)
def primary_supplier(t):
    chosen = replenishment.primary_supplier(t("shop_supplier_items"), t("suppliers"))
    return chosen.select(
        "item_id", "supplier_id", "supplier_name", "lead_time_days", "unit_cost", "moq", "packaging_unit"
    )


@query(
    "reorder_points",
    f"WITH {POINTS} SELECT store_id, item_id, supplier_id, current_stock, ss AS safety_stock, rop AS reorder_point, v AS velocity FROM points",
)
def reorder_points(t):
    return _points(t).select(
        "store_id", "item_id", "supplier_id", "current_stock", "safety_stock", "reorder_point", "velocity"
    )


@query("order_quantities", f"WITH {SUGGEST} SELECT * FROM sug")
def order_quantities(t):
    return replenishment.order_quantities(_points(t), AS_OF)


@query("enforce_supplier_moq", f"WITH {FINAL} SELECT * FROM fin")
def enforce_supplier_moq(t):
    return replenishment.enforce_supplier_moq(order_quantities(t))


@query(
    "replenishment_dashboard",
    f"""
WITH {FINAL}, st AS (SELECT * REPLACE (CASE item_id % 3 WHEN 0 THEN 'approved' ELSE 'pending' END AS status) FROM fin)
SELECT count(*) FILTER (current_stock <= 0) AS items_below_rop, CAST(coalesce(sum(CAST(estimated_cost AS DECIMAL(18,4))) FILTER (status = 'pending'), 0) AS DOUBLE) AS pending_orders_value,
       count(*) FILTER (status = 'pending') AS pending_count, count(*) FILTER (status = 'approved') AS approved_count,
       (SELECT round(CAST(count(*) FILTER (quantity > min_stock) AS DOUBLE) / count(*) * 100 * 10) / 10 FROM inv) AS coverage_rate FROM st""",
)
def replenishment_dashboard(t):
    stored = enforce_supplier_moq(t).withColumn(
        "status", F.when(F.col("item_id") % 3 == 0, "approved").otherwise("pending")
    )
    return replenishment.replenishment_dashboard(stored, t("shop_inventory"))


@query(
    "replenishment_timeline",
    f"""
WITH {FINAL}
SELECT store_id, item_id, item_name, current_stock, demand_velocity AS daily_consumption,
       CASE WHEN demand_velocity > 0 THEN CAST(trunc(current_stock / demand_velocity) AS INT) ELSE 999 END AS days_until_stockout, optimal_order_date,
       optimal_order_date + CAST(coalesce(s.lead_time_days, 7) AS INT) AS expected_delivery, suggested_qty
FROM fin LEFT JOIN suppliers s ON s.id = supplier_id ORDER BY optimal_order_date, store_id, item_id LIMIT 20""",
)
def replenishment_timeline(t):
    return replenishment.replenishment_timeline(enforce_supplier_moq(t), t("suppliers"))


@query(
    "list_suggestions",
    f"WITH {FINAL} SELECT fin.*, s.name AS supplier_name FROM fin LEFT JOIN suppliers s ON s.id = supplier_id ORDER BY optimal_order_date DESC, store_id, item_id LIMIT 20",
)
def list_suggestions(t):
    return replenishment.list_suggestions(enforce_supplier_moq(t), t("suppliers"))


@query(
    "coverage",
    """
WITH l AS (SELECT * FROM inventory QUALIFY row_number() OVER (PARTITION BY store_id, item_id ORDER BY snapshot_date DESC) = 1)
SELECT count(*) AS total_items, count(*) FILTER (quantity > min_stock) AS covered_items, round(CAST(count(*) FILTER (quantity > min_stock) AS DOUBLE) / count(*) * 100 * 10) / 10 AS coverage_rate FROM l""",
)
def coverage(t):
    return replenishment.coverage(t("inventory"))


@query(
    "order_lines",
    """
SELECT o.*, i.item_id, i.quantity, i.unit_cost, i.received_quantity, i.quality_score,
       CASE WHEN i.item_id IS NOT NULL THEN row_number() OVER (PARTITION BY o.order_no, o.supplier_id ORDER BY i.item_id, i.quantity, i.unit_cost, i.received_quantity, i.quality_score) END AS line_no
FROM purchase_orders o LEFT JOIN purchase_order_items i ON i.order_no = o.order_no AND i.supplier_id = o.supplier_id""",
)
def order_lines(t):
    rows = supply.order_lines(t("purchase_orders"), t("purchase_order_items"))
    return rows.withColumn("quality_score", F.col("quality_score").cast("double"))


_ADJUSTED = """
SELECT l_orderkey * 10 + l_linenumber AS id, l_suppkey AS store_id, l_partkey AS item_id, CASE l_returnflag WHEN 'R' THEN -l_quantity ELSE l_quantity END AS quantity,
       CASE l_returnflag WHEN 'R' THEN 'loss' ELSE 'count' END AS adjustment_type, l_shipdate AS created_at FROM {lineitem}"""


@query("list_adjustments", f"SELECT * FROM ({_ADJUSTED.replace('{lineitem}', 'lineitem')}) WHERE store_id IN (1, 2, 3, 5) ORDER BY created_at DESC, id LIMIT 20 OFFSET 20")
def list_adjustments(t):
    """Second page of the adjustments of four stores."""
    return supply.list_adjustments(t.spark.sql(_ADJUSTED, lineitem=t("lineitem")), [1, 2, 3, 5], page_no=2)


@query(
    "field_predicates",
    r"""
WITH c AS (SELECT c_custkey, '1' || lpad(CAST(c_custkey * 7654321987 % 10000000000 AS VARCHAR), 10, '0') AS phone, c_acctbal, '  ' || repeat(c_name || ' ', 20) AS note FROM customer),
p AS (SELECT *, regexp_matches(phone, '^1[3-9]\d{9}$') AS phone_ok, c_acctbal >= 0 AS balance_ok, substr(trim(note), 1, 200) AS note_kept FROM c),
o AS (SELECT o_custkey, count(*) FILTER (NOT (CAST(o_orderdate AS DATE) <= DATE '2000-01-01')) AS late FROM orders GROUP BY o_custkey)
SELECT c_custkey, phone_ok, balance_ok, note_kept, coalesce(late, 0) AS late FROM p LEFT JOIN o ON o_custkey = c_custkey""",
)
def field_predicates(t):
    """Each predicate over a whole table: phone, sign, range of dates, trimmed and cut text."""
    phone = F.concat(F.lit("1"), F.lpad((F.col("c_custkey") * 7654321987 % 10000000000).cast("string"), 10, "0"))
    note = F.concat(F.lit("  "), F.repeat(F.concat("c_name", F.lit(" ")), 20))
    rows = t("customer").select(
        "c_custkey", scalars.valid_phone(phone).alias("phone_ok"), scalars.non_negative("c_acctbal").alias("balance_ok"), scalars.tidy_text(note).alias("note_kept")
    )
    in_time = scalars.valid_date_range(F.col("o_orderdate").cast("date"), F.lit("2000-01-01").cast("date"))
    late = t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count_if(~in_time).alias("late"))
    return rows.join(late, "c_custkey", "left").fillna(0, ["late"])
