"""Product lifecycle queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from aisle.operators import lifecycle
from aisle.plans.registry import query
from aisle.session import checkpoint_root

AS_OF = "2001-11-04"


def _style_sales(t, start="2001-08-12"):
    lines = t.sales("store_id", "sale_date", "brand", "category", "quantity", "total_amount", start=start)
    return lines.withColumn("item_id", F.concat("brand", F.lit(" "), "category"))


WEEKLY = f"""
ss AS (SELECT concat(brand, ' ', category) AS item_id, store_id, sale_date, quantity, total_amount FROM sales WHERE sale_date >= DATE '{AS_OF}' - 84),
w0 AS (SELECT item_id, CAST(date_trunc('week', sale_date) AS DATE) AS week_start, CAST(sum(CAST(total_amount AS DECIMAL(18,4))) AS DOUBLE) AS revenue,
       sum(quantity) AS quantity, count(DISTINCT store_id) AS store_count FROM ss GROUP BY ALL),
w1 AS (SELECT *, lag(revenue) OVER (PARTITION BY item_id ORDER BY week_start) AS pr FROM w0),
w AS (SELECT item_id, week_start, revenue, quantity, store_count, (revenue - pr) / greatest(pr, 1) AS growth_rate FROM w1)"""
STAGED = f"""
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY week_start DESC) AS rn FROM w),
h AS (SELECT item_id, count(growth_rate) AS n, stddev_pop(growth_rate) AS s, arg_max(revenue, week_start) AS weekly_revenue, arg_max(quantity, week_start) AS weekly_quantity,
      arg_max(store_count, week_start) AS stc, coalesce(max(growth_rate) FILTER (rn = 1), 0) AS growth_rate FROM r GROUP BY item_id),
cv AS (SELECT p.category, sum(quantity) / count(*) / 7.0 AS cv FROM ss JOIN style_products p ON p.item_id = ss.item_id WHERE sale_date >= DATE '{AS_OF}' - 28 GROUP BY p.category),
f AS (SELECT h.*, p.id AS product_id, coalesce(nullif(cv.cv, 0), 1) AS cv, stc / (SELECT greatest(count(*) FILTER (is_active), 1) FROM stores) AS adoption_rate, weekly_revenue / 7.0 AS velocity,
      coalesce(floor((DATE '{AS_OF}' - launch_date) / 7), 52) AS wk, greatest(0.03, least(0.15, s * 1.2)) AS lim, greatest(0.03, least(0.10, s * 0.8)) AS band,
      CASE WHEN weekly_revenue > 0 THEN (weekly_revenue - unit_cost * weekly_quantity) / greatest(weekly_revenue, 1) ELSE 0 END AS margin_rate
      FROM h JOIN style_products p ON p.item_id = h.item_id AND p.is_active LEFT JOIN cv ON cv.category = p.category),
k AS (SELECT f.product_id, count(*) FILTER (r.growth_rate > lim) AS up, count(*) FILTER (r.growth_rate < -lim) AS dn, count(*) FILTER (abs(r.growth_rate) <= band) AS st,
      count(*) FILTER (r.growth_rate < -0.05) AS falling FROM f JOIN r ON r.item_id = f.item_id AND rn <= 4 AND r.growth_rate IS NOT NULL GROUP BY f.product_id),
staged AS (SELECT f.product_id, f.item_id, CAST(date_trunc('week', DATE '{AS_OF}') AS DATE) AS snapshot_week,
      CASE WHEN n < 4 THEN 'introduction' WHEN wk <= 8 AND adoption_rate < 0.5 THEN 'introduction'
           WHEN dn >= 3 OR (velocity < greatest(0, cv - s * cv) AND wk > 26) THEN 'decline' WHEN up >= 3 AND adoption_rate >= 0.5 THEN 'growth'
           WHEN st >= 3 AND velocity > cv * 0.7 THEN 'maturity' WHEN up >= 2 THEN 'growth' ELSE 'maturity' END AS stage,
      weekly_revenue, weekly_quantity, growth_rate, adoption_rate, CAST(0 AS DOUBLE) AS market_share, margin_rate, velocity, n, falling
      FROM f LEFT JOIN k ON k.product_id = f.product_id)"""


@query("product_weekly", f"WITH {WEEKLY} SELECT * FROM w")
def product_weekly(t):
    return lifecycle.product_weekly(_style_sales(t), AS_OF)


@query("lifecycle_stage", f"WITH {WEEKLY}, {STAGED} SELECT * EXCLUDE (n, falling) FROM staged")
def lifecycle_stage(t):
    return lifecycle.lifecycle_stage(_style_sales(t), t("style_products"), t.stores, AS_OF).drop("growth_rates")


@query(
    "retirement_advice",
    f"""
WITH {WEEKLY}, {STAGED}
SELECT product_id, CASE WHEN margin_rate < 0 THEN 'phase_out' WHEN velocity < 0.5 THEN 'markdown' ELSE 'keep' END AS recommendation,
       CAST(CASE WHEN margin_rate < 0 THEN 0.9 WHEN velocity < 0.5 THEN 0.75 ELSE 0.5 END AS DOUBLE) AS confidence,
       CASE WHEN margin_rate < 0 THEN 'negative margin' WHEN velocity < 0.5 THEN 'very slow sales' ELSE 'still selling' END AS reason,
       weekly_revenue AS impact_revenue_loss, DATE '{AS_OF}' + 14 AS suggested_action_date, p.item_name
FROM staged JOIN style_products p ON p.id = product_id WHERE stage = 'decline' AND n >= 4 AND falling >= 3
ORDER BY confidence DESC, impact_revenue_loss, product_id LIMIT 50""",
)
def retirement_advice(t):
    staged = lifecycle.lifecycle_stage(_style_sales(t), t("style_products"), t.stores, AS_OF)
    return lifecycle.list_retirement(lifecycle.retirement_advice(staged, AS_OF), t("style_products"))


@query(
    "lifecycle_overview",
    """
WITH n AS (SELECT stage, count(DISTINCT product_id) AS c FROM product_snapshots WHERE snapshot_week = (SELECT max(snapshot_week) FROM product_snapshots)
           AND product_id IN (SELECT id FROM products) GROUP BY stage)
SELECT CAST(coalesce(sum(c) FILTER (stage = 'introduction'), 0) AS BIGINT) AS introduction_count, CAST(coalesce(sum(c) FILTER (stage = 'growth'), 0) AS BIGINT) AS growth_count,
       CAST(coalesce(sum(c) FILTER (stage = 'maturity'), 0) AS BIGINT) AS maturity_count, CAST(coalesce(sum(c) FILTER (stage = 'decline'), 0) AS BIGINT) AS decline_count,
       CAST(coalesce(sum(c), 0) AS BIGINT) AS total_products FROM n""",
)
def lifecycle_overview(t):
    return lifecycle.lifecycle_overview(t("product_snapshots"), t("products"))


@query(
    "products_with_stage",
    """
SELECT p.id, item_id, item_name, category, store_id, stage AS current_stage, weekly_revenue, growth_rate,
       CAST(coalesce(greatest(1, floor((snapshot_week - launch_date) / 7)), 0) AS INT) AS weeks_in_stage
FROM product_snapshots s JOIN products p ON p.id = s.product_id WHERE snapshot_week = (SELECT max(snapshot_week) FROM product_snapshots)
ORDER BY weekly_revenue DESC, p.id, store_id LIMIT 20 OFFSET 20""",
)
def products_with_stage(t):
    return lifecycle.products_with_stage(t("product_snapshots"), t("products"), page_no=2)


@query(
    "lifecycle_curve",
    "SELECT product_id, item_name, store_id, snapshot_week, stage, weekly_revenue AS revenue, weekly_quantity AS quantity FROM product_snapshots LEFT JOIN products p ON p.id = product_id",
)
def lifecycle_curve(t):
    return lifecycle.lifecycle_curve(t("product_snapshots"), t("products"))


@query(
    "stage_transitions",
    f"""
WITH r AS (SELECT *, lag(stage) OVER (PARTITION BY product_id, store_id ORDER BY snapshot_week) AS from_stage FROM product_snapshots WHERE snapshot_week >= DATE '{AS_OF}' - 90)
SELECT product_id, store_id, item_name, from_stage, stage AS to_stage, snapshot_week AS transition_date FROM r JOIN products p ON p.id = product_id
WHERE from_stage <> stage ORDER BY transition_date DESC, product_id, store_id LIMIT 50""",
)
def stage_transitions(t):
    return lifecycle.stage_transitions(t("product_snapshots"), t("products"), AS_OF, days=90)


@query(
    "stage_kpis",
    """
SELECT stage, count(DISTINCT product_id) AS product_count, round(avg(weekly_revenue) * 100) / 100 AS avg_weekly_revenue, round(avg(growth_rate) * 10000) / 10000 AS avg_growth_rate,
       round(avg(adoption_rate) * 10000) / 10000 AS avg_adoption_rate, CAST(0 AS DOUBLE) AS avg_market_share, round(avg(margin_rate) * 10000) / 10000 AS avg_margin_rate,
       round(avg(velocity) * 100) / 100 AS avg_velocity
FROM product_snapshots WHERE snapshot_week = (SELECT max(snapshot_week) FROM product_snapshots) GROUP BY stage""",
)
def stage_kpis(t):
    return lifecycle.stage_kpis(t("product_snapshots"))


#: A day of the same week as ``AS_OF``.
EARLIER = "2001-10-30"
_SNAPSHOT = f"WITH {WEEKLY}, {STAGED} SELECT * FROM staged"


@query(
    "snapshot_lifecycle",
    f"""
WITH one AS ({_SNAPSHOT.replace(AS_OF, EARLIER)}), two AS ({_SNAPSHOT})
SELECT coalesce(two.product_id, one.product_id) AS product_id, CAST(NULL AS BIGINT) AS store_id, coalesce(two.snapshot_week, one.snapshot_week) AS snapshot_week,
       coalesce(two.stage, one.stage) AS stage, coalesce(two.weekly_revenue, one.weekly_revenue) AS weekly_revenue, coalesce(one.weekly_quantity, two.weekly_quantity) AS weekly_quantity,
       coalesce(two.growth_rate, one.growth_rate) AS growth_rate, coalesce(one.adoption_rate, two.adoption_rate) AS adoption_rate, CAST(0 AS DOUBLE) AS market_share,
       coalesce(one.margin_rate, two.margin_rate) AS margin_rate, coalesce(two.velocity, one.velocity) AS velocity
FROM one FULL JOIN two ON two.product_id = one.product_id""",
)
def snapshot_lifecycle(t):
    """Two runs in one week: the second refreshes the stage and what it is judged by."""
    path = f"{checkpoint_root(t.spark)}/snapshots-{uuid.uuid4().hex}"
    for day, start in ((EARLIER, "2001-08-07"), (AS_OF, "2001-08-12")):
        lifecycle.snapshot_lifecycle(path, lifecycle.lifecycle_stage(_style_sales(t, start), t("style_products"), t.stores, day))
    return t.spark.read.parquet(path)
