"""Floor-space and site queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from aisle.operators import sites, zones
from aisle.plans.registry import query

START, END = "2001-01-01", "2001-11-04"
AS_OF = "2001-11-04"
TRAFFIC_AS_OF = "2024-01-30"


def _facts(t):
    lines = t.sales("store_id", "sale_date", "receipt_no", "item_id", "category", "quantity", "total_amount", start=START, end=END)
    return zones.aggregate_zone_sales(lines, t("zone_item_mapping"), t("store_zones"), t("store_traffic"))


FACTS = f"""
zf0 AS (SELECT s.store_id, m.zone_id, sale_date, CAST(sum(CAST(total_amount AS DECIMAL(18,4))) AS DOUBLE) AS revenue, count(DISTINCT receipt_no) AS transaction_count, sum(quantity) AS items_sold
        FROM sales s JOIN zone_item_mapping m ON m.store_id = s.store_id AND m.category = s.category AND (m.item_id IS NULL OR m.item_id = s.item_id)
        WHERE sale_date BETWEEN DATE '{START}' AND DATE '{END}' GROUP BY ALL),
tv AS (SELECT store_id, traffic_date, sum(enter_count) AS v FROM store_traffic GROUP BY ALL),
zc AS (SELECT store_id, count(*) AS n FROM store_zones WHERE is_active GROUP BY store_id),
zf AS (SELECT zf0.*, CAST(floor(coalesce(v, 0) / greatest(coalesce(n, 1), 1)) AS BIGINT) AS traffic_count FROM zf0 LEFT JOIN tv ON tv.store_id = zf0.store_id AND traffic_date = sale_date LEFT JOIN zc ON zc.store_id = zf0.store_id)"""
TOTALS = f"""
{FACTS},
zs AS (SELECT zone_id, CAST(sum(CAST(revenue AS DECIMAL(18,4))) AS DOUBLE) AS revenue, CAST(sum(transaction_count) AS BIGINT) AS transaction_count, sum(items_sold) AS items_sold, CAST(sum(traffic_count) AS BIGINT) AS traffic_count FROM zf GROUP BY zone_id),
zt AS (SELECT z.id AS zone_id, z.* EXCLUDE (id), coalesce(revenue, 0) AS revenue, coalesce(transaction_count, 0) AS transaction_count, coalesce(items_sold, 0) AS items_sold, coalesce(traffic_count, 0) AS traffic_count
       FROM store_zones z LEFT JOIN zs ON zs.zone_id = z.id WHERE is_active),
kp AS (SELECT store_id, zone_id, zone_name, zone_type, area_sqm, round(revenue * 100) / 100 AS revenue, transaction_count, round(items_sold * 100) / 100 AS items_sold, traffic_count,
       round(revenue / area_sqm * 100) / 100 AS revenue_per_sqm, round(items_sold / area_sqm * 100) / 100 AS items_per_sqm,
       CASE WHEN traffic_count > 0 THEN round(CAST(transaction_count AS DOUBLE) / traffic_count * 10000) / 10000 ELSE 0 END AS traffic_conversion FROM zt)"""


@query("zone_facts", f"WITH {FACTS} SELECT * FROM zf")
def zone_facts(t):
    return _facts(t)


@query("zone_kpis", f"WITH {TOTALS} SELECT * FROM kp")
def zone_kpis(t):
    return zones.zone_kpis(t("store_zones"), _facts(t), START, END)


@query(
    "zone_summary",
    f"""
WITH {TOTALS} SELECT store_id, count(*) AS total_zones, round(sum(area_sqm) * 10) / 10 AS total_area,
       round(CAST(sum(CAST(revenue AS DECIMAL(18,4))) AS DOUBLE) / sum(area_sqm) * 100) / 100 AS avg_revenue_per_sqm, arg_max(zone_name, ROW(revenue_per_sqm, -zone_id)) AS top_zone_name FROM kp GROUP BY store_id""",
)
def zone_summary(t):
    return zones.zone_summary(zones.zone_kpis(t("store_zones"), _facts(t), START, END))


@query(
    "zone_heatmap",
    f"""
WITH {TOTALS}, p AS (SELECT store_id, CASE WHEN max(revenue) = 0 THEN 1 ELSE max(revenue) END AS peak, CAST(max(position_x + width) AS DOUBLE) AS plan_width, CAST(max(position_y + height) AS DOUBLE) AS plan_height FROM zt GROUP BY store_id)
SELECT zt.store_id, zone_id, zone_name, position_x, position_y, CAST(width AS DOUBLE) AS width, CAST(height AS DOUBLE) AS height, round(revenue / peak * 10000) / 10000 AS intensity, round(revenue * 100) / 100 AS revenue, plan_width, plan_height
FROM zt JOIN p ON p.store_id = zt.store_id""",
)
def zone_heatmap(t):
    plan = t("store_zones").withColumn("width", F.col("width").cast("double")).withColumn("height", F.col("height").cast("double"))
    return zones.zone_heatmap(plan, _facts(t), START, END)


@query(
    "zone_ranking",
    f"""
WITH {TOTALS} SELECT zone_id, zone_name, s.name AS store_name, zone_type, round(revenue / zt.area_sqm * 100) / 100 AS metric_value,
       row_number() OVER (ORDER BY revenue / zt.area_sqm DESC, zone_id) AS rank FROM zt JOIN stores s ON s.id = zt.store_id""",
)
def zone_ranking(t):
    return zones.zone_ranking(t("store_zones"), t.stores, _facts(t), START, END)


@query(
    "zone_trends",
    f"""
WITH {FACTS} SELECT zone_id, CAST(date_trunc('month', sale_date) AS DATE) AS period_date, round(CAST(sum(CAST(revenue AS DECIMAL(18,4))) AS DOUBLE) * 100) / 100 AS revenue,
       CAST(sum(transaction_count) AS BIGINT) AS transaction_count, round(sum(items_sold) * 100) / 100 AS items_sold,
       round(CAST(sum(CAST(revenue AS DECIMAL(18,4))) AS DOUBLE) / max(area_sqm) * 100) / 100 AS revenue_per_sqm
FROM zf JOIN store_zones z ON z.id = zone_id GROUP BY zone_id, CAST(date_trunc('month', sale_date) AS DATE)""",
)
def zone_trends(t):
    return zones.zone_trends(t("store_zones"), _facts(t), START, END, "monthly")


@query(
    "layout_advice",
    f"""
WITH {TOTALS}, a AS (SELECT *, revenue / area_sqm AS sqm, CAST(transaction_count AS DOUBLE) / nullif(traffic_count, 0) AS conv FROM zt),
b AS (SELECT *, CAST(sum(CAST(sqm AS DECIMAL(28,8))) OVER (PARTITION BY store_id) AS DOUBLE) / count(*) OVER (PARTITION BY store_id) AS mean,
      CAST(sum(transaction_count) OVER (PARTITION BY store_id) AS DOUBLE) / greatest(sum(traffic_count) OVER (PARTITION BY store_id), 1) AS mconv, max(traffic_count) OVER (PARTITION BY store_id) AS peak FROM a)
SELECT store_id, zone_id, zone_name, 'low_revenue_per_sqm' AS issue, 'high' AS priority, round(sqm * 100) / 100 AS current_value, round(mean * 100) / 100 AS benchmark,
       round((mean - sqm) * area_sqm) AS estimated_gain, 'change the category or shrink the zone' AS suggestion FROM b WHERE mean > 0 AND sqm < mean * CAST(0.7 AS DOUBLE)
UNION ALL SELECT store_id, zone_id, zone_name, 'low_conversion', 'medium', round(conv * 100 * 10) / 10, round(mconv * 100 * 10) / 10,
       round(traffic_count * CAST(0.01 AS DOUBLE) * (revenue / greatest(transaction_count, 1))), 'place impulse goods and improve display' FROM b WHERE traffic_count > 0 AND conv < mconv * CAST(0.6 AS DOUBLE)
UNION ALL SELECT store_id, zone_id, zone_name, 'quiet_entrance', 'high', CAST(traffic_count AS DOUBLE), CAST(peak AS DOUBLE), NULL, 'move traffic-drawing categories to the entrance'
FROM b WHERE zone_type = 'entrance' AND traffic_count > 0 AND traffic_count < peak * 0.5""",
)
def layout_advice(t):
    return zones.sorted_advice(zones.layout_advice(t("store_zones"), _facts(t), START, END))


@query(
    "compare_zone_types",
    f"""
WITH {TOTALS} SELECT zone_type, store_id, s.name AS store_name, round(CAST(sum(CAST(revenue AS DECIMAL(18,4))) AS DOUBLE) * 100) / 100 AS revenue, CAST(sum(transaction_count) AS BIGINT) AS transaction_count,
       round(sum(items_sold) * 100) / 100 AS items_sold, round(sum(zt.area_sqm) * 100) / 100 AS total_area_sqm,
       round(CAST(sum(CAST(revenue AS DECIMAL(18,4))) AS DOUBLE) / sum(zt.area_sqm) * 100) / 100 AS revenue_per_sqm, count(*) AS zone_count
FROM zt JOIN stores s ON s.id = store_id GROUP BY zone_type, store_id, s.name""",
)
def compare_zone_types(t):
    return zones.compare_zone_types(t("store_zones"), t.stores, _facts(t), START, END)


D8 = "CAST(sum(CAST({} AS DECIMAL(28,8))) AS DOUBLE) / count(*)"
SCORES = f"""
tm AS (SELECT store_id, CAST(sum(enter_count) AS DOUBLE) / count(*) AS m FROM traffic WHERE traffic_date >= DATE '{TRAFFIC_AS_OF}' - 30 GROUP BY store_id),
tc AS (SELECT city, {D8.format('m')} AS m FROM tm JOIN stores s ON s.id = store_id GROUP BY city),
dn AS (SELECT district, count(*) AS n FROM stores WHERE is_active GROUP BY district),
ts AS (SELECT c.id, CASE WHEN dn.n > 0 THEN least(100, (CASE WHEN coalesce(m, 0) <> 0 THEN least(100, m / 10) ELSE 50 END) * CAST(1.2 AS DOUBLE)) ELSE CASE WHEN coalesce(m, 0) <> 0 THEN least(100, m / 10) ELSE 50 END END AS traffic_score
       FROM candidates c LEFT JOIN tc ON tc.city = c.city LEFT JOIN dn ON dn.district = c.district),
ds AS (SELECT c.id, o.id AS oid, 2 * 6371.0 * atan2(sqrt(h), sqrt(1 - h)) AS km FROM (
       SELECT c.id, c.city, o.id AS oid, pow(sin(radians(CAST(o.latitude AS DOUBLE) - CAST(c.latitude AS DOUBLE)) / 2), 2)
         + cos(radians(c.latitude)) * cos(radians(o.latitude)) * pow(sin(radians(CAST(o.longitude AS DOUBLE) - CAST(c.longitude AS DOUBLE)) / 2), 2) AS h
       FROM candidates c JOIN competitors o ON o.city = c.city WHERE c.latitude IS NOT NULL) c JOIN competitors o ON o.id = c.oid),
pn AS (SELECT id, sum(CASE WHEN km <= 0.5 THEN 15 WHEN km <= 1 THEN 8 WHEN km <= 2 THEN 3 ELSE 0 END) AS p FROM ds GROUP BY id),
cs AS (SELECT c.id, CAST(CASE WHEN latitude IS NULL OR longitude IS NULL THEN 60 WHEN c.city NOT IN (SELECT city FROM competitors) THEN 85 ELSE greatest(10, 100 - coalesce(p, 0)) END AS DOUBLE) AS competition_score
       FROM candidates c LEFT JOIN pn ON pn.id = c.id),
mc AS (SELECT s.city, count(DISTINCT m.id) AS n FROM members m JOIN stores s ON s.id = m.register_store_id WHERE m.is_active GROUP BY s.city),
gs AS (SELECT c.id, CAST(CASE WHEN n > 10000 THEN 90 WHEN n > 5000 THEN 75 WHEN n > 1000 THEN 60 ELSE 45 END AS DOUBLE) AS demographic_score FROM candidates c LEFT JOIN mc ON mc.city = c.city),
ps AS (SELECT c.id, CAST(CASE WHEN n >= 3 THEN 80 WHEN n >= 1 THEN 65 ELSE 50 END AS DOUBLE) AS transport_score FROM candidates c LEFT JOIN dn ON dn.district = c.district),
rv AS (SELECT store_id, CAST(sum(CAST(total_amount AS DECIMAL(18,4))) AS DOUBLE) AS revenue FROM sales WHERE sale_date >= DATE '{AS_OF}' - 30 GROUP BY store_id),
rc AS (SELECT city, {D8.format('revenue')} AS m FROM rv JOIN stores s ON s.id = store_id GROUP BY city),
os AS (SELECT c.id, CAST(CASE WHEN m > 500000 THEN 90 WHEN m > 200000 THEN 75 WHEN m > 100000 THEN 60 ELSE 50 END AS DOUBLE) AS commercial_score FROM candidates c LEFT JOIN rc ON rc.city = c.city)"""
EVALUATED = f"""
{SCORES},
e0 AS (SELECT c.*, traffic_score, competition_score, demographic_score, transport_score, commercial_score,
       traffic_score * CAST(0.25 AS DOUBLE) + competition_score * CAST(0.20 AS DOUBLE) + demographic_score * CAST(0.20 AS DOUBLE) + transport_score * CAST(0.15 AS DOUBLE) + commercial_score * CAST(0.20 AS DOUBLE) AS total
       FROM candidates c JOIN ts ON ts.id = c.id JOIN cs ON cs.id = c.id JOIN gs ON gs.id = c.id JOIN ps ON ps.id = c.id JOIN os ON os.id = c.id),
e1 AS (SELECT *, (SELECT coalesce(CAST(sum(CAST(revenue AS DECIMAL(28,4))) AS DOUBLE) / count(*), 200000) FROM rv) * (total / 70.0) * least(2.0, area_sqm / 100.0) AS rev FROM e0),
ev AS (SELECT id AS location_id, name AS location_name, round(total * 10) / 10 AS total_score, round(traffic_score * 10) / 10 AS traffic_score, round(competition_score * 10) / 10 AS competition_score,
       round(demographic_score * 10) / 10 AS demographic_score, round(transport_score * 10) / 10 AS transport_score, round(commercial_score * 10) / 10 AS commercial_score,
       round(rev) AS predicted_monthly_revenue, CASE WHEN monthly_rent <> 0 AND rev > 0 THEN round(monthly_rent * 12 / (rev * CAST(0.15 AS DOUBLE)) * 10) / 10 END AS predicted_payback_months,
       round(greatest(30, least(100, total * CAST(0.8 AS DOUBLE) + 20)) * 10) / 10 AS confidence_level FROM e1)"""


def _candidates(t):
    return t("candidates").withColumn("latitude", F.col("latitude").cast("double")).withColumn("longitude", F.col("longitude").cast("double"))


def _competitors(t):
    return t("competitors").withColumn("latitude", F.col("latitude").cast("double")).withColumn("longitude", F.col("longitude").cast("double"))


def _evaluated(t):
    return sites.evaluate_sites(
        _candidates(t), t.stores, t("traffic"), t.sales("store_id", "sale_date", "total_amount", start="2001-10-01"),
        t("members"), _competitors(t), AS_OF, traffic_as_of=TRAFFIC_AS_OF,
    )


@query("traffic_score", f"WITH {SCORES} SELECT * FROM ts")
def traffic_score(t):
    return sites.traffic_score(t("candidates"), t.stores, t("traffic"), TRAFFIC_AS_OF)


@query("competition_score", f"WITH {SCORES} SELECT * FROM cs")
def competition_score(t):
    return sites.competition_score(_candidates(t), _competitors(t))


@query("demographic_score", f"WITH {SCORES} SELECT * FROM gs")
def demographic_score(t):
    return sites.demographic_score(t("candidates"), t.stores, t("members"))


@query("transport_score", f"WITH {SCORES} SELECT * FROM ps")
def transport_score(t):
    return sites.transport_score(t("candidates"), t.stores)


@query("commercial_score", f"WITH {SCORES} SELECT * FROM os")
def commercial_score(t):
    return sites.commercial_score(t("candidates"), t.stores, t.sales("store_id", "sale_date", "total_amount", start="2001-10-01"), AS_OF)


@query("evaluate_sites", f"WITH {EVALUATED} SELECT * FROM ev")
def evaluate_sites(t):
    return _evaluated(t)


@query(
    "location_factors",
    f"WITH {EVALUATED} SELECT location_id, unnest(['traffic', 'competition', 'demographic', 'transport', 'commercial']) AS factor_type, unnest([traffic_score, competition_score, demographic_score, transport_score, commercial_score]) AS normalized_score FROM ev",
)
def location_factors(t):
    return sites.location_factors(_evaluated(t))


@query(
    "compare_sites",
    f"WITH {EVALUATED} SELECT * REPLACE (CASE WHEN location_id % 2 = 0 THEN total_score - 5 ELSE total_score END AS total_score), CASE WHEN location_id % 2 = 0 THEN 2 ELSE 1 END AS evaluated_at FROM ev",
)
def compare_sites(t):
    first = _evaluated(t).withColumn("evaluated_at", F.lit(1))
    again = first.where(F.col("location_id") % 2 == 0).withColumn("evaluated_at", F.lit(2)).withColumn(
        "total_score", F.col("total_score") - 5
    )
    return sites.compare_sites(first.unionByName(again))


@query(
    "store_benchmark",
    f"""
WITH {SCORES}, j AS (SELECT s.id, revenue, revenue / nullif(area_sqm, 0) AS sqm FROM stores s LEFT JOIN rv ON rv.store_id = s.id WHERE is_active)
SELECT count(DISTINCT id) AS store_count, round(CAST(sum(CAST(revenue AS DECIMAL(28,8))) AS DOUBLE) / count(revenue)) AS avg_monthly_revenue, round(max(revenue)) AS top_store_revenue,
       round(CAST(sum(CAST(sqm AS DECIMAL(28,8))) AS DOUBLE) / count(sqm) * 10) / 10 AS avg_sqm_efficiency, (SELECT round({D8.format('m')}) FROM tm) AS avg_traffic FROM j""",
)
def store_benchmark(t):
    return sites.store_benchmark(
        t.stores, t.sales("store_id", "sale_date", "total_amount", start="2001-10-01"), t("traffic"), AS_OF, TRAFFIC_AS_OF
    )
