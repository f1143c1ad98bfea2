"""Store KPI, anomaly and segmentation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from aisle.operators import anomaly, kpi, rfm
from aisle.plans.registry import query

START, END = "2000-11-05", "2001-11-04"
ALL_START, ALL_END = "1995-01-01", "2001-11-04"

_MONEY = "CAST(sum(CAST({} AS DECIMAL(18,4))) AS DOUBLE)"
GMV = _MONEY.format("total_amount")


@query(
    "kpi_summary",
    f"""
WITH f AS (
  SELECT coalesce({GMV}, 0) AS g, count(DISTINCT receipt_no) AS n, count(DISTINCT store_id) AS s, count(DISTINCT member_id) AS m,
         coalesce({_MONEY.format('discount_amount')}, 0) AS d
  FROM sales WHERE sale_date BETWEEN DATE '{ALL_START}' AND DATE '{ALL_END}'),
a AS (SELECT greatest(coalesce(sum(area_sqm), 1), 1) AS area FROM stores WHERE is_active)
SELECT round(g * 100) / 100 AS gmv, n AS total_orders, round(g / n * 100) / 100 AS avg_ticket, s AS active_stores, m AS active_members,
       round(d * 100) / 100 AS total_discount, round(g / 2500 * 100) / 100 AS daily_avg_gmv, round(g / area * 100) / 100 AS sqm_efficiency,
       2500 AS period_days
FROM f, a""",
)
def kpi_summary(t):
    columns = ("sale_date", "store_id", "receipt_no", "member_id", "total_amount", "discount_amount")
    return kpi.kpi_summary(t.sales(*columns), t.stores, ALL_START, ALL_END)


def _ranking_sql(value: str, label: str, start: str, end: str) -> str:
    return f"""
WITH g AS (SELECT store_id, {GMV} AS gmv, count(DISTINCT receipt_no) AS orders
           FROM sales WHERE sale_date BETWEEN DATE '{start}' AND DATE '{end}' GROUP BY store_id)
SELECT row_number() OVER (ORDER BY {value} DESC, g.store_id) AS rank, g.store_id, code AS store_code, name AS store_name, city,
       round(CAST({value} AS DOUBLE) * 100) / 100 AS metric_value, round(gmv * 100) / 100 AS gmv, orders
FROM g JOIN stores ON id = g.store_id"""


@query("store_ranking", _ranking_sql("gmv", "gmv", ALL_START, ALL_END))
def store_ranking(t):
    return kpi.store_ranking(
        t.sales("store_id", "sale_date", "receipt_no", "total_amount"), t.stores, ALL_START, ALL_END
    )


@query("store_ranking_avg_ticket", _ranking_sql("gmv / orders", "avg_ticket", START, END))
def store_ranking_avg_ticket(t):
    lines = t.sales("store_id", "sale_date", "receipt_no", "total_amount", start=START, end=END)
    return kpi.store_ranking(lines, t.stores, START, END, metric="avg_ticket")


@query(
    "missing_periods",
    """
WITH d AS (SELECT DISTINCT store_id, sale_date FROM sales),
span AS (SELECT store_id, unnest(generate_series(min(sale_date), max(sale_date), INTERVAL 1 DAY))::DATE AS day FROM d GROUP BY store_id),
missing AS (SELECT span.store_id, day, day - CAST(row_number() OVER (PARTITION BY span.store_id ORDER BY day) AS INTEGER) AS island
            FROM span LEFT JOIN d ON d.store_id = span.store_id AND d.sale_date = day WHERE d.sale_date IS NULL)
SELECT store_id, min(day) AS gap_start, max(day) AS gap_end, CAST(count(*) AS INTEGER) AS days FROM missing GROUP BY store_id, island""",
)
def missing_periods(t):
    return kpi.missing_periods(t.sales("store_id", "sale_date"), "sale_date", ["store_id"])


@query(
    "missing_period_log",
    """
WITH d AS (SELECT DISTINCT store_id, traffic_date FROM store_traffic),
n AS (SELECT *, lead(traffic_date) OVER (PARTITION BY store_id ORDER BY traffic_date) AS nxt FROM d)
SELECT store_id, 'traffic' AS data_type, traffic_date + 1 AS missing_start, nxt - 1 AS missing_end, CAST(nxt - traffic_date - 1 AS INTEGER) AS missing_count,
       DATE '2024-01-31' AS detected_at
FROM n WHERE nxt - traffic_date > 1""",
)
def missing_period_log(t):
    gaps = kpi.missing_periods(t("store_traffic"), "traffic_date", ["store_id"])
    return kpi.missing_period_log(gaps, "traffic", "2024-01-31")


@query(
    "report_sales_summary",
    f"""
WITH g AS (SELECT store_id, sale_date, count(DISTINCT receipt_no) AS orders, {GMV} AS gmv
           FROM sales WHERE sale_date BETWEEN DATE '{ALL_START}' AND DATE '{ALL_END}' GROUP BY ALL)
SELECT name AS store_name, sale_date, orders, round(gmv * 100) / 100 AS gmv, round(gmv / orders * 100) / 100 AS avg_ticket
FROM g JOIN stores ON id = store_id""",
)
def report_sales_summary(t):
    return kpi.report_sales_summary(
        t.sales("store_id", "sale_date", "receipt_no", "total_amount"), t.stores, ALL_START, ALL_END
    )


@query(
    "report_inventory_status",
    f"""
SELECT s.name AS store_name, item_id, item_name, category, quantity, min_stock, max_stock, snapshot_date
FROM inventory i JOIN stores s ON s.id = i.store_id WHERE snapshot_date BETWEEN DATE '2001-01-01' AND DATE '{END}'""",
)
def report_inventory_status(t):
    return kpi.report_inventory_status(t("inventory"), t.stores, "2001-01-01", END)


@query(
    "report_daily_gmv",
    f"""
SELECT name AS store_name, sale_date, round({GMV} * 100) / 100 AS gmv FROM sales JOIN stores ON id = store_id
WHERE sale_date BETWEEN DATE '{START}' AND DATE '{END}' GROUP BY store_id, name, sale_date""",
)
def report_daily_gmv(t):
    lines = t.sales("store_id", "sale_date", "total_amount", start=START, end=END)
    return kpi.report_daily_gmv(lines, t.stores, START, END)


DAILY_CTE = f"daily AS (SELECT store_id, sale_date, {GMV} AS v FROM sales GROUP BY store_id, sale_date)"
IQR_CTE = """
q AS (SELECT store_id, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS md, quantile_cont(v, 0.75) AS q3
      FROM {period} GROUP BY store_id HAVING count(*) >= 7),
f AS (SELECT p.*, q3 - q1 AS iqr, q1 - (q3 - q1) * 1.5 AS low, q3 + (q3 - q1) * 1.5 AS high, md FROM {period} p JOIN q USING (store_id)),
iqr AS (SELECT store_id, sale_date AS date, 'sales_anomaly' AS type, 'IQR' AS method, round(v * 100) / 100 AS value,
        round(low * 100) / 100 AS expected_low, round(high * 100) / 100 AS expected_high,
        round((v - md) / greatest(iqr, 1) * 100) / 100 AS deviation,
        CASE WHEN abs((v - md) / greatest(iqr, 1)) > 3 THEN 'high' ELSE 'medium' END AS severity,
        round(abs((v - md) / greatest(iqr, 1)) * 100) / 100 AS severity_score,
        CASE WHEN v > high THEN 'above' ELSE 'below' END AS direction
        FROM f WHERE v < low OR v > high)"""
YOY_CTE = f"""
b AS (SELECT store_id, CAST(sale_date + INTERVAL 12 MONTH AS DATE) AS d, v AS ly FROM daily
      WHERE sale_date BETWEEN DATE '{START}' - INTERVAL 12 MONTH AND DATE '{END}' - INTERVAL 12 MONTH),
yoy AS (SELECT c.store_id, c.sale_date AS date, 'yoy_deviation' AS type, 'YoY' AS method, round(v * 100) / 100 AS value,
        round(ly * 100) / 100 AS last_year_value, round((v - ly) / ly * 100 * 10) / 10 AS yoy_change_pct,
        CASE WHEN abs((v - ly) / ly * 100) > 100 THEN 'high' ELSE 'medium' END AS severity,
        round(abs((v - ly) / ly * 100) / 50 * 100) / 100 AS severity_score,
        CASE WHEN (v - ly) / ly > 0 THEN 'above' ELSE 'below' END AS direction
        FROM daily c JOIN b ON b.store_id = c.store_id AND b.d = c.sale_date
        WHERE c.sale_date BETWEEN DATE '{START}' AND DATE '{END}' AND abs((v - ly) / ly) > 0.5)"""
STOCK_CTE = """
st AS (SELECT *, CASE WHEN quantity < min_stock THEN (min_stock - quantity) / greatest(min_stock, 1)
                      WHEN max_stock <> 0 THEN (quantity - max_stock) / greatest(max_stock, 1) ELSE 0 END AS sc
       FROM inventory WHERE snapshot_date = (SELECT max(snapshot_date) FROM inventory) AND (quantity < min_stock OR quantity > max_stock)),
stock AS (SELECT store_id, item_id, item_name, snapshot_date AS date, 'inventory_anomaly' AS type, 'threshold' AS method,
          round(quantity * 100) / 100 AS quantity, round(min_stock * 100) / 100 AS min_stock, round(max_stock * 100) / 100 AS max_stock,
          CASE WHEN sc > 0.5 THEN 'high' ELSE 'medium' END AS severity, round(sc * 100) / 100 AS severity_score,
          CASE WHEN quantity < min_stock THEN 'below_min' ELSE 'above_max' END AS direction FROM st)"""


@query("iqr_anomalies", f"WITH {DAILY_CTE}, {IQR_CTE.format(period='daily')} SELECT * FROM iqr")
def iqr_anomalies(t):
    return anomaly.iqr_anomalies(anomaly.daily_sales(t.sales("store_id", "sale_date", "total_amount")))


@query("yoy_anomalies", f"WITH {DAILY_CTE}, {YOY_CTE} SELECT * FROM yoy")
def yoy_anomalies(t):
    lines = t.sales("store_id", "sale_date", "total_amount", start="1999-11-05", end=END)
    return anomaly.yoy_anomalies(anomaly.daily_sales(lines), START, END)


@query("stock_threshold_anomalies", f"WITH {STOCK_CTE} SELECT * FROM stock")
def stock_threshold_anomalies(t):
    return anomaly.stock_threshold_anomalies(t("inventory"))


@query(
    "anomaly_feed",
    f"""
WITH {DAILY_CTE}, period AS (SELECT * FROM daily WHERE sale_date BETWEEN DATE '{START}' AND DATE '{END}'),
{IQR_CTE.format(period='period')}, {YOY_CTE}, {STOCK_CTE},
u AS (SELECT * FROM iqr UNION ALL BY NAME SELECT * FROM yoy UNION ALL BY NAME SELECT * FROM stock)
SELECT u.*, s.name AS store_name, (SELECT count(*) FROM u) AS total_anomalies FROM u LEFT JOIN stores s ON s.id = u.store_id
ORDER BY severity_score DESC, type, store_id, date, item_id NULLS FIRST LIMIT 50""",
)
def anomaly_feed(t):
    lines = t.sales("store_id", "sale_date", "total_amount", start="1999-11-01", end=END)
    return anomaly.anomaly_feed(lines, t.stores, t("inventory"), START, END)


RFM_CTE = """
b AS (SELECT m.id AS member_id, member_no, name, DATE '2001-11-04' - max(transaction_date) AS recency,
             count(DISTINCT receipt_no) AS frequency, CAST(sum(CAST(amount AS DECIMAL(18,4))) AS DOUBLE) AS monetary
      FROM members m JOIN member_transactions t ON t.member_id = m.id WHERE is_active GROUP BY m.id, member_no, name),
q AS (SELECT quantile_cont(recency, [0.25, 0.5, 0.75]) AS rq, quantile_cont(frequency, [0.25, 0.5, 0.75]) AS fq, quantile_cont(monetary, [0.25, 0.5, 0.75]) AS mq FROM b),
s AS (SELECT b.*, CASE WHEN recency <= rq[1] THEN 4 WHEN recency <= rq[2] THEN 3 WHEN recency <= rq[3] THEN 2 ELSE 1 END AS r_score,
             CASE WHEN frequency <= fq[1] THEN 1 WHEN frequency <= fq[2] THEN 2 WHEN frequency <= fq[3] THEN 3 ELSE 4 END AS f_score,
             CASE WHEN monetary <= mq[1] THEN 1 WHEN monetary <= mq[2] THEN 2 WHEN monetary <= mq[3] THEN 3 ELSE 4 END AS m_score FROM b, q),
rfm AS (SELECT *, concat(r_score, f_score, m_score) AS rfm_score,
        CASE concat(r_score, f_score, m_score) WHEN '444' THEN 'key_value' WHEN '443' THEN 'key_value' WHEN '434' THEN 'key_growth' WHEN '433' THEN 'key_growth'
             WHEN '344' THEN 'key_retain' WHEN '343' THEN 'key_retain' WHEN '334' THEN 'key_win_back' WHEN '333' THEN 'general_value'
             WHEN '222' THEN 'general_growth' WHEN '111' THEN 'lost' ELSE
             CASE WHEN r_score + f_score + m_score >= 10.5 THEN 'key_value' WHEN r_score + f_score + m_score >= 9 THEN 'key_retain'
                  WHEN r_score + f_score + m_score >= 7.5 THEN 'general_value' WHEN r_score + f_score + m_score >= 6 THEN 'general_growth' ELSE 'lost' END END AS segment FROM s)"""


@query("rfm_scores", f"WITH {RFM_CTE} SELECT * FROM rfm")
def rfm_scores(t):
    return rfm.rfm_scores(rfm.rfm_base(t("members"), t("member_transactions"), "2001-11-04"))


@query(
    "rfm_summary",
    f"WITH {RFM_CTE} SELECT segment, count(*) AS count, round(CAST(sum(CAST(monetary AS DECIMAL(18,4))) AS DOUBLE) / count(*) * 100) / 100 AS avg_monetary FROM rfm GROUP BY segment",
)
def rfm_summary(t):
    scored = rfm.rfm_scores(rfm.rfm_base(t("members"), t("member_transactions"), "2001-11-04"))
    return rfm.rfm_summary(scored).orderBy(F.desc("count"), "segment")
