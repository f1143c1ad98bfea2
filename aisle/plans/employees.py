"""Employee performance queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from aisle.operators import employee
from aisle.plans.registry import query

START, END = "2001-01-01", "2001-07-31"
AS_OF = "2001-08-01"


def _scores(t, periods):
    return employee.employee_scores(
        t("employees"), t("employee_sales_records"), t("employee_service_records"), t("employee_attendance"),
        t("employee_training"), t("performance_weights"), periods,
    )


def _score_sql(periods: str) -> str:
    """CTEs ``pd`` .. ``sc``; ``periods`` is a SELECT of period, lo, hi."""
    return f"""
pd AS ({periods}),
em AS (SELECT e.*, period, lo, hi FROM employees e, pd),
pv AS (SELECT period, store_id, employee_id, CAST(sum(CAST(revenue AS DECIMAL(18,4))) AS DOUBLE) AS v FROM employee_sales_records, pd WHERE record_date BETWEEN lo AND hi GROUP BY ALL),
ov AS (SELECT period, employee_id, CAST(sum(CAST(v AS DECIMAL(18,4))) AS DOUBLE) AS v FROM pv GROUP BY ALL),
sl AS (SELECT em.period, em.id, CASE WHEN count(pv.v) = 0 THEN 50 WHEN count(pv.v) = 1 THEN 75 ELSE CAST(count(*) FILTER (pv.v < coalesce(ov.v, 0)) AS DOUBLE) / count(pv.v) * 100 END AS s
       FROM em LEFT JOIN ov ON ov.employee_id = em.id AND ov.period = em.period LEFT JOIN pv ON pv.store_id = em.store_id AND pv.period = em.period GROUP BY em.period, em.id),
sv AS (SELECT em.period, em.id, greatest(0, least(100, coalesce(nullif(sum(customer_rating) / count(customer_rating), 0), 3) / 5.0 * 80 + least(20, sum(praise_count) * 3) - least(40, sum(complaint_count) * 5))) AS s
       FROM em JOIN employee_service_records r ON r.employee_id = em.id AND r.store_id = em.store_id AND record_date BETWEEN lo AND hi GROUP BY em.period, em.id),
att AS (SELECT em.period, em.id, greatest(0, least(100, 100 - sum(is_absent) * 15 - sum(is_late) * 5 - greatest(0, sum(CAST(scheduled_hours AS DOUBLE)) - sum(CAST(actual_hours AS DOUBLE))) * 2)) AS s
       FROM em JOIN employee_attendance r ON r.employee_id = em.id AND r.store_id = em.store_id AND attend_date BETWEEN lo AND hi GROUP BY em.period, em.id),
tr AS (SELECT em.period, em.id, CAST(sum(completed) AS DOUBLE) / count(*) * 70 + coalesce(sum(score) FILTER (completed = 1) / count(*) FILTER (completed = 1), 0) / 100 * 30 AS s
       FROM em JOIN employee_training r ON r.employee_id = em.id AND scheduled_date BETWEEN lo AND hi GROUP BY em.period, em.id),
j AS (SELECT em.*, CAST(coalesce(sl.s, 50) AS DOUBLE) AS a, CAST(coalesce(sv.s, 60) AS DOUBLE) AS b, CAST(coalesce(att.s, 70) AS DOUBLE) AS c, CAST(coalesce(tr.s, 70) AS DOUBLE) AS d,
      CAST(coalesce(w1.weight_sales, w2.weight_sales, 0.40) AS DOUBLE) AS wa, CAST(coalesce(w1.weight_service, w2.weight_service, 0.25) AS DOUBLE) AS wb,
      CAST(coalesce(w1.weight_attendance, w2.weight_attendance, 0.20) AS DOUBLE) AS wc, CAST(coalesce(w1.weight_training, w2.weight_training, 0.15) AS DOUBLE) AS wd
      FROM em LEFT JOIN sl ON sl.id = em.id AND sl.period = em.period LEFT JOIN sv ON sv.id = em.id AND sv.period = em.period LEFT JOIN att ON att.id = em.id AND att.period = em.period
      LEFT JOIN tr ON tr.id = em.id AND tr.period = em.period
      LEFT JOIN performance_weights w1 ON w1.store_id = em.store_id AND w1.position = em.position LEFT JOIN performance_weights w2 ON w2.store_id = em.store_id AND w2.position = 'default'),
sc AS (SELECT period, id AS employee_id, name AS employee_name, position, store_id, is_active, round((wa * a + wb * b + wc * c + wd * d) * 100) / 100 AS composite_score,
      round(a * 100) / 100 AS sales_score, round(b * 100) / 100 AS service_score, round(c * 100) / 100 AS attendance_score, round(d * 100) / 100 AS training_score FROM j)"""


ONE = [("all", START, END)]
ONE_SQL = _score_sql(f"SELECT 'all' AS period, DATE '{START}' AS lo, DATE '{END}' AS hi")


@query("sales_score", f"WITH {ONE_SQL} SELECT employee_id, sales_score FROM sc")
def sales_score(t):
    scored = employee.sales_score(t("employees"), t("employee_sales_records"), ONE)
    return scored.select("employee_id", (F.round(F.col("sales_score") * 100) / 100).alias("sales_score"))


@query("employee_scores", f"WITH {ONE_SQL} SELECT * FROM sc")
def employee_scores(t):
    return _scores(t, ONE)


@query(
    "employee_ranking",
    f"""
WITH {ONE_SQL}, r AS (SELECT *, row_number() OVER (ORDER BY composite_score DESC, employee_id) AS rank, lag(composite_score) OVER (ORDER BY composite_score DESC, employee_id) AS p FROM sc WHERE is_active)
SELECT * EXCLUDE (p, is_active, period), CASE WHEN rank = 1 THEN 'up' WHEN p > composite_score THEN 'down' ELSE 'stable' END AS neighbour_trend FROM r WHERE rank <= 20""",
)
def employee_ranking(t):
    return employee.employee_ranking(_scores(t, ONE))


@query(
    "employee_ranking_all",
    f"""
WITH {ONE_SQL}, r AS (SELECT *, row_number() OVER (ORDER BY composite_score DESC, employee_id) AS rank, lag(composite_score) OVER (ORDER BY composite_score DESC, employee_id) AS p FROM sc WHERE is_active)
SELECT * EXCLUDE (p, is_active, period), CASE WHEN rank = 1 THEN 'up' WHEN p > composite_score THEN 'down' ELSE 'stable' END AS neighbour_trend FROM r""",
)
def employee_ranking_all(t):
    return employee.employee_ranking(_scores(t, ONE), top=None)


@query(
    "employee_trend",
    "WITH "
    + _score_sql(
        " UNION ALL ".join(
            f"SELECT '{label}' AS period, DATE '{lo}' AS lo, DATE '{hi}' AS hi"
            for label, lo, hi in employee.month_periods(AS_OF, 4)
        )
    )
    + " SELECT employee_id, period AS window_end, period[:7] AS month, composite_score, sales_score, service_score, attendance_score, training_score FROM sc",
)
def employee_trend(t):
    return employee.employee_trend(_scores(t, employee.month_periods(AS_OF, 4)))


def _others(scope: str, part: str, over: str) -> str:
    rest = f"(CAST(sum(CAST(CASE WHEN is_active THEN {part}_score END AS DECIMAL(18,2))) OVER ({over}) AS DOUBLE) - CAST(is_active AS INT) * {part}_score)"
    n = f"(count(*) FILTER (is_active) OVER ({over}) - CAST(is_active AS INT))"
    return f"CASE WHEN {n} > 0 THEN round({rest} / {n} * 100) / 100 ELSE 50 END AS {scope}_avg_{part}"


@query(
    "peer_comparison",
    f"WITH {ONE_SQL} SELECT employee_id, employee_name, sales_score, service_score, attendance_score, training_score, "
    + ", ".join(
        _others(scope, part, over)
        for scope, over in (("store", "PARTITION BY store_id"), ("chain", ""))
        for part in employee.PARTS
    )
    + " FROM sc",
)
def peer_comparison(t):
    return employee.peer_comparison(_scores(t, ONE))


@query(
    "employee_dashboard",
    f"""
WITH {ONE_SQL}
SELECT round(CAST(sum(CAST(composite_score AS DECIMAL(18,4))) AS DOUBLE) / count(*) * 100) / 100 AS avg_score, arg_max(employee_name, ROW(composite_score, -employee_id)) AS top_performer,
       max(composite_score) AS top_score, round(CAST(sum(CAST(attendance_score AS DECIMAL(18,4))) AS DOUBLE) / count(*) * 100) / 100 AS avg_attendance_rate, count(*) AS total_employees FROM sc WHERE is_active""",
)
def employee_dashboard(t):
    return employee.employee_dashboard(_scores(t, ONE))
