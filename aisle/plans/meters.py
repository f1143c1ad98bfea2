"""Store energy and port queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from aisle.operators import energy, forecast, port
from aisle.plans.forecasting import AS_OF as SALES_AS_OF
from aisle.plans.forecasting import PLAIN, _final
from aisle.plans.registry import query

START, END = "2024-01-11", "2024-01-30"
NOW = "2024-01-31 00:00:00"
M = "CAST(sum(CAST({} AS DECIMAL(18,4))) AS DOUBLE)"
PERIOD = f"energy_date BETWEEN DATE '{START}' AND DATE '{END}'"


@query(
    "energy_dashboard",
    f"""
WITH f AS (SELECT {M.format('total_kwh')} AS k, {M.format('cost')} AS c FROM store_energy_daily WHERE {PERIOD}),
b AS (SELECT coalesce({M.format('total_kwh')}, 0) AS k FROM store_energy_daily WHERE energy_date BETWEEN DATE '2023-12-22' AND DATE '2024-01-10'),
a AS (SELECT sum(area_sqm) AS a FROM stores WHERE id IN (SELECT store_id FROM store_energy_daily WHERE {PERIOD})),
r AS (SELECT {M.format('total_amount')} AS r FROM energy_sales WHERE sale_date BETWEEN DATE '{START}' AND DATE '{END}')
SELECT round(f.k * 100) / 100 AS total_kwh, round(c * 100) / 100 AS total_cost, round(c / a * 100) / 100 AS cost_per_sqm, round(r / f.k * 100) / 100 AS revenue_per_kwh,
       CASE WHEN b.k > 0 THEN round((f.k - b.k) / b.k * 100 * 10) / 10 ELSE 0 END AS period_kwh_change_pct, (SELECT count(*) FROM equipment WHERE status = 'active') AS equipment_count
FROM f, b, a, r""",
)
def energy_dashboard(t):
    return energy.energy_dashboard(t("store_energy_daily"), t("equipment"), t.stores, t("energy_sales"), START, END)


@query(
    "energy_by_type",
    f"""
WITH d AS (SELECT equipment_type, total_kwh, cost FROM store_energy_daily JOIN equipment e ON e.id = equipment_id WHERE {PERIOD})
SELECT equipment_type, round({M.format('total_kwh')} * 100) / 100 AS total_kwh, round({M.format('cost')} * 100) / 100 AS total_cost,
       round({M.format('total_kwh')} / (SELECT {M.format('total_kwh')} FROM d) * 100 * 10) / 10 AS pct FROM d GROUP BY equipment_type""",
)
def energy_by_type(t):
    return energy.energy_by_type(t("store_energy_daily"), t("equipment"), START, END)


@query(
    "energy_trends",
    f"""
SELECT d.store_id, CAST(date_trunc('week', energy_date) AS DATE) AS period_date, round({M.format('total_kwh')} * 100) / 100 AS total_kwh, round({M.format('cost')} * 100) / 100 AS total_cost
FROM store_energy_daily d JOIN equipment e ON e.id = equipment_id WHERE {PERIOD} AND equipment_type = 'hvac' GROUP BY ALL""",
)
def energy_trends(t):
    return energy.energy_trends(t("store_energy_daily"), t("equipment"), START, END, "weekly", "hvac")


@query(
    "energy_daily",
    """
SELECT store_id, equipment_id, CAST(reading_time AS DATE) AS energy_date, round(sum(energy_kwh) * 1000000) / 1000000 AS total_kwh, max(power_kw) AS peak_kw, round(avg(power_kw) * 10000) / 10000 AS avg_kw,
       count(*) FILTER (operational_state <> 'idle') / 3600.0::DOUBLE AS operating_hours FROM energy_readings GROUP BY ALL""",
)
def energy_daily(t):
    daily = energy.energy_daily(t("energy_readings"))
    return daily.drop("cost").withColumn("total_kwh", F.round(F.col("total_kwh") * 1e6) / 1e6).withColumn(
        "avg_kw", F.round(F.col("avg_kw") * 1e4) / 1e4
    )


@query(
    "peak_hours",
    f"""
WITH m AS (SELECT store_id, CAST(extract(hour FROM reading_time) AS INT) AS hour, avg(energy_kwh) AS m FROM energy_readings WHERE CAST(reading_time AS DATE) BETWEEN DATE '{START}' AND DATE '{END}' GROUP BY ALL),
g AS (SELECT DISTINCT store_id, h.hour FROM m, (SELECT CAST(unnest(range(24)) AS INT) AS hour) h)
SELECT g.store_id, g.hour, round(coalesce(m, 0) * 10000) / 10000 AS avg_kwh, round(coalesce(m, 0) * 0.85::DOUBLE * 10000) / 10000 AS avg_cost FROM g LEFT JOIN m ON m.store_id = g.store_id AND m.hour = g.hour""",
)
def peak_hours(t):
    return energy.peak_hours(t("energy_readings"), START, END)


_DAYS = f"dk AS (SELECT store_id, energy_date, {M.format('total_kwh')} AS y FROM store_energy_daily WHERE {PERIOD} GROUP BY ALL)"
WEATHER_POINTS = f"""
{_DAYS}, pt AS (SELECT dk.store_id, energy_date, temp_high AS x, y FROM dk JOIN stores s ON s.id = dk.store_id JOIN weather w ON w.city = s.city AND weather_date = energy_date)"""
SALES_POINTS = f"""
{_DAYS}, rv AS (SELECT store_id, sale_date, {M.format('total_amount')} AS r FROM energy_sales GROUP BY ALL),
pt AS (SELECT dk.store_id, energy_date, coalesce(r, 0) AS x, y FROM dk LEFT JOIN rv ON rv.store_id = dk.store_id AND sale_date = energy_date)"""
_CORR = "SELECT store_id, CASE WHEN count(*) < 3 OR corr(x, y) IS NULL OR isnan(corr(x, y)) THEN 0 ELSE round(corr(x, y) * 10000) / 10000 END AS correlation_coefficient, count(*) AS points FROM pt GROUP BY store_id"


def _weather_points(t):
    return energy.weather_energy_points(t("store_energy_daily"), t.stores, t("weather"), START, END)


def _sales_points(t):
    return energy.sales_energy_points(t("store_energy_daily"), t("energy_sales"), START, END)


@query("weather_energy_corr", f"WITH {WEATHER_POINTS} {_CORR}")
def weather_energy_corr(t):
    return energy.point_correlation(_weather_points(t)).drop("p_value")


@query("sales_energy_corr", f"WITH {SALES_POINTS} {_CORR}")
def sales_energy_corr(t):
    return energy.point_correlation(_sales_points(t)).drop("p_value")


# The two-sided p-value by Simpson's rule over the density of the t distribution, in its angle; Spark sums a finite series.
_STEPS = 400
_P_VALUE = f"""
, cr AS (SELECT store_id, count(*) AS n, corr(x, y) AS r FROM pt GROUP BY store_id),
an AS (SELECT *, n - 2 AS df, atan(abs(r) / sqrt(1 - r * r)) AS th FROM cr WHERE n >= 3 AND abs(r) < 1),
sm AS (SELECT store_id, any_value(df) AS df, sum((CASE WHEN k = 0 OR k = {_STEPS} THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END) * pow(cos(th * k / {_STEPS}), df - 1)) * any_value(th) / {_STEPS} / 3 AS area
       FROM an, range(0, {_STEPS} + 1) AS g(k) GROUP BY store_id),
pv AS (SELECT store_id, greatest(0, 1 - 2 * area * exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(pi())) AS p FROM sm)
SELECT cr.store_id, round((CASE WHEN n < 3 OR r IS NULL OR isnan(r) THEN 1 WHEN abs(r) >= 1 THEN 0 ELSE p END) * 1000000) / 1000000 AS p_value FROM cr LEFT JOIN pv ON pv.store_id = cr.store_id"""


@query("sales_energy_significance", f"WITH {SALES_POINTS} {_P_VALUE}")
def sales_energy_significance(t):
    return energy.point_correlation(_sales_points(t)).select("store_id", "p_value")


@query("weather_energy_significance", f"WITH {WEATHER_POINTS} {_P_VALUE}")
def weather_energy_significance(t):
    return energy.point_correlation(_weather_points(t)).select("store_id", "p_value")


@query(
    "regression_line",
    f"""
WITH {SALES_POINTS}, f AS (SELECT store_id, regr_slope(y, x) AS s, regr_intercept(y, x) AS i, min(x) AS x1, max(x) AS x2 FROM pt GROUP BY store_id)
SELECT store_id, x1, round((s * x1 + i) * 10000) / 10000 AS y1, x2, round((s * x2 + i) * 10000) / 10000 AS y2 FROM f""",
)
def regression_line(t):
    line = energy.regression_line(_sales_points(t))
    return line.withColumn("y1", F.round(F.col("y1") * 1e4) / 1e4).withColumn("y2", F.round(F.col("y2") * 1e4) / 1e4)


ANOMALY = """
r AS (SELECT *, row_number() OVER w AS i, avg(total_kwh) OVER b AS m, stddev_pop(total_kwh) OVER b AS s FROM store_energy_daily
      WHERE energy_date >= DATE '2024-01-30' - 30 WINDOW w AS (PARTITION BY equipment_id ORDER BY energy_date), b AS (PARTITION BY equipment_id ORDER BY energy_date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)),
an AS (SELECT r.store_id, equipment_id, e.name AS equipment_name, energy_date AS date, round(total_kwh * 100) / 100 AS actual_kwh, round(m * 100) / 100 AS expected_kwh, round((m + s * 2) * 100) / 100 AS threshold_kwh
       FROM r JOIN equipment e ON e.id = equipment_id WHERE i > 7 AND s > 0 AND total_kwh > m + s * 2)"""


@query("energy_anomalies", f"WITH {ANOMALY} SELECT * FROM an")
def energy_anomalies(t):
    return energy.energy_anomalies(t("store_energy_daily"), t("equipment"), "2024-01-30")


@query(
    "list_energy_alerts",
    f"WITH {ANOMALY} SELECT store_id, equipment_id, 'anomaly' AS alert_type, 'warning' AS alert_level, actual_kwh AS metric_value, threshold_kwh AS threshold_value, TIMESTAMP '{NOW}' AS alert_time, false AS is_acknowledged FROM an ORDER BY store_id, equipment_id LIMIT 100",
)
def list_energy_alerts(t):
    return energy.list_energy_alerts(energy.anomaly_alerts(energy_anomalies(t), NOW), acknowledged=False)


@query(
    "schedule_advice",
    f"""
WITH {PLAIN}, fc AS ({_final('d2')} WHERE step <= 14),
md AS (SELECT store_id, quantile_cont(forecast, 0.5) AS base FROM fc GROUP BY store_id),
pk AS (SELECT fc.store_id, isodow(date) - 1 AS dow, max(forecast / base) AS ratio FROM fc JOIN md ON md.store_id = fc.store_id AND base > 0 WHERE forecast / base > 1.5 OR is_holiday GROUP BY ALL),
hr AS (SELECT store_id, hour, CAST(sum(enter_count) AS DOUBLE) / count(*) AS m FROM traffic GROUP BY ALL),
hp AS (SELECT *, max(m) OVER (PARTITION BY store_id) AS p FROM hr),
gr AS (SELECT e.*, d.d AS dow, h.h AS hour FROM equipment e, (SELECT unnest(range(7)) AS d) d, (SELECT unnest(range(24)) AS h) h WHERE status = 'active'),
fl AS (SELECT g.*, EXISTS (SELECT 1 FROM hp WHERE hp.store_id = g.store_id AND hp.hour = g.hour AND m < p * 0.3::DOUBLE) AS low,
       EXISTS (SELECT 1 FROM hp WHERE hp.store_id = g.store_id AND hp.hour BETWEEN g.hour AND g.hour + 2 AND m >= p * 0.8::DOUBLE) AS near,
       EXISTS (SELECT 1 FROM pk WHERE pk.store_id = g.store_id AND pk.dow = g.dow) AS pday FROM gr g),
ad AS (SELECT *, CASE WHEN equipment_type = 'hvac' AND pday AND NOT near THEN 'peak day: mild reduction only' WHEN equipment_type = 'hvac' AND NOT pday AND low THEN 'low traffic: reduce output'
       WHEN equipment_type = 'lighting' AND NOT pday AND low THEN 'low traffic: half the lighting' WHEN equipment_type = 'pos' AND (hour >= 22 OR hour < 7) THEN 'store closed: standby' END AS reason FROM fl)
SELECT store_id, id AS equipment_id, name AS equipment_name, CAST(dow AS INT) AS day_of_week, CAST(hour AS INT) AS hour, 'full' AS current_level,
       CASE WHEN equipment_type = 'pos' THEN 'standby' ELSE 'reduced' END AS recommended_level, reason,
       round(rated_power_kw * CASE reason WHEN 'peak day: mild reduction only' THEN 0.15::DOUBLE WHEN 'low traffic: reduce output' THEN 0.4::DOUBLE WHEN 'low traffic: half the lighting' THEN 0.5::DOUBLE ELSE 0.85::DOUBLE END * 1000) / 1000 AS estimated_saving_kwh
FROM ad WHERE reason IS NOT NULL""",
)
def schedule_advice(t):
    lines = t.sales("store_id", "sale_date", "total_amount", start="2000-11-04")
    outlook = forecast.sales_forecast(lines, SALES_AS_OF, 14)
    return energy.schedule_advice(t("equipment"), t("traffic"), outlook)


@query(
    "energy_cost_advice",
    f"""
WITH rd AS (SELECT * FROM energy_readings WHERE CAST(reading_time AS DATE) BETWEEN DATE '{START}' AND DATE '{END}'),
ld AS (SELECT store_id, sum(energy_kwh) AS tot, sum(CASE WHEN extract(hour FROM reading_time) BETWEEN 8 AND 22 THEN energy_kwh ELSE 0 END) AS pk FROM rd GROUP BY store_id),
dv AS (SELECT d.store_id, d.equipment_id, e.equipment_type, e.rated_power_kw, e.status, avg(avg_kw) AS kw, {M.format('total_kwh')} AS kwh FROM store_energy_daily d JOIN equipment e ON e.id = d.equipment_id WHERE {PERIOD} GROUP BY ALL),
ty AS (SELECT store_id, {M.format('kwh')} AS tot, coalesce(CAST(sum(CAST(kwh AS DECIMAL(18,4))) FILTER (equipment_type = 'hvac') AS DOUBLE), 0) AS hv FROM dv GROUP BY store_id),
ew AS (SELECT store_id, avg(m) FILTER (dow NOT IN (0, 6)) AS wd, avg(m) FILTER (dow IN (0, 6)) AS we FROM (SELECT store_id, dayofweek(energy_date) AS dow, {M.format('total_kwh')} / count(*) AS m FROM store_energy_daily WHERE {PERIOD} GROUP BY ALL) GROUP BY store_id),
sw AS (SELECT store_id, avg(m) FILTER (dow NOT IN (0, 6)) AS swd, avg(m) FILTER (dow IN (0, 6)) AS swe FROM (SELECT store_id, dayofweek(sale_date) AS dow, {M.format('total_amount')} / count(*) AS m FROM energy_sales WHERE sale_date BETWEEN DATE '{START}' AND DATE '{END}' GROUP BY ALL) GROUP BY store_id)
SELECT store_id, 'load_shifting' AS category, 'high' AS priority, CAST(NULL AS BIGINT) AS equipment_id, round(pk / tot * 10000) / 10000 AS metric_value, round(tot * 0.05::DOUBLE * 0.85::DOUBLE * 100) / 100 AS potential_saving FROM ld WHERE pk / tot > 0.6
UNION ALL SELECT store_id, 'equipment_efficiency', 'medium', equipment_id, round(kw / rated_power_kw * 10000) / 10000, round(kwh * 0.1::DOUBLE * 0.85::DOUBLE * 100) / 100 FROM dv WHERE status = 'active' AND kw > rated_power_kw * 0.9::DOUBLE
UNION ALL SELECT store_id, 'hvac_optimization', 'high', NULL, round(hv / tot * 10000) / 10000, round(hv * 0.15::DOUBLE * 0.85::DOUBLE * 100) / 100 FROM ty WHERE hv / tot > 0.5
UNION ALL SELECT ew.store_id, 'weekend_optimization', 'medium', NULL, round(we / wd * 10000) / 10000, round(greatest(0, (we - wd * 0.7::DOUBLE) * 2 * 4 * 0.85::DOUBLE) * 100) / 100 FROM ew JOIN sw ON sw.store_id = ew.store_id WHERE wd > 0 AND we / wd > 0.85 AND swd > 0 AND swe / swd < 0.7""",
)
def energy_cost_advice(t):
    return energy.energy_cost_advice(
        t("store_energy_daily"), t("energy_readings"), t("equipment"), t("energy_sales"), START, END
    )


@query(
    "budget_alerts",
    f"""
WITH u AS (SELECT store_id, {M.format('total_kwh')} AS k FROM store_energy_daily WHERE strftime(energy_date, '%Y-%m') = '2024-01' GROUP BY store_id),
j AS (SELECT b.store_id, CAST(budget_kwh AS DOUBLE) AS budget_kwh, CAST(alert_threshold_pct AS DOUBLE) AS th, coalesce(k, 0) AS k, coalesce(k, 0) * 100.0::DOUBLE / CAST(budget_kwh AS DOUBLE) AS p FROM energy_budgets b LEFT JOIN u ON u.store_id = b.store_id)
SELECT store_id, 'budget_exceeded' AS alert_type, CASE WHEN p >= 100 THEN 'critical' ELSE 'warning' END AS alert_level, k AS metric_value, CASE WHEN p >= 100 THEN budget_kwh ELSE budget_kwh * th / 100 END AS threshold_value, round(p * 10) / 10 AS usage_pct
FROM j WHERE p >= 100 OR p >= th""",
)
def budget_alerts(t):
    budgets = t("energy_budgets").select(
        "store_id", "year_month", *[F.col(c).cast("double").alias(c) for c in ("budget_kwh", "alert_threshold_pct")]
    )
    return energy.budget_alerts(t("store_energy_daily"), budgets, "2024-01")


@query("list_budgets", "SELECT store_id, year_month, CAST(budget_kwh AS DOUBLE) AS budget_kwh, CAST(alert_threshold_pct AS DOUBLE) AS alert_threshold_pct FROM energy_budgets")
def list_budgets(t):
    rows = energy.list_budgets(t("energy_budgets"), "2024-01")
    return rows.select("store_id", "year_month", *[F.col(c).cast("double").alias(c) for c in ("budget_kwh", "alert_threshold_pct")])


@query(
    "energy_history",
    """
SELECT r.id, equipment_id, equipment_code, equipment_type, CAST(floor((epoch_us(reading_time) + 500000) / 1000000) AS BIGINT) * 1000 AS ts, power_kw, energy_kwh AS delta_kwh, operational_state AS state
FROM energy_readings r JOIN equipment e ON e.id = equipment_id WHERE reading_time >= TIMESTAMP '2024-01-10' AND reading_time <= TIMESTAMP '2024-01-20' ORDER BY reading_time DESC, r.id LIMIT 500""",
)
def energy_history(t):
    return port.energy_history(t("energy_readings"), t("equipment"), start="2024-01-10 00:00:00", end="2024-01-20 00:00:00")


@query(
    "energy_cost_summary",
    """
WITH f AS (SELECT equipment_id, sum(energy_kwh) AS k, avg(power_kw) AS a, max(power_kw) AS m, count(*) AS n FROM energy_readings WHERE reading_time >= TIMESTAMP '2024-01-30 18:00:00' GROUP BY equipment_id)
SELECT e.id AS equipment_id, equipment_code, equipment_type, name AS equipment_name, round(coalesce(k, 0) * 10000) / 10000 AS total_kwh, round(coalesce(a, 0) * 100) / 100 AS avg_power_kw, round(coalesce(m, 0) * 100) / 100 AS peak_power_kw,
       coalesce(n, 0) AS sample_count, round(round(coalesce(k, 0) * 10000) / 10000 * 0.85::DOUBLE * 100) / 100 AS cost FROM equipment e LEFT JOIN f ON f.equipment_id = e.id""",
)
def energy_cost_summary(t):
    return port.energy_cost_summary(t("energy_readings"), t("equipment"), start="2024-01-30 18:00:00")


@query(
    "power_peaks",
    """
SELECT r.id, equipment_id, equipment_code, equipment_type, power_kw AS peak_power_kw, CAST(floor((epoch_us(reading_time) + 500000) / 1000000) AS BIGINT) * 1000 AS ts, operational_state AS state
FROM energy_readings r JOIN equipment e ON e.id = equipment_id ORDER BY power_kw DESC, r.id LIMIT 20""",
)
def power_peaks(t):
    return port.power_peaks(t("energy_readings"), t("equipment"))


STATE = """
st AS (SELECT container_id, coalesce(arg_max(s, ROW(event_time, event_id)) FILTER (s IS NOT NULL), 'en_route') AS status, max(event_time) FILTER (event_type = 'vessel_arrival') AS arrival_time,
       max(event_time) FILTER (event_type IN ('load', 'gate_out')) AS departure_time
       FROM (SELECT *, CASE event_type WHEN 'vessel_arrival' THEN 'arrived' WHEN 'stack' THEN 'stacked' WHEN 'retrieve' THEN 'retrieving' WHEN 'load' THEN 'departed' END AS s FROM container_events) GROUP BY container_id)"""


@query("container_state", f"WITH {STATE} SELECT * FROM st")
def container_state(t):
    return port.container_state(t("container_events"))


@query(
    "container_trace",
    "SELECT c.equipment_id, container_id, event_time, event_id, event_type, equipment_code, e.name AS equipment_name FROM container_events c LEFT JOIN equipment e ON e.id = c.equipment_id",
)
def container_trace(t):
    return port.container_trace(t("container_events"), t("equipment"))


@query(
    "container_stats",
    f"""
WITH {STATE} SELECT count(*) AS total_containers, count(*) FILTER (status = 'en_route') AS en_route, count(*) FILTER (status = 'stacked') AS stacked, count(*) FILTER (status = 'departed') AS departed,
       round(coalesce(avg((epoch_us(coalesce(departure_time, TIMESTAMP '{NOW}')) - epoch_us(arrival_time)) / 3600000000.0::DOUBLE), 0) * 10) / 10 AS avg_dwell_hours FROM st""",
)
def container_stats(t):
    return port.container_stats(port.container_state(t("container_events")), NOW)


@query(
    "search_containers",
    f"""
WITH {STATE} SELECT c.*, status, arrival_time, departure_time FROM containers c JOIN st ON st.container_id = c.container_id
WHERE bill_of_lading LIKE 'BL1%' AND vessel_name LIKE '%Vessel%' AND status = 'stacked' ORDER BY created_at DESC, c.container_id LIMIT 20""",
)
def search_containers(t):
    known = t("containers").join(port.container_state(t("container_events")), "container_id")
    return port.search_containers(known, keyword="BL1", vessel="Vessel", status="stacked")


_LOAD = "ld AS (SELECT personnel_id, count(*) AS shift_count FROM duty_schedules WHERE schedule_date >= DATE '2001-07-25' - 7 AND status NOT IN ('cancelled', 'planned') GROUP BY personnel_id)"
_SLOTS = f"""
{_LOAD},
nd AS (SELECT id AS shift_id, unnest(['crane_operator', 'truck_driver', 'planner', 'guard']) AS position, unnest([CAST(id AS INT), CAST(2 * id AS INT), 90, 1]) AS need FROM shifts),
nb AS (SELECT *, coalesce(sum(need) OVER (PARTITION BY position ORDER BY shift_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM nd),
rk AS (SELECT p.id AS personnel_id, position, row_number() OVER (PARTITION BY position ORDER BY coalesce(shift_count, 0), p.id) AS r FROM personnel p LEFT JOIN ld ON ld.personnel_id = p.id WHERE is_active)"""


@query(
    "assign_day",
    f"WITH {_SLOTS} SELECT DATE '2001-07-25' AS schedule_date, shift_id, personnel_id, nb.position FROM nb JOIN rk ON rk.position = nb.position AND r > b AND r <= b + need",
)
def assign_day(t):
    load = port.recent_load(t("duty_schedules"), "2001-07-25")
    return port.assign_day(t("personnel"), t("shifts"), load, "2001-07-25")[0]


@query(
    "roster_gaps",
    f"""
WITH {_SLOTS}, hd AS (SELECT position, max(r) AS h FROM rk GROUP BY position), x AS (SELECT nb.*, coalesce(h, 0) - b AS free FROM nb LEFT JOIN hd ON hd.position = nb.position)
SELECT DATE '2001-07-25' AS schedule_date, shift_id, position, CASE WHEN free <= 0 THEN 'no_eligible' ELSE 'understaffed' END AS constraint_type, need, CAST(greatest(free, 0) AS BIGINT) AS available FROM x WHERE free <= 0 OR free < need""",
)
def roster_gaps(t):
    load = port.recent_load(t("duty_schedules"), "2001-07-25")
    return port.assign_day(t("personnel"), t("shifts"), load, "2001-07-25")[1]


@query(
    "task_load",
    """
SELECT p.id AS personnel_id, p.name, position, count(s.id) FILTER (s.status = 'active') AS active_tasks, count(s.id) FILTER (schedule_date = DATE '2001-07-25') AS today_shifts,
       count(s.id) FILTER (schedule_date >= DATE '2001-07-25' - 7) AS week_shifts FROM personnel p LEFT JOIN duty_schedules s ON s.personnel_id = p.id WHERE is_active GROUP BY ALL""",
)
def task_load(t):
    return port.task_load(t("personnel"), t("duty_schedules"), "2001-07-25")


@query(
    "roster",
    """
SELECT s.id, personnel_id, shift_id, schedule_date, status, shift_name, p.name AS personnel_name, position FROM duty_schedules s JOIN shifts f ON f.id = shift_id JOIN personnel p ON p.id = personnel_id
WHERE schedule_date BETWEEN DATE '2001-01-01' AND DATE '2001-06-30'""",
)
def roster(t):
    return port.roster(t("duty_schedules"), t("shifts"), t("personnel"), "2001-01-01", "2001-06-30")


@query("double_booked", "SELECT schedule_date, personnel_id, count(*) AS shifts FROM duty_schedules GROUP BY ALL HAVING count(*) > 1")
def double_booked(t):
    return port.double_booked(t("duty_schedules"))


@query(
    "utilization",
    """
WITH f AS (SELECT equipment_id, count(*) FILTER (operational_state <> 'idle') AS b, count(*) FILTER (operational_state = 'idle') AS i FROM energy_readings GROUP BY equipment_id)
SELECT equipment_code, name AS equipment_name, round(b * 100.0::DOUBLE / (b + i) * 10000) / 10000 AS utilization_percent, round(b / 3600.0::DOUBLE * 1000000) / 1000000 AS operating_hours, round(i / 3600.0::DOUBLE * 1000000) / 1000000 AS idle_hours
FROM equipment e LEFT JOIN f ON f.equipment_id = e.id""",
)
def utilization(t):
    return port.utilization(t("energy_readings"), t("equipment"))


@query(
    "throughput",
    f"SELECT CAST(event_time AS DATE) AS time_bucket, count(*) AS container_count, count(*) AS teu_count FROM container_events WHERE event_type IN ('discharge', 'load') AND event_time >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY GROUP BY CAST(event_time AS DATE)",
)
def throughput(t):
    return port.throughput(t("container_events"), NOW)


@query(
    "port_dashboard",
    f"""
WITH {STATE} SELECT (SELECT count(*) FROM st WHERE status = 'stacked') AS current_containers, (SELECT count(*) FROM container_events WHERE event_type IN ('discharge', 'load', 'gate_in', 'gate_out') AND event_time >= TIMESTAMP '2024-01-30') AS today_throughput,
       round(k * 10) / 10 AS today_energy_kwh, round(k * 0.85::DOUBLE * 100) / 100 AS energy_cost, (SELECT count(*) FROM equipment WHERE status <> 'idle') AS equipment_active
FROM (SELECT sum(energy_kwh) AS k FROM energy_readings WHERE reading_time >= TIMESTAMP '2024-01-30')""",
)
def port_dashboard(t):
    return port.port_dashboard(
        port.container_state(t("container_events")), t("container_events"), t("energy_readings"), t("equipment"), "2024-01-30 00:00:00"
    )


@query(
    "yard_hourly",
    """
WITH m AS (SELECT date_trunc('hour', event_time) AS h, count(DISTINCT container_id) AS c, count(*) FILTER (event_type IN ('discharge', 'load')) AS t FROM container_events GROUP BY 1),
e AS (SELECT date_trunc('hour', reading_time) AS h, round(count(*) FILTER (operational_state <> 'idle') * 100.0::DOUBLE / count(*) * 10000) / 10000 AS u, round(sum(energy_kwh) * 1000000) / 1000000 AS k FROM energy_readings GROUP BY 1)
SELECT coalesce(m.h, e.h) AS metric_time, coalesce(c, 0) AS total_containers, coalesce(t, 0) AS throughput_teu, coalesce(u, 0) AS avg_utilization, coalesce(k, 0) AS total_energy_kwh FROM m FULL JOIN e ON e.h = m.h""",
)
def yard_hourly(t):
    return port.yard_hourly(t("container_events"), t("energy_readings"))


@query(
    "live_totals",
    """
WITH l AS (SELECT equipment_id, arg_max(power_kw, ROW(reading_time, id)) AS p, arg_max(operational_state, ROW(reading_time, id)) AS s, CAST(sum(CAST(power_kw AS DECIMAL(18,4))) AS DOUBLE) / 3600 AS c FROM energy_readings GROUP BY equipment_id)
SELECT CAST(round(sum(p)) AS BIGINT) AS total_power_kw, count(*) FILTER (s <> 'idle') AS active_count, round(sum(c) * 100) / 100 AS total_cumulative_kwh FROM l""",
)
def live_totals(t):
    return port.live_totals(t("energy_readings"))


@query(
    "trend_buffer",
    "SELECT equipment_id, id, reading_time, power_kw, row_number() OVER (PARTITION BY equipment_id ORDER BY reading_time DESC, id DESC) AS position FROM energy_readings QUALIFY row_number() OVER (PARTITION BY equipment_id ORDER BY reading_time DESC, id DESC) <= 300",
)
def trend_buffer(t):
    return port.trend_buffer(t("energy_readings"))


@query(
    "cumulative_kwh",
    "SELECT equipment_id, id, reading_time, round(CAST(sum(CAST(power_kw AS DECIMAL(18,4))) OVER (PARTITION BY equipment_id ORDER BY reading_time, id) AS DOUBLE) / 3600 * 1000000) / 1000000 AS cumulative_kwh FROM energy_readings",
)
def cumulative_kwh(t):
    return port.cumulative_kwh(t("energy_readings"))


@query(
    "sequence_gaps",
    """
WITH k AS (SELECT event_id % 5 AS source_id, event_id // 5 AS seq, ts AS received_at FROM events WHERE event_id % 13 <> 0),
l AS (SELECT *, lag(seq) OVER (PARTITION BY source_id ORDER BY received_at, seq) AS previous_seq FROM k)
SELECT source_id, seq, previous_seq, seq - previous_seq - 1 AS dropped, received_at FROM l WHERE previous_seq > 0 AND seq - previous_seq - 1 > 0""",
)
def sequence_gaps(t):
    ticks = t("events").where(F.col("event_id") % 13 != 0).select(
        (F.col("event_id") % 5).alias("source_id"), F.floor(F.col("event_id") / 5).alias("seq"), F.col("ts").alias("received_at")
    )
    return port.sequence_gaps(ticks)
