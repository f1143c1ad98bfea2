"""Forecast, demand and data-quality queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from aisle.operators import demand, forecast, quality
from aisle.plans.registry import query
from aisle.session import checkpoint_root, deal

AS_OF = "2001-11-04"
START = "2000-11-04"
PERIODS = 30

_KEYS = ", ".join(f"'{k}'" for k in forecast.holiday_keys())


def _flag(d: str) -> str:
    is_holiday = lambda x: f"strftime({x}, '%m-%d') IN ({_KEYS})"
    return f"(CASE WHEN {is_holiday(d)} THEN 1.0::DOUBLE WHEN {is_holiday(d + ' + 1')} OR {is_holiday(d + ' - 1')} THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END)"


SERIES = f"""
s0 AS (SELECT store_id, sale_date, CAST(sum(CAST(total_amount AS DECIMAL(18,4))) AS DOUBLE) AS value FROM sales WHERE sale_date >= DATE '{AS_OF}' - 365 GROUP BY ALL),
s1 AS (SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY sale_date) - 1 AS i, count(*) OVER (PARTITION BY store_id) AS n FROM s0),
ser AS (SELECT * FROM s1 WHERE n >= 14)"""


def _decomposed(source: str, p: str = "") -> str:
    """CTEs ending in ``{p}parts`` and ``{p}fit``."""
    smooth = """(sum({t}) OVER (PARTITION BY store_id ORDER BY sale_date ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)
       + greatest(0, 3 - i) * first_value({t}) OVER w + greatest(0, 3 - (n - 1 - i)) * last_value({t}) OVER w) / 7"""
    steps = []
    previous = f"(SELECT *, value AS t FROM {source})"
    for k in range(3):
        name = f"{p}t{k}"
        steps.append(
            f"{name} AS (SELECT * EXCLUDE (t), {smooth.format(t='t')} AS t FROM {previous} WINDOW w AS (PARTITION BY store_id ORDER BY sale_date ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"
        )
        previous = name
    return ",\n".join(steps) + f""",
{p}ph AS (SELECT store_id, i % 7 AS ph, avg(value - t) AS m FROM {p}t2 GROUP BY ALL),
{p}ce AS (SELECT store_id, avg(m) AS c FROM {p}ph GROUP BY store_id),
{p}cy AS (SELECT ph.store_id, ph, m - c AS s FROM {p}ph ph JOIN {p}ce ce ON ce.store_id = ph.store_id),
{p}parts AS (SELECT t.*, s AS seasonal, value - t - s AS residual FROM {p}t2 t JOIN {p}cy cy ON cy.store_id = t.store_id AND cy.ph = t.i % 7),
{p}fit AS (SELECT store_id, max(n) AS n, max(sale_date) AS last_date, max(t) FILTER (n - i <= 1) AS level, regr_slope(t, i) FILTER (n - i <= 14) AS slope, avg(residual) FILTER (n - i <= 14) AS rm,
       stddev_pop(residual) FILTER (n - i <= 30) AS rs, {_effect()} AS he FROM {p}parts GROUP BY store_id)"""


def _effect() -> str:
    flag = _flag("sale_date")
    full, normal = f"avg(value) FILTER ({flag} > 0.5)", f"avg(value) FILTER ({flag} = 0)"
    return f"""CASE WHEN count(*) FILTER ({flag} > 0.5) < 3 OR count(*) FILTER ({flag} = 0) < 7 THEN 0.25::DOUBLE
            WHEN {normal} > 0 THEN greatest(({full} - {normal}) / {normal}, 0) ELSE 0.25::DOUBLE END"""


def _grid(p: str, periods: int) -> str:
    return f"""{p}grid AS (SELECT f.*, step, level + slope * (1 - pow(0.95::DOUBLE, step)) / (1 - 0.95::DOUBLE) + s + rm AS base
       FROM (SELECT *, unnest(range(1, {periods + 1})) AS step FROM {p}fit) f JOIN {p}cy cy ON cy.store_id = f.store_id AND cy.ph = (n + step - 1) % 7)"""


FITTED = f"{SERIES},\n{_decomposed('ser')},\n{_grid('', PERIODS)}"
_DATED = f"""
d0 AS (SELECT *, last_date + CAST(step AS INTEGER) AS date FROM grid),
d1 AS (SELECT *, {_flag('date')} AS flag FROM d0),
d2 AS (SELECT *, base * CASE WHEN flag > 0 THEN 1 + he * flag ELSE 1 END AS v FROM d1)"""
PLAIN = f"{FITTED},{_DATED}"


def _final(source: str) -> str:
    margin = "rs * 1.96::DOUBLE * sqrt(1 + step * 0.08::DOUBLE)"
    return f"""SELECT store_id, CAST(step AS INTEGER) AS step, date, round(greatest(v, 0) * 100) / 100 AS forecast, round(greatest(greatest(v, 0) - {margin}, 0) * 100) / 100 AS lower,
       round((greatest(v, 0) + {margin}) * 100) / 100 AS upper, flag > 0 AS is_holiday FROM {source}"""


LIFT = """
dl AS (SELECT store_id, sale_date, CAST(sum(CAST(total_amount AS DECIMAL(18,4))) AS DOUBLE) AS v FROM sales GROUP BY ALL),
pp AS (SELECT p.id, p.store_id, promo_type, end_date, (SELECT avg(v) FROM dl WHERE dl.store_id = p.store_id AND sale_date BETWEEN p.start_date AND p.end_date) AS pa,
       (SELECT avg(v) FROM dl WHERE dl.store_id = p.store_id AND sale_date BETWEEN p.start_date - 14 AND p.start_date - 1) AS ba FROM promotions p WHERE status = 'completed'),
lf AS (SELECT store_id, promo_type, round(avg(greatest((pa - ba) / ba, 0)) * 1000) / 1000 AS lift
       FROM (SELECT * FROM pp WHERE pa IS NOT NULL QUALIFY row_number() OVER (PARTITION BY store_id ORDER BY end_date DESC, id DESC) <= 10) WHERE ba > 0 AND pa <> 0 GROUP BY ALL)"""
FACTORS = f"""
{LIFT},
pd AS (SELECT p.store_id, CAST(unnest(generate_series(start_date, end_date, INTERVAL 1 DAY)) AS DATE) AS date, start_date, end_date,
       coalesce(lift, CASE WHEN discount_rate > 0 THEN least(CAST(discount_rate AS DOUBLE) * 0.8::DOUBLE, 0.6::DOUBLE) WHEN discount_amount > 0 THEN 0.15::DOUBLE ELSE 0.10::DOUBLE END) AS lift
       FROM promotions p LEFT JOIN lf ON lf.store_id = p.store_id AND lf.promo_type = p.promo_type WHERE status = 'active' AND end_date >= DATE '{AS_OF}'),
pf AS (SELECT store_id, date, product(1 + lift * greatest(1 - 0.3::DOUBLE * (CAST(date - start_date AS DOUBLE) / greatest(end_date - start_date + 1, 1)), 0.5::DOUBLE)) AS pf FROM pd GROUP BY ALL),
wf AS (SELECT st.id AS store_id, weather_date AS date, CASE WHEN precipitation > 30 THEN 0.80::DOUBLE WHEN precipitation > 15 THEN 0.88::DOUBLE WHEN precipitation > 5 THEN 0.94::DOUBLE ELSE 1.0::DOUBLE END
       * CASE WHEN coalesce(nullif(temp_high, 0), 25) > 38 OR coalesce(nullif(temp_high, 0), 25) < -5 THEN 0.90::DOUBLE ELSE 1.0::DOUBLE END AS wf
       FROM weather w JOIN stores st ON st.city = w.city WHERE weather_date > DATE '{AS_OF}' AND weather_date <= DATE '{AS_OF}' + 365)"""


def _lines(t):
    return t.sales("store_id", "sale_date", "total_amount")


def _year(t):
    return t.sales("store_id", "sale_date", "total_amount", start=START)


@query("holiday_effect", f"WITH {SERIES} SELECT store_id, round({_effect()} * 1000000) / 1000000 AS holiday_effect FROM ser GROUP BY store_id")
def holiday_effect(t):
    series = forecast.daily_series(_year(t), AS_OF)
    effect = forecast.holiday_effect(F.col("value"), F.col("sale_date"))
    return series.groupBy("store_id").agg((F.round(effect * 1e6) / 1e6).alias("holiday_effect"))


@query(
    "decompose",
    f"WITH {SERIES}, {_decomposed('ser')} SELECT store_id, sale_date, round(t * 100) / 100 AS trend, round(seasonal * 100) / 100 AS seasonal, round(residual * 100) / 100 AS residual FROM parts",
)
def decompose(t):
    parts = forecast.decompose(forecast.daily_series(_year(t), AS_OF))
    return parts.select(
        "store_id", "sale_date", *[(F.round(F.col(c) * 100) / 100).alias(c) for c in ("trend", "seasonal", "residual")]
    )


@query("sales_forecast", f"WITH {PLAIN} {_final('d2')}")
def sales_forecast(t):
    return forecast.sales_forecast(_year(t), AS_OF, PERIODS)


@query("promo_lift", f"WITH {LIFT} SELECT * FROM lf")
def promo_lift(t):
    # Few lines share a store and day.
    daily = deal(_lines(t), "store_id", "sale_date").groupBy("store_id", "sale_date").agg(
        F.sum(F.col("total_amount").cast("decimal(18,4)")).cast("double").alias("value"), F.count(F.lit(1)).alias("lines")
    )
    return forecast.promo_lift(daily, t("promotions"))


@query(
    "weather_adjusted_forecast",
    f"""
WITH {PLAIN}, {FACTORS},
d3 AS (SELECT d2.* EXCLUDE (v), v * coalesce(pf, 1) * coalesce(wf, 1) AS v FROM d2 LEFT JOIN pf ON pf.store_id = d2.store_id AND pf.date = d2.date LEFT JOIN wf ON wf.store_id = d2.store_id AND wf.date = d2.date)
{_final('d3')}""",
)
def weather_adjusted_forecast(t):
    return forecast.sales_forecast(
        _lines(t), AS_OF, PERIODS, promotions=t("promotions"), weather=t("weather"), stores=t.stores
    )


@query(
    "backtest",
    f"""
WITH {SERIES}, tr AS (SELECT * REPLACE (n - 7 AS n) FROM ser WHERE n >= 28 AND i < n - 7),
{_decomposed('tr', 'b_')}, {_grid('b_', 7)},
te AS (SELECT store_id, sale_date, value AS actual, i - n + 8 AS step, {_flag('sale_date')} AS flag FROM ser WHERE n >= 28 AND i >= n - 7),
e AS (SELECT te.store_id, actual, abs(greatest(base * CASE WHEN flag > 0 THEN 1 + he * flag ELSE 1 END, 0) - actual) AS err FROM te JOIN b_grid g ON g.store_id = te.store_id AND g.step = te.step)
SELECT store_id, round(avg(err / CASE WHEN actual > 0 THEN actual ELSE 1 END) * 100 * 100) / 100 AS mape, round(sqrt(avg(err * err)) * 100) / 100 AS rmse FROM e GROUP BY store_id""",
)
def backtest(t):
    return forecast.backtest(forecast.daily_series(_year(t), AS_OF))


FACTOR = """CASE signal_type WHEN 'competitor_price' THEN CASE WHEN value > 1.1::DOUBLE THEN 1 + least(0.10::DOUBLE, (value - 1) * 0.1::DOUBLE) * confidence
     WHEN value < 0.9::DOUBLE THEN 1 - least(0.10::DOUBLE, (1 - value) * 0.1::DOUBLE) * confidence ELSE 1 END
     WHEN 'market_trend' THEN 1 + (value - 1) * 0.3::DOUBLE * confidence WHEN 'sentiment' THEN 1 + value * 0.08::DOUBLE * confidence ELSE 1 END"""


def _external(where: str) -> str:
    return f"SELECT signal_date AS date, greatest(0.5::DOUBLE, least(1.5::DOUBLE, product({FACTOR}))) AS external_factor FROM market_signals {where} GROUP BY signal_date"


@query("external_factor", f"WITH x AS ({_external('')}) SELECT date, round(external_factor * 1000000) / 1000000 AS external_factor FROM x")
def external_factor(t):
    factors = demand.external_factor(t("market_signals"))
    return factors.withColumn("external_factor", F.round(F.col("external_factor") * 1e6) / 1e6)


BASE = f"""
q0 AS (SELECT store_id, sale_date, CAST(sum(CAST(total_amount AS DECIMAL(18,4))) AS DOUBLE) AS v FROM shop_sales WHERE sale_date >= DATE '{AS_OF}' - 90 GROUP BY ALL),
q1 AS (SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY sale_date DESC) AS r FROM q0),
q2 AS (SELECT store_id, avg(v) FILTER (r <= 30) AS m, stddev_pop(v) FILTER (r <= 30) AS sd, CASE WHEN count(*) >= 14 THEN avg(v) FILTER (r <= 7) - avg(v) FILTER (r BETWEEN 8 AND 14) ELSE 0 END AS tr FROM q1 GROUP BY store_id),
q3 AS (SELECT *, unnest(range(1, 31)) AS step FROM q2),
q4 AS (SELECT *, greatest(0, m + tr * step * 0.1::DOUBLE) AS f, sd * 1.96::DOUBLE * sqrt(1 + (step - 1) * 0.05::DOUBLE) AS mg FROM q3),
bl AS (SELECT store_id, DATE '{AS_OF}' + CAST(step AS INTEGER) AS date, round(f * 100) / 100 AS forecast, round(greatest(0, f - mg) * 100) / 100 AS lower, round((f + mg) * 100) / 100 AS upper FROM q4)"""
ENHANCED = f"""
{BASE}, x AS ({_external(f"WHERE signal_date BETWEEN DATE '{AS_OF}' AND DATE '{AS_OF}' + 30")}),
e0 AS (SELECT bl.*, coalesce(CAST(weight_internal AS DOUBLE), 0.7::DOUBLE) AS wi, coalesce(CAST(weight_external AS DOUBLE), 0.3::DOUBLE) AS we, coalesce(external_factor, 1) AS xf
       FROM bl LEFT JOIN forecast_configs c ON c.store_id = bl.store_id LEFT JOIN x ON x.date = bl.date),
e1 AS (SELECT *, wi * forecast + we * (forecast * xf) AS v, (upper - forecast) * (1 + we * 0.15::DOUBLE) AS mg FROM e0),
en AS (SELECT store_id, date, round(v * 100) / 100 AS forecast, round(greatest(0, v - mg) * 100) / 100 AS lower, round((v + mg) * 100) / 100 AS upper, round(xf * 10000) / 10000 AS external_factor FROM e1)"""


def _baseline(t):
    return demand.baseline_forecast(t("shop_sales"), AS_OF, PERIODS)


def _enhanced(t):
    return demand.enhanced_forecast(_baseline(t), t("market_signals"), t("forecast_configs"), AS_OF, PERIODS)


@query("baseline_forecast", f"WITH {BASE} SELECT * FROM bl")
def baseline_forecast(t):
    return _baseline(t)


@query("enhanced_forecast", f"WITH {ENHANCED} SELECT * FROM en")
def enhanced_forecast(t):
    return _enhanced(t)


@query(
    "forecast_comparison",
    f"WITH {ENHANCED} SELECT bl.store_id, bl.date, bl.forecast AS baseline_forecast, bl.lower AS baseline_lower, bl.upper AS baseline_upper, en.forecast AS enhanced_forecast, en.lower AS enhanced_lower, en.upper AS enhanced_upper FROM bl JOIN en ON en.store_id = bl.store_id AND en.date = bl.date",
)
def forecast_comparison(t):
    return demand.forecast_comparison(_baseline(t), _enhanced(t))


@query(
    "signals_used",
    f"WITH x AS ({_external(f"WHERE signal_date BETWEEN DATE '{AS_OF}' AND DATE '{AS_OF}' + 30")}) SELECT DISTINCT signal_type FROM market_signals WHERE signal_date BETWEEN DATE '{AS_OF}' AND DATE '{AS_OF}' + 30 AND EXISTS (SELECT 1 FROM x WHERE external_factor <> 1)",
)
def signals_used(t):
    return demand.signals_used(t("market_signals"), AS_OF, PERIODS)


TUNED = f"""
a AS (SELECT store_id, sale_date, CAST(sum(CAST(total_amount AS DECIMAL(18,4))) AS DOUBLE) AS v FROM shop_sales WHERE sale_date BETWEEN DATE '{AS_OF}' - 30 AND DATE '{AS_OF}' GROUP BY ALL),
b AS (SELECT *, count(*) OVER (PARTITION BY store_id) AS n, CAST(sum(CAST(v AS DECIMAL(18,4))) OVER (PARTITION BY store_id) AS DOUBLE) / count(*) OVER (PARTITION BY store_id) AS m FROM a),
x AS ({_external(f"WHERE signal_date BETWEEN DATE '{AS_OF}' - 30 AND DATE '{AS_OF}'")}),
c AS (SELECT b.*, coalesce(CAST(weight_internal AS DOUBLE), 0.7::DOUBLE) AS wi, coalesce(CAST(weight_external AS DOUBLE), 0.3::DOUBLE) AS we, coalesce(external_factor, 1) AS xf
      FROM b LEFT JOIN forecast_configs f ON f.store_id = b.store_id LEFT JOIN x ON x.date = sale_date WHERE n >= 14),
d AS (SELECT store_id, avg(abs(v - m) / greatest(v, 1)) * 100 AS bm, avg(abs(v - (wi * m + we * m * xf)) / greatest(v, 1)) * 100 AS em, max(we) AS we, count(*) AS n FROM c GROUP BY store_id),
tn AS (SELECT store_id, round(bm * 100) / 100 AS baseline_mape, round(em * 100) / 100 AS enhanced_mape, we AS weight_external_before,
      CASE WHEN em < bm - 2 THEN least(0.5::DOUBLE, we + 0.05::DOUBLE) WHEN em > bm THEN greatest(0.1::DOUBLE, we - 0.05::DOUBLE) ELSE we END AS weight_external_after, n AS sample_size FROM d)"""


@query("tune_weights", f"WITH {TUNED} SELECT * FROM tn")
def tune_weights(t):
    return demand.tune_weights(t("shop_sales"), t("market_signals"), t("forecast_configs"), AS_OF)


@query(
    "accuracy_history",
    f"""
WITH {TUNED} SELECT store_id, 'baseline' AS model_name, DATE '{AS_OF}' AS evaluation_date, 30 AS forecast_horizon, baseline_mape AS mape, CAST(0 AS DOUBLE) AS rmse, sample_size FROM tn
UNION ALL SELECT store_id, 'enhanced', DATE '{AS_OF}', 30, enhanced_mape, 0, sample_size FROM tn""",
)
def accuracy_history(t):
    return demand.accuracy_history(demand.accuracy_rows(tune_weights(t), AS_OF), AS_OF)


@query(
    "tuned_configs",
    f"""
WITH {TUNED}, ch AS (SELECT * FROM tn WHERE weight_external_after <> weight_external_before)
SELECT coalesce(c.store_id, ch.store_id) AS store_id, 'ensemble' AS model_name, CASE WHEN ch.store_id IS NULL THEN CAST(weight_internal AS DOUBLE) ELSE 1 - weight_external_after END AS weight_internal,
       CASE WHEN ch.store_id IS NULL THEN CAST(weight_external AS DOUBLE) ELSE weight_external_after END AS weight_external
FROM forecast_configs c FULL JOIN ch ON ch.store_id = c.store_id""",
)
def tuned_configs(t):
    configs = t("forecast_configs").select(
        "store_id", "model_name", *[F.col(c).cast("double").alias(c) for c in ("weight_internal", "weight_external")]
    )
    return demand.tuned_configs(configs, tune_weights(t))


@query("list_signals", "SELECT * FROM market_signals WHERE region = 'R1' AND signal_date >= DATE '2001-10-20' ORDER BY signal_date DESC, id LIMIT 100")
def list_signals(t):
    return demand.list_signals(t("market_signals"), region="R1", start="2001-10-20")


_TARGET_COLUMNS = {
    "sales": ["item_name", "category", "unit_price", "total_amount", "member_id"],
    "inventory": ["item_name", "category", "quantity", "min_stock", "max_stock"],
    "traffic": ["enter_count"],
}
CHECK_DAY = "2001-11-10"


def _targets(t):
    sales = t.sales("sale_date", "quantity", *_TARGET_COLUMNS["sales"])
    return [
        quality.Target("sales", sales, "sale_date", _TARGET_COLUMNS["sales"], quality.default_rules("sales")),
        quality.Target("inventory", t("inventory"), "snapshot_date", _TARGET_COLUMNS["inventory"], quality.default_rules("inventory")),
        quality.Target("traffic", t("store_traffic"), "traffic_date", _TARGET_COLUMNS["traffic"], quality.default_rules("traffic")),
    ]


def _documents(t):
    rows = t("quality_target").withColumn("seen", F.lit("2024-01-01").cast("date"))
    return quality.Target("documents", rows, "seen", ["lang", "source", "quality", "toxic"], {"short": F.col("n_chars") < 100, "toxic": F.col("toxic") == 1})


@query(
    "completeness",
    """
WITH f AS (SELECT count(*) AS n, count(*) FILTER (lang IS NULL) + count(*) FILTER (source IS NULL) + count(*) FILTER (quality IS NULL) + count(*) FILTER (toxic IS NULL) AS k FROM quality_target)
SELECT 'documents' AS target_table, 'completeness' AS dimension, round((1 - CAST(k AS DOUBLE) / (n * 4)) * 100 * 100) / 100 AS score, n AS total_records, k AS failed_records, DATE '2024-02-01' AS score_date FROM f""",
)
def completeness(t):
    return quality.completeness(_documents(t), "2024-02-01")


@query(
    "completeness_columns",
    """
WITH f AS (SELECT count(*) AS n, count(*) FILTER (quality IS NULL) AS q, count(*) FILTER (toxic IS NULL) AS x FROM quality_target)
SELECT 'documents' AS target_table, 'quality' AS column_name, q AS null_count, round(CAST(q AS DOUBLE) / n * 10000) / 10000 AS null_rate FROM f
UNION ALL SELECT 'documents', 'toxic', x, round(CAST(x AS DOUBLE) / n * 10000) / 10000 FROM f""",
)
def completeness_columns(t):
    return quality.completeness_columns(_documents(t), "2024-02-01")


@query(
    "accuracy",
    """
WITH f AS (SELECT count(*) AS n, count(*) FILTER (n_chars < 100) AS a, count(*) FILTER (toxic = 1) AS b FROM quality_target)
SELECT 'documents' AS target_table, 'accuracy' AS dimension, round((1 - CAST(a + b AS DOUBLE) / n) * 100 * 100) / 100 AS score, n AS total_records, a + b AS failed_records, DATE '2024-02-01' AS score_date FROM f""",
)
def accuracy(t):
    return quality.accuracy(_documents(t), "2024-02-01")


@query(
    "accuracy_rules",
    """
WITH f AS (SELECT count(*) AS n, count(*) FILTER (n_chars < 100) AS a, count(*) FILTER (toxic = 1) AS b FROM quality_target)
SELECT * FROM (SELECT 'documents' AS target_table, 'short' AS rule, a AS violations, round(CAST(a AS DOUBLE) / n * 10000) / 10000 AS rate FROM f
UNION ALL SELECT 'documents', 'toxic', b, round(CAST(b AS DOUBLE) / n * 10000) / 10000 FROM f) WHERE violations > 0""",
)
def accuracy_rules(t):
    return quality.accuracy_rules(_documents(t), "2024-02-01")


@query(
    "timeliness",
    f"""
SELECT 'sales' AS target_table, 'timeliness' AS dimension, CAST(CASE WHEN DATE '{CHECK_DAY}' - max(sale_date) <= 2 THEN 100 ELSE greatest(0, 100 - (DATE '{CHECK_DAY}' - max(sale_date) - 2) * 15) END AS DOUBLE) AS score,
       CAST(1 AS BIGINT) AS total_records, CAST(CASE WHEN DATE '{CHECK_DAY}' - max(sale_date) > 2 THEN 1 ELSE 0 END AS BIGINT) AS failed_records, DATE '{CHECK_DAY}' AS score_date FROM sales""",
)
def timeliness(t):
    return quality.timeliness(_targets(t)[0], CHECK_DAY)


def _scores_sql() -> str:
    parts = []
    rules = {
        "sales": ["total_amount < 0", "quantity <= 0", "unit_price > 100000"],
        "inventory": ["quantity < 0", "min_stock > max_stock"],
        "traffic": ["enter_count < 0", "enter_count > 100000"],
    }
    for name, view, day in (("sales", "sales", "sale_date"), ("inventory", "inventory", "snapshot_date"), ("traffic", "store_traffic", "traffic_date")):
        columns = _TARGET_COLUMNS[name]
        k = " + ".join(f"count(*) FILTER ({c} IS NULL)" for c in columns)
        r = " + ".join(f"count(*) FILTER ({c})" for c in rules[name])
        age = f"(DATE '{CHECK_DAY}' - max({day}))"
        parts += [
            f"SELECT '{name}' AS target_table, 'completeness' AS dimension, round((1 - CAST({k} AS DOUBLE) / (count(*) * {len(columns)})) * 100 * 100) / 100 AS score, count(*) AS total_records, {k} AS failed_records, DATE '{CHECK_DAY}' AS score_date FROM {view}",
            f"SELECT '{name}', 'accuracy', round((1 - CAST({r} AS DOUBLE) / count(*)) * 100 * 100) / 100, count(*), {r}, DATE '{CHECK_DAY}' FROM {view}",
            f"SELECT '{name}', 'timeliness', CAST(CASE WHEN {age} <= 2 THEN 100 ELSE greatest(0, 100 - ({age} - 2) * 15) END AS DOUBLE), 1, CASE WHEN {age} > 2 THEN 1 ELSE 0 END, DATE '{CHECK_DAY}' FROM {view}",
        ]
    return "qs AS (" + " UNION ALL ".join(parts) + ")"


@query("quality_scores", f"WITH {_scores_sql()} SELECT * FROM qs")
def quality_scores(t):
    return quality.quality_scores(_targets(t), CHECK_DAY)


@query(
    "health",
    f"""
WITH {_scores_sql()}, m AS (SELECT avg(score) FILTER (dimension = 'completeness') AS c, avg(score) FILTER (dimension = 'accuracy') AS a, avg(score) FILTER (dimension = 'timeliness') AS t FROM qs)
SELECT round((c * 0.35::DOUBLE + a * 0.40::DOUBLE + t * 0.25::DOUBLE) * 100) / 100 AS overall_score, round(c * 100) / 100 AS completeness_score, round(a * 100) / 100 AS accuracy_score, round(t * 100) / 100 AS timeliness_score FROM m""",
)
def health(t):
    return quality.health(quality_scores(t))


_ALERTS = """open_alerts AS (SELECT * FROM (VALUES ('sales', 'timeliness', 'open', TIMESTAMP '2001-11-09 20:00:00'), ('inventory', 'timeliness', 'closed', TIMESTAMP '2001-11-09 20:00:00')) v(target_table, dimension, status, created_at))"""


@query(
    "quality_alerts",
    f"""
WITH {_scores_sql()}, {_ALERTS}
SELECT target_table, dimension, CASE WHEN CAST(failed_records AS DOUBLE) / total_records > 0.3 THEN 'critical' ELSE 'error' END AS severity, round(CAST(failed_records AS DOUBLE) / total_records * 10000) / 10000 AS metric_value,
       CAST(0.15 AS DOUBLE) AS threshold_value, 'open' AS status FROM qs q WHERE CAST(failed_records AS DOUBLE) / total_records > 0.15
       AND NOT EXISTS (SELECT 1 FROM open_alerts o WHERE o.target_table = q.target_table AND o.dimension = q.dimension AND o.status = 'open' AND o.created_at > TIMESTAMP '2001-11-10 12:00:00' - INTERVAL 24 HOUR)""",
)
def quality_alerts(t):
    alerts = t.spark.sql(
        """SELECT * FROM VALUES ('sales', 'timeliness', 'open', TIMESTAMP '2001-11-09 20:00:00'),
           ('inventory', 'timeliness', 'closed', TIMESTAMP '2001-11-09 20:00:00') AS v(target_table, dimension, status, created_at)"""
    )
    return quality.new_alerts(quality_scores(t), alerts, "2001-11-10 12:00:00").drop("created_at")


@query(
    "score_trend",
    """
WITH s AS (SELECT lang AS target_table, source AS dimension, DATE '2024-01-01' + CAST(doc_id % 28 AS INTEGER) AS score_date, CAST(n_chars % 101 AS DOUBLE) AS score FROM quality_target)
SELECT score_date, dimension, round(avg(score) * 100) / 100 AS avg_score FROM s WHERE score_date >= DATE '2024-01-28' - 20 GROUP BY ALL""",
)
def score_trend(t):
    scores = t("quality_target").select(
        F.col("lang").alias("target_table"), F.col("source").alias("dimension"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 28).cast("int")).alias("score_date"),
        (F.col("n_chars") % 101).cast("double").alias("score"),
    )
    return quality.score_trend(scores, "2024-01-28", days=20)


@query(
    "run_checks",
    f"""
WITH {_scores_sql()}, f AS (SELECT count(*) AS rules_checked, round(avg(score) * 100) / 100 AS overall_score, count(*) FILTER (CAST(failed_records AS DOUBLE) / greatest(total_records, 1) > 0.15) AS n FROM qs)
SELECT TIMESTAMP '2001-11-10 12:00:00' AS started_at, 'completed' AS status, rules_checked, overall_score, n AS alerts_generated, (SELECT count(*) FROM qs) AS stored_scores FROM f
UNION ALL SELECT TIMESTAMP '2001-11-10 18:00:00', 'completed', rules_checked, overall_score, 0, (SELECT count(*) FROM qs) FROM f""",
)
def run_checks(t):
    """Two runs on one day: the second stores its scores over the first's and finds its alerts open."""
    root = f"{checkpoint_root(t.spark)}/checks-{uuid.uuid4().hex}"
    for hour in (12, 18):
        quality.run_checks(_targets(t), root, f"{CHECK_DAY} {hour}:00:00")
    stored = t.spark.read.parquet(f"{root}/scores").agg(F.count(F.lit(1)).alias("stored_scores"))
    return t.spark.read.parquet(f"{root}/runs").join(F.broadcast(stored))


@query(
    "weather_forecast_by_position",
    f"""
WITH {PLAIN}, {FACTORS.replace("wf AS (SELECT st.id AS store_id, weather_date AS date,", "wf AS (SELECT st.id AS store_id, row_number() OVER (PARTITION BY st.id ORDER BY weather_date) AS step,")},
d3 AS (SELECT d2.* EXCLUDE (v), v * coalesce(pf, 1) * coalesce(wf, 1) AS v FROM d2 LEFT JOIN pf ON pf.store_id = d2.store_id AND pf.date = d2.date LEFT JOIN wf ON wf.store_id = d2.store_id AND wf.step = d2.step)
{_final('d3')}""",
)
def weather_forecast_by_position(t):
    """The n-th weather row after today on the n-th forecast day, whatever their dates."""
    return forecast.sales_forecast(
        _lines(t), AS_OF, PERIODS, promotions=t("promotions"), weather=t("weather"), stores=t.stores, positional_weather=True
    )
