"""Omnichannel and member marketing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from aisle.operators import marketing, omnichannel
from aisle.plans.registry import query
from aisle.session import cut_lineage

START, END = "1999-01-01", "1999-12-31"
AS_OF = "2001-08-01"
NOW = "2001-08-01 12:00:00"
CHANNEL_COLUMNS = ("sale_date", "channel", "receipt_no", "member_id", "total_amount", "store_id")


def _money(c):
    return f"CAST(sum(CAST({c} AS DECIMAL(18,4))) AS DOUBLE)"


@query(
    "channel_kpis",
    f"""
WITH c AS (SELECT channel, {_money('total_amount')} AS g, count(DISTINCT receipt_no) AS o, count(DISTINCT member_id) AS m
           FROM sales WHERE sale_date BETWEEN DATE '{START}' AND DATE '{END}' GROUP BY channel),
p AS (SELECT channel, {_money('total_amount')} AS g FROM sales WHERE sale_date BETWEEN DATE '1998-01-01' AND DATE '1998-12-31' GROUP BY channel)
SELECT c.channel, round(c.g * 100) / 100 AS gmv, c.o AS order_count, round(c.g / c.o * 100) / 100 AS avg_ticket, c.m AS member_count,
       CASE WHEN p.g > 0 THEN round((c.g - p.g) / p.g * 100 * 100) / 100 END AS growth_rate_pct,
       (SELECT round({_money('g')} * 100) / 100 FROM c) AS total_gmv, (SELECT CAST(sum(o) AS BIGINT) FROM c) AS total_orders
FROM c LEFT JOIN p ON p.channel = c.channel""",
)
def channel_kpis(t):
    lines = t.sales(*CHANNEL_COLUMNS, start="1998-01-01", end=END)
    return omnichannel.channel_kpis(lines, START, END)


def _trend_sql(bucket: str) -> str:
    return f"""
SELECT {bucket} AS period_date, channel, round({_money('total_amount')} * 100) / 100 AS gmv, count(DISTINCT receipt_no) AS order_count
FROM sales WHERE sale_date BETWEEN DATE '1995-01-01' AND DATE '2001-12-31' GROUP BY {bucket}, channel"""


@query("channel_trends", _trend_sql("CAST(date_trunc('week', sale_date) AS DATE)"))
def channel_trends(t):
    return omnichannel.channel_trends(t.sales(*CHANNEL_COLUMNS[:3], "total_amount"), "1995-01-01", "2001-12-31", "weekly")


@query("channel_trends_monthly", _trend_sql("CAST(date_trunc('month', sale_date) AS DATE)"))
def channel_trends_monthly(t):
    return omnichannel.channel_trends(t.sales(*CHANNEL_COLUMNS[:3], "total_amount"), "1995-01-01", "2001-12-31", "monthly")


_ATTRIBUTION = f"""
WITH conv AS (
  SELECT receipt_no, {_money('total_amount')} AS amount, min(ROW(sale_date, channel, member_id)) AS f
  FROM sales WHERE sale_date BETWEEN DATE '{START}' AND DATE '{END}' GROUP BY receipt_no),
cv AS (SELECT receipt_no, amount, f[1] AS sale_date, f[2] AS own, f[3] AS member_id FROM conv),
touch AS (SELECT cv.receipt_no, e.channel, e.event_date, e.id,
                 epoch_us(CAST(cv.sale_date + 1 AS TIMESTAMP)) - epoch_us(e.event_date) AS us
          FROM cv JOIN channel_member_events e ON e.member_id = cv.member_id AND CAST(e.event_date AS DATE) <= cv.sale_date),
share AS ({{share}}),
credit AS (SELECT coalesce(s.channel, cv.own) AS channel, cv.amount * coalesce(s.w, 1.0) AS g, coalesce(s.w, 1.0) AS o
           FROM cv LEFT JOIN share s ON s.receipt_no = cv.receipt_no),
r AS (SELECT channel, sum(g) AS g, sum(o) AS o FROM credit GROUP BY channel)
SELECT channel, round(g * 100) / 100 AS attributed_gmv, CAST(round(round(o * 1000000) / 1000000) AS BIGINT) AS attributed_orders,
       round(g / (SELECT sum(g) FROM r) * 10000) / 10000 AS weight FROM r"""
_SHARES = {
    "last_touch": "SELECT receipt_no, arg_max(channel, ROW(event_date, id)) AS channel, CAST(1 AS DOUBLE) AS w FROM touch GROUP BY receipt_no",
    "first_touch": "SELECT receipt_no, arg_min(channel, ROW(event_date, id)) AS channel, CAST(1 AS DOUBLE) AS w FROM touch GROUP BY receipt_no",
    "linear": "SELECT DISTINCT receipt_no, channel, 1.0 / (SELECT count(DISTINCT channel) FROM touch u WHERE u.receipt_no = touch.receipt_no) AS w FROM touch",
    "time_decay": "SELECT receipt_no, channel, sum(pow(2, -us / 86400000000.0 / 7)) / sum(sum(pow(2, -us / 86400000000.0 / 7))) OVER (PARTITION BY receipt_no) AS w FROM touch GROUP BY receipt_no, channel",
}


def _register_attribution(model: str) -> None:
    @query(f"attribution_{model}", _ATTRIBUTION.format(share=_SHARES[model]))
    def plan(t):
        lines = t.sales(*CHANNEL_COLUMNS, start=START, end=END)
        return omnichannel.attribution(lines, t("channel_member_events"), START, END, model)


for _model in _SHARES:
    _register_attribution(_model)


@query(
    "channel_funnel",
    """
WITH m AS (SELECT channel, member_id, count(*) FILTER (event_type = 'browse') AS b, count(*) FILTER (event_type = 'add_cart') AS c,
                  count(*) FILTER (event_type = 'purchase') AS p
           FROM channel_member_events WHERE CAST(event_date AS DATE) BETWEEN DATE '1999-01-02' AND DATE '1999-01-20' GROUP BY channel, member_id),
w AS (SELECT channel, count(*) FILTER (b > 0) AS n1, count(*) FILTER (c > 0) AS n2, count(*) FILTER (p > 0) AS n3, count(*) FILTER (p >= 2) AS n4 FROM m GROUP BY channel)
SELECT channel, 1 AS step, 'browse' AS step_name, n1 AS count, CAST(NULL AS DOUBLE) AS conversion_rate FROM w
UNION ALL SELECT channel, 2, 'add_cart', n2, CASE WHEN n1 > 0 THEN round(CAST(n2 AS DOUBLE) / n1 * 100 * 100) / 100 END FROM w
UNION ALL SELECT channel, 3, 'purchase', n3, CASE WHEN n2 > 0 THEN round(CAST(n3 AS DOUBLE) / n2 * 100 * 100) / 100 END FROM w
UNION ALL SELECT channel, 4, 'repeat_purchase', n4, CASE WHEN n3 > 0 THEN round(CAST(n4 AS DOUBLE) / n3 * 100 * 100) / 100 END FROM w""",
)
def channel_funnel(t):
    return omnichannel.channel_funnel(t("channel_member_events"), "1999-01-02", "1999-01-20")


@query(
    "member_journey",
    """
SELECT member_id, CAST(row_number() OVER (PARTITION BY member_id ORDER BY event_date, id) AS BIGINT) AS step, event_date, channel, event_type, store_id, amount
FROM channel_member_events""",
)
def member_journey(t):
    return omnichannel.member_journey(t("channel_member_events"))


@query(
    "member_channels",
    f"""
WITH s AS (SELECT member_id, string_agg(DISTINCT channel, ',' ORDER BY channel) AS channels_used, arg_min(channel, ROW(event_date, id)) AS first_channel,
                  arg_max(channel, ROW(event_date, id)) AS last_channel FROM channel_member_events GROUP BY member_id),
p AS (SELECT member_id, channel, {_money('amount')} AS spend FROM channel_member_events WHERE event_type = 'purchase' GROUP BY member_id, channel)
SELECT s.*, p.channel AS spend_channel, p.spend FROM s LEFT JOIN p ON p.member_id = s.member_id""",
)
def member_channels(t):
    rows = omnichannel.member_channels(t("channel_member_events"))
    return rows.select(
        "member_id",
        F.array_join("channels_used", ",").alias("channels_used"),
        "first_channel",
        "last_channel",
        F.explode_outer("spend_by_channel").alias("spend_channel", "spend"),
    )


@query(
    "channel_overlap",
    f"""
WITH m AS (SELECT member_id, bool_or(channel = 'online') AS a, bool_or(channel = 'offline') AS b, bool_or(channel = 'o2o') AS c
           FROM sales WHERE sale_date BETWEEN DATE '1999-03-01' AND DATE '1999-03-31' GROUP BY member_id)
SELECT count(*) FILTER (a AND NOT b AND NOT c) AS online_only, count(*) FILTER (b AND NOT a AND NOT c) AS offline_only,
       count(*) FILTER (a AND b) AS both_channels, count(*) FILTER (c) AS o2o_members, count(*) AS total_members FROM m""",
)
def channel_overlap(t):
    lines = t.sales(*CHANNEL_COLUMNS, start="1999-03-01", end="1999-03-31")
    return omnichannel.channel_overlap(lines, "1999-03-01", "1999-03-31")


@query(
    "channel_inventory",
    """
WITH d AS (SELECT store_id, max(snapshot_date) AS snapshot_date FROM channel_inventory GROUP BY store_id)
SELECT i.store_id, i.item_id, max(p.item_name) AS item_name,
       coalesce(sum(available_qty) FILTER (channel = 'online'), 0) AS online_available, coalesce(sum(available_qty) FILTER (channel = 'offline'), 0) AS offline_available,
       coalesce(sum(reserved_qty) FILTER (channel = 'online'), 0) AS online_reserved, coalesce(sum(reserved_qty) FILTER (channel = 'offline'), 0) AS offline_reserved
FROM channel_inventory i JOIN d ON d.store_id = i.store_id AND d.snapshot_date = i.snapshot_date LEFT JOIN products p ON p.item_id = i.item_id
GROUP BY i.store_id, i.item_id""",
)
def channel_inventory(t):
    return omnichannel.channel_inventory(t("channel_inventory"), t("products").select("item_id", "item_name"))


@query(
    "unified_member_stats",
    f"""
WITH m AS (SELECT member_id, count(DISTINCT channel) AS c, {_money('total_amount')} AS s FROM sales
           WHERE sale_date BETWEEN DATE '{START}' AND DATE '{END}' GROUP BY member_id)
SELECT count(*) AS total_members, round(CAST(count(*) FILTER (c > 1) AS DOUBLE) / count(*) * 100 * 100) / 100 AS cross_channel_pct,
       round({_money('s')} / count(*) * 100) / 100 AS avg_ltv FROM m""",
)
def unified_member_stats(t):
    return omnichannel.unified_member_stats(t.sales(*CHANNEL_COLUMNS, start=START, end=END), START, END)


@query(
    "channel_member_stats",
    f"""
SELECT channel, count(DISTINCT member_id) AS member_count, round(CAST(count(DISTINCT receipt_no) AS DOUBLE) / count(DISTINCT member_id) * 100) / 100 AS avg_frequency,
       round(CAST(sum(DATE '{AS_OF}' - sale_date) AS DOUBLE) / count(*) * 10) / 10 AS avg_recency_days,
       round({_money('total_amount')} / count(DISTINCT member_id) * 100) / 100 AS avg_spend
FROM sales WHERE sale_date BETWEEN DATE '{START}' AND DATE '{END}' GROUP BY channel""",
)
def channel_member_stats(t):
    return omnichannel.channel_member_stats(t.sales(*CHANNEL_COLUMNS, start=START, end=END), START, END, AS_OF)


LIMITS = f"""
gaps AS (SELECT gap FROM (SELECT transaction_date - lag(transaction_date) OVER (PARTITION BY member_id ORDER BY transaction_date) AS gap
         FROM member_transactions WHERE transaction_date >= DATE '{AS_OF}' - 90) WHERE gap > 0),
pq AS (SELECT count(*) AS n, CAST(floor(quantile_cont(gap, 0.5)) AS INT) AS p50, CAST(floor(quantile_cont(gap, 0.75)) AS INT) AS p75, CAST(floor(quantile_cont(gap, 0.95)) AS INT) AS p95 FROM gaps),
l1 AS (SELECT *, greatest(14, CAST(floor(p50 * 1.5) AS INT)) AS a FROM pq),
l2 AS (SELECT *, greatest(a + 7, CAST(floor(p75 * 1.5) AS INT)) AS d FROM l1),
lim AS (SELECT CASE WHEN n >= 10 THEN a ELSE 30 END AS active, CASE WHEN n >= 10 THEN d ELSE 90 END AS declining,
               CASE WHEN n >= 10 THEN greatest(d + 14, CAST(floor(p95 * 1.2) AS INT)) ELSE 180 END AS at_risk FROM l2)"""
IDLE = f"""
idle AS (SELECT m.*, DATE '{AS_OF}' - t.d AS days FROM members m LEFT JOIN (SELECT member_id, max(transaction_date) AS d FROM member_transactions GROUP BY member_id) t
         ON t.member_id = m.id WHERE m.is_active)"""
CLASSIFIED = f"""
cl AS (SELECT id AS member_id, member_no, name, level, total_points, CAST(coalesce(days, 9999) AS INT) AS days_since_last,
       CASE WHEN coalesce(DATE '{AS_OF}' - register_date, 9999) <= 30 THEN 'new' WHEN coalesce(days, 9999) <= active THEN 'active'
            WHEN coalesce(days, 9999) <= declining THEN 'declining' WHEN coalesce(days, 9999) <= at_risk THEN 'at_risk' ELSE 'churned' END AS lifecycle_stage
       FROM idle, lim)"""


@query("lifecycle_thresholds", f"WITH {LIMITS} SELECT active, declining, at_risk FROM lim")
def lifecycle_thresholds(t):
    return marketing.lifecycle_thresholds(t("member_transactions"), AS_OF)


@query("member_lifecycle", f"WITH {LIMITS}, {IDLE}, {CLASSIFIED} SELECT * FROM cl")
def member_lifecycle(t):
    return marketing.member_lifecycle(t("members"), t("member_transactions"), AS_OF)


@query(
    "lifecycle_distribution",
    f"WITH {LIMITS}, {IDLE}, {CLASSIFIED} SELECT lifecycle_stage AS stage, count(*) AS count, round(CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM cl) * 100 * 10) / 10 AS percentage FROM cl GROUP BY lifecycle_stage",
)
def lifecycle_distribution(t):
    return marketing.lifecycle_distribution(marketing.member_lifecycle(t("members"), t("member_transactions"), AS_OF))


BIRTHDAY = f"""
bd AS (SELECT id AS member_id FROM (SELECT id, CAST(birthday + to_months(CAST((2001 - year(birthday)) * 12 AS INT)) AS DATE) AS b0,
              CAST(birthday + to_months(CAST((2002 - year(birthday)) * 12 AS INT)) AS DATE) AS b1 FROM members WHERE is_active)
       WHERE CASE WHEN b0 >= DATE '{AS_OF}' THEN b0 ELSE b1 END <= DATE '{AS_OF}' + 7)"""
CHURN = "ch AS (SELECT id AS member_id FROM idle, lim WHERE days BETWEEN declining AND at_risk)"
REPURCHASE = f"""
rp AS (SELECT member_id FROM (SELECT member_id, avg(i) AS a, max(transaction_date) AS d FROM
       (SELECT member_id, transaction_date, transaction_date - lag(transaction_date) OVER (PARTITION BY member_id ORDER BY transaction_date) AS i FROM member_transactions)
       WHERE i IS NOT NULL GROUP BY member_id) WHERE DATE '{AS_OF}' - d > a * 1.5)"""
UPGRADE = f"""
up AS (SELECT m.id AS member_id FROM members m JOIN member_transactions t ON t.member_id = m.id
       WHERE m.is_active AND t.transaction_date >= DATE '{AS_OF}' - 90 AND m.level IN ('silver', 'bronze')
       GROUP BY m.id, m.total_points HAVING {_money('t.amount')} > m.total_points * CAST(0.8 AS DOUBLE))"""


@query("birthday_members", f"WITH {BIRTHDAY} SELECT * FROM bd")
def birthday_members(t):
    return marketing.birthday_members(t("members"), AS_OF)


@query("churn_risk", f"WITH {LIMITS}, {IDLE}, {CHURN} SELECT * FROM ch")
def churn_risk(t):
    return marketing.churn_risk_members(t("members"), t("member_transactions"), AS_OF)


@query("repurchase_candidates", f"WITH {REPURCHASE} SELECT * FROM rp")
def repurchase_candidates(t):
    return marketing.repurchase_candidates(t("member_transactions"), AS_OF)


@query("upgrade_candidates", f"WITH {UPGRADE} SELECT * FROM up")
def upgrade_candidates(t):
    return marketing.upgrade_candidates(t("members"), t("member_transactions"), AS_OF)


def _cooldown(pairs: str) -> str:
    return f"""
locked AS (SELECT DISTINCT member_id FROM campaign_executions WHERE sent_at >= TIMESTAMP '{NOW}' - INTERVAL 24 HOUR
           AND status IN ('sent', 'delivered', 'opened', 'converted')),
h AS (SELECT campaign_id, member_id, count(*) AS n, max(triggered_at) AS last FROM campaign_executions GROUP BY campaign_id, member_id),
ok AS (SELECT p.campaign_id, p.member_id FROM {pairs} p LEFT JOIN h ON h.campaign_id = p.campaign_id AND h.member_id = p.member_id
       LEFT JOIN (SELECT * FROM marketing_rules WHERE is_active) r ON r.campaign_id = p.campaign_id
       WHERE p.member_id NOT IN (SELECT member_id FROM locked)
         AND (h.n IS NULL OR (h.n < coalesce(max_triggers_per_member, 3) AND NOT coalesce(h.last > TIMESTAMP '{NOW}' - to_days(coalesce(cooldown_days, 7)), false))))"""


@query(
    "apply_cooldown",
    f"""
WITH pairs AS (SELECT DISTINCT o_orderkey % 25 AS campaign_id, o_custkey AS member_id FROM orders), {_cooldown('pairs')}
SELECT * FROM ok""",
)
def apply_cooldown(t):
    pairs = t("orders").select(
        (F.col("o_orderkey") % 25).alias("campaign_id"), F.col("o_custkey").alias("member_id")
    ).distinct()
    return marketing.apply_cooldown(pairs, t("campaign_executions"), t("marketing_rules"), NOW)


_SENT = f"""
{LIMITS}, {IDLE}, {BIRTHDAY}, {CHURN}, {REPURCHASE}, {UPGRADE},
tagged AS (SELECT *, 'birthday' AS k FROM bd UNION ALL SELECT *, 'churn_warning' FROM ch UNION ALL SELECT *, 'repurchase' FROM rp UNION ALL SELECT *, 'upgrade' FROM up),
pairs AS (SELECT c.id AS campaign_id, member_id FROM tagged JOIN campaigns c ON c.campaign_type = k AND c.status = 'active'), {_cooldown('pairs')},
chosen AS (SELECT member_id, min(campaign_id) AS campaign_id FROM ok GROUP BY member_id)"""


@query(
    "evaluate_campaigns",
    f"""
WITH {_SENT}
SELECT campaign_id, c.name AS campaign_name, campaign_type, member_id, channel, replace(message_template, '{{member_id}}', CAST(member_id AS VARCHAR)) AS message_content,
       'sent' AS status, TIMESTAMP '{NOW}' AS sent_at FROM chosen JOIN campaigns c ON c.id = campaign_id""",
)
def evaluate_campaigns(t):
    return marketing.evaluate_campaigns(
        t("campaigns"), t("members"), t("member_transactions"), t("campaign_executions"), t("marketing_rules"), NOW
    )


@query(
    "trigger_counts",
    f"WITH {_SENT} SELECT campaign_id, c.name AS campaign_name, campaign_type AS trigger_type, count(*) AS triggered_members FROM chosen JOIN campaigns c ON c.id = campaign_id GROUP BY ALL",
)
def trigger_counts(t):
    return marketing.trigger_counts(evaluate_campaigns(t))


@query(
    "campaign_stats",
    """
SELECT campaign_id, count(*) AS total_sent, count(*) FILTER (status = 'converted') AS converted,
       round(CAST(count(*) FILTER (status = 'converted') AS DOUBLE) / count(*) * 100 * 10) / 10 AS conversion_rate FROM campaign_executions GROUP BY campaign_id""",
)
def campaign_stats(t):
    return marketing.campaign_stats(t("campaign_executions"))


_DAILY = f"""
d0 AS (SELECT campaign_id, CAST(sent_at AS DATE) AS period_date, count(*) AS total_targeted, count(*) FILTER (status <> 'failed') AS total_sent,
       count(*) FILTER (status IN ('delivered', 'opened', 'converted')) AS total_delivered, count(*) FILTER (status IN ('opened', 'converted')) AS total_opened,
       count(*) FILTER (status = 'converted') AS total_converted, {_money('revenue')} AS total_revenue FROM campaign_executions GROUP BY ALL),
d1 AS (SELECT d0.*, total_sent * CAST(coalesce(unit_cost, 0) AS DOUBLE) AS total_cost FROM d0 LEFT JOIN campaigns c ON c.id = d0.campaign_id),
daily AS (SELECT *, CASE WHEN total_cost > 0 THEN (total_revenue - total_cost) / total_cost ELSE 0 END AS roi FROM d1)"""


@query("campaign_daily", f"WITH {_DAILY} SELECT * FROM daily")
def campaign_daily(t):
    return marketing.campaign_daily(t("campaign_executions"), t("campaigns"))


@query(
    "campaign_metrics",
    f"""
WITH {_DAILY}
SELECT *, CASE WHEN total_sent > 0 THEN round(total_converted * CAST(100 AS DOUBLE) / total_sent * 10) / 10 ELSE 0 END AS conversion_rate,
       CASE WHEN total_delivered > 0 THEN round(total_opened * CAST(100 AS DOUBLE) / total_delivered * 10) / 10 ELSE 0 END AS open_rate
FROM daily QUALIFY row_number() OVER (PARTITION BY campaign_id ORDER BY period_date DESC) <= 30""",
)
def campaign_metrics(t):
    return marketing.campaign_metrics(campaign_daily(t))


@query(
    "marketing_dashboard",
    f"""
WITH {_DAILY}, r AS (SELECT CASE WHEN total_sent > 0 THEN total_converted * CAST(100 AS DOUBLE) / total_sent ELSE 0 END AS c,
  CASE WHEN total_cost > 0 THEN (total_revenue - total_cost) / total_cost ELSE 0 END AS g FROM daily WHERE period_date >= DATE '{AS_OF}' - 30)
SELECT (SELECT count(*) FROM campaigns WHERE status = 'active') AS active_campaigns,
       (SELECT count(DISTINCT member_id) FROM campaign_executions WHERE sent_at >= TIMESTAMP '2001-08-01' AND status <> 'failed') AS members_reached_month,
       round(avg(c) * 10) / 10 AS avg_conversion_rate, round(sum(g) * 100) / 100 AS total_roi FROM r""",
)
def marketing_dashboard(t):
    return marketing.marketing_dashboard(t("campaigns"), t("campaign_executions"), campaign_daily(t), AS_OF)


def _reach(t):
    """Daily bitmaps of all sales, written once as a store of them would be."""
    return cut_lineage(omnichannel.reach_bitmaps(t.sales("channel", "sale_date", "member_id", "receipt_no")), "reach")


@query(
    "channel_reach",
    """
WITH p AS (SELECT * FROM sales WHERE sale_date BETWEEN DATE '1999-02-10' AND DATE '2000-05-20')
SELECT channel, count(DISTINCT member_id) AS members, count(DISTINCT receipt_no) AS receipts FROM p GROUP BY channel
UNION ALL SELECT NULL, count(DISTINCT member_id), count(DISTINCT receipt_no) FROM p""",
)
def channel_reach(t):
    return omnichannel.channel_reach(_reach(t), "1999-02-10", "2000-05-20")


@query(
    "channel_pairs",
    """
WITH m AS (SELECT member_id, bool_or(channel = 'online') AS a, bool_or(channel = 'offline') AS b, bool_or(channel = 'o2o') AS c
           FROM sales WHERE sale_date BETWEEN DATE '1999-03-01' AND DATE '1999-03-31' GROUP BY member_id)
SELECT count(*) FILTER (a AND b) AS online_offline, count(*) FILTER (a AND c) AS online_o2o, count(*) FILTER (b AND c) AS offline_o2o, count(*) FILTER (a AND b AND c) AS all_three FROM m""",
)
def channel_pairs(t):
    return omnichannel.channel_pairs(_reach(t), "1999-03-01", "1999-03-31")
