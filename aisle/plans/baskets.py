"""Market-basket queries: item = brand, basket = order, slice = order number modulo three."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from aisle.operators import basket
from aisle.plans.registry import query
from aisle.session import checkpoint_root, cut_lineage

BASE = 0.002
CONFIDENCE = 0.05
MIN_LIFT = 1.1


def _lines(t):
    return t.sales("receipt_no", "brand", "unit_price", "sale_date").select(
        (F.col("receipt_no") % 3).alias("store_id"),
        "receipt_no",
        "sale_date",
        F.col("brand").alias("item_id"),
        F.concat(F.lit("G"), (F.substring("brand", 7, 3).cast("int") % 5).cast("string")).alias("category"),
        "unit_price",
    )


LINES = """
ln AS (SELECT receipt_no % 3 AS store_id, receipt_no, brand AS item_id, 'G' || (CAST(substr(brand, 7, 3) AS INT) % 5) AS category, unit_price FROM sales),
di AS (SELECT DISTINCT store_id, receipt_no, item_id FROM ln),
bk AS (SELECT * FROM di QUALIFY count(*) OVER (PARTITION BY store_id, receipt_no) >= 2),
nb AS (SELECT store_id, count(DISTINCT receipt_no) AS n FROM bk GROUP BY store_id)"""
SUPPORT = f"""
c0 AS (SELECT store_id, category, count(DISTINCT receipt_no) AS receipts, avg(unit_price) AS p FROM ln GROUP BY ALL),
cs AS (SELECT *, greatest(greatest(sqrt(CAST(receipts AS DOUBLE) / max(receipts) OVER (PARTITION BY store_id)) * {BASE}::DOUBLE, {BASE}::DOUBLE * 0.1::DOUBLE)
       * CASE WHEN p > quantile_cont(p, 0.5) OVER (PARTITION BY store_id) THEN 0.7::DOUBLE ELSE 1.0::DOUBLE END, {BASE}::DOUBLE * 0.05::DOUBLE) AS min_support FROM c0),
ic AS (SELECT store_id, item_id, min(category) AS category FROM ln GROUP BY ALL),
th AS (SELECT ic.store_id, ic.item_id, min_support * n AS mc FROM ic JOIN cs ON cs.store_id = ic.store_id AND cs.category = ic.category JOIN nb ON nb.store_id = ic.store_id)"""

# Every set of frequent items of every basket, of any size; a set's count must reach the lowest threshold of its items.
SETS = f"""
{LINES}, {SUPPORT},
f1 AS (SELECT b.store_id, b.item_id, count(*) AS c, max(mc) AS mc FROM bk b JOIN th ON th.store_id = b.store_id AND th.item_id = b.item_id GROUP BY ALL HAVING count(*) >= max(mc)),
kb AS (SELECT b.*, mc FROM bk b JOIN f1 ON f1.store_id = b.store_id AND f1.item_id = b.item_id),
sb(store_id, receipt_no, items, newest, mc) AS (
  SELECT store_id, receipt_no, [item_id], item_id, mc FROM kb
  UNION ALL SELECT sb.store_id, sb.receipt_no, list_append(items, item_id), item_id, least(sb.mc, kb.mc) FROM sb JOIN kb ON kb.store_id = sb.store_id AND kb.receipt_no = sb.receipt_no AND item_id > newest),
sets AS (SELECT store_id, items, count(*) AS support_count FROM sb GROUP BY store_id, items HAVING count(*) >= min(mc))"""
RULES = f"""
{SETS},
sp AS (SELECT *, unnest(range(1, (1 << len(items)) - 1)) AS m FROM sets WHERE len(items) >= 2),
sd AS (SELECT *, list_filter(items, lambda x: (m >> (list_position(items, x) - 1)) & 1 = 1) AS ant, list_filter(items, lambda x: (m >> (list_position(items, x) - 1)) & 1 = 0) AS con FROM sp),
rj AS (SELECT sd.store_id, ant, con, CAST(sd.support_count AS DOUBLE) AS c, CAST(a.support_count AS DOUBLE) AS ca, CAST(k.support_count AS DOUBLE) AS cc, n FROM sd JOIN sets a ON a.store_id = sd.store_id AND a.items = ant
       JOIN sets k ON k.store_id = sd.store_id AND k.items = con JOIN nb ON nb.store_id = sd.store_id WHERE CAST(sd.support_count AS DOUBLE) / a.support_count >= {CONFIDENCE}::DOUBLE),
rules AS (SELECT store_id, ant, con, round(c / n * 1000000) / 1000000 AS support, round(c / ca * 1000000) / 1000000 AS confidence, round(c / ca / (cc / n) * 10000) / 10000 AS lift,
       CASE WHEN c / ca < 1 THEN round((1 - cc / n) / (1 - c / ca) * 10000) / 10000 END AS conviction, round((c / n - ca / n * (cc / n)) * 1000000) / 1000000 AS leverage, n AS transaction_count FROM rj)"""
TOP = f"tp AS (SELECT * FROM rules WHERE lift >= {MIN_LIFT} QUALIFY row_number() OVER (PARTITION BY store_id ORDER BY lift DESC, ant, con) <= 30)"


def _sets(t, max_k=None):
    lines = _lines(t)
    return basket.frequent_itemsets(basket.baskets(lines), BASE, basket.item_thresholds(lines, BASE), max_k)


def _rules(t):
    return basket.analyse(_lines(t), BASE, CONFIDENCE)[0]


@query("baskets", f"WITH {LINES} SELECT store_id, receipt_no, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM bk GROUP BY ALL")
def baskets(t):
    return basket.baskets(_lines(t)).groupBy("store_id", "receipt_no").agg(
        F.count(F.lit(1)).alias("n_items"), F.array_join(F.array_sort(F.collect_list("item_id")), ",").alias("items")
    )


@query("category_support", f"WITH {LINES}, {SUPPORT} SELECT store_id, category, receipts, round(min_support * 100000000) / 100000000 AS min_support FROM cs")
def category_support(t):
    rows = basket.category_support(_lines(t), BASE)
    return rows.withColumn("min_support", F.round(F.col("min_support") * 1e8) / 1e8)


@query("item_categories", f"WITH {LINES}, {SUPPORT} SELECT * FROM ic")
def item_categories(t):
    return basket.item_categories(_lines(t))


@query("frequent_pairs", f"WITH RECURSIVE {SETS} SELECT store_id, items[1] AS item_a, items[2] AS item_b, support_count FROM sets WHERE len(items) = 2")
def frequent_pairs(t):
    return _sets(t, 2).where(F.size("items") == 2).select(
        "store_id", F.col("items")[0].alias("item_a"), F.col("items")[1].alias("item_b"), "support_count"
    )


@query("frequent_itemsets", f"WITH RECURSIVE {SETS} SELECT store_id, array_to_string(items, ',') AS items, support_count FROM sets")
def frequent_itemsets(t):
    return _sets(t).withColumn("items", F.array_join("items", ","))


@query(
    "association_rules",
    f"WITH RECURSIVE {RULES} SELECT * EXCLUDE (ant, con), array_to_string(ant, ',') AS antecedent, array_to_string(con, ',') AS consequent FROM rules",
)
def association_rules(t):
    return _rules(t).withColumn("antecedent", F.array_join("antecedent", ",")).withColumn(
        "consequent", F.array_join("consequent", ",")
    )


@query(
    "cooccurrence",
    f"""
WITH {LINES}, fr AS (SELECT store_id, item_id, count(*) AS f FROM bk GROUP BY store_id, item_id QUALIFY row_number() OVER (PARTITION BY store_id ORDER BY count(*) DESC, item_id) <= 10),
k AS (SELECT bk.* FROM bk JOIN fr ON fr.store_id = bk.store_id AND fr.item_id = bk.item_id)
SELECT a.store_id, a.item_id AS item_a, b.item_id AS item_b, count(*) AS baskets FROM k a JOIN k b ON b.store_id = a.store_id AND b.receipt_no = a.receipt_no GROUP BY ALL""",
)
def cooccurrence(t):
    return basket.cooccurrence(basket.baskets(_lines(t)), 10)


@query("rule_graph", f"WITH RECURSIVE {RULES}, {TOP}, s AS (SELECT store_id, unnest(ant) AS source, con, lift FROM tp) SELECT store_id, source, unnest(con) AS target, lift AS value FROM s")
def rule_graph(t):
    return basket.rule_graph_edges(_rules(t), MIN_LIFT)


@query("rule_graph_nodes", f"WITH RECURSIVE {RULES}, {TOP}, s AS (SELECT store_id, unnest(list_concat(ant, con)) AS item_id, transaction_count FROM tp) SELECT store_id, item_id, max(transaction_count) AS value FROM s GROUP BY ALL")
def rule_graph_nodes(t):
    return basket.rule_graph_nodes(_rules(t), MIN_LIFT)


@query(
    "bundle_for",
    f"""
WITH RECURSIVE {RULES}, l AS (SELECT *, unnest(ant) AS for_item FROM rules),
r AS (SELECT *, row_number() OVER (PARTITION BY store_id, for_item ORDER BY lift DESC, ant, con) AS rk FROM l),
o AS (SELECT store_id, for_item, rk, support, confidence, lift, unnest(con) AS item_id, generate_subscripts(con, 1) AS pos FROM r),
f AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY store_id, for_item, item_id ORDER BY rk, pos) = 1)
SELECT store_id, for_item, item_id, support, confidence, lift, CAST(row_number() OVER (PARTITION BY store_id, for_item ORDER BY rk, pos) AS INT) AS rank FROM f QUALIFY rank <= 5""",
)
def bundle_for(t):
    return basket.bundle_for(_rules(t), 5)


@query(
    "layout_clusters",
    f"""
WITH RECURSIVE {RULES}, e0 AS (SELECT store_id, unnest(ant) AS a, con, lift FROM rules WHERE lift >= 1.2), e AS (SELECT store_id, a, unnest(con) AS b, lift FROM e0),
bo AS (SELECT DISTINCT store_id, a, b FROM e UNION SELECT DISTINCT store_id, b, a FROM e),
reach(store_id, a, b) AS (SELECT store_id, a, a FROM bo UNION SELECT store_id, a, b FROM bo UNION SELECT r.store_id, r.a, bo.b FROM reach r JOIN bo ON bo.store_id = r.store_id AND bo.a = r.b),
lb AS (SELECT store_id, a AS item_id, min(b) AS cluster_id FROM reach GROUP BY store_id, a),
av AS (SELECT e.store_id, cluster_id, round(CAST(sum(CAST(lift AS DECIMAL(18,4))) AS DOUBLE) / count(*) * 10000) / 10000 AS avg_lift FROM e JOIN lb ON lb.store_id = e.store_id AND lb.item_id = e.a GROUP BY e.store_id, cluster_id)
SELECT lb.store_id, lb.cluster_id, item_id, avg_lift FROM lb JOIN av ON av.store_id = lb.store_id AND av.cluster_id = lb.cluster_id""",
)
def layout_clusters(t):
    return basket.layout_clusters(_rules(t), 1.2)


@query(
    "query_rules",
    f"WITH RECURSIVE {RULES} SELECT * EXCLUDE (ant, con), array_to_string(ant, ',') AS antecedent, array_to_string(con, ',') AS consequent FROM rules WHERE lift >= {MIN_LIFT} ORDER BY lift DESC, ant, con, store_id LIMIT 20 OFFSET 20",
)
def query_rules(t):
    rows = basket.query_rules(_rules(t), min_lift=MIN_LIFT, page_no=2)
    return rows.withColumn("antecedent", F.array_join("antecedent", ",")).withColumn(
        "consequent", F.array_join("consequent", ",")
    )


@query(
    "run_basket_analysis",
    f"""
WITH RECURSIVE {RULES}, r AS (SELECT store_id, count(*) AS n FROM rules GROUP BY store_id), s AS (SELECT store_id, count(*) AS n FROM sets GROUP BY store_id)
SELECT nb.store_id, nb.n AS n_baskets, coalesce(s.n, 0) AS frequent_itemsets_count, coalesce(r.n, 0) AS rules_found, coalesce(r.n, 0) AS rules_stored
FROM nb LEFT JOIN s ON s.store_id = nb.store_id LEFT JOIN r ON r.store_id = nb.store_id""",
)
def run_basket_analysis(t):
    """The analysis of a period, twice: the second run takes the place of the first."""
    path = f"{checkpoint_root(t.spark)}/rules-{uuid.uuid4().hex}"
    lines = cut_lineage(_lines(t))
    for confidence in (CONFIDENCE * 2, CONFIDENCE):
        counts = basket.run_basket_analysis(lines, path, "1990-01-01", "2010-12-31", min_support=BASE, min_confidence=confidence)
    stored = t.spark.read.parquet(path).groupBy(F.col("store_id").cast("long").alias("store_id")).agg(F.count(F.lit(1)).alias("rules_stored"))
    return counts.join(stored, "store_id", "left").fillna(0, ["rules_stored"])
