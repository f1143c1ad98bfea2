from itertools import combinations

import pytest
from pyspark.sql import functions as F

from aisle.operators import basket


def lines(spark, receipts, store=1):
    rows = [(store, r, i) for r, items in enumerate(receipts) for i in items]
    return spark.createDataFrame(rows, "store_id long, receipt_no long, item_id string")


def brute_force(receipts, minimum, max_k=5):
    """Itemsets by counting every subset of every basket."""
    counts = {}
    for items in receipts:
        for k in range(1, max_k + 1):
            for s in combinations(sorted(set(items)), k):
                counts[s] = counts.get(s, 0) + 1
    found, level = {}, {}
    for k in range(1, max_k + 1):
        before, level = level, {}
        for s, c in counts.items():
            if len(s) != k or c < min(minimum(i) for i in s):
                continue
            parts = sum(1 for p in combinations(s, k - 1) if p in before)
            if k == 1 or parts >= 2:
                level[s] = c
        found.update(level)
    return found


RECEIPTS = [list("ABCDE"), list("ABCD"), list("ABC"), list("ABD"), list("BCE"), list("ACE"), list("AB"), list("DE"), list("ABCDE"), list("CE")]


@pytest.mark.parametrize("support", [0.2, 0.3, 0.5, 0.9])
def test_itemsets_uniform(spark, support):
    rows = basket.baskets(lines(spark, RECEIPTS))
    got = {tuple(r["items"]): r["support_count"] for r in basket.frequent_itemsets(rows, support).collect()}
    assert got == brute_force(RECEIPTS, lambda i: support * len(RECEIPTS))


def test_itemsets_with_item_thresholds(spark):
    low = {"D": 0.1, "E": 0.2, "A": 0.6, "B": 0.6, "C": 0.6}
    rows = basket.baskets(lines(spark, RECEIPTS))
    thresholds = spark.createDataFrame([(1, i, s) for i, s in low.items()], "store_id long, item_id string, min_support double")
    got = {tuple(r["items"]): r["support_count"] for r in basket.frequent_itemsets(rows, 0.5, thresholds).collect()}
    assert got == brute_force(RECEIPTS, lambda i: low[i] * len(RECEIPTS))


def test_slices_do_not_mix(spark):
    both = lines(spark, RECEIPTS, 1).unionByName(lines(spark, [list("XY")] * 4 + [list("XZ")], 2))
    out = basket.frequent_itemsets(basket.baskets(both), 0.5).where("store_id = 2").collect()
    assert {tuple(r["items"]): r["support_count"] for r in out} == {("X",): 5, ("Y",): 4, ("X", "Y"): 4}


def test_short_baskets_and_repeats_are_dropped(spark):
    rows = basket.baskets(lines(spark, [["A", "A"], ["A", "B", "B"], list("ABC")]), min_items=3)
    assert {(r["receipt_no"], r["item_id"]) for r in rows.collect()} == {(2, "A"), (2, "B"), (2, "C")}


def test_rule_numbers(spark):
    rows = basket.baskets(lines(spark, RECEIPTS))
    sets = basket.frequent_itemsets(rows, 0.2)
    rules = {
        (tuple(r["antecedent"]), tuple(r["consequent"])): r
        for r in basket.association_rules(sets, basket.basket_count(rows), 0.0).collect()
    }
    rule = rules[("A",), ("B",)]
    n, a, b, ab = 10, 7, 7, 6
    assert rule["support"] == ab / n and rule["confidence"] == round(ab / a, 6)
    assert rule["lift"] == round(ab / a / (b / n), 4) and rule["leverage"] == pytest.approx(ab / n - a * b / n / n)
    assert rule["conviction"] == round((1 - b / n) / (1 - ab / a), 4)
    assert all(r["conviction"] is None for r in rules.values() if r["confidence"] == 1.0)


def test_cooccurrence_is_symmetric(spark):
    rows = basket.baskets(lines(spark, RECEIPTS))
    cells = {(r["item_a"], r["item_b"]): r["baskets"] for r in basket.cooccurrence(rows, 3).collect()}
    assert all(cells[b, a] == n for (a, b), n in cells.items())
    assert len({a for a, _ in cells}) == 3 and cells["A", "A"] == 7


def rule_table(spark, pairs):
    rows = [(1, [a], [b], lift, 10) for a, b, lift in pairs]
    return spark.createDataFrame(rows, "store_id long, antecedent array<string>, consequent array<string>, lift double, transaction_count long").withColumn(
        "support", F.lit(0.1)).withColumn("confidence", F.lit(0.5))


def test_clusters_of_a_long_chain(spark):
    chain = [(f"c{i:02d}", f"c{i + 1:02d}", 2.0 + i) for i in range(20)]
    rules = rule_table(spark, chain + [("x", "y", 3.0), ("p", "q", 1.0)])
    members = {r["item_id"]: r for r in basket.layout_clusters(rules, 2.0).collect()}
    assert {r["cluster_id"] for i, r in members.items() if i.startswith("c")} == {"c00"}
    assert members["c05"]["avg_lift"] == 11.5 and members["y"]["cluster_id"] == "x"
    assert "p" not in members


def test_bundle_keeps_best_rule_of_an_item(spark):
    rules = rule_table(spark, [("a", "b", 3.0), ("a", "c", 2.0), ("a", "b", 1.0), ("z", "c", 9.0)])
    offers = [(r["item_id"], r["lift"]) for r in basket.bundle_for(rules, 5, "a").orderBy("rank").collect()]
    assert offers == [("b", 3.0), ("c", 2.0)]


def test_bundle_finds_offers_behind_many_rules_of_one_item(spark):
    rules = rule_table(spark, [*[("a", "x", 9.0 - k) for k in range(6)], ("a", "y", 1.5)])
    offers = [(r["item_id"], r["lift"]) for r in basket.bundle_for(rules, 2, "a").orderBy("rank").collect()]
    assert offers == [("x", 9.0), ("y", 1.5)]


def test_analysis_replaces_only_its_slice(spark, tmp_path):
    path = str(tmp_path / "rules")
    sales = lines(spark, RECEIPTS).withColumn("sale_date", F.lit("2024-01-05").cast("date")).withColumn(
        "category", F.lit("x")).withColumn("unit_price", F.lit(1.0))
    basket.run_basket_analysis(sales, path, "2024-01-01", "2024-01-31", min_support=0.2, min_confidence=0.1)
    basket.run_basket_analysis(sales, path, "2024-01-01", "2024-02-28", min_support=0.5, min_confidence=0.1)
    first = spark.read.parquet(path).where("cast(period_end as string) = '2024-01-31'").count()
    stats = basket.run_basket_analysis(sales, path, "2024-01-01", "2024-02-28", min_support=0.6, min_confidence=0.1).first()
    stored = spark.read.parquet(path)
    assert stored.where("cast(period_end as string) = '2024-01-31'").count() == first > 0
    assert stored.where("cast(period_end as string) = '2024-02-28'").count() == stats["rules_found"]
    basket.run_basket_analysis(sales, path, "2024-01-01", "2024-02-28", min_support=0.99, min_confidence=0.1)
    assert spark.read.parquet(path).where("cast(period_end as string) = '2024-02-28'").count() == 0


def test_sets_and_rules_of_every_size(spark):
    """Seven items together: sets of six and seven were dropped, and registered rules ended at three items."""
    receipts = [list("ABCDEFG")] * 3 + [list("ABCDEF"), list("AB"), list("FG")]
    sales = lines(spark, receipts)
    found = brute_force(receipts, lambda i: 0.5 * len(receipts), max_k=7)
    rules, itemsets, _ = basket.analyse(sales, 0.5, 0.01, adaptive=False)
    assert {tuple(r["items"]): r["support_count"] for r in itemsets.collect()} == found
    assert max(map(len, found)) == 7
    expected = {(a, tuple(x for x in s if x not in a)) for s in found for k in range(1, len(s)) for a in combinations(s, k)}
    assert {(tuple(r["antecedent"]), tuple(r["consequent"])) for r in rules.collect()} == expected


def test_hot_items_and_wide_receipts(spark, monkeypatch):
    """Projections cut down to a few entries a task find the same sets; so does one receipt of 5 000 items."""
    whole = basket.frequent_itemsets(basket.baskets(lines(spark, RECEIPTS)), 0.2)
    monkeypatch.setattr(basket, "TASK_ENTRIES", 5)
    for max_k in (None, 1, 2, 3):
        cut = basket.frequent_itemsets(basket.baskets(lines(spark, RECEIPTS)), 0.2, None, max_k)
        want = {(tuple(r["items"]), r["support_count"]) for r in whole.collect() if max_k is None or len(r["items"]) <= max_k}
        assert {(tuple(r["items"]), r["support_count"]) for r in cut.collect()} == want
    monkeypatch.undo()
    many = [f"i{k:04d}" for k in range(5000)]
    receipts = [many, many[:12], many[6:18], *[many[k : k + 2] for k in range(0, 5000, 2)], *[many[k : k + 2] for k in range(0, 5000, 2)]]
    rows = basket.frequent_itemsets(basket.baskets(lines(spark, receipts)), 3 / len(receipts)).where(F.size("items") > 1).collect()
    found = {tuple(r["items"]): r["support_count"] for r in rows}
    pairs = {tuple(many[k : k + 2]): 3 + (k < 12) + (6 <= k < 18) for k in range(0, 5000, 2)}
    # Six items lie in all three wide receipts: each of their sets is frequent.
    both = {s: 3 for k in range(2, 7) for s in combinations(many[6:12], k)}
    assert found == both | pairs


def test_registered_sets_of_every_size(spark):
    from aisle import plans

    every = plans.queries()["frequent_itemsets"](spark, "/root/testdata/sf0.001").collect()
    sizes = {r["items"].count(",") + 1 for r in every}
    assert max(sizes) > 3 and sizes == set(range(1, max(sizes) + 1))
