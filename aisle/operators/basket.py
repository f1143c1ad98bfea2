"""Market-basket analysis: baskets, adaptive support, itemsets, rules, graph and clusters.

Everything runs for all slices (stores) at once. Itemsets are found by vertical search in
projections of baskets on their items; of a basket only its frequent items are ever one array.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aisle.functions.listing import page
from aisle.functions.scalars import round_to
from aisle.functions.stats import bounded_quantiles
from aisle.session import cut_lineage
from aisle.sources.sinks import replace_slice

SLICE = "store_id"
BASKET = "receipt_no"
ITEM = "item_id"
#: Entries of projected baskets that one task searches; items with more are extended first.
TASK_ENTRIES = 2_000_000


def baskets(sales: DataFrame, category: str | None = None, min_items: int = 2) -> DataFrame:
    """Distinct (slice, basket, item) rows of baskets with enough different items."""
    rows = sales if category is None else sales.where(F.col("category") == category)
    items = rows.select(SLICE, BASKET, ITEM).distinct()
    wide = items.groupBy(SLICE, BASKET).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_items)
    return items.join(wide.select(SLICE, BASKET), [SLICE, BASKET], "left_semi")


def basket_count(basket_rows: DataFrame) -> DataFrame:
    return basket_rows.groupBy(SLICE).agg(F.countDistinct(BASKET).alias("n_baskets"))


def category_support(sales: DataFrame, base: float) -> DataFrame:
    """Support per slice and category: lower for rare and for dear categories."""
    known = sales.where(F.col("category").isNotNull())
    facts = known.groupBy(SLICE, "category").agg(
        F.countDistinct(BASKET).alias("receipts"), F.avg("unit_price").alias("avg_price")
    )
    # One row per category from here on.
    peers = Window.partitionBy(SLICE)
    share = F.col("receipts") / F.max("receipts").over(peers)
    median = bounded_quantiles("avg_price", [0.5]).over(peers)[0]
    adjusted = F.greatest(F.sqrt(share) * base, F.lit(base * 0.1))
    dear = F.when(F.col("avg_price") > median, 0.7).otherwise(1.0)
    return facts.withColumn("min_support", F.greatest(adjusted * dear, F.lit(base * 0.05))).select(
        SLICE, "category", "receipts", "min_support"
    )


def item_categories(sales: DataFrame) -> DataFrame:
    return sales.where(F.col("category").isNotNull()).groupBy(SLICE, ITEM).agg(F.min("category").alias("category"))


def item_thresholds(sales: DataFrame, base: float) -> DataFrame:
    """Adaptive minimum support per slice and item; an item without a category has none and keeps the base."""
    supports = item_categories(sales).join(category_support(sales, base), [SLICE, "category"])
    return supports.select(SLICE, ITEM, "min_support")


def _frequent_items(basket_rows: DataFrame, thresholds: DataFrame | None, base: float) -> DataFrame:
    counts = basket_rows.groupBy(SLICE, ITEM).agg(F.count(F.lit(1)).alias("support_count"))
    sized = counts.join(basket_count(basket_rows), SLICE)
    if thresholds is None:
        sized = sized.withColumn("min_support", F.lit(base))
    else:
        sized = sized.join(thresholds, [SLICE, ITEM], "left").fillna(base, ["min_support"])
    return sized.withColumn("min_count", F.col("min_support") * F.col("n_baskets")).where(
        F.col("support_count") >= F.col("min_count")
    ).select(SLICE, ITEM, "support_count", "min_count")


def _projections(kept: DataFrame) -> DataFrame:
    """For each item of each basket the basket's later items: (slice, prefix, least, tail).

    Items are ordered by their least count, so a set's count must reach that of its first item, and
    inside the projections of one first item a part of a frequent set is frequent.
    """
    order = F.array_sort(F.collect_list(F.struct("min_count", ITEM))).alias("_items")
    listed = kept.groupBy(SLICE, BASKET).agg(order).select(SLICE, "_items", F.posexplode("_items").alias("_at", "_first"))
    after = F.expr("transform(slice(_items, _at + 2, size(_items)), x -> x.item_id)")
    return listed.select(SLICE, F.array(f"_first.{ITEM}").alias("prefix"), F.col("_first.min_count").alias("least"), after.alias("tail"))


def _longer(projections: DataFrame) -> DataFrame:
    """Each prefix longer by one item of its tails."""
    listed = projections.select(SLICE, "prefix", "least", "tail", F.posexplode("tail").alias("_at", "_next"))
    after = F.expr("slice(tail, _at + 2, size(tail))")
    return listed.select(SLICE, F.concat("prefix", F.array("_next")).alias("prefix"), "least", after.alias("tail"))


def _extensions(items: list, bits: list[int], least: float, depth: int | None) -> Iterator[tuple[list, int]]:
    """Frequent sets of items with a bitmap of baskets each, in every order-preserving combination, with their counts."""
    for k, (item, own) in enumerate(zip(items, bits, strict=True)):
        yield [item], own.bit_count()
        if depth is not None and depth <= 1:
            continue
        further = [(x, met) for x, b in zip(items[k + 1 :], bits[k + 1 :], strict=True) if (met := own & b).bit_count() >= least]
        if further:
            for rest, count in _extensions(*map(list, zip(*further, strict=True)), least, None if depth is None else depth - 1):
                yield [item, *rest], count


def _mine(max_k: int | None) -> Callable[[pa.Table], pa.Table]:
    """All frequent sets that begin with the prefix of a group of projections, from bitmaps of its baskets per item.

    The group stays in Arrow's columns: an item of a tail takes its bytes and a code there, not an object of its own.
    """

    def run(group: pa.Table) -> pa.Table:
        prefix, least, store = (group[c][0].as_py() for c in ("prefix", "least", SLICE))
        tails = [np.asarray(pc.list_value_length(c)) for c in group["tail"].chunks]
        basket = np.repeat(np.arange(group.num_rows, dtype=np.int32), np.concatenate(tails))
        coded = pa.chunked_array([pc.list_flatten(c) for c in group["tail"].chunks]).dictionary_encode().combine_chunks()
        if isinstance(coded, pa.ChunkedArray):
            coded = coded.chunk(0)
        codes, items = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        counts = np.bincount(codes)
        found = []
        for code in np.flatnonzero(counts >= least):
            held = np.zeros(group.num_rows, bool)
            held[basket[codes == code]] = True
            found.append((code, int.from_bytes(np.packbits(held).tobytes(), "big")))
        # Any one order will do here: all sets of the group have the same least count.
        deeper = None if max_k is None else max_k - len(prefix)
        rows = _extensions([items[c] for c, _ in found], [b for _, b in found], least, deeper) if deeper is None or deeper > 0 else ()
        sets = [(store, prefix + more, count) for more, count in rows]
        kind, whole = coded.dictionary.type, lambda k, t: pa.array([s[k] for s in sets], t)
        columns = [whole(0, group.schema.field(SLICE).type), whole(1, pa.list_(kind)), whole(2, pa.int64())]
        return pa.table(columns, names=[SLICE, "items", "support_count"])

    return run


def frequent_itemsets(
    basket_rows: DataFrame, base: float, thresholds: DataFrame | None = None, max_k: int | None = None
) -> DataFrame:
    """Sets of frequent items whose count reaches the lowest threshold of their items, of any size unless ``max_k`` is given.

    Baskets are projected on each of their items, the one of the lowest threshold first, and each
    item's projections are searched in one task from bitmaps of baskets per item. An item with more projections
    than a task should hold is extended by a second item first, and so on, so hot items spread.
    A basket of n items is n rows, never its pairs; pairs that are not frequent leave no task.
    """
    basket_rows = cut_lineage(basket_rows)
    singles = cut_lineage(_frequent_items(basket_rows, thresholds, base))
    found = [singles.select(SLICE, F.array(ITEM).alias("items"), "support_count")]
    level = _projections(basket_rows.join(singles.select(SLICE, ITEM, "min_count"), [SLICE, ITEM]))
    kind = singles.schema[ITEM].dataType.simpleString()
    store = singles.schema[SLICE].dataType.simpleString()
    k = 1
    while max_k is None or k < max_k:
        level = cut_lineage(level, "projections")
        sizes = level.groupBy(SLICE, "prefix").agg(
            F.count(F.lit(1)).alias("support_count"), F.min("least").alias("_least"), F.sum(F.size("tail")).alias("_entries")
        )
        sizes = cut_lineage(sizes.where(F.col("support_count") >= F.col("_least")), "prefixes")
        if k > 1:
            found.append(sizes.select(SLICE, F.col("prefix").alias("items"), "support_count"))
        large = F.col("_entries") > TASK_ENTRIES
        alive = level.join(sizes.select(SLICE, "prefix", large.alias("_large")), [SLICE, "prefix"]).where(F.size("tail") > 0)
        mined = alive.where("NOT _large").groupBy(SLICE, "prefix").applyInArrow(
            _mine(max_k), f"{SLICE} {store}, items array<{kind}>, support_count long"
        )
        found.append(cut_lineage(mined, "itemsets"))
        if sizes.where(large).isEmpty():
            break
        level = _longer(alive.where("_large"))
        k += 1
    else:
        if k > 1:
            last = level.groupBy(SLICE, "prefix").agg(F.count(F.lit(1)).alias("support_count"), F.min("least").alias("_least"))
            found.append(last.where(F.col("support_count") >= F.col("_least")).select(SLICE, F.col("prefix").alias("items"), "support_count"))
    return reduce(DataFrame.unionByName, found).withColumn("items", F.array_sort("items"))


def _subset(mask: str, keep: bool) -> Column:
    test = "!=" if keep else "="
    return F.expr(f"filter(items, (x, i) -> ({mask} & shiftleft(1, i)) {test} 0)")


def association_rules(itemsets: DataFrame, counts: DataFrame, min_confidence: float) -> DataFrame:
    """Rules from every split of every itemset whose two sides are frequent too."""
    known = itemsets.select(SLICE, F.col("items").alias("_side"), F.col("support_count").alias("_c"))
    masks = F.expr("sequence(1, shiftleft(1, size(items)) - 2)")
    split = (
        itemsets.where(F.size("items") >= 2)
        .withColumn("_mask", F.explode(masks))
        .withColumn("antecedent", _subset("_mask", True))
        .withColumn("consequent", _subset("_mask", False))
    )
    sides = (
        split.join(
            known.select(SLICE, F.col("_side").alias("antecedent"), F.col("_c").alias("_ca")), [SLICE, "antecedent"]
        )
        .join(known.select(SLICE, F.col("_side").alias("consequent"), F.col("_c").alias("_cc")), [SLICE, "consequent"])
        .join(counts, SLICE)
    )
    n = F.col("n_baskets")
    support = F.col("support_count") / n
    confidence = F.col("support_count") / F.col("_ca")
    other = F.col("_cc") / n
    return (
        sides.withColumn("_conf", confidence)
        .where(F.col("_conf") >= min_confidence)
        .select(
            SLICE, "antecedent", "consequent",
            round_to(support, 6).alias("support"),
            round_to("_conf", 6).alias("confidence"),
            round_to(F.col("_conf") / other, 4).alias("lift"),
            F.when(F.col("_conf") < 1.0, round_to((1 - other) / (1 - F.col("_conf")), 4)).alias("conviction"),
            round_to(support - F.col("_ca") / n * other, 6).alias("leverage"),
            n.alias("transaction_count"),
        )
    )


def _top_items(basket_rows: DataFrame, n: int) -> DataFrame:
    freq = basket_rows.groupBy(SLICE, ITEM).agg(F.count(F.lit(1)).alias("freq"))
    order = Window.partitionBy(SLICE).orderBy(F.desc("freq"), ITEM)
    return freq.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= n).drop("_r")


def cooccurrence(basket_rows: DataFrame, top_n: int = 20) -> DataFrame:
    """Baskets with both items for the most frequent items of each slice; the diagonal is the item count."""
    top = _top_items(basket_rows, top_n)
    kept = basket_rows.join(top.select(SLICE, ITEM), [SLICE, ITEM], "left_semi")
    left, right = kept.withColumnRenamed(ITEM, "item_a"), kept.withColumnRenamed(ITEM, "item_b")
    half = left.join(right, [SLICE, BASKET]).where(F.col("item_a") < F.col("item_b")).groupBy(
        SLICE, "item_a", "item_b"
    ).agg(F.count(F.lit(1)).alias("baskets"))
    mirror = half.select(SLICE, F.col("item_b").alias("item_a"), F.col("item_a").alias("item_b"), "baskets")
    own = top.select(SLICE, F.col(ITEM).alias("item_a"), F.col(ITEM).alias("item_b"), F.col("freq").alias("baskets"))
    return half.unionByName(mirror).unionByName(own)


def _rule_order() -> list[Column]:
    return [F.desc("lift"), F.asc("antecedent"), F.asc("consequent")]


def _edges(rules: DataFrame) -> DataFrame:
    return rules.withColumn("source", F.explode("antecedent")).withColumn("target", F.explode("consequent"))


def _strongest(rules: DataFrame, min_lift: float, n: int) -> DataFrame:
    order = Window.partitionBy(SLICE).orderBy(*_rule_order())
    strong = rules.where(F.col("lift") >= min_lift)
    return strong.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= n)


def rule_graph_edges(rules: DataFrame, min_lift: float = 1.5, n: int = 30) -> DataFrame:
    """Item to item edges of the strongest rules of each slice."""
    return _edges(_strongest(rules, min_lift, n)).select(SLICE, "source", "target", F.col("lift").alias("value"))


def rule_graph_nodes(rules: DataFrame, min_lift: float = 1.5, n: int = 30) -> DataFrame:
    both = _strongest(rules, min_lift, n).withColumn(ITEM, F.explode(F.concat("antecedent", "consequent")))
    return both.groupBy(SLICE, ITEM).agg(F.max("transaction_count").alias("value"))


def bundle_for(rules: DataFrame, n: int = 10, item=None) -> DataFrame:
    """Items to offer beside each item: consequents of its best rules, each once."""
    listed = rules.withColumn("for_item", F.explode("antecedent"))
    if item is not None:
        listed = listed.where(F.col("for_item") == item)
    # The struct sorts as rules are listed: by falling lift, then by both sides.
    rule = F.struct((-F.col("lift")).alias("down"), "antecedent", "consequent").alias("_rule")
    offers = listed.select(
        SLICE, "for_item", rule, "support", "confidence", "lift", F.posexplode("consequent").alias("_pos", ITEM)
    )
    first = offers.groupBy(SLICE, "for_item", ITEM).agg(
        F.min(F.struct("_rule", "_pos", "support", "confidence", "lift")).alias("_f")
    ).select(SLICE, "for_item", ITEM, "_f.*")
    order = Window.partitionBy(SLICE, "for_item").orderBy("_rule", "_pos")
    return first.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).drop("_rule", "_pos")


def connected_components(edges: DataFrame) -> DataFrame:
    """Smallest item reachable from each item, per slice.

    Every round takes the smallest label of the neighbours and then the label of
    the label, so long chains shrink in few rounds. Rounds end when nothing moves;
    each one is written, so a lost executor does not replay the rounds before.
    """
    both = edges.select(SLICE, F.col("source").alias("a"), F.col("target").alias("b"))
    both = cut_lineage(both.unionByName(both.select(SLICE, F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = both.groupBy(SLICE, "a").agg(F.least(F.min("b"), F.col("a")).alias("label"))
    labels = cut_lineage(labels)
    while True:
        near = both.join(labels.select(SLICE, F.col("a").alias("b"), F.col("label").alias("_l")), [SLICE, "b"]).groupBy(
            SLICE, "a"
        ).agg(F.min("_l").alias("_near"))
        moved = labels.join(near, [SLICE, "a"]).withColumn("_new", F.least("label", "_near"))
        jump = labels.select(SLICE, F.col("a").alias("_new"), F.col("label").alias("_far"))
        moved = moved.join(jump, [SLICE, "_new"], "left").select(
            SLICE, "a", F.col("label").alias("_old"), F.least("_new", "_far").alias("label")
        )
        moved = cut_lineage(moved)
        labels = moved.drop("_old")
        if moved.where(F.col("label") < F.col("_old")).isEmpty():
            return labels.withColumnRenamed("a", ITEM)


def layout_clusters(rules: DataFrame, min_lift: float = 2.0) -> DataFrame:
    """Members of each group of items tied by strong rules, with the mean lift inside the group."""
    edges = cut_lineage(_edges(rules.where(F.col("lift") >= min_lift)).select(SLICE, "source", "target", "lift"))
    members = connected_components(edges)
    strength = edges.join(members.withColumnRenamed(ITEM, "source"), [SLICE, "source"]).groupBy(SLICE, "label").agg(
        round_to(F.sum(F.col("lift").cast("decimal(18,4)")).cast("double") / F.count(F.lit(1)), 4).alias("avg_lift")
    )
    return members.join(strength, [SLICE, "label"]).select(SLICE, F.col("label").alias("cluster_id"), ITEM, "avg_lift")


def analyse(
    sales: DataFrame, min_support: float = 0.01, min_confidence: float = 0.3, category: str | None = None,
    min_items: int = 2, adaptive: bool = True, max_k: int | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rules, itemsets and basket counts of every slice."""
    rows = cut_lineage(baskets(sales, category, min_items))
    thresholds = item_thresholds(sales, min_support) if adaptive else None
    itemsets = cut_lineage(frequent_itemsets(rows, min_support, thresholds, max_k))
    counts = basket_count(rows)
    return association_rules(itemsets, counts, min_confidence), itemsets, counts


def run_basket_analysis(
    sales: DataFrame, path: str, period_start: str, period_end: str, category: str | None = None, **settings
) -> DataFrame:
    """Analyse a period, put the rules in place of the stored slice and return counts per slice."""
    period = sales.where(F.col("sale_date").between(F.lit(period_start), F.lit(period_end)))
    rules, itemsets, counts = analyse(period, category=category, **settings)
    keyed = (
        rules.withColumn("period_start", F.lit(period_start))
        .withColumn("period_end", F.lit(period_end))
        .withColumn("category_filter", F.lit(category).cast("string"))
    )
    keyed = cut_lineage(keyed)
    slices = ["store_id", "period_start", "period_end", "category_filter"]
    cleared = counts.select(
        SLICE, F.lit(period_start).alias("period_start"), F.lit(period_end).alias("period_end"),
        F.lit(category).cast("string").alias("category_filter"),
    )
    replace_slice(path, keyed, slices, cleared)
    found = keyed.groupBy(SLICE).agg(F.count(F.lit(1)).alias("rules_found"))
    sets = itemsets.groupBy(SLICE).agg(F.count(F.lit(1)).alias("frequent_itemsets_count"))
    return counts.join(sets, SLICE, "left").join(found, SLICE, "left").fillna(0)


def query_rules(
    rules: DataFrame, min_lift: float | None = None, category: str | None = None, start=None, end=None,
    page_no: int = 1, size: int = 20,
) -> DataFrame:
    rows = rules
    if min_lift is not None:
        rows = rows.where(F.col("lift") >= min_lift)
    if category is not None:
        rows = rows.where(F.col("category_filter") == category)
    if start is not None:
        rows = rows.where(F.col("period_start") >= start)
    if end is not None:
        rows = rows.where(F.col("period_end") <= end)
    return page(rows, [*_rule_order(), F.asc(SLICE)], page_no, size)
