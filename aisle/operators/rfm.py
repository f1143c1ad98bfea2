"""Recency, frequency and monetary segmentation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aisle.functions.scalars import money_sum, round_to
from aisle.functions.scope import scope_stores
from aisle.functions.stats import bounded_quantiles, exact_quantiles
from aisle.session import cut_lineage

QUARTILES = [0.25, 0.5, 0.75]

# Three-digit score codes and their segments.
SEGMENT_CODES = {
    "444": "key_value",
    "443": "key_value",
    "434": "key_growth",
    "433": "key_growth",
    "344": "key_retain",
    "343": "key_retain",
    "334": "key_win_back",
    "333": "general_value",
    "222": "general_growth",
    "111": "lost",
}
# Lowest mean score of a segment for every other code.
SEGMENT_MEANS = [(3.5, "key_value"), (3.0, "key_retain"), (2.5, "general_value"), (2.0, "general_growth")]


def rfm_base(members: DataFrame, transactions: DataFrame, as_of: str, store_ids=None) -> DataFrame:
    """One row per active member with a purchase. A purchase on ``as_of`` has recency 0."""
    facts = (
        scope_stores(transactions, store_ids)
        .groupBy("member_id")
        .agg(
            F.datediff(F.lit(as_of).cast("date"), F.max("transaction_date")).alias("recency"),
            F.countDistinct("receipt_no").alias("frequency"),
            F.coalesce(money_sum("amount"), F.lit(0.0)).alias("monetary"),
        )
        .withColumn("recency", F.coalesce("recency", F.lit(999)))
    )
    active = members.where("is_active").select(F.col("id").alias("member_id"), "member_no", "name")
    return facts.join(active, "member_id")


def _score(value: str, cuts: Column, reverse: bool) -> Column:
    v = F.col(value)
    steps = [4, 3, 2, 1] if reverse else [1, 2, 3, 4]
    return (
        F.when(v <= cuts[0], steps[0]).when(v <= cuts[1], steps[1]).when(v <= cuts[2], steps[2]).otherwise(steps[3])
    )


def rfm_scores(base: DataFrame) -> DataFrame:
    """Quartile scores 1 to 4 and the segment of every member.

    Days and receipt counts have few distinct values; money does not and goes
    through the range-split quantile.
    """
    base = cut_lineage(base, "rfm")
    small = base.agg(
        bounded_quantiles("recency", QUARTILES).alias("_rq"),
        bounded_quantiles("frequency", QUARTILES).alias("_fq"),
    )
    money = exact_quantiles(base, "monetary", {"q1": 0.25, "q2": 0.5, "q3": 0.75}).select(
        F.array("q1", "q2", "q3").alias("_mq")
    )
    scored = (
        base.join(F.broadcast(small))
        .join(F.broadcast(money))
        .withColumn("r_score", _score("recency", F.col("_rq"), True))
        .withColumn("f_score", _score("frequency", F.col("_fq"), False))
        .withColumn("m_score", _score("monetary", F.col("_mq"), False))
        .withColumn("rfm_score", F.concat(*[F.col(c).cast("string") for c in ("r_score", "f_score", "m_score")]))
    )
    return scored.drop("_rq", "_fq", "_mq").withColumn("segment", rfm_segment())


def rfm_segment() -> Column:
    codes = F.create_map(*[F.lit(x) for pair in SEGMENT_CODES.items() for x in pair])
    mean = (F.col("r_score") + F.col("f_score") + F.col("m_score")) / 3
    by_mean = F.when(mean >= SEGMENT_MEANS[0][0], SEGMENT_MEANS[0][1])
    for low, name in SEGMENT_MEANS[1:]:
        by_mean = by_mean.when(mean >= low, name)
    return F.coalesce(F.try_element_at(codes, F.col("rfm_score")), by_mean.otherwise("lost"))


def rfm_summary(scored: DataFrame) -> DataFrame:
    return scored.groupBy("segment").agg(
        F.count(F.lit(1)).alias("count"),
        round_to(money_sum("monetary") / F.count(F.lit(1)), 2).alias("avg_monetary"),
    )
