"""Quality rules: base counts of a text, and robust multivariate outliers per language and source.

All on DataFrame functions. The counts of a text are array expressions over its words, so
nothing is shuffled for them. Outliers are found by the minimum covariance determinant: from
three starts the three quarters of a group's rows nearest to its centre give a new centre
and covariance, until the determinant stands still, and the smallest determinant wins. Nearest
rows are chosen by a histogram of distances, and sums are whole numbers, so each step is
two pre-aggregated passes over short rows and its result does not depend on their order.
"""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aisle.llm.common import SPACE, cut_lineage

WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "[#*$%&|<>]"
LEAST_WORDS = 50
MOST_REPEATED = 50  # per hundred words

#: Statistics of a text that the outlier rule looks at, transformed so that their bulk is near symmetric.
STATISTICS = {
    "words": "ln(n_words)",
    "length": "ln(word_chars / n_words)",
    "symbols": "log1p(1000 * n_symbols / word_chars)",
    "lines": "log1p(1000 * n_dup_lines / n_words)",
    "repeats": "log1p(100 * n_repeat_words / n_words)",
}
#: Floor of each statistic's spread: below it differences do not matter, and a statistic that is mostly 0 has none of its own.
LEAST_SPREAD = {"words": 0.5, "length": 0.08, "symbols": 0.8, "lines": 0.8, "repeats": 0.8}
NAMES = list(STATISTICS)
PAIRS = list(combinations_with_replacement(NAMES, 2))
GROUP = ["lang_key", "source_key"]
#: Fixed-point steps in a unit: products of two statistics stay in 64 bits for 4e10 rows of a group.
SCALE = 1024
SUBSET = 0.75
#: Bins of log(1 + squared distance) in a unit.
BINS = 1024
#: A start is at rest when a step lowers the logarithm of its determinant by no more than this.
CLOSE = 1e-3
#: Share of the correlations that a start takes over, so that its matrix is positive definite.
TRUST = 0.95
#: Chi-square with five degrees of freedom. A normal subset of 0.75 has its covariance too small by CONSISTENCY.
CONSISTENCY = 1.41
#: Squared distance beyond which a text is rejected: the upper 1e-5 tail.
CUTOFF = 30.86
#: Parts into which the rows of a group are dealt where they meet its estimates.
PARTS = 32
#: Rows with the centre and spread of the whole language that every subset holds besides, so that small sources lean on their language.
PRIOR_ROWS = 50


def base_counts(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of every whole text.

    A 3-word window is known by a 64-bit hash of its words, compared within its text only.
    Windows that occur once are left out before any sorting.
    """
    kept = F.struct(*[F.col(c) for c in keep]).alias("kept")
    trimmed = F.btrim(F.coalesce("text", F.lit("")), F.lit(WHITE))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE))
    step = docs.select(kept, F.coalesce("text", F.lit("")).alias("body"), words.alias("words"))
    full_lines = F.filter(F.split("body", "\n", -1), lambda line: F.btrim(line, F.lit(WHITE)) != "")
    windows = F.transform("words", lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2)))
    step = step.select(
        "kept",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("body", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        full_lines.alias("full"),
        F.slice(windows, F.lit(1), F.greatest(F.size("words") - 2, F.lit(0))).alias("windows"),
    )
    placed = F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    some = F.size(F.array_distinct("windows")) < F.size("windows")
    step = step.select(
        "kept", "n_words", "word_chars", "n_symbols",
        (F.size("full") - F.size(F.array_distinct("full"))).cast("long").alias("n_dup_lines"),
        F.when(some, placed).alias("placed"),
    )
    again = F.filter(
        "placed", lambda e, k: e["h"].eqNullSafe(F.get("placed", k - 1)["h"]) | e["h"].eqNullSafe(F.get("placed", k + 1)["h"])
    )
    step = step.withColumn("starts", F.array_sort(F.transform(again, lambda e: e["i"])))
    # A repeated window covers its words up to the start of the next repeated one.
    covered = F.transform("starts", lambda p, k: F.least(F.lit(3), F.coalesce(F.get("starts", k + 1) - p, F.lit(3))))
    repeats = F.coalesce(F.aggregate(covered, F.lit(0), lambda a, b: a + b), F.lit(0)).cast("long")
    return step.select("kept.*", "n_words", "word_chars", "n_symbols", "n_dup_lines", repeats.alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def _total(terms: list[Column]) -> Column:
    return sum(terms, F.lit(0.0))


def _quartiles(counts: DataFrame, keys: list[str], centre: str, spread: str) -> DataFrame:
    """Median and normal spread, at least the floor, of each statistic from the histogram ``counts``, one row of ``keys``."""
    of = Window.partitionBy(*keys, "name")
    ranked = counts.select(*keys, "name", "bin", F.sum("rows").over(of.orderBy("bin")).alias("upto"), F.sum("rows").over(of).alias("all"))
    quartile = lambda share: (F.min(F.when(F.col("upto") >= F.col("all") * share, F.col("bin"))) + F.lit(0.5)) * 32 / SCALE
    cuts = ranked.groupBy(*keys, "name").agg(quartile(0.25).alias("low"), quartile(0.5).alias("mid"), quartile(0.75).alias("high"))
    one = lambda name, value: F.max(F.when(F.col("name") == name, value))
    wide = lambda n: F.greatest((F.col("high") - F.col("low")) / 1.349, F.lit(LEAST_SPREAD[n]))
    return cuts.groupBy(*keys).agg(
        *[one(n, F.col("mid")).alias(f"{centre}_{n}") for n in NAMES], *[one(n, wide(n)).alias(f"{spread}_{n}") for n in NAMES]
    )


def _meet(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Every row beside the rows of ``table`` of its group. A hot group is dealt by scan partition, as the table may be too long to broadcast."""
    dealt = rows.withColumn("part", F.spark_partition_id() % PARTS)
    copies = table.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    return dealt.join(copies, [*GROUP, "part"]).drop("part")


def _starts(rows: DataFrame) -> DataFrame:
    """Three first estimates of every group around its medians, with the spreads of its quartiles: uncorrelated,
    with the correlations of tanh(z), and with those of the signs z / |z|.

    A row is a group and ``start`` with its estimate ``est`` (centre m, Cholesky factor l) and the
    centre t and spread u of its whole language in ``prior``.
    """
    long = rows.select(
        *GROUP,
        F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.floor(F.col(f"x_{n}") / 32).alias("bin")) for n in NAMES])).alias("e"),
    ).select(*GROUP, "e.*")
    counts = cut_lineage(long.groupBy(*GROUP, "name", "bin").agg(F.count(F.lit(1)).alias("rows")), "histogram")
    language = counts.groupBy("lang_key", "name", "bin").agg(F.sum("rows").alias("rows"))
    scale = _quartiles(counts, GROUP, "m", "d").join(_quartiles(language, ["lang_key"], "t", "u"), "lang_key")
    scale = cut_lineage(scale, "scale")
    z = _meet(rows, scale).select(*GROUP, *[((F.col(f"x_{n}") / SCALE - F.col(f"m_{n}")) / F.col(f"d_{n}")).alias(n) for n in NAMES])
    z = z.withColumn("norm", F.greatest(_total([F.col(n) * F.col(n) for n in NAMES]), F.lit(1e-12)))
    whole = lambda c, unit: F.sum(F.round(c * unit).cast("long"))
    sums = z.groupBy(*GROUP).agg(
        F.count(F.lit(1)).alias("rows"),
        *[whole(F.tanh(n), SCALE).alias(f"h_{n}") for n in NAMES],
        *[whole(F.tanh(a) * F.tanh(b), SCALE**2).alias(f"h_{a}_{b}") for a, b in PAIRS],
        *[whole(F.col(a) * F.col(b) / F.col("norm"), SCALE**2).alias(f"g_{a}_{b}") for a, b in PAIRS],
    )
    moment = {
        "axes": lambda a, b: F.lit(float(a == b)),
        "tanh": lambda a, b: F.col(f"h_{a}_{b}") / F.col("rows") - F.col(f"h_{a}") / F.col("rows") * F.col(f"h_{b}") / F.col("rows"),
        "signs": lambda a, b: F.col(f"g_{a}_{b}") / F.col("rows"),
    }

    def start(name: str) -> Column:
        of = moment[name]
        both = lambda a, b: F.sqrt(F.greatest(of(a, a), F.lit(0.0)) * F.greatest(of(b, b), F.lit(0.0)))
        tied = lambda a, b: F.coalesce(F.try_divide(of(a, b), both(a, b)), F.lit(0.0)) * TRUST
        cells = [((F.lit(1.0) if a == b else tied(a, b)) * F.col(f"d_{a}") * F.col(f"d_{b}")).alias(f"c_{b}_{a}") for a, b in PAIRS]
        return F.struct(F.lit(name).alias("start"), *cells)

    table = sums.join(scale, GROUP).withColumn("of", F.explode(F.array(*[start(n) for n in moment]))).select("*", "of.*")
    table = _factor(table)
    return table.select(
        *GROUP, "start", F.lit(True).alias("moving"), F.lit(float("inf")).alias("logdet"), _estimate(),
        F.struct(*[f"{c}_{n}" for c in "tu" for n in NAMES]).alias("prior"),
    )


def _factor(table: DataFrame) -> DataFrame:
    """Adds the Cholesky factor l of the covariance c; what a statistic has beside the earlier ones is floored too."""
    for k, n in enumerate(NAMES):
        for j, m in enumerate(NAMES[: k + 1]):
            rest = F.col(f"c_{n}_{m}") - _total([F.col(f"l_{n}_{e}") * F.col(f"l_{m}_{e}") for e in NAMES[:j]])
            pivot = F.sqrt(F.greatest(rest, F.lit(LEAST_SPREAD[n] ** 2 / 2)))
            table = table.withColumn(f"l_{n}_{m}", pivot if n == m else rest / F.col(f"l_{m}_{m}"))
    return table


def _estimate() -> Column:
    return F.struct(*[f"m_{n}" for n in NAMES], *[f"l_{b}_{a}" for a, b in PAIRS]).alias("est")


def _distance(rows: DataFrame, shape: DataFrame) -> DataFrame:
    """Squared Mahalanobis distance ``d2`` of every row to the estimates of its group, by forward substitution."""
    out = _meet(rows, shape)
    for k, n in enumerate(NAMES):
        value = F.col(f"x_{n}") / SCALE - F.col(f"est.m_{n}")
        for earlier in NAMES[:k]:
            value = value - F.col(f"est.l_{n}_{earlier}") * F.col(f"y_{earlier}")
        out = out.withColumn(f"y_{n}", value / F.col(f"est.l_{n}_{n}"))
    return out.withColumn("d2", _total([F.col(f"y_{n}") * F.col(f"y_{n}") for n in NAMES]))


def _concentrate(rows: DataFrame, shape: DataFrame) -> DataFrame:
    """One step of every start that still moves: a new estimate from the nearest three quarters of its group.

    A fine histogram of distances tells the bin in which the subset ends; rows of that bin count in
    proportion, so every subset of a group has the same weight. The new estimate is taken if
    its determinant is smaller by more than ``CLOSE``, else the start is at rest.
    """
    moving = shape.where("moving").select(*GROUP, "start", "est", "prior")
    key = [*GROUP, "start"]
    place = F.floor(F.log1p("d2") * BINS)
    bins = _distance(rows, moving).groupBy(*key, place.alias("bin")).agg(F.count(F.lit(1)).alias("rows"))
    of = Window.partitionBy(*key)
    upto = bins.select(*key, "bin", "rows", F.sum("rows").over(of.orderBy("bin")).alias("upto"), (F.sum("rows").over(of) * SUBSET).alias("want"))
    last = upto.where((F.col("upto") >= F.col("want")) & (F.col("upto") - F.col("rows") < F.col("want")))
    ends = last.select(*key, "want", F.col("bin").alias("end"), ((F.col("want") - F.col("upto") + F.col("rows")) / F.col("rows")).alias("share"))
    near = _distance(rows, moving.drop("prior").join(ends, key)).withColumn("bin", place).where(F.col("bin") <= F.col("end"))
    sums = {f"s_{n}": F.col(f"x_{n}") for n in NAMES} | {f"p_{a}_{b}": F.col(f"x_{a}") * F.col(f"x_{b}") for a, b in PAIRS}
    # Whole numbers apart for the rows inside and those of the last bin: no sum depends on the order of rows.
    part = lambda test, v: F.coalesce(F.sum(F.when(test, v)), F.lit(0))
    inside = near.groupBy(*key).agg(
        F.first("want").alias("want"), F.first("share").alias("share"),
        *[part(F.col("bin") < F.col("end"), v).alias(f"in_{k}") for k, v in sums.items()],
        *[part(F.col("bin") == F.col("end"), v).alias(f"at_{k}") for k, v in sums.items()],
    )
    inside = inside.join(moving.select(*key, "prior"), key)
    weight = F.col("want") + PRIOR_ROWS
    prior = lambda c, n: F.col(f"prior.{c}_{n}")
    seen = lambda k, unit: (F.col(f"in_{k}") + F.col("share") * F.col(f"at_{k}")) / unit
    new = inside.select("*", *[((seen(f"s_{n}", SCALE) + PRIOR_ROWS * prior("t", n)) / weight).alias(f"m_{n}") for n in NAMES])
    for a, b in PAIRS:
        pseudo = prior("t", a) * prior("t", b) + (prior("u", a) * prior("u", a) / CONSISTENCY if a == b else F.lit(0.0))
        second = (seen(f"p_{a}_{b}", SCALE**2) + PRIOR_ROWS * pseudo) / weight
        spread = (second - F.col(f"m_{a}") * F.col(f"m_{b}")) * CONSISTENCY
        new = new.withColumn(f"c_{b}_{a}", F.greatest(spread, F.lit(LEAST_SPREAD[a] ** 2)) if a == b else spread)
    logdet = 2 * _total([F.log(f"l_{n}_{n}") for n in NAMES])
    new = _factor(new).select(*key, logdet.alias("new_logdet"), _estimate().alias("new_est"))
    lower = F.coalesce(F.col("new_logdet") < F.col("logdet") - CLOSE, F.lit(False))
    return shape.join(new, key, "left").select(
        *key, lower.alias("moving"), F.when(lower, F.col("new_logdet")).otherwise(F.col("logdet")).alias("logdet"),
        F.when(lower, F.col("new_est")).otherwise(F.col("est")).alias("est"), "prior",
    )


def estimates(rows: DataFrame) -> DataFrame:
    """Minimum covariance determinant of every group: lang_key, source_key, est, logdet, start of the best.

    Each start is followed until its determinant falls no more, which ends as determinants have a floor;
    starts at rest leave the passes. ``rows`` has the group and x_* in units of 1 / SCALE.
    """
    shape = cut_lineage(_starts(rows), "shape")
    while not shape.where("moving").isEmpty():
        shape = cut_lineage(_concentrate(rows, shape), "shape")
    return shape.groupBy(*GROUP).agg(F.min_by(F.struct("est", "logdet", "start"), F.struct("logdet", "start")).alias("b")).select(*GROUP, "b.*")


def quality(docs: DataFrame) -> DataFrame:
    """Base counts and verdict of every row.

    ``kept`` is false where the base rule fails, and else where the text's statistics lie
    beyond the cutoff of its language's and source's robust estimate. Rows that fail the base
    rule take no part in the estimates. Cases: null and empty texts have no words and fail
    the base rule; null lang or source is a group of its own; equal distances fall into one
    bin and are used together; repeated rows count as often as they are there; an empty
    table gives no rows; extra columns are ignored. Returns doc_id, n_words, word_chars,
    n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance.
    """
    key = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")).alias(f"{c}_key")
    counts = base_counts(docs.select("doc_id", "text", key("lang"), key("source")), ["doc_id", "lang_key", "source_key"])
    counts = cut_lineage(counts.withColumn("base_failed", base_failed()), "counts")
    plain = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    sound = counts.where(~F.col("base_failed")).select(
        *plain, "lang_key", "source_key", *[F.round(F.expr(v) * SCALE).cast("long").alias(f"x_{n}") for n, v in STATISTICS.items()]
    )
    judged = _distance(sound, estimates(sound).select(*GROUP, "est")).select(*plain, (F.col("d2") <= CUTOFF).alias("kept"), F.sqrt("d2").alias("distance"))
    failed = counts.where("base_failed").select(*plain, F.lit(False).alias("kept"), F.lit(None).cast("double").alias("distance"))
    return judged.unionByName(failed)
