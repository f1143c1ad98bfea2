"""Cleaning of imported feeds and the import job."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aisle.functions import ordered
from aisle.functions.stats import exact_medians, exact_quantiles
from aisle.session import cut_lineage
from aisle.sources import hadoop
from aisle.sources.feeds import read_feed
from aisle.sources.sinks import load_atomic, not_stored, stored_near

# Columns that must be present, keys that must be filled, and keys of stored rows.
REQUIRED = {
    "sales": ["store_id", "sale_date", "receipt_no", "item_id", "quantity", "unit_price", "total_amount"],
    "inventory": ["store_id", "item_id", "quantity", "snapshot_date"],
    "members": ["member_no", "register_date"],
    "traffic": ["store_id", "traffic_date", "hour", "enter_count"],
    "weather": ["city", "weather_date"],
}
ROW_KEYS = {
    "sales": ["store_id", "sale_date", "receipt_no", "item_id"],
    "inventory": ["store_id", "item_id", "snapshot_date"],
    "members": ["member_no", "register_date"],
    "traffic": ["store_id", "traffic_date", "hour"],
    "weather": ["city", "weather_date"],
}
CONFLICT_KEYS = {
    "sales": ["store_id", "receipt_no", "item_id"],
    "inventory": ["store_id", "item_id", "snapshot_date"],
    "traffic": ["store_id", "traffic_date", "hour"],
    "weather": ["city", "weather_date"],
}
#: Column by which stored rows lie in folders, so that an import only looks at the folders that it has keys for.
#: It is a key column or, where that has very many values, a group of them: a folder costs a file and its Bloom filters.
FOLDERS = {"sales": ["store_group"], "inventory": ["snapshot_date"], "traffic": ["traffic_date"], "weather": ["weather_date"]}
STORE_GROUPS = 64
#: Rows of a group that are filled as one window in one task.
WHOLE = 200_000
NUMERIC_STORE = {"sales", "inventory"}
#: Columns that a cleaner turns into numbers before anything else and that are no keys as text; done once, where copies are counted.
NUMBERS = {
    "sales": ["store_id", "quantity", "unit_price", "total_amount"],
    "inventory": ["store_id", "quantity"],
}
WEATHER_NUMBERS = ["temp_high", "temp_low", "humidity", "wind_speed", "precipitation"]
COPIES = "_copies"
NO_DATE = "0001-01-01"
LEAST, MOST = -(2**63), 2**63 - 1


@dataclass
class Cleaned:
    """Clean rows, and one row of counts: total_rows, duplicate_rows, error_rows."""

    rows: DataFrame
    stats: DataFrame


def normalize_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip().lower().replace(" ", "_") for c in df.columns])


def _data_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if not c.startswith("_")]


def drop_empty_rows(df: DataFrame) -> DataFrame:
    return df.na.drop("all", subset=_data_columns(df))


def count_copies(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Distinct rows with the number of copies of each; copies combine before the shuffle. ``by`` keeps imports apart."""
    return df.groupBy(*by, *_data_columns(df)).agg(F.count(F.lit(1)).alias(COPIES))


def drop_exact_duplicates(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct rows, and one row with the number of dropped ones."""
    counted = count_copies(df)
    dropped = counted.agg(F.coalesce(F.sum(F.col(COPIES) - 1), F.lit(0)).alias("duplicate_rows"))
    return counted.drop(COPIES), dropped


def require_columns(df: DataFrame, columns: list[str]) -> bool:
    return set(columns) <= set(df.columns)


def null_key(keys: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])


def drop_null_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.where(~null_key(keys))


def lenient_number(c: str) -> Column:
    """Number, or null for text and for a literal NaN."""
    return F.nullif(F.col(c).try_cast("double"), F.lit(float("nan")))


def lenient_date(c: str) -> Column:
    """Date from common notations, null for anything else."""
    text = F.col(c).cast("string")
    formats = ["yyyy/M/d", "yyyyMMdd", "M/d/yyyy"]
    return F.coalesce(
        F.try_to_timestamp(text).cast("date"), *[F.try_to_timestamp(text, F.lit(f)).cast("date") for f in formats]
    )


def coerce(df: DataFrame, numbers: list[str], dates: list[str] = ()) -> DataFrame:
    for c in numbers:
        df = df.withColumn(c, lenient_number(c))
    for c in dates:
        df = df.withColumn(c, lenient_date(c))
    return df


def interpolate(
    df: DataFrame, columns: list[str], group: str | Sequence[str], order: list[str], bucket: Column, median_fallback: bool = True,
    by: Sequence[str] = (),
) -> DataFrame:
    """Fill numeric nulls: linear within the group, then the column's median, then zero.

    ``order`` must give every row of a group its place; ``bucket`` cuts a group's
    rows in that order. Only groups of more than ``WHOLE`` rows are cut, into chunks of neighbouring buckets.
    Groups without any value are rare, so the medians are only
    computed for columns that have such a group. With ``by`` each of its values is an
    import of its own, with its own groups and medians.

    The input is read twice; what is costly before it should be written first.
    """
    columns = [c for c in columns if c in df.columns]
    if not columns:
        return df
    groups = [group] if isinstance(group, str) else group
    keys = [*by, *groups]
    known = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), *[F.count(c).alias(f"_known_{k}") for k, c in enumerate(columns)]
    )
    facts = known.agg(F.max("_n").alias("_n"), *[F.bool_or(F.col(f"_known_{k}") == 0).alias(c) for k, c in enumerate(columns)]).first()
    by_place = [F.col(c).asc_nulls_first() for c in order]
    rows = df.withColumn("_bucket", bucket)
    # Rows without bucket count as the first of their group and go in the end.
    nullable = rows.schema["_bucket"].nullable
    if (facts["_n"] or 0) <= WHOLE:
        by_place = [F.col("_bucket").isNotNull(), *by_place] if nullable else by_place
        filled = ordered.interpolate_whole(rows, columns, keys, by_place, [*by, groups[0]])
    else:
        large = cut_lineage(known.where(F.col("_n") > WHOLE).select(*keys), "large")
        chunks = ordered.chunk_numbers(rows.join(large, keys, "left_semi"), keys, "_bucket", WHOLE // 4, "_chunk")
        numbered = rows.join(cut_lineage(chunks, "chunks"), [*keys, "_bucket"], "left")
        numbered = numbered.withColumn("_chunk", F.coalesce("_chunk", F.lit(0)))
        if nullable:
            numbered = numbered.withColumn("_chunk", F.when(F.col("_bucket").isNotNull(), F.col("_chunk")))
        filled = ordered.interpolate(numbered, columns, keys, "_chunk", by_place)
    filled = (filled.where(F.col("_bucket").isNotNull()) if nullable else filled).select(*df.columns)
    if not median_fallback:
        return filled.fillna(0.0, columns)
    open_columns = [c for c in columns if facts[c]]
    if open_columns:
        filled = cut_lineage(filled)
    for c in open_columns:
        medians = exact_medians(filled, c, by, "_median") if by else exact_quantiles(filled, c, {"_median": 0.5})
        joined = filled.join(medians, list(by), "left") if by else filled.join(F.broadcast(medians))
        filled = joined.withColumn(c, F.coalesce(c, "_median", F.lit(0.0))).drop("_median")
    return filled


def _order(df: DataFrame, first: list[str]) -> list[str]:
    """The given columns, then the rest: distinct rows always have one place."""
    return first + [c for c in _data_columns(df) if c not in first]


def clean_sales(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Distinct rows with filled keys in, typed valid sale lines out."""
    typed = coerce(df, ["store_id", "quantity", "unit_price", "total_amount"]).where(F.col("store_id").isNotNull())
    # A store's number is its whole part and, where that is not all, its text. Spark deals floating keys anew for each grouping,
    # as it normalises them first; dealt by the whole number that is stored in the end, the fill and the keys of an import need one shuffle.
    number = F.col("store_id") + F.lit(0.0)
    ends = F.when(number > 0, F.lit(MOST)).otherwise(F.lit(LEAST))
    typed = typed.withColumn("_store_id", F.coalesce(number.try_cast("long"), ends))
    typed = typed.withColumn("store_id", F.when(number != F.col("_store_id").cast("double"), number.cast("string")).otherwise(""))
    dated = typed.withColumn("_day", F.coalesce(lenient_date("sale_date"), F.lit(NO_DATE).cast("date")))
    order = ["_day", *[c for c in _order(df, ["receipt_no", "item_id"]) if c != "store_id"]]
    # Days are cut once more by receipt, so that one busy day of one store is no single bucket.
    bucket = F.struct("_day", F.substring("receipt_no", 1, 2).alias("receipts"))
    full = interpolate(dated, ["quantity", "unit_price", "total_amount"], ["_store_id", "store_id"], order, bucket, by=by)
    amounts = (F.col("quantity") > 0) & (F.col("unit_price") >= 0) & (F.col("total_amount") >= 0)
    usable = amounts & (F.col("_day") != F.lit(NO_DATE).cast("date"))
    # A number beyond all whole ones is an error of the import, as it is for the cast, but only in a row that would be stored.
    beyond = usable & F.col("_store_id").isin(MOST, LEAST)
    whole = F.coalesce(F.nullif(F.col("store_id"), F.lit("")).cast("double"), F.col("_store_id").cast("double")).cast("long")
    valid = full.where(usable).where(F.when(beyond, whole.isNotNull()).otherwise(True))
    valid = valid.withColumn("sale_date", F.col("_day")).withColumn("store_id", F.col("_store_id")).drop("_day", "_store_id")
    if "discount_amount" in valid.columns:
        valid = valid.withColumn("discount_amount", F.coalesce(lenient_number("discount_amount"), F.lit(0.0)))
    else:
        valid = valid.withColumn("discount_amount", F.lit(0.0))
    recalculated = F.when(
        (F.col("total_amount") == 0) & (F.col("unit_price") > 0), F.col("quantity") * F.col("unit_price")
    ).otherwise(F.col("total_amount"))
    return valid.withColumn("total_amount", recalculated)


def clean_inventory(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    typed = coerce(df, ["store_id", "quantity"]).where(F.col("store_id").isNotNull())
    dated = typed.withColumn("_day", F.coalesce(lenient_date("snapshot_date"), F.lit(NO_DATE).cast("date")))
    order = ["_day", *_order(df, ["store_id", "item_id"])]
    full = interpolate(dated, ["quantity"], "item_id", order, F.col("_day"), by=by)
    valid = full.where(F.col("_day") != F.lit(NO_DATE).cast("date")).withColumn("snapshot_date", F.col("_day"))
    more = [c for c in ("unit_cost", "total_value") if c in df.columns]
    valid = cut_lineage(valid) if more else valid
    valid = interpolate(coerce(valid, more), more, "item_id", order, F.col("_day"), by=by).drop("_day")
    if "unit_cost" in df.columns and "total_value" not in df.columns:
        valid = valid.withColumn("total_value", F.col("quantity") * F.col("unit_cost"))
    return valid.withColumn("store_id", F.col("store_id").cast("long"))


def clean_members(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    valid = coerce(df, [], ["register_date"]).where(F.col("register_date").isNotNull())
    if "phone" in valid.columns:
        digits = F.regexp_replace("phone", r"[^\d]", "")
        valid = valid.withColumn("phone", F.when(F.length(digits) == 11, digits))
    return valid


def clean_traffic(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    counts = [c for c in ("enter_count", "exit_count", "pass_by_count") if c in df.columns]
    typed = coerce(df, ["store_id", "hour", *counts]).where(F.col("store_id").isNotNull())
    dated = typed.withColumn("_day", F.coalesce(lenient_date("traffic_date"), F.lit(NO_DATE).cast("date")))
    order = ["_day", *_order(df, ["hour"])]
    full = interpolate(dated, counts, "store_id", order, F.col("_day"), by=by)
    return (
        full.where(F.col("hour").between(0, 23) & (F.col("enter_count") >= 0))
        .where(F.col("_day") != F.lit(NO_DATE).cast("date"))
        .withColumn("traffic_date", F.col("_day"))
        .drop("_day")
        .withColumn("store_id", F.col("store_id").cast("long"))
        .withColumn("hour", F.col("hour").cast("int"))
    )


def clean_weather(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    numbers = [c for c in WEATHER_NUMBERS if c in df.columns]
    valid = coerce(df, numbers, ["weather_date"]).where(F.col("weather_date").isNotNull())
    full = interpolate(valid, numbers, "city", _order(df, ["weather_date"]), F.trunc("weather_date", "month"), by=by)
    if "humidity" in numbers:
        full = full.withColumn("humidity", F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("humidity"))))
    return full


CLEANERS = {
    "sales": clean_sales,
    "inventory": clean_inventory,
    "members": clean_members,
    "traffic": clean_traffic,
    "weather": clean_weather,
}


def _counted(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return count_copies(drop_empty_rows(normalize_headers(df)), by)


def clean_stats(df: DataFrame, entity: str, by: Sequence[str] = ()) -> DataFrame:
    """Counts of an import as one row: total, duplicate and error rows; one row for each value of ``by``."""
    return _stats(_counted(df, by), entity, by)


def _stats(counted: DataFrame, entity: str, by: Sequence[str] = ()) -> DataFrame:
    total = F.coalesce(F.sum(COPIES), F.lit(0)).alias("total_rows")
    copies = F.coalesce(F.sum(F.col(COPIES) - 1), F.lit(0)).alias("duplicate_rows")
    if entity not in CLEANERS:
        errors = F.lit(0).cast("long")
    elif not require_columns(counted, REQUIRED[entity]):
        errors = F.count(F.lit(1))
    else:
        bad = null_key(ROW_KEYS[entity])
        if entity in NUMERIC_STORE:
            bad = bad | lenient_number("store_id").isNull()
        errors = F.count_if(bad)
    return counted.groupBy(*by).agg(total, copies, errors.alias("error_rows"))


def clean_rows(df: DataFrame, entity: str, by: Sequence[str] = ()) -> DataFrame:
    """Headers, empty rows, duplicates, key and column checks, then the entity's cleaner.

    An entity without a cleaner passes through after the duplicate check; a missing
    column rejects the whole batch. ``by`` names columns, such as the file, whose values are
    cleaned as imports of their own and stay on the rows.
    """
    # Fills read their input twice; the duplicates should be found once.
    return _rows(_written(df, entity, by) if entity in CLEANERS else _counted(df, by), entity, by)


def _written(df: DataFrame, entity: str, by: Sequence[str]) -> DataFrame:
    counted = _counted(df, by)
    return cut_lineage(coerce(counted, [c for c in NUMBERS.get(entity, []) if c in counted.columns]), "counted")


def _rows(counted: DataFrame, entity: str, by: Sequence[str] = ()) -> DataFrame:
    rows = counted.drop(COPIES)
    if entity not in CLEANERS:
        return rows
    if not require_columns(rows, REQUIRED[entity]):
        return rows.where(F.lit(False))
    return CLEANERS[entity](drop_null_keys(rows, ROW_KEYS[entity]), by)


def clean(df: DataFrame, entity: str, by: Sequence[str] = ()) -> Cleaned:
    """Clean rows and counts from one reading of ``df``."""
    counted = _written(df, entity, by)
    return Cleaned(_rows(counted, entity, by), _stats(counted, entity, by))


def with_folders(rows: DataFrame, entity: str) -> DataFrame:
    """Clean rows with the folder column that is no column of the feed."""
    if "store_group" not in FOLDERS.get(entity, []):
        return rows
    return rows.withColumn("store_group", F.pmod(F.xxhash64("store_id"), F.lit(STORE_GROUPS)).cast("int"))


def run_import(spark: SparkSession, path: str, entity: str, target: str, line_breaks: bool = True) -> dict[str, int]:
    """One import: read, clean, drop rows whose key is stored already, publish all or nothing. ``line_breaks`` as in ``read_feed``."""
    cleaned = clean(read_feed(spark, path, line_breaks), entity)
    rows = with_folders(cleaned.rows, entity)
    keys, folders = CONFLICT_KEYS.get(entity), FOLDERS.get(entity, [])
    if keys and set(keys) <= set(rows.columns):
        # Equal keys inside one file: the smallest row by its other columns stands for the first.
        rest = [c for c in rows.columns if c not in keys]
        least = rows.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_row"), F.count(F.lit(1)).alias(COPIES))
        rows = least.select(*keys, "_row.*", COPIES).select(*rows.columns, COPIES)
    else:
        rows = rows.withColumn(COPIES, F.lit(1).cast("long"))
    rows = cut_lineage(rows, f"clean-{entity}")
    kept = rows.drop(COPIES)
    if keys and hadoop.exists(spark, target):
        kept = cut_lineage(not_stored(stored_near(target, kept, keys, folders), kept, keys), f"fresh-{entity}")
    counts = cleaned.stats.first()
    clean_rows, inserted = rows.agg(F.coalesce(F.sum(COPIES), F.lit(0))).first()[0], kept.count()
    load_atomic(kept, target, keys, folders)
    return {
        "total_rows": counts["total_rows"],
        "processed_rows": counts["total_rows"],
        "success_rows": inserted,
        "conflict_rows": clean_rows - inserted,
        "error_rows": counts["error_rows"],
        "duplicate_rows": counts["duplicate_rows"],
    }
