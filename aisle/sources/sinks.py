"""Writes: insert-if-absent, upsert, slice replacement, append, CSV and atomic load.

Parquet has no MERGE. Upserts and slice replacement rewrite only the partitions
they touch, through a written intermediate, so a lost executor never leaves the
table half read and half written.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, DataFrameWriter
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from aisle.session import cut_lineage
from aisle.sources import hadoop


def merge_rows(target: DataFrame, updates: DataFrame, keys: list[str], update_cols: list[str]) -> DataFrame:
    """Target after an upsert: known keys refresh ``update_cols`` only, new keys are added.

    Updates must hold one row per key. Keys compare null-safe.
    """
    t, u = target.alias("t"), updates.alias("u")
    known, new = F.col("t._t"), F.col("u._u")
    on = [F.col(f"t.{k}").eqNullSafe(F.col(f"u.{k}")) for k in keys]
    joined = t.withColumn("_t", F.lit(True)).alias("t").join(
        u.withColumn("_u", F.lit(True)).alias("u"), on, "full_outer"
    )
    columns = []
    for name in target.columns:
        if name not in updates.columns:
            value = F.col(f"t.{name}")
        elif name in keys or name not in update_cols:
            value = F.when(known, F.col(f"t.{name}")).otherwise(F.col(f"u.{name}"))
        else:
            value = F.when(new, F.col(f"u.{name}")).otherwise(F.col(f"t.{name}"))
        columns.append(value.alias(name))
    return joined.select(*columns)


def first_per_key(batch: DataFrame, keys: list[str], order: list) -> DataFrame:
    """First row per key by map-side combined min_by, however often a key is repeated."""
    payload = F.struct(*[F.col(c) for c in batch.columns if c not in keys])
    return batch.groupBy(*keys).agg(F.min_by(payload, F.struct(*order)).alias("_row")).select(*keys, "_row.*").select(
        *batch.columns
    )


def not_stored(stored: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    return batch.join(stored.select(*keys), keys, "left_anti")


def absent_rows(target: DataFrame, batch: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Batch rows whose key is new; of equal keys in the batch the first by ``order``."""
    return not_stored(target, first_per_key(batch, keys, order), keys)


def _read_like(path: str, df: DataFrame) -> DataFrame:
    """Stored table with the types of ``df``; partition folder names are not guessed."""
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)


def _keyed_writer(df: DataFrame, keys: Sequence[str], folders: Sequence[str]) -> DataFrameWriter:
    """Rows by folder, sorted by key inside files, with Bloom filters on the key columns that are no folders.

    Row groups then have narrow key ranges, and readers skip those that cannot hold what they look for.
    """
    inner = [k for k in keys if k not in folders]
    rows = df.hint("rebalance", *folders) if folders else df
    writer = (rows.sortWithinPartitions(*folders, *inner) if keys else rows).write
    for k in inner:
        writer = writer.option(f"parquet.bloom.filter.enabled#{k}", "true")
    # Each filter gets the size that its keys need.
    writer = writer.option("parquet.bloom.filter.adaptive.enabled", "true")
    return writer.partitionBy(*folders) if folders else writer


def stored_near(path: str, batch: DataFrame, keys: Sequence[str], folders: Sequence[str], but: Column | None = None) -> DataFrame:
    """Stored keys that may equal one of ``batch``: only its folders are listed, only row groups in its key ranges are read.

    ``folders`` must be key columns or follow from them, and stand in ``batch``. Their different values in the batch, at most as many as the table has folders of
    interest to it, come to the driver as filter literals, with one least and greatest value for each other key column.
    ``but`` leaves stored rows out.
    """
    spark = batch.sparkSession
    inner = [k for k in keys if k not in folders]
    ends = [f(k).alias(f"{name}_{k}") for k in inner for name, f in (("low", F.min), ("high", F.max))]
    found = batch.agg(F.count(F.lit(1)).alias("n"), *ends, *[F.collect_set(f).alias(f"in_{f}") for f in folders]).first()
    fields = [batch.schema[k] for k in dict.fromkeys([*keys, *folders])]
    stored = spark.read.schema(StructType([*fields, *([StructField("batch", StringType())] if but is not None else [])])).parquet(path)
    if but is not None:
        stored = stored.where(but)
    stored = stored.select(*keys)
    if not found["n"]:
        return stored.where(F.lit(False))
    for f in folders:
        stored = stored.where(F.col(f).isin(found[f"in_{f}"]))
    for k in inner:
        if found[f"low_{k}"] is not None:
            stored = stored.where(F.col(k).between(F.lit(found[f"low_{k}"]), F.lit(found[f"high_{k}"])))
    return stored


def absent_from(
    path: str, batch: DataFrame, keys: list[str], order: list, folders: Sequence[str] = (), but: Column | None = None
) -> DataFrame:
    """Batch rows whose key is not stored under ``path``, one row per key; see ``stored_near``."""
    if not hadoop.exists(batch.sparkSession, path):
        return first_per_key(batch, keys, order)
    return absent_rows(stored_near(path, batch, keys, folders, but), batch, keys, order)


def append_facts(df: DataFrame, path: str, partition_by: Sequence[str] = (), keys: Sequence[str] = ()) -> None:
    _keyed_writer(df, keys, partition_by).mode("append").parquet(path) if keys else (
        df.write.partitionBy(*partition_by) if partition_by else df.write
    ).mode("append").parquet(path)


def insert_if_absent(path: str, batch: DataFrame, keys: list[str], order: list, partition_by: list[str] | None = None) -> dict[str, int]:
    """Append the rows with new keys; first writer wins. Returns inserted and conflict counts.

    Folders that are key columns prune what is read of the stored rows; see ``stored_near``.
    """
    rows = cut_lineage(batch, "insert")
    folders = [c for c in partition_by or [] if c in keys]
    kept = cut_lineage(absent_from(path, rows, keys, order, folders), "fresh")
    total, inserted = rows.count(), kept.count()
    append_facts(kept, path, partition_by or [], keys)
    return {"inserted": inserted, "conflicts": total - inserted}


def _overwrite_partitions(df: DataFrame, path: str, partition_by: list[str]) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)


def _touching(target: DataFrame, touched: DataFrame, partition_by: list[str]) -> DataFrame:
    on = [target[c].eqNullSafe(touched[c]) for c in partition_by]
    return target.join(touched, on, "left_semi")


def upsert(path: str, updates: DataFrame, keys: list[str], update_cols: list[str], partition_by: list[str]) -> None:
    """Last writer wins on the key; only partitions named in the updates are rewritten.

    The partition columns must be part of the key, so that a row never moves. Stored columns
    that the updates lack stay as they are; updates with a column that is not stored are refused.
    """
    if not set(partition_by) <= set(keys):
        raise ValueError("partition columns must belong to the key")
    spark = updates.sparkSession
    if not hadoop.exists(spark, path):
        append_facts(updates, path, partition_by)
        return
    rows = cut_lineage(updates, "upsert")
    if _read_like(path, rows.select(*partition_by)).isEmpty():
        append_facts(rows, path, partition_by)
        return
    # Types of partition columns come from the updates, as folder names do not tell them.
    stored = spark.read.parquet(path).schema
    schema = StructType([rows.schema[f.name] if f.name in partition_by else f for f in stored])
    if unknown := set(rows.columns) - set(schema.names):
        raise ValueError(f"columns that the table does not have: {sorted(unknown)}")
    rows = rows.select(*[F.col(c).cast(schema[c].dataType).alias(c) for c in rows.columns])
    target = spark.read.schema(schema).parquet(path)
    old = _touching(target, rows.select(*partition_by).distinct(), partition_by)
    merged = cut_lineage(merge_rows(old, rows, keys, update_cols), "merged")
    _overwrite_partitions(merged, path, partition_by)


def replace_slice(path: str, new: DataFrame, slice_cols: list[str], slices: DataFrame | None = None) -> None:
    """Put ``new`` in place of the stored rows of its slices; a null slice value is its own slice.

    ``slices`` names slices to clear even where ``new`` has no row for them.
    """
    spark = new.sparkSession
    staged = cut_lineage(new, "slice")
    if not hadoop.exists(spark, path):
        append_facts(staged, path, slice_cols)
        return
    _overwrite_partitions(staged, path, slice_cols)
    if slices is not None:
        on = [slices[c].eqNullSafe(staged[c]) for c in slice_cols]
        gone = slices.select(*slice_cols).distinct().join(staged.select(*slice_cols).distinct(), on, "left_anti")
        # The folders are those that the stored rows lie in, however their names are escaped.
        folder = F.regexp_replace("_metadata.file_path", "/[^/]*$", "").alias("_folder")
        stored = spark.read.schema(staged.schema).parquet(path).select(*slice_cols, folder).distinct()
        cleared = _touching(stored, gone, slice_cols).select("_folder").distinct()
        hadoop.delete_uris(spark, [row["_folder"] for row in cleared.toLocalIterator()])


def export_csv(df: DataFrame, path: str) -> None:
    """Report files with a header line, one per partition; quotes inside fields are doubled."""
    df.write.mode("overwrite").options(header=True, escape='"').csv(path)


def load_atomic(batch: DataFrame, path: str, keys: Sequence[str] | None = None, folders: Sequence[str] = ()) -> None:
    """All rows or none: the files are complete in a staging folder before one rename shows them.

    The rename is a single call of the file system; a reader sees the batch folder whole or not at all.
    """
    spark = batch.sparkSession
    name = f"batch={uuid.uuid4().hex}"
    staging = f"{path.rstrip('/')}/_staging-{name}"
    _keyed_writer(batch, keys or [], folders).parquet(staging)
    if not hadoop.rename(spark, staging, f"{path.rstrip('/')}/{name}"):
        raise OSError(f"could not publish {staging}")
