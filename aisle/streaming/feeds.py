"""Live feeds in Structured Streaming.

State lives in the checkpoint, so sums survive a restart. Results go to parquet
batches by ``foreachBatch``; a repeated batch overwrites its own folder, which
makes every sink exactly-once. Nothing is gathered on the driver.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from aisle.functions.scalars import round_to
from aisle.operators import cleaning, port
from aisle.session import checkpoint_root, cut_lineage, deal, passing_tables, shuffles_dropped
from aisle.sources import hadoop
from aisle.sources.sinks import _keyed_writer, _read_like, not_stored, stored_near

WATERMARK = "10 minutes"
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def latest_state(readings: DataFrame) -> DataFrame:
    """Newest reading and running kWh per device (update mode)."""
    newest = F.max_by(F.struct("power_kw", "operational_state", "reading_time"), F.struct("reading_time", "id"))
    return readings.groupBy("equipment_id").agg(
        newest.alias("_r"), (F.sum(F.col("power_kw").cast("decimal(18,4)")).cast("double") / 3600).alias("cumulative_kwh")
    ).select("equipment_id", "_r.*", "cumulative_kwh")


def hourly_energy(readings: DataFrame) -> DataFrame:
    """Closed hours of all devices (append mode); the hour still open is not given out."""
    timed = readings.withColumn("reading_time", F.col("reading_time").cast("timestamp"))
    return (
        timed.withWatermark("reading_time", WATERMARK)
        .groupBy(F.window("reading_time", "1 hour"))
        .agg(F.count(F.lit(1)).alias("samples"), F.sum(F.col("power_kw").cast("decimal(18,4)")).cast("double").alias("power_sum"))
        .select(F.col("window.start").alias("metric_time"), "samples", "power_sum")
    )


def hourly_moves(events: DataFrame) -> DataFrame:
    """Containers seen and moves per closed hour, as (window, total_containers, throughput_teu) (append mode)."""
    timed = events.withColumn("event_time", F.col("event_time").cast("timestamp")).withWatermark("event_time", WATERMARK)
    # Each container once an hour, then the hours; distinct counts are not for streams.
    each = timed.groupBy(F.window("event_time", "1 hour"), "container_id").agg(F.count_if(F.col("event_type").isin(port.MOVES)).alias("_moves"))
    return each.groupBy("window").agg(F.count("container_id").alias("total_containers"), F.sum("_moves").alias("throughput_teu"))


def yard_hours(events: DataFrame, readings: DataFrame) -> DataFrame:
    """Containers seen, moves, utilisation and kWh per closed hour, from two live feeds (append mode).

    Each feed is folded per hour and the hours are joined, all of both. An hour is given out when the
    later of the two feeds has passed its end by the lateness allowed, so a feed that lags holds
    the hour back instead of leaving it half full.
    """
    timed = readings.withColumn("reading_time", F.col("reading_time").cast("timestamp")).withWatermark("reading_time", WATERMARK)
    metered = timed.groupBy(F.window("reading_time", "1 hour")).agg(
        round_to(F.count_if(F.col("operational_state") != "idle") * 100.0 / F.count(F.lit(1)), 4).alias("avg_utilization"),
        round_to(F.sum("energy_kwh"), 6).alias("total_energy_kwh"),
    )
    joined = hourly_moves(events).join(metered, "window", "full_outer")
    return joined.select(
        F.col("window.start").alias("metric_time"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total_containers", "throughput_teu", "avg_utilization", "total_energy_kwh")],
    )


def container_states(events: DataFrame) -> DataFrame:
    """Status of every container by event time (update mode)."""
    return events.groupBy("container_id").agg(*port.state_aggregates())


def peak_alarms(readings: DataFrame, equipment: DataFrame, share: float = 0.9) -> DataFrame:
    """Readings over a share of the device's rated power; stateless."""
    rated = equipment.select(F.col("id").alias("equipment_id"), "rated_power_kw")
    limit = F.col("rated_power_kw") * share
    return readings.join(rated, "equipment_id").where(F.col("power_kw") > limit).select(
        "store_id", "equipment_id", F.lit("peak_warning").alias("alert_type"), F.lit("warning").alias("alert_level"),
        F.col("power_kw").alias("metric_value"), limit.alias("threshold_value"), F.col("reading_time").alias("alert_time"),
    )


@contextmanager
def _state_store(spark: SparkSession, keyed: bool) -> Iterator[None]:
    """Keyed state with timers lives in RocksDB; a query keeps the store that is set when it starts."""
    if not keyed:
        yield
        return
    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, ROCKS_DB)
    try:
        yield
    finally:
        spark.conf.unset(STATE_STORE) if before is None else spark.conf.set(STATE_STORE, before)


def run_available(
    stream: DataFrame, write_batch: Callable[[DataFrame, int], None], mode: str = "append", checkpoint: str | None = None,
    keyed: bool = False,
) -> StreamingQuery:
    """Work off everything that is there and stop; ``keyed`` for streams with keyed state of their own."""
    place = checkpoint or f"{checkpoint_root(stream.sparkSession)}/stream-{uuid.uuid4().hex}"
    with _state_store(stream.sparkSession, keyed):
        query = (
            stream.writeStream.outputMode(mode)
            .option("checkpointLocation", place)
            .trigger(availableNow=True)
            .foreachBatch(write_batch)
            .start()
        )
        query.awaitTermination()
    return query


def batch_folder(path: str) -> Callable[[DataFrame, int], None]:
    def write(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def collect_stream(stream: DataFrame, mode: str = "append", keys: list[str] | None = None, keyed: bool = False) -> DataFrame:
    """Result of a drained stream as a batch table; with ``keys`` the newest version of each row."""
    spark = stream.sparkSession
    path = f"{checkpoint_root(spark)}/stream-out-{uuid.uuid4().hex}"
    run_available(stream, batch_folder(path), mode, keyed=keyed)
    stored = spark.read.parquet(path)
    if keys is None:
        return stored.drop("batch")
    payload = F.struct(*[c for c in stored.columns if c not in (*keys, "batch")])
    return stored.groupBy(*keys).agg(F.max_by(payload, "batch").alias("_row")).select(*keys, "_row.*")


def stream_sequence_gaps(ticks: DataFrame, root: str, checkpoint: str | None = None, silence: str = "7 days") -> None:
    """Ticks after which numbers are missing, under ``root/gaps``.

    The last tick of every source is written per batch and heads the next one. The
    gaps of a batch come from the bucketed lag, so a source with very many ticks
    is spread over its hours. A source that was silent for longer than ``silence`` starts anew,
    so what is kept of it ends: its last tick goes once twice that time has passed.
    """
    spark = ticks.sparkSession
    columns = ["source_id", "seq", "received_at"]
    pause = F.expr(f"interval {silence}")

    def find(df: DataFrame, batch_id: int) -> None:
        rows = df.select(*columns)
        before = f"{root}/last/batch={batch_id - 1}"
        if hadoop.exists(spark, before):
            known = _read_like(before, df.select(*columns))
            rows = rows.unionByName(known)
        rows = cut_lineage(rows)
        gaps = port.sequence_gaps(rows, silence=silence)
        gaps.write.mode("overwrite").parquet(f"{root}/gaps/batch={batch_id}")
        last = rows.groupBy("source_id").agg(F.max(F.struct("received_at", "seq")).alias("_l"))
        newest = rows.agg(F.max("received_at").alias("_newest"))
        last = last.join(F.broadcast(newest)).where(F.col("_l.received_at") >= F.col("_newest") - pause - pause)
        last.select("source_id", "_l.seq", "_l.received_at").write.mode("overwrite").parquet(
            f"{root}/last/batch={batch_id}"
        )

    run_available(ticks, find, "append", checkpoint)


#: Columns that name the import a row belongs to: its file, and when that arrived.
FILE, ARRIVED = "_file", "_arrived"


def stream_import(
    spark: SparkSession, stream: DataFrame, entity: str, target: str, checkpoint: str | None = None
) -> None:
    """Clean and load dropped files as they come, each file as one import; known keys are skipped.

    Interpolation, duplicates and counts stay inside a file, and of equal keys the one of the file
    that arrived first is kept, so how many files a micro-batch takes changes nothing. ``imports`` lists
    the files with their counts, ``imported`` the rows of listed files.

    A batch owns the folder ``batch=<id>``: when it is repeated after a failure it looks only
    at the folders of other batches and writes its own again. The list of its files is written last.
    """
    keys, folders = cleaning.CONFLICT_KEYS[entity], cleaning.FOLDERS[entity]
    unit = [FILE, ARRIVED]
    named = stream.select("*", F.col("_metadata.file_path").alias(FILE), F.col("_metadata.file_modification_time").alias(ARRIVED))

    def load(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        count = lambda rows, name: rows.groupBy(*unit).agg(F.count(F.lit(1)).alias(name))
        # Each table on the way goes as soon as the next one is written, so two of them lie on disk at a time.
        with passing_tables(spark, "import") as kept:
            with passing_tables(spark, "clean") as held:
                with passing_tables(spark, "counted"):
                    cleaned = cleaning.clean(df, entity, unit)
                    rows = cut_lineage(cleaning.with_folders(cleaned.rows, entity), "clean", held)
                    stats = cut_lineage(cleaned.stats, "stats", kept)
                # The row of the first file, of equal keys in it the least one. Nearly every key has one row, so nothing is combined before the shuffle.
                rest = [c for c in rows.columns if c not in (*keys, *unit)]
                first = deal(rows, *keys).groupBy(*keys).agg(F.min(F.struct(ARRIVED, FILE, *rest)).alias("_row"))
                first = first.select(*keys, "_row.*").select(*rows.columns)
                if hadoop.exists(spark, target):
                    first = not_stored(stored_near(target, rows, keys, folders, F.col("batch") != str(batch_id)), first, keys)
                fresh = cut_lineage(first, "fresh", kept)
                listed = cut_lineage(stats.join(count(rows, "clean_rows"), unit, "left"), "listed", kept)
            with shuffles_dropped(spark):
                _keyed_writer(fresh, keys, folders).mode("overwrite").parquet(f"{target}/batch={batch_id}")
            listed = listed.join(count(fresh, "success_rows"), unit, "left").fillna(0, ["clean_rows", "success_rows"])
            listed = listed.withColumn("conflict_rows", F.col("clean_rows") - F.col("success_rows")).drop("clean_rows")
            listed.write.mode("overwrite").parquet(f"{_files_of(target)}/batch={batch_id}")

    run_available(named, load, "append", checkpoint)


def _files_of(target: str) -> str:
    return f"{target.rstrip('/')}_files"


def imports(spark: SparkSession, target: str) -> DataFrame:
    """One row per imported file: total, duplicate, error, success and conflict rows."""
    return spark.read.parquet(_files_of(target))


def imported(spark: SparkSession, target: str) -> DataFrame:
    """Rows of files that are wholly imported."""
    whole = spark.read.parquet(target).join(imports(spark, target).select("batch").distinct(), "batch", "left_semi")
    return whole.drop("batch", ARRIVED, "store_group")
