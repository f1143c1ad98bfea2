"""Session settings and lineage cutting."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

from aisle.sources import hadoop

CHECKPOINT_CONF = "spark.checkpoint.dir"
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_PLACE: ContextVar[str | None] = ContextVar("place", default=None)


def local_session(app: str = "aisle", cpus: int | None = None, **conf: str) -> SparkSession:
    """Single-node session for tests and benchmarks; clusters bring their own."""
    cpus = cpus or os.cpu_count() or 4
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for written intermediates.

    The cluster names it in ``spark.checkpoint.dir``. A machine-local folder is
    only made for a local master, where driver and executors share the disk.
    """
    configured = spark.conf.get(CHECKPOINT_CONF, None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder shared by all executors")
    root = tempfile.mkdtemp(prefix="aisle-checkpoint-")
    spark.conf.set(CHECKPOINT_CONF, root)
    return root


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What is run inside drops its shuffle files at its end; otherwise they lie until the driver collects its garbage."""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP) if before is None else spark.conf.set(SHUFFLE_CLEANUP, before)


@contextmanager
def passing_tables(spark: SparkSession, label: str) -> Iterator[str]:
    """A spare folder for tables that are read for the last time inside; it goes at the end, also after a failure.

    ``cut_lineage`` writes to the innermost one of its thread unless it is given a folder.
    """
    place = f"{checkpoint_root(spark)}/{label}-{uuid.uuid4().hex}"
    token = _PLACE.set(place)
    try:
        yield place
    finally:
        _PLACE.reset(token)
        hadoop.delete(spark, place)


def cut_lineage(df: DataFrame, label: str = "cut", place: str | None = None) -> DataFrame:
    """Write the rows to the shared folder, or to ``place`` in it, and read them back.

    The result survives the loss of any executor, is computed once however often it
    is used, and has a known size, so Spark can choose joins by it. The shuffles before it go when it is written.
    """
    path = f"{place or _PLACE.get() or checkpoint_root(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    with shuffles_dropped(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def deal(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by key to as many tasks as there are shuffle partitions, before they are aggregated.

    Where nearly every row is a group of its own, hash maps in front of the shuffle hold whole file splits and save nothing.
    The number is given, so adaptive execution does not put small partitions together: it goes by compressed bytes, while
    the maps of such groups take many times that.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
