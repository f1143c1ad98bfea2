"""File feeds: CSV imports, competitor lists and the meter stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROKEN = "_broken_line"


def read_feed(spark: SparkSession, path: str, line_breaks: bool = True) -> DataFrame:
    """CSV with a header as strings, plus ``_file``.

    Quoted fields may hold commas, doubled quotes and line breaks. A file whose fields may
    hold line breaks is read by one task; a feed declared without them (``line_breaks``
    false) is split.

    Short lines are filled with nulls. Lines with more fields than the header are
    skipped. Only a line that does not have the header's length is looked at again: with one field
    added a line of exactly that length parses cleanly and a longer one fills the added field.
    """
    names = spark.read.options(header=True, escape='"', multiLine=line_breaks).csv(path).columns
    fields = names or ["_no_field"]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in fields] + [T.StructField(BROKEN, T.StringType())])
    lines = (
        spark.read.schema(schema)
        .options(header=True, escape='"', multiLine=line_breaks)
        .option("encoding", "UTF-8")
        .option("mode", "PERMISSIVE")
        # Whether a line is too long shows only when all its fields are parsed, also where a count needs none of them.
        .option("columnPruning", False)
        .option("columnNameOfCorruptRecord", BROKEN)
        .csv(path)
        .withColumn("_file", F.col("_metadata.file_path"))
    )
    # Spark reads no file for the broken line alone, so a count needs a field too.
    line = F.coalesce(F.col(BROKEN), F.col(fields[0]))
    return lines.where(F.when(F.col(BROKEN).isNotNull(), _not_longer(line, len(fields))).otherwise(True)).select(*names, "_file")


def _not_longer(line: Column, n: int) -> Column:
    """Whether a line that is not ``n`` fields long has fewer."""
    fields = ", ".join(f"f{i} string" for i in range(n + 1))
    options = {"escape": '"', "mode": "PERMISSIVE", "columnPruning": "false", "columnNameOfCorruptRecord": BROKEN}
    parsed = F.from_csv(line, f"{fields}, {BROKEN} string", options)
    return parsed[BROKEN].isNotNull() & parsed[f"f{n}"].isNull()


def read_competitors(spark: SparkSession, path: str, line_breaks: bool = True) -> DataFrame:
    """Competitor list: ``name`` is required as a column, everything else may be missing. ``line_breaks`` as in ``read_feed``."""
    feed = read_feed(spark, path, line_breaks)
    if "name" not in feed.columns:
        raise ValueError("the file needs a name column")
    for missing in ("brand", "category", "latitude", "longitude", "city", "district", "estimated_revenue"):
        if missing not in feed.columns:
            feed = feed.withColumn(missing, F.lit(None).cast("string"))
    number = lambda c: F.col(c).try_cast("double").alias(c)
    return feed.select(
        "name", "brand", "category", number("latitude"), number("longitude"), "city", "district",
        number("estimated_revenue"), F.element_at(F.split("_file", "/"), -1).alias("data_source"),
    )


READINGS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("store_id", T.LongType()),
        T.StructField("equipment_id", T.LongType()),
        T.StructField("reading_time", T.TimestampType()),
        T.StructField("power_kw", T.DoubleType()),
        T.StructField("energy_kwh", T.DoubleType()),
        T.StructField("operational_state", T.StringType()),
    ]
)


def stream_readings(spark: SparkSession, directory: str, files_per_batch: int | None = None) -> DataFrame:
    """Meter readings as files arrive."""
    reader = spark.readStream.schema(READINGS)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(directory)
