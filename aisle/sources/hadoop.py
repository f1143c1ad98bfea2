"""Calls of the Hadoop file system that Spark reads and writes with."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import SparkSession


def _path(spark: SparkSession, place: str):
    return spark._jvm.org.apache.hadoop.fs.Path(place)


def _system(spark: SparkSession, path):
    return path.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, place: str) -> bool:
    path = _path(spark, place)
    return _system(spark, path).exists(path)


def rename(spark: SparkSession, place: str, goal: str) -> bool:
    path = _path(spark, place)
    return _system(spark, path).rename(path, _path(spark, goal))


def delete(spark: SparkSession, place: str) -> bool:
    path = _path(spark, place)
    return _system(spark, path).delete(path, True)


def delete_uris(spark: SparkSession, uris: Iterable[str]) -> None:
    """Folders by their escaped names, as ``_metadata.file_path`` gives them."""
    for uri in uris:
        path = _path(spark, spark._jvm.java.net.URI(uri))
        _system(spark, path).delete(path, True)
