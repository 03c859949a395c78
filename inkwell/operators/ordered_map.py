"""A sorted map with distinct keys as a DataFrame of (key, value).

Order is made when it is read; keys compare by their UTF-8 bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .matching import intersect_documents, intersect_rows

__all__ = ["empty", "length", "is_empty", "put", "get", "remove", "scan", "scan_from", "scan_prefix", "update", "intersect_documents", "intersect_rows"]


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "key string, value string")


def length(entries: DataFrame) -> int:
    return entries.count()


def is_empty(entries: DataFrame) -> bool:
    return entries.isEmpty()


def put(entries: DataFrame, new: DataFrame, order: Column | None = None) -> DataFrame:
    """entries with those of new in place of what had their keys.

    Where new has a key several times, the row that is last by order wins; by
    default that of the greatest value.
    """
    by = Window.partitionBy("key").orderBy((order if order is not None else F.col("value")).desc())
    last = new.withColumn("_n", F.row_number().over(by)).where("_n = 1").select(*entries.columns)
    return entries.join(last.select("key"), "key", "left_anti").select(*entries.columns).unionByName(last)


def get(entries: DataFrame, key: str) -> DataFrame:
    """The entry of the key, or no row."""
    return entries.where(F.col("key") == key)


def update(entries: DataFrame, key: str, value: Column) -> DataFrame:
    """entries with the key's value replaced; an unknown key changes nothing."""
    return entries.withColumn("value", F.when(F.col("key") == key, value).otherwise(F.col("value")))


def remove(entries: DataFrame, keys: DataFrame) -> DataFrame:
    """entries without those whose keys are in the first column; unknown keys change nothing."""
    return entries.join(keys.select(F.col(keys.columns[0]).alias("key")), "key", "left_anti")


def scan(entries: DataFrame) -> DataFrame:
    return entries.orderBy("key")


def scan_from(entries: DataFrame, key: str) -> DataFrame:
    """The entries from an existing key on, in order; none where the key isn't there."""
    there = entries.where(F.col("key") == key).select("key").distinct().withColumnRenamed("key", "_from")
    return entries.where(F.col("key") >= key).join(F.broadcast(there), F.col("key") >= F.col("_from")).drop("_from").orderBy("key")


def scan_prefix(entries: DataFrame, prefix: str) -> DataFrame:
    """The entries whose keys begin with the prefix, in order."""
    return entries.where(F.col("key").startswith(prefix)).orderBy("key")
