"""Positional samples of ordered lists, and batches of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def placed(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """rows with their position (from 0) in the key's list and its length."""
    w = Window.partitionBy(key)
    return rows.withColumn("position", F.row_number().over(w.orderBy(*order)) - 1).withColumn("n", F.count("*").over(w))


def representative(rows: DataFrame, key: str, order: list[Column], limit: int = 8) -> DataFrame:
    """The first `limit` rows of each key."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("position", F.row_number().over(w)).where(F.col("position") <= limit)


def first_latest(rows: DataFrame, limit: int) -> DataFrame:
    """The first half and the last of a placed list; lists up to limit stay whole."""
    head = limit // 2
    return rows.where((F.col("n") <= limit) | (F.col("position") < head) | (F.col("position") >= F.col("n") - (limit - head)))


def lifecycle_positions(n: Column, limit: int) -> Column:
    """0, n - 1 and evenly spread places between them, ties to even."""
    inner = F.transform(F.sequence(F.lit(1), F.lit(limit - 2)), lambda i: F.bround(i * (n - 1) / (limit - 1)).cast("int"))
    return F.array_distinct(F.concat(F.array(F.lit(0), (n - 1).cast("int")), inner))


def lifecycle(rows: DataFrame, limit: int) -> DataFrame:
    if limit < 3:
        raise ValueError("a lifecycle sample has three places at least")
    return rows.where((F.col("n") <= limit) | F.array_contains(lifecycle_positions(F.col("n"), limit), F.col("position")))


def batches(rows: DataFrame, size: int = 20) -> DataFrame:
    return rows.withColumn("batch", F.floor(F.col("position") / size).cast("int"))
