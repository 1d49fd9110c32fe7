"""The store's constraints as queries for rows that break them (none expected)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def domain(rows: DataFrame, name: str, column: str, values: list[str]) -> DataFrame:
    """Values outside a fixed list."""
    bad = F.col(column).isNotNull() & ~F.col(column).isin(values)
    return rows.where(bad).groupBy(F.lit(name).alias("rule"), F.col(column).cast("string").alias("value")).agg(F.count("*").alias("rows"))


def unique(rows: DataFrame, name: str, keys: list[str]) -> DataFrame:
    repeated = rows.groupBy(*keys).agg(F.count("*").alias("rows")).where("rows > 1")
    return repeated.select(F.lit(name).alias("rule"), F.concat_ws(",", *keys).alias("value"), "rows")


def foreign_key(rows: DataFrame, name: str, column: str, parents: DataFrame, parent: str) -> DataFrame:
    orphans = rows.where(F.col(column).isNotNull()).join(parents.select(F.col(parent).alias(column)), column, "left_anti")
    return orphans.groupBy(F.lit(name).alias("rule"), F.col(column).cast("string").alias("value")).agg(F.count("*").alias("rows"))


def check(rows: DataFrame, name: str, holds: Column, value: Column) -> DataFrame:
    """Rows for which the condition is false (null passes, as in SQL)."""
    return rows.where(~holds).groupBy(F.lit(name).alias("rule"), value.cast("string").alias("value")).agg(F.count("*").alias("rows"))


def partial_date_parts() -> Column:
    """Known parts match the precision."""
    y, m, d, p = (F.col(c) for c in ("year", "month", "day", "precision"))
    return F.when(p == "day", y.isNotNull() & m.isNotNull() & d.isNotNull()).when(p == "month", y.isNotNull() & m.isNotNull() & d.isNull()).when(p == "year", y.isNotNull() & m.isNull() & d.isNull()).otherwise(y.isNull() & m.isNull() & d.isNull())


def partial_date_range() -> Column:
    return F.coalesce(F.col("month").between(1, 12), F.lit(True)) & F.coalesce(F.col("day").between(1, 31), F.lit(True))


def cascade(children: DataFrame, column: str, gone: DataFrame, parent: str) -> DataFrame:
    """Children left after their parents are deleted."""
    return children.join(gone.select(F.col(parent).alias(column)), column, "left_anti")


def together(*found: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, found)
