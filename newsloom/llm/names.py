"""Names that no column has, and ids of whole numbers."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame

_WHOLE = ("tinyint", "smallint", "int", "bigint")


def fresh(columns: Iterable[str], stem: str) -> str:
    """A name like `stem` that is none of the columns, whatever their case."""
    taken, name = {c.lower() for c in columns}, f"__{stem}"
    while name.lower() in taken:
        name += "_"
    return name


def whole_ids(table: DataFrame, *columns: str) -> None:
    """TypeError unless these id columns hold whole numbers (or nothing but nulls)."""
    for column in columns:
        kind = table.select(f"`{column}`").dtypes[0][1]
        if kind not in _WHOLE and kind != "void" and not (kind.startswith("decimal") and kind.endswith(",0)")):
            raise TypeError(f"ids are whole numbers; column {column} is {kind}")
