"""Loops over outer axes are key columns; stacking puts them back in place."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def for_each(table: DataFrame, axes: Sequence[str], n: int = 1) -> tuple[DataFrame, list[str]]:
    """The table and the key columns that a body of the loop carries: the first ``n`` axes."""
    if not 1 <= n <= len(axes):
        raise ValueError(f"{n} axes can't be taken from {list(axes)}")
    return table, list(axes[:n])


def stack(table: DataFrame, keys: Sequence[str], order: str = "prepend") -> DataFrame:
    """The table with its key columns first or last."""
    if order not in ("prepend", "append"):
        raise ValueError("order must be prepend or append")
    rest = [c for c in table.columns if c not in keys]
    return table.select(*((*keys, *rest) if order == "prepend" else (*rest, *keys)))


def extents(table: DataFrame, axes: Sequence[str]) -> DataFrame:
    """(axis, size): how many values each axis has, exactly."""
    return table.agg(*(F.count_distinct(a).alias(a) for a in axes)).unpivot([], list(axes), "axis", "size")


def dense_rows(table: DataFrame, keys: Sequence[str], axis: str, value: str = "value") -> DataFrame:
    """(keys, values): each key's values as one array in the order of the axis."""
    pair = F.sort_array(F.collect_list(F.struct(axis, value)))
    return table.groupBy(*keys).agg(F.transform(pair, lambda p: p[value]).alias("values"))
