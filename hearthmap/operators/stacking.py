"""Stacking and column clean-up."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame

from hearthmap.constants import INDEX_COLUMNS


def bind_rows(*frames: DataFrame) -> DataFrame:
    """Union all by name; columns missing on one side are NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def stack_rows(*frames: DataFrame) -> DataFrame:
    """Union all by name; raises unless all sides have the same columns."""
    expected = set(frames[0].columns)
    for f in frames[1:]:
        if set(f.columns) != expected:
            raise ValueError(f"column sets differ: {sorted(expected ^ set(f.columns))}")
    return reduce(lambda a, b: a.unionByName(b), frames)


def drop_index(df: DataFrame) -> DataFrame:
    """Remove row-name columns left by a CSV export."""
    return df.drop(*INDEX_COLUMNS)


def drop_range(df: DataFrame, first: str, last: str) -> DataFrame:
    """Drop the columns from ``first`` to ``last`` in table order, both included."""
    start, end = df.columns.index(first), df.columns.index(last)
    return df.drop(*df.columns[start : end + 1])


def rename_at(df: DataFrame, names: dict[int, str]) -> DataFrame:
    """Rename columns by 1-based position."""
    return df.toDF(*[names.get(i, c) for i, c in enumerate(df.columns, start=1)])
