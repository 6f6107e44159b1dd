"""Null-aware scalar and aggregate expressions.

Policy: a missing value is NULL, never NaN; division by zero gives NULL.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strict_sum(c: Column | str) -> Column:
    """Sum that is NULL as soon as one input is NULL; an empty input sums to 0."""
    c = as_col(c)
    return F.when(F.count(c) == F.count(F.lit(1)), F.coalesce(F.sum(c), F.lit(0)))


def lenient_sum(c: Column | str) -> Column:
    """Sum that skips NULLs; all-NULL sums to 0."""
    return F.coalesce(F.sum(as_col(c)), F.lit(0))


def ratio(numerator: Column | str, denominator: Column | str) -> Column:
    """Double division; a zero denominator gives NULL."""
    return F.try_divide(as_col(numerator).cast("double"), as_col(denominator).cast("double"))


def to_number(c: Column | str) -> Column:
    """Text to double; anything unreadable becomes NULL."""
    number = as_col(c).try_cast("double")
    return F.when(~F.isnan(number), number)


def not_in_keep_null(c: Column | str, values: Iterable) -> Column:
    """NOT IN that keeps rows whose value is NULL."""
    return ~F.coalesce(as_col(c).isin(list(values)), F.lit(False))


def in_or_false(c: Column | str, values: Iterable) -> Column:
    """IN that is never NULL."""
    return F.coalesce(as_col(c).isin(list(values)), F.lit(False))


def dash_to_zero(c: Column | str) -> Column:
    """The sheet sentinel '-' stands for zero."""
    c = as_col(c)
    return F.when(c == "-", F.lit("0")).otherwise(c)


def drop_suffix(c: Column | str, length: int) -> Column:
    """Text without its last ``length`` characters; '' when it is shorter."""
    c = as_col(c)
    return F.substring(c, F.lit(1), F.length(c) - F.lit(length))


def ordered_level(c: Column | str, levels: list[str]) -> Column:
    """Ordered category: values outside ``levels`` become NULL."""
    c = as_col(c)
    return F.when(c.isin(levels), c)


def level_rank(c: Column | str, levels: list[str]) -> Column:
    """1-based position of a category in its level order, NULL outside it."""
    rank = F.array_position(F.array(*[F.lit(v) for v in levels]), as_col(c))
    return F.when(rank > 0, rank.cast("int"))


def listed(c: Column | str, values: list, what: str) -> Column:
    """The value itself; a value outside the list, NULL included, raises when the rows are read."""
    c = as_col(c)
    shown = F.coalesce(c.cast("string"), F.lit("NULL"))
    unlisted = F.raise_error(F.concat(F.lit(f"{what} has a value outside its list: "), shown))
    return F.when(c.isin(*values), c).otherwise(unlisted)
