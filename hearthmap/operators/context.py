"""Contextual indicators per small area."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from hearthmap.functions.joins import group_totals
from hearthmap.functions.nulls import lenient_sum, ratio, strict_sum, to_number
from hearthmap.operators.apportion import join_practice_values
from hearthmap.operators.reshape import wide_counts


def practice_prevalence(sheet: DataFrame, cases: str, people: str) -> DataFrame:
    """Practice-level prevalence from text counts."""
    return sheet.withColumn("practice_prevalence", ratio(to_number(cases), to_number(people)))


def area_prevalence(
    registrations: DataFrame,
    sheet: DataFrame,
    *,
    practice: str = "practice",
    area: str = "area",
    patients: str = "patients",
    cases: str = "cases",
    people: str = "people",
) -> DataFrame:
    """Practice cases and population spread to areas; prevalence is the ratio of the sums."""
    counts = sheet.select(
        F.col(practice).alias("_practice"),
        to_number(cases).alias("_cases"),
        to_number(people).alias("_people"),
    )
    rows = join_practice_values(
        registrations.select(practice, area, patients), counts, practice, patients
    ).fillna(0.0, subset=["_cases", "_people"])
    return (
        rows.groupBy(area)
        .agg(
            lenient_sum(F.col("_cases") * F.col("_share")).cast("double").alias(cases),
            lenient_sum(F.col("_people") * F.col("_share")).cast("double").alias(people),
        )
        .withColumn("prevalence", ratio(cases, people))
    )


def overcrowding_rate(
    sheet: DataFrame, *, area: str, occupancy: list[str], worst: str
) -> DataFrame:
    """Share of worst-occupancy households among all households of the area.

    Household columns are text; the total runs over all rows of an area and all columns and is
    NULL when any of them is unreadable.
    """
    numbers = {f"_h{i}": to_number(F.col(f"`{c}`")) for i, c in enumerate(occupancy)}
    readable = sheet.withColumns(numbers)
    total: Column = reduce(Column.__add__, [strict_sum(n) for n in numbers])
    return (
        group_totals(readable, [area], {"total_households": total.cast("double")})
        .withColumn("overcrowding_rate", ratio(f"_h{occupancy.index(worst)}", "total_households"))
        .drop(*numbers)
    )


def category_counts_wide(
    df: DataFrame, *, area: str, category: str, count: str, categories: list[str] | None = None
) -> DataFrame:
    """Counts per area and category, one column per category, zero where absent."""
    return wide_counts(df, area, category, count, categories)
