"""Hotspot groups, group rates and the area analysis table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from hearthmap.constants import (
    ELSEWHERE,
    HIGHEST,
    HOT_LEVELS,
    HOTSPOT_LEVELS,
    HOTSPOTS,
    NOT_URBAN,
    OUTLIER_AREAS,
    URBAN,
    URBAN_LABELS,
)
from hearthmap.functions.nulls import in_or_false, not_in_keep_null, ordered_level
from hearthmap.functions.joins import lookup_join
from hearthmap.functions.ordered import exact_quantiles
from hearthmap.operators.bins import quantile_bins
from hearthmap.operators.stacking import drop_index


def hotspot_groups(
    areas: DataFrame, *, level: str = "classification", income: str = "LSOA_incmedian"
) -> DataFrame:
    """Ordered level, hotspot flag (unknown counts as elsewhere) and income quartile."""
    flagged = areas.withColumn(level, ordered_level(level, HOTSPOT_LEVELS)).withColumn(
        "top_or_not",
        F.when(in_or_false(level, HOT_LEVELS), F.lit(HOTSPOTS)).otherwise(F.lit(ELSEWHERE)),
    )
    return quantile_bins(flagged, {"income_dist_median": (income, 4)})


def without_areas(
    areas: DataFrame, area: str, excluded: list[str] = OUTLIER_AREAS
) -> DataFrame:
    """Sensitivity subset; rows with a NULL area code stay."""
    return areas.where(not_in_keep_null(area, excluded))


def lowest_income(areas: DataFrame) -> DataFrame:
    """Areas of the lowest income quartile."""
    return areas.where(F.col("income_dist_median") == 1)


def group_rates(df: DataFrame, by: str, measures: dict[str, str]) -> DataFrame:
    """Mean x 100 per group over rows that are complete in every column of ``df``."""
    return (
        df.na.drop("any")
        .groupBy(by)
        .agg(*[(F.avg(src) * 100).alias(out) for out, src in measures.items()])
    )


def groups_by_median(df: DataFrame, by: str, value: str) -> DataFrame:
    """Groups with their median, highest median first."""
    return exact_quantiles(df, value, {"median": 0.5}, [by]).orderBy(F.desc("median"), by)


def analysis_table(
    areas: DataFrame,
    ages: DataFrame,
    urban_rural: DataFrame,
    *,
    area: str = "LSOA21CD",
    age_area: str = "area_code",
    poverty: str = "LSOA_FPmean",
    income: str = "LSOA_incmedian",
) -> DataFrame:
    """Area indicators with quantile bins, exposure flags, ages, settlement type and country.

    A missing poverty value counts as not exposed; a missing settlement type as not urban.
    ``ages`` and ``urban_rural`` have one row per area (ages may have one NULL area).
    """
    binned = quantile_bins(
        areas,
        {
            "income_dist_median": (income, 4),
            "fp_quint_mean": (poverty, 5),
            "fp_dec_mean": (poverty, 10),
        },
    )
    quint, dec = F.col("fp_quint_mean"), F.col("fp_dec_mean")
    flagged = (
        binned.withColumn("top5_or_not", F.when(quint == 5, HIGHEST).otherwise(ELSEWHERE))
        .withColumn("top10_or_not", F.when(dec == 10, HIGHEST).otherwise(ELSEWHERE))
        .withColumn("top_20_or_not", F.when(dec >= 9, 1).otherwise(0))
    )
    settlement = urban_rural.select(
        F.col("DZ22_Code").alias("_zone"), F.col("UR6_Name").alias("_settlement")
    )
    joined = lookup_join(flagged, ages, [(area, age_area)], unique=True)
    joined = lookup_join(joined, settlement, [(area, "_zone")], unique=True)
    code = F.col(area)
    england, wales, scotland = code.contains("E"), code.contains("W"), code.contains("S")
    return drop_index(
        joined.withColumn(
            "urb_rur",
            F.when(england | wales, F.col("ruc21ind")).when(scotland, F.col("_settlement")),
        )
        .withColumn(
            "country",
            F.when(england, "England").when(wales, "Wales").when(scotland, "Scotland"),
        )
        .withColumn(
            "urb_or_not", F.when(in_or_false("urb_rur", URBAN_LABELS), URBAN).otherwise(NOT_URBAN)
        )
        .drop("_settlement")
    )
