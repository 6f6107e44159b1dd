"""Contextual tables per small area from landed sheets."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from hearthmap.constants import england_age_columns
from hearthmap.operators.context import area_prevalence, category_counts_wide, overcrowding_rate
from hearthmap.operators.reshape import england_age_bands, scotland_age_bands
from hearthmap.operators.stacking import stack_rows
from hearthmap.sources.sheets import pick_columns, promote_header, trim_rows

# Layout of the published smoking sheet (row ranges and column positions, 1-based), the
# defaults below, and the occupancy column names.
SMOKING_PREAMBLE, SMOKING_FOOTER, SMOKING_HEADER = (1, 9), (6199, 6202), 10
SMOKING_POPULATION, SMOKING_CASES = 9, 32
OCCUPANCY = [
    "Occupancy rating of -1 or less",
    "Occupancy rating of 0",
    "Occupancy rating of +1",
    "Occupancy rating of +2 or more",
]


def clean_smoking_sheet(
    sheet: DataFrame,
    preamble: tuple[int, int] = SMOKING_PREAMBLE,
    header: int = SMOKING_HEADER,
    footer: tuple[int, int] = SMOKING_FOOTER,
) -> DataFrame:
    """Practice smoking counts from the raw sheet; ``footer`` is where this edition's notes lie."""
    body = promote_header(trim_rows(sheet, preamble, footer), header)
    return pick_columns(
        body,
        {
            "PCN_code": "PCN ODS code",
            "PCN_name": "PCN name",
            "practice": "Practice code",
            "practice_name": "Practice name",
            "people": SMOKING_POPULATION,
            "cases": SMOKING_CASES,
        },
    )


def smoking_by_area(
    registrations: DataFrame,
    sheet: DataFrame,
    preamble: tuple[int, int] = SMOKING_PREAMBLE,
    header: int = SMOKING_HEADER,
    footer: tuple[int, int] = SMOKING_FOOTER,
) -> DataFrame:
    """Smokers, population and prevalence per area."""
    volumes = area_prevalence(
        registrations.withColumnsRenamed(
            {"PRACTICE_CODE": "practice", "LSOA_CODE": "area", "NUMBER_OF_PATIENTS": "patients"}
        ),
        clean_smoking_sheet(sheet, preamble, header, footer),
    )
    return volumes.withColumnsRenamed(
        {
            "area": "LSOA_CODE",
            "cases": "smokers",
            "people": "population",
            "prevalence": "smoking_prevalence",
        }
    )


def overcrowding_by_area(sheet: DataFrame) -> DataFrame:
    """Households and overcrowding per area from the raw sheet (header in its second row)."""
    body = promote_header(sheet, 2).drop("_row")
    rates = overcrowding_rate(body, area="LSOA code", occupancy=OCCUPANCY, worst=OCCUPANCY[0])
    return rates.withColumnsRenamed(
        {
            "LSOA code": "LSOA_CODE",
            "total_households": "Total_households",
            "overcrowding_rate": "Overcrowding_prev",
        }
    )


def ethnicity_by_area(long: DataFrame) -> DataFrame:
    """One row per area, one column per ethnic group."""
    return category_counts_wide(
        long.withColumnRenamed("Lower layer Super Output Areas Code", "LSOA_CODE"),
        area="LSOA_CODE",
        category="Ethnic group (20 categories)",
        count="Observation",
    )


def age_table(
    england_sheet: DataFrame, scotland_sheet: DataFrame, oa_zones: DataFrame
) -> DataFrame:
    """Age bands and shares for all areas."""
    england = england_age_bands(
        england_sheet.withColumnRenamed("LSOA 2021 Code", "area_code"),
        "area_code",
        ["Total", *england_age_columns()],
    )
    scotland = scotland_age_bands(scotland_sheet, "oa_code", oa_zones, "OA22", "DZ22", "area_code")
    return stack_rows(england, scotland)


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    """Round columns for comparison with another engine's summation order."""
    return df.withColumns({c: F.round(F.col(f"`{c}`"), digits) for c in columns})
