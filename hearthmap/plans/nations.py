"""Prescribing volumes per small area for the three nations, from landed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from hearthmap.constants import NATION_LABELS, PREFIX_CLASSES
from hearthmap.operators.apportion import (
    apportion,
    class_totals,
    locality_apportion,
    locality_shares,
    practice_localities,
    two_step_apportion,
    zone_shares,
)
from hearthmap.operators.classes import DrugClass, class_from_list, relabel
from hearthmap.operators.stacking import drop_index, stack_rows
from hearthmap.session import materialise


def drug_classes(inhalers: DataFrame, pain: DataFrame, column: str = "bnf_presentation_code"):
    """The five classes: three by prefix, two by published list."""
    prefixed = [DrugClass(label, prefix=p) for label, p in PREFIX_CLASSES.items()]
    return [
        *prefixed,
        class_from_list("inhaler", inhalers, column),
        class_from_list("pain", pain, column),
    ]


def england_volumes(
    rx: DataFrame,
    registrations: DataFrame,
    classes: list[DrugClass],
    ready_made: DataFrame | None = None,
) -> DataFrame:
    """Area volumes for England: items, quantity, cost per area and drug class.

    ``rx`` is the tagged monthly scan; ``ready_made`` are area volumes of a class that was
    prepared elsewhere (its row-name column is dropped).  List-defined classes are allocated code
    by code, where a missing product counts as zero.
    """
    totals = class_totals(
        rx,
        "bnf_code",
        classes,
        ["row_id", "row_name"],
        {"items": "items", "quantity": "quantity", "cost": "actual_cost"},
    ).withColumnRenamed("row_id", "PRACTICE_CODE")
    volumes = apportion(
        registrations,
        totals,
        [c.label for c in classes],
        practice="PRACTICE_CODE",
        area="LSOA_CODE",
        patients="NUMBER_OF_PATIENTS",
        filled_after=[c.label for c in classes if c.prefix is None],
    )
    volumes = relabel(volumes, NATION_LABELS["england"])
    if ready_made is not None:
        volumes = stack_rows(volumes, drop_index(ready_made))
    return volumes


def scotland_volumes(
    rx: DataFrame,
    zones: DataFrame,
    population: DataFrame,
    practices: DataFrame,
    classes: list[DrugClass],
    faithful: bool = True,
) -> DataFrame:
    """Zone volumes for Scotland: practice -> locality -> zones by population share."""
    totals = class_totals(
        rx,
        "BNFItemCode",
        classes,
        ["GPPractice"],
        {
            "items": "NumberOfPaidItems",
            "quantity": "PaidQuantity",
            "cost": "GrossIngredientCost",
        },
        by_code=False,
    )
    totals = relabel(totals, NATION_LABELS["scotland"]).withColumnRenamed("GPPractice", "practice")
    # read several times below
    shares = materialise(
        zone_shares(
            zones,
            population,
            zone="DataZone",
            population_zone="Data_zone_code",
            locality="SubHSCPName",
            parent="HSCP",
            people="Total_population",
        )
    )
    listed = practice_localities(
        practices.select(
            F.col("PracticeCode").cast("string").alias("practice"),
            F.col("HSCP").alias("practice_parent"),
            "DataZone",
        ),
        shares,
        zone="DataZone",
        locality="SubHSCPName",
        parent="HSCP",
    )
    labels = [NATION_LABELS["scotland"][c.label] for c in classes]
    return two_step_apportion(
        totals, listed, shares, labels, locality="SubHSCPName", faithful=faithful
    )


def wales_volumes(
    rx: DataFrame, registered: DataFrame, codes: DataFrame, classes: list[DrugClass]
) -> DataFrame:
    """Area volumes for Wales: locality totals by registered-patient share."""
    totals = class_totals(
        rx,
        "BNFCode",
        classes,
        ["Locality"],
        {"items": "Items", "cost": "ActCost", "quantity": "Quantity"},
        by_code=False,
    )
    totals = relabel(totals, NATION_LABELS["wales"]).withColumnsRenamed({"Locality": "Code", "drug_type": "item"})
    shares = locality_shares(registered, codes, area_name="LSOA_name", name="Locality")
    return locality_apportion(totals, shares, code="Code", class_col="item")
