"""Spread practice and locality totals over small areas by population share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from hearthmap.constants import AREA_SUFFIX_LENGTH
from hearthmap.functions.joins import full_join, group_totals, keep_all_lookup, lookup_join
from hearthmap.functions.nulls import drop_suffix, lenient_sum, listed, ratio, strict_sum, to_number
from hearthmap.operators.classes import DrugClass, classify_codes
from hearthmap.session import materialise

MEASURES = ["items", "quantity", "cost"]


def practice_totals(
    fact: DataFrame, keys: list[str], measures: dict[str, str] | list[str] = MEASURES
) -> DataFrame:
    """Null-propagating sums of the measures by ``keys`` (combined map-side)."""
    if not isinstance(measures, dict):
        measures = {m: m for m in measures}
    return fact.groupBy(*keys).agg(*[strict_sum(src).alias(out) for out, src in measures.items()])


def class_totals(
    fact: DataFrame,
    code: str,
    classes: list[DrugClass],
    keys: list[str],
    measures: dict[str, str] | list[str] = MEASURES,
    *,
    by_code: bool = True,
    label: str = "drug_type",
) -> DataFrame:
    """Totals by (class, code, keys), or by (class, keys): facts are added up per code before any class
    is looked up, so the class step sees no fact row."""
    tagged = classify_codes(practice_totals(fact, [code, *keys], measures), code, classes, label)
    return tagged if by_code else practice_totals(tagged, [label, *keys], list(measures))


def practice_shares(
    registrations: DataFrame, practice: str = "practice", patients: str = "patients"
) -> DataFrame:
    """Each row's share of its practice's patients; NULL when the practice has none."""
    return group_totals(
        registrations, [practice], {"total_patients": strict_sum(patients)}
    ).withColumn("share", ratio(patients, "total_patients"))


def join_practice_values(
    registrations: DataFrame, values: DataFrame, practice: str, patients: str, how: str = "left"
) -> DataFrame:
    """Registrations with their share of the practice and the practice's values.

    ``values`` (key ``_practice``) and the practice's patients are brought together per practice
    first, so the registrations themselves are joined once.
    """
    by_practice = registrations.groupBy(F.col(practice).alias("_practice")).agg(
        strict_sum(patients).alias("_patients"), F.count(F.lit(1)).alias("_n")
    )
    per_practice = materialise(
        by_practice.join(values, by_practice["_practice"].eqNullSafe(values["_practice"]), how).drop(
            values["_practice"]
        )
    )
    sizes = per_practice.groupBy(F.col("_practice").alias(practice)).agg(F.max("_n").alias("_n"))
    joined = lookup_join(
        registrations,
        per_practice.drop("_n"),
        [(practice, "_practice")],
        how,
        written=True,
        sizes=sizes,
    )
    return joined.withColumn("_share", ratio(patients, "_patients"))


def _wide_totals(
    totals: DataFrame, practice: str, class_col: str, classes: list[str]
) -> DataFrame:
    """One row per practice, one column per class and measure; a missing value counts as zero.

    A class outside ``classes`` raises.
    """
    known = listed(class_col, classes, class_col)
    sums = [
        F.sum(F.when(known == label, F.coalesce(F.col(m), F.lit(0.0)))).alias(f"{m}_{i}")
        for i, label in enumerate(classes)
        for m in MEASURES
    ]
    return totals.groupBy(F.col(practice).alias("_practice")).agg(*sums)


def apportion(
    registrations: DataFrame,
    totals: DataFrame,
    classes: list[str],
    *,
    practice: str = "practice",
    area: str = "area",
    patients: str = "patients",
    class_col: str = "drug_type",
    filled_after: list[str] | None = None,
) -> DataFrame:
    """Practice totals -> area volumes, all classes in one pass.

    ``totals`` has (practice, class, measures) with any number of rows per practice and class
    (per code, per practice name); allocation is linear so they are added up first.  Practices
    without registrations drop out; areas without prescriptions get zeros.

    Missing totals become zero before the multiplication, so an area served by a practice without
    patients is NULL.  Classes in ``filled_after`` are filled after it, so such an area is 0.
    """
    filled_after = filled_after or []
    wide = _wide_totals(totals, practice, class_col, classes)
    rows = join_practice_values(registrations.select(practice, area, patients), wide, practice, patients)

    sums = []
    for i, label in enumerate(classes):
        add_up = lenient_sum if label in filled_after else strict_sum
        for m in MEASURES:
            volume = F.coalesce(F.col(f"{m}_{i}"), F.lit(0.0)) * F.col("_share")
            sums.append(add_up(volume).cast("double").alias(f"{m}_{i}"))
    per_class = F.array(
        *[
            F.struct(
                *[F.col(f"{m}_{i}").alias(m) for m in MEASURES], F.lit(label).alias(class_col)
            )
            for i, label in enumerate(classes)
        ]
    )
    return rows.groupBy(area).agg(*sums).select(area, F.inline(per_class))


def apportion_by_code(
    registrations: DataFrame,
    totals: DataFrame,
    *,
    practice: str = "practice",
    area: str = "area",
    patients: str = "patients",
    code: str = "code",
) -> DataFrame:
    """Area volumes per single code, for the (area, code) pairs that occur.

    A pair without a row has volume zero.  The sum over codes is what :func:`apportion` gives for a
    class with ``filled_after``, at a fraction of the rows.
    """
    summed = totals.groupBy(F.col(practice).alias("_practice"), code).agg(
        *[F.sum(m).alias(m) for m in MEASURES]
    )
    rows = join_practice_values(
        registrations.select(practice, area, patients), summed, practice, patients, "inner"
    )
    return rows.groupBy(area, code).agg(
        *[lenient_sum(F.col(m) * F.col("_share")).cast("double").alias(m) for m in MEASURES]
    )


def zone_shares(
    zones: DataFrame,
    population: DataFrame,
    *,
    zone: str = "zone",
    population_zone: str = "zone_code",
    locality: str = "locality",
    parent: str = "parent",
    people: str = "population",
) -> DataFrame:
    """Zone population as a share of its locality and of the locality's parent."""
    joined = lookup_join(
        zones, population.select(population_zone, people), [(zone, population_zone)], unique=True
    )
    with_locality = group_totals(joined, [locality], {"locality_population": strict_sum(people)})
    with_parent = group_totals(with_locality, [parent], {"parent_population": strict_sum(people)})
    return with_parent.withColumns(
        {
            "locality_share": ratio(people, "locality_population"),
            "parent_share": ratio(people, "parent_population"),
        }
    )


def practice_localities(
    practices: DataFrame,
    shares: DataFrame,
    *,
    practice: str = "practice",
    zone: str = "zone",
    locality: str = "locality",
    parent: str = "parent",
    practice_parent: str = "practice_parent",
) -> DataFrame:
    """Every listed practice with its zone's locality, and a check of the stated parent."""
    zone_side = shares.select(zone, locality, F.col(parent).alias("zone_parent"))
    return lookup_join(practices, zone_side, [zone]).withColumn(
        "parent_check", parent_check(practice_parent, "zone_parent")
    )


def parent_check(stated: str, derived: str) -> Column:
    """1 when the stated and the derived parent agree, 0 otherwise (also when unknown)."""
    return F.when(F.col(stated) == F.col(derived), F.lit(1)).otherwise(F.lit(0))


def two_step_apportion(
    totals: DataFrame,
    practices: DataFrame,
    shares: DataFrame,
    classes: list[str],
    *,
    practice: str = "practice",
    locality: str = "locality",
    class_col: str = "drug_type",
    faithful: bool = True,
) -> DataFrame:
    """Practice -> locality of its zone -> every zone of that locality by share.

    ``totals``: one row per (class, practice).  ``practices``: practice list with locality.
    Faithful rows per class: zones x their locality's total; the same zones again with empty
    measures when the locality has a listed practice without prescriptions; one zone-less row for
    practices that are not listed; zones of localities without practices.  ``faithful=False``
    keeps one row per zone and class, plus the zone-less rows.
    """
    # few classes, fixed in code: the grid has one row per class and listed practice
    class_rows = F.explode(F.array(*[F.lit(c) for c in classes])).alias("_class")
    listed = practices.select(practice, locality, class_rows)
    tagged = totals.withColumn("_class", F.col(class_col)).withColumnRenamed(class_col, "item")
    per_practice = full_join(listed, tagged, ["_class", practice], unique=True)
    per_locality = per_practice.groupBy("_class", locality, "item").agg(
        *[strict_sum(m).cast("double").alias(m) for m in MEASURES]
    )
    if not faithful:
        per_locality = per_locality.where(F.col("item").isNotNull())
    zones = shares.select("*", class_rows)
    spread = full_join(zones, per_locality, ["_class", locality])
    per_zone = {f"{m}_per_zone": F.col(m) * F.col("locality_share") for m in MEASURES}
    return spread.withColumns(per_zone).withColumnRenamed("_class", "class_key")


def locality_shares(
    registered: DataFrame,
    locality_codes: DataFrame,
    *,
    area_name: str = "area_name",
    patients: str = "patients",
    name: str = "locality_name",
) -> DataFrame:
    """Area share of its locality's registered patients, with the locality's code attached.

    The locality name is the area name without its fixed-length suffix; unreadable patient counts
    count as zero.
    """
    clean = registered.withColumn(
        patients, F.coalesce(to_number(patients), F.lit(0.0))
    ).withColumn(name, drop_suffix(area_name, AREA_SUFFIX_LENGTH))
    with_total = group_totals(clean, [name], {"locality_population": strict_sum(patients)})
    shares = with_total.withColumn("locality_share", ratio(patients, "locality_population"))
    return lookup_join(shares, locality_codes, [name])


def locality_apportion(
    totals: DataFrame,
    shares: DataFrame,
    *,
    code: str = "code",
    class_col: str = "drug_type",
) -> DataFrame:
    """Locality totals to areas by share; localities without areas stay with empty areas."""
    spread = keep_all_lookup(shares, totals, [code])
    return spread.withColumns(
        {f"{m}_per_area": F.col(m) * F.col("locality_share") for m in MEASURES}
    )
