"""Hotspot comparison and matched comparison as whole studies."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from hearthmap.constants import OUTLIER_AREAS
from hearthmap.functions.nulls import not_in_keep_null, ratio
from hearthmap.operators.balance import balance_table, pair_distance, sample_sizes
from hearthmap.operators.effects import treated_effect, weighted_model
from hearthmap.operators.group_tests import anova_of, distance_moments, welch_of
from hearthmap.operators.hotspots import hotspot_groups
from hearthmap.operators.matching import (
    complete_cases,
    match_flags,
    matched_data,
    nearest_pairs,
    propensity_score,
)
from hearthmap.session import materialise

# The comparisons of the study as (subset, test, measure).
COMPARISONS = [
    ("all", "levene", "inhaler_prv"),
    ("all", "welch", "inhaler_prv"),
    ("all", "welch", "antidep_prv"),
    ("all", "welch", "antianx_prv"),
    ("no outliers", "levene", "inhaler_prv"),
    ("no outliers", "welch", "inhaler_prv"),
    ("low income", "levene", "inhaler_prv"),
    ("low income", "anova", "antipsych_prv"),
    ("low income", "welch", "antidep_prv"),
]


def hotspot_tests(areas: DataFrame, outliers: list[str] = OUTLIER_AREAS) -> DataFrame:
    """Every test of hotspots against elsewhere: one row per subset, test and measure.

    The areas are added up once, per (group, subsets they are in, inhaler rate); all tests come from the
    moments and counts of that table.
    """
    groups = hotspot_groups(materialise(areas))
    subsets = {
        "all": F.lit(True),
        "no outliers": not_in_keep_null("LSOA21CD", outliers),
        "low income": F.coalesce(F.col("income_dist_median") == 1, F.lit(False)),
    }
    masks = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in subsets.items()]))
    measures = list(dict.fromkeys(m for *_, m in COMPARISONS))
    spread = dict.fromkeys(m for _, test, m in COMPARISONS if test == "levene")
    by_value = [F.col(m).cast("double").alias(f"_v_{m}") for m in spread]
    cells = materialise(
        groups.where(F.col("top_or_not").isNotNull())
        .groupBy(F.col("top_or_not").alias("_g"), masks.alias("_in"), *by_value)
        .agg(
            F.count(F.lit(1)).alias("_n"),
            *[f(F.col(m).cast("double")).alias(f"{k}_{m}") for m in measures for k, f in (("_k", F.count), ("_m", F.avg), ("_q", F.var_pop))],
        )
    )
    placed = cells.withColumn("_subset", F.explode("_in"))
    results = {}
    for measure in measures:
        moments = materialise(_combined(placed, measure))
        of_spread = None
        if measure in spread:
            value = F.col(f"_v_{measure}")
            counts = placed.where(value.isNotNull()).groupBy("_subset", "_g", value.alias("_v")).agg(F.sum("_n").alias("_n"))
            of_spread = materialise(distance_moments(materialise(counts), ["_subset", "_g"]))
        for subset, test, tested in COMPARISONS:
            if tested == measure:
                table = (of_spread if test == "levene" else moments).where(F.col("_subset") == subset)
                row = (welch_of if test == "welch" else anova_of)(table)
                names = [F.lit(v).alias(c) for c, v in (("subset", subset), ("test", test), ("measure", measure))]
                results[subset, test, measure] = row.select(*names, "f", "df1", "df2", "p")
    return reduce(DataFrame.unionByName, [results[c] for c in COMPARISONS])


def _combined(placed: DataFrame, measure: str) -> DataFrame:
    """Moments per subset and group from those of the cells, squares added up around the group mean."""
    k, m, q = (F.col(f"{c}_{measure}") for c in ("_k", "_m", "_q"))
    known = placed.where(k > 0).select("_subset", "_g", k.alias("_k"), m.alias("_m"), q.alias("_q"))
    means = known.groupBy("_subset", "_g").agg(F.sum("_k").alias("n"), (F.sum(F.col("_k") * F.col("_m")) / F.sum("_k")).alias("mean"))
    away = F.col("_m") - F.col("mean")
    # a handful of rows: subsets x groups
    around = known.join(F.broadcast(means), ["_subset", "_g"])
    return around.groupBy("_subset", "_g", "n", "mean").agg(
        ratio(F.sum(F.col("_k") * (F.col("_q") + away * away)), F.first("n") - 1).alias("var")
    )


def _complete(columns: list[str]) -> Column:
    """1 where no column is NULL, else NULL."""
    return F.when(F.greatest(*[F.col(c).isNull().cast("int") for c in columns], F.lit(0)) == 0, 1)


@dataclass
class MatchedStudy:
    dropped: int
    pairs: DataFrame
    before: DataFrame
    after: DataFrame
    pair_gaps: DataFrame
    sizes: DataFrame
    matched: DataFrame
    model: DataFrame
    effect: DataFrame


def matched_study(
    areas: DataFrame,
    *,
    id_col: str,
    treated: str,
    outcome: str,
    numeric: list[str],
    categorical: list[str],
    drop_incomplete: bool = False,
) -> MatchedStudy:
    """Score, match, check balance and estimate the effect on the treated.

    Missing covariates raise unless ``drop_incomplete``; then ``dropped`` says how many areas went.
    """
    covariates = [*numeric, *categorical]
    data = complete_cases(areas, covariates, drop_incomplete).select(id_col, treated, outcome, *covariates)
    dropped = areas.agg(F.count(F.lit(1)) - F.count(_complete(covariates))).first()[0]
    scored = materialise(propensity_score(materialise(data), treated, numeric, categorical))
    pairs = materialise(nearest_pairs(scored, id_col, treated))
    flagged = match_flags(scored, pairs, id_col)
    with_score = ["distance", *numeric]
    rows = materialise(matched_data(scored, pairs, id_col))
    return MatchedStudy(
        dropped=dropped,
        pairs=pairs,
        before=balance_table(scored, treated, with_score, categorical),
        after=balance_table(flagged, treated, with_score, categorical, matched="matched"),
        pair_gaps=pair_distance(scored, pairs, id_col, treated, with_score, categorical),
        sizes=sample_sizes(flagged, treated, "matched"),
        matched=rows,
        model=weighted_model(rows, treated, outcome, numeric, categorical),
        effect=treated_effect(rows, treated, outcome, numeric, categorical),
    )
