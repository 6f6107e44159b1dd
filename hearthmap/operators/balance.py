"""Covariate balance before and after matching."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from hearthmap.functions.joins import lookup_join
from hearthmap.functions.nulls import ratio
from hearthmap.functions.ordered import running_totals
from hearthmap.session import materialise


def balance_table(
    df: DataFrame,
    treated: str,
    numeric: list[str],
    categorical: list[str],
    *,
    matched: str | None = None,
) -> DataFrame:
    """Means, standardised difference, variance ratio and eCDF differences per covariate.

    ``matched``: 0/1 column that limits the comparison to matched rows; the standardising
    deviation stays that of all treated rows.  Category levels are compared as proportions, any number of
    them.  The rows are added up once, to moments per (arm, matched, levels); no row is multiplied.
    """
    used = F.lit(True) if matched is None else F.coalesce(F.col(matched) == 1, F.lit(False))
    rows = df.select(
        F.col(treated).cast("int").alias("_t"),
        used.alias("_used"),
        *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(numeric)],
        *[F.col(c).cast("string").alias(f"_c{i}") for i, c in enumerate(categorical)],
    )
    moments = [
        f(f"_x{i}").alias(f"{name}{i}")
        for i in range(len(numeric))
        for f, name in ((F.count, "_n"), (F.avg, "_m"), (F.var_pop, "_v"))
    ]
    cells = materialise(
        rows.groupBy("_t", "_used", *[f"_c{i}" for i in range(len(categorical))]).agg(F.count(F.lit(1)).alias("_rows"), *moments)
    )
    parts = [_level_rows(cells, c, i) for i, c in enumerate(categorical)]
    if numeric:
        parts.append(_number_rows(cells, rows, numeric))
    return reduce(DataFrame.unionByName, parts)


def _side(name: str) -> Column:
    """Cells of a side: treated in use, control in use, all treated."""
    arm = F.col("_t") == (0 if name == "0" else 1)
    return arm if name == "a" else arm & F.col("_used")


def _number_rows(cells: DataFrame, rows: DataFrame, numeric: list[str]) -> DataFrame:
    """Balance of the numeric covariates from the moments of the cells."""
    places = [(i, s) for i in range(len(numeric)) for s in ("1", "0", "a")]
    count = lambda i, s: F.sum(F.when(_side(s), F.col(f"_n{i}")))
    means = cells.agg(
        *[count(i, s).alias(f"n{i}{s}") for i, s in places],
        *[(F.sum(F.when(_side(s), F.col(f"_n{i}") * F.col(f"_m{i}"))) / count(i, s)).alias(f"m{i}{s}") for i, s in places],
    )
    # `means` is one row; squares are added up around it
    around = cells.crossJoin(F.broadcast(means))
    squares = [
        F.sum(F.when(_side(s), F.col(f"_n{i}") * (F.col(f"_v{i}") + F.pow(F.col(f"_m{i}") - F.col(f"m{i}{s}"), F.lit(2))))).alias(f"q{i}{s}")
        for i, s in places
    ]
    kept = [F.max(f"{c}{i}{s}").alias(f"{c}{i}{s}") for c in "nm" for i, s in places]
    variance = lambda i, s: ratio(F.col(f"q{i}{s}"), F.col(f"n{i}{s}") - 1)
    table = F.array(
        *[
            F.struct(
                F.lit(c).alias("variable"),
                F.col(f"m{i}1").alias("mean_treated"),
                F.col(f"m{i}0").alias("mean_control"),
                ratio(F.col(f"m{i}1") - F.col(f"m{i}0"), F.sqrt(variance(i, "a"))).alias("std_mean_diff"),
                ratio(variance(i, "1"), variance(i, "0")).alias("var_ratio"),
            )
            for i, c in enumerate(numeric)
        ]
    )
    found = around.agg(*squares, *kept).select(F.inline(table))
    ecdf = _ecdf(rows, numeric)
    return lookup_join(found, ecdf, ["variable"], unique=True).withColumnsRenamed({"_mean": "ecdf_mean", "_max": "ecdf_max"})


def _level_rows(cells: DataFrame, name: str, i: int) -> DataFrame:
    """Balance of the levels of one categorical covariate, as proportions of all rows of a side."""
    sums = [F.sum(F.when(_side(s), F.col("_rows")).otherwise(0)) for s in ("1", "0", "a")]
    totals = cells.agg(*[c.alias(f"_all{s}") for c, s in zip(sums, ("1", "0", "a"))])
    found = cells.where(F.col(f"_c{i}").isNotNull()).groupBy(f"_c{i}").agg(*[c.alias(f"_l{s}") for c, s in zip(sums, ("1", "0", "a"))])
    # `totals` is one row
    shares = found.crossJoin(F.broadcast(totals)).withColumns({f"p{s}": ratio(f"_l{s}", f"_all{s}") for s in ("1", "0", "a")})
    gap = F.col("p1") - F.col("p0")
    return shares.select(
        F.concat(F.lit(f"{name}_"), F.col(f"_c{i}")).alias("variable"),
        F.col("p1").alias("mean_treated"),
        F.col("p0").alias("mean_control"),
        ratio(gap, F.sqrt(F.col("pa") * (1 - F.col("pa")))).alias("std_mean_diff"),
        F.lit(None).cast("double").alias("var_ratio"),
        F.abs(gap).alias("ecdf_mean"),
        F.abs(gap).alias("ecdf_max"),
    )


def _ecdf(rows: DataFrame, numeric: list[str]) -> DataFrame:
    """Mean and largest eCDF difference over the distinct values of each numeric covariate."""
    inside = rows.where(F.col("_used"))
    counts = [
        inside.where(F.col(f"_x{i}").isNotNull())
        .groupBy(F.lit(c).alias("variable"), F.col(f"_x{i}").alias("_v"))
        .agg(F.sum((F.col("_t") == 1).cast("long")).alias("n1"), F.sum((F.col("_t") == 0).cast("long")).alias("n0"))
        for i, c in enumerate(numeric)
    ]
    steps = running_totals(reduce(DataFrame.unionAll, counts), "_v", ["n1", "n0"], ["variable"])
    gap = F.abs(ratio("cum_n1", "all_n1") - ratio("cum_n0", "all_n0"))
    return steps.groupBy("variable").agg(F.avg(gap).alias("_mean"), F.max(gap).alias("_max"))


def pair_distance(
    df: DataFrame, pairs: DataFrame, id_col: str, treated: str, numeric: list[str], categorical: list[str] | None = None
) -> DataFrame:
    """Mean absolute within-pair difference in units of the treated deviation: variable, pair_dist.

    For a level of a categorical covariate that is the share of pairs of which one side is in it; all
    levels come from the counts of pairs of levels.
    """
    categorical = categorical or []
    values = df.select(
        F.col(id_col).alias("_id"),
        *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(numeric)],
        *[F.col(c).cast("string").alias(f"_c{i}") for i, c in enumerate(categorical)],
    )
    names = [c for c in values.columns if c != "_id"]
    sides = [
        values.select(F.col("_id").alias(key), *[F.col(c).alias(f"{c}{s}") for c in names])
        for key, s in (("treated_id", "a"), ("control_id", "b"))
    ]
    both = pairs.join(sides[0], "treated_id").join(sides[1], "control_id")
    gaps = [F.abs(F.col(f"_x{i}a") - F.col(f"_x{i}b")) for i in range(len(numeric))]
    # one row per pair of levels, with everything that is added up over its pairs
    cells = materialise(
        both.groupBy(*[f"_c{i}{s}" for i in range(len(categorical)) for s in "ab"]).agg(
            F.count(F.lit(1)).alias("_pairs"),
            *[F.sum(g).alias(f"_g{i}") for i, g in enumerate(gaps)],
            *[F.count(g).alias(f"_k{i}") for i, g in enumerate(gaps)],
        )
    )
    arm = df.where(F.col(treated) == 1)
    parts = []
    if numeric:
        spread = arm.agg(*[F.stddev_samp(c).alias(f"_s{i}") for i, c in enumerate(numeric)])
        mean_gap = cells.agg(*[ratio(F.sum(f"_g{i}"), F.sum(f"_k{i}")).alias(f"_g{i}") for i in range(len(numeric))])
        rows = F.array(
            *[F.struct(F.lit(c).alias("variable"), ratio(f"_g{i}", f"_s{i}").alias("pair_dist")) for i, c in enumerate(numeric)]
        )
        # one row each
        parts.append(mean_gap.crossJoin(F.broadcast(spread)).select(F.inline(rows)))
    for i, c in enumerate(categorical):
        parts.append(_level_distance(cells, df, treated, c, i))
    return reduce(DataFrame.unionAll, parts)


def _level_distance(cells: DataFrame, df: DataFrame, treated: str, name: str, i: int) -> DataFrame:
    a, b = F.col(f"_c{i}a"), F.col(f"_c{i}b")
    apart = cells.where(~a.eqNullSafe(b)).select(F.explode(F.array(a, b)).alias("_level"), "_pairs")
    differing = apart.where("_level is not null").groupBy("_level").agg(F.sum("_pairs").alias("_apart"))
    is_treated = (F.col(treated) == 1).cast("long")
    levels = df.where(F.col(name).isNotNull()).groupBy(F.col(name).cast("string").alias("_name")).agg(F.sum(is_treated).alias("_in"))
    totals = df.agg(F.sum(is_treated).alias("_arm")).crossJoin(F.broadcast(cells.agg(F.sum("_pairs").alias("_all"))))
    # one row of totals
    rows = levels.join(differing, F.col("_name") == F.col("_level"), "left").crossJoin(F.broadcast(totals))
    share = ratio("_in", "_arm")
    mean = ratio(F.coalesce("_apart", F.lit(0)), "_all")
    return rows.select(F.concat(F.lit(f"{name}_"), "_name").alias("variable"), ratio(mean, F.sqrt(share * (1 - share))).alias("pair_dist"))


def balance_report(
    df: DataFrame, pairs: DataFrame, id_col: str, treated: str, numeric: list[str], categorical: list[str], matched: str = "matched"
) -> DataFrame:
    """Balance of the matched rows and distance within pairs: score, covariates and levels in one table."""
    table = balance_table(df, treated, numeric, categorical, matched=matched)
    gaps = pair_distance(df, pairs, id_col, treated, numeric, categorical)
    return lookup_join(table, gaps, ["variable"], unique=True)


def sample_sizes(df: DataFrame, treated: str, matched: str) -> DataFrame:
    """Number of control and treated rows: all, matched, unmatched."""
    t, m = F.col(treated) == 1, F.col(matched) == 1
    rows = [("All", F.lit(True)), ("Matched", m), ("Unmatched", ~m)]
    sums = []
    for i, (_, keep) in enumerate(rows):
        sums.append(F.count(F.when(~t & keep, 1)).alias(f"c{i}"))
        sums.append(F.count(F.when(t & keep, 1)).alias(f"t{i}"))
    table = F.array(
        *[
            F.struct(
                F.lit(name).alias("sample"),
                F.col(f"c{i}").alias("control"),
                F.col(f"t{i}").alias("treated"),
            )
            for i, (name, _) in enumerate(rows)
        ]
    )
    return df.agg(*sums).select(F.inline(table))
