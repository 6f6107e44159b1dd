"""Weighted outcome model with treatment interactions and the effect on the treated.

A model with all treatment x covariate interactions is one regression per arm.  Levels of a categorical
covariate are swept out (``absorbed.py``), so there may be any number of them; the driver solves a
system in the other covariates only.  The effect's standard error is that of a sum of row influences
per cluster, one number per row.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from hearthmap.functions.joins import lookup_join
from hearthmap.functions.tails import NORMAL_975, normal_two_sided
from hearthmap.operators.absorbed import Covariates, Fit, covariates, fit, model_rows
from hearthmap.session import materialise


def _fitted(df: DataFrame, x: Covariates, treated: str, y: str, w: str, **more) -> tuple[DataFrame, Fit]:
    rows = model_rows(
        df, x, _y=F.col(y).cast("double"), _w=F.col(w).cast("double"), _t=F.col(treated).cast("int"), **more
    )
    result = fit(rows, len(x.names), F.col("_w"), F.col("_y"), F.col("_t"))
    if set(result.slopes) != {0, 1}:
        raise ValueError("the model needs complete rows in both arms")
    return rows, result


def _paired(result: Fit) -> DataFrame:
    """Levels side by side: _l, intercepts i0 and i1, weights w0 and w1, means and rows of either arm."""
    table = result.levels.withColumn("_i", result.intercept())
    means = [f"_m{i}" for i in result.kept]
    sides = [
        table.where(F.col("_a") == a).select("_l", *[F.col(c).alias(f"{c}{a}") for c in ("_i", "_w", "_n", *means)])
        for a in (0, 1)
    ]
    return sides[0].join(sides[1], "_l", "full")


def _base_level(paired: DataFrame) -> str:
    """Level that the treatment's own term belongs to: the first if both arms have it, else the last of both."""
    both = F.col("_i0").isNotNull() & F.col("_i1").isNotNull()
    first, low, high = paired.agg(F.min("_l"), F.min(F.when(both, F.col("_l"))), F.max(F.when(both, F.col("_l")))).first()
    if low is None:
        raise ValueError("no level has both treated and untreated rows")
    return first if first == low else high


def weighted_model(
    df: DataFrame, treated: str, y: str, numeric: list[str], categorical: list[str], w: str = "weights"
) -> DataFrame:
    """Coefficients (term, estimate) of y on treatment x (covariates); terms without estimate are aliased.

    Levels are compared with the first; a level that one arm lacks has no interaction.  A covariate that is
    constant within levels or depends on earlier ones in either arm is left out.
    """
    x = covariates(df, numeric, categorical)
    _, result = _fitted(df, x, treated, y, w)
    paired = materialise(_paired(result))
    base = paired.where(F.col("_l") == _base_level(paired)).first()
    first_level = paired.agg(F.min("_l")).first()[0]
    effect = base["_i1"] - base["_i0"]
    first = paired.where(F.col("_l") == first_level).first()
    origin = first["_i0"] if first["_i0"] is not None else first["_i1"] - effect
    control, arm = result.slopes[0], result.slopes[1]
    rows = [("(Intercept)", origin), (treated, effect)]
    rows += [(n, control[i]) for i, n in enumerate(x.names)]
    rows += [(f"{treated}:{n}", None if control[i] is None else arm[i] - control[i]) for i, n in enumerate(x.names)]
    terms = df.sparkSession.createDataFrame(rows, "term string, estimate double")
    if x.factor is None:
        return terms
    others = paired.where(F.col("_l") != first_level)
    name = F.concat(F.lit(f"{x.factor}_"), "_l")
    main = F.coalesce(F.col("_i0"), F.col("_i1") - effect) - origin
    # the level that the treatment's term belongs to has no interaction of its own
    own = F.when(F.col("_l") != base["_l"], F.col("_i1") - F.col("_i0") - effect)
    levels = others.select(name.alias("term"), main.alias("estimate")).unionAll(
        others.select(F.concat(F.lit(f"{treated}:"), name), own)
    )
    return terms.unionAll(levels)


def treated_effect(
    df: DataFrame,
    treated: str,
    y: str,
    numeric: list[str],
    categorical: list[str],
    *,
    w: str = "weights",
    cluster: str = "subclass",
) -> DataFrame:
    """Average effect on the treated with a cluster-robust standard error, one row.

    Treated rows of a level without untreated rows get the effect of the base level.
    """
    x = covariates(df, numeric, categorical)
    rows, result = _fitted(df, x, treated, y, w, _g=F.col(cluster))
    paired = materialise(_paired(result))
    base = _base_level(paired)
    both = F.col("_i0").isNotNull() & F.col("_i1").isNotNull()
    kept = result.kept
    # one row: treated rows, those of levels that lack the other arm, covariate sums of the treated
    total = result.levels.where("_a = 1").agg(F.sum("_n")).first()[0]
    lone = paired.where("_i0 is null").agg(F.coalesce(F.sum("_n1"), F.lit(0))).first()[0]
    means = rows.where("_t = 1").agg(*[F.avg(f"x{i}") for i in kept], F.lit(0)).first()
    share = (F.col("_n1") + F.when(F.col("_l") == base, F.lit(lone)).otherwise(0)) / total
    shares = paired.withColumn("_u", F.when(both, share).otherwise(0.0))
    sums = shares.agg(
        F.sum(F.col("_u") * (F.col("_i1") - F.col("_i0"))),
        *[F.sum(F.col("_u") * F.col(f"_m{i}{a}")) for a in (0, 1) for i in kept],
        F.sum(F.col("_i0").isNotNull().cast("int") + F.col("_i1").isNotNull().cast("int")),
    ).first()
    estimate = sums[0] + sum(m * (result.slopes[1][i] - result.slopes[0][i]) for m, i in zip(means, kept))
    centred = {a: [means[p] - sums[1 + a * len(kept) + p] for p in range(len(kept))] for a in (0, 1)}
    pull = {a: result.inverse[a] @ centred[a] if kept else [] for a in (0, 1)}

    def of_arm(a: int):
        away = [F.col(f"x{i}") - F.col(f"_m{i}{a}") for i in kept]
        residual = F.col("_y") - F.col(f"_i{a}") - sum((F.lit(result.slopes[a][i]) * F.col(f"x{i}") for i in kept), F.lit(0.0))
        weight = F.col("_u") / F.col(f"_w{a}") + sum((F.lit(float(p)) * d for p, d in zip(pull[a], away)), F.lit(0.0))
        return F.col("_w") * residual * weight * (1 if a else -1)

    placed = lookup_join(rows, shares.withColumnRenamed("_l", "_level"), [("_l", "_level")], "inner")
    influence = F.when(F.col("_t") == 1, of_arm(1)).otherwise(of_arm(0))
    found = (
        placed.groupBy("_g")
        .agg(F.sum(influence).alias("_f"), F.count(F.lit(1)).alias("_rows"))
        .agg(F.sum(F.col("_f") * F.col("_f")), F.count(F.lit(1)), F.sum("_rows"))
        .first()
    )
    squares, groups, n = found
    k = sums[-1] + 2 * len(kept)
    se = math.sqrt(squares * groups / (groups - 1) * (n - 1) / (n - k))
    z = estimate / se
    row = (estimate, se, z, normal_two_sided(z), estimate - NORMAL_975 * se, estimate + NORMAL_975 * se, total, groups)
    return df.sparkSession.createDataFrame(
        [row],
        "estimate double, std_error double, z double, p double, conf_low double, conf_high double, "
        "n_treated bigint, n_clusters bigint",
    )
