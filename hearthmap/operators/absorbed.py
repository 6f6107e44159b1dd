"""Weighted least squares with one categorical covariate of any number of levels.

The levels are swept out instead of becoming columns: sums per (arm, level) give the level means; what
is left is a system in the few other covariates.  The level intercepts follow from the means and stay a
table.  Arms are fitted side by side; a fit without arms has one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from hearthmap.operators.reshape import distinct_labels
from hearthmap.session import materialise


# Level tables up to this size may be collected by a fit that is repeated.
FEW_BYTES = 1_000_000


def level_bytes(levels: int, k: int) -> int:
    """Bytes of the level table of a fit with ``k`` other covariates, a generous 100 for the level's name."""
    return levels * (100 + 8 * (2 * k + k * (k + 1) + 6))


@dataclass
class Covariates:
    """Named covariate columns, and the categorical covariate whose levels are swept out (if any)."""

    names: list[str]
    columns: list[Column]
    factor: str | None

    @property
    def level(self) -> Column:
        return F.lit("") if self.factor is None else F.col(self.factor).cast("string")


def covariates(df: DataFrame, numeric: list[str], categorical: list[str]) -> Covariates:
    """The categorical covariate with most levels is swept out; others become indicators but their first level's."""
    factor = categorical[0] if categorical else None
    if len(categorical) > 1:
        sizes = df.agg(*[F.approx_count_distinct(c) for c in categorical]).first()
        factor = categorical[int(np.argmax(sizes))]
    named = {c: F.col(c).cast("double") for c in numeric}
    for c in categorical:
        if c != factor:
            named |= {f"{c}_{v}": (F.col(c) == v).cast("double") for v in distinct_labels(df, c)[1:]}
    return Covariates(list(named), list(named.values()), factor)


def model_rows(df: DataFrame, x: Covariates, **more: Column) -> DataFrame:
    """Complete rows: _l (level), x0, x1, ... and the columns of ``more``."""
    columns = [c.alias(f"x{i}") for i, c in enumerate(x.columns)] + [c.alias(n) for n, c in more.items()]
    return df.select(x.level.alias("_l"), *columns).na.drop("any")


@dataclass
class Fit:
    """``slopes`` per arm (None: left out); ``levels``: a written table (_a, _l, _n, _w, _m0.., _my)."""

    slopes: dict[int, list[float | None]]
    inverse: dict[int, np.ndarray]
    kept: list[int]
    levels: DataFrame
    totals: dict[str, float]

    def intercept(self) -> Column:
        """Intercept of a row of ``levels``."""
        value = F.col("_my")
        for arm, slopes in self.slopes.items():
            part = sum((F.lit(slopes[i]) * F.col(f"_m{i}") for i in self.kept), F.lit(0.0))
            value = value - F.when(F.col("_a") == arm, part).otherwise(0.0)
        return value


def fit(
    rows: DataFrame,
    k: int,
    w: Column,
    y: Column,
    arm: Column,
    more: dict[str, Column] | None = None,
    collected: bool = False,
) -> Fit:
    """Weighted least squares of ``y`` on x0..x(k-1) and the levels, separately in each arm.

    A covariate that depends on earlier ones in either arm is left out of all.  ``more`` are columns to be
    added up in the same pass.  ``collected``: the level table is known to be small (``FEW_BYTES``).
    """
    more = more or {}
    xs = [F.col(f"x{i}") for i in range(k)]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    weighted = rows.select(arm.alias("_a"), "_l", w.alias("_ww"), y.alias("_yy"), *xs, *[c.alias(n) for n, c in more.items()])
    sums = weighted.groupBy("_a", "_l").agg(
        F.count(F.lit(1)).alias("_n"),
        F.sum("_ww").alias("_w"),
        *[F.sum(F.col("_ww") * x).alias(f"_s{i}") for i, x in enumerate(xs)],
        F.sum(F.col("_ww") * F.col("_yy")).alias("_sy"),
        *[F.sum(F.col("_ww") * xs[i] * xs[j]).alias(f"_q{i}_{j}") for i, j in pairs],
        *[F.sum(F.col("_ww") * x * F.col("_yy")).alias(f"_p{i}") for i, x in enumerate(xs)],
        *[F.sum(n).alias(n) for n in more],
    )
    levels = sums.where("_w > 0").select(
        "*", *[(F.col(f"_s{i}") / F.col("_w")).alias(f"_m{i}") for i in range(k)], (F.col("_sy") / F.col("_w")).alias("_my")
    )
    # one row per arm: what the level means leave
    left = {
        **{f"_c{i}_{j}": (f"_q{i}_{j}", f"_s{i}", f"_m{j}") for i, j in pairs},
        **{f"_d{i}": (f"_p{i}", f"_s{i}", "_my") for i in range(k)},
    }
    whole = [f"_q{i}_{i}" for i in range(k)] + list(more)
    if collected:
        # a table of few bytes goes on as rows of the plan
        table = levels.toArrow()
        levels = rows.sparkSession.createDataFrame(table)
        by_arm = table.to_pandas().groupby("_a")
        within = [[a, *[(g[q] - g[s] * g[m]).sum() for q, s, m in left.values()], *[g[c].sum() for c in whole]] for a, g in by_arm]
    else:
        levels = materialise(levels)
        within = levels.groupBy("_a").agg(
            *[F.sum(F.col(q) - F.col(s) * F.col(m)) for q, s, m in left.values()], *[F.sum(c) for c in whole], F.count(F.lit(1))
        ).collect()
    cross, moment, kept, totals = {}, {}, list(range(k)), dict.fromkeys(more, 0.0)
    for row in within:
        a, values = row[0], list(row)[1:]
        square = np.zeros((k, k))
        for (i, j), v in zip(pairs, values):
            square[i, j] = square[j, i] = v
        cross[a], moment[a] = square, np.array(values[len(pairs) : len(pairs) + k])
        total = np.array(values[len(pairs) + k : len(pairs) + 2 * k])
        for n, v in zip(more, values[len(pairs) + 2 * k :]):
            totals[n] += v
        kept = [i for i in independent(square, total) if i in kept]
    slopes, inverse = {}, {}
    for a, square in cross.items():
        part = square[np.ix_(kept, kept)]
        scale = 1 / np.sqrt(part.diagonal())
        inverse[a] = np.linalg.inv(part * np.outer(scale, scale)) * np.outer(scale, scale) if kept else part
        found = dict(zip(kept, (inverse[a] @ moment[a][kept]).tolist()))
        slopes[a] = [found.get(i) for i in range(k)]
    return Fit(slopes, inverse, kept, levels, totals)


def independent(cross: np.ndarray, total: np.ndarray) -> list[int]:
    """Columns kept: leaves out those that the levels or earlier columns explain; ``total`` is their size before."""
    kept: list[int] = []
    for j in range(len(cross)):
        if cross[j, j] <= 1e-12 * total[j]:
            continue
        scale = 1 / np.sqrt(cross[np.ix_(kept + [j], kept + [j])].diagonal())
        trial = cross[np.ix_(kept + [j], kept + [j])] * np.outer(scale, scale)
        rest = trial[-1, -1]
        if kept:
            rest -= trial[-1, :-1] @ np.linalg.solve(trial[:-1, :-1], trial[:-1, -1])
        if rest > 1e-9:
            kept.append(j)
    return kept
