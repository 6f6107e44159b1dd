"""Equal-frequency bins, box statistics, histograms and binned distributions."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from hearthmap.functions.joins import lookup_join
from hearthmap.functions.nulls import ratio
from hearthmap.functions.ordered import exact_quantiles


def quantile_bins(df: DataFrame, bins: dict[str, tuple[str, int]]) -> DataFrame:
    """Add equal-frequency bins: output column -> (value column, number of bins).

    Bin = 1 + number of interior type-7 quantiles strictly below the value, so ties never split.
    NULL stays NULL.  The break tables are single rows.
    """
    out = df
    by_value: dict[str, dict[str, float]] = {}
    for _, (value, q) in bins.items():
        by_value.setdefault(value, {}).update(
            {f"_{value}_{i}_{q}": i / q for i in range(1, q)}
        )
    for value, probs in by_value.items():
        breaks = exact_quantiles(df, value, probs)
        out = out.join(F.broadcast(breaks), F.lit(True), "left")
    for name, (value, q) in bins.items():
        above: Column = F.lit(1)
        for i in range(1, q):
            above = above + F.when(F.col(value) > F.col(f"_{value}_{i}_{q}"), 1).otherwise(0)
        out = out.withColumn(name, F.when(F.col(value).isNotNull(), above))
    return out.drop(*[p for probs in by_value.values() for p in probs])


def _with_fences(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    known = df.where(F.col(value).isNotNull())
    hinges = exact_quantiles(known, value, {"q1": 0.25, "median": 0.5, "q3": 0.75}, by)
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    fenced = hinges.withColumn("_low", F.col("q1") - reach).withColumn("_high", F.col("q3") + reach)
    return lookup_join(known, fenced, by) if by else known.crossJoin(F.broadcast(fenced))


def box_stats(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Quartiles, whiskers (most extreme values within 1.5 IQR) and outlier count per group."""
    inside = F.col(value).between(F.col("_low"), F.col("_high"))
    return (
        _with_fences(df.select(*by, value), value, by)
        .groupBy(*by)
        .agg(
            F.max("q1").alias("q1"),
            F.max("median").alias("median"),
            F.max("q3").alias("q3"),
            F.min(F.when(inside, F.col(value))).alias("lower_whisker"),
            F.max(F.when(inside, F.col(value))).alias("upper_whisker"),
            F.count(F.lit(1)).alias("n"),
            F.count(F.when(~inside, F.lit(1))).alias("n_outliers"),
        )
    )


def box_outliers(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Rows beyond the whiskers' fences."""
    fenced = _with_fences(df, value, by)
    return fenced.where(~F.col(value).between(F.col("_low"), F.col("_high"))).drop(
        "q1", "median", "q3", "_low", "_high"
    )


def pretty_step(low: float, high: float, n: int) -> float:
    """Smallest-misfit step of the form 1, 2, 5 or 10 x 10^j for about ``n`` cells."""
    cell = (high - low) / n
    base = 10.0 ** math.floor(math.log10(cell))
    step = base
    # Bias towards larger steps (1.5) and the matching weight for 5s (2.75).
    for factor, bias in ((2, 1.5), (5, 2.75), (10, 1.5)):
        if factor * base - cell >= bias * (cell - step):
            break
        step = factor * base
    return step


def histogram_breaks(n: int, low: float, high: float) -> tuple[float, float, int]:
    """(first break, step, number of cells) for Sturges' number of cells widened to round values."""
    cells = math.ceil(math.log2(n) + 1) if n > 0 else 1
    if high == low:
        width = abs(high) if high else 1.0
        low, high = low - width / 2, high + width / 2
    step = pretty_step(low, high, cells)
    first, last = math.floor(low / step + 1e-7), math.ceil(high / step - 1e-7)
    return first * step, step, last - first


def histogram(df: DataFrame, value: str) -> DataFrame:
    """Counts in right-closed cells (the first closed on both sides), empty cells included."""
    seen = (
        df.select(F.col(value).cast("double").alias("_v"))
        .where(F.col("_v").isNotNull())
    )
    n, low, high = seen.agg(F.count("_v"), F.min("_v"), F.max("_v")).first()
    spark = df.sparkSession
    if not n:
        return spark.range(0).select(
            F.col("id").cast("int").alias("cell"),
            F.lit(0.0).alias("lower"),
            F.lit(0.0).alias("upper"),
            F.col("id").alias("n"),
        )
    first, step, cells = histogram_breaks(n, low, high)
    cell = F.greatest(F.ceil((F.col("_v") - F.lit(first)) / F.lit(step)), F.lit(1)).cast("int")
    counts = seen.groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    frame = spark.range(1, cells + 1).select(F.col("id").cast("int").alias("cell"))
    return frame.join(counts, "cell", "left").select(
        "cell",
        (F.lit(first) + (F.col("cell") - 1) * F.lit(step)).alias("lower"),
        (F.lit(first) + F.col("cell") * F.lit(step)).alias("upper"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def binned_distribution(
    df: DataFrame, variables: list[str], cells: int, by: list[str], categorical: list[str] | None = None
) -> DataFrame:
    """Per variable, equal-width cells over its range and the share of each group in each cell.

    The data behind density and jitter plots: variable, ``by``, cell, n, proportion.  Categorical covariates
    have a row per level instead of a cell, and the result then has a column ``level``.  Every variable is
    counted on its own, so no row is multiplied.
    """
    # one row with the range of every variable
    ranges = df.agg(
        *[F.min(F.col(v).cast("double")).alias(f"_l{i}") for i, v in enumerate(variables)],
        *[F.max(F.col(v).cast("double")).alias(f"_h{i}") for i, v in enumerate(variables)],
    )
    no_level, no_cell = F.lit(None).cast("string").alias("level"), F.lit(None).cast("int").alias("cell")
    counts = []
    for i, v in enumerate(variables):
        low, high = F.col(f"_l{i}"), F.col(f"_h{i}")
        known = df.select(*by, F.col(v).cast("double").alias("_v")).where("_v is not null").crossJoin(F.broadcast(ranges))
        place = F.coalesce(ratio(F.col("_v") - low, high - low) * cells, F.lit(0.0))
        cell = F.least(F.greatest(F.ceil(place), F.lit(1)), F.lit(cells)).cast("int").alias("cell")
        counts.append(known.groupBy(F.lit(v).alias("variable"), *by, cell, no_level).agg(F.count(F.lit(1)).alias("n")))
    for c in categorical or []:
        level = F.col(c).cast("string").alias("level")
        counts.append(df.groupBy(F.lit(c).alias("variable"), *by, no_cell, level).agg(F.count(F.lit(1)).alias("n")))
    counted = reduce(DataFrame.unionAll, counts)
    # totals over the counted table: at most variables x groups x cells (or levels) rows
    totals = counted.groupBy("variable", *by).agg(F.sum("n").alias("_all"))
    shares = lookup_join(counted, totals, ["variable", *by], unique=True).withColumn("proportion", ratio("n", "_all")).drop("_all")
    return shares if categorical else shares.drop("level")
