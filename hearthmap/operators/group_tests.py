"""One-way tests between groups from group moments."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType

from hearthmap.functions.joins import lookup_join
from hearthmap.functions.nulls import ratio
from hearthmap.functions.ordered import quantiles_of_counts
from hearthmap.functions.tails import f_upper_tail
from hearthmap.session import materialise


@F.pandas_udf(DoubleType())
def f_p_value(f: pd.Series, df1: pd.Series, df2: pd.Series) -> pd.Series:
    """Upper F tail; only ever applied to one-row test results."""
    return pd.Series([f_upper_tail(*row) for row in zip(f, df1, df2)], dtype="float64")


def _moments(df: DataFrame, y: str, g: str) -> DataFrame:
    """One row per group: size, mean, variance."""
    value = F.col(y).cast("double")
    return (
        df.select(value.alias("_y"), F.col(g).alias("_g"))
        .where(F.col("_y").isNotNull() & F.col("_g").isNotNull())
        .groupBy("_g")
        .agg(
            F.count("_y").alias("n"), F.avg("_y").alias("mean"), F.var_samp("_y").alias("var")
        )
    )


def anova(df: DataFrame, y: str, g: str) -> DataFrame:
    """Classic one-way table in one row: sums of squares, mean squares, F and p."""
    return anova_of(_moments(df, y, g))


def anova_of(m: DataFrame) -> DataFrame:
    """The same from a table of group moments (n, mean, var)."""
    n, mean = F.col("n"), F.col("mean")
    overall = m.agg(F.sum(n * mean).alias("_s"), F.sum(n).alias("_n"), F.count(F.lit(1)).alias("_k"))
    # `overall` is one row; a group of one has no variance and adds nothing within
    parts = m.crossJoin(F.broadcast(overall))
    within = F.coalesce((n - 1) * F.col("var"), F.lit(0.0))
    table = parts.agg(
        F.max("_k").alias("_k"),
        F.max("_n").alias("_n"),
        F.sum(n * F.pow(mean - F.col("_s") / F.col("_n"), F.lit(2))).alias("ss_between"),
        F.sum(within).alias("ss_within"),
    )
    table = table.select(
        (F.col("_k") - 1).cast("double").alias("df1"),
        (F.col("_n") - F.col("_k")).cast("double").alias("df2"),
        "ss_between",
        "ss_within",
    )
    table = table.withColumn("ms_between", ratio("ss_between", "df1")).withColumn(
        "ms_within", ratio("ss_within", "df2")
    )
    return table.withColumn("f", ratio("ms_between", "ms_within")).withColumn(
        "p", f_p_value("f", "df1", "df2")
    )


def levene(df: DataFrame, y: str, g: str) -> DataFrame:
    """Homogeneity of variance: one-way test on distances from the group median."""
    value = F.col(y).cast("double")
    known = df.select(F.col(g).alias("_g"), value.alias("_v")).where("_v is not null and _g is not null and not isnan(_v)")
    return levene_of(known.groupBy("_g", "_v").agg(F.count(F.lit(1)).alias("_n")))


def levene_of(counts: DataFrame) -> DataFrame:
    """The same from counts of values per group (_g, _v, _n): medians and both sums come from them."""
    return anova_of(distance_moments(materialise(counts), ["_g"])).select("f", "df1", "df2", "p")


def distance_moments(counts: DataFrame, by: list[str]) -> DataFrame:
    """Per group: n, mean and variance of the distances from its median, from counts of values."""
    medians = quantiles_of_counts(counts, "_v", "_n", {"_median": 0.5}, by)
    gap = F.abs(F.col("_v") - F.col("_median"))
    sums = lookup_join(counts, medians, by).groupBy(*by).agg(
        F.sum("_n").alias("n"),
        (F.sum(F.col("_n") * gap) / F.sum("_n")).alias("mean"),
        F.sum(F.col("_n") * gap * gap).alias("_squares"),
    )
    return sums.withColumn("var", ratio(F.col("_squares") - F.col("n") * F.col("mean") * F.col("mean"), F.col("n") - 1)).drop("_squares")


def welch(df: DataFrame, y: str, g: str) -> DataFrame:
    """One-way test of equal means without assuming equal variances."""
    return welch_of(_moments(df, y, g))


def welch_of(moments: DataFrame) -> DataFrame:
    """The same from a table of group moments (n, mean, var)."""
    m = moments.withColumn("w", ratio("n", "var"))
    w, mean = F.col("w"), F.col("mean")
    overall = m.agg(
        F.sum(w).alias("_w"), F.sum(w * mean).alias("_wm"), F.count(F.lit(1)).cast("double").alias("_k")
    )
    # one row
    parts = m.crossJoin(F.broadcast(overall))
    spread = ratio(F.pow(1 - ratio(w, "_w"), F.lit(2)), F.col("n") - 1)
    sums = parts.agg(
        F.max("_k").alias("k"),
        F.sum(w * F.pow(mean - ratio("_wm", "_w"), F.lit(2))).alias("_between"),
        F.sum(spread).alias("_spread"),
    )
    k = F.col("k")
    h = ratio("_spread", F.pow(k, F.lit(2)) - 1)
    out = sums.select(
        ratio("_between", (k - 1) * (1 + 2 * (k - 2) * h)).alias("f"),
        (k - 1).alias("df1"),
        ratio(F.lit(1.0), 3 * h).alias("df2"),
    )
    return out.withColumn("p", f_p_value("f", "df1", "df2"))
