"""Running totals and exact quantiles over ordered values without single-task groups.

Values are first collapsed to (group, value, counts) and written once.  The rows are then dealt out in
order of (group, value): every task holds one slice of that order.  Sums per slice, added up in order, tell
each slice what lies before it; only the inside of a slice is ever sorted by one task.  Slices follow the
bytes of the collapsed table, so a task's share is the same however large the data, one group or many; a
table of one slice is just not dealt out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window, functions as F

from hearthmap.functions.joins import lookup_join
from hearthmap.session import materialise, size_in_bytes

# Bytes of the collapsed table's files that one task sorts.
SLICE_BYTES = 16_000_000
SliceFilter = Callable[[DataFrame], DataFrame]


def running_totals(
    counts: DataFrame,
    value: str,
    sums: list[str],
    by: list[str] | None = None,
    only: SliceFilter | None = None,
    slices: int | None = None,
) -> DataFrame:
    """Inclusive running totals of ``sums`` in ``value`` order within ``by``.

    ``counts`` holds one row per (by, value).  Adds ``cum_<s>`` and ``all_<s>``.  ``only`` may
    filter the slice table (columns ``before_<s>``, ``slice_<s>``, ``all_<s>``) so that just the
    slices of interest are sorted.  ``slices``: their number, else as the table's bytes want.
    """
    by = by or []
    table = _sliced(counts, value, by, slices)
    keys = [*by, "_slice"]
    totals = _offsets(table, sums, by)
    if only is not None:
        totals = only(totals)
    joined = lookup_join(table, totals, keys, "inner", unique=True)
    inside = _over(keys).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = {f"cum_{s}": F.col(f"before_{s}") + F.sum(s).over(inside) for s in sums}
    scratch = [f"slice_{s}" for s in sums] + [f"before_{s}" for s in sums]
    return joined.withColumns(running).drop("_slice", *scratch)


def _sliced(counts: DataFrame, value: str, by: list[str], slices: int | None) -> DataFrame:
    """The rows as a written table with the number of their slice of the (by, value) order."""
    table = materialise(counts)
    n = slices or -(-size_in_bytes(table) // SLICE_BYTES)
    if n <= 1:
        return table.withColumn("_slice", F.lit(0))
    dealt = table.repartitionByRange(n, *by, value)
    return materialise(dealt.withColumn("_slice", F.spark_partition_id()))


def _over(keys: list[str]):
    return Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))


def _offsets(table: DataFrame, sums: list[str], by: list[str]) -> DataFrame:
    """Per group and slice: its sums, those of the slices before it, and the group's.

    The order has at most as many (group, slice) rows as groups and slices together.
    """
    totals = table.groupBy(*by, "_slice").agg(*[F.sum(s).alias(f"slice_{s}") for s in sums])
    upto = _over(by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = {f"before_{s}": F.coalesce(F.sum(f"slice_{s}").over(upto), F.lit(0)) for s in sums}
    return totals.withColumns(offsets | {f"all_{s}": F.sum(f"slice_{s}").over(_over(by)) for s in sums})


def exact_quantiles(
    df: DataFrame,
    value: str,
    probs: dict[str, float],
    by: list[str] | None = None,
    slices: int | None = None,
) -> DataFrame:
    """Exact linear-interpolation quantiles, one row per group, one column per probability."""
    by = by or []
    number = F.col(value).cast("double")
    counts = (
        df.select(*by, number.alias("_v"))
        .where(F.col("_v").isNotNull() & ~F.isnan("_v"))
        .groupBy(*by, "_v")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    return quantiles_of_counts(counts, "_v", "_n", probs, by, slices)


def quantiles_of_counts(
    counts: DataFrame, value: str, n: str, probs: dict[str, float], by: list[str], slices: int | None = None
) -> DataFrame:
    """The same from a table of (by, value) with the number of times each value occurs."""
    counts = counts.select(*by, F.col(value).alias("_v"), F.col(n).alias("_n"))
    places = {name: (F.col("all__n") - 1) * F.lit(float(p)) for name, p in probs.items()}
    ranks = F.array_distinct(
        F.array(*[f(h).cast("long") for h in places.values() for f in (F.floor, F.ceil)])
    )

    def holding_a_rank(slices: DataFrame) -> DataFrame:
        end = F.col("before__n") + F.col("slice__n")
        wanted = F.filter(ranks, lambda r: (r >= F.col("before__n")) & (r < end))
        return slices.withColumn("_ranks", wanted).where(F.size("_ranks") > 0)

    hits = (
        running_totals(counts, "_v", ["_n"], by, holding_a_rank, slices)
        .withColumn("_rank", F.explode("_ranks"))
        .where((F.col("_rank") < F.col("cum__n")) & (F.col("_rank") >= F.col("cum__n") - F.col("_n")))
    )

    def at(rank):
        return F.max(F.when(F.col("_rank") == rank.cast("long"), F.col("_v")))

    quantiles = []
    for name, place in places.items():
        low, high = at(F.floor(place)), at(F.ceil(place))
        part = F.max(place - F.floor(place))
        between = low * (1 - part) + high * part
        quantiles.append(F.when(low == high, low).otherwise(between).alias(name))
    return hits.groupBy(*by).agg(*quantiles)
