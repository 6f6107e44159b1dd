"""Equi-joins with the reference's key rules, safe for hot keys.

The ``lookup`` side has at most a handful of rows per key.  It is written once and its size checked:
a small one is broadcast, so the many-rows side is not moved at all.  For a larger one the few keys
that hold a large share of the rows are found, and just those are split over many tasks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from hearthmap.session import materialise, shuffle_width, size_in_bytes

Keys = list[str] | list[tuple[str, str]]
# Written lookups up to this many bytes of files are broadcast.
BROADCAST_BYTES = 8_000_000
# A key is hot when it has more rows than this fraction of an even task's share.
HOT_SHARE = 4


def _pairs(on: Keys) -> list[tuple[str, str]]:
    return [(k, k) if isinstance(k, str) else k for k in on]


def _equal(pairs: list[tuple[str, str]]) -> Column:
    return reduce(Column.__and__, [F.col(a).eqNullSafe(F.col(b)) for a, b in pairs])


def _renamed(df: DataFrame, names: list[str], prefix: str) -> tuple[DataFrame, list[str]]:
    """Keys under new names, so that a key of the same name on both sides stays apart."""
    new = {n: f"{prefix}{i}" for i, n in enumerate(names)}
    return df.withColumnsRenamed(new), list(new.values())


def lookup_join(
    many: DataFrame,
    lookup: DataFrame,
    on: Keys,
    how: str = "left",
    *,
    unique: bool = False,
    written: bool = False,
    sizes: DataFrame | None = None,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Left or inner join of a large side to a lookup; NULL keys match NULL keys.

    ``unique``: every key has about one row on the left too, so no key can be hot.  ``written``:
    the lookup is a plain table already.  ``sizes``: rows per left key (column ``_n``) where they are
    known already.
    """
    pairs = _pairs(on)
    if not unique and not written:
        lookup = materialise(lookup)
    right, keys = _renamed(lookup, [b for _, b in pairs], "_key")
    same = [(a, k) for (a, _), k in zip(pairs, keys)]
    if unique:
        return many.join(right, _equal(same), how).drop(*keys)
    if size_in_bytes(lookup) <= broadcast_bytes:
        return many.join(F.broadcast(right), _equal(same), how).drop(*keys)
    return _split_join(many, right, same, how, sizes)


def _hot_keys(sizes: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with a large share of all rows and the number of tasks to split each over.

    At most HOT_SHARE x shuffle width keys can qualify, whatever the data.
    """
    parts = HOT_SHARE * shuffle_width(sizes.sparkSession)
    total = sizes.agg(F.sum("_n").alias("_all"))  # one row
    share = F.col("_n") * parts
    return (
        sizes.crossJoin(F.broadcast(total))
        .where(share > F.col("_all"))
        .select(*keys, F.ceil(share / F.col("_all")).cast("int").alias("_copies"))
    )


def _split_join(
    many: DataFrame,
    right: DataFrame,
    same: list[tuple[str, str]],
    how: str,
    sizes: DataFrame | None,
) -> DataFrame:
    """Shuffled join in which rows of a hot key are dealt out by row hash over copies of its lookup."""
    left_keys, right_keys = [a for a, _ in same], [b for _, b in same]
    if sizes is None:
        sizes = many.groupBy(*left_keys).agg(F.count(F.lit(1)).alias("_n"))
    hot = materialise(_hot_keys(sizes, left_keys))
    if hot.isEmpty():
        return many.join(right, _equal(same), how).drop(*right_keys)
    hot, hot_keys = _renamed(hot, left_keys, "_hot")
    # proven bound: see _hot_keys
    dealt = many.join(F.broadcast(hot), _equal(list(zip(left_keys, hot_keys))), "left").withColumn(
        "_deal",
        F.coalesce(F.pmod(F.xxhash64(*many.columns), F.col("_copies")), F.lit(0)).cast("int"),
    )
    copied = right.join(F.broadcast(hot), _equal(list(zip(right_keys, hot_keys))), "left")
    copied = copied.withColumn(
        "_copy", F.explode(F.sequence(F.lit(0), F.coalesce("_copies", F.lit(1)) - 1))
    ).drop(*hot_keys, "_copies")
    joined = dealt.drop(*hot_keys, "_copies").join(
        copied, _equal([*same, ("_deal", "_copy")]), how
    )
    return joined.drop("_deal", "_copy", *right_keys)


def _unmatched(many: DataFrame, lookup: DataFrame, on: Keys) -> DataFrame:
    """Lookup rows whose key never occurs on the many side (distinct keys are combined first)."""
    pairs = _pairs(on)
    seen, keys = _renamed(many.select(*[a for a, _ in pairs]).distinct(), [a for a, _ in pairs], "_seen")
    return lookup.join(seen, _equal([(b, k) for (_, b), k in zip(pairs, keys)]), "left_anti")


def _padded(rows: DataFrame, on: Keys, target: DataFrame) -> DataFrame:
    """Unmatched lookup rows in the layout of the joined table, key under the many-side name."""
    renamed = rows.withColumnsRenamed({b: a for a, b in _pairs(on)})
    return renamed.select(
        *[
            F.col(f"`{f.name}`")
            if f.name in renamed.columns
            else F.lit(None).cast(f.dataType).alias(f.name)
            for f in target.schema.fields
        ]
    )


def _with_unmatched(
    many: DataFrame, lookup: DataFrame, on: Keys, how: str, options: dict
) -> DataFrame:
    lookup = materialise(lookup)  # read by both parts
    joined = lookup_join(many, lookup, on, how, written=True, **options)
    return joined.unionByName(_padded(_unmatched(many, lookup, on), on, joined))


def full_join(many: DataFrame, lookup: DataFrame, on: Keys, **options) -> DataFrame:
    """Full outer join, NULL keys match, one key column (many-side name).

    Left join plus unmatched lookup rows: unlike a plain full outer join both parts can be broadcast
    or split when one key is hot.  ``options`` as for :func:`lookup_join`.
    """
    return _with_unmatched(many, lookup, on, "left", options)


def keep_all_lookup(many: DataFrame, lookup: DataFrame, on: Keys, **options) -> DataFrame:
    """Right outer join that keeps every lookup row, one key column (many-side name)."""
    return _with_unmatched(many, lookup, on, "inner", options)


def group_totals(
    df: DataFrame,
    keys: list[str],
    totals: dict[str, Column],
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Attach group aggregates to every row.

    Aggregate-then-join instead of a window: the aggregate combines map-side and the join splits
    hot keys, where a window would move each group into a single task.
    """
    sums = materialise(
        df.groupBy(*keys).agg(
            *[c.alias(name) for name, c in totals.items()], F.count(F.lit(1)).alias("_n")
        )
    )
    return lookup_join(
        df,
        sums.drop("_n"),
        keys,
        written=True,
        sizes=sums.select(*keys, "_n"),
        broadcast_bytes=broadcast_bytes,
    )
