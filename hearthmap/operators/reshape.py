"""Crosstabs, wide/long reshaping and age bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from hearthmap.constants import (
    AGE_BANDS,
    ENGLAND_AGE_MAX,
    SCOTLAND_AGE_MAX,
    SENIOR_MIN,
    YOUNG_MAX,
)
from hearthmap.functions.joins import lookup_join
from hearthmap.functions.nulls import as_col, dash_to_zero, listed, ratio, strict_sum, to_number
from hearthmap.session import materialise


# Most columns that a wide form makes of the labels it finds; a map (:func:`category_map`) has no such bound.
MOST_COLUMNS = 1_000


def distinct_labels(df: DataFrame, column: str) -> list:
    """Distinct non-null labels of a categorical column that become columns of a result."""
    rows = df.select(column).where(F.col(column).isNotNull()).distinct().limit(MOST_COLUMNS + 1).collect()
    if len(rows) > MOST_COLUMNS:
        raise ValueError(f"{column} has more than {MOST_COLUMNS} labels: use category_map, or name the ones wanted")
    return sorted(r[0] for r in rows)


def crosstab_column_share(
    df: DataFrame, row: str, column: str, levels: list[str], null_label: str = "NA_"
) -> DataFrame:
    """Two-way table with column shares; missing values form their own row and column.

    Counts are combined per (row, column) first; only that small table is pivoted.  A level outside
    ``levels`` raises.
    """
    labelled = df.select(
        F.coalesce(F.col(row).cast("string"), F.lit(null_label)).alias(row),
        F.coalesce(F.col(column).cast("string"), F.lit(null_label)).alias(column),
    )
    columns = [*levels, null_label]
    cells = labelled.groupBy(row, column).agg(F.count(F.lit(1)).alias("_n"))
    cells = cells.withColumn(column, listed(column, columns, column))
    wide = cells.groupBy(row).pivot(column, columns).agg(F.sum("_n"))
    counts = cells.groupBy().agg(
        *[F.sum(F.when(F.col(column) == c, F.col("_n"))).alias(f"_t{i}") for i, c in enumerate(columns)]
    )
    # `counts` is one row by construction
    shares = wide.crossJoin(F.broadcast(counts))
    return shares.select(
        row,
        *[
            F.coalesce(ratio(f"`{c}`", f"_t{i}"), F.lit(0.0)).alias(c)
            for i, c in enumerate(columns)
        ],
    )


def to_long(
    df: DataFrame, ids: list[str], values: list[str], name: str = "name", value: str = "value"
) -> DataFrame:
    """Wide to long, one row per value column (all of one type)."""
    cells = ", ".join(f"'{_quoted(c)}', `{c}`" for c in values)
    return df.select(*ids, F.expr(f"stack({len(values)}, {cells}) AS (`{name}`, `{value}`)"))


def _quoted(text: str) -> str:
    return text.replace("\\", "\\\\").replace("'", "\\'")


def to_wide(
    df: DataFrame, key: str, category: str, value: str, categories: list[str]
) -> DataFrame:
    """Long to wide with a fixed category list; (key, category) must be unique.

    A category outside the list raises.
    """
    checked = df.withColumn(category, listed(category, categories, category))
    return checked.groupBy(key).pivot(category, categories).agg(F.first(value))


def _category_cells(df: DataFrame, key: str, category: str, count: str) -> DataFrame:
    """Sum per (key, category); how many rows each is from."""
    return df.groupBy(key, category).agg(strict_sum(count).alias("_n"), F.count(F.lit(1)).alias("_rows"))


def category_map(
    df: DataFrame, key: str, category: str, count: str, out: str = "counts", null_label: str = "NA"
) -> DataFrame:
    """Sum per (key, category) as one map per key, for any number of categories.

    A category that a key lacks is absent; the missing category goes by ``null_label``.
    """
    named = df.withColumn(category, F.coalesce(F.col(category).cast("string"), F.lit(null_label)))
    entry = F.struct(F.col(category).alias("key"), F.col("_n").alias("value"))
    cells = _category_cells(named, key, category, count)
    return cells.groupBy(key).agg(F.map_from_entries(F.sort_array(F.collect_list(entry))).alias(out))


def wide_counts(
    df: DataFrame,
    key: str,
    category: str,
    count: str,
    categories: list[str] | None = None,
    null_label: str = "NA",
) -> DataFrame:
    """Sum per (key, category), then one column per category, zero-filled.

    A category outside a given list raises.  Without a list all labels become columns (``MOST_COLUMNS`` at
    most), the missing one under ``null_label`` if it occurs.
    """
    if categories is None:
        labels = distinct_labels(df, category)
        if df.where(F.col(category).isNull()).isEmpty():
            return _spread(_category_cells(df, key, category, count), key, category, labels)
        if null_label in map(str, labels):
            raise ValueError(f"{null_label} is a label of {category}: choose another name for the missing one")
        named = df.withColumn(category, F.coalesce(F.col(category).cast("string"), F.lit(null_label)))
        return _spread(_category_cells(named, key, category, count), key, category, [*map(str, labels), null_label])
    cells = _category_cells(df, key, category, count)
    return _spread(cells.withColumn(category, listed(category, categories, category)), key, category, categories)


def wide_counts_and_rejects(
    df: DataFrame, key: str, category: str, count: str, categories: list[str]
) -> tuple[DataFrame, DataFrame]:
    """As :func:`wide_counts` for the listed categories, and the others (NULL included) with their rows.

    Both come from one pass over the rows, whose sums are written once.
    """
    cells = materialise(_category_cells(df, key, category, count))
    known = F.coalesce(F.col(category).isin(*categories), F.lit(False))
    rejects = cells.where(~known).groupBy(category).agg(F.sum("_rows").alias("rows"))
    # a key of which nothing is listed keeps its row
    kept = cells.withColumn("_n", F.when(known, F.col("_n")))
    return _spread(kept, key, category, categories), rejects


def _spread(cells: DataFrame, key: str, category: str, categories: list) -> DataFrame:
    # a cell that exists keeps its value (NULL included); an absent cell becomes zero
    found = [
        F.max(F.when(F.col(category) == c, F.struct(F.col("_n")))).alias(f"_f{i}")
        for i, c in enumerate(categories)
    ]
    return cells.groupBy(key).agg(*found).select(
        key,
        *[
            F.when(F.col(f"_f{i}").isNull(), F.lit(0)).otherwise(F.col(f"_f{i}._n")).alias(str(c))
            for i, c in enumerate(categories)
        ],
    )


def age_band(label: Column | str, oldest: int, sexed: bool) -> Column:
    """Band of an age label ('F0'.., 'M90' or 'Under 1', '1'.., '100 and over'), else NULL."""
    label = as_col(label)
    pattern = r"^[FM]([0-9]+)$" if sexed else r"^([0-9]+)$"
    age = F.regexp_extract(label, pattern, 1).try_cast("int")
    first = 0 if sexed else 1
    band = (
        F.when(age.between(first, YOUNG_MAX), F.lit("<=17"))
        .when(age.between(YOUNG_MAX + 1, SENIOR_MIN - 1), F.lit("18-64"))
        .when(age.between(SENIOR_MIN, oldest), F.lit("65+"))
    )
    if sexed:
        return band.when(label == "Total", F.lit("Total"))
    return (
        band.when(label == "Under 1", F.lit("<=17"))
        .when(label == "100 and over", F.lit("65+"))
        .when(label == "All people", F.lit("Total"))
    )


def band_of(label: str, oldest: int, sexed: bool) -> str | None:
    """Band of one age label; the same rule as :func:`age_band` for a column name."""
    if label == ("Total" if sexed else "All people"):
        return "Total"
    if not sexed and label in ("Under 1", "100 and over"):
        return "<=17" if label == "Under 1" else "65+"
    digits = label[1:] if sexed and label[:1] in ("F", "M") else label
    if not digits.isdigit() or (sexed and digits == label):
        return None
    age = int(digits)
    if age > oldest or (age == 0 and not sexed):
        return None
    return "<=17" if age <= YOUNG_MAX else "65+" if age >= SENIOR_MIN else "18-64"


def _by_band(columns: list[str], oldest: int, sexed: bool) -> dict[str, list[str]]:
    found: dict[str, list[str]] = {band: [] for band in AGE_BANDS}
    for c in columns:
        band = band_of(c, oldest, sexed)
        if band is not None:
            found[band].append(c)
    return found


def _with_band_shares(wide: DataFrame) -> DataFrame:
    return (
        wide.withColumn("young_perc", ratio("`<=17`", "Total"))
        .withColumn("wa_perc", ratio("`18-64`", "Total"))
        .withColumn("senior_perc", ratio("`65+`", "Total"))
    )


def england_age_bands(sheet: DataFrame, key: str, age_columns: list[str]) -> DataFrame:
    """Single-year, single-sex sheet to three bands, total and shares.

    The labels are column names, so bands are added up across columns: no row is multiplied.  A
    missing value makes its band NULL.
    """
    bands = _by_band(age_columns, ENGLAND_AGE_MAX, sexed=True)
    sums = [
        strict_sum(
            F.aggregate(_numbers(columns), F.lit(0.0), lambda total, v: total + v)
        ).alias(band)
        for band, columns in bands.items()
    ]
    return _with_band_shares(sheet.groupBy(key).agg(*sums))


def scotland_age_bands(
    sheet: DataFrame, key: str, lookup: DataFrame, lookup_key: str, zone: str, out: str
) -> DataFrame:
    """Output-area sheet of text counts to bands per zone.

    '-' is zero, unreadable values are dropped (a band without any readable value is NULL), output
    areas without a zone form the NULL zone.  Columns are added up before the lookup join, then one
    aggregate per zone: the two sums of the hierarchy are one.
    """
    ages = [c for c in sheet.columns if c != key]
    partial = []
    for i, columns in enumerate(_by_band(ages, SCOTLAND_AGE_MAX, sexed=False).values()):
        texts = F.array(*[F.col(f"`{c}`") for c in columns]).cast("array<string>")
        readable = F.array_compact(F.transform(texts, lambda t: to_number(dash_to_zero(t))))
        partial.append(F.aggregate(readable, F.lit(0.0), lambda total, v: total + v).alias(f"_s{i}"))
        partial.append(F.size(readable).alias(f"_n{i}"))
    added = sheet.select(key, *partial)
    located = lookup_join(added, lookup.select(lookup_key, zone), [(key, lookup_key)], unique=True)
    sums = [
        F.when(F.sum(f"_n{i}") > 0, F.sum(f"_s{i}")).alias(band) for i, band in enumerate(AGE_BANDS)
    ]
    return _with_band_shares(located.groupBy(F.col(zone).alias(out)).agg(*sums))


def _numbers(columns: list[str]) -> Column:
    return F.array(*[F.col(f"`{c}`") for c in columns]).cast("array<double>")


def age_band_quality(long_labels: DataFrame, label: str, oldest: int, sexed: bool) -> DataFrame:
    """Labels that fall in no band, with their row counts (data-quality output)."""
    return (
        long_labels.withColumn("_band", age_band(label, oldest, sexed))
        .where(F.col("_band").isNull())
        .groupBy(label)
        .agg(F.count(F.lit(1)).alias("rows"))
    )
