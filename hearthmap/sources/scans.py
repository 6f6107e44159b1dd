"""Typed scans of landed files."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from hearthmap.constants import STUDY_MONTHS, STUDY_START
from hearthmap.functions.joins import lookup_join


def study_months(start: tuple[int, int] = STUDY_START, count: int = STUDY_MONTHS) -> list[date]:
    """First days of ``count`` consecutive months."""
    year, month = start
    steps = range(month - 1, month - 1 + count)
    return [date(year + s // 12, s % 12 + 1, 1) for s in steps]


def month_start(c: Column) -> Column:
    """'yyyyMM' text to the first day of the month."""
    return F.to_date(F.concat(c, F.lit("01")), "yyyyMMdd")


def scan_csv(spark: SparkSession, paths: str | list[str], schema: str) -> DataFrame:
    """Headered CSV with a declared schema; columns are matched to the header by name check."""
    return spark.read.schema(schema).csv(paths, header=True, enforceSchema=False)


def scan_code_months(
    spark: SparkSession,
    base: str,
    codes: list[str],
    months: list[date],
    schema: str,
    code: str = "bnf_code",
) -> DataFrame:
    """One scan over the code x month files below ``base``, each row tagged with its file's code.

    Layout: ``<base>/code=<code>/month=<yyyy-MM-dd>/``, the usual partition folders: the filter on them
    prunes what is not wanted before anything is opened, and a code without files in a month has no
    rows there.
    """
    rows = scan_csv(spark, base, f"{schema}, `code` string, `month` date")
    wanted = F.col("code").isin(*codes) & F.col("month").isin(*months)
    return rows.where(wanted).drop("month").withColumnRenamed("code", code)


def scan_months(
    spark: SparkSession,
    pattern: str,
    months: list[date],
    schema: str,
    keep: Column | None = None,
) -> DataFrame:
    """One scan over monthly files; ``pattern`` has a ``{month}`` place for yyyyMM.

    Months without files have no rows; a pattern that meets no file at all raises.  ``keep`` is the per-row filter; the scan applies it while reading.
    """
    any_month = "{" + ",".join(f"{m:%Y%m}" for m in months) + "}"
    rows = scan_csv(spark, pattern.replace("{month}", any_month), schema)
    return rows if keep is None else rows.where(keep)


def scan_csv_after_preamble(
    spark: SparkSession, path: str | list[str], skip: int, schema: str | None = None
) -> DataFrame:
    """CSV files whose header each follows ``skip`` preamble lines; any number of files and splits.

    Line numbers come from the scan: ids are consecutive inside a split, and the counts of a file's splits in
    order say which line a split begins with.  Without a schema all columns are text named by the first
    file's header line.  Records must not span lines.
    """
    lines = spark.read.option("recursiveFileLookup", "true").text(path).select(
        "value",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_id"),
    )
    counts = lines.groupBy("_file", "_start").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("_file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    begun = counts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    # one row per file or so: just the splits that hold lines of a preamble or a header
    heads = begun.where(F.col("_before") <= skip).drop("_n")
    numbered = lookup_join(lines, heads, ["_file", "_start"]).withColumn(
        "_line", F.col("_before") + F.col("_id") - F.col("_first")
    )
    fields = schema
    if fields is None:
        header = numbered.where(F.col("_line") == skip).orderBy("_file").first()["value"]
        names = spark.createDataFrame([(header,)], "value string").select(
            F.from_csv("value", F.lit(_text_fields(header.count(",") + 1))).alias("r")
        )
        fields = ", ".join(f"`{c}` string" for c in names.select("r.*").first() if c is not None)
    body = F.col("_line").isNull() | (F.col("_line") > skip)
    data = numbered.where(body & (F.length("value") > 0))
    return data.select(F.from_csv("value", F.lit(fields)).alias("r")).select("r.*")


def _text_fields(n: int) -> str:
    return ", ".join(f"c{i} string" for i in range(n))


def landed_sheet(spark: SparkSession, path: str) -> DataFrame:
    """Named sheet landed as an all-text table with its row number in ``_row``."""
    return spark.read.parquet(path)
