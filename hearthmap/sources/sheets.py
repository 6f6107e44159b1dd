"""Cleaning of raw sheets: all-text tables with a row number and positional layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

ROW = "_row"


def trim_rows(sheet: DataFrame, *ranges: tuple[int, int]) -> DataFrame:
    """Drop rows by position; each range is (first, last), both included."""
    kept = sheet
    for first, last in ranges:
        kept = kept.where(~F.col(ROW).between(first, last))
    return kept


def promote_header(sheet: DataFrame, header_row: int, drop_before: bool = True) -> DataFrame:
    """Use the text of one row as column names and drop it (and what comes before it)."""
    value_columns = [c for c in sheet.columns if c != ROW]
    # one row
    header = sheet.where(F.col(ROW) == header_row).select(*value_columns).first()
    body = F.col(ROW) > header_row if drop_before else F.col(ROW) != header_row
    names = [n if n is not None else c for n, c in zip(header, value_columns)]
    return sheet.where(body).select(
        ROW, *[F.col(f"`{c}`").alias(n) for c, n in zip(value_columns, names)]
    )


def pick_columns(sheet: DataFrame, picks: dict[str, str | int]) -> DataFrame:
    """Select columns by name or by 1-based position and name them.

    Positions hold where header names repeat; a repeated name cannot be picked by name.
    """
    places = [i for i, c in enumerate(sheet.columns) if c != ROW]
    numbered = sheet.toDF(*[f"_{i}" for i in range(len(sheet.columns))])
    chosen = []
    for out, pick in picks.items():
        named = [i for i in places if sheet.columns[i] == pick]
        if not isinstance(pick, int) and len(named) != 1:
            raise ValueError(f"{len(named)} columns are called {pick}")
        place = places[pick - 1] if isinstance(pick, int) else named[0]
        chosen.append(F.col(f"_{place}").alias(out))
    return numbered.select(*chosen)
