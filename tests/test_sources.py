from datetime import date

import pytest
from conftest import table
from pyspark.sql import functions as F

from hearthmap.constants import RX_ENGLAND
from hearthmap.sources import scans, sheets, sinks


def test_study_months():
    months = scans.study_months()
    assert months[0] == date(2024, 8, 1) and months[-1] == date(2025, 7, 1) and len(months) == 12


def test_code_month_scan_reads_only_wanted_files(frame, tmp_path):
    row = "c,P1,Practice,1.5,2,3,4,2024-08-01"
    head = "ccg,row_id,row_name,actual_cost,items,quantity,setting,date"
    for code in ("0402", "0403"):
        for month in ("2024-08-01", "2024-09-01"):
            folder = tmp_path / f"code={code}" / f"month={month}"
            folder.mkdir(parents=True)
            (folder / "part.csv").write_text(f"{head}\n{row}\n")
    spark = frame([(1,)], "x int").sparkSession
    out = scans.scan_code_months(spark, str(tmp_path), ["0402"], [date(2024, 8, 1)], RX_ENGLAND)
    assert table(out, "bnf_code", "row_id", "items") == [("0402", "P1", 2.0)]
    assert out.schema["date"].dataType.simpleString() == "date"


def test_monthly_scan_filters(frame, tmp_path):
    for month in ("202408", "202409"):
        (tmp_path / f"m{month}.csv").write_text("Code,N\n0403A,1\n0101,2\n")
    spark = frame([(1,)], "x int").sparkSession
    out = scans.scan_months(
        spark, str(tmp_path) + "/m{month}.csv", scans.study_months(count=2), "Code string, N double", F.col("Code").startswith("0403")
    )
    assert table(out, "Code", "N") == [("0403A", 1.0), ("0403A", 1.0)]
    assert frame([("202408",)], "m string").select(scans.month_start(F.col("m"))).first()[0] == date(2024, 8, 1)


def test_preamble_is_skipped_in_a_split_file(frame, tmp_path):
    spark = frame([(1,)], "x int").sparkSession
    lines = ["Title", "", "note, with comma", 'oa,"All, people",1'] + [f"o{i},{i},-" for i in range(500)]
    path = tmp_path / "ages.csv"
    path.write_text("\n".join(lines) + "\n")
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        out = scans.scan_csv_after_preamble(spark, str(path), 3)
        assert out.columns == ["oa", "All, people", "1"]
        rows = table(out, *out.columns)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert sorted(rows) == sorted((f"o{i}", str(i), "-") for i in range(500))
    typed = scans.scan_csv_after_preamble(spark, str(path), 3, "oa string, people int, y string")
    assert typed.agg(F.sum("people")).first()[0] == sum(range(500))


def test_preambles_of_many_files_over_several_splits(frame, tmp_path):
    """The preamble itself may span splits; each file is numbered on its own."""
    spark = frame([(1,)], "x int").sparkSession
    for f in range(3):
        lines = [f"note {f} {'x' * 300}"] * 6 + ["a,b"] + [f"{f}-{i},{i}" for i in range(80 * f)]
        (tmp_path / f"f{f}.csv").write_text("\n".join(lines) + "\n")
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        out = scans.scan_csv_after_preamble(spark, str(tmp_path), 6)
        assert out.columns == ["a", "b"]
        assert table(out, "a", "b") == sorted((f"{f}-{i}", str(i)) for f in range(3) for i in range(80 * f))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def test_sheet_cleaning(frame):
    sheet = frame([(1, "t", None), (2, "t", None), (3, "name", "n"), (4, "a", "1"), (5, "b", "2"), (6, "end", None)], "_row int, c1 string, c2 string")
    body = sheets.promote_header(sheets.trim_rows(sheet, (1, 2), (6, 6)), 3)
    assert body.columns == ["_row", "name", "n"]
    assert table(sheets.pick_columns(body, {"label": "name", "count": 2}), "label", "count") == [("a", "1"), ("b", "2")]


def test_csv_round_trip(frame, tmp_path):
    df = frame([("0403", 1.25, None), ("a,b", None, "q\"x")], "code string, v double, s string")
    path = str(tmp_path / "out")
    sinks.write_csv(df, path)
    back = scans.scan_csv(df.sparkSession, path, "code string, v double, s string")
    assert table(back, "code", "v", "s") == table(df, "code", "v", "s")
    with pytest.raises(Exception):
        sinks.write_csv(df, path)
    sinks.write_parquet(df, str(tmp_path / "p"), partition_by=["code"])
    assert df.sparkSession.read.parquet(str(tmp_path / "p")).count() == 2


def test_scans_survive_gaps(frame, tmp_path):
    spark = frame([(1,)], "x int").sparkSession
    row = "c,P1,Practice,1.5,2,3,4,2024-08-01"
    head = "ccg,row_id,row_name,actual_cost,items,quantity,setting,date"
    for code, month in (("0402", "2024-08-01"), ("0403", "2024-09-01"), ("a%3Ab", "2024-09-01")):
        folder = tmp_path / "codes" / f"code={code}" / f"month={month}"
        folder.mkdir(parents=True)
        (folder / "part.csv").write_text(f"{head}\n{row}\n")
    months = [date(2024, 8, 1), date(2024, 9, 1), date(2024, 10, 1)]
    out = scans.scan_code_months(spark, str(tmp_path / "codes"), ["0402", "a:b", "none"], months, RX_ENGLAND)
    assert table(out, "bnf_code", "row_id") == [("0402", "P1"), ("a:b", "P1")]
    (tmp_path / "m202408.csv").write_text("Code,N\n0403A,1\n")
    out = scans.scan_months(spark, str(tmp_path) + "/m{month}.csv", months, "Code string, N double")
    assert table(out, "Code", "N") == [("0403A", 1.0)]


def test_positions_hold_where_headers_repeat(frame):
    sheet = frame([(1, "Code", "Pop", "Pop"), (2, "a", "1", "2")], "_row int, c1 string, c2 string, c3 string")
    body = sheets.promote_header(sheet, 1)
    assert table(sheets.pick_columns(body, {"code": "Code", "second": 3}), "code", "second") == [("a", "2")]
    with pytest.raises(ValueError):
        sheets.pick_columns(body, {"n": "Pop"})
