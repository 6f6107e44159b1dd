import math
import random

import numpy as np
import pytest
from conftest import table
from pyspark.sql import functions as F

from hearthmap.constants import england_age_columns, scotland_age_columns
from hearthmap.operators import bins, group_tests, hotspots, reshape
from hearthmap.plans import context as plans
from hearthmap.plans.study import COMPARISONS, hotspot_tests


def test_quantile_bins_never_split_ties(frame):
    df = frame([(1.0,), (2.0,), (3.0,), (10.0,), (None,)], "x double")
    assert table(bins.quantile_bins(df, {"b": ("x", 4)}), "x", "b") == [(None, None), (1.0, 1), (2.0, 2), (3.0, 3), (10.0, 4)]
    tied = frame([(5.0,)] * 6 + [(7.0,), (9.0,)], "x double")
    assert set(table(bins.quantile_bins(tied, {"b": ("x", 4)}), "x", "b")) == {(5.0, 1), (7.0, 4), (9.0, 4)}


def test_box_stats(frame):
    values = [1.0, 2.0, 3.0, 4.0, 100.0]
    df = frame([("a", v) for v in values] + [("b", 5.0), ("b", None)], "g string, x double")
    assert table(bins.box_stats(df, "x", ["g"]), "g", "q1", "median", "q3", "lower_whisker", "upper_whisker", "n", "n_outliers") == [
        ("a", 2.0, 3.0, 4.0, 1.0, 4.0, 5, 1), ("b", 5.0, 5.0, 5.0, 5.0, 5.0, 1, 0)
    ]
    assert table(bins.box_outliers(df, "x", ["g"]), "g", "x") == [("a", 100.0)]


@pytest.mark.parametrize("low,high,n,expected", [(0.0, 10.0, 5, 2.0), (1.0, 97.0, 7, 10.0), (0.0, 1.0, 4, 0.2), (3.0, 4.9, 6, 0.5)])
def test_round_steps(low, high, n, expected):
    assert bins.pretty_step(low, high, n) == pytest.approx(expected)


def test_histogram_counts_every_value_once(frame):
    rng = random.Random(2)
    values = [round(rng.gauss(50, 12), 3) for _ in range(500)]
    rows = bins.histogram(frame([(v,) for v in values] + [(None,)], "x double"), "x").orderBy("cell").collect()
    assert sum(r["n"] for r in rows) == 500
    for i, r in enumerate(rows):
        inside = [v for v in values if (r["lower"] < v or (i == 0 and v == r["lower"])) and v <= r["upper"]]
        assert r["n"] == len(inside)


def test_age_bands(frame):
    columns = ["Total", *england_age_columns()]
    counts = {"F0": 1, "M17": 2, "F18": 3, "M64": 4, "F65": 5, "M90": 6, "Total": 21}
    sheet = frame([("A", *[counts.get(c, 0) for c in columns])], "area string, " + ", ".join(f"`{c}` bigint" for c in columns))
    row = reshape.england_age_bands(sheet, "area", columns).first()
    assert (row["<=17"], row["18-64"], row["65+"], row["Total"]) == (3, 7, 11, 21)
    assert row["wa_perc"] == pytest.approx(1 / 3)
    missing = sheet.withColumn("F20", F.lit(None).cast("bigint"))
    assert reshape.england_age_bands(missing, "area", columns).first()["18-64"] is None


def test_output_area_ages(frame):
    sheet = frame(
        [("o1", 5, "2", "-", "3"), ("o2", 1, "1", "x", "-")],
        "oa string, `All people` int, `Under 1` string, `1` string, `100 and over` string",
    )
    lookup = frame([("o1", "Z")], "OA22 string, DZ22 string")
    out = reshape.scotland_age_bands(sheet, "oa", lookup, "OA22", "DZ22", "area")
    assert table(out, "area", "<=17", "18-64", "65+", "Total") == [(None, 1.0, None, 0.0, 1.0), ("Z", 2.0, None, 3.0, 5.0)]


def test_area_sheet_widens_an_area_in_one_task(spark, tmp_path):
    """Wide rows are made behind the last exchange, so that no task holds those of areas that are not its own."""
    from hearthmap import standins

    schemas = {name: spark.createDataFrame([], standins.SCHEMAS[name]).schema for name in ("orders", "lineitem")}
    lines = [(1, 3.0, "O", "N"), (1, 3.0, "O", "R"), (2, 3.0, "F", "N"), (2, 60.0, "F", "N"), (3, 50.0, "F", "A")]
    for name, columns, rows in [
        ("orders", ["o_orderkey", "o_custkey"], [(1, 7), (2, 7), (3, 8)]),
        ("lineitem", ["l_orderkey", "l_quantity", "l_linestatus", "l_returnflag"], lines),
    ]:
        df = spark.createDataFrame(rows, columns)
        cells = [(F.col(f.name) if f.name in columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schemas[name]]
        df.select(*cells).write.parquet(f"{tmp_path}/{name}.parquet")
    sheet = standins.output_area_sheet(spark, str(tmp_path), scotland_age_columns())
    plan = sheet._jdf.queryExecution().executedPlan().toString().splitlines()
    moved = [i for i, line in enumerate(plan) if "Exchange" in line]
    made = [i for i, line in enumerate(plan) if "Aggregate" in line]
    assert made and max(made) < min(moved)
    # an age that is no column leaves the area's row as it is
    assert table(sheet, "oa_code", "All people", "3", "43", "90", "99") == [
        ("OA7", 3, "2", "1", "-", "-"), ("OA8", 1, "-", "-", "1", "-")
    ]


@pytest.mark.parametrize("sexed,oldest,labels", [(True, 90, england_age_columns()), (False, 99, scotland_age_columns())])
def test_band_rules_agree(frame, sexed, oldest, labels):
    extra = ["Total", "All people", "F91", "0", "150", "note", "M", "Under 1", "100 and over", "F-1"]
    out = frame([(x,) for x in [*labels, *extra]], "l string").select("l", reshape.age_band("l", oldest, sexed).alias("b"))
    assert {r["l"]: r["b"] for r in out.collect()} == {x: reshape.band_of(x, oldest, sexed) for x in [*labels, *extra]}
    bad = reshape.age_band_quality(frame([("note",), ("note",), (labels[5],)], "l string"), "l", oldest, sexed)
    assert table(bad, "l", "rows") == [("note", 2)]


def test_long_and_wide_are_inverse(frame):
    df = frame([("a", 1, 2), ("b", 3, None)], "k string, `x y` int, `z's` int")
    long = reshape.to_long(df, ["k"], ["x y", "z's"])
    assert table(long, "k", "name", "value") == [("a", "x y", 1), ("a", "z's", 2), ("b", "x y", 3), ("b", "z's", None)][:4]
    back = reshape.to_wide(long, "k", "name", "value", ["x y", "z's"])
    assert table(back, *df.columns) == table(df, *df.columns)


def test_wide_counts_fill(frame):
    df = frame([("a", "x", 1), ("a", "x", 2), ("b", "y", None)], "k string, c string, n int")
    out = reshape.wide_counts(df, "k", "c", "n")
    assert table(out, "k", "x", "y") == [("a", 3, 0), ("b", 0, None)]


def test_crosstab_columns_add_up(frame):
    df = frame([("u", "H"), ("u", "E"), ("r", "E"), (None, "E"), ("r", None)], "r string, c string")
    rows = reshape.crosstab_column_share(df, "r", "c", ["E", "H", "unused"]).collect()
    assert {r["r"] for r in rows} == {"u", "r", "NA_"}
    for c, total in (("E", 1.0), ("H", 1.0), ("NA_", 1.0), ("unused", 0.0)):
        assert sum(r[c] for r in rows) == pytest.approx(total)


def test_welch_known_values(frame):
    df = frame([("a", float(v)) for v in (1, 2, 3, 4, 9)] + [("b", float(v)) for v in (2, 7, 8, 5)] + [(None, 1.0), ("a", None)], "g string, y double")
    row = group_tests.welch(df, "y", "g").first()
    assert (row["f"], row["df1"], row["df2"]) == (pytest.approx(0.7831978320), 1.0, pytest.approx(6.9408516278))
    assert 0.3 < row["p"] < 0.5


def _anova(groups):
    values = np.concatenate(groups)
    between = sum(len(g) * (np.mean(g) - values.mean()) ** 2 for g in groups)
    within = sum(((g - np.mean(g)) ** 2).sum() for g in groups)
    df1, df2 = len(groups) - 1, len(values) - len(groups)
    return between / df1 / (within / df2), df1, df2


def test_anova_and_levene(frame):
    rng = np.random.default_rng(4)
    groups = [rng.normal(m, s, n) for m, s, n in ((0, 1, 30), (0.4, 2, 25), (1, 1, 44))]
    df = frame([(f"g{i}", float(v)) for i, g in enumerate(groups) for v in g], "g string, y double")
    f, df1, df2 = _anova(groups)
    row = group_tests.anova(df, "y", "g").first()
    assert (row["f"], row["df1"], row["df2"]) == (pytest.approx(f), df1, df2)
    f, df1, df2 = _anova([np.abs(g - np.median(g)) for g in groups])
    row = group_tests.levene(df, "y", "g").first()
    assert (row["f"], row["df1"], row["df2"]) == (pytest.approx(f), df1, df2)
    assert 0 <= row["p"] <= 1


def _indicator_rows(n):
    rng = random.Random(9)
    levels = ["Very hot", "Hot", "Insignificant", "Cold", "unknown", None]
    rows = []
    for i in range(n):
        rates = [round(rng.random(), 4) for _ in range(4)]
        rows.append((f"{'EWS'[i % 3]}{i:08d}", rng.choice(levels), rng.uniform(1, 9), None if i % 13 == 0 else rng.uniform(0, 1), "Urban", *rates))
    return rows


AREAS = (
    "LSOA21CD string, classification string, LSOA_incmedian double, LSOA_FPmean double, ruc21ind string, "
    "inhaler_prv double, antidep_prv double, antianx_prv double, antipsych_prv double"
)


def test_analysis_table(frame):
    areas = frame(_indicator_rows(200), AREAS).withColumn("...1", F.lit(1))
    ages = frame([("E00000000", 0.5), (None, 0.1)], "area_code string, wa_perc double")
    scot = frame([("S00000002", "Other Urban Areas")], "DZ22_Code string, UR6_Name string")
    out = hotspots.analysis_table(areas, ages, scot).toPandas()
    assert len(out) == 200 and "...1" not in out.columns
    known = out[out.LSOA_FPmean.notna()]
    assert (known.top_20_or_not == (known.fp_dec_mean >= 9)).all()
    assert (known.top_20_or_not == (known.LSOA_FPmean > np.quantile(known.LSOA_FPmean, 0.8))).all()
    assert (out[out.LSOA_FPmean.isna()].top_20_or_not == 0).all()
    by_id = out.set_index("LSOA21CD")
    assert by_id.loc["S00000002", "urb_rur"] == "Other Urban Areas"
    assert by_id.loc["S00000002", "urb_or_not"] == "Urban" and by_id.loc["S00000005", "urb_or_not"] == "Small towns and rural"
    assert by_id.loc["E00000000", "wa_perc"] == 0.5 and math.isnan(by_id.loc["E00000003", "wa_perc"])


def test_hotspot_tests(frame):
    rows = hotspot_tests(frame(_indicator_rows(120), AREAS)).collect()
    assert [(r["subset"], r["test"], r["measure"]) for r in rows] == COMPARISONS
    assert all(0 <= r["p"] <= 1 for r in rows)


def test_context_plans(frame):
    width = 32
    header = ["PCN ODS code", "PCN name", "Practice code", "Practice name", *[f"h{i}" for i in range(5, width + 1)]]
    def practice(code, people, cases):
        return ["U", "net", code, "name", *["" for _ in range(4)], people, *["" for _ in range(width - 10)], cases]
    body = [(i, *["note"] * width) for i in range(1, 10)]
    body += [(10, *header), (11, *practice("P1", "100", "10")), (12, *practice("P2", "50", "-")), (6199, *["end"] * width)]
    sheet = frame(body, "_row int, " + ", ".join(f"c{i} string" for i in range(1, width + 1)))
    reg = frame([("P1", "A1", 1), ("P1", "A2", 1), ("P2", "A2", 1), ("P3", "A3", 1)], "PRACTICE_CODE string, LSOA_CODE string, NUMBER_OF_PATIENTS bigint")
    out = plans.smoking_by_area(reg, sheet)
    assert table(out, "LSOA_CODE", "smokers", "population", "smoking_prevalence") == [
        ("A1", 5.0, 50.0, 0.1), ("A2", 5.0, 100.0, 0.05), ("A3", 0.0, 0.0, None)
    ]
    crowd = frame(
        [(1, *["t"] * 5), (2, "LSOA code", *plans.OCCUPANCY), (3, "A1", "1", "2", "3", "4"), (4, "A2", "1", "x", "3", "4")],
        "_row int, a string, b string, c string, d string, e string",
    )
    assert table(plans.overcrowding_by_area(crowd), "LSOA_CODE", "Total_households", "Overcrowding_prev") == [("A1", 10.0, 0.1), ("A2", None, None)]
    people = frame([("A1", "x", 1), ("A1", "x", 2), ("A2", "y", 5)], "`Lower layer Super Output Areas Code` string, `Ethnic group (20 categories)` string, Observation bigint")
    assert table(plans.ethnicity_by_area(people), "LSOA_CODE", "x", "y") == [("A1", 3, 0), ("A2", 0, 5)]


def test_values_outside_a_list_raise(frame):
    from hearthmap.operators import apportion, reshape

    df = frame([("a", "X", 1.0), ("a", "Z", 2.0)], "k string, c string, n double")
    for wide in (
        reshape.to_wide(df, "k", "c", "n", ["X", "Y"]),
        reshape.wide_counts(df, "k", "c", "n", ["X", "Y"]),
        reshape.crosstab_column_share(df, "k", "c", ["X", "Y"]),
    ):
        with pytest.raises(Exception, match="value outside its list: Z"):
            wide.collect()
    totals = frame([("P", "other", 1.0, 1.0, 1.0)], "practice string, drug_type string, items double, quantity double, cost double")
    with pytest.raises(Exception, match="value outside its list: other"):
        apportion._wide_totals(totals, "practice", "drug_type", ["known"]).collect()
    assert reshape.wide_counts(df, "k", "c", "n").columns == ["k", "X", "Z"]


def test_footer_of_another_edition(frame):
    from hearthmap.plans import context

    head = ["PCN ODS code", "PCN name", "Practice code", "Practice name", "Population", *[f"h{i}" for i in range(26)], "Population", "Cases"]
    # 1-based: people in column 9, cases in column 32
    rows = [(1, *["t"] * 33), (2, *head), (3, *[str(i) for i in range(33)]), (4, *["end"] * 33)]
    sheet = frame(rows, "_row int, " + ", ".join(f"c{i} string" for i in range(33)))
    out = context.clean_smoking_sheet(sheet, (1, 1), 2, (4, 4))
    assert [tuple(r) for r in out.collect()] == [("0", "1", "2", "3", "8", "31")]


def test_many_categories_and_the_missing_one(frame):
    rows = [("a", "x", 1), ("a", None, 5), ("a", "x", 2), ("b", "y", None), ("b", "y", 3), ("c", None, 4)]
    df = frame(rows, "k string, c string, n int")
    wide = reshape.wide_counts(df, "k", "c", "n")
    assert wide.columns == ["k", "x", "y", "NA"]
    assert table(wide, "k", "x", "y", "NA") == [("a", 3, 0, 5), ("b", 0, None, 0), ("c", 0, 0, 4)]
    maps = {r["k"]: r["counts"] for r in reshape.category_map(df, "k", "c", "n").collect()}
    assert maps == {"a": {"x": 3, "NA": 5}, "b": {"y": None}, "c": {"NA": 4}}
    known, rejects = reshape.wide_counts_and_rejects(df, "k", "c", "n", ["x"])
    assert table(known, "k", "x") == [("a", 3), ("b", 0), ("c", 0)]
    assert table(rejects, "c", "rows") == [(None, 2), ("y", 2)]
    with pytest.raises(ValueError):
        reshape.wide_counts(frame([("a", "NA", 1), ("a", None, 1)], "k string, c string, n int"), "k", "c", "n")


def test_labels_beyond_the_bound_raise(frame, monkeypatch):
    monkeypatch.setattr(reshape, "MOST_COLUMNS", 3)
    df = frame([("a", str(i), 1) for i in range(4)], "k string, c string, n int")
    with pytest.raises(ValueError):
        reshape.wide_counts(df, "k", "c", "n")
    assert len(reshape.category_map(df, "k", "c", "n").first()["counts"]) == 4


def test_pair_distance_of_levels(frame):
    from hearthmap.operators.balance import pair_distance

    rows = [(1, 1, "a", 2.0), (2, 1, "b", 4.0), (3, 1, "a", 9.0), (4, 0, "b", 1.0), (5, 0, "b", 4.0), (6, 0, None, 7.0), (7, 0, "c", 1.0)]
    df = frame(rows, "id long, t int, g string, x double")
    pairs = frame([(1, 4), (2, 5), (3, 6)], "treated_id long, control_id long")
    got = {r["variable"]: r["pair_dist"] for r in pair_distance(df, pairs, "id", "t", ["x"], ["g"]).collect()}
    spread = (2 / 3 * 1 / 3) ** 0.5
    assert got["g_a"] == pytest.approx(2 / 3 / spread) and got["g_b"] == pytest.approx(1 / 3 / spread) and got["g_c"] is None
    assert got["x"] == pytest.approx((1 + 0 + 2) / 3 / 13**0.5)
