import random

import pytest
from conftest import table

from hearthmap.operators import apportion as A
from hearthmap.operators.classes import (
    DrugClass,
    class_from_list,
    classify_by_listing,
    classify_codes,
    in_any_class,
    in_class,
)
from hearthmap.operators.stacking import bind_rows, drop_index, drop_range, rename_at, stack_rows
from hearthmap.plans.nations import england_volumes, scotland_volumes, wales_volumes

REG = "practice string, area string, patients bigint"
TOTALS = "drug_type string, code string, practice string, practice_name string, items double, quantity double, cost double"


@pytest.fixture(scope="module")
def registrations(frame):
    return frame([("P1", "A1", 30), ("P1", "A2", 70), ("P2", "A2", 50), ("P3", "A1", 10), ("P4", "A3", 0)], REG)


@pytest.fixture(scope="module")
def totals(frame):
    rows = [("P1", "n", 100.0), ("P2", "n", 20.0), ("P2", "renamed", 30.0), ("P9", "n", 40.0)]
    return frame([("c", "x", p, n, v, 2 * v, None if p == "P1" else v) for p, n, v in rows], TOTALS)


def test_apportion(registrations, totals):
    out = A.apportion(registrations, totals, ["c", "unused"])
    assert table(out.where("drug_type = 'c'"), "area", "items", "quantity", "cost") == [
        ("A1", 30.0, 60.0, 0.0), ("A2", 120.0, 240.0, 50.0), ("A3", None, None, None)
    ]
    assert table(out.where("drug_type = 'unused'"), "area", "items") == [("A1", 0.0), ("A2", 0.0), ("A3", None)]


def test_apportion_filled_after(registrations, totals):
    out = A.apportion(registrations, totals, ["c"], filled_after=["c"])
    assert table(out, "area", "items") == [("A1", 30.0), ("A2", 120.0), ("A3", 0.0)]
    by_code = A.apportion_by_code(registrations, totals)
    assert table(by_code, "area", "code", "items") == [("A1", "x", 30.0), ("A2", "x", 120.0)]


def test_mass_is_conserved_with_a_hot_practice(frame):
    rng = random.Random(11)
    reg = [("hot", f"A{i}", rng.randint(1, 50)) for i in range(300)]
    reg += [(f"P{p}", f"A{rng.randint(0, 300)}", rng.randint(1, 9)) for p in range(60)]
    tot = [("c", "x", p, "n", float(rng.randint(1, 99)), 1.0, 1.0) for p in {r[0] for r in reg}]
    out = A.apportion(frame(reg, REG), frame(tot, TOTALS), ["c"])
    assert out.groupBy().sum("items").first()[0] == pytest.approx(sum(t[4] for t in tot))
    shares = A.practice_shares(frame(reg, REG)).groupBy("practice").sum("share")
    assert all(r[1] == pytest.approx(1.0) for r in shares.collect())


def test_one_pass_equals_class_by_class(frame, registrations):
    rows = [("040102A", "P1", 3.0), ("0403AB", "P1", 5.0), ("0403AB", "P2", None), ("0403XY", "P2", 7.0), ("0301", "P2", 9.0)]
    fact = frame([(c, p, v, v, v) for c, p, v in rows], "code string, practice string, items double, quantity double, cost double")
    classes = [DrugClass("a", prefix="0403"), DrugClass("b", codes=("0403AB",)), DrugClass("c", prefix="040102")]
    together = A.apportion(
        registrations, A.practice_totals(classify_codes(fact, "code", classes), ["drug_type", "practice"]), ["a", "b", "c"]
    )
    single = []
    for c in classes:
        totals = A.practice_totals(classify_codes(fact, "code", [c]), ["drug_type", "practice"])
        single += table(A.apportion(registrations, totals, [c.label]), "drug_type", "area", "items")
    key = lambda r: [(v is not None, v) for v in r]
    assert table(together, "drug_type", "area", "items") == sorted(single, key=key)


def test_classes_overlap(frame, spark):
    codes = frame([("0403AB",), ("0403AB",), (None,)], "bnf_presentation_code string")
    listed = class_from_list("list", codes, "bnf_presentation_code")
    fact = frame([("0403AB",), ("0403XY",), ("0301",), (None,)], "code string")
    tagged = classify_codes(fact, "code", [DrugClass("prefix", prefix="0403"), listed])
    assert table(tagged, "code", "drug_type") == [("0403AB", "list"), ("0403AB", "prefix"), ("0403XY", "prefix")]
    listing = frame([("0403AB", "x"), ("0403AB", "y"), ("0403AB", "x"), (None, "z")], "code string, drug_type string")
    assert table(classify_by_listing(fact, "code", listing, "code"), "code", "drug_type") == [("0403AB", "x"), ("0403AB", "y")]


def test_classes_from_tables_in_every_operator(frame):
    codes = frame([("0403AB",), ("0301",), (None,)], "c string")
    listed = class_from_list("list", codes, "c")
    both = DrugClass("both", prefix="0403", codes=("0403AB", "0200"), listing=codes)
    fact = frame([("0403AB",), ("0403XY",), ("0301",), ("0200",), ("9",), (None,)], "code string")
    assert table(in_class(fact, "code", listed), "code") == [("0301",), ("0403AB",)]
    # a code that several entries of one class cover counts once
    assert table(in_class(fact, "code", both), "code") == [("0200",), ("0301",), ("0403AB",), ("0403XY",)]
    assert table(in_any_class(fact, "code", [DrugClass("p", prefix="9"), listed]), "code") == [("0301",), ("0403AB",), ("9",)]
    assert table(in_any_class(fact, "code", [DrugClass("p", prefix="04")]), "code") == [("0403AB",), ("0403XY",)]
    with pytest.raises(ValueError):
        listed.matches("code")
    assert classify_codes(fact, "code", []).collect() == []


def test_totals_come_before_classes_in_one_scan(spark):
    """Prefix and listed classes: the facts are read once and added up below the class step."""
    part = spark.read.parquet("/root/testdata/sf0.001/part.parquet")
    listing = spark.read.parquet("/root/testdata/sf0.001/supplier.parquet")
    mixed = [DrugClass("a", prefix="Brand#1"), DrugClass("b", codes=("Brand#3",)), class_from_list("c", listing, "s_name")]
    totals = A.class_totals(part, "p_brand", mixed, ["p_type"], {"items": "p_size"})
    plan = totals._jdf.queryExecution().optimizedPlan().toString()
    facts = [line for line in plan.splitlines() if "p_brand" in line and "Relation" in line]
    assert len(facts) == 1
    assert plan.index("Join") < plan.index("Generate") < plan.index("Aggregate")
    assert "filter(" not in plan and "array_compact" not in plan


def test_one_scan_and_pushed_prefix(spark):
    from hearthmap.operators.classes import any_class

    part = spark.read.parquet("/root/testdata/sf0.001/part.parquet")
    classes = [DrugClass("a", prefix="Brand#1"), DrugClass("b", codes=("Brand#3", "Brand#4"))]
    assert any_class("p_brand", classes) is not None
    plan = classify_codes(part, "p_brand", classes).select("p_partkey", "drug_type")._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan ==") :]
    assert physical.count("FileScan") == 1
    assert "StringStartsWith(p_brand,Brand#1)" in physical
    assert "ReadSchema: struct<p_partkey:bigint,p_brand:string>" in physical


ZONES = "zone string, locality string, parent string"


def _two_step(frame, faithful):
    zones = frame([("Z1", "L1", "H"), ("Z2", "L1", "H"), ("Z3", "L2", "H")], ZONES)
    people = frame([("Z1", 60), ("Z2", 40), ("Z3", 10)], "zone_code string, population bigint")
    shares = A.zone_shares(zones, people)
    practices = frame([("1", "Z1", "H"), ("2", "Z2", "other"), ("3", "Z1", None)], "practice string, zone string, practice_parent string")
    listed = A.practice_localities(practices, shares)
    assert table(listed, "practice", "parent_check") == [("1", 1), ("2", 0), ("3", 0)]
    totals = frame([("c", p, v, v, v) for p, v in (("1", 10.0), ("2", 20.0), ("99", 5.0))], "drug_type string, practice string, items double, quantity double, cost double")
    return A.two_step_apportion(totals, listed, shares, ["c"], faithful=faithful)


def test_two_step_faithful(frame):
    out = _two_step(frame, True)
    assert table(out, "zone", "locality", "item", "items", "items_per_zone") == [
        (None, None, "c", 5.0, None),
        ("Z1", "L1", None, None, None), ("Z1", "L1", "c", 30.0, 18.0),
        ("Z2", "L1", None, None, None), ("Z2", "L1", "c", 30.0, 12.0),
        ("Z3", "L2", None, None, None),
    ]


def test_two_step_clean(frame):
    assert table(_two_step(frame, False), "zone", "item", "items", "items_per_zone") == [
        (None, "c", 5.0, None), ("Z1", "c", 30.0, 18.0), ("Z2", "c", 30.0, 12.0), ("Z3", None, None, None)
    ]


def test_locality_apportion(frame):
    registered = frame([("Cardiff 001A", "60"), ("Cardiff 001B", "40"), ("Gwent 002A", "x")], "area_name string, patients string")
    codes = frame([("Cardiff", "C1")], "locality_name string, code string")
    totals = frame([("c", "C1", 50.0, 1.0, 1.0), ("c", "C9", 7.0, 1.0, 1.0)], "drug_type string, code string, items double, quantity double, cost double")
    out = A.locality_apportion(totals, A.locality_shares(registered, codes))
    assert table(out, "area_name", "code", "items", "locality_share", "items_per_area") == [
        (None, "C9", 7.0, None, None), ("Cardiff 001A", "C1", 50.0, 0.6, 30.0), ("Cardiff 001B", "C1", 50.0, 0.4, 20.0)
    ]


CLASSES = [DrugClass("anti_anxiety", prefix="040102"), DrugClass("inhaler", codes=("0301A",))]


def test_england_plan(frame):
    rx = frame(
        [("040102X", "P1", "n", 10.0, 1.0, 1.0), ("0301A", "P1", "n", 4.0, 1.0, 1.0), ("0999", "P1", "n", 9.0, 1.0, 1.0)],
        "bnf_code string, row_id string, row_name string, items double, quantity double, actual_cost double",
    )
    reg = frame([("P1", "A1", 1), ("P1", "A2", 3), ("P2", "A3", 0)], "PRACTICE_CODE string, LSOA_CODE string, NUMBER_OF_PATIENTS bigint")
    ready = frame([(1, "A1", 5.0, 5.0, 5.0, "pain_medications")], "X int, LSOA_CODE string, items double, quantity double, cost double, drug_type string")
    out = england_volumes(rx, reg, CLASSES, ready)
    assert table(out, "drug_type", "LSOA_CODE", "items") == [
        ("anti_anxiety", "A1", 2.5), ("anti_anxiety", "A2", 7.5), ("anti_anxiety", "A3", None),
        ("inhaler", "A1", 1.0), ("inhaler", "A2", 3.0), ("inhaler", "A3", 0.0), ("pain_medications", "A1", 5.0),
    ]


def test_scotland_plan(frame):
    rx = frame([("1", "040102X", 10.0, 1.0, 1.0)], "GPPractice string, BNFItemCode string, NumberOfPaidItems double, PaidQuantity double, GrossIngredientCost double")
    zones = frame([("Z1", "L1", "H"), ("Z2", "L1", "H")], "DataZone string, SubHSCPName string, HSCP string")
    people = frame([("Z1", 1), ("Z2", 3)], "Data_zone_code string, Total_population bigint")
    practices = frame([(1, "Z1", "H")], "PracticeCode bigint, DataZone string, HSCP string")
    out = scotland_volumes(rx, zones, people, practices, CLASSES[:1])
    assert table(out, "DataZone", "item", "items_per_zone") == [("Z1", "antianx", 2.5), ("Z2", "antianx", 7.5)]


def test_wales_plan(frame):
    rx = frame([("C1", "0301A", 10.0, 1.0, 1.0)], "Locality string, BNFCode string, Items double, Quantity double, ActCost double")
    registered = frame([("Cardiff 001A", "1"), ("Cardiff 001B", "4")], "LSOA_name string, patients string")
    codes = frame([("Cardiff", "C1")], "Locality string, Code string")
    out = wales_volumes(rx, registered, codes, CLASSES)
    assert table(out, "LSOA_name", "Code", "item", "items_per_area") == [
        ("Cardiff 001A", "C1", "inhalers", 2.0), ("Cardiff 001B", "C1", "inhalers", 8.0)
    ]


def test_stacking(frame):
    a, b = frame([(1, "x")], "n int, s string"), frame([("y", 2)], "s string, n int")
    assert table(stack_rows(a, b), "n", "s") == [(1, "x"), (2, "y")]
    with pytest.raises(ValueError):
        stack_rows(a, b.drop("n"))
    assert table(bind_rows(a, b.drop("n")), "n", "s") == [(None, "y"), (1, "x")]
    wide = frame([(1, 2, 3, 4)], "X int, a int, b int, c int")
    assert drop_index(wide).columns == ["a", "b", "c"]
    assert drop_range(wide, "a", "b").columns == ["X", "c"]
    assert rename_at(wide, {1: "id", 3: "z"}).columns == ["id", "a", "z", "c"]
