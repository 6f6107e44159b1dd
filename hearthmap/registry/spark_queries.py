"""Every operator as a query on the driver's tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hearthmap import standins as S
from hearthmap.constants import (
    AREA_SUFFIX_LENGTH,
    ELSEWHERE,
    EMPTY_AREA,
    HOT_LEVELS,
    HOTSPOT_LEVELS,
    HOTSPOTS,
    RX_ENGLAND,
    RX_SCOTLAND,
    SCOTLAND_AGE_MAX,
    england_age_columns,
    scotland_age_columns,
)
from hearthmap.functions.joins import full_join, group_totals, keep_all_lookup, lookup_join
from hearthmap.functions.nulls import (
    dash_to_zero,
    drop_suffix,
    in_or_false,
    lenient_sum,
    level_rank,
    not_in_keep_null,
    ordered_level,
    ratio,
    strict_sum,
    to_number,
)
from hearthmap.functions.ordered import running_totals
from hearthmap.operators import apportion as A
from hearthmap.operators import balance as B
from hearthmap.operators import bins, classes, context, effects, group_tests, hotspots, matching
from hearthmap.operators import reshape, stacking
from hearthmap.plans import nations, study
from hearthmap.session import materialise, materialise_all, new_shared_path
from hearthmap.sources import scans, sheets, sinks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def rnd(c: Column | str, digits: int = 4) -> Column:
    """Rounded for comparison: summation order changes the last bits."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


def rounded(df: DataFrame, *columns: str, digits: int = 4) -> DataFrame:
    return df.withColumns({c: rnd(f"`{c}`", digits) for c in columns})


def rounded_off_halves(df: DataFrame, *columns: str) -> DataFrame:
    """Share x amount often ends on an exact half, which engines round differently: nudge it."""
    return df.withColumns({c: rnd(F.col(c) + NUDGE) for c in columns})


NUDGE = 1.3e-6


def _areas(spark: SparkSession, sf: str) -> DataFrame:
    """Area table, written once because its users read it several times."""
    return materialise(S.areas(spark, sf))


def _with_registrations(spark: SparkSession, sf: str, other: DataFrame) -> list[DataFrame]:
    """Registrations and one other input as tables: shares and allocation both read them."""
    return materialise_all(S.registrations(spark, sf), other)


# ---------------------------------------------------------------- sources and sinks


def _landed_code_files(spark: SparkSession, sf: str) -> str:
    """Line items landed as prescribing CSV files by code and year."""
    rows = S.table(spark, sf, "lineitem").select(
        F.col("l_linenumber").cast("string").alias("ccg"),
        F.concat(F.lit("P"), "l_suppkey").alias("row_id"),
        F.concat(F.lit("Practice "), "l_suppkey").alias("row_name"),
        F.col("l_extendedprice").alias("actual_cost"),
        F.lit(1.0).alias("items"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_linestatus").alias("setting"),
        F.to_date("l_shipdate").alias("date"),
        F.col("l_returnflag").alias("code"),
        F.trunc("l_shipdate", "year").alias("month"),
    )
    path = new_shared_path(spark, "landed-codes")
    # rebalance: few files per folder, and several writers for a busy one
    rows.hint("rebalance", F.col("code"), F.col("month")).write.partitionBy(
        "code", "month"
    ).option("header", True).csv(path)
    return path


def _landed_month_files(spark: SparkSession, sf: str) -> str:
    """Prescribing facts landed as monthly CSV files."""
    none = F.lit(None).cast("string")
    rows = S.rx(spark, sf).select(
        none.alias("HBT"),
        F.col("practice").alias("GPPractice"),
        none.alias("DMDCode"),
        F.col("code").alias("BNFItemCode"),
        none.alias("BNFItemDescription"),
        none.alias("PrescribedType"),
        F.col("items").alias("NumberOfPaidItems"),
        F.col("quantity").alias("PaidQuantity"),
        F.col("cost").alias("GrossIngredientCost"),
        F.date_format("month", "yyyyMM").alias("PaidDateMonth"),
        F.date_format("month", "yyyyMM").alias("month"),
    )
    path = new_shared_path(spark, "landed-months")
    rows.hint("rebalance", F.col("month")).write.partitionBy("month").option(
        "header", True
    ).csv(path)
    return path


@query
def s1_manifest_scan(spark, sf):
    path = _landed_code_files(spark, sf)
    span = S.table(spark, sf, "lineitem").agg(
        F.year(F.min("l_shipdate")), F.year(F.max("l_shipdate"))
    ).first()
    codes = [r[0] for r in S.table(spark, sf, "lineitem").select("l_returnflag").distinct().collect()]
    years = [date(y, 1, 1) for y in range(span[0], span[1] + 1)]
    rows = scans.scan_code_months(spark, path, sorted(codes), years, RX_ENGLAND)
    return rows.groupBy("bnf_code", F.year("date").alias("year")).agg(
        F.count(F.lit(1)).alias("n"),
        rnd(F.sum("quantity")).alias("quantity"),
        rnd(F.sum("actual_cost"), 2).alias("cost"),
    )


@query
def s2_monthly_filter(spark, sf):
    path = _landed_month_files(spark, sf)
    low, high = S.table(spark, sf, "lineitem").agg(F.min("l_shipdate"), F.max("l_shipdate")).first()
    count = (high.year - low.year) * 12 + high.month - low.month + 1
    months = scans.study_months((low.year, low.month), count)
    wanted = classes.any_class("BNFItemCode", S.CLASSES)
    rows = scans.scan_months(spark, path + "/month={month}", months, RX_SCOTLAND, wanted)
    return rows.groupBy(
        "BNFItemCode", scans.month_start(F.col("PaidDateMonth")).alias("month")
    ).agg(
        F.count(F.lit(1)).alias("n"),
        rnd(F.sum("PaidQuantity")).alias("quantity"),
        rnd(F.sum("GrossIngredientCost"), 2).alias("cost"),
    )


def _landed_after_preamble(spark, sf):
    """Suppliers as CSV files with three lines of preamble, one file per last digit of the key."""
    supplier = S.table(spark, sf, "supplier")
    kept = F.concat_ws(",", "s_suppkey", "s_nationkey", F.concat(F.lit('"'), "s_name", F.lit(', listed"')))
    lines = supplier.select((F.col("s_suppkey") % 4).alias("file"), F.col("s_suppkey").alias("place"), kept.alias("value"))
    head = ["Suppliers", "", "as listed, by key", "key,nation,name"]
    tops = F.inline(F.array(*[F.struct(F.lit(i - len(head)).cast("long").alias("place"), F.lit(t).alias("value")) for i, t in enumerate(head)]))
    preamble = lines.select("file").distinct().select("file", tops)
    path = new_shared_path(spark, "preamble")
    # one sorted file per group of suppliers
    ordered = lines.unionByName(preamble).repartition("file").sortWithinPartitions("file", "place")
    ordered.drop("place").write.partitionBy("file").text(path)
    return path


@query
def s4_after_preamble(spark, sf):
    return scans.scan_csv_after_preamble(spark, _landed_after_preamble(spark, sf), 3, "key long, nation int, name string")


@query
def s4_inferred_names(spark, sf):
    return scans.scan_csv_after_preamble(spark, _landed_after_preamble(spark, sf), 3)


def _landed_sheet(spark, sf):
    path = new_shared_path(spark, "sheet")
    S.raw_sheet(spark, sf).write.parquet(path)
    return scans.landed_sheet(spark, path)


@query
def s5_landed_sheet(spark, sf):
    return _landed_sheet(spark, sf)


@query
def s6_raw_sheet_clean(spark, sf):
    sheet = _landed_sheet(spark, sf)
    last = sheet.agg(F.max("_row")).first()[0]
    body = sheets.promote_header(sheets.trim_rows(sheet, (1, 2), (last, last)), 3)
    return sheets.pick_columns(body, {"code": "code", "name": 2, "balance": 4})


@query
def s7_code_list(spark, sf):
    return classes.code_list(S.table(spark, sf, "part"), "p_brand")


@query
def k1_csv_round_trip(spark, sf):
    path = new_shared_path(spark, "csv")
    sinks.write_csv(S.table(spark, sf, "customer"), path)
    return scans.scan_csv(
        spark,
        path,
        "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    )


@query
def k2_drop_index(spark, sf):
    exported = S.table(spark, sf, "nation").withColumn("X", F.col("n_nationkey") + 1)
    return stacking.drop_index(exported)


# ---------------------------------------------------------------- projections


@query
def p2_drop_range(spark, sf):
    return stacking.drop_range(S.table(spark, sf, "part"), "p_type", "p_retailprice")


@query
def p3_rename(spark, sf):
    return stacking.rename_at(S.table(spark, sf, "nation"), {1: "oa_code"}).withColumnsRenamed(
        {"n_name": "zone_name"}
    )


@query
def p5_ratio(spark, sf):
    line = S.table(spark, sf, "lineitem")
    return line.groupBy("l_partkey").agg(
        rnd(ratio(F.sum("l_tax"), F.sum("l_discount")), 9).alias("tax_per_discount")
    )


@query
def p7_case(spark, sf):
    return S.areas(spark, sf).select(
        "LSOA21CD",
        F.when(F.col("classification").isin(HOT_LEVELS), HOTSPOTS).otherwise(ELSEWHERE).alias("top_or_not"),
    )


@query
def p9_try_cast(spark, sf):
    return S.smoking_sheet(spark, sf).select("practice", to_number("cases").alias("cases"))


@query
def p10_ordered_factor(spark, sf):
    level = ordered_level("classification", HOTSPOT_LEVELS)
    return (
        S.areas(spark, sf)
        .select(level.alias("level"))
        .withColumn("rank", level_rank("level", HOTSPOT_LEVELS))
        .groupBy("level", "rank")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query
def p11_trim_suffix(spark, sf):
    return S.registered_by_area(spark, sf).select(
        "area_name", drop_suffix("area_name", AREA_SUFFIX_LENGTH).alias("locality_name")
    )


@query
def p13_sentinel(spark, sf):
    return S.smoking_sheet(spark, sf).select(
        "practice", to_number(dash_to_zero("cases")).alias("cases")
    )


# ---------------------------------------------------------------- filters


def _rx_by_code(rows):
    return rows.groupBy("code").agg(
        F.count(F.lit(1)).alias("n"), rnd(F.sum("cost"), 2).alias("cost")
    )


@query
def f1_in_list(spark, sf):
    return _rx_by_code(classes.in_class(S.rx(spark, sf), "code", S.CLASSES[3]))


@query
def f2_prefix(spark, sf):
    return _rx_by_code(classes.in_class(S.rx(spark, sf), "code", S.CLASSES[0]))


@query
def f3_any_class(spark, sf):
    return _rx_by_code(S.rx(spark, sf).where(classes.any_class("code", S.CLASSES)))


@query
def f5_not_in_keep_null(spark, sf):
    return S.zones(spark, sf).where(not_in_keep_null("locality", ["NATION_1", "NATION_5"]))


@query
def f7_complete_case(spark, sf):
    return rounded(
        S.areas(spark, sf).na.drop("any").select("LSOA21CD", "ruc21ind", "LSOA_FPmean"), "LSOA_FPmean"
    )


@query
def f8_sentinel(spark, sf):
    return S.registrations(spark, sf).where(F.col("area") != EMPTY_AREA)


@query
def f9_contains(spark, sf):
    code = F.col("LSOA21CD")
    return S.areas(spark, sf).groupBy(
        F.when(code.contains("E"), "England")
        .when(code.contains("W"), "Wales")
        .when(code.contains("S"), "Scotland")
        .alias("country")
    ).agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- joins


@query
def j1_left(spark, sf):
    return lookup_join(S.practice_list(spark, sf), S.zones(spark, sf), ["zone"])


@query
def j3_right_coalesce(spark, sf):
    totals = A.practice_totals(S.locality_rx(spark, sf), ["locality_code"])
    codes = S.locality_codes(spark, sf)
    return rounded(
        keep_all_lookup(codes, totals, [("code", "locality_code")]), "items", "quantity", "cost"
    )


@query
def j4_full_nullsafe(spark, sf):
    practices = lookup_join(S.practice_list(spark, sf), S.zones(spark, sf), ["zone"])
    totals = A.practice_totals(S.rx(spark, sf), ["practice"])
    with_locality = full_join(practices, totals, ["practice"], unique=True)
    by_locality = with_locality.groupBy("locality").agg(strict_sum("items").cast("double").alias("items"))
    return full_join(S.zones(spark, sf), by_locality, ["locality"])


@query
def j5_grid(spark, sf):
    """Request grid: every code with every month of a twelve-month window."""
    months = F.array(*[F.lit(m) for m in scans.study_months((1996, 8), 12)])
    codes = classes.code_list(S.table(spark, sf, "part"), "p_brand")
    return codes.select("p_brand", F.explode(months).alias("month"))


# ---------------------------------------------------------------- aggregates and reshaping


@query
def a1_practice_totals(spark, sf):
    totals = A.practice_totals(S.rx(spark, sf), ["code", "practice", "practice_name"])
    return rounded(totals, "items", "quantity", "cost")


@query
def a5_rollup(spark, sf):
    orders = S.table(spark, sf, "orders")
    fine = orders.groupBy("o_custkey", "o_orderstatus").agg(strict_sum("o_totalprice").alias("v"))
    lookup = S.table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    return (
        lookup_join(fine, lookup, [("o_custkey", "c_custkey")], unique=True)
        .groupBy("c_nationkey", "o_orderstatus")
        .agg(rnd(strict_sum("v"), 2).alias("value"))
    )


RATES = {
    "inhaler": "inhaler_prv",
    "antidep": "antidep_prv",
    "antianx": "antianx_prv",
    "antipsych": "antipsych_prv",
}


@query
def a6_group_mean(spark, sf):
    rates = hotspots.group_rates(S.areas(spark, sf), "classification", RATES)
    return rounded(rates, *RATES, digits=6)


@query
def a7_ratio_of_sums(spark, sf):
    return (
        S.areas(spark, sf)
        .groupBy("ruc21ind")
        .agg(
            rnd(lenient_sum("LSOA_FPmean"), 2).alias("poverty"),
            rnd(lenient_sum("LSOA_incmedian"), 2).alias("income"),
            rnd(ratio(lenient_sum("LSOA_FPmean"), lenient_sum("LSOA_incmedian")), 6).alias("share"),
        )
    )


@query
def a8_crosstab_flag(spark, sf):
    areas = S.areas(spark, sf).withColumn(
        "top_or_not",
        F.when(in_or_false("classification", HOT_LEVELS), HOTSPOTS).otherwise(ELSEWHERE),
    )
    levels = [ELSEWHERE, HOTSPOTS]
    table = reshape.crosstab_column_share(areas, "ruc21ind", "top_or_not", levels)
    return rounded(table, *levels, "NA_", digits=6)


@query
def a8_crosstab_levels(spark, sf):
    areas = S.areas(spark, sf).withColumn(
        "classification", ordered_level("classification", HOTSPOT_LEVELS)
    )
    table = reshape.crosstab_column_share(areas, "ruc21ind", "classification", HOTSPOT_LEVELS)
    return rounded(table, *HOTSPOT_LEVELS, "NA_", digits=6)


@query
def a9_unpivot(spark, sf):
    columns = ["Total", *england_age_columns()]
    sheet = S.age_sheet(spark, sf, england_age_columns())
    return reshape.to_long(sheet, ["area_code"], columns, "age_cat", "value")


@query
def a10_age_bands(spark, sf):
    sheet = S.output_area_sheet(spark, sf, scotland_age_columns())
    long = reshape.to_long(sheet.withColumn("All people", F.col("All people").cast("string")), ["oa_code"], scotland_age_columns(), "label", "text")
    band = reshape.age_band("label", SCOTLAND_AGE_MAX, sexed=False)
    return long.groupBy("label", band.alias("band")).agg(
        lenient_sum(to_number(dash_to_zero("text"))).alias("people")
    )


@query
def a11_pivot(spark, sf):
    cells = S.table(spark, sf, "orders").groupBy("o_custkey", "o_orderstatus").agg(
        F.count(F.lit(1)).alias("n")
    )
    return reshape.to_wide(cells, "o_custkey", "o_orderstatus", "n", ["F", "O", "P"])


@query
def a12_pivot_fill0(spark, sf):
    return reshape.wide_counts(
        S.event_counts(spark, sf), "area", "category", "observation", EVENT_TYPES
    )


@query
def a13_quartile(spark, sf):
    return bins.quantile_bins(_areas(spark, sf), {"bin": ("LSOA_incmedian", 4)}).select(
        "LSOA21CD", "bin"
    )


@query
def a13_decile(spark, sf):
    table = bins.quantile_bins(
        _areas(spark, sf), {"decile": ("LSOA_FPmean", 10), "fifth": ("LSOA_FPmean", 5)}
    )
    return table.select("LSOA21CD", "decile", "fifth")


@query
def a14_distinct(spark, sf):
    return S.registrations(spark, sf).select("area").distinct()


@query
def w1_group_total(spark, sf):
    shares = A.practice_shares(materialise(S.registrations(spark, sf)))
    return rounded(shares, "share", digits=6)


@query
def w2_multi_col_total(spark, sf):
    customer = S.table(spark, sf, "customer")
    total = strict_sum("c_acctbal") + strict_sum(F.col("c_custkey").cast("double"))
    out = group_totals(customer, ["c_mktsegment"], {"total": total})
    return out.select("c_custkey", rnd("total", 2).alias("total"))


@query
def o1_head(spark, sf):
    return S.registrations(spark, sf).orderBy("practice", "area").limit(6)


@query
def o2_group_order(spark, sf):
    return rounded(
        hotspots.groups_by_median(_areas(spark, sf), "classification", "inhaler_prv"), "median", digits=6
    )


# ---------------------------------------------------------------- stacking


@query
def u1_bind_rows(spark, sf):
    supplier = S.table(spark, sf, "supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    customer = S.table(spark, sf, "customer").select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return stacking.bind_rows(supplier, customer)


@query
def u2_rbind(spark, sf):
    supplier = S.table(spark, sf, "supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    customer = S.table(spark, sf, "customer").select(F.col("c_acctbal").alias("balance"), F.col("c_name").alias("name"))
    return stacking.stack_rows(supplier, customer)


# ---------------------------------------------------------------- domain operators

EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


def _totals(spark, sf, keys=("practice", "practice_name"), by_code=True):
    return A.class_totals(S.rx(spark, sf), "code", S.CLASSES, list(keys), by_code=by_code)


@query
def d1_classify(spark, sf):
    by_code = S.rx(spark, sf).groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.sum("cost").alias("cost"))
    return rounded(classes.classify_codes(by_code, "code", S.CLASSES), "cost", digits=2)


@query
def d1_classify_rows(spark, sf):
    """Every single fact with its classes."""
    tagged = classes.classify_codes(S.rx(spark, sf), "code", S.CLASSES)
    return tagged.groupBy("drug_type", "practice").agg(F.count(F.lit(1)).alias("n"), rnd(F.sum("cost"), 2).alias("cost"))


def _small_parts(spark, sf):
    """A class whose codes are a table."""
    return classes.class_from_list("small", S.table(spark, sf, "part").where("p_size = 1 and p_partkey % 3 = 0"), "p_brand")


@query
def d1_listed_classes(spark, sf):
    """Two prefix classes and one whose codes are a table, in one scan of the facts."""
    mixed = [*S.CLASSES[:2], _small_parts(spark, sf)]
    totals = A.class_totals(S.rx(spark, sf), "code", mixed, ["practice"], by_code=False)
    return rounded(totals, *A.MEASURES, digits=2)


@query
def f1_in_listed_class(spark, sf):
    return _rx_by_code(classes.in_class(S.rx(spark, sf), "code", _small_parts(spark, sf)))


@query
def f3_in_any_class(spark, sf):
    wanted = [S.CLASSES[0], S.CLASSES[4], _small_parts(spark, sf)]
    return _rx_by_code(classes.in_any_class(S.rx(spark, sf), "code", wanted))


@query
def d1_classify_by_listing(spark, sf):
    """Listing read as a table: codes grouped by the part type they occur with."""
    listing = S.table(spark, sf, "part").select("p_brand", F.col("p_type").alias("drug_type"))
    tagged = classes.classify_by_listing(S.rx(spark, sf), "code", listing, "p_brand")
    return tagged.groupBy("drug_type").agg(
        F.count(F.lit(1)).alias("n"), rnd(F.sum("cost"), 2).alias("cost")
    )


@query
def d2_apportion(spark, sf):
    volumes = A.apportion(*_with_registrations(spark, sf, _totals(spark, sf)), S.LABELS)
    return rounded(volumes, *A.MEASURES)


@query
def d2_apportion_twelve_months(spark, sf):
    months = scans.study_months((1996, 8), 12)
    rx = S.rx(spark, sf).where(F.col("month").isin(months))
    totals = A.class_totals(rx, "code", S.CLASSES, ["practice", "practice_name"])
    volumes = A.apportion(*_with_registrations(spark, sf, totals), S.LABELS)
    return rounded(volumes, *A.MEASURES)


@query
def d3_by_code(spark, sf):
    totals = A.practice_totals(S.rx(spark, sf), ["code", "practice", "practice_name"])
    volumes = A.apportion_by_code(*_with_registrations(spark, sf, totals))
    return rounded(volumes, *A.MEASURES)


@query
def d3_rolled_up(spark, sf):
    inputs = _with_registrations(spark, sf, _totals(spark, sf))
    volumes = A.apportion(*inputs, S.LABELS, filled_after=S.LABELS)
    return rounded(volumes, *A.MEASURES)


def _shares(spark, sf):
    return materialise(A.zone_shares(S.zones(spark, sf), S.zone_population(spark, sf)))


@query
def d4a_zone_shares(spark, sf):
    return rounded(_shares(spark, sf), "locality_share", "parent_share", digits=6)


def _two_step(spark, sf, faithful):
    shares = _shares(spark, sf)
    listed = materialise(A.practice_localities(S.practice_list(spark, sf), shares))
    totals = _totals(spark, sf, ["practice"], by_code=False)
    spread = A.two_step_apportion(totals, listed, shares, S.LABELS, faithful=faithful)
    measures = [*A.MEASURES, *[f"{m}_per_zone" for m in A.MEASURES]]
    return rounded_off_halves(
        spread.select("class_key", "zone", "locality", "item", *measures), *measures
    )


@query
def d4b_two_step_faithful(spark, sf):
    return _two_step(spark, sf, True)


@query
def d4b_two_step_clean(spark, sf):
    return _two_step(spark, sf, False)


@query
def d4c_parent_check(spark, sf):
    listed = A.practice_localities(S.practice_list(spark, sf), _shares(spark, sf))
    return listed.select("practice", "practice_parent", "zone_parent", "parent_check")


@query
def d5_locality(spark, sf):
    totals = A.class_totals(S.locality_rx(spark, sf), "code", S.CLASSES, ["locality_code"], by_code=False)
    totals = totals.withColumnRenamed("locality_code", "code")
    shares = A.locality_shares(S.registered_by_area(spark, sf), S.locality_codes(spark, sf))
    spread = A.locality_apportion(totals, shares)
    return rounded_off_halves(
        spread, "locality_share", *A.MEASURES, *[f"{m}_per_area" for m in A.MEASURES]
    )


@query
def d6_stack(spark, sf):
    registrations, totals = _with_registrations(spark, sf, _totals(spark, sf))
    of = lambda labels: totals.where(F.col("drug_type").isin(*labels))
    first = A.apportion(registrations, of(S.LABELS[:4]), S.LABELS[:4])
    prepared = A.apportion(registrations, of(S.LABELS[4:]), S.LABELS[4:]).withColumn("X", F.lit(1))
    return rounded(stacking.stack_rows(first, stacking.drop_index(prepared)), *A.MEASURES)


@query
def d7_prevalence(spark, sf):
    rates = context.area_prevalence(*_with_registrations(spark, sf, S.smoking_sheet(spark, sf)))
    return rounded(rates, "cases", "people", "prevalence")


@query
def d8_overcrowding(spark, sf):
    columns = list(S.OCCUPANCY)
    rates = context.overcrowding_rate(
        S.occupancy_sheet(spark, sf), area="area", occupancy=columns, worst=columns[0]
    )
    return rounded(rates.select("area", "total_households", "overcrowding_rate"), "overcrowding_rate", digits=6)


@query
def d9_category_wide(spark, sf):
    return context.category_counts_wide(
        S.event_counts(spark, sf), area="area", category="category", count="observation"
    )


def _many_categories(spark, sf):
    """Events by user group and kind of event, views without a kind."""
    kind = F.when(F.col("event_type") != "view", F.concat("event_type", F.lit("-"), F.col("event_id") % 400))
    return S.table(spark, sf, "events").select((F.col("user_id") % 1000).alias("area_no"), kind.alias("category"), F.lit(1).cast("long").alias("n"))


@query
def d9_category_map(spark, sf):
    """Any number of categories, the missing one included."""
    table = reshape.category_map(_many_categories(spark, sf), "area_no", "category", "n")
    entries = F.transform(F.map_entries("counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return table.select("area_no", F.array_join(entries, ",").alias("counts"), F.size("counts").cast("long").alias("n_categories"))


def _two_kinds(spark, sf):
    events = S.table(spark, sf, "events")
    return events.select((F.col("user_id") % 1000).alias("area_no"), F.col("event_type").alias("category"), F.lit(1).cast("long").alias("n"))


@query
def a12_null_category(spark, sf):
    known = F.when(F.col("category").isin("click", "signup"), F.col("category"))
    return reshape.wide_counts(_two_kinds(spark, sf).withColumn("category", known), "area_no", "category", "n")


@query
def n13_rejected_levels(spark, sf):
    return reshape.wide_counts_and_rejects(_two_kinds(spark, sf), "area_no", "category", "n", ["click", "signup"])[1]


@query
def d10_age_table(spark, sf):
    england = reshape.england_age_bands(
        S.age_sheet(spark, sf, england_age_columns()), "area_code", ["Total", *england_age_columns()]
    )
    scotland = reshape.scotland_age_bands(
        S.output_area_sheet(spark, sf, scotland_age_columns()),
        "oa_code",
        S.output_area_zones(spark, sf),
        "OA22",
        "DZ22",
        "area_code",
    )
    return rounded(
        stacking.stack_rows(england, scotland), "young_perc", "wa_perc", "senior_perc", digits=6
    )


def _analysis(spark, sf):
    return hotspots.analysis_table(
        _areas(spark, sf), S.area_ages(spark, sf), S.urban_rural(spark, sf)
    )


@query
def d11_analysis_table(spark, sf):
    shares = ["young_perc", "wa_perc", "senior_perc"]
    return rounded(
        _analysis(spark, sf).select(
            "LSOA21CD", "income_dist_median", "fp_quint_mean", "fp_dec_mean", "top5_or_not",
            "top10_or_not", "top_20_or_not", "urb_rur", "country", "urb_or_not", *shares,
        ),
        *shares,
        digits=6,
    )


def _groups(spark, sf):
    return materialise(hotspots.hotspot_groups(_areas(spark, sf)))


@query
def d12_hotspot_groups(spark, sf):
    return _groups(spark, sf).select(
        "LSOA21CD", "LSOA_incmedian", "classification", "top_or_not", "income_dist_median"
    )


@query
def d12_low_income(spark, sf):
    return hotspots.lowest_income(_groups(spark, sf)).select("LSOA21CD", "top_or_not")


@query
def d12_without_outliers(spark, sf):
    kept = hotspots.without_areas(_groups(spark, sf), "LSOA21CD", S.OUTLIERS)
    return kept.select("LSOA21CD", "top_or_not")


@query
def d13_group_rates(spark, sf):
    rates = hotspots.group_rates(_groups(spark, sf), "top_or_not", RATES)
    return rounded(rates, *RATES, digits=6)


# ---------------------------------------------------------------- national studies


def _through_csv(spark, df):
    """Written as CSV with a header, read again with the types it had."""
    path = new_shared_path(spark, "national")
    sinks.write_csv(df, path)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return scans.scan_csv(spark, path, fields)


@query
def nation_england(spark, sf):
    rx = S.rx(spark, sf).withColumnsRenamed(
        {"code": "bnf_code", "practice": "row_id", "practice_name": "row_name", "cost": "actual_cost"}
    )
    registrations = S.registrations(spark, sf).withColumnsRenamed(
        {"practice": "PRACTICE_CODE", "area": "LSOA_CODE", "patients": "NUMBER_OF_PATIENTS"}
    )
    volumes = nations.england_volumes(rx, materialise(registrations), S.CLASSES)
    return _through_csv(spark, rounded(volumes, *A.MEASURES))


@query
def nation_scotland(spark, sf):
    rx = S.rx(spark, sf).withColumnsRenamed(
        {"code": "BNFItemCode", "practice": "GPPractice", "items": "NumberOfPaidItems", "quantity": "PaidQuantity", "cost": "GrossIngredientCost"}
    )
    zones = S.zones(spark, sf).withColumnsRenamed({"zone": "DataZone", "locality": "SubHSCPName", "parent": "HSCP"})
    population = S.zone_population(spark, sf).withColumnsRenamed({"zone_code": "Data_zone_code", "population": "Total_population"})
    listed = S.practice_list(spark, sf).withColumnsRenamed({"practice": "PracticeCode", "zone": "DataZone", "practice_parent": "HSCP"})
    spread = nations.scotland_volumes(rx, zones, population, listed, S.CLASSES)
    measures = [*A.MEASURES, *[f"{m}_per_zone" for m in A.MEASURES]]
    kept = spread.select("class_key", "DataZone", "SubHSCPName", "item", *measures)
    return _through_csv(spark, rounded_off_halves(kept, *measures))


@query
def nation_wales(spark, sf):
    rx = S.locality_rx(spark, sf).withColumnsRenamed(
        {"code": "BNFCode", "locality_code": "Locality", "items": "Items", "cost": "ActCost", "quantity": "Quantity"}
    )
    registered = S.registered_by_area(spark, sf).withColumnRenamed("area_name", "LSOA_name")
    codes = S.locality_codes(spark, sf).withColumnsRenamed({"locality_name": "Locality", "code": "Code"})
    spread = nations.wales_volumes(rx, registered, codes, S.CLASSES)
    measures = [*A.MEASURES, *[f"{m}_per_area" for m in A.MEASURES]]
    kept = spread.select("LSOA_name", "Locality", "Code", "item", *measures)
    return _through_csv(spark, rounded_off_halves(kept, *measures))


# ---------------------------------------------------------------- statistics


def _test(row: DataFrame, *columns: str) -> DataFrame:
    return row.select(*[rnd(c, 6).alias(c) for c in columns])


@query
def t1_levene(spark, sf):
    return _test(group_tests.levene(_groups(spark, sf), "inhaler_prv", "top_or_not"), "f", "df1", "df2")


@query
def t2_welch(spark, sf):
    return _test(group_tests.welch(_groups(spark, sf), "inhaler_prv", "top_or_not"), "f", "df1", "df2")


@query
def t2_welch_levels(spark, sf):
    return _test(
        group_tests.welch(_groups(spark, sf), "antidep_prv", "classification"), "f", "df1", "df2"
    )


@query
def t3_anova(spark, sf):
    low = hotspots.lowest_income(_groups(spark, sf))
    return _test(
        group_tests.anova(low, "antipsych_prv", "top_or_not"),
        "df1", "df2", "ss_between", "ss_within", "ms_between", "ms_within", "f",
    )


@query
def t_hotspot_tests(spark, sf):
    return study.hotspot_tests(S.areas(spark, sf), S.OUTLIERS)


@query
def t_hotspot_report(spark, sf):
    """The same tests without the tail probabilities, which SQL lacks."""
    return rounded(study.hotspot_tests(S.areas(spark, sf), S.OUTLIERS).drop("p"), "f", "df1", "df2", digits=6)


BOX = ["q1", "median", "q3", "lower_whisker", "upper_whisker"]


@query
def t4_boxstats(spark, sf):
    return rounded(
        bins.box_stats(_areas(spark, sf), "LSOA_incmedian", ["classification"]), *BOX
    )


@query
def t4_boxstats_two_keys(spark, sf):
    table = bins.box_stats(_groups(spark, sf), "inhaler_prv", ["income_dist_median", "top_or_not"])
    return rounded(table, *BOX, digits=6)


@query
def t4_outliers(spark, sf):
    out = bins.box_outliers(_groups(spark, sf), "inhaler_prv", ["top_or_not"])
    return rounded(out.select("LSOA21CD", "top_or_not", "inhaler_prv"), "inhaler_prv", digits=6)


@query
def t5_histogram(spark, sf):
    inhalers = _totals(spark, sf).where("drug_type = 'inhaler'")
    volumes = A.apportion(*_with_registrations(spark, sf, inhalers), ["inhaler"])
    return bins.histogram(volumes.where(F.col("area") != EMPTY_AREA), "items")


@query
def t5_histogram_orders(spark, sf):
    return bins.histogram(S.table(spark, sf, "orders"), "o_totalprice")


NUMERIC, CATEGORICAL = ["income", "orders"], ["settlement"]


def _study_rows(spark, sf):
    return materialise(S.matching_frame(spark, sf))


def _scored(spark, sf):
    return materialise(matching.propensity_score(_study_rows(spark, sf), "t", NUMERIC, CATEGORICAL))


def _given_score(spark, sf):
    """A score that any engine computes alike."""
    score = F.least(F.col("orders"), F.lit(64.0)) / 64 + F.round(F.col("income"), 0) / 16384
    return S.matching_frame(spark, sf).withColumn("distance", score)


def _given_pairs(rows: DataFrame) -> DataFrame:
    """k-th treated with k-th control in id order; ranks from distributed running totals."""
    ranked = []
    for arm, name in ((1, "treated_id"), (0, "control_id")):
        ids = rows.where(F.col("t") == arm).select(F.col("id").alias(name), F.lit(1).alias("k"))
        ranked.append(running_totals(ids, name, ["k"]).select(name, "cum_k"))
    return ranked[0].join(ranked[1], "cum_k").drop("cum_k")


@query
def t6_score(spark, sf):
    return _scored(spark, sf).select("id", "t", rnd("distance", 6).alias("distance"))


@query
def t6_score_one_factor(spark, sf):
    scored = matching.propensity_score(_study_rows(spark, sf), "t", [], ["settlement"])
    return scored.select("id", rnd("distance", 6).alias("distance"))


@query
def t6_score_equations(spark, sf):
    """A fitted score leaves nothing per level and nothing along a covariate; its size is that of the treated."""
    rows = _study_rows(spark, sf).withColumn("t", (F.col("id") % 3 == 0).cast("int"))
    scored = matching.propensity_score(rows, "t", NUMERIC, CATEGORICAL)
    left = F.col("t") - F.col("distance")
    return scored.groupBy("settlement").agg(
        rnd(F.sum("distance"), 5).alias("expected"),
        rnd(F.sum(left), 5).alias("left"),
        F.count(F.lit(1)).alias("n"),
    ).unionByName(
        scored.agg(
            rnd(F.sum(F.col("distance") * F.col("orders")), 3).alias("expected"),
            rnd(F.sum(left * F.col("income")), 3).alias("left"),
            F.count(F.lit(1)).alias("n"),
        ).withColumn("settlement", F.lit("(orders, income)"))
    )


@query
def t6_imbalance(spark, sf):
    table = B.balance_table(_scored(spark, sf), "t", ["distance", *NUMERIC], CATEGORICAL)
    return rounded(table, *[c for c in table.columns if c != "variable"], digits=6)


@query
def t7_pairs(spark, sf):
    return matching.nearest_pairs(_scored(spark, sf), "id", "t")


@query
def t7_pairs_given_score(spark, sf):
    pairs = matching.nearest_pairs(_given_score(spark, sf), "id", "t")
    return rounded(pairs, "gap", digits=9)


@query
def t8_balance_unmatched(spark, sf):
    table = B.balance_table(_study_rows(spark, sf), "t", NUMERIC, CATEGORICAL)
    return rounded(table, *[c for c in table.columns if c != "variable"], digits=6)


@query
def t8_balance_given_pairs(spark, sf):
    rows = _study_rows(spark, sf)
    flagged = matching.match_flags(rows, _given_pairs(rows), "id")
    table = B.balance_table(flagged, "t", NUMERIC, CATEGORICAL, matched="matched")
    return rounded(table, *[c for c in table.columns if c != "variable"], digits=6)


@query
def t8_balance(spark, sf):
    scored = _scored(spark, sf)
    flagged = matching.match_flags(scored, matching.nearest_pairs(scored, "id", "t"), "id")
    return B.balance_table(flagged, "t", ["distance", *NUMERIC], CATEGORICAL, matched="matched")


@query
def t8_pair_distance(spark, sf):
    rows = _study_rows(spark, sf)
    return rounded(B.pair_distance(rows, _given_pairs(rows), "id", "t", NUMERIC), "pair_dist", digits=6)


@query
def t8_report(spark, sf):
    """Score, covariates and levels with the distance within pairs."""
    rows = materialise(_given_score(spark, sf))
    pairs = materialise(_given_pairs(rows))
    flagged = matching.match_flags(rows, pairs, "id")
    table = B.balance_report(flagged, pairs, "id", "t", ["distance", *NUMERIC], CATEGORICAL)
    return rounded(table, *[c for c in table.columns if c != "variable"], digits=6)


@query
def t8_sample_sizes(spark, sf):
    rows = _study_rows(spark, sf)
    return B.sample_sizes(matching.match_flags(rows, _given_pairs(rows), "id"), "t", "matched")


@query
def t9_matched(spark, sf):
    scored = _scored(spark, sf)
    return matching.matched_data(scored, matching.nearest_pairs(scored, "id", "t"), "id")


@query
def t9_matched_given_pairs(spark, sf):
    rows = _study_rows(spark, sf)
    return matching.matched_data(rows, _given_pairs(rows), "id").select("id", "t", "subclass", "weights")


def _given_matched(spark, sf):
    rows = _study_rows(spark, sf)
    return materialise(matching.matched_data(rows, _given_pairs(rows), "id"))


@query
def t10_wls(spark, sf):
    return rounded(effects.weighted_model(_given_matched(spark, sf), "t", "y", NUMERIC, CATEGORICAL), "estimate", digits=7)


@query
def t10_wls_one_covariate(spark, sf):
    model = effects.weighted_model(_given_matched(spark, sf), "t", "y", ["income"], [])
    return rounded(model, "estimate", digits=7)


@query
def t11_att(spark, sf):
    effect = effects.treated_effect(_given_matched(spark, sf), "t", "y", NUMERIC, CATEGORICAL)
    return effect.select(*[rnd(c, 6).alias(c) for c in ("estimate", "std_error")], rnd("z", 5).alias("z"), "n_treated", "n_clusters")


@query
def t11_att_one_covariate(spark, sf):
    effect = effects.treated_effect(_given_matched(spark, sf), "t", "y", ["income"], [])
    return effect.select(
        rnd("estimate", 6).alias("estimate"),
        rnd("std_error", 6).alias("std_error"),
        rnd("z", 5).alias("z"),
        "n_treated",
        "n_clusters",
    )


@query
def t11_matched_study(spark, sf):
    result = study.matched_study(
        S.matching_frame(spark, sf),
        id_col="id", treated="t", outcome="y", numeric=NUMERIC, categorical=CATEGORICAL,
    )
    return result.effect


@query
def t12_distribution_levels(spark, sf):
    """With the score and the levels of the categorical covariate."""
    rows = materialise(_given_score(spark, sf))
    flagged = matching.match_flags(rows, _given_pairs(rows), "id")
    table = bins.binned_distribution(flagged, ["distance", *NUMERIC], 20, ["t", "matched"], CATEGORICAL)
    return rounded(table, "proportion", digits=6)


@query
def t12_distribution(spark, sf):
    rows = _study_rows(spark, sf)
    flagged = matching.match_flags(rows, _given_pairs(rows), "id")
    table = bins.binned_distribution(flagged, NUMERIC, 20, ["t", "matched"])
    return rounded(table, "proportion", digits=6)
