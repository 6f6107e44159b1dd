"""Views of the driver's tables in the roles of this library's inputs.

Every view covers its whole tables; edge cases (unlisted practices, suppressed counts, areas
without a code, missing values) come from ordinary attributes, not from dropping rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from hearthmap.functions.nulls import ratio
from hearthmap.operators.classes import DrugClass

# Overlapping on purpose: '...1' also covers '...11', and the lists repeat prefix codes.
CLASSES = [
    DrugClass("anti_anxiety", prefix="Brand#1"),
    DrugClass("anti_psychotic", prefix="Brand#11"),
    DrugClass("anti_depressants", prefix="Brand#2"),
    DrugClass("inhaler", codes=("Brand#11", "Brand#3")),
    DrugClass("pain", codes=("Brand#12", "Brand#4")),
]
LABELS = [c.label for c in CLASSES]
AGE_LABELS = ["Under 1", "100 and over", "All people"]


# Declared, so that no job has to read file footers first.
SCHEMAS = {
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
    "c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
    "p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
    "value double, props string",
}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf}/{name}.parquet")


def rx(spark: SparkSession, sf: str) -> DataFrame:
    """Prescribing facts.  Deep-discount lines belong to prescribers outside the practice list."""
    line = table(spark, sf, "lineitem")
    part = table(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("code"))
    unlisted = F.col("l_discount") >= 0.095
    unreadable = (
        (F.col("l_quantity") == 50) & (F.col("l_linenumber") == 7) & (F.col("l_tax") == 0.08)
    )
    return line.join(part, line["l_partkey"] == part["p_partkey"]).select(
        F.concat(F.when(unlisted, "X").otherwise("P"), "l_suppkey").alias("practice"),
        F.concat(
            F.lit("Practice "),
            "l_suppkey",
            F.when(F.col("l_linestatus") == "F", " (former)").otherwise(""),
        ).alias("practice_name"),
        F.trunc("l_shipdate", "month").alias("month"),
        "code",
        F.lit(1.0).alias("items"),
        F.when(~unreadable, F.col("l_quantity")).alias("quantity"),
        F.col("l_extendedprice").alias("cost"),
    )


def registrations(spark: SparkSession, sf: str) -> DataFrame:
    """Patients per practice and area; orders without a stated priority have no known area."""
    line = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    customer = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    known = F.col("o_orderpriority") != "4-NOT SPECIFIED"
    counts = (
        line.join(orders, line["l_orderkey"] == orders["o_orderkey"])
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy(
            "l_suppkey",
            F.when(known, F.col("c_nationkey")).alias("nation"),
            F.when(known, F.col("c_mktsegment")).alias("segment"),
        )
        .agg(F.count(F.lit(1)).alias("patients"))
    )
    return counts.select(
        F.concat(F.lit("P"), "l_suppkey").alias("practice"),
        F.coalesce(F.concat(F.lit("A"), "nation", F.lit("-"), "segment"), F.lit("EMPTY")).alias("area"),
        "patients",
    )


def _zone_code(nation: str, segment: str):
    return F.concat(F.lit("Z"), nation, F.lit("-"), segment)


def zones(spark: SparkSession, sf: str) -> DataFrame:
    """Zone -> locality -> parent; zones of one nation have no locality name."""
    customer = table(spark, sf, "customer")
    nation = table(spark, sf, "nation")
    cells = customer.select("c_nationkey", "c_mktsegment").distinct()
    return cells.join(nation, cells["c_nationkey"] == nation["n_nationkey"]).select(
        _zone_code("n_nationkey", "c_mktsegment").alias("zone"),
        F.nullif("n_name", F.lit("NATION_0")).alias("locality"),
        F.concat(F.lit("R"), "n_regionkey").alias("parent"),
    )


def zone_population(spark: SparkSession, sf: str) -> DataFrame:
    return (
        table(spark, sf, "customer")
        .groupBy(_zone_code("c_nationkey", "c_mktsegment").alias("zone_code"))
        .agg(F.count(F.lit(1)).alias("population"))
    )


def practice_list(spark: SparkSession, sf: str) -> DataFrame:
    """Listed practices with zone and stated parent; practices in debt state an outdated parent."""
    supplier = table(spark, sf, "supplier")
    nation = table(spark, sf, "nation")
    return supplier.join(nation, supplier["s_nationkey"] == nation["n_nationkey"]).select(
        F.concat(F.lit("P"), "s_suppkey").alias("practice"),
        _zone_code("s_nationkey", F.lit("BUILDING")).alias("zone"),
        F.when(F.col("s_acctbal") < 0, "R-old")
        .otherwise(F.concat(F.lit("R"), "n_regionkey"))
        .alias("practice_parent"),
    )


def locality_codes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nation").select(
        F.col("n_name").alias("locality_name"), F.concat(F.lit("C"), "n_nationkey").alias("code")
    )


def registered_by_area(spark: SparkSession, sf: str) -> DataFrame:
    """Area name = locality name + five characters; patients as text, one segment suppressed."""
    customer = table(spark, sf, "customer")
    nation = table(spark, sf, "nation").select("n_nationkey", "n_name")
    cells = customer.groupBy("c_nationkey", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
    return cells.join(nation, cells["c_nationkey"] == nation["n_nationkey"]).select(
        F.concat("n_name", F.lit(" "), F.substring("c_mktsegment", 1, 4)).alias("area_name"),
        F.when(F.col("c_mktsegment") == "MACHINERY", "*")
        .otherwise(F.col("n").cast("string"))
        .alias("patients"),
    )


def locality_rx(spark: SparkSession, sf: str) -> DataFrame:
    """Prescribing facts by locality code; unlisted prescribers have a code without areas."""
    facts = rx(spark, sf)
    supplier = table(spark, sf, "supplier").select(
        F.concat(F.lit("P"), "s_suppkey").alias("listed"),
        F.concat(F.lit("C"), "s_nationkey").alias("supplier_code"),
    )
    return facts.join(supplier, facts["practice"] == supplier["listed"], "left").select(
        F.coalesce("supplier_code", F.lit("UNALLOCATED")).alias("locality_code"),
        facts["code"],
        "items",
        "quantity",
        "cost",
    )


def smoking_sheet(spark: SparkSession, sf: str) -> DataFrame:
    """Practice counts as text; practices in debt have no readable case count."""
    line = table(spark, sf, "lineitem")
    supplier = table(spark, sf, "supplier").select("s_suppkey", "s_acctbal")
    counts = line.groupBy("l_suppkey").agg(
        F.count(F.when(F.col("l_returnflag") == "R", F.lit(1))).alias("cases"),
        F.count(F.lit(1)).alias("people"),
    )
    return counts.join(supplier, counts["l_suppkey"] == supplier["s_suppkey"]).select(
        F.concat(F.lit("P"), "l_suppkey").alias("practice"),
        F.when(F.col("s_acctbal") < 0, "-").otherwise(F.col("cases").cast("string")).alias("cases"),
        F.col("people").cast("string").alias("people"),
    )


def raw_sheet(spark: SparkSession, sf: str) -> DataFrame:
    """Supplier sheet as landed: title rows, a header row, data rows, footer rows, all text."""
    supplier = table(spark, sf, "supplier")
    data = supplier.select(
        (F.col("s_suppkey") + 4).alias("_row"),
        *[F.col(c).cast("string").alias(f"c{i}") for i, c in enumerate(supplier.columns, 1)],
    )
    end = table(spark, sf, "supplier").agg(F.max("s_suppkey").alias("m"))
    fixed = spark.createDataFrame(
        [
            (1, "Suppliers", None, None, None),
            (2, "All regions", None, None, None),
            (3, "code", "name", "nation", "balance"),
        ],
        "_row bigint, c1 string, c2 string, c3 string, c4 string",
    )
    none = F.lit(None).cast("string")
    footer = end.select(
        (F.col("m") + 5).alias("_row"),
        F.lit("Source: sheet").alias("c1"),
        none.alias("c2"),
        none.alias("c3"),
        none.alias("c4"),
    )
    return fixed.unionByName(data).unionByName(footer)


OCCUPANCY = {
    "Occupancy rating of -1 or less": ("AUTOMOBILE",),
    "Occupancy rating of 0": ("BUILDING",),
    "Occupancy rating of +1": ("FURNITURE",),
    "Occupancy rating of +2 or more": ("HOUSEHOLD", "MACHINERY"),
}
# Areas left out in sensitivity runs: the first two customers, whatever their country letter.
OUTLIERS = [f"{letter}{n:08d}" for letter in "ENSW" for n in (1, 2)]


def occupancy_sheet(spark: SparkSession, sf: str) -> DataFrame:
    """Text household counts per nation; a zero count is left blank."""
    customer = table(spark, sf, "customer")
    counts = [
        F.nullif(
            F.count(F.when(F.col("c_mktsegment").isin(*s), F.lit(1))).cast("string"), F.lit("0")
        ).alias(c)
        for c, s in OCCUPANCY.items()
    ]
    return customer.groupBy(F.concat(F.lit("N"), "c_nationkey").alias("area")).agg(*counts)


def event_counts(spark: SparkSession, sf: str) -> DataFrame:
    return (
        table(spark, sf, "events")
        .groupBy(F.col("user_id").alias("area"), F.col("event_type").alias("category"))
        .agg(F.count(F.lit(1)).alias("observation"))
    )


def _aged_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as people: age from quantity and status, sex from the return flag."""
    age = F.col("l_quantity").cast("int") + F.when(F.col("l_linestatus") == "F", 40).otherwise(0)
    sex = F.when(F.col("l_returnflag") == "N", "M").otherwise("F")
    # made before the join, which sorts narrower rows
    line = table(spark, sf, "lineitem").select("l_orderkey", age.alias("age"), sex.alias("sex"))
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return line.join(orders, line["l_orderkey"] == orders["o_orderkey"]).select("o_custkey", "age", "sex")


def age_sheet(spark: SparkSession, sf: str, columns: list[str]) -> DataFrame:
    """Wide sheet per nation: people by sex and single year, and their total."""
    people = _aged_lines(spark, sf)
    customer = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    cells = (
        people.join(customer, people["o_custkey"] == customer["c_custkey"])
        .groupBy(
            F.concat(F.lit("N"), "c_nationkey").alias("area_code"),
            F.concat("sex", "age").alias("label"),
        )
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return (
        cells.groupBy("area_code")
        .pivot("label", columns)
        .agg(F.sum("n"))
        .fillna(0)
        .withColumn("Total", F.expr(" + ".join(columns)))
    )


def output_area_sheet(spark: SparkSession, sf: str, columns: list[str]) -> DataFrame:
    """Wide sheet per customer (output area): text counts, '-' for zero."""
    years = [c for c in columns if c not in AGE_LABELS]
    # an area's people meet while their rows are narrow, and its wide row is made once, in one task
    people = _aged_lines(spark, sf).select("o_custkey", "age").repartition("o_custkey")
    wide = people.groupBy("o_custkey").agg(*[F.count_if(F.col("age") == int(c)).alias(c) for c in years])
    return wide.selectExpr(
        "concat('OA', o_custkey) AS oa_code",
        " + ".join(f"`{c}`" for c in years) + " AS `All people`",
        "'-' AS `Under 1`",
        *[f"coalesce(CAST(nullif(`{c}`, 0) AS string), '-') AS `{c}`" for c in years],
        "'-' AS `100 and over`",
    )


def output_area_zones(spark: SparkSession, sf: str) -> DataFrame:
    """Output area -> zone; output areas in debt have no zone."""
    return table(spark, sf, "customer").select(
        F.concat(F.lit("OA"), "c_custkey").alias("OA22"),
        F.when(F.col("c_acctbal") >= 0, _zone_code("c_nationkey", "c_mktsegment")).alias("DZ22"),
    )


def area_code():
    """Area id with the country letter taken from the region."""
    letter = (
        F.when(F.col("n_regionkey") <= 1, "E")
        .when(F.col("n_regionkey") == 2, "W")
        .when(F.col("n_regionkey") == 3, "S")
        .otherwise("N")
    )
    return F.concat(letter, F.lpad(F.col("c_custkey").cast("string"), 8, "0"))


def areas(spark: SparkSession, sf: str) -> DataFrame:
    """Area indicators, one row per customer."""
    customer = table(spark, sf, "customer")
    nation = table(spark, sf, "nation").select("n_nationkey", "n_regionkey")
    line = table(spark, sf, "lineitem")
    orders = table(spark, sf, "orders")
    urgent = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    per_customer = orders.groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n_orders"),
        F.sum(F.when(urgent, F.col("o_totalprice"))).alias("poverty"),
    )
    rates = (
        line.join(
            orders.select("o_orderkey", F.col("o_custkey").alias("r_custkey")),
            line["l_orderkey"] == F.col("o_orderkey"),
        )
        .groupBy("r_custkey")
        .agg(
            F.avg("l_discount").alias("inhaler_prv"),
            F.avg("l_tax").alias("antidep_prv"),
            (F.avg("l_quantity") / 50).alias("antianx_prv"),
            F.avg(F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0)).alias("antipsych_prv"),
        )
    )
    n = F.col("n_orders")
    level = (
        F.when(n >= 15, "Very hot")
        .when(n >= 13, "Hot")
        .when(n >= 11, "Somewhat hot")
        .when(n >= 9, "Insignificant")
        .when(n >= 7, "Somewhat cold")
        .when(n >= 5, "Cold")
        .when(n >= 3, "Very cold")
        .otherwise("No data")
    )
    settlement = (
        F.when(F.col("c_mktsegment") == "AUTOMOBILE", "Urban near town/city")
        .when(F.col("c_mktsegment") == "BUILDING", "Urban")
        .when(F.col("c_mktsegment") == "HOUSEHOLD", "Rural near town")
        .when(F.col("c_mktsegment") == "MACHINERY", "Rural")
    )
    return (
        customer.join(nation, customer["c_nationkey"] == nation["n_nationkey"])
        .join(per_customer, F.col("c_custkey") == F.col("o_custkey"), "left")
        .join(rates, F.col("c_custkey") == F.col("r_custkey"), "left")
        .select(
            area_code().alias("LSOA21CD"),
            level.alias("classification"),
            F.col("c_acctbal").alias("LSOA_incmedian"),
            F.col("poverty").alias("LSOA_FPmean"),
            settlement.alias("ruc21ind"),
            "inhaler_prv",
            "antidep_prv",
            "antianx_prv",
            "antipsych_prv",
        )
    )


def area_ages(spark: SparkSession, sf: str) -> DataFrame:
    """Age shares per customer area."""
    people = _aged_lines(spark, sf)
    customer = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf, "nation").select("n_nationkey", "n_regionkey")
    age = F.col("age")
    located = people.join(customer, people["o_custkey"] == customer["c_custkey"]).join(
        nation, F.col("c_nationkey") == F.col("n_nationkey")
    )
    total = F.count(F.lit(1))
    return located.groupBy(area_code().alias("area_code")).agg(
        ratio(F.count(F.when(age <= 17, 1)), total).alias("young_perc"),
        ratio(F.count(F.when(age.between(18, 64), 1)), total).alias("wa_perc"),
        ratio(F.count(F.when(age >= 65, 1)), total).alias("senior_perc"),
    )


def urban_rural(spark: SparkSession, sf: str) -> DataFrame:
    """Settlement type of the Scottish scheme for every area."""
    customer = table(spark, sf, "customer")
    nation = table(spark, sf, "nation").select("n_nationkey", "n_regionkey")
    kind = (
        F.when(F.col("c_mktsegment") == "AUTOMOBILE", "Large Urban Areas")
        .when(F.col("c_mktsegment") == "BUILDING", "Other Urban Areas")
        .when(F.col("c_mktsegment") == "HOUSEHOLD", "Accessible Small Towns")
        .otherwise("Remote Rural")
    )
    return customer.join(nation, customer["c_nationkey"] == nation["n_nationkey"]).select(
        area_code().alias("DZ22_Code"), kind.alias("UR6_Name")
    )


def matching_frame(spark: SparkSession, sf: str) -> DataFrame:
    """Areas with exposure, covariates and outcome; one row per customer, nothing missing.

    The exposure is a low account balance together with the local order volume, so treated areas
    are concentrated on one side of the covariates.
    """
    customer = table(spark, sf, "customer")
    orders = table(spark, sf, "orders")
    totals = orders.groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n_orders"), F.sum("o_totalprice").alias("volume")
    )
    return customer.join(totals, F.col("c_custkey") == F.col("o_custkey"), "left").select(
        F.col("c_custkey").alias("id"),
        F.when(F.col("n_orders") * 1000 + F.col("c_acctbal") > 17000, 1).otherwise(0).alias("t"),
        F.col("c_acctbal").alias("income"),
        F.coalesce("n_orders", F.lit(0)).cast("double").alias("orders"),
        F.col("c_mktsegment").alias("settlement"),
        F.coalesce(F.col("volume") / 100000, F.lit(0.0)).alias("y"),
    )
