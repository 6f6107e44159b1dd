"""Fixed values (result-defining word lists, codes, labels and file layouts)."""

from __future__ import annotations

# --- Fixed values: drug classes -------------------------------------------------
# Prefix-defined classes; inhaler and pain classes are lists loaded from code tables.
PREFIX_CLASSES = {
    "anti_anxiety": "040102",
    "anti_psychotic": "0402",
    "anti_depressants": "0403",
}
# Labels each nation's output uses for the five classes.
NATION_LABELS = {
    "england": {
        "anti_anxiety": "anti_anxiety",
        "anti_depressants": "anti_depressants",
        "anti_psychotic": "anti_psychotic",
        "inhaler": "inhaler",
        "pain": "pain_medications",
    },
    "scotland": {
        "inhaler": "inhaler",
        "anti_anxiety": "antianx",
        "anti_depressants": "antidep",
        "anti_psychotic": "antipsych",
        "pain": "painmed",
    },
    "wales": {
        "inhaler": "inhalers",
        "anti_anxiety": "antianx",
        "anti_depressants": "antidep",
        "anti_psychotic": "antipsych",
        "pain": "painmed",
    },
}

# --- Fixed values: study window, first month and number of months -----------------
STUDY_START = (2024, 8)
STUDY_MONTHS = 12

# --- Fixed values: hotspot levels, hottest first ----------------------------------
HOTSPOT_LEVELS = [
    "Very hot",
    "Hot",
    "Somewhat hot",
    "Insignificant",
    "Somewhat cold",
    "Cold",
    "Very cold",
]
HOT_LEVELS = ["Very hot", "Hot"]
OUTLIER_AREAS = ["E01009406", "E01015180"]

# --- Fixed values: settlement labels counted as urban -----------------------------
URBAN_LABELS = [
    "Urban",
    "Urban near town/city",
    "Large Urban Areas",
    "Other Urban Areas",
]

# --- Fixed values: labels ---------------------------------------------------------
EMPTY_AREA = "EMPTY"
HIGHEST = "Highest fuel poverty"
ELSEWHERE = "Elsewhere"
HOTSPOTS = "Hotspots"
URBAN = "Urban"
NOT_URBAN = "Small towns and rural"
AREA_SUFFIX_LENGTH = 5
AGE_BANDS = ["<=17", "18-64", "65+", "Total"]
# Oldest age of the young band, first age of the senior band.
YOUNG_MAX, SENIOR_MIN = 17, 65
ENGLAND_AGE_MAX, SCOTLAND_AGE_MAX = 90, 99
# Row-name columns that CSV exports leave behind.
INDEX_COLUMNS = ["X", "...1", "_c0"]


def england_age_columns() -> list[str]:
    """Single-year columns of the England and Wales sheet: F0..F90, M0..M90."""
    return [f"{sex}{age}" for sex in "FM" for age in range(ENGLAND_AGE_MAX + 1)]


def scotland_age_columns() -> list[str]:
    """Age columns of the Scottish output-area sheet."""
    years = [str(a) for a in range(1, SCOTLAND_AGE_MAX + 1)]
    return ["All people", "Under 1", *years, "100 and over"]


# --- Fixed values: schemas of the landed files -------------------------------------
RX_ENGLAND = (
    "ccg string, row_id string, row_name string, actual_cost double, "
    "items double, quantity double, setting string, date date"
)
RX_SCOTLAND = (
    "HBT string, GPPractice string, DMDCode string, BNFItemCode string, "
    "BNFItemDescription string, PrescribedType string, NumberOfPaidItems double, "
    "PaidQuantity double, GrossIngredientCost double, PaidDateMonth string"
)
RX_WALES = (
    "HB string, Locality string, PracticeID string, BNFCode string, BNFName string, "
    "Items double, NIC double, ActCost double, Quantity double, DDD double, "
    "ADQ double, Period string"
)
REGISTRATIONS = "PRACTICE_CODE string, LSOA_CODE string, NUMBER_OF_PATIENTS bigint"
ZONE_LOOKUP = "DataZone string, SubHSCPName string, HSCP string"
ZONE_POPULATION = "Data_zone_code string, Total_population bigint"
PRACTICE_LIST = (
    "PracticeCode string, GPPracticeName string, PracticeListSize bigint, "
    "DataZone string, HSCP string, GPCluster string"
)
LOCALITY_CODES = "Locality string, Code string"
WALES_REGISTERED = "LSOA_name string, patients string"
AREA_INDICATORS = (
    "LSOA21CD string, classification string, LSOA_incmedian double, LSOA_FPmean double, "
    "ruc21ind string, inhaler_prv double, antidep_prv double, antianx_prv double, "
    "antipsych_prv double"
)
OA_ZONE_LOOKUP = "OA22 string, DZ22 string"
URBAN_RURAL = "DZ22_Code string, UR6_Name string"
