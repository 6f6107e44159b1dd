"""The registry's queries in plain SQL (DuckDB dialect), on the same tables."""

from __future__ import annotations

from hearthmap.constants import HOTSPOT_LEVELS, NATION_LABELS
from hearthmap.plans.study import COMPARISONS
from hearthmap.standins import CLASSES, LABELS, OCCUPANCY, OUTLIERS

MEASURES = ["items", "quantity", "cost"]
# keeps exact halves from being rounded differently
NUDGE = 1.3e-6
RATES = {
    "inhaler": "inhaler_prv",
    "antidep": "antidep_prv",
    "antianx": "antianx_prv",
    "antipsych": "antipsych_prv",
}


def strict(x: str) -> str:
    return f"CASE WHEN count({x}) = count(*) THEN coalesce(sum({x}), 0) END"


def class_test(c) -> str:
    tests = []
    if c.prefix:
        tests.append(f"starts_with(code, '{c.prefix}')")
    if c.codes:
        tests.append("code IN (" + ", ".join(f"'{x}'" for x in c.codes) + ")")
    return "(" + " OR ".join(tests) + ")"


AREA_CODE = (
    "(CASE WHEN n_regionkey <= 1 THEN 'E' WHEN n_regionkey = 2 THEN 'W' "
    "WHEN n_regionkey = 3 THEN 'S' ELSE 'N' END) || lpad(CAST(c_custkey AS VARCHAR), 8, '0')"
)
_TAGGED = " UNION ALL ".join(
    f"SELECT *, '{c.label}' AS drug_type FROM {{}} WHERE {class_test(c)}" for c in CLASSES
)
_CLASS_ROWS = "(VALUES " + ", ".join(f"('{x}')" for x in LABELS) + ") AS k(class_key)"
_SUMS = ", ".join(f"{strict(m)} AS {m}" for m in MEASURES)

# name -> (needs, text)
VIEWS: dict[str, tuple[list[str], str]] = {
    "rx": (
        [],
        """SELECT (CASE WHEN l_discount >= 0.095 THEN 'X' ELSE 'P' END) || l_suppkey AS practice,
          'Practice ' || l_suppkey || (CASE WHEN l_linestatus = 'F' THEN ' (former)' ELSE '' END) AS practice_name,
          CAST(date_trunc('month', l_shipdate) AS DATE) AS month, p_brand AS code,
          CAST(1 AS DOUBLE) AS items,
          CASE WHEN NOT (l_quantity = 50 AND l_linenumber = 7 AND l_tax = 0.08) THEN l_quantity END AS quantity,
          l_extendedprice AS cost
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
    ),
    "reg": (
        [],
        """SELECT 'P' || l_suppkey AS practice,
          CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'EMPTY'
               ELSE 'A' || c_nationkey || '-' || c_mktsegment END AS area, count(*) AS patients
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
        GROUP BY 1, 2""",
    ),
    "shares": (
        ["reg"],
        """SELECT practice, area, patients,
          CAST(sum(patients) OVER (PARTITION BY practice) AS BIGINT) AS total_patients,
          patients / nullif(CAST(sum(patients) OVER (PARTITION BY practice) AS DOUBLE), 0) AS share
        FROM reg""",
    ),
    "tagged": (["rx"], _TAGGED.replace("{}", "rx")),
    "totals": (
        ["tagged"],
        f"SELECT drug_type, code, practice, practice_name, {_SUMS} FROM tagged GROUP BY 1, 2, 3, 4",
    ),
    "zones": (
        [],
        """SELECT DISTINCT 'Z' || n_nationkey || '-' || c_mktsegment AS zone,
          nullif(n_name, 'NATION_0') AS locality, 'R' || n_regionkey AS parent
        FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    ),
    "people": (
        [],
        """SELECT 'Z' || c_nationkey || '-' || c_mktsegment AS zone_code, count(*) AS population
        FROM customer GROUP BY 1""",
    ),
    "zone_shares": (
        ["zones", "people"],
        """SELECT zone, locality, parent, population,
          CAST(sum(population) OVER (PARTITION BY locality) AS BIGINT) AS locality_population,
          CAST(sum(population) OVER (PARTITION BY parent) AS BIGINT) AS parent_population,
          population / CAST(sum(population) OVER (PARTITION BY locality) AS DOUBLE) AS locality_share,
          population / CAST(sum(population) OVER (PARTITION BY parent) AS DOUBLE) AS parent_share
        FROM zones LEFT JOIN people ON zone = zone_code""",
    ),
    "listed": (
        [],
        """SELECT 'P' || s_suppkey AS practice, 'Z' || s_nationkey || '-BUILDING' AS zone,
          CASE WHEN s_acctbal < 0 THEN 'R-old' ELSE 'R' || n_regionkey END AS practice_parent
        FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    ),
    "placed": (
        ["listed", "zones"],
        """SELECT practice, zone, practice_parent, locality, parent AS zone_parent
        FROM listed LEFT JOIN zones USING (zone)""",
    ),
    "locality_rx": (
        ["rx"],
        """SELECT coalesce('C' || s_nationkey, 'UNALLOCATED') AS locality_code, code, items, quantity, cost
        FROM rx LEFT JOIN supplier ON practice = 'P' || s_suppkey""",
    ),
    "smoking": (
        [],
        """SELECT 'P' || l_suppkey AS practice,
          CASE WHEN any_value(s_acctbal) < 0 THEN '-'
               ELSE CAST(count(*) FILTER (l_returnflag = 'R') AS VARCHAR) END AS cases,
          CAST(count(*) AS VARCHAR) AS people
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY l_suppkey""",
    ),
    "registered": (
        [],
        """SELECT n_name || ' ' || substr(c_mktsegment, 1, 4) AS area_name,
          CASE WHEN c_mktsegment = 'MACHINERY' THEN '*' ELSE CAST(count(*) AS VARCHAR) END AS patients
        FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name, c_mktsegment""",
    ),
    "areas_shared": (
        ["registered"],
        """SELECT area_name, coalesce(TRY_CAST(patients AS DOUBLE), 0) AS patients,
          substr(area_name, 1, length(area_name) - 5) AS locality_name FROM registered""",
    ),
    "aged": (
        [],
        """SELECT o_custkey, CAST(l_quantity AS INT) + (CASE WHEN l_linestatus = 'F' THEN 40 ELSE 0 END) AS age,
          CASE WHEN l_returnflag = 'N' THEN 'M' ELSE 'F' END AS sex
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    ),
    "areas": (
        [],
        f"""SELECT {AREA_CODE} AS LSOA21CD,
          CASE WHEN n_orders >= 15 THEN 'Very hot' WHEN n_orders >= 13 THEN 'Hot'
               WHEN n_orders >= 11 THEN 'Somewhat hot' WHEN n_orders >= 9 THEN 'Insignificant'
               WHEN n_orders >= 7 THEN 'Somewhat cold' WHEN n_orders >= 5 THEN 'Cold'
               WHEN n_orders >= 3 THEN 'Very cold' ELSE 'No data' END AS classification,
          c_acctbal AS LSOA_incmedian, poverty AS LSOA_FPmean,
          CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Urban near town/city' WHEN 'BUILDING' THEN 'Urban'
               WHEN 'HOUSEHOLD' THEN 'Rural near town' WHEN 'MACHINERY' THEN 'Rural' END AS ruc21ind,
          inhaler_prv, antidep_prv, antianx_prv, antipsych_prv
        FROM customer JOIN nation ON c_nationkey = n_nationkey
        LEFT JOIN (SELECT o_custkey, count(*) AS n_orders,
                     sum(o_totalprice) FILTER (o_orderpriority IN ('1-URGENT', '2-HIGH')) AS poverty
                   FROM orders GROUP BY 1) po ON c_custkey = po.o_custkey
        LEFT JOIN (SELECT o_custkey, avg(l_discount) AS inhaler_prv, avg(l_tax) AS antidep_prv,
                     avg(l_quantity) / 50 AS antianx_prv,
                     avg(CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS antipsych_prv
                   FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1) pr ON c_custkey = pr.o_custkey""",
    ),
    "ages": (
        ["aged"],
        f"""SELECT {AREA_CODE} AS area_code,
          count(*) FILTER (age <= 17) / CAST(count(*) AS DOUBLE) AS young_perc,
          count(*) FILTER (age BETWEEN 18 AND 64) / CAST(count(*) AS DOUBLE) AS wa_perc,
          count(*) FILTER (age >= 65) / CAST(count(*) AS DOUBLE) AS senior_perc
        FROM aged JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""",
    ),
    "urban_rural": (
        [],
        f"""SELECT {AREA_CODE} AS area_code,
          CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Large Urban Areas' WHEN 'BUILDING' THEN 'Other Urban Areas'
               WHEN 'HOUSEHOLD' THEN 'Accessible Small Towns' ELSE 'Remote Rural' END AS settlement
        FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    ),
    "leveled": (
        ["areas"],
        "SELECT * REPLACE (CASE WHEN classification IN ("
        + ", ".join(f"'{x}'" for x in HOTSPOT_LEVELS)
        + ") THEN classification END AS classification) FROM areas",
    ),
    "income_breaks": (
        ["areas"],
        "SELECT quantile_cont(LSOA_incmedian, 0.25) AS b1, quantile_cont(LSOA_incmedian, 0.5) AS b2, "
        "quantile_cont(LSOA_incmedian, 0.75) AS b3 FROM areas",
    ),
    "groups": (
        ["leveled", "income_breaks"],
        """SELECT leveled.*, CASE WHEN classification IN ('Very hot', 'Hot') THEN 'Hotspots' ELSE 'Elsewhere' END AS top_or_not,
          CASE WHEN LSOA_incmedian IS NOT NULL THEN 1 + CAST(LSOA_incmedian > b1 AS INT)
            + CAST(LSOA_incmedian > b2 AS INT) + CAST(LSOA_incmedian > b3 AS INT) END AS income_dist_median
        FROM leveled, income_breaks""",
    ),
    "study": (
        [],
        """SELECT c_custkey AS id, CASE WHEN n_orders * 1000 + c_acctbal > 17000 THEN 1 ELSE 0 END AS t,
          c_acctbal AS income, CAST(coalesce(n_orders, 0) AS DOUBLE) AS orders, c_mktsegment AS settlement,
          coalesce(volume / 100000, 0) AS y
        FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n_orders, sum(o_totalprice) AS volume
                                 FROM orders GROUP BY 1) ON c_custkey = o_custkey""",
    ),
    "pairs": (
        ["study"],
        """SELECT a.id AS treated_id, b.id AS control_id
        FROM (SELECT id, row_number() OVER (ORDER BY id) AS k FROM study WHERE t = 1) a
        JOIN (SELECT id, row_number() OVER (ORDER BY id) AS k FROM study WHERE t = 0) b USING (k)""",
    ),
    "members": (
        ["pairs"],
        """SELECT treated_id AS id, treated_id AS subclass FROM pairs
        UNION ALL SELECT control_id, treated_id FROM pairs""",
    ),
    "flagged": (
        ["study", "members"],
        """SELECT study.*, CAST(subclass IS NOT NULL AS INT) AS matched, subclass
        FROM study LEFT JOIN members USING (id)""",
    ),
}


def sql(body: str, *needs: str, recursive: bool = False) -> str:
    """``body`` preceded by the views it needs, in order."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for n in VIEWS[name][0]:
            add(n)
        if name not in ordered:
            ordered.append(name)

    for name in needs:
        add(name)
    if not ordered:
        return body
    head = "WITH RECURSIVE " if recursive else "WITH "
    views = ", ".join(f"{n} AS ({VIEWS[n][1]})" for n in ordered)
    joiner = ", " if recursive else " "
    return f"{head}{views}{joiner}{body}"


def rounded(columns: list[str], digits: int = 4) -> str:
    return ", ".join(f'round("{c}", {digits}) AS "{c}"' for c in columns)


_SMALL_PARTS = "SELECT p_brand FROM part WHERE p_size = 1 AND p_partkey % 3 = 0"


def _by_code(test: str) -> str:
    return sql(
        f"SELECT code, count(*) AS n, round(sum(cost), 2) AS cost FROM rx WHERE {test} GROUP BY 1", "rx"
    )


def _apportioned(
    labels: list[str], months: str = "", after: bool = False, where: str = ""
) -> str:
    """Body: area volumes; ``months`` filters the facts, ``after`` fills after multiplying."""
    rows = ", ".join(f"('{x}')" for x in labels)
    if after:
        volume = ", ".join(f"round(sum(coalesce(coalesce({m}, 0) * share, 0)), 4) AS {m}" for m in MEASURES)
    else:
        parts = []
        for m in MEASURES:
            v = f"(coalesce({m}, 0) * share)"
            parts.append(f"round({strict(v)}, 4) AS {m}")
        volume = ", ".join(parts)
    source = "totals"
    if months:
        source = (
            f"(SELECT drug_type, code, practice, practice_name, {_SUMS} FROM tagged "
            f"WHERE {months} GROUP BY 1, 2, 3, 4)"
        )
    return (
        f"SELECT area, drug_type, {volume} FROM (SELECT area, k.drug_type, share, items, quantity, cost "
        f"FROM shares CROSS JOIN (VALUES {rows}) AS k(drug_type) LEFT JOIN {source} tt "
        f"ON shares.practice = tt.practice AND tt.drug_type = k.drug_type) {where} GROUP BY 1, 2"
    )


def _relabelled(column: str, nation: str) -> str:
    names = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in NATION_LABELS[nation].items())
    return f"CASE {column} {names} END"


def _two_step(faithful: bool) -> str:
    per_zone = ", ".join(
        f"round({m} + {NUDGE}, 4) AS {m}, round({m} * locality_share + {NUDGE}, 4) AS {m}_per_zone"
        for m in MEASURES
    )
    keep = "" if faithful else "WHERE item IS NOT NULL"
    return sql(
        f"""SELECT coalesce(z.class_key, p.class_key) AS class_key, zone,
          coalesce(z.locality, p.locality) AS locality, item, {per_zone}
        FROM (SELECT class_key, zone, locality, locality_share FROM zone_shares CROSS JOIN {_CLASS_ROWS}) z
        FULL JOIN (SELECT class_key, locality, item, {_SUMS} FROM (
            SELECT coalesce(l.class_key, u.drug_type) AS class_key, l.locality, u.drug_type AS item,
              u.items, u.quantity, u.cost
            FROM (SELECT class_key, practice, locality FROM placed CROSS JOIN {_CLASS_ROWS}) l
            FULL JOIN (SELECT drug_type, practice, {_SUMS} FROM tagged GROUP BY 1, 2) u
              ON l.class_key = u.drug_type AND l.practice = u.practice) {keep} GROUP BY 1, 2, 3) p
        ON z.class_key = p.class_key AND z.locality IS NOT DISTINCT FROM p.locality""",
        "zone_shares",
        "placed",
        "tagged",
    )


def _crosstab(view: str, column: str, levels: list[str], *needs: str) -> str:
    cells = ", ".join(
        f"round(coalesce(count(*) FILTER (c = '{x}') / nullif(CAST(any_value(t{i}) AS DOUBLE), 0), 0), 6) "
        f'AS "{x}"'
        for i, x in enumerate([*levels, "NA_"])
    )
    totals = ", ".join(
        f"count(*) FILTER (coalesce({column}, 'NA_') = '{x}') AS t{i}"
        for i, x in enumerate([*levels, "NA_"])
    )
    return sql(
        f"SELECT ruc21ind, {cells} FROM (SELECT coalesce(ruc21ind, 'NA_') AS ruc21ind, "
        f"coalesce({column}, 'NA_') AS c FROM {view}) CROSS JOIN (SELECT {totals} FROM {view}) GROUP BY 1",
        *needs,
    )


def _age_sums(value: str = "n") -> str:
    def band(test: str) -> str:
        return f"CAST(sum({value}) FILTER ({test}) AS DOUBLE)"

    return (
        f'{band("age <= 17")} AS "<=17", {band("age BETWEEN 18 AND 64")} AS "18-64", '
        f'{band("age >= 65")} AS "65+", CAST(sum({value}) AS DOUBLE) AS "Total"'
    )


def _bins(value: str, q: int) -> str:
    tests = " + ".join(f"CAST({value} > {value}_{q}_{i} AS INT)" for i in range(1, q))
    return f"CASE WHEN {value} IS NOT NULL THEN 1 + {tests} END"


def _break_columns(value: str, q: int) -> str:
    return ", ".join(f"quantile_cont({value}, {i / q!r}) AS {value}_{q}_{i}" for i in range(1, q))


def _anova(source: str) -> str:
    """Body of a one-row table from ``source`` with columns y and g."""
    return f"""SELECT k - 1.0::DOUBLE AS df1, n - k * 1.0::DOUBLE AS df2, ssb, ssw, ssb / (k - 1) AS msb, ssw / (n - k) AS msw,
      (ssb / (k - 1)) / (ssw / (n - k)) AS f
    FROM (SELECT count(*) AS k, sum(n) AS n, sum(n * (m - o) * (m - o)) AS ssb, sum(coalesce((n - 1) * v, 0)) AS ssw
      FROM (SELECT g, count(*) AS n, avg(y) AS m, var_samp(y) AS v FROM ({source}) GROUP BY g)
      CROSS JOIN (SELECT avg(y) AS o FROM ({source})))"""


def _welch(y: str, g: str) -> str:
    return sql(
        f"""SELECT round(b / ((k - 1) * (1 + 2 * (k - 2) * h)), 6) AS f, round(k - 1.0::DOUBLE, 6) AS df1, round(1 / (3 * h), 6) AS df2
        FROM (SELECT k, b, s / (k * k - 1.0::DOUBLE) AS h FROM (
          SELECT any_value(k) AS k, sum(w * (m - wm / ws) * (m - wm / ws)) AS b,
            sum((1 - w / ws) * (1 - w / ws) / (n - 1)) AS s
          FROM (SELECT *, n / v AS w FROM (SELECT {g} AS g, count(*) AS n, avg({y}) AS m, var_samp({y}) AS v
                FROM groups WHERE {y} IS NOT NULL AND {g} IS NOT NULL GROUP BY 1))
          CROSS JOIN (SELECT sum(n / v) AS ws, sum(n / v * m) AS wm, count(*) AS k
            FROM (SELECT count(*) AS n, avg({y}) AS m, var_samp({y}) AS v FROM groups
                  WHERE {y} IS NOT NULL AND {g} IS NOT NULL GROUP BY {g}))))""",
        "groups",
    )


def _welch_of(source: str) -> str:
    """Body of a one-row table (f, df1, df2) from ``source`` with columns y and g."""
    groups = f"SELECT g, count(*) AS n, avg(y) AS m, var_samp(y) AS v FROM ({source}) GROUP BY g"
    return f"""SELECT b / ((k - 1) * (1 + 2 * (k - 2) * h)) AS f, k - 1.0::DOUBLE AS df1, 1 / (3 * h) AS df2 FROM (
      SELECT k, b, s / (k * k - 1.0::DOUBLE) AS h FROM (
        SELECT any_value(k) AS k, sum(n / v * (m - wm / ws) * (m - wm / ws)) AS b, sum((1 - n / v / ws) * (1 - n / v / ws) / (n - 1)) AS s
        FROM ({groups}) CROSS JOIN (SELECT sum(n / v) AS ws, sum(n / v * m) AS wm, count(*) AS k FROM ({groups}))))"""


def _hotspot_report() -> str:
    """All tests of hotspots against elsewhere: subset, test, measure, f, df1, df2."""
    subsets = {
        "all": "true",
        "no outliers": f"coalesce(LSOA21CD NOT IN {tuple(OUTLIERS)}, true)",
        "low income": "income_dist_median = 1",
    }
    parts = []
    for subset, test, y in COMPARISONS:
        source = f"SELECT top_or_not AS g, {y} AS y FROM groups WHERE {subsets[subset]} AND {y} IS NOT NULL AND top_or_not IS NOT NULL"
        if test == "levene":
            middle = f"SELECT g AS h, quantile_cont(y, 0.5) AS m FROM ({source}) GROUP BY 1"
            source = f"SELECT g, abs(y - m) AS y FROM ({source}) JOIN ({middle}) ON g = h"
        body = _welch_of(source) if test == "welch" else _anova(source)
        parts.append(
            f"SELECT '{subset}' AS subset, '{test}' AS test, '{y}' AS measure, round(f, 6) AS f, round(df1, 6) AS df1, round(df2, 6) AS df2 FROM ({body})"
        )
    return sql(" UNION ALL ".join(parts), "groups")


def _hinges(value: str, by: str, view: str) -> str:
    return (
        f"SELECT {by}, quantile_cont({value}, 0.25) AS q1, quantile_cont({value}, 0.5) AS median, "
        f"quantile_cont({value}, 0.75) AS q3 FROM {view} WHERE {value} IS NOT NULL GROUP BY {by}"
    )


def _box(value: str, by: list[str], view: str, digits: int) -> str:
    keys = ", ".join(by)
    same = " AND ".join(f"a.{k} IS NOT DISTINCT FROM h.{k}" for k in by)
    inside = f"({value} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))"
    stats = rounded(["q1", "median", "q3", "lower_whisker", "upper_whisker"], digits)
    return sql(
        f"""SELECT {keys}, {stats}, n, n_outliers FROM (
          SELECT {", ".join("a." + k for k in by)}, max(q1) AS q1, max(median) AS median, max(q3) AS q3,
            min({value}) FILTER {inside} AS lower_whisker, max({value}) FILTER {inside} AS upper_whisker,
            count(*) AS n, count(*) FILTER (NOT {inside}) AS n_outliers
          FROM {view} a JOIN ({_hinges(value, keys, view)}) h ON {same}
          WHERE {value} IS NOT NULL GROUP BY {", ".join("a." + k for k in by)})""",
        view,
    )


def _histogram(source: str, *needs: str) -> str:
    """Round-valued cells around Sturges' number over the single column x of ``source``."""
    step = (
        "CASE WHEN 2 * base - cell >= 1.5 * (cell - base) THEN base "
        "WHEN 5 * base - cell >= 2.75 * (cell - 2 * base) THEN 2 * base "
        "WHEN 10 * base - cell >= 1.5 * (cell - 5 * base) THEN 5 * base ELSE 10 * base END"
    )
    return sql(
        f"""SELECT CAST(i AS INT) AS cell, lo + (i - 1) * step AS lower, lo + i * step AS upper, coalesce(n, 0) AS n
        FROM (SELECT *, unnest(generate_series(1, CAST(cells AS BIGINT))) AS i FROM (
          SELECT step, floor(a / step + 1e-7) * step AS lo, ceil(b / step - 1e-7) - floor(a / step + 1e-7) AS cells
          FROM (SELECT a, b, {step} AS step FROM (
            SELECT a, b, cell, pow(10::DOUBLE, floor(log10(cell))) AS base FROM (
              SELECT min(x) AS a, max(x) AS b, (max(x) - min(x)) / ceil(log2(count(*)) + 1) AS cell FROM ({source}))))))
        LEFT JOIN (SELECT greatest(ceil((x - lo) / step), 1) AS j, count(*) AS n FROM ({source}) CROSS JOIN (
          SELECT step, floor(a / step + 1e-7) * step AS lo FROM (SELECT a, b, {step} AS step FROM (
            SELECT a, b, cell, pow(10::DOUBLE, floor(log10(cell))) AS base FROM (
              SELECT min(x) AS a, max(x) AS b, (max(x) - min(x)) / ceil(log2(count(*)) + 1) AS cell FROM ({source})))))
          WHERE x IS NOT NULL GROUP BY 1) ON i = j""",
        *needs,
    )


SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def _balance(view: str, used: str, score: str = "") -> str:
    """Balance of income, orders and settlement levels; ``used`` picks the compared rows, ``score`` adds one."""
    long = (
        (f"SELECT t, {used} AS used, 'distance' AS variable, {score} AS v, false AS level FROM {view} UNION ALL " if score else "")
        + f"SELECT t, {used} AS used, 'income' AS variable, income AS v, false AS level FROM {view} UNION ALL "
        f"SELECT t, {used}, 'orders', orders, false FROM {view} UNION ALL "
        + " UNION ALL ".join(
            f"SELECT t, {used}, 'settlement_{s}', CAST(settlement = '{s}' AS INT)::DOUBLE, true FROM {view}"
            for s in SEGMENTS
        )
    )
    return sql(
        f"""SELECT variable, round(m1, 6) AS mean_treated, round(m0, 6) AS mean_control,
          round((m1 - m0) / nullif(sd, 0), 6) AS std_mean_diff,
          round(CASE WHEN NOT level THEN v1 / nullif(v0, 0) END, 6) AS var_ratio,
          round(CASE WHEN level THEN abs(m1 - m0) ELSE em END, 6) AS ecdf_mean,
          round(CASE WHEN level THEN abs(m1 - m0) ELSE ex END, 6) AS ecdf_max
        FROM (SELECT variable, any_value(level) AS level, avg(v) FILTER (t = 1 AND used) AS m1,
            avg(v) FILTER (t = 0 AND used) AS m0, var_samp(v) FILTER (t = 1 AND used) AS v1,
            var_samp(v) FILTER (t = 0 AND used) AS v0,
            sqrt(CASE WHEN any_value(level) THEN avg(v) FILTER (t = 1) * (1 - avg(v) FILTER (t = 1))
                 ELSE var_samp(v) FILTER (t = 1) END) AS sd
          FROM ({long}) GROUP BY 1)
        LEFT JOIN (SELECT variable, avg(gap) AS em, max(gap) AS ex FROM (
            SELECT variable, abs(sum(n1) OVER w / CAST(sum(n1) OVER p AS DOUBLE)
                               - sum(n0) OVER w / CAST(sum(n0) OVER p AS DOUBLE)) AS gap
            FROM (SELECT variable, v, count(*) FILTER (t = 1) AS n1, count(*) FILTER (t = 0) AS n0
                  FROM ({long}) WHERE used AND NOT level GROUP BY 1, 2)
            WINDOW w AS (PARTITION BY variable ORDER BY v), p AS (PARTITION BY variable)) GROUP BY 1) USING (variable)""",
        view,
    )


_GIVEN_SCORE = "(least(orders, 64) / 64 + round(income, 0) / 16384)"
# the end of the views that a balance body follows
_AFTER_VIEWS = "LEFT JOIN members USING (id)) "

# Income and orders within the levels of settlement, per arm of the matched rows: slopes b1, b2 and intercepts a.
_FULL_MODEL = """cells AS (SELECT t, settlement, count(*) AS n, avg(income) AS m1, avg(orders) AS m2, avg(y) AS my
    FROM flagged WHERE matched = 1 GROUP BY 1, 2),
  away AS (SELECT f.t, f.settlement, f.subclass, f.y, income, orders, income - m1 AS d1, orders - m2 AS d2, f.y - my AS dy
    FROM flagged f JOIN cells c ON f.t = c.t AND f.settlement = c.settlement WHERE matched = 1),
  crossed AS (SELECT t, sum(d1 * d1) AS s11, sum(d1 * d2) AS s12, sum(d2 * d2) AS s22, sum(d1 * dy) AS s1, sum(d2 * dy) AS s2 FROM away GROUP BY 1),
  slopes AS (SELECT *, s11 * s22 - s12 * s12 AS det, (s22 * s1 - s12 * s2) / (s11 * s22 - s12 * s12) AS b1,
    (s11 * s2 - s12 * s1) / (s11 * s22 - s12 * s12) AS b2 FROM crossed),
  starts AS (SELECT c.t, settlement, n, m1, m2, my - m1 * b1 - m2 * b2 AS a FROM cells c JOIN slopes s ON c.t = s.t),
  both_arms AS (SELECT settlement, any_value(a) FILTER (t = 0) AS a0, any_value(a) FILTER (t = 1) AS a1, any_value(n) FILTER (t = 0) AS n0,
    any_value(n) FILTER (t = 1) AS n1, any_value(m1) FILTER (t = 0) AS m10, any_value(m1) FILTER (t = 1) AS m11,
    any_value(m2) FILTER (t = 0) AS m20, any_value(m2) FILTER (t = 1) AS m21 FROM starts GROUP BY 1),
  base AS (SELECT a0, a1 FROM both_arms ORDER BY settlement LIMIT 1),
  arms AS (SELECT any_value(b1) FILTER (t = 0) AS b10, any_value(b1) FILTER (t = 1) AS b11, any_value(b2) FILTER (t = 0) AS b20,
    any_value(b2) FILTER (t = 1) AS b21 FROM slopes)
"""

_ONE_COVARIATE = """(SELECT t, count(*) AS n, avg(income) AS mx, avg(y) AS my, regr_slope(y, income) AS b,
    regr_intercept(y, income) AS a, var_pop(income) * count(*) AS sxx FROM flagged WHERE matched = 1 GROUP BY t)"""

ORACLE: dict[str, str] = {
    "s1_manifest_scan": """SELECT l_returnflag AS bnf_code, CAST(year(l_shipdate) AS INT) AS year, count(*) AS n,
        round(sum(l_quantity), 4) AS quantity, round(sum(l_extendedprice), 2) AS cost FROM lineitem GROUP BY 1, 2""",
    "s2_monthly_filter": sql(
        "SELECT code AS BNFItemCode, month, count(*) AS n, round(sum(quantity), 4) AS quantity, "
        "round(sum(cost), 2) AS cost FROM rx WHERE "
        + " OR ".join(class_test(c) for c in CLASSES)
        + " GROUP BY 1, 2",
        "rx",
    ),
    "s4_after_preamble": "SELECT s_suppkey AS key, s_nationkey AS nation, s_name || ', listed' AS name FROM supplier",
    "s4_inferred_names": "SELECT CAST(s_suppkey AS VARCHAR) AS key, CAST(s_nationkey AS VARCHAR) AS nation, s_name || ', listed' AS name FROM supplier",
    "s5_landed_sheet": """SELECT s_suppkey + 4 AS _row, CAST(s_suppkey AS VARCHAR) AS c1, s_name AS c2,
        CAST(s_nationkey AS VARCHAR) AS c3, CAST(s_acctbal AS VARCHAR) AS c4 FROM supplier
        UNION ALL SELECT * FROM (VALUES (1, 'Suppliers', NULL, NULL, NULL), (2, 'All regions', NULL, NULL, NULL),
          (3, 'code', 'name', 'nation', 'balance'))
        UNION ALL SELECT max(s_suppkey) + 5, 'Source: sheet', NULL, NULL, NULL FROM supplier""",
    "s6_raw_sheet_clean": "SELECT CAST(s_suppkey AS VARCHAR) AS code, s_name AS name, CAST(s_acctbal AS VARCHAR) AS balance FROM supplier",
    "s7_code_list": "SELECT DISTINCT p_brand FROM part",
    "k1_csv_round_trip": "SELECT * FROM customer",
    "k2_drop_index": "SELECT * FROM nation",
    "p2_drop_range": "SELECT p_partkey, p_name, p_brand FROM part",
    "p3_rename": "SELECT n_nationkey AS oa_code, n_name AS zone_name, n_regionkey FROM nation",
    "p5_ratio": "SELECT l_partkey, round(sum(l_tax) / nullif(sum(l_discount), 0), 9) AS tax_per_discount FROM lineitem GROUP BY 1",
    "p7_case": sql(
        "SELECT LSOA21CD, CASE WHEN classification IN ('Very hot', 'Hot') THEN 'Hotspots' ELSE 'Elsewhere' END AS top_or_not FROM areas",
        "areas",
    ),
    "p9_try_cast": sql("SELECT practice, TRY_CAST(cases AS DOUBLE) AS cases FROM smoking", "smoking"),
    "p10_ordered_factor": sql(
        "SELECT classification AS level, CASE "
        + " ".join(f"WHEN classification = '{x}' THEN {i}" for i, x in enumerate(HOTSPOT_LEVELS, 1))
        + " END AS rank, count(*) AS n FROM leveled GROUP BY 1, 2",
        "leveled",
    ),
    "p11_trim_suffix": sql("SELECT area_name, substr(area_name, 1, length(area_name) - 5) AS locality_name FROM registered", "registered"),
    "p13_sentinel": sql("SELECT practice, TRY_CAST(CASE WHEN cases = '-' THEN '0' ELSE cases END AS DOUBLE) AS cases FROM smoking", "smoking"),
    "f1_in_list": _by_code(class_test(CLASSES[3])),
    "f2_prefix": _by_code(class_test(CLASSES[0])),
    "f3_any_class": _by_code(" OR ".join(class_test(c) for c in CLASSES)),
    "f5_not_in_keep_null": sql("SELECT * FROM zones WHERE locality IS NULL OR locality NOT IN ('NATION_1', 'NATION_5')", "zones"),
    "f7_complete_case": sql(
        """SELECT LSOA21CD, ruc21ind, round(LSOA_FPmean, 4) AS LSOA_FPmean FROM areas WHERE LSOA_incmedian IS NOT NULL
        AND LSOA_FPmean IS NOT NULL AND ruc21ind IS NOT NULL AND inhaler_prv IS NOT NULL AND antidep_prv IS NOT NULL
        AND antianx_prv IS NOT NULL AND antipsych_prv IS NOT NULL""",
        "areas",
    ),
    "f8_sentinel": sql("SELECT * FROM reg WHERE area <> 'EMPTY'", "reg"),
    "f9_contains": sql(
        """SELECT CASE WHEN contains(LSOA21CD, 'E') THEN 'England' WHEN contains(LSOA21CD, 'W') THEN 'Wales'
        WHEN contains(LSOA21CD, 'S') THEN 'Scotland' END AS country, count(*) AS n FROM areas GROUP BY 1""",
        "areas",
    ),
    "j1_left": sql("SELECT practice, listed.zone, practice_parent, locality, parent FROM listed LEFT JOIN zones ON listed.zone = zones.zone", "listed", "zones"),
    "j3_right_coalesce": sql(
        f"""SELECT n_name AS locality_name, tt.locality_code AS code, {rounded(MEASURES)}
        FROM nation RIGHT JOIN (SELECT locality_code, {_SUMS} FROM locality_rx GROUP BY 1) tt
        ON 'C' || n_nationkey = tt.locality_code""",
        "locality_rx",
    ),
    "j4_full_nullsafe": sql(
        f"""SELECT zone, coalesce(z.locality, b.locality) AS locality, parent, items FROM zones z FULL JOIN (
          SELECT locality, {strict("items")} AS items FROM (
            SELECT locality, u.items FROM placed FULL JOIN (SELECT practice, sum(items) AS items FROM rx GROUP BY 1) u
            ON placed.practice = u.practice) GROUP BY 1) b ON z.locality IS NOT DISTINCT FROM b.locality""",
        "zones",
        "placed",
        "rx",
    ),
    "j5_grid": """SELECT DISTINCT p_brand, CAST(m AS DATE) AS month FROM part,
        (SELECT unnest(generate_series(DATE '1996-08-01', DATE '1997-07-01', INTERVAL 1 MONTH)) AS m)""",
    "a1_practice_totals": sql(
        f"SELECT code, practice, practice_name, {rounded(MEASURES)} FROM (SELECT code, practice, practice_name, {_SUMS} FROM rx GROUP BY 1, 2, 3)",
        "rx",
    ),
    "a5_rollup": """SELECT c_nationkey, o_orderstatus, round(sum(o_totalprice), 2) AS value
        FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2""",
    "a6_group_mean": sql(
        "SELECT classification, " + ", ".join(f"round(avg({s}) * 100, 6) AS {o}" for o, s in RATES.items())
        + " FROM areas WHERE LSOA_incmedian IS NOT NULL AND LSOA_FPmean IS NOT NULL AND ruc21ind IS NOT NULL"
        + "".join(f" AND {s} IS NOT NULL" for s in RATES.values())
        + " GROUP BY 1",
        "areas",
    ),
    "a7_ratio_of_sums": sql(
        """SELECT ruc21ind, round(coalesce(sum(LSOA_FPmean), 0), 2) AS poverty, round(coalesce(sum(LSOA_incmedian), 0), 2) AS income,
        round(coalesce(sum(LSOA_FPmean), 0) / nullif(coalesce(sum(LSOA_incmedian), 0), 0), 6) AS share FROM areas GROUP BY 1""",
        "areas",
    ),
    "a8_crosstab_flag": _crosstab("groups", "top_or_not", ["Elsewhere", "Hotspots"], "groups"),
    "a8_crosstab_levels": _crosstab("leveled", "classification", HOTSPOT_LEVELS, "leveled"),
    "a9_unpivot": sql(
        """SELECT area_code, label AS age_cat, coalesce(n, 0) AS value
        FROM (SELECT DISTINCT 'N' || c_nationkey AS area_code FROM aged JOIN customer ON o_custkey = c_custkey)
        CROSS JOIN (SELECT s || a AS label FROM (SELECT unnest(['F', 'M']) AS s) CROSS JOIN (SELECT unnest(generate_series(0, 90)) AS a))
        LEFT JOIN (SELECT 'N' || c_nationkey AS area, sex || age AS l, count(*) AS n
                   FROM aged JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2) ON area = area_code AND l = label
        UNION ALL SELECT 'N' || c_nationkey, 'Total', count(*) FROM aged JOIN customer ON o_custkey = c_custkey GROUP BY 1""",
        "aged",
    ),
    "a10_age_bands": sql(
        """SELECT label, CASE WHEN label = 'All people' THEN 'Total' WHEN label = 'Under 1' THEN '<=17'
          WHEN label = '100 and over' THEN '65+' WHEN CAST(a AS INT) <= 17 THEN '<=17' WHEN a <= 64 THEN '18-64' ELSE '65+' END AS band,
          CAST(coalesce(n, 0) AS DOUBLE) AS people
        FROM (SELECT a, CASE a WHEN 0 THEN 'Under 1' WHEN 100 THEN '100 and over' WHEN 101 THEN 'All people' ELSE CAST(a AS VARCHAR) END AS label
              FROM (SELECT unnest(generate_series(0, 101)) AS a))
        LEFT JOIN (SELECT age, count(*) AS n FROM aged GROUP BY 1 UNION ALL SELECT 101, count(*) FROM aged) ON a = age""",
        "aged",
    ),
    "a11_pivot": """SELECT o_custkey, nullif(count(*) FILTER (o_orderstatus = 'F'), 0) AS F, nullif(count(*) FILTER (o_orderstatus = 'O'), 0) AS O,
        nullif(count(*) FILTER (o_orderstatus = 'P'), 0) AS P FROM orders GROUP BY 1""",
    "a12_pivot_fill0": "SELECT user_id AS area, "
    + ", ".join(f"count(*) FILTER (event_type = '{e}') AS {e}" for e in ["click", "error", "purchase", "signup", "view"])
    + " FROM events GROUP BY 1",
    "a13_quartile": sql("SELECT LSOA21CD, income_dist_median AS bin FROM groups", "groups"),
    "a13_decile": sql(
        f"""SELECT LSOA21CD, {_bins("LSOA_FPmean", 10)} AS decile, {_bins("LSOA_FPmean", 5)} AS fifth FROM areas,
        (SELECT {_break_columns("LSOA_FPmean", 10)}, {_break_columns("LSOA_FPmean", 5)} FROM areas)""",
        "areas",
    ),
    "a14_distinct": sql("SELECT DISTINCT area FROM reg", "reg"),
    "w1_group_total": sql("SELECT practice, area, patients, total_patients, round(share, 6) AS share FROM shares", "shares"),
    "w2_multi_col_total": """SELECT c_custkey, round(sum(c_acctbal) OVER (PARTITION BY c_mktsegment)
        + sum(CAST(c_custkey AS DOUBLE)) OVER (PARTITION BY c_mktsegment), 2) AS total FROM customer""",
    "o1_head": sql("SELECT * FROM reg ORDER BY practice, area LIMIT 6", "reg"),
    "o2_group_order": sql("SELECT classification, round(quantile_cont(inhaler_prv, 0.5), 6) AS median FROM areas WHERE inhaler_prv IS NOT NULL GROUP BY 1 ORDER BY 2 DESC", "areas"),
    "u1_bind_rows": """SELECT s_name AS name, s_acctbal AS balance, CAST(NULL AS VARCHAR) AS segment FROM supplier
        UNION ALL SELECT c_name, NULL, c_mktsegment FROM customer""",
    "u2_rbind": "SELECT s_name AS name, s_acctbal AS balance FROM supplier UNION ALL SELECT c_name, c_acctbal FROM customer",
    "d1_classify": sql("SELECT drug_type, code, count(*) AS n, round(sum(cost), 2) AS cost FROM tagged GROUP BY 1, 2", "tagged"),
    "d1_classify_rows": sql("SELECT drug_type, practice, count(*) AS n, round(sum(cost), 2) AS cost FROM tagged GROUP BY 1, 2", "tagged"),
    "d1_listed_classes": sql(
        "SELECT drug_type, practice, "
        + ", ".join(f"round({strict(m)}, 2) AS {m}" for m in MEASURES)
        + f" FROM (SELECT * FROM tagged WHERE drug_type IN ('{LABELS[0]}', '{LABELS[1]}')"
        + f" UNION ALL SELECT *, 'small' FROM rx WHERE code IN ({_SMALL_PARTS})) GROUP BY 1, 2",
        "tagged",
        "rx",
    ),
    "f1_in_listed_class": _by_code(f"code IN ({_SMALL_PARTS})"),
    "f3_in_any_class": _by_code(f"{class_test(CLASSES[0])} OR {class_test(CLASSES[4])} OR code IN ({_SMALL_PARTS})"),
    "d1_classify_by_listing": sql(
        """SELECT drug_type, count(*) AS n, round(sum(cost), 2) AS cost FROM rx
        JOIN (SELECT DISTINCT p_brand, p_type AS drug_type FROM part) ON code = p_brand GROUP BY 1""",
        "rx",
    ),
    "d2_apportion": sql(_apportioned(LABELS), "shares", "totals"),
    "d2_apportion_twelve_months": sql(
        _apportioned(LABELS, "month >= DATE '1996-08-01' AND month < DATE '1997-08-01'"), "shares", "tagged"
    ),
    "d3_by_code": sql(
        "SELECT area, code, "
        + ", ".join(f"round(coalesce(sum({m} * share), 0), 4) AS {m}" for m in MEASURES)
        + f" FROM shares JOIN (SELECT code, practice, practice_name, {_SUMS} FROM rx GROUP BY 1, 2, 3) tt"
        + " USING (practice) GROUP BY 1, 2",
        "shares",
        "rx",
    ),
    "d3_rolled_up": sql(_apportioned(LABELS, after=True), "shares", "totals"),
    "d4a_zone_shares": sql(
        """SELECT zone, locality, parent, population, locality_population, parent_population,
        round(locality_share, 6) AS locality_share, round(parent_share, 6) AS parent_share FROM zone_shares""",
        "zone_shares",
    ),
    "d4b_two_step_faithful": _two_step(True),
    "d4b_two_step_clean": _two_step(False),
    "d4c_parent_check": sql("SELECT practice, practice_parent, zone_parent, CASE WHEN practice_parent = zone_parent THEN 1 ELSE 0 END AS parent_check FROM placed", "placed"),
    "d5_locality": sql(
        f"""SELECT area_name, patients, locality_name, locality_population, round(patients / nullif(locality_population, 0) + {NUDGE}, 4) AS locality_share,
          tt.locality_code AS code, drug_type, {", ".join(f"round({m} + {NUDGE}, 4) AS {m}" for m in MEASURES)},
          {", ".join(f"round({m} * (patients / nullif(locality_population, 0)) + {NUDGE}, 4) AS {m}_per_area" for m in MEASURES)}
        FROM (SELECT *, sum(patients) OVER (PARTITION BY locality_name) AS locality_population,
              'C' || n_nationkey AS code FROM areas_shared LEFT JOIN nation ON locality_name = n_name) s
        RIGHT JOIN (SELECT drug_type, locality_code, {_SUMS} FROM ({_TAGGED.replace("{}", "locality_rx")}) GROUP BY 1, 2) tt
        ON s.code = tt.locality_code""",
        "areas_shared",
        "locality_rx",
    ),
    "nation_england": sql(
        f"""SELECT area AS LSOA_CODE, CASE drug_type WHEN 'pain' THEN 'pain_medications' ELSE drug_type END AS drug_type, {", ".join(MEASURES)}
        FROM ({_apportioned(LABELS[:3])} UNION ALL {_apportioned(LABELS[3:], after=True)})""",
        "shares",
        "totals",
    ),
    "nation_scotland": _two_step(True)
    .replace("SELECT coalesce(z.class_key, p.class_key) AS class_key, zone,", f"SELECT {_relabelled('coalesce(z.class_key, p.class_key)', 'scotland')} AS class_key, zone AS \"DataZone\",")
    .replace("coalesce(z.locality, p.locality) AS locality, item,", f"coalesce(z.locality, p.locality) AS \"SubHSCPName\", {_relabelled('item', 'scotland')} AS item,"),
    "nation_wales": sql(
        f"""SELECT area_name AS "LSOA_name", locality_name AS "Locality", tt.locality_code AS "Code", {_relabelled("drug_type", "wales")} AS item,
          {", ".join(f"round({m} + {NUDGE}, 4) AS {m}" for m in MEASURES)},
          {", ".join(f"round({m} * (patients / nullif(locality_population, 0)) + {NUDGE}, 4) AS {m}_per_area" for m in MEASURES)}
        FROM (SELECT *, sum(patients) OVER (PARTITION BY locality_name) AS locality_population,
              'C' || n_nationkey AS code FROM areas_shared LEFT JOIN nation ON locality_name = n_name) s
        RIGHT JOIN (SELECT drug_type, locality_code, {_SUMS} FROM ({_TAGGED.replace("{}", "locality_rx")}) GROUP BY 1, 2) tt
        ON s.code = tt.locality_code""",
        "areas_shared",
        "locality_rx",
    ),
    "d6_stack": sql(_apportioned(LABELS), "shares", "totals"),
    "d7_prevalence": sql(
        """SELECT area, round(c, 4) AS cases, round(p, 4) AS people, round(c / nullif(p, 0), 4) AS prevalence FROM (
          SELECT area, coalesce(sum(coalesce(TRY_CAST(cases AS DOUBLE), 0) * share), 0) AS c,
            coalesce(sum(coalesce(TRY_CAST(people AS DOUBLE), 0) * share), 0) AS p
          FROM shares LEFT JOIN smoking USING (practice) GROUP BY 1)""",
        "shares",
        "smoking",
    ),
    "d8_overcrowding": "SELECT area, CASE WHEN "
    + " AND ".join(f'h{i} > 0' for i in range(4))
    + " THEN CAST(h0 + h1 + h2 + h3 AS DOUBLE) END AS total_households, round(CASE WHEN "
    + " AND ".join(f'h{i} > 0' for i in range(4))
    + " THEN h0 / CAST(h0 + h1 + h2 + h3 AS DOUBLE) END, 6) AS overcrowding_rate FROM (SELECT 'N' || c_nationkey AS area, "
    + ", ".join(f"count(*) FILTER (c_mktsegment IN {(*s, '')}) AS h{i}" for i, s in enumerate(OCCUPANCY.values()))
    + " FROM customer GROUP BY 1)",
    "d9_category_wide": "SELECT user_id AS area, "
    + ", ".join(f"count(*) FILTER (event_type = '{e}') AS {e}" for e in ["click", "error", "purchase", "signup", "view"])
    + " FROM events GROUP BY 1",
    "d9_category_map": """SELECT user_id % 1000 AS area_no, string_agg(category || '=' || n, ',' ORDER BY category) AS counts, count(*) AS n_categories FROM (
        SELECT user_id % 1000 AS user_id, coalesce(CASE WHEN event_type <> 'view' THEN event_type || '-' || (event_id % 400) END, 'NA') AS category, count(*) AS n
        FROM events GROUP BY 1, 2) GROUP BY 1""",
    "a12_null_category": """SELECT user_id % 1000 AS area_no, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'signup') AS signup,
        count(*) FILTER (event_type NOT IN ('click', 'signup')) AS "NA" FROM events GROUP BY 1""",
    "n13_rejected_levels": """SELECT event_type AS category, count(*) AS rows FROM events WHERE event_type NOT IN ('click', 'signup') GROUP BY 1""",
    "d10_age_table": sql(
        f"""SELECT area_code, "<=17", "18-64", "65+", "Total", round("<=17" / nullif("Total", 0), 6) AS young_perc,
          round("18-64" / nullif("Total", 0), 6) AS wa_perc, round("65+" / nullif("Total", 0), 6) AS senior_perc
        FROM (SELECT 'N' || c_nationkey AS area_code, {_age_sums("1").replace("sum(1) FILTER (", "count(*) FILTER (")}
              FROM aged JOIN customer ON o_custkey = c_custkey GROUP BY 1
        UNION ALL SELECT CASE WHEN c_acctbal >= 0 THEN 'Z' || c_nationkey || '-' || c_mktsegment END,
              {_age_sums("1").replace("sum(1) FILTER (", "count(*) FILTER (")}
              FROM aged JOIN customer ON o_custkey = c_custkey GROUP BY 1)""",
        "aged",
    ),
    "d11_analysis_table": sql(
        f"""SELECT LSOA21CD, income_dist_median, fp_quint_mean, fp_dec_mean,
          CASE WHEN fp_quint_mean = 5 THEN 'Highest fuel poverty' ELSE 'Elsewhere' END AS top5_or_not,
          CASE WHEN fp_dec_mean = 10 THEN 'Highest fuel poverty' ELSE 'Elsewhere' END AS top10_or_not,
          CASE WHEN fp_dec_mean IN (9, 10) THEN 1 ELSE 0 END AS top_20_or_not, urb_rur, country,
          CASE WHEN urb_rur IN ('Urban', 'Urban near town/city', 'Large Urban Areas', 'Other Urban Areas') THEN 'Urban'
               ELSE 'Small towns and rural' END AS urb_or_not,
          round(young_perc, 6) AS young_perc, round(wa_perc, 6) AS wa_perc, round(senior_perc, 6) AS senior_perc
        FROM (SELECT *, {_bins("LSOA_FPmean", 5)} AS fp_quint_mean, {_bins("LSOA_FPmean", 10)} AS fp_dec_mean,
            CASE WHEN contains(LSOA21CD, 'E') OR contains(LSOA21CD, 'W') THEN ruc21ind WHEN contains(LSOA21CD, 'S') THEN settlement END AS urb_rur,
            CASE WHEN contains(LSOA21CD, 'E') THEN 'England' WHEN contains(LSOA21CD, 'W') THEN 'Wales' WHEN contains(LSOA21CD, 'S') THEN 'Scotland' END AS country
          FROM groups CROSS JOIN (SELECT {_break_columns("LSOA_FPmean", 10)}, {_break_columns("LSOA_FPmean", 5)} FROM areas)
          LEFT JOIN ages ON LSOA21CD = ages.area_code LEFT JOIN urban_rural ON LSOA21CD = urban_rural.area_code)""",
        "groups",
        "ages",
        "urban_rural",
    ),
    "d12_hotspot_groups": sql("SELECT LSOA21CD, LSOA_incmedian, classification, top_or_not, income_dist_median FROM groups", "groups"),
    "d12_low_income": sql("SELECT LSOA21CD, top_or_not FROM groups WHERE income_dist_median = 1", "groups"),
    "d12_without_outliers": sql("SELECT LSOA21CD, top_or_not FROM groups WHERE LSOA21CD NOT IN " + str(tuple(OUTLIERS)), "groups"),
    "d13_group_rates": sql(
        "SELECT top_or_not, " + ", ".join(f"round(avg({s}) * 100, 6) AS {o}" for o, s in RATES.items())
        + " FROM groups WHERE classification IS NOT NULL AND LSOA_incmedian IS NOT NULL AND LSOA_FPmean IS NOT NULL AND ruc21ind IS NOT NULL"
        + "".join(f" AND {s} IS NOT NULL" for s in RATES.values())
        + " GROUP BY 1",
        "groups",
    ),
    "t1_levene": sql(
        "SELECT round(f, 6) AS f, round(df1, 6) AS df1, round(df2, 6) AS df2 FROM ("
        + _anova(
            "SELECT top_or_not AS g, abs(inhaler_prv - m) AS y FROM groups JOIN (SELECT top_or_not AS h, "
            "quantile_cont(inhaler_prv, 0.5) AS m FROM groups WHERE inhaler_prv IS NOT NULL GROUP BY 1) ON top_or_not = h WHERE inhaler_prv IS NOT NULL"
        )
        + ")",
        "groups",
    ),
    "t2_welch": _welch("inhaler_prv", "top_or_not"),
    "t2_welch_levels": _welch("antidep_prv", "classification"),
    "t3_anova": sql(
        "SELECT round(df1, 6) AS df1, round(df2, 6) AS df2, round(ssb, 6) AS ss_between, round(ssw, 6) AS ss_within, "
        "round(msb, 6) AS ms_between, round(msw, 6) AS ms_within, round(f, 6) AS f FROM ("
        + _anova("SELECT top_or_not AS g, antipsych_prv AS y FROM groups WHERE income_dist_median = 1 AND antipsych_prv IS NOT NULL")
        + ")",
        "groups",
    ),
    "t_hotspot_report": _hotspot_report(),
    "t4_boxstats": _box("LSOA_incmedian", ["classification"], "areas", 4),
    "t4_boxstats_two_keys": _box("inhaler_prv", ["income_dist_median", "top_or_not"], "groups", 6),
    "t4_outliers": sql(
        f"""SELECT LSOA21CD, a.top_or_not, round(inhaler_prv, 6) AS inhaler_prv FROM groups a
        JOIN ({_hinges("inhaler_prv", "top_or_not", "groups")}) h ON a.top_or_not = h.top_or_not
        WHERE NOT (inhaler_prv BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))""",
        "groups",
    ),
    "t5_histogram": _histogram(
        "SELECT items AS x FROM (" + _apportioned(["inhaler"], where="WHERE area <> 'EMPTY'") + ")",
        "shares",
        "totals",
    ),
    "t5_histogram_orders": _histogram("SELECT o_totalprice AS x FROM orders"),
    "t6_score_one_factor": sql(
        "SELECT id, round(avg(t) OVER (PARTITION BY settlement), 6) AS distance FROM study", "study"
    ),
    "t7_pairs_given_score": sql(
        """scored AS (SELECT id, t, least(orders, 64) / 64 + round(income, 0) / 16384 AS s FROM study),
        tr AS (SELECT row_number() OVER (ORDER BY s DESC, id) AS k, id, s FROM scored WHERE t = 1),
        co AS (SELECT id, s FROM scored WHERE t = 0),
        m(k, tid, cid, gap, used) AS (
          SELECT CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS DOUBLE), CAST([] AS BIGINT[])
          UNION ALL
          SELECT any_value(tr.k), any_value(tr.id), arg_min(co.id, (abs(co.s - tr.s), -co.s, co.id)), min(abs(co.s - tr.s)),
            list_append(any_value(used), arg_min(co.id, (abs(co.s - tr.s), -co.s, co.id)))
          FROM m JOIN tr ON tr.k = m.k + 1 JOIN co ON NOT list_contains(m.used, co.id)
          HAVING count(*) > 0)
        SELECT tid AS treated_id, cid AS control_id, round(gap, 9) AS gap FROM m WHERE k > 0""",
        "study",
        recursive=True,
    ),
    "t8_balance_unmatched": _balance("study", "true"),
    "t8_balance_given_pairs": _balance("flagged", "(matched = 1)"),
    "t8_pair_distance": sql(
        "SELECT variable, round(g / s, 6) AS pair_dist FROM ("
        + " UNION ALL ".join(
            f"SELECT '{v}' AS variable, (SELECT avg(abs(a.{v} - b.{v})) FROM pairs JOIN study a ON treated_id = a.id "
            f"JOIN study b ON control_id = b.id) AS g, (SELECT stddev_samp({v}) FROM study WHERE t = 1) AS s"
            for v in ("income", "orders")
        )
        + ")",
        "pairs",
    ),
    "t8_report": sql(
        f"""SELECT b.*, round(pair_dist, 6) AS pair_dist FROM ({_balance("flagged", "(matched = 1)", _GIVEN_SCORE).partition(_AFTER_VIEWS)[2]}) b JOIN ("""
        + " UNION ALL ".join(
            f"SELECT '{name}' AS variable, (SELECT avg(abs(a.v - b.v)) FROM pairs JOIN (SELECT id, {x} AS v FROM study) a ON treated_id = a.id "
            f"JOIN (SELECT id, {x} AS v FROM study) b ON control_id = b.id) / (SELECT stddev_samp({x}) FROM study WHERE t = 1) AS pair_dist"
            for name, x in (("distance", _GIVEN_SCORE), ("income", "income"), ("orders", "orders"))
        )
        + " UNION ALL "
        + " UNION ALL ".join(
            f"SELECT 'settlement_{x}', (SELECT avg(CAST((a.settlement = '{x}') <> (b.settlement = '{x}') AS INT)) FROM pairs JOIN study a ON treated_id = a.id "
            f"JOIN study b ON control_id = b.id) / (SELECT sqrt(avg(CAST(settlement = '{x}' AS INT)) * (1 - avg(CAST(settlement = '{x}' AS INT)))) FROM study WHERE t = 1)"
            for x in SEGMENTS
        )
        + ") g USING (variable)",
        "flagged",
        "pairs",
    ),
    "t8_sample_sizes": sql(
        " UNION ALL ".join(
            f"SELECT '{name}' AS sample, count(*) FILTER (t = 0 AND {test}) AS control, count(*) FILTER (t = 1 AND {test}) AS treated FROM flagged"
            for name, test in (("All", "true"), ("Matched", "matched = 1"), ("Unmatched", "matched = 0"))
        ),
        "flagged",
    ),
    "t9_matched_given_pairs": sql(
        "SELECT id, t, subclass, CAST(1 AS DOUBLE) AS weights FROM flagged WHERE matched = 1", "flagged"
    ),
    "t6_score_equations": sql(
        """SELECT settlement, round(CAST(sum(CAST(id % 3 = 0 AS INT)) AS DOUBLE), 5) AS expected, 0.0::DOUBLE AS left, count(*) AS n FROM study GROUP BY 1
        UNION ALL SELECT '(orders, income)', round(sum(CASE WHEN id % 3 = 0 THEN orders ELSE 0 END), 3), 0.0, count(*) FROM study""",
        "study",
    ),
    "t10_wls": sql(
        f"""{_FULL_MODEL} SELECT term, round(estimate, 7) AS estimate FROM (
          SELECT unnest(['(Intercept)', 't', 'income', 'orders', 't:income', 't:orders']) AS term,
            unnest([a0, a1 - a0, b10, b20, b11 - b10, b21 - b20]) AS estimate FROM base, arms
          UNION ALL SELECT 'settlement_' || settlement, m.a0 - b.a0 FROM both_arms m, base b WHERE settlement <> (SELECT min(settlement) FROM both_arms)
          UNION ALL SELECT 't:settlement_' || settlement, m.a1 - m.a0 - (b.a1 - b.a0) FROM both_arms m, base b
            WHERE settlement <> (SELECT min(settlement) FROM both_arms))""",
        "flagged",
        recursive=True,
    ),
    "t11_att": sql(
        f"""{_FULL_MODEL},
        treated AS (SELECT avg(income) AS x1, avg(orders) AS x2, CAST(count(*) AS DOUBLE) AS n FROM flagged WHERE matched = 1 AND t = 1),
        shares AS (SELECT m.*, n1 / (SELECT n FROM treated) AS u FROM both_arms m),
        sums AS (SELECT sum(u * (a1 - a0)) AS gap, sum(u * m10) AS u10, sum(u * m11) AS u11, sum(u * m20) AS u20, sum(u * m21) AS u21 FROM shares),
        found AS (SELECT gap + x1 * (b11 - b10) + x2 * (b21 - b20) AS est, n FROM sums, treated, arms),
        pull AS (SELECT s.t, (s22 * c1 - s12 * c2) / det AS p1, (s11 * c2 - s12 * c1) / det AS p2 FROM slopes s JOIN (
          SELECT 0 AS t, x1 - u10 AS c1, x2 - u20 AS c2 FROM treated, sums UNION ALL SELECT 1, x1 - u11, x2 - u21 FROM treated, sums) c ON s.t = c.t),
        influence AS (SELECT subclass, sum((2 * w.t - 1) * (w.dy - b1 * d1 - b2 * d2) * (u / (CASE WHEN w.t = 1 THEN n1 ELSE n0 END) + p1 * d1 + p2 * d2)) AS f, count(*) AS k
          FROM away w JOIN slopes s ON w.t = s.t JOIN pull p ON w.t = p.t JOIN shares h ON w.settlement = h.settlement GROUP BY 1),
        spread AS (SELECT sum(f * f) AS ss, count(*) AS g, sum(k) AS nn FROM influence),
        errors AS (SELECT g, sqrt(ss * g / (g - 1) * (nn - 1) / (nn - (2 * (SELECT count(*) FROM both_arms) + 4))) AS se FROM spread)
        SELECT round(est, 6) AS estimate, round(se, 6) AS std_error, round(est / se, 5) AS z, CAST(n AS BIGINT) AS n_treated, g AS n_clusters FROM found, errors""",
        "flagged",
        recursive=True,
    ),
    "t10_wls_one_covariate": sql(
        f"""SELECT term, round(estimate, 7) AS estimate FROM (
          SELECT unnest(['(Intercept)', 't', 'income', 't:income']) AS term,
            unnest([c.a, d.a - c.a, c.b, d.b - c.b]) AS estimate
          FROM (SELECT * FROM {_ONE_COVARIATE} WHERE t = 0) c, (SELECT * FROM {_ONE_COVARIATE} WHERE t = 1) d)""",
        "flagged",
    ),
    "t11_att_one_covariate": sql(
        f"""SELECT round(est, 6) AS estimate, round(se, 6) AS std_error, round(est / se, 5) AS z, n1 AS n_treated, g AS n_clusters FROM (
          SELECT any_value(d.my - (c.a + c.b * d.mx)) AS est, any_value(d.n) AS n1, any_value(gg) AS g,
            sqrt(sum(pow(infl, 2)) * any_value(gg) / (any_value(gg) - 1.0::DOUBLE) * (any_value(nn) - 1) / (any_value(nn) - 4)) AS se
          FROM (SELECT subclass, sum(CASE WHEN f.t = 1 THEN (y - (d.a + d.b * income)) / d.n
                  ELSE -(y - (c.a + c.b * income)) * (1 / c.n::DOUBLE + (d.mx - c.mx) * (income - c.mx) / c.sxx) END) AS infl
                FROM flagged f, (SELECT * FROM {_ONE_COVARIATE} WHERE t = 0) c, (SELECT * FROM {_ONE_COVARIATE} WHERE t = 1) d
                WHERE matched = 1 GROUP BY 1),
            (SELECT * FROM {_ONE_COVARIATE} WHERE t = 0) c, (SELECT * FROM {_ONE_COVARIATE} WHERE t = 1) d,
            (SELECT count(*) AS nn, count(DISTINCT subclass) AS gg FROM flagged WHERE matched = 1))""",
        "flagged",
    ),
    "t12_distribution_levels": sql(
        " UNION ALL ".join(
            f"""SELECT variable, t, matched, CAST(cell AS INT) AS cell, CAST(NULL AS VARCHAR) AS level, n, round(n / CAST(sum(n) OVER (PARTITION BY t, matched) AS DOUBLE), 6) AS proportion
            FROM (SELECT '{name}' AS variable, t, matched, least(greatest(ceil((({v} - lo) / nullif(hi - lo, 0)) * 20), 1), 20) AS cell, count(*) AS n
                  FROM flagged, (SELECT min({v}) AS lo, max({v}) AS hi FROM flagged) GROUP BY 1, 2, 3, 4)"""
            for name, v in (("distance", _GIVEN_SCORE), ("income", "income"), ("orders", "orders"))
        )
        + """ UNION ALL SELECT 'settlement', t, matched, NULL, settlement, count(*), round(count(*) / CAST(sum(count(*)) OVER (PARTITION BY t, matched) AS DOUBLE), 6)
          FROM flagged GROUP BY t, matched, settlement""",
        "flagged",
    ),
    "t12_distribution": sql(
        " UNION ALL ".join(
            f"""SELECT variable, t, matched, CAST(cell AS INT) AS cell, n, round(n / CAST(sum(n) OVER (PARTITION BY t, matched) AS DOUBLE), 6) AS proportion
            FROM (SELECT '{v}' AS variable, t, matched, least(greatest(ceil((({v} - lo) / nullif(hi - lo, 0)) * 20), 1), 20) AS cell, count(*) AS n
                  FROM flagged, (SELECT min({v}) AS lo, max({v}) AS hi FROM flagged) GROUP BY 1, 2, 3, 4)"""
            for v in ("income", "orders")
        ),
        "flagged",
    ),
}
