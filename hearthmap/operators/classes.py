"""Drug classes: prefix- or list-defined, possibly overlapping."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from hearthmap.functions.joins import lookup_join


@dataclass(frozen=True)
class DrugClass:
    """A class is every code that starts with ``prefix``, is in ``codes`` or in the table ``listing``.

    ``listing`` has one text column; it is joined and may be of any size.
    """

    label: str
    prefix: str | None = None
    codes: tuple[str, ...] = field(default=())
    listing: DataFrame | None = field(default=None, compare=False)

    def matches(self, code: str) -> Column:
        """Predicate on a code; a listing is a table and has to be joined (:func:`in_class`)."""
        if self.listing is not None:
            raise ValueError(f"the codes of {self.label} are a table: use in_class or in_any_class")
        return self._literal(code)

    def _literal(self, code: str) -> Column:
        tests = []
        if self.prefix is not None:
            # startswith (unlike a regex) is pushed into the Parquet scan
            tests.append(F.col(code).startswith(self.prefix))
        if self.codes:
            tests.append(F.col(code).isin(*self.codes))
        return reduce(Column.__or__, tests, F.lit(False)) if len(tests) != 1 else tests[0]

    def entries(self) -> list[tuple[int, str, str]]:
        """Index entries (length, key, label) of what is given in code; no code meets two of them."""
        own = [] if self.prefix is None else [(len(self.prefix), self.prefix, self.label)]
        points = [c for c in dict.fromkeys(self.codes) if self.prefix is None or not c.startswith(self.prefix)]
        return own + [(WHOLE, c, self.label) for c in points]

    def listed_entries(self, label: str) -> DataFrame:
        """Index entries of the listing, without codes that another entry of the class covers."""
        column = self.listing.columns[0]
        known = self.listing.where(F.col(column).isNotNull() & ~self._literal(column))
        return known.select(F.lit(WHOLE).alias("_length"), F.col(column).alias("_key"), F.lit(self.label).alias(label)).distinct()


# Length of an index entry that is a whole code and not a prefix.
WHOLE = -1


def code_list(df: DataFrame, column: str) -> DataFrame:
    """Distinct codes of a list table."""
    return df.select(column).distinct()


def class_from_list(label: str, codes: DataFrame, column: str) -> DrugClass:
    """Class from a published code list of any size."""
    return DrugClass(label, listing=code_list(codes, column).where(F.col(column).isNotNull()))


def classify_by_listing(
    fact: DataFrame, code: str, listing: DataFrame, listed_code: str, label: str = "drug_type"
) -> DataFrame:
    """As :func:`classify_codes` for listings of any size: one row per (code, class) to join."""
    pairs = listing.select(F.col(listed_code), F.col(label)).where(F.col(listed_code).isNotNull())
    return lookup_join(fact, pairs.distinct(), [(code, listed_code)], "inner")


def any_class(code: str, classes: list[DrugClass]) -> Column:
    """The code belongs to at least one class (classes without listing)."""
    return reduce(Column.__or__, [c.matches(code) for c in classes])


def in_class(fact: DataFrame, code: str, one: DrugClass) -> DataFrame:
    """Rows whose code belongs to the class."""
    if one.listing is None:
        return fact.where(one.matches(code))
    return classify_codes(fact, code, [one], "_class").drop("_class")


def in_any_class(fact: DataFrame, code: str, classes: list[DrugClass]) -> DataFrame:
    """Rows whose code belongs to at least one class, each once."""
    listed = [c.listing.toDF("_listed") for c in classes if c.listing is not None]
    if not listed:
        return fact.where(any_class(code, classes))
    given = reduce(Column.__or__, [c._literal(code) for c in classes])
    codes = reduce(DataFrame.unionAll, listed).where("_listed is not null").distinct().withColumn("_hit", F.lit(True))
    return lookup_join(fact, codes, [(code, "_listed")]).where(given | F.col("_hit")).drop("_hit")


def classify_codes(
    fact: DataFrame, code: str, classes: list[DrugClass], label: str = "drug_type"
) -> DataFrame:
    """One output row per (fact row, class it belongs to); one scan for all classes.

    The classes form an index of code ranges: a prefix is the range of codes that begin with it, a listed
    code is a range of one.  A code is looked up once per length that occurs among the entries, so the
    work per row does not grow with the classes or their listings.  Without listings the pre-filter
    reaches the scan and the index, given in code, is broadcast; with them its size is checked.  A code in
    two classes yields two rows.
    """
    entries = [e for c in classes for e in c.entries()]
    listings = [c.listed_entries(label) for c in classes if c.listing is not None]
    spark = fact.sparkSession
    index = spark.createDataFrame(entries, f"_length int, _key string, `{label}` string")
    lengths = sorted({e[0] for e in entries} | ({WHOLE} if listings else set()))
    if not lengths:
        return fact.withColumn(label, F.lit("")).limit(0)
    probes = F.array(
        *[
            F.struct(F.lit(n).alias("_length"), (F.col(code) if n == WHOLE else F.substring(code, 1, n)).alias("_key"))
            for n in lengths
        ]
    )
    names = [f"`{c}`" for c in fact.columns]
    if not listings:
        probed = fact.where(any_class(code, classes)).select(*names, F.inline(probes))
        found = probed.join(F.broadcast(index), ["_length", "_key"])
    else:
        whole = reduce(DataFrame.unionAll, listings, index)
        probed = fact.where(F.col(code).isNotNull()).select(*names, F.inline(probes))
        found = lookup_join(probed, whole, ["_length", "_key"], "inner")
    return found.select(*names, label)


def relabel(df: DataFrame, labels: dict[str, str], label: str = "drug_type") -> DataFrame:
    """Replace class labels by a nation's own wording."""
    return df.replace(labels, subset=[label])
