import math
import random

import numpy as np
import pytest
from conftest import table
from pyspark.sql import functions as F

from hearthmap.functions import nulls, tails
from hearthmap.functions.joins import full_join, group_totals, keep_all_lookup, lookup_join
from hearthmap.functions.ordered import exact_quantiles, running_totals


def test_sums_and_ratio(frame):
    df = frame([("a", 1.0, 0.0), ("a", None, 0.0), ("b", 2.0, 4.0), ("c", None, 1.0)], "k string, x double, y double")
    out = df.groupBy("k").agg(
        nulls.strict_sum("x").alias("strict"),
        nulls.lenient_sum("x").alias("lenient"),
        nulls.ratio(F.sum("x"), F.sum("y")).alias("ratio"),
    )
    assert table(out, "k", "strict", "lenient", "ratio") == [
        ("a", None, 1.0, None), ("b", 2.0, 2.0, 0.5), ("c", None, 0.0, None)
    ]
    assert df.where("k = 'none'").agg(nulls.strict_sum("x").alias("s")).first()["s"] == 0


def test_not_in_keeps_null(frame):
    df = frame([(None,), ("a",), ("b",)], "k string")
    assert table(df.where(nulls.not_in_keep_null("k", ["a"])), "k") == [(None,), ("b",)]


def test_text_helpers(frame):
    df = frame([("-",), ("12",), ("x",), ("NaN",), (None,)], "s string")
    out = df.select(nulls.to_number("s").alias("n"), nulls.to_number(nulls.dash_to_zero("s")).alias("z"))
    assert [tuple(r) for r in out.collect()] == [(None, 0.0), (12.0, 12.0), (None, None), (None, None), (None, None)]
    names = frame([("Cardiff 001A",), ("abc",), ("",)], "s string")
    assert [r[0] for r in names.select(nulls.drop_suffix("s", 5)).collect()] == ["Cardiff", "", ""]


def test_levels(frame):
    df = frame([("Hot",), ("other",), (None,)], "s string")
    out = df.select(nulls.ordered_level("s", ["Cold", "Hot"]).alias("l"), nulls.level_rank("s", ["Cold", "Hot"]).alias("r"))
    assert [tuple(r) for r in out.collect()] == [("Hot", 2), (None, None), (None, None)]


@pytest.mark.parametrize("broadcast_bytes", [0, 10**6])
def test_joins_match_null_keys_and_split_hot_ones(frame, broadcast_bytes):
    many = frame([(None, 1), ("a", 2), ("a", 3), ("b", 4)], "k string, v int")
    lookup = frame([(None, 10), ("a", 20), ("z", 30)], "j string, w int")
    on = [("k", "j")]
    assert table(lookup_join(many, lookup, on, "left", broadcast_bytes=broadcast_bytes), "k", "v", "w") == [
        (None, 1, 10), ("a", 2, 20), ("a", 3, 20), ("b", 4, None)
    ]
    assert table(full_join(many, lookup, on, broadcast_bytes=broadcast_bytes), "k", "v", "w") == [
        (None, 1, 10), ("a", 2, 20), ("a", 3, 20), ("b", 4, None), ("z", None, 30)
    ]
    assert table(keep_all_lookup(many, lookup, on, broadcast_bytes=broadcast_bytes), "k", "v", "w") == [
        (None, 1, 10), ("a", 2, 20), ("a", 3, 20), ("z", None, 30)
    ]


def test_hot_keys_are_few_and_split(frame):
    from hearthmap.functions.joins import _hot_keys

    sizes = frame([("hot", 500), *[(f"k{i}", 1) for i in range(500)]], "k string, _n long")
    parts = 4 * int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    assert [tuple(r) for r in _hot_keys(sizes, ["k"]).collect()] == [("hot", -(-500 * parts // 1000))]
    many = frame([("hot", i) for i in range(300)] + [(f"k{i}", i) for i in range(50)], "k string, v int")
    lookup = frame([("hot", 1), *[(f"k{i}", 2) for i in range(40)]], "k string, w int")
    out = lookup_join(many, lookup, ["k"], broadcast_bytes=0)
    assert out.count() == 350
    assert out.groupBy("w").count().orderBy("w").collect() == [(None, 10), (1, 300), (2, 40)]


def test_group_totals(frame):
    df = frame([("a", 1.0), ("a", 2.0), (None, 5.0)], "k string, v double")
    out = group_totals(df, ["k"], {"t": nulls.strict_sum("v")}, broadcast_bytes=0)
    assert table(out, "k", "v", "t") == [(None, 5.0, 5.0), ("a", 1.0, 3.0), ("a", 2.0, 3.0)]


@pytest.mark.parametrize("slices", [None, 1, 7, 60])
def test_running_totals(frame, slices):
    rng = random.Random(3)
    rows = [(g, float(v), rng.randint(1, 9)) for g in ("a", "b", None) for v in rng.sample(range(500), 120)]
    out = running_totals(frame(rows, "g string, v double, n int"), "v", ["n"], ["g"], slices=slices)
    expected = [
        (g, v, sum(n for h, u, n in rows if h == g and u <= v), sum(n for h, _, n in rows if h == g))
        for g, v, _ in rows
    ]
    assert table(out, "g", "v", "cum_n", "all_n") == sorted(expected, key=lambda r: [(x is not None, x) for x in r])


@pytest.mark.parametrize("slices", [None, 1, 7, 60])
def test_exact_quantiles(frame, slices):
    rng = random.Random(5)
    # one group holds most rows and most of those share one value
    rows = [("hot", 7.0)] * 400 + [("hot", rng.random() * 20) for _ in range(150)] + [("b", rng.gauss(0, 1)) for _ in range(31)]
    rows += [("b", None), ("c", 4.0)]
    probs = {"p10": 0.1, "p25": 0.25, "p50": 0.5, "p99": 0.99, "p0": 0.0, "p100": 1.0}
    out = exact_quantiles(frame(rows, "g string, v double"), "v", probs, ["g"], slices)
    got = {r["g"]: r for r in out.collect()}
    for g in ("hot", "b", "c"):
        values = [v for h, v in rows if h == g and v is not None]
        for name, p in probs.items():
            assert got[g][name] == pytest.approx(np.quantile(values, p), abs=1e-12)
    alone = exact_quantiles(frame([(v,) for v in (1.0, 2.0, 3.0, 10.0)], "v double"), "v", {"a": 0.25, "b": 0.5, "c": 0.75}, slices=slices)
    assert tuple(alone.first()) == (1.75, 2.5, 4.75)


def test_many_groups_over_few_slices(frame):
    rng = random.Random(6)
    rows = [(g, float(rng.randrange(50))) for g in range(1500) for _ in range(rng.randint(1, 4))]
    out = exact_quantiles(frame(rows, "g int, v double"), "v", {"m": 0.5, "q": 0.3}, ["g"], 9).collect()
    assert len(out) == 1500
    for r in rng.sample(out, 200):
        values = [v for g, v in rows if g == r["g"]]
        assert (r["m"], r["q"]) == (pytest.approx(np.quantile(values, 0.5)), pytest.approx(np.quantile(values, 0.3)))


def test_slices_share_the_rows_of_one_group(frame, monkeypatch):
    """One group with many values is dealt out by order; no row carries a list of cuts."""
    from hearthmap.functions import ordered

    counts = frame([(float(v * 37 % 4001), 1) for v in range(4001)], "v double, n int")
    monkeypatch.setattr(ordered, "SLICE_BYTES", 1_000)
    dealt = ordered._sliced(counts, "v", [], None).groupBy("_slice").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    slices = sorted(dealt.collect(), key=lambda r: r["low"])
    assert len(slices) > 10 and max(r["n"] for r in slices) < 4001 / 4
    assert all(a["high"] < b["low"] for a, b in zip(slices, slices[1:]))
    out = running_totals(counts, "v", ["n"])
    assert "percentile" not in out._jdf.queryExecution().toString() and "array" not in out._jdf.queryExecution().toString()
    assert sorted((r["v"], r["cum_n"], r["all_n"]) for r in out.collect()) == [(float(i), i + 1, 4001) for i in range(4001)]


def test_tails():
    # published F table values at the 5 % point
    assert tails.f_upper_tail(4.964603, 1, 10) == pytest.approx(0.05, abs=1e-6)
    assert tails.f_upper_tail(3.098391, 3, 20) == pytest.approx(0.05, abs=1e-6)
    # for 2 numerator degrees of freedom the tail has a closed form
    assert tails.f_upper_tail(2.5, 2, 7.3) == pytest.approx((1 + 2 * 2.5 / 7.3) ** (-7.3 / 2), rel=1e-12)
    assert tails.f_upper_tail(None, 1, 2) is None
    assert tails.normal_two_sided(1.959963984540054) == pytest.approx(0.05, rel=1e-12)
    assert tails.beta_regularised(0.3, 2.0, 3.0) == pytest.approx(
        6 * 0.3**2 - 8 * 0.3**3 + 3 * 0.3**4, rel=1e-12
    )
    assert not math.isnan(tails.beta_regularised(0.5, 2000.0, 0.5))
