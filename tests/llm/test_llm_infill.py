import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
import regex
from hypothesis import given, settings, strategies as st

from hearthmap.llm import infill, queries
from hearthmap.llm.words import raw

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string"
PIECES = {
    "char": regex.compile(r"(?s)."),
    "word": regex.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+[\x20\x09-\x0D]*|[\x20\x09-\x0D]+"),
    "line": regex.compile(r"[^\n]*\n|[^\n]+"),
}


def brute_units(text, unit):
    """Units of a text; a word takes the blanks after it, the first word those before it as well."""
    return PIECES[unit].findall(text)


def brute(doc_id, text, unit="char"):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    units = brute_units(text, unit)
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return (doc_id, n, "plain", None, None, text)
    if h4 % 100 < 20:
        return (doc_id, n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}")
    return (doc_id, n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}")


ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "a"), (5, "\x1c\x85  x\x00y"), (6, "z" * 30_000), (7, "so so " * 20_000),
    (8, "Ünï 漢字 🙂🙂\r\n👩‍👩‍👧 ña"), (9, "12 34 | $"), (9, "12 34 | $"), (None, "no id here."), (10, "\n\n\nline.\nline.\n"),
    (11, "has <S> inside"), (12, "<P"), (13, "<<S"), (14, "S><M"), (15, "é" * 513), (16, "漢" * 1024), (-3, "x" * 512), (17, "<P>"),
]


def rows(df):
    return sorted(map(tuple, df.collect()), key=lambda r: (r[0] is not None, r[0], r[5]))


@pytest.mark.parametrize("unit", infill.UNITS)
def test_odd_rows_against_brute_force(spark, unit):
    df = spark.createDataFrame(ODD, SCHEMA).repartition(3)
    wanted = sorted((brute(*r, unit) for r in ODD), key=lambda r: (r[0] is not None, r[0], r[5]))
    assert rows(infill.fill_in_middle(df, unit)) == wanted
    assert infill.fill_in_middle(df.limit(0), unit).collect() == []


def test_clashing_columns_do_not_matter(spark):
    df = spark.createDataFrame([(1, "ab", "x", 7)], "doc_id int, text string, output string, h1 long")
    assert rows(infill.fill_in_middle(df)) == [brute(1, "ab")]
    with pytest.raises(ValueError):
        infill.fill_in_middle(df, "page")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="a é\n漢🙂\t", max_size=40), min_size=1, max_size=6), st.sampled_from(infill.UNITS), st.integers(1, 9))
def test_every_cut_of_random_texts(texts, unit, block):
    held, infill.BLOCK = infill.BLOCK, block
    try:
        data, bounds = raw(pa.array(texts))
        cutter = infill.Cutter(data, bounds, unit)
        for i, text in enumerate(texts):
            units = brute_units(text, unit)
            assert cutter.n_units[i] == len(units)
            cuts = np.arange(len(units) + 1)
            place, chars = cutter.cut(np.full(len(cuts), i), cuts)
            for u in cuts:
                before = "".join(units[:u])
                assert (place[u] - bounds[i], chars[u]) == (len(before.encode()), len(before))
    finally:
        infill.BLOCK = held


def test_fenwick_tree():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 7, 8, 9, 100):
        counts = rng.integers(0, 4, n)
        tree = infill.Fenwick(counts)
        assert tree.before(np.arange(n + 1)).tolist() == np.concatenate([[0], np.cumsum(counts)]).tolist()
        owner = np.repeat(np.arange(n), counts)
        block, left = tree.descend(np.arange(counts.sum()))
        assert block.tolist() == owner.tolist()
        assert left.tolist() == [int(np.sum(owner[:i] == o)) for i, o in enumerate(owner)]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet="<>PSM a", max_size=12), min_size=1, max_size=30))
def test_outputs_can_be_taken_apart(spark, texts):
    df = spark.createDataFrame([(random.Random(i).randrange(1000), t) for i, t in enumerate(texts)], SCHEMA)
    made = infill.fill_in_middle(df).withColumn("back", infill.restored(infill.F.col("output"), infill.F.col("form")))
    assert sorted(r["back"] for r in made.collect()) == sorted(texts)


def test_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    found = {r["doc_id"]: r for r in queries.op12_fill_in_middle(spark, SF).collect()}
    assert len(found) == len(docs)
    for d in docs:
        doc_id, n, form, prefix, middle, output = brute(d["doc_id"], d["text"])
        r = found[doc_id]
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"]) == (n, form, prefix, middle)
        assert r["output_sha256"] == hashlib.sha256(output.encode()).hexdigest()
        assert r["restored_sha256"] == hashlib.sha256((d["text"] or "").encode()).hexdigest()
    assert {r["form"] for r in found.values()} == {"plain", "psm", "spm"}
