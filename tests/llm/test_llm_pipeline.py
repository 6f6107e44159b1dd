import re
import time
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from hearthmap.llm import mixing, vectors
from hearthmap.llm.scratch import Scratch
from hearthmap.session import shared_dir
from test_llm_dedup import brute_components, fold
from test_llm_text import ENCODING, RANKS

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


# vectors -----------------------------------------------------------------------------------------


def brute_vectors(rows, least):
    sound = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            sound.setdefault(i, []).append(np.array(v, float) / np.abs(v).max())
    links = Counter()
    root = {i: i for i, _ in rows if i is not None}
    pairs = []
    flat = [(i, v) for i, vs in sound.items() for v in vs]
    for x in range(len(flat)):
        for y in range(x + 1, len(flat)):
            (i, a), (j, b) = flat[x], flat[y]
            if len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= least:
                links[i] += 1
                links[j] += 1
                pairs.append((i, j))
    changed = True
    while changed:
        changed = False
        for i, j in pairs:
            low = min(root[i], root[j])
            changed |= root[i] != low or root[j] != low
            root[i] = root[j] = low
    return links, root


def check_vectors(spark, rows, least=0.9):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n long").repartition(3)
    links, root = brute_vectors([r[:2] for r in rows], least)
    result = vectors.near_vectors(df, least).collect()
    assert len(result) == len(rows)
    for r in result:
        i = r["vec_id"]
        assert (r["n_links"], r["component_id"]) == ((links[i], root[i]) if i is not None else (0, None))
        assert r["kept"] == (i == r["component_id"])


def vector_rows(rng):
    base = rng.normal(size=(40, 24))
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    rows += [(100 + i, (base[i % 7] * 3 + rng.normal(size=24) * 0.35).tolist()) for i in range(60)]
    rows += [(300 + i, base[3].tolist()) for i in range(30)]  # copies
    # a chain: neighbours are near, the ends are not
    rows += [(400 + i, [float(np.cos(i * 0.4)), float(np.sin(i * 0.4)), *[0.0] * 22]) for i in range(8)]
    return rows


def test_vectors_against_brute_force(spark, monkeypatch):
    rows = vector_rows(np.random.default_rng(3))
    rows += [(500, None), (501, []), (502, [0.0] * 24), (503, [float("nan")] * 24), (504, [None] * 24), (505, [float("inf")] * 24)]
    rows += [(506, [1.0, 2.0]), (507, [2.0, 4.0]), (None, rows[3][1]), (508, [1e200] * 24), (509, [1e-200] * 24), (510, [-1e200] * 24)]
    rows = [(i, v, 1) for i, v in rows]
    check_vectors(spark, rows)
    # many small tiles; only the driver-side packing sees the smaller bound in the same process
    parts = vectors.TILE_BYTES
    monkeypatch.setattr(vectors, "TILE_BYTES", 24 * 8 * 20)
    check_vectors(spark, rows, 0.8)
    assert parts != vectors.TILE_BYTES
    check_vectors(spark, [])


def test_products_stop_early_and_lose_nothing(monkeypatch):
    rng = np.random.default_rng(5)
    v = np.array([v for _, v in vector_rows(rng)])
    turn = np.linalg.eigh(vectors._unit(v).T @ vectors._unit(v))[1][:, ::-1]
    unit = vectors._unit(v)
    wanted = unit @ unit.T >= 0.9
    for leading, rows in [(4, 16), (16, 1024), (24, 7)]:
        monkeypatch.setattr(vectors, "LEADING", leading)
        monkeypatch.setattr(vectors, "ROWS_AT_ONCE", rows)
        found = vectors._close(v, v, turn, 0.9)
        off = ~np.eye(len(v), dtype=bool)
        assert (found == wanted)[off].all()


# pipeline ----------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def stages(spark):
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES:
        kept.append(scratch.write(stage(spark, kept[-1], SF)))
    return kept


def rows_of(df):
    return df.orderBy("doc_id").collect()


def test_stages_return_the_columns_of_documents(stages):
    for df in stages[1:-1]:
        assert df.dtypes == stages[0].dtypes


def test_clean_documents_pass_the_language_stage(stages):
    assert stages[1].count() == 200


def test_one_document_of_each_group_stays(stages):
    before, after = rows_of(stages[1]), rows_of(stages[2])
    _, roots = brute_components([(r["doc_id"], r["text"]) for r in before])
    assert [tuple(r) for r in after] == [tuple(r) for r in before if roots[r["doc_id"]] == r["doc_id"]]


def test_repeated_passages_are_gone(stages):
    before = {r["doc_id"]: r for r in rows_of(stages[2])}
    seen = set()
    for r in rows_of(stages[3]):
        w = fold(r["text"])
        grams = {tuple(w[k : k + 50]) for k in range(len(w) - 49)}
        assert not grams & seen
        seen |= grams
        assert r["n_chars"] == len(r["text"])
        old = iter(WORD.findall(before[r["doc_id"]]["text"]))
        assert all(x in old for x in WORD.findall(r["text"]))  # words are only taken away


def test_every_document_comes_as_often_as_the_mix_takes_it(spark, stages):
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(stages[3]).collect()}
    counts = Counter(r["doc_id"] for r in stages[4].collect())
    assert counts == {i: n for i, n in copies.items() if n}


def test_token_ids_of_the_pipeline(stages):
    texts = {r["doc_id"]: r["text"] for r in stages[4].collect()}
    rows = stages[5].collect()
    assert len(rows) == stages[4].count() and len(RANKS)
    for r in rows:
        assert r["token_ids"] == ENCODING.encode_ordinary(texts[r["doc_id"]])


def test_stages_of_odd_rows(spark):
    words = " ".join(f"k{i}" for i in range(90))
    rows = [
        (1, None, "en", "a", 0, 5), (2, "", None, None, 0, 5), (3, words, "en", "a", 3, 5), (3, words, "en", "a", 3, 5),
        (None, words, "de", None, 3, 5), (4, "12 34", "en", "b", 5, 5), (5, "own words. " + words.upper(), "fr", "b", 9, 5),
        (6, "so " * 30_000, "en", "hot", 1, 5), (7, "x" * 50_000, "de", "hot", 1, 5),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long, copies int"
    docs = spark.createDataFrame(rows, schema).withColumnRenamed("copies", "spans")
    for given in (docs, docs.limit(0)):
        current = given
        for name, stage in corpus_pipeline.STAGES[:-1]:
            result = Scratch(spark).write(stage(spark, current, SF))
            assert result.dtypes == given.dtypes, name
            current = result
        assert corpus_pipeline.token_ids(spark, current, SF).count() == current.count()
    kept = corpus_pipeline.near_duplicates(spark, docs, SF).collect()
    # the row without id is a copy of document 3
    assert sorted(r["doc_id"] for r in kept) == [1, 2, 3, 4, 6, 7]


def test_rows_that_share_an_id_are_judged_by_their_texts(spark):
    one, two = (" ".join(f"{c}{i}" for i in range(120)) for c in "kq")
    rows = [(7, one, "en", "a", 5), (7, two, "en", "a", 5), (None, two + " end", "en", "a", 5), (None, "alone here", "en", "a", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept.collect()) == [(0, "alone here"), (7, one), (7, two)]
    shared = spark.createDataFrame([(7, one, 1), (7, "own start " + two, 1), (None, one[:700] + " own end", 1)], "doc_id long, text string, n_chars long")
    cut = {(r["doc_id"], r["text"]) for r in corpus_pipeline.repeated_passages(spark, shared, SF).collect()}
    # what the second row with id 7 holds is its own; the row without id loses what the first holds
    assert (7, one) in cut and (7, "own start " + two) in cut and len(cut) == 3
    assert all(len(t.split()) < 10 for i, t in cut if i is None)


def test_stages_leave_no_copy_of_the_texts(spark):
    """Where every row has an id of its own, what a stage leaves on disk holds neither texts nor signatures."""
    before = {p.name for p in Path(shared_dir(spark).removeprefix("file:")).iterdir()}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for stage in (corpus_pipeline.near_duplicates, corpus_pipeline.repeated_passages):
        assert stage(spark, docs, SF).count()
    left = [p for p in Path(shared_dir(spark).removeprefix("file:")).iterdir() if p.name not in before]
    assert left and not {c for p in left for c in spark.read.parquet(str(p)).columns} & {"text", "minima", "bands"}


def test_shuffle_files_go_with_their_query(spark):
    def shuffles():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ")
        return set(re.findall(r"shuffle_(\d+)_", files))

    before = shuffles()
    Scratch(spark).write(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    until = time.time() + 20
    while shuffles() - before and time.time() < until:
        time.sleep(0.1)
    assert not shuffles() - before


def test_clean_texts_in_several_languages_stay(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    clean = docs.where("n_chars between 800 and 4000 and lang is not null").toPandas()
    parts = {lang: [" ".join(WORD.findall(t)[:60]) for t in clean[clean.lang == lang].text[:6]] for lang in sorted(set(clean.lang))}
    mixed = [" ".join(p) for p in zip(*parts.values())]
    assert len(parts) >= 3 and len(mixed) >= 4
    more = spark.createDataFrame([(10**6 + i, t, None, "mixed", len(t)) for i, t in enumerate(mixed)], docs.schema)
    odd = spark.createDataFrame([(10**7, "12 34 .", None, "mixed", 7)], docs.schema)
    kept = corpus_pipeline.language(spark, docs.unionByName(more).unionByName(odd), SF)
    assert kept.where("source = 'mixed'").count() == len(mixed)


def test_run_equals_its_stages(spark, stages):
    rows = corpus_pipeline.run(spark, SF).select("doc_id", "ids_sha256").collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, stages[5].select("doc_id", "ids_sha256").collect()))
