import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

from hearthmap.llm import near, substrings
from hearthmap.llm.components import components
from hearthmap.llm.scratch import Scratch

SF = "/root/testdata/sf0.001"


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()


def shingles(text):
    w = fold(text)
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def union_find(nodes, links):
    parent = {n: n for n in nodes}

    def top(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        parent[b] = a
    return {n: top(n) for n in nodes}


def brute_components(rows):
    sets = {}
    for i, t in rows:
        if i is not None:
            sets[i] = shingles(t)
    links = []
    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 75 * len(x | y):
            links.append((a, b))
    return {i: len(s) for i, s in sets.items()}, union_find(sets, links)


def check_near(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    result = near.near_duplicates(df).collect()
    sizes, roots = brute_components(rows)
    assert sorted(r["doc_id"] for r in result if r["doc_id"] is not None) == sorted(i for i, _ in rows if i is not None)
    for r in result:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
            continue
        assert r["n_shingles"] == sizes[r["doc_id"]]
        assert r["component_id"] == roots[r["doc_id"]]
        assert r["kept"] == (r["doc_id"] == r["component_id"])


def variant(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def test_components_of_random_graphs(spark):
    rng = random.Random(3)
    for n, m in [(30, 20), (40, 60), (200, 150)]:
        links = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
        found = components(spark.createDataFrame(links, "a long, b long"), Scratch(spark)).collect()
        real = [(a, b) for a, b in links if a != b]
        wanted = union_find({x for l in real for x in l}, real)
        assert {r["node"]: r["root"] for r in found} == wanted and len(found) == len(wanted)


def test_components_of_a_long_path_and_of_nothing(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(100)], "a long, b long")
    assert {r["root"] for r in components(path, Scratch(spark)).collect()} == {0}
    assert components(path.where("a < 0"), Scratch(spark)).collect() == []


def test_near_duplicates_on_the_given_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    check_near(spark, [tuple(r) for r in docs.collect()])


def test_near_duplicates_of_groups_and_odd_rows(spark):
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(3000)}"
    base = [word() for _ in range(120)]
    rows = [(100 + i, variant(rng, base, rng.randrange(1, 8))) for i in range(60)]
    rows += [(300 + i, " ".join(base).upper()) for i in range(20)]
    # documents that share half of their text with many, but are no near-duplicates
    rows += [(400 + i, " ".join(base[:60] + [word() for _ in range(60)])) for i in range(15)]
    # a chain: neighbours are near, the ends are not
    chain = [word() for _ in range(80)]
    for i in range(12):
        rows.append((500 + i, " ".join(chain)))
        chain = chain[3:] + [word() for _ in range(3)]
    rows += [(600, None), (601, ""), (602, " \n\t"), (603, "a b"), (604, "A  b"), (605, "a b c"), (606, "a b c d e")]
    rows += [(None, " ".join(base)), (300, " ".join(base).upper()), (607, "x " * 20_000), (608, "X " * 9_000)]
    check_near(spark, rows)


def test_near_duplicates_of_copies_changed_apart(spark):
    rng = random.Random(9)
    base = [f"w{i}" for i in range(100)]
    few = lambda words, edits: " ".join(
        f"n{rng.randrange(3)}" if i in edits else w for i, w in enumerate(words)
    )
    rows = [(i, few(base, rng.sample(range(100), rng.randrange(2, 9)))) for i in range(120)]
    # copies of changed copies are near each other, not the first original
    for start in (200, 300):
        changed = variant(rng, base, 7).split()
        rows += [(start + i, few(changed, rng.sample(range(100), rng.randrange(1, 5)))) for i in range(40)]
    check_near(spark, rows)


def test_near_duplicates_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string, key string, band long")
    assert near.near_duplicates(none).collect() == []


def spans_of(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return [tuple(r) for r in substrings.repeated_passages(df).collect()]


def test_every_exact_passage_is_found(spark):
    rng = random.Random(5)
    fresh = itertools.count()
    words = lambda n: [f"u{next(fresh)}" for _ in range(n)]
    passages = [words(n) for n in (50, 51, 55, 70, 120, 400)]
    rows, wanted = [], {}
    for p, passage in enumerate(passages):
        for k in range(6):
            before = words(rng.randrange(0, 150))
            doc = 100 * p + k
            rows.append((doc, " ".join(before + passage + words(rng.randrange(0, 150)))))
            wanted[doc] = (len(before), len(before) + len(passage))
    rows += [(900, " ".join(words(300))), (901, None), (902, ""), (None, rows[0][1]), (903, "y " * 5000)]
    found = spans_of(spark, rows)
    later = {d for d in wanted if d % 100}
    assert {(d, d // 100 * 100, *wanted[d]) for d in later} == set(found)


def test_shorter_repeats_stay_and_near_passages_go(spark):
    rng = random.Random(6)
    fresh = itertools.count()
    words = lambda n: [f"u{next(fresh)}" for _ in range(n)]
    short, long = words(40), words(200)
    edited = list(long)
    edited[50], edited[150] = "x1", "x2"
    rows = [(1, " ".join(words(60) + short + words(60))), (2, " ".join(words(60) + short + words(60)))]
    rows += [(3, " ".join(words(30) + long)), (4, " ".join(words(90) + edited + words(9)))]
    assert {(d, f) for d, f, _, _ in spans_of(spark, rows)} == {(4, 3)}
    (_, _, a, b), = spans_of(spark, rows)
    assert (a, b) == (90, 290)


def test_verified_passages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = sorted(tuple(r) for r in docs.collect())
    lists = {i: [tuple(fold(t)[k : k + 5]) for k in range(len(fold(t)) - 4)] for i, t in rows}
    covered = {}
    for d, first, a, b in spans_of(spark, rows):
        assert first < d and b - a >= 5
        here = lists[d][a : b - 4]
        assert here[0] in set(lists[first]) and here[-1] in set(lists[first])
        covered.setdefault(d, set()).update(range(a, b))
    # every exact passage of 50 words of an earlier document is inside a span
    seen = set()
    for i, _ in rows:
        grams = [tuple(lists[i][k : k + 46]) for k in range(len(lists[i]) - 45)]
        for k, g in enumerate(grams):
            if g in seen:
                assert set(range(k, k + 50)) <= covered.get(i, set()), (i, k)
        seen.update(grams)


def test_near_starts_against_brute_force():
    rng = np.random.default_rng(11)
    width = substrings.WIDTH

    def similar(a, b):
        return 100 * len(a & b) >= 75 * len(a | b)

    for kinds in (3, 20, 60, 10**6):
        base = rng.integers(0, kinds, 140).astype(np.uint64)
        for edits in (0, 2, 5, 12):
            own, other = base.copy(), np.concatenate([base[70:], rng.integers(0, kinds, 9).astype(np.uint64), base[:80]])
            own[rng.integers(0, len(own), edits)] = rng.integers(0, 10**9, edits)
            starts = np.arange(len(own) - width + 1)
            sets = [set(other[j : j + width].tolist()) for j in range(len(other) - width + 1)]
            wanted = [i for i in starts if any(similar(set(own[i : i + width].tolist()), b) for b in sets)]
            assert substrings._near_starts(own, other, np.isin(own, other), starts).tolist() == wanted


def test_a_lead_of_many_pairs_is_cut_into_shingles_once(monkeypatch):
    lead = " ".join(f"w{i}" for i in range(400))
    own = [f"start{k} " + lead[: 900 + k] for k in range(60)]
    none = pa.nulls(len(own), pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())])))
    columns = [pa.array(range(1, 61)), pa.array([0] * 60), pa.array(own), pa.array([lead] * 60), none]
    batch = pa.RecordBatch.from_arrays(columns, ["doc_id", "lead", "text", "lead_text", "closed"])
    seen, inner = [], substrings._shingles
    monkeypatch.setattr(substrings, "_shingles", lambda column: (seen.extend(column.to_pylist()), inner(column))[1])
    found = [r for rows in substrings._verify([batch]) for r in rows.to_pylist()]
    assert [r["doc_id"] for r in found] == list(range(1, 61))
    assert seen.count(lead) == 1 and len(seen) == 61


def test_a_passage_must_be_near_one_passage_of_the_lead(spark):
    fresh = itertools.count()
    words = lambda n: [f"u{next(fresh)}" for _ in range(n)]
    a, b = words(25), words(25)
    rows = [(1, " ".join(a + words(300) + b)), (2, " ".join(words(9) + a + b + words(9)))]
    rows += [(3, " ".join(words(50) + ["y"] * 5 + words(50))), (4, "y " * 50)]
    assert spans_of(spark, rows) == []


def test_the_source_is_found_behind_earlier_documents(spark):
    rng = random.Random(12)
    fresh = itertools.count()
    words = lambda n: [f"u{next(fresh)}" for _ in range(n)]
    lines = [words(26) for _ in range(6)]
    # 60 earlier documents hold the lines one by one, only then comes one with the whole passage
    rows = [(10 * k + i, " ".join(words(40) + line + words(40))) for k in range(10) for i, line in enumerate(lines)]
    passage = [w for line in lines for w in line]
    worse = [f"x{i}" if i % 13 == 0 else w for i, w in enumerate(passage)]
    rows += [(400, " ".join(worse)), (500, " ".join(words(9) + passage)), (600, " ".join(passage + words(9)))]
    found = spans_of(spark, rows)
    assert [(d, f, a, b) for d, f, a, b in found if d == 600] == [(600, 500, 0, 156)]
    assert {d for d, _, _, _ in found} == {600}


def test_short_passages_at_the_threshold_are_found(spark):
    rng = random.Random(13)
    fresh = itertools.count()
    words = lambda n: [f"u{next(fresh)}" for _ in range(n)]
    rows = []
    for k in range(300):
        passage = words(50)
        changed = list(passage)
        changed[rng.randrange(50)] = "x"  # one word of 50: five shingles of 46 at most
        rows.append((2 * k, " ".join(words(30) + passage + words(30))))
        rows.append((2 * k + 1, " ".join(words(30) + changed + words(30))))
    assert {(d, f) for d, f, _, _ in spans_of(spark, rows)} == {(2 * k + 1, 2 * k) for k in range(300)}


def test_documents_that_share_one_line_are_not_paired_out(spark, monkeypatch):
    fresh = itertools.count()
    words = lambda n: [f"u{next(fresh)}" for _ in range(n)]
    line, size, compared = words(28), 400, []
    rows = [(k, " ".join(words(60) + line + words(60))) for k in range(size)]
    inner = substrings._compared

    def counted(pairs, *rest):
        compared.append(pairs.count())
        return inner(pairs, *rest)

    monkeypatch.setattr(substrings, "_compared", counted)
    assert spans_of(spark, rows) == []
    assert sum(compared) <= 3 * size


@pytest.mark.parametrize("kinds", [10**9, 12])
def test_copies_changed_apart_are_not_paired_out(spark, monkeypatch, kinds):
    rng = random.Random(14)
    base, size, compared, rows = [f"u{i}" for i in range(150)], 300, [], []
    for k in range(size):
        words = list(base)
        # two words of any 50: too few shingles are left, though other copies may hold the changed ones
        for p in range(rng.randrange(24), 150, 24):
            words[p] = f"v{p}.{rng.randrange(kinds)}"
        rows.append((k, " ".join(words)))
    inner = substrings._compared

    def counted(pairs, *rest):
        compared.append(pairs.count())
        return inner(pairs, *rest)

    monkeypatch.setattr(substrings, "_compared", counted)
    covered = {}
    for d, _, a, b in spans_of(spark, rows):
        covered.setdefault(d, set()).update(range(a, b))
    texts = [substrings._shingles(pa.array([t]))[0] for _, t in rows]
    starts = np.arange(len(texts[0]) - substrings.WIDTH + 1)
    wanted = hit = 0
    for i, own in enumerate(texts):
        near_any = set()
        for other in texts[:i]:
            near_any.update(substrings._near_starts(own, other, np.isin(own, other), starts).tolist())
        wanted += len(near_any)
        hit += sum(len(covered.get(i, set()) & set(range(s, s + 50))) >= 38 for s in near_any)
    assert hit >= 0.99 * wanted and (wanted > 0) == (kinds == 12)
    assert sum(compared) <= 12 * size


def test_a_shingle_of_a_passage_is_one_row_however_often_it_comes():
    texts, over = ["to " * 500, " ".join(f"w{i}" for i in range(60))], [[45 << 6] * 3, [10 << 6] * 3]
    columns = [pa.array([1, 2]), pa.array(texts), pa.array(over, pa.list_(pa.int64()))]
    batch = pa.RecordBatch.from_arrays(columns, ["doc_id", "text", "places"])
    rows = [r for found in substrings._passages([batch]) for r in found.to_pylist()]
    assert [(r["at"], r["plain"], r["folded"]) for r in rows if r["doc_id"] == 1] == [(list(range(91)), False, True)]
    assert sorted((r["at"], r["plain"], r["folded"]) for r in rows if r["doc_id"] == 2) == [([i], True, False) for i in range(56)]


def test_near_passages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = sorted(tuple(r) for r in docs.collect())
    covered = {}
    for d, _, a, b in spans_of(spark, rows):
        covered.setdefault(d, set()).update(range(a, b))
    sequence, first, _ = substrings._shingles(pa.array([t for _, t in rows], pa.string()))
    texts = [sequence[a:b] for a, b in zip(first, first[1:])]
    wanted = hit = 0
    for i, (doc, _) in enumerate(rows):
        starts = np.arange(max(0, len(texts[i]) - substrings.WIDTH + 1))
        near_any = set()
        for j in range(i):
            common = np.isin(texts[i], texts[j])
            if common.sum() >= 30:
                near_any.update(substrings._near_starts(texts[i], texts[j], common, starts).tolist())
        wanted += len(near_any)
        # a passage is cut when the words between its first and last common shingle are
        hit += sum(len(covered.get(doc, set()) & set(range(s, s + 50))) >= 38 for s in near_any)
    assert wanted > 0 and hit >= 0.99 * wanted, (hit, wanted)


def test_passages_are_cut_out(spark):
    words = [f"k{i}" for i in range(80)]
    rows = [(1, "start\n" + " ".join(words), 7), (2, "Own  text\n" + " ".join(words).upper() + "\nits end", 8), (3, None, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans int")
    result = {r["doc_id"]: (r["text"], r["spans"]) for r in substrings.without_repeats(docs).collect()}
    assert result == {1: (rows[0][1], 7), 2: ("Own  text\nits end", 8), 3: (None, 9)}


@pytest.mark.parametrize("schema", ["doc_id long, text string, key long, lead long, place long"])
def test_no_passages_of_nothing(spark, schema):
    none = spark.createDataFrame([], schema)
    assert substrings.repeated_passages(none).collect() == []
    assert substrings.without_repeats(none).columns == none.columns


def test_signatures_estimate_the_similarity():
    x = np.unique(np.random.default_rng(0).integers(0, 2**63, 3000, np.uint64))
    a, b = x[:2000], x[500:2500]
    low = near._minima(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
    assert abs((low[0] == low[1]).mean() - 1500 / 2500) < 0.15
