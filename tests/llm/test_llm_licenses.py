import random
import re

import pytest

from hearthmap.llm import licenses, queries

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
RULES = licenses.build_rules()
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words_of(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(text):
    """All rules on the whole word string, no gate; overlaps resolved by comparing with all taken ones."""
    words = words_of(text)
    joined = "".join(w + " " for w in words)
    found = []
    for i, rule in enumerate(RULES):
        for m in re.finditer(rf"(?<![^ ])(?:{rule.expression})(?= )", joined):
            if m.end() > m.start():
                found.append((i, joined[: m.start()].count(" "), joined[: m.end()].count(" "), m.start(), m.end()))
    taken = []
    for d in sorted(found, key=lambda d: (RULES[d[0]].priority, d[3] - d[4], d[3], d[0])):
        if RULES[d[0]].priority == 0 or not any(t[3] <= d[3] and d[4] <= t[4] for t in taken):
            taken.append(d)
    detections = sorted((RULES[i].name, a, b) for i, a, b, _, _ in taken)
    labels = sorted({RULES[d[0]].label for d in taken})
    return len(words), detections, ",".join(labels), max([RULES[d[0]].score for d in taken], default=0.0)


def base_of(text):
    words = words_of(text)
    places, labels = [], set()
    for phrase, label in (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")):
        wanted = phrase.split()
        for i in range(len(words) - len(wanted) + 1):
            if words[i : i + len(wanted)] == wanted:
                places.append(i)
                labels.add(label)
    return len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def check(df):
    scanned = licenses.scan(df)
    details = [(r["doc_id"], sorted((d["rule"], d["first_word"], d["last_word"]) for d in r["detections"])) for r in scanned.collect()]
    figures = licenses.summary(scanned).collect()
    texts = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    key = lambda x: (x[0] is not None, x)
    assert sorted(details, key=key) == sorted(((i, brute(t)[1]) for i, t in texts), key=key)
    mine = [
        tuple(r[c] for c in ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"))
        for r in figures
    ]
    wanted = [(i, brute(t)[0], *base_of(t), *brute(t)[2:]) for i, t in texts]
    assert sorted(mine, key=repr) == sorted(wanted, key=repr)
    return {r["doc_id"]: r for r in figures}


ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "MIT"), (5, "Released UNDER the-MIT\nLicense. Under the MIT license!"), (6, "z" * 30_000),
    (7, "cc by nc " * 3_000), (8, "Ünï 漢字 licensed under CC BY-NC 4.0. 🙂"), (9, "Apache License, Version 2.0"), (9, "Apache License, Version 2.0"),
    (None, "Licensed under the Apache License, Version 2.0."), (10, "mit dem license under"), (11, "xmit license"), (12, "under the mit licenseé"),
    (13, "SPDX-License-Identifier: GPL-3.0-or-later"), (14, "the GNU Lesser General Public Licence v3"), (15, "All rights reserved. In the public domain"),
]


def test_odd_rows(spark):
    df = spark.createDataFrame(ODD, SCHEMA).repartition(3)
    found = check(df)
    assert found[5]["n_base"] == 2 and found[5]["first_word"] == 1 and found[5]["base_labels"] == "mit"
    assert found[13]["labels"] == "gpl-3" and found[14]["labels"] == "lgpl-3"
    assert found[8]["labels"] == "cc-by-nc" and found[12]["n_base"] == 0
    assert found[10]["labels"] == "" and found[15]["labels"] == "proprietary,public-domain"
    check(df.limit(0))


def test_places_in_the_text(spark):
    text = "Ünï 漢字 — Licensed under CC BY-NC 4.0. Öh"
    row = licenses.scan(spark.createDataFrame([(1, text, "x")], "doc_id int, text string, n_words string")).first()
    spans = {d["rule"].split(":")[0]: text[d["char_start"] : d["char_end"]] for d in row["detections"]}
    assert spans == {"base": "CC BY-NC", "grant": "Licensed under CC BY-NC 4.0"}
    assert row["n_suppressed"] > 0


def test_every_rule_matches_what_its_keywords_let_through():
    assert len(RULES) > 300 and len({r.name for r in RULES}) == len(RULES)
    scanner = licenses.Scanner(RULES)
    rng = random.Random(4)
    for i, rule in enumerate(RULES):
        for _ in range(6):
            sample = example(rule.expression, rng)
            if not re.search(rf"(?<![^ ])(?:{rule.expression})(?= )", sample + " "):
                continue
            present = {licenses._SPELLINGS.get(w, w) for w in sample.split()}
            assert i in scanner.gated(present), (rule.name, sample)


def example(expression, rng):
    """A random string that the expression matches."""
    from re import _parser as parser

    def build(parts):
        out = ""
        for op, value in parts:
            op = str(op)
            if op == "LITERAL":
                out += chr(value)
            elif op == "IN":
                kind, v = rng.choice(value)
                out += chr(rng.randint(*v)) if str(kind) == "RANGE" else chr(v) if str(kind) == "LITERAL" else "x"
            elif op == "NOT_LITERAL":
                out += "x"
            elif op == "BRANCH":
                out += build(rng.choice(value[1]))
            elif op == "SUBPATTERN":
                out += build(value[-1])
            elif op == "MAX_REPEAT":
                low, high, body = value
                out += "".join(build(body) for _ in range(rng.randint(low, min(high, low + 2))))
            else:
                raise AssertionError(op)
        return out

    return build(parser.parse(expression))


def test_random_texts_of_license_words(spark):
    rng = random.Random(8)
    pool = [example(r.expression, rng) for r in rng.sample(RULES, 60)] + ["the", "under", "mit", "license", "cc by", "gpl", "x."] * 6
    rows = [(i, " ".join(rng.choice(pool) for _ in range(rng.randint(1, 14)))) for i in range(80)]
    check(spark.createDataFrame(rows, SCHEMA))


def test_query_on_the_given_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = check(docs)
    rows = queries.op11_license_scan(spark, SF).collect()
    assert {r["doc_id"]: r for r in rows} == found and len(rows) == docs.count()
    assert any(r["n_base"] for r in rows) and all(0 <= r["score"] <= 1 for r in rows)


def test_cover_keeps_the_widest_intervals():
    rng = random.Random(5)
    for _ in range(200):
        cover, seen = licenses._Cover(), []
        for _ in range(12):
            a = rng.randrange(20)
            b = a + rng.randrange(1, 8)
            assert cover.holds(a, b) == any(x <= a and b <= y for x, y in seen)
            cover.add(a, b)
            seen.append((a, b))


@pytest.mark.parametrize("phrase", licenses.BASE_PHRASES)
def test_base_phrases_are_never_suppressed(phrase):
    scanner = licenses.default_scanner()
    text = f"licensed under the terms of the {phrase} 4 0 "
    present = {licenses._SPELLINGS.get(w, w) for w in text.split()}
    kept, _ = scanner.resolve(scanner.find(text.encode(), present))
    assert any(scanner.rules[i].name.startswith("base:") for i, *_ in kept)
