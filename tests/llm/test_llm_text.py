import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import tiktoken
from hypothesis import given, settings, strategies as st

from hearthmap.llm import attribution, bpe, langid, lines, mixing, preferences, queries, urls

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
RANKS = bpe.read_ranks(public_tokenizers.path(queries.RANK_FILE))
ENCODING = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "a"), (5, "\x1c\x85  x"), (6, "z" * 30_000), (7, "so so " * 20_000),
    (8, "Ünï 漢字 🙂🙂\r\n👩‍👩‍👧 ña"), (9, "12 34 | $"), (9, "12 34 | $"), (None, "no id here."), (10, "\n\n\nline.\nline.\n"),
]
ODD_SCHEMA = "doc_id long, text string"


def odd(spark):
    return spark.createDataFrame(ODD, ODD_SCHEMA).repartition(2)


def given_docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# language ----------------------------------------------------------------------------------------


def test_language_of_held_out_documents(spark):
    rows = queries.op1_language_id(spark, "/root/testdata/sf0.01").toPandas()
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").toPandas()
    merged = rows.merge(docs, on="doc_id")
    held = merged[merged.held_out]
    assert len(rows) == len(docs) and 0.2 < len(held) / len(rows) < 0.45
    assert (held.lang_pred == held.lang).mean() > 0.98
    assert rows.score.between(0, 1).all()


def small_model(spark):
    return langid.train(given_docs(spark).select("text", "lang"))


def test_language_of_odd_rows(spark):
    model = small_model(spark)
    result = {(r["doc_id"], r["text"]): r for r in langid.identify(odd(spark), model).collect()}
    for i, t in ODD:
        known = bool(t and regex.search(r"\p{L}", t))
        r = result[(i, t)]
        assert (r["lang_pred"] != "und") == known
        assert 0 <= r["score"] <= 1 and (known or r["score"] == 0)
    assert langid.identify(odd(spark).limit(0), model).collect() == []


def test_no_labels_no_language(spark):
    model = langid.train(spark.createDataFrame([("x y", None)], "text string, lang string"))
    assert {r["lang_pred"] for r in langid.identify(odd(spark), model).collect()} == {"und"}


def test_code_switching_is_found_word_by_word(spark):
    model = small_model(spark)
    docs = given_docs(spark).toPandas()
    clean = docs[~docs.text.str.contains(r"[#$%&|!]")]
    en = clean[clean.lang == "en"].text.iloc[3].split()[:40]
    de = clean[clean.lang == "de"].text.iloc[3].split()[:40]
    batch = pa.RecordBatch.from_arrays([pa.array([" ".join(en + de)])], ["text"])
    data, bounds = langid.raw(batch.column(0))
    data = langid.lower_ascii(data)
    words = langid.find_words(data, bounds)
    scores = langid._emissions(langid._features(data, words.start, words.end), model.weights)
    best = langid._Chains(np.array([80])).posterior(scores, model.switch).argmax(1)
    wanted = [model.labels.index("en")] * 40 + [model.labels.index("de")] * 40
    assert (best == wanted).mean() > 0.9


def test_forward_backward_against_all_label_sequences():
    rng = np.random.default_rng(1)
    counts = np.array([3, 0, 5, 1])
    scores, switch = rng.normal(size=(9, 3)), rng.normal(size=(3, 3))
    pairs = np.zeros((3, 3))
    mine = langid._Chains(counts).posterior(scores, switch, pairs)
    at, wanted, wanted_pairs = 0, np.zeros((9, 3)), np.zeros((3, 3))
    for n in counts:
        total, single, double = 0.0, np.zeros((n, 3)), np.zeros((3, 3))
        for path in np.ndindex(*[3] * n):
            p = math.exp(sum(scores[at + i, l] for i, l in enumerate(path)) + sum(switch[a, b] for a, b in zip(path, path[1:])))
            total += p
            for i, l in enumerate(path):
                single[i, l] += p
            for a, b in zip(path, path[1:]):
                double[a, b] += p
        if n:
            wanted[at : at + n] = single / total
            wanted_pairs += double / total
        at += n
    assert np.allclose(mine, wanted) and np.allclose(pairs, wanted_pairs)


# lines -------------------------------------------------------------------------------------------


def brute_lines(text):
    words = WORD.findall(text or "")
    seen, dup, lost = set(), 0, 0
    for line in (text or "").split("\n"):
        here = WORD.findall(line)
        if not here:
            continue
        dup += line in seen
        seen.add(line)
        symbols = sum(c in "#*$%&|<>" for c in line)
        failed = not here[-1].endswith(lines.CLOSING)
        failed |= 100 * symbols > lines.SYMBOL_PERCENT * len(line)
        failed |= 100 * sum(w.endswith("!!") for w in here) > lines.SHOUT_PERCENT * len(here)
        failed |= sum(w in lines.SEPARATOR_WORDS for w in here) >= lines.NAVIGATION_MARKS
        failed |= any(p in line.lower() for p in lines.BOILERPLATE)
        lost += failed * len(here)
    grams = Counter(zip(words, words[1:], words[2:]))
    marked = set()
    for i in range(len(words) - 2):
        if grams[tuple(words[i : i + 3])] > 1:
            marked |= {i, i + 1, i + 2}
    base = len(words) < 50 or 100 * len(marked) > 50 * len(words)
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(marked), base,
        not base and 100 * lost <= lines.LOST_PERCENT * len(words), lost,
    )


def check_lines(df):
    texts = {r["doc_id"]: r["text"] for r in df.collect()}
    result = lines.clean_lines(df).collect()
    assert sorted(map(str, (r["doc_id"] for r in result))) == sorted(str(r["doc_id"]) for r in df.collect())
    for r in result:
        mine = tuple(r[c] for c in "n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept n_lost_words".split())
        assert mine == brute_lines(texts[r["doc_id"]]), r["doc_id"]


def test_line_rules_on_the_given_documents(spark):
    check_lines(given_docs(spark))


def test_line_rules_on_odd_rows(spark):
    check_lines(odd(spark))
    check_lines(odd(spark).limit(0))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab. \n\t!|#é”\x85", max_size=60), min_size=1, max_size=6))
def test_line_rules_on_random_texts(texts):
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    for r, t in zip(lines._judge(batch).to_pylist(), texts):
        mine = tuple(r[c] for c in "n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept n_lost_words".split())
        assert mine == brute_lines(t)


def test_cleaned_text_has_the_lines_kept(spark):
    text = "Good line here.\nHome | About | Contact\n\nAll rights reserved.\nno end\nLast one!"
    df = spark.createDataFrame([(1, text)], ODD_SCHEMA)
    assert lines.clean_lines(df).first()["cleaned"] == "Good line here.\n\nLast one!"


# tokens ------------------------------------------------------------------------------------------


def check_tokens(spark, df):
    coded = bpe.encode(df.select("doc_id", "text"), RANKS, public_tokenizers.PATTERN)
    rows = bpe.decode(coded, RANKS).collect()
    for r in rows:
        text = r["text"] or ""
        assert r["token_ids"] == ENCODING.encode_ordinary(text)
        assert bytes(r["decoded"]) == text.encode()
    return rows


def test_ids_are_those_of_the_library(spark):
    assert len(check_tokens(spark, given_docs(spark))) == 200


def test_ids_of_odd_rows(spark):
    assert len(check_tokens(spark, odd(spark))) == len(ODD)
    assert check_tokens(spark, odd(spark).limit(0)) == []


CODEC = bpe.MergeReplay(RANKS, public_tokenizers.PATTERN)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(max_size=40), min_size=1, max_size=8))
def test_ids_of_random_texts(texts):
    ids = [np.frombuffer(x, "<u4").tolist() for x in CODEC.encode(texts)]
    assert ids == [ENCODING.encode_ordinary(t) for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.dictionaries(st.binary(min_size=2, max_size=4).map(lambda b: bytes(x % 3 + 97 for x in b)), st.integers(0, 10**6), max_size=14), st.lists(st.text("abc", min_size=1, max_size=14), max_size=6))
def test_ids_of_vocabularies_that_rank_pairs_below_their_parts(tokens, pieces):
    ranks = {bytes([i]): i for i in range(256)}
    for rank, token in enumerate(sorted(tokens, key=lambda t: (tokens[t], t))):
        ranks[token] = 256 + rank
    codec = bpe.MergeReplay(ranks, r"\S+")
    library = tiktoken.Encoding("own", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})
    ids = [np.frombuffer(x, "<u4").tolist() for x in codec.encode(pieces)]
    assert ids == [library.encode_ordinary(p) for p in pieces]


def test_pieces_in_use_are_remembered_when_others_are_forgotten(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    codec = bpe.MergeReplay(RANKS, public_tokenizers.PATTERN)
    replayed, replay = [], codec.replay
    monkeypatch.setattr(codec, "replay", lambda corpus: replayed.append(corpus) or replay(corpus))
    whole = bpe.MergeReplay(RANKS, public_tokenizers.PATTERN)
    texts = [f"Thlyouble {word}" for word in ("qzxvk", "zzyxw", "kjqvx", "vvxqz", "qzxvk", "wqzzk", "xxkqj")]
    assert [codec.encode([t]) for t in texts] == [whole.encode([t]) for t in texts]
    # never encoded again while it is used; what is not used is forgotten
    assert sum(b"Thlyouble" in corpus for corpus in replayed) == 1
    assert len(codec._known) + len(codec._aside) <= 2 * (3 + 2)


def test_digests(spark):
    for r in queries.op9_byte_bpe(spark, SF).limit(5).collect():
        text = given_docs(spark).where(f"doc_id = {r['doc_id']}").first()["text"]
        ids = ENCODING.encode_ordinary(text)
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def brute_sections(text, rule):
    spans, at = [], 0
    for line in text.split("\n") if not text.endswith("\n") else text.split("\n")[:-1]:
        spans.append((at, min(at + len(line) + 1, len(text))))
        at += len(line) + 1
    spans = spans or [(0, 0)]
    owner = [i for i, c in enumerate(text) for _ in c.encode()]
    counts, crossing, at = [0] * len(spans), [0] * len(spans), 0
    for token in ENCODING.encode_ordinary(text):
        size = len(ENCODING.decode_single_token_bytes(token))
        chars = set(owner[at : at + size])
        at += size
        inside = [len([c for c in chars if a <= c < b]) for a, b in spans]
        touched = [i for i, n in enumerate(inside) if n]
        chosen = {"start": touched[0], "end": touched[-1], "most": inside.index(max(inside))}[rule]
        counts[chosen] += 1
        for i in touched if len(touched) > 1 else []:
            crossing[i] += 1
    return [(i, a, b, counts[i], crossing[i], sum(counts)) for i, (a, b) in enumerate(spans)]


def test_token_edges_of_very_long_runs_of_blanks():
    ranks = bpe.read_ranks(public_tokenizers.path(queries.RANK_FILE))
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        lengths[rank] = len(token)

    class Refusing:
        _pat_str, _encode_single_piece = encoding._pat_str, encoding._encode_single_piece

        def encode_to_numpy(self, text, disallowed_special):
            raise ValueError

    text = "Some words, 1234 and\n\n  more" + " " * 5000 + "\u00fcber \u65e5\u672c <|end|> it's"
    wanted = attribution.token_bytes(encoding, lengths, text)
    assert attribution.token_bytes(Refusing(), lengths, text).tolist() == wanted.tolist()
    long = "x" + " " * 1_000_000 + "y"
    edges = attribution.token_bytes(encoding, lengths, long)
    assert edges[-1] == len(long) and (np.diff(edges) > 0).all()


@pytest.mark.parametrize("rule", attribution.RULES)
def test_section_tokens_against_brute_force(spark, rule):
    texts = ["a\n\n\n\nb", "\n\n\n\n\n\n\n\nx\n\n \n\n", "", "one.\ntwo 🙂\nthree", "🙂🙂\n漢字\n", "\n", " \n  \n\n  end"]
    rows = [*enumerate(texts), (90, None)] + [tuple(r) for r in given_docs(spark).select("doc_id", "text").limit(20).collect()]
    rows = [(1000 + i, t) for i, (_, t) in enumerate(rows)]
    df = spark.createDataFrame(rows, ODD_SCHEMA)
    found = {}
    for r in attribution.section_tokens(df, public_tokenizers.path(queries.RANK_FILE), public_tokenizers.PATTERN, rule).collect():
        found.setdefault(r["doc_id"], []).append(tuple(r)[1:])
    assert {i: sorted(x) for i, x in found.items()} == {i: brute_sections(t, rule) for i, t in rows if t is not None}


def test_section_tokens_of_odd_rows(spark):
    args = public_tokenizers.path(queries.RANK_FILE), public_tokenizers.PATTERN
    rows = attribution.section_tokens(odd(spark), *args).collect()
    assert Counter(r["doc_id"] for r in rows)[9] == 2
    assert all(r["n_tokens"] >= 0 for r in rows)
    assert attribution.section_tokens(odd(spark).limit(0), *args).collect() == []
    with pytest.raises(ValueError):
        attribution.section_tokens(odd(spark), *args, "middle")


# URLs --------------------------------------------------------------------------------------------


def brute_rule(url):
    rest = (url or "").split("://", 1)[1] if "://" in (url or "") else ""
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in urls.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.text), default=None)
    return host, path, best.text if best else None, best.verdict if best else None


def brute_scores(pages, counted):
    def grams(url):
        body = re.sub("[0-9]", "0", re.sub(r"(?s)^.*?://", "", url or "", count=1))
        s = "\x02" + body
        return [s[max(i - 4, 0) : i + 1] for i in range(1, len(s))]

    counts = {"allow": Counter(), "block": Counter()}
    for i, url in pages.items():
        verdict = brute_rule(url)[3]
        if verdict and i in counted:
            for g in grams(url):
                for k in range(len(g)):
                    counts[verdict][g[len(g) - 1 - k :]] += 1
    follow = {v: {} for v in counts}
    for v, c in counts.items():
        for tail, n in c.items():
            total, kinds = follow[v].get(tail[:-1], (0, 0))
            follow[v][tail[:-1]] = (total + n, kinds + 1)

    def logp(g, v):
        p = 1 / urls.ALPHABET
        for k in range(len(g)):
            tail = g[len(g) - 1 - k :]
            total, kinds = follow[v].get(tail[:-1], (0, 0))
            if total:
                p = (counts[v][tail] + kinds * p) / (total + kinds)
        return math.log(p)

    return {i: sum(logp(g, "allow") - logp(g, "block") for g in grams(u)) / len(grams(u)) for i, u in pages.items() if grams(u)}


ODD_URLS = [
    (9001, None), (9002, ""), (9003, "no scheme"), (9004, "http://"), (9005, "HTTP://A.B.NET/x?y=://z#q"), (9006, "http://xnet/"),
    (9007, "http://net/"), (9008, "http://a.example.net/EN/"), (9009, "http://ÀÉ.org/fr/é🙂"), (9010, "ftp://www.example.org?fr/"),
    (9011, "http://a.net"), (9012, "http://example.com/de/" + "x" * 20_000), (9007, "http://net/"),
]


def test_url_rules_and_models(spark):
    given = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url").collect()]
    df = spark.createDataFrame(given + ODD_URLS, "page_id long, url string").repartition(3)
    held = {r["page_id"] for r in df.where(urls.F.pmod(urls.F.xxhash64("url"), urls.F.lit(urls.FOLDS)) == 0).collect()}
    pages = dict(given + ODD_URLS)
    # the repeated row is counted twice
    scores = brute_scores(pages | {-1: "http://net/"}, {*pages, -1} - held - ({-1} if 9007 in held else set()) - {9001})
    rows = urls.filter_urls(df).collect()
    assert len(rows) == len(given) + len(ODD_URLS)
    limit = rows[0]["threshold"]
    groups = {"allow": [], "block": []}
    for r in rows:
        host, path, rule, verdict = brute_rule(pages[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        score = scores.get(r["page_id"], 0.0)
        assert abs(r["score"] - score) < 1e-6
        assert r["verdict"] == (verdict or ("block" if r["page_id"] in scores and score < limit else "allow"))
        if verdict and r["page_id"] in held:
            groups[verdict].append(score)
    (a, sa), (b, sb) = ((np.mean(g), np.std(g)) for g in groups.values())
    assert abs(limit - (a * sb + b * sa) / (sa + sb)) < 1e-6


def test_url_models_without_evidence(spark):
    df = spark.createDataFrame([(1, "http://a.com/"), (2, None), (3, "http://b.net/")], "page_id long, url string")
    assert {r["page_id"]: r["verdict"] for r in urls.filter_urls(df).collect()} == {1: "allow", 2: "allow", 3: "block"}
    assert urls.filter_urls(df.limit(0)).collect() == []


# mixing ------------------------------------------------------------------------------------------


def brute_targets(by_source):
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(sorted(by_source, key=lambda s: (s is None, (s or "").encode())))}
    total, capped = sum(by_source.values()), set()
    while True:
        rest = total - sum(3 * by_source[s] for s in capped)
        open_ = [s for s in by_source if s not in capped]
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * by_source[s]}
        if not over:
            return {s: 3.0 * by_source[s] if s in capped else share[s] for s in by_source}
        capped |= over


def check_mix(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(3)
    result = mixing.mix(df).collect()
    assert len(result) == len(rows)
    sizes, taken = Counter(), Counter()
    for _, s, t in rows:
        sizes[s] += len(WORD.findall(t or ""))
    wanted = brute_targets(dict(sizes)) if rows else {}
    largest = Counter()
    for r in result:
        assert 0 <= r["taken"] <= 3 * r["size"] and r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(wanted[r["source"]])
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    for s in sizes:
        assert abs(taken[s] - wanted[s]) <= 2 * largest[s] + 1e-6
    again = mixing.mix(df.repartition(2)).collect()
    assert sorted(map(str, map(tuple, result))) == sorted(map(str, map(tuple, again)))


def test_mix_of_the_given_documents(spark):
    check_mix(spark, [(r["doc_id"], r["source"], r["text"]) for r in given_docs(spark).collect()])


def test_mix_with_small_large_null_and_empty_sources(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice(["hot"] * 8 + ["b", "é", "Z", None]), "w " * rng.randrange(0, 90)) for i in range(400)]
    rows += [(1000, "tiny", "one"), (1001, "none", None), (1002, "none", ""), (1000, "tiny", "one"), (None, "b", "x y")]
    check_mix(spark, rows)
    check_mix(spark, [(1, "a", None), (2, None, "")])
    check_mix(spark, [])


def test_targets_with_caps(spark):
    sizes = {"a": 1000, "b": 1, "c": 2, "d": 50, "e": 3000, "f": 10, "g": 0}
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    found = {r["source"]: r["target"] for r in mixing.targets(df).collect()}
    assert found == pytest.approx(brute_targets(sizes))
    assert sum(found.values()) == pytest.approx(sum(sizes.values()))


# preferences -------------------------------------------------------------------------------------


def brute_pair(chosen, rejected):
    def render(turns):
        text, spans = "", []
        for _, role, content in turns:
            text += f"<|{'unknown' if role is None else role}|>\n"
            if role == "assistant":
                spans.append((len(text), len(text) + len(content or "")))
            text += (content or "") + "\n<|end|>\n"
        return text, spans

    n = 0
    while n < min(len(chosen), len(rejected)) and chosen[n][1:] == rejected[n][1:]:
        n += 1
    return (n, render(chosen[:n])[0], *render(chosen[n:]), *render(rejected[n:]))


def test_pairs_against_brute_force(spark):
    rng = random.Random(9)
    rows = []
    for p in range(60):
        base = [(t, rng.choice(["user", "assistant", "system", None]), rng.choice(["a", "b 🙂", "", None])) for t in range(rng.randrange(0, 6))]
        for side in ("chosen", "rejected"):
            cut = rng.randrange(0, len(base) + 1)
            more = [(t, rng.choice(["user", "assistant"]), rng.choice("xy")) for t in range(cut, cut + rng.randrange(0, 3))]
            rows += [(p, side, *turn) for turn in base[:cut] + more]
    rows += [(100, "chosen", 0, "user", "only one side"), (101, "other", 0, "user", "x"), (None, "chosen", 0, "user", "x")]
    df = spark.createDataFrame(rows, "pair_id long, side string, turn long, role string, text string").repartition(4)
    found = {r["pair_id"]: r for r in preferences.format_pairs(df).collect()}
    assert set(found) == {p for p, s, *_ in rows if p is not None and p != 101}
    for p, r in found.items():
        sides = [[t for q, s, *t in rows if q == p and s == side] for side in ("chosen", "rejected")]
        mine = (r["n_prompt_turns"], r["prompt"], r["chosen"], [tuple(s) for s in r["chosen_mask"]], r["rejected"], [tuple(s) for s in r["rejected_mask"]])
        assert mine == brute_pair(*sides)
        assert r["identical"] == (not mine[2] and not mine[4])


def test_pairs_of_the_given_conversations(spark):
    turns = preferences.swapped_endings(spark.read.parquet(f"{SF}/conversations.parquet"))
    rows = preferences.format_pairs(turns).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id").distinct().count()
    for r in rows:
        assert r["prompt"] + r["chosen"] and all(r["chosen"][a:b] for a, b in r["chosen_mask"])
    assert preferences.format_pairs(turns.limit(0)).collect() == []


def test_odd_conversations(spark):
    rows = [(2, 0, "user", "q"), (2, 1, "assistant", None), (3, None, None, "x"), (3, 0, "assistant", "b"), (None, 0, "assistant", "c"), (4, 0, "user", "z"), (6, 0, "assistant", "lone")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = {r["pair_id"]: r for r in preferences.format_pairs(preferences.swapped_endings(df)).collect()}
    assert set(found) == {2, 3, 4, 6}
    assert found[4]["prompt"] == "<|user|>\nz\n<|end|>\n" and found[4]["identical"] and found[4]["chosen"] == ""
    assert found[2]["rejected"] == "<|assistant|>\nb\n<|end|>\n" and found[6]["rejected"] == ""
