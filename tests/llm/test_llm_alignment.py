import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tokenizers
from hypothesis import given, settings, strategies as st

from hearthmap.llm import alignment, queries

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string"
PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
FILES = alignment.Files.read(*PATHS)
ENCODERS = alignment.Encoders(FILES)
A = tokenizers.Tokenizer.from_file(PATHS[0])
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])


def byte_characters():
    own = list(range(33, 127)) + list(range(161, 173)) + list(range(174, 256))
    table, n = {chr(b): b for b in own}, 0
    for b in range(256):
        if b not in own:
            table[chr(256 + n)] = b
            n += 1
    return table


CHARACTERS = byte_characters()


def token_bytes_a(i):
    return bytes(CHARACTERS[c] for c in A.id_to_token(i))


def token_bytes_b(i):
    piece = B.id_to_piece(i)
    return bytes([int(piece[3:5], 16)]) if B.is_byte(i) else piece.replace("▁", " ").encode()


def brute(text):
    """(n_a, n_b, groups) token by token, groups as lists of ids."""
    if not text:
        return 0, 0, []
    full = (" " + text).encode()
    a, b = A.encode(" " + text, add_special_tokens=False).ids, B.encode(text)
    if b"".join(map(token_bytes_a, a)) != full or b"".join(map(token_bytes_b, b)) != full:
        return 0, 0, []
    ends = []
    for ids, of in ((a, token_bytes_a), (b, token_bytes_b)):
        at, here = 0, {}
        for i in ids:
            at += len(of(i))
            here[at] = i
        ends.append(here)
    cuts = sorted(set(ends[0]) & set(ends[1]))
    groups, low = [], 0
    for cut in cuts:
        groups.append([[i for at, i in side.items() if low < at <= cut] for side in ends])
        low = cut
    return len(a), len(b), groups


def render(groups):
    return ";".join("|".join(",".join(map(str, ids)) for ids in g) for g in groups)


def brute_query(rows):
    aligned = [(i, *brute(t)) for i, t in rows]
    counts = Counter((g[0][-1], g[1][-1]) for *_, groups in aligned for g in groups)
    highest = Counter()
    for (_, b), n in counts.items():
        highest[b] = max(highest[b], n)
    out = []
    for i, n_a, n_b, groups in aligned:
        links = [(g[0][-1], g[1][-1]) for g in groups]
        best = sum(counts[x] == highest[x[1]] for x in links)
        digest = hashlib.sha256(render(groups).encode()).hexdigest() if groups else ""
        out.append((i, n_a, n_b, len(groups), len(links), best, sum(counts[x] for x in links), digest))
    return sorted(out, key=repr)


def run(df, **options):
    aligned = alignment.align(df, FILES, **options).drop("groups")
    names = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    rated = alignment.rate_links(aligned, alignment.pair_list(FILES))
    return sorted((tuple(r[c] for c in names) for r in rated.collect()), key=repr)


RNG = random.Random(3)
PROSE = " ".join(RNG.choice(["the", "straße", "über 12", "naïve,", "x\n\ny", "漢字かな", "🙂", "it's", "a  b", "<s>", "<0x41>", "\t"]) for _ in range(900))
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "a"), (5, "\x1c\x85  x\x00y"), (6, "z" * 9_000), (7, "so so " * 3_000), (8, "Ünï 漢字 🙂🙂\r\n👩‍👩‍👧 ña"),
    (9, "12 34 | $"), (9, "12 34 | $"), (None, "no id here."), (10, "a▁b is not rebuilt"), (11, "<|endoftext|> </s> <unk>"), (12, PROSE), (12, PROSE),
    (13, "  two spaces first"), (14, "﻿ 　x ­"), (15, PROSE + " ▁ at the end"),
]


def test_odd_rows_against_brute_force(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in ODD], SCHEMA + ", links string").repartition(3)
    assert run(df) == brute_query(ODD)
    assert run(df.limit(0)) == []


@pytest.mark.parametrize("part_chars", [40, 700])
def test_long_texts_in_parts(spark, part_chars):
    """Parts dealt out to tasks and composed over one or more levels give the same rows."""
    df = spark.createDataFrame(ODD, SCHEMA).repartition(3)
    assert run(df, part_chars=part_chars) == brute_query(ODD)
    assert max(len(list(alignment._parts(t, 40))) for _, t in ODD if t) > alignment.FAN


def test_rendered_groups(spark):
    rows = alignment.align(spark.createDataFrame(ODD, SCHEMA), FILES, rendered=True, part_chars=300).collect()
    assert sorted((r["doc_id"], r["groups"]) for r in rows if r["doc_id"]) == sorted((i, render(brute(t)[2])) for i, t in ODD if i)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab é漢🙂'\n 12", max_size=60), min_size=1, max_size=4), st.integers(1, 30))
def test_ranges_of_any_size_compose_to_the_same_groups(texts, range_bytes):
    for text, f in zip(texts, alignment.fragments(texts, ENCODERS, range_bytes)):
        n_a, n_b, groups = brute(text)
        assert f.closed.decode() == render(groups)
        if groups:
            assert (f.n_a, f.n_b) == (n_a, n_b)
            links = ENCODERS.pairs.a[f.links], ENCODERS.pairs.b[f.links]
            assert list(zip(*map(list, links))) == [(g[0][-1], g[1][-1]) for g in groups]


def same(x, y):
    return all(np.array_equal(getattr(x, c), getattr(y, c)) for c in alignment.Fragment.__dataclass_fields__)


def test_composition_is_associative():
    rng = random.Random(1)
    text = PROSE[:2000]
    whole = f" {text}".encode()
    a, b = ENCODERS.encode([text])
    aligned = alignment.Aligned(np.array(a[0], np.int32), np.array(b[0], np.int32), ENCODERS)
    join = lambda x, y: alignment.compose(x, y, ENCODERS.pairs)
    open_ranges = 0
    for _ in range(200):
        middle = rng.randrange(2, len(whole) - 8)
        cuts = [middle, middle + rng.randint(1, 3), rng.randint(middle + 4, len(whole))]
        x, y, z = (aligned.fragment(p, q, p == 0) for p, q in zip([0, *cuts], cuts))
        assert same(join(join(x, y), z), join(x, join(y, z)))
        open_ranges += not y.cut
        assert same(join(alignment.BEGIN, aligned.fragment(0, cuts[0], False)), aligned.fragment(0, cuts[0], True))
    assert open_ranges


def test_units_of_texts_are_encoded_once_as_the_whole_text(monkeypatch):
    monkeypatch.setattr(alignment, "REMEMBERED", 40)
    encoders = alignment.Encoders(FILES)
    coded, encode = [], encoders._encode
    monkeypatch.setattr(encoders, "_encode", lambda units: coded.extend(units) or encode(units))
    rng = random.Random(5)
    words = PROSE[:3000].split() + ["", "", " ", "\n", "\t", "x\n", "\u2581", "a\u2581b", "\u00a0", "\x1c", "\x85y", "it's", "12", "<|endoftext|>", "<s>", "\u3000\u4e2d\u6587", "\x00", "e\u0301", "q" * 90]
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 40))) or " " for _ in range(300)]
    for at in range(0, 300, 10):
        some = [f"{t} zqxv" for t in texts[at : at + 10]]
        a, b = encoders.encode(some)
        assert [x.tolist() for x in a] == [A.encode(f" {t}", add_special_tokens=False).ids for t in some]
        assert [x.tolist() for x in b] == B.encode(some)
    # safe in front of it in nearly every text, remembered all along; long units are not kept
    assert coded.count("zqxv") == 1
    assert max(map(len, [*encoders._known, *encoders._aside])) <= alignment.UNIT_CHARS
    assert len(encoders._aside) < len(set(coded))


def test_pairs_hold_every_pair_that_can_be_linked():
    pairs = alignment.Pairs([b"ab", b"b", b"", b"cab"], [b"b", b"ab", b"xab", b"b", b"c"])
    found = set(zip(pairs.a.tolist(), pairs.b.tolist()))
    assert found == {(0, 0), (0, 1), (0, 2), (0, 3), (1, 0), (1, 1), (1, 2), (1, 3), (3, 0), (3, 1), (3, 3)}
    assert len(ENCODERS.pairs) < 400_000 and ENCODERS.divisible


def test_query_against_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    df = queries.op13_tokenizer_alignment(spark, SF)
    names = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    assert sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr) == brute_query(docs)
