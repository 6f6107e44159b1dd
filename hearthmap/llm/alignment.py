"""Alignment of two tokenizers by composing fragments of byte ranges.

A text, with one space in front, is encoded by a byte-level BPE (A) and by a sentence-piece model (B).  Byte
offsets at which a token of either side ends are cuts; the tokens between two cuts are a group, and its last
tokens of both sides, which end together, are linked.

Fragments.  The tokens that end inside a byte range make a :class:`Fragment`: those up to the range's first cut
are its open head (their group may have begun before the range), those between its cuts are closed groups, those
after its last cut its open tail; without a cut all is open.  :func:`compose` joins the fragments of neighbouring
ranges and is associative, so ranges can be composed in any tree.  A text of up to ``PART_CHARS`` is encoded in
one task and its ranges of ``RANGE_BYTES`` are composed there.  A longer one is dealt out to tasks in parts; the
parts' fragments are composed ``FAN`` neighbours at a time, level by level, until one is left.  Parts begin at a
single space between two other characters, where both tokenizers always begin a token (pieces of B hold spaces
only in front, which is checked), so that encoding by parts equals encoding whole; a run without such a space
stays one part.

Links.  Two linked tokens end at the same byte, so one's bytes end in the other's.  The pairs for which this
holds are listed from the two vocabularies (:class:`Pairs`), whatever the corpus: a link is a number of that list,
and corpus-wide counts are one array of its length (324,297 for the two files of the query), which is all that
the driver collects or broadcasts.

Rows: texts that are null, empty or not rebuilt exactly by the tokens of either side have no tokens: zeros and
empty groups.  Repeated rows give equal rows and count each time; other columns are dropped.  Empty table: no
rows.  A null id stays null.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
import tokenizers
from pyspark.sql import DataFrame, functions as F

from hearthmap.llm.bpe import Vocabulary
from hearthmap.llm.scratch import Scratch
from hearthmap.llm.words import steps

RANGE_BYTES = 65_536
PART_CHARS = 500_000
FAN = 16
STEP = 1_000_000
# Encoded units of a text that a worker remembers between steps, and the longest one that it remembers.
REMEMBERED = 250_000
UNIT_CHARS = 64
_SAFE = re.compile(r"(?<=[^\s▁]) (?=[^\s▁])")
_NO_IDS = np.zeros(0, np.int32)


def byte_level_alphabet() -> dict[str, int]:
    """The characters that byte-level vocabularies write bytes with: printable ones stand for themselves."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


class Pairs:
    """All pairs of an A and a B token of which one's bytes end in the other's, numbered in order of (a, b)."""

    def __init__(self, a: list[bytes], b: list[bytes]):
        def ends(tokens: list[bytes]) -> dict[bytes, list[int]]:
            found: dict[bytes, list[int]] = {}
            for i, t in enumerate(tokens):
                if t:
                    found.setdefault(t, []).append(i)
            return found

        by_a, by_b = ends(a), ends(b)
        pairs = {(i, j) for t in by_a for k in range(len(t)) for j in by_b.get(t[k:], ()) for i in by_a[t]}
        pairs |= {(i, j) for t in by_b for k in range(1, len(t)) for i in by_a.get(t[k:], ()) for j in by_b[t]}
        listed = np.array(sorted(pairs), np.int64).reshape(-1, 2)
        self.a, self.b = listed[:, 0], listed[:, 1]
        self._keys = self.a << 32 | self.b

    def __len__(self) -> int:
        return len(self.a)

    def numbers(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.searchsorted(self._keys, a.astype(np.int64) << 32 | b).astype(np.int32)


@dataclass
class Files:
    """Contents of the two tokenizer files; read on the driver, which ships them to the tasks."""

    byte_level: str
    pieces: bytes

    @staticmethod
    def read(byte_level_path: str, piece_path: str) -> "Files":
        with open(byte_level_path, encoding="utf-8") as a, open(piece_path, "rb") as b:
            return Files(a.read(), b.read())


class Encoders:
    """Both tokenizers with the bytes of their tokens."""

    def __init__(self, files: Files):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
        self._a = tokenizers.Tokenizer.from_str(files.byte_level)
        self._a.encode_special_tokens = True
        alphabet = byte_level_alphabet()
        vocabulary = json.loads(files.byte_level)["model"]["vocab"]
        a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            a[i] = bytes([alphabet[c] for c in token])
        self._b = sentencepiece.SentencePieceProcessor(model_proto=files.pieces)
        b = []
        for i in range(self._b.get_piece_size()):
            piece = self._b.id_to_piece(i)
            if self._b.is_byte(i):
                b.append(bytes([int(piece[3:5], 16)]))
            else:
                special = self._b.is_control(i) or self._b.is_unknown(i)
                b.append(b"" if special else piece.replace("▁", " ").encode())
        self.a, self.b = Vocabulary(a), Vocabulary(b)
        self.pairs = Pairs(a, b)
        # parts need that no piece holds a space behind another character
        self.divisible = not any(b" " in t.lstrip(b" ") for t in b)
        digits = [str(i).encode() + b"," for i in range(max(len(a), len(b)))]
        self.digits = Vocabulary(digits)
        self._known: dict[str, tuple[bytes, bytes]] = {}
        self._aside: dict[str, tuple[bytes, bytes]] = {}

    def _encode(self, texts: list[str]) -> Iterator[tuple[bytes, bytes]]:
        """Ids of either side, as 32-bit integers, of each text that is not empty, encoded as one."""
        a = self._a.encode_batch_fast([f" {t}" for t in texts], add_special_tokens=False)
        b = self._b.encode(texts, out_type=int, num_threads=1)
        return ((array("i", x.ids).tobytes(), array("i", y).tobytes()) for x, y in zip(a, b))

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of either side for each text that is not empty.

        Both sides begin a token at every safe space, so a text's ids are those of its units between such
        spaces.  Each distinct unit of a step is encoded once.  A worker that remembers enough units sets them
        aside, keeps those that come up again and forgets the others.
        """
        split = [_SAFE.split(t) if self.divisible else [t] for t in texts]
        if len(self._known) > REMEMBERED:
            self._known, self._aside = {}, self._known
        known, aside = self._known, self._aside
        fresh = []
        for unit in set().union(*split).difference(known):
            ids = aside.pop(unit, None)
            if ids is None:
                fresh.append(unit)
            else:
                known[unit] = ids
        known.update(zip(fresh, self._encode(fresh)))
        coded = [[known[unit] for unit in units] for units in split]
        for unit in fresh:
            if len(unit) > UNIT_CHARS:
                del known[unit]
        joined = ([b"".join([ids[side] for ids in units]) for units in coded] for side in (0, 1))
        return tuple([np.frombuffer(ids, np.int32) for ids in side] for side in joined)


_encoders: list[tuple[Files, Encoders]] = []


def _worker_encoders(files: Files) -> Encoders:
    """The worker's tokenizers; the last ones are kept for its next task."""
    if not _encoders or _encoders[0][0] is not files:
        _encoders[:] = [(files, Encoders(files))]
    return _encoders[0][1]


# ---------------------------------------------------------------- fragments


@dataclass
class Fragment:
    """Tokens that end in one byte range.  ``closed``: groups as text, ``links``: pair numbers of their ends.

    Without a cut all tokens are in the head, and there is nothing closed and no tail.
    """

    cut: bool = False
    head_a: np.ndarray = field(default_factory=lambda: _NO_IDS)
    head_b: np.ndarray = field(default_factory=lambda: _NO_IDS)
    closed: bytes = b""
    links: np.ndarray = field(default_factory=lambda: _NO_IDS)
    tail_a: np.ndarray = field(default_factory=lambda: _NO_IDS)
    tail_b: np.ndarray = field(default_factory=lambda: _NO_IDS)
    n_a: int = 0
    n_b: int = 0
    good: bool = True


# A text begins with a cut.
BEGIN = Fragment(cut=True)


def _render(a: np.ndarray, b: np.ndarray) -> bytes:
    return f"{','.join(map(str, a.tolist()))}|{','.join(map(str, b.tolist()))}".encode()


def compose(x: Fragment, y: Fragment, pairs: Pairs) -> Fragment:
    """The fragment of two neighbouring ranges."""
    both = np.concatenate
    counts = {"n_a": x.n_a + y.n_a, "n_b": x.n_b + y.n_b, "good": x.good and y.good}
    if not x.cut:
        head = both([x.head_a, y.head_a]), both([x.head_b, y.head_b])
        return Fragment(y.cut, *head, y.closed, y.links, y.tail_a, y.tail_b, **counts)
    if not y.cut:
        tail = both([x.tail_a, y.head_a]), both([x.tail_b, y.head_b])
        return Fragment(True, x.head_a, x.head_b, x.closed, x.links, *tail, **counts)
    closed, links = [x.closed, y.closed], [x.links, y.links]
    a, b = both([x.tail_a, y.head_a]), both([x.tail_b, y.head_b])
    if len(a) or len(b):  # both are empty where the ranges meet at a cut and y begins a text
        closed.insert(1, _render(a, b))
        links.insert(1, pairs.numbers(a[-1:], b[-1:]))
    return Fragment(True, x.head_a, x.head_b, b";".join(filter(None, closed)), both(links), y.tail_a, y.tail_b, **counts)


def compose_all(fragments: list[Fragment], pairs: Pairs) -> Fragment:
    """Neighbouring fragments composed as a balanced tree."""
    while len(fragments) > 1:
        fragments = [reduce(lambda x, y: compose(x, y, pairs), fragments[i : i + 2]) for i in range(0, len(fragments), 2)]
    return fragments[0] if fragments else Fragment()


class Aligned:
    """Tokens of several texts side by side, cut into fragments by ranges of their bytes."""

    def __init__(self, a: np.ndarray, b: np.ndarray, encoders: Encoders):
        self.a, self.b, self.encoders = a, b, encoders
        self.end_a = np.cumsum(encoders.a.lengths[a])
        self.end_b = np.cumsum(encoders.b.lengths[b])
        size = int(self.end_a[-1]) if len(a) else 0
        ends = np.zeros(size + 1, np.int8)
        ends[self.end_a] = 1
        ends[self.end_b] += 2
        cut_a, cut_b = ends[self.end_a] == 3, ends[self.end_b] == 3
        # places of the last tokens of every group
        self.last_a, self.last_b = np.flatnonzero(cut_a), np.flatnonzero(cut_b)
        self.cut_at = self.end_a[self.last_a]
        self.links = encoders.pairs.numbers(a[self.last_a], b[self.last_b])
        self._text(cut_a, cut_b)

    def _text(self, cut_a: np.ndarray, cut_b: np.ndarray) -> None:
        """All groups as text, with the place after each one's closing ``;``."""
        group_a = np.cumsum(cut_a) - cut_a
        group_b = np.cumsum(cut_b) - cut_b
        # place of every token in the order: group, side, position
        before_a = np.concatenate([[0], self.last_a + 1])
        before_b = np.concatenate([[0], self.last_b + 1])
        place_a = np.arange(len(self.a)) + before_b[group_a]
        place_b = np.arange(len(self.b)) + np.append(before_a, len(self.a))[group_b + 1]
        order = np.empty(len(self.a) + len(self.b), np.int64)
        order[place_a], order[place_b] = self.a, self.b
        text = self.encoders.digits.bytes_of(order).copy()
        after = np.cumsum(self.encoders.digits.lengths[order])
        text[after[place_a[self.last_a]] - 1] = ord("|")
        closing = after[place_b[self.last_b]]
        text[closing - 1] = ord(";")
        self.text, self.closing = text.tobytes(), closing

    def fragment(self, low: int, high: int, begin: bool) -> Fragment:
        """The fragment of the bytes from ``low`` to ``high``; ``begin``: a text begins at ``low``."""
        a = slice(*np.searchsorted(self.end_a, [low, high], "right"))
        b = slice(*np.searchsorted(self.end_b, [low, high], "right"))
        first, after = np.searchsorted(self.cut_at, [low, high], "right")
        counts = {"n_a": a.stop - a.start, "n_b": b.stop - b.start}
        if first == after:
            open_a, open_b = self.a[a], self.b[b]
            if begin:
                return Fragment(True, tail_a=open_a, tail_b=open_b, **counts)
            return Fragment(False, open_a, open_b, **counts)
        head_a = head_b = _NO_IDS
        if not begin:
            head_a = self.a[a.start : self.last_a[first] + 1]
            head_b = self.b[b.start : self.last_b[first] + 1]
            first += 1
        start = self.closing[first - 1] if first else 0
        closed = self.text[start : max(self.closing[after - 1] - 1, start)]
        tail = self.a[self.last_a[after - 1] + 1 : a.stop], self.b[self.last_b[after - 1] + 1 : b.stop]
        return Fragment(True, head_a, head_b, closed, self.links[first:after], *tail, **counts)


def _flat(ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts side by side, and how many each has."""
    return np.concatenate([_NO_IDS, *ids]), np.array([len(x) for x in ids], np.int64)


def _rebuilt(ids: np.ndarray, sizes: np.ndarray, vocabulary: Vocabulary, texts: list[bytes]) -> np.ndarray:
    """Flags of the texts whose tokens give exactly their bytes."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    lengths = vocabulary.lengths[ids]
    good = np.bincount(owner, lengths, len(sizes)) == [len(t) for t in texts]
    good &= np.bincount(owner, lengths == 0, len(sizes)) == 0
    made = vocabulary.bytes_of(ids[good[owner]]).tobytes()
    kept = [t for t, g in zip(texts, good) if g]
    if made != b"".join(kept):
        ends = np.cumsum([len(t) for t in kept]).tolist()
        good[good] = [made[e - len(t) : e] == t for e, t in zip(ends, kept)]
    return good


def fragments(texts: list[str | None], encoders: Encoders, range_bytes: int = RANGE_BYTES) -> list[Fragment]:
    """One fragment per text, composed from its byte ranges; a text that is not rebuilt is not good."""
    full = [i for i, t in enumerate(texts) if t]
    out = [Fragment() for _ in texts]
    if not full:
        return out
    whole = [f" {texts[i]}".encode() for i in full]
    ids_a, ids_b = encoders.encode([texts[i] for i in full])
    (a, n_a), (b, n_b) = _flat(ids_a), _flat(ids_b)
    good = _rebuilt(a, n_a, encoders.a, whole) & _rebuilt(b, n_b, encoders.b, whole)
    keep_a, keep_b = np.repeat(good, n_a), np.repeat(good, n_b)
    aligned = Aligned(a[keep_a], b[keep_b], encoders)
    low = 0
    for i, text, g in zip(full, whole, good):
        if not g:
            out[i] = Fragment(good=False)
            continue
        edges = [*range(low, low + len(text), range_bytes), low + len(text)]
        pieces = [aligned.fragment(x, y, x == low) for x, y in zip(edges, edges[1:])]
        out[i] = compose_all(pieces, encoders.pairs)
        low += len(text)
    return out


# ---------------------------------------------------------------- on Spark

_STATE = (
    "cut boolean, head_a binary, head_b binary, closed binary, links binary, tail_a binary, tail_b binary, "
    "n_a long, n_b long, good boolean"
)
_ARRAYS = ("head_a", "head_b", "links", "tail_a", "tail_b")
_RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, links binary"


def _to_row(f: Fragment) -> dict:
    return {**f.__dict__, **{c: getattr(f, c).tobytes() for c in _ARRAYS}}


def _from_row(row: dict) -> Fragment:
    known = {c: row[c] for c in Fragment.__dataclass_fields__}
    return Fragment(**known | {c: np.frombuffer(row[c], np.int32) for c in _ARRAYS})


def _result(doc_id: int | None, f: Fragment, rendered: bool) -> dict:
    if not f.good or not f.closed:
        return dict(doc_id=doc_id, n_a=0, n_b=0, n_groups=0, n_links=0, groups_sha256="", groups="" if rendered else None, links=b"")
    return {
        "doc_id": doc_id,
        "n_a": f.n_a,
        "n_b": f.n_b,
        "n_groups": len(f.links),
        "n_links": len(f.links),
        "groups_sha256": hashlib.sha256(f.closed).hexdigest(),
        "groups": f.closed.decode() if rendered else None,
        "links": f.links.tobytes(),
    }


def _arrow_schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in ddl.split(", "))])


def _rows(rows: list[dict], ddl: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, _arrow_schema(ddl))


def _parts(text: str, size: int) -> Iterator[str]:
    """The text in parts, each without the space it begins with (the first has none)."""
    at = 0
    while len(text) - at > size:
        place = _SAFE.search(text, at + size)
        if place is None:
            break
        yield text[at : place.start()]
        at = place.end()
    yield text[at:]


def align(documents: DataFrame, files: Files, *, rendered: bool = False, part_chars: int = PART_CHARS) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, groups_sha256, groups (if rendered) and ``links``.

    ``groups`` reads ``a1,a2|b1;a3|b2,b3``; ``links`` holds pair numbers (:func:`pair_list`) as 32-bit integers.
    The result is a written table.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark)
    shipped = spark.sparkContext.broadcast(files)  # fixed by the files
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    is_long = F.coalesce(F.length("text") > part_chars, F.lit(False))
    if not _worker_encoders(files).divisible:
        is_long = F.lit(False)

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders = _worker_encoders(shipped.value)
        for whole in batches:
            for batch in steps(whole, limit=STEP):
                found = fragments(batch.column("text").to_pylist(), encoders)
                ids = batch.column("doc_id").to_pylist()
                yield _rows([_result(i, f, rendered) for i, f in zip(ids, found)], _RESULT)

    at_once = docs.where(~is_long).mapInArrow(short, _RESULT)
    composed = _long(docs.where(is_long), shipped, scratch, rendered, part_chars)
    return scratch.write(at_once if composed is None else at_once.unionAll(composed), compression="zstd")


def _long(docs: DataFrame, shipped, scratch: Scratch, rendered: bool, part_chars: int) -> DataFrame | None:
    """Long texts: parts dealt out to tasks, their fragments composed level by level."""

    def divide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("row", "doc_id", "text"))):
                for number, part in enumerate(_parts(text, part_chars)):
                    yield _rows([{"row": row, "doc_id": doc_id, "part": number, "text": part}], "row long, doc_id long, part long, text string")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders = _worker_encoders(shipped.value)
        for whole in batches:
            for batch in steps(whole, limit=STEP):
                found = fragments(batch.column("text").to_pylist(), encoders)
                keys = (batch.column(c).to_pylist() for c in ("row", "doc_id", "part"))
                rows = [{"row": r, "doc_id": d, "part": p, **_to_row(f)} for r, d, p, f in zip(*keys, found)]
                for row in rows:
                    yield _rows([row], f"row long, doc_id long, part long, {_STATE}")

    # rows get their number once, in a written table
    numbered = docs.withColumn("row", F.monotonically_increasing_id())
    parts = scratch.write(numbered.mapInArrow(divide, "row long, doc_id long, part long, text string"))
    most = parts.agg(F.max("part")).first()[0]
    if most is None:
        return None
    dealt = parts.repartition(F.col("row"), F.col("part"))
    state = scratch.write(dealt.mapInArrow(encode, f"row long, doc_id long, part long, {_STATE}"))
    levels = 0
    while FAN**levels <= most:
        levels += 1
        state = scratch.write(_level(state, shipped))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                yield _rows([_result(r["doc_id"], _from_row(r), rendered)], _RESULT)

    return state.mapInArrow(finish, _RESULT)


def _level(state: DataFrame, shipped) -> DataFrame:
    """At most ``FAN`` neighbouring fragments of a text become one."""
    schema = f"row long, doc_id long, part long, {_STATE}"

    def join(group: pd.DataFrame) -> pd.DataFrame:
        rows = group.sort_values("part").to_dict("records")
        pairs = _worker_encoders(shipped.value).pairs
        one = compose_all([_from_row(r) for r in rows], pairs)
        keys = {"row": rows[0]["row"], "doc_id": rows[0]["doc_id"], "part": rows[0]["part"] // FAN}
        return pd.DataFrame([keys | _to_row(one)])

    # a text's first part begins with a cut and each part ends with one
    return state.groupBy("row", F.floor(F.col("part") / FAN).alias("__up")).applyInPandas(join, schema)


def pair_list(files: Files) -> Pairs:
    """The numbered pairs of the two vocabularies."""
    return _worker_encoders(files).pairs


def pair_counts(aligned: DataFrame, n_pairs: int) -> np.ndarray:
    """How many links of the corpus hold each pair.  Bounded by the vocabularies; the data only adds up."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_pairs, np.int64)
        for batch in batches:
            total += np.bincount(_links(batch.column("links"))[0], minlength=n_pairs)
        seen = np.flatnonzero(total)
        for some in np.array_split(seen, max(1, len(seen) // 50_000)):
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["pair", "n"])

    sums = aligned.select("links").mapInArrow(count, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    rows = sums.toArrow()  # one row per pair of the list at most
    counts = np.zeros(n_pairs, np.int64)
    counts[rows.column("pair").to_numpy()] = rows.column("n").to_numpy()
    return counts


def _links(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Pair numbers of a column's rows side by side, and the first of each row."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    if data is None or not len(column):
        return _NO_IDS, np.zeros(len(column) + 1, np.int64)
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    held = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]].tobytes()
    return np.frombuffer(held, np.int32), (bounds - bounds[0]) // 4


def rate_links(aligned: DataFrame, pairs: Pairs) -> DataFrame:
    """Adds n_best (links whose pair is the most frequent of its B token, ties included) and count_sum."""
    counts = pair_counts(aligned, len(pairs))
    highest = np.zeros(int(pairs.b.max()) + 1 if len(pairs) else 0, np.int64)
    np.maximum.at(highest, pairs.b, counts)
    shipped = aligned.sparkSession.sparkContext.broadcast((counts, counts == highest[pairs.b]))
    kept = [f for f in aligned.schema.fields if f.name != "links"]
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in kept] + ["n_best bigint", "count_sum bigint"])

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, best = shipped.value
        for batch in batches:
            links, of = _links(batch.column("links"))
            sums = [np.concatenate([[0], np.cumsum(x[links], dtype=np.int64)]) for x in (best, counts)]
            made = [pa.array(s[of[1:]] - s[of[:-1]]) for s in sums]
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in kept], *made], [*[f.name for f in kept], "n_best", "count_sum"])

    return aligned.mapInArrow(rate, schema)
