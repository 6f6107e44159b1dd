"""Byte-level BPE encoding and decoding by corpus-level merge replay.

The corpus of one step is a bounded run of documents.  Its distinct pieces (matches of the pattern) are
laid out as one sequence of byte tokens; an inverted index holds, per token pair, the positions where
the pair occurs.  Merges are replayed in rank order over that whole corpus: the pair of lowest rank is
taken from a heap, all its positions are merged, and only the pairs with the touched neighbours leave
and enter the index.  Ids of a document are the concatenated ids of its pieces.

Some vocabularies rank a pair below one of its parts.  Such a pair can appear while a higher rank is
being replayed; the replay then leaves the rest of that piece for later and takes the lower rank first,
so that every piece sees its merges in the order of a one-piece encoder.

Rows: null text encodes to no ids.  Ids outside the vocabulary make decoding fail.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import (
    ArrayType,
    BinaryType,
    DataType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)

from hearthmap.llm.scratch import small_batches
from hearthmap.llm.words import STEP_BYTES, steps

# Encoded pieces that a worker remembers between steps.  Beyond that it sets them aside: what comes up again
# while as many others are gathered is remembered anew, the rest is forgotten.
REMEMBERED = 300_000


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: lines of base64 token and rank.  Read on the driver, which ships it to the tasks."""
    lines = Path(path).read_bytes().splitlines()
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, lines))}


class MergeReplay:
    """Encodes with one vocabulary; a token's id is its rank."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, pattern
        self.pieces: Callable[[str], list[str]] = regex.compile(pattern).findall
        self._shift = max(ranks.values()).bit_length()
        # rank of what two neighbouring tokens make, by left << shift | right
        self._pair = {
            ranks[t[:i]] << self._shift | ranks[t[i:]]: rank
            for t, rank in ranks.items()
            for i in range(1, len(t))
            if t[:i] in ranks and t[i:] in ranks
        }
        self._byte = np.array([ranks.get(bytes([i]), -1) for i in range(256)], np.int64)
        ends = [(a, b) for a in range(256) for b in range(256)]
        self._two = np.array([ranks.get(bytes(x), -1) for x in ends], np.int64)
        self._known: dict[str, bytes] = {}
        self._aside: dict[str, bytes] = {}

    def replay(self, corpus: list[bytes]) -> list[bytes]:
        """Ids of every piece of a corpus of distinct pieces that are no tokens themselves."""
        if not corpus:
            return []
        data = np.frombuffer(b"".join(corpus), np.uint8)
        sizes = np.array([len(p) for p in corpus])
        ends = np.cumsum(sizes)
        token, following = self._byte[data], np.arange(1, len(data) + 1)
        if token.min() < 0:
            raise ValueError("the vocabulary lacks a byte of the text")
        following[ends - 1] = -1
        preceding = np.arange(-1, len(data) - 1)
        preceding[ends - sizes] = -1
        first = np.append(self._two[data[:-1].astype(np.int64) * 256 + data[1:]], -1)
        first[ends - 1] = -1
        index = _places(first)
        word = np.repeat(np.arange(len(corpus)), sizes)
        token = np.array(self._merge(token.tolist(), following.tolist(), preceding.tolist(), word.tolist(), index))
        left = token >= 0
        counts = np.bincount(word[left], minlength=len(corpus))
        stops = (4 * np.cumsum(counts)).tolist()
        ids = token[left].astype("<u4").tobytes()
        return [ids[a:b] for a, b in zip([0, *stops], stops)]

    def _merge(self, token: list, after: list, before: list, word: list, index: dict[int, list[int]]) -> list:
        """Replay all merges over the index; a token merged into its left neighbour becomes -1."""
        pair, shift = self._pair.get, self._shift
        heap = list(index)
        heapq.heapify(heap)
        while heap:
            rank = heapq.heappop(heap)
            places = index.pop(rank)
            places.sort()
            left = rank << shift
            waiting, later = -1, []  # piece in which a lower rank has come up, and its places left
            for i in places:
                j = after[i]
                # the place may have been touched since it was indexed
                if j < 0 or (first := token[i]) < 0 or pair(first << shift | token[j]) != rank:
                    continue
                if waiting >= 0 and word[i] == waiting:
                    later.append(i)
                    continue
                token[i], token[j] = rank, -1
                after[i] = k = after[j]
                if k >= 0:
                    before[k] = i
                    new = pair(left | token[k])
                    if new is not None:
                        if new in index:
                            index[new].append(i)
                        else:
                            index[new] = [i]
                            heapq.heappush(heap, new)
                        if new < rank:
                            waiting = word[i]
                h = before[i]
                if h >= 0:
                    new = pair(token[h] << shift | rank)
                    if new is not None:
                        if new in index:
                            index[new].append(h)
                        else:
                            index[new] = [h]
                            heapq.heappush(heap, new)
                        if new < rank:
                            waiting = word[i]
            if later:
                if rank not in index:
                    index[rank] = []
                    heapq.heappush(heap, rank)
                index[rank] += later
        return token

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        split = [self.pieces(t) if t else [] for t in texts]
        if len(self._known) > REMEMBERED:
            self._known, self._aside = {}, self._known
        known, aside = self._known, self._aside
        fresh = []
        for piece in set().union(*split).difference(known):
            ids = aside.pop(piece, None)
            if ids is None:
                fresh.append(piece)
            else:
                known[piece] = ids
        raw = [p.encode() for p in fresh]
        whole = [self.ranks.get(p) for p in raw]
        coded = iter(self.replay([p for p, rank in zip(raw, whole) if rank is None]))
        for piece, rank in zip(fresh, whole):
            known[piece] = next(coded) if rank is None else rank.to_bytes(4, "little")
        return [b"".join(map(known.__getitem__, pieces)) for pieces in split]


def _places(ranks: np.ndarray) -> dict[int, list[int]]:
    """The inverted index: places of every rank of 0 or more."""
    found = np.flatnonzero(ranks >= 0)
    order = found[np.argsort(ranks[found], kind="stable")]
    values, starts = np.unique(ranks[order], return_index=True)
    stops = np.append(starts[1:], len(order)).tolist()
    places = order.tolist()
    return {v: places[a:b] for v, a, b in zip(values.tolist(), starts.tolist(), stops)}


_codecs: list[MergeReplay] = []


def _codec(ranks: dict[bytes, int], pattern: str) -> MergeReplay:
    """The worker's codec of this vocabulary; the last one is kept for its next task."""
    if not _codecs or _codecs[0].ranks is not ranks or _codecs[0].pattern != pattern:
        _codecs[:] = [MergeReplay(ranks, pattern)]
    return _codecs[0]


class Vocabulary:
    """Token bytes by id as one run of bytes, so that ids turn into bytes without a loop."""

    def __init__(self, by_id: list[bytes]):
        self._data = np.frombuffer(b"".join(by_id), np.uint8)
        self.lengths = np.array([len(t) for t in by_id])
        self._starts = np.cumsum(self.lengths) - self.lengths

    def decode(self, ids: np.ndarray) -> bytes:
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.lengths) or not self.lengths[ids].all()):
            raise ValueError("an id is not in the vocabulary")
        return self.bytes_of(ids).tobytes()

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of known ids."""
        sizes = self.lengths[ids]
        ends = np.cumsum(sizes)
        places = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self._starts[ids] - ends + sizes, sizes)
        return self._data[places]


_vocabularies: list[tuple[dict[bytes, int], Vocabulary]] = []


def _vocabulary(ranks: dict[bytes, int]) -> Vocabulary:
    """The worker's decoder of this vocabulary; the last one is kept for its next task."""
    if not _vocabularies or _vocabularies[0][0] is not ranks:
        by_id = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            by_id[rank] = token
        _vocabularies[:] = [(ranks, Vocabulary(by_id))]
    return _vocabularies[0][1]


# What one pass over a text can add, with its type.
_PRODUCTS: dict[str, DataType] = {
    "ids": ArrayType(IntegerType()),
    "decoded": BinaryType(),
    "n_tokens": LongType(),
    "ids_sha256": StringType(),
    "decoded_sha256": StringType(),
}


def code(
    df: DataFrame, ranks: dict[bytes, int], pattern: str, products: dict[str, str], text: str = "text"
) -> DataFrame:
    """Encodes each whole text once and adds the asked products in that same pass: kind -> column.

    Kinds: ``ids`` (array<int>), ``decoded`` (the bytes of the ids), ``n_tokens``, ``ids_sha256`` (of the ids as
    little-endian unsigned 32-bit integers), ``decoded_sha256``.  ``text`` itself is dropped: a worker sends
    back only what is asked for.
    """
    for name in products.values():
        if name in df.columns:
            raise ValueError(f"the input has a column {name} already")
    small_batches(df.sparkSession)
    shipped = _ship(df.sparkSession, ranks)
    kept = [f for f in df.schema.fields if f.name != text]
    schema = StructType([*kept, *[StructField(name, _PRODUCTS[kind]) for kind, name in products.items()]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, vocabulary = _codec(shipped.value, pattern), _vocabulary(shipped.value)
        for whole in batches:
            for batch in steps(whole, text, STEP_BYTES):
                coded = codec.encode(batch.column(text).to_pylist())
                columns = [batch.column(f.name) for f in kept]
                columns += [_product(kind, coded, vocabulary) for kind in products]
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return df.mapInArrow(run, schema)


def _product(kind: str, coded: list[bytes], vocabulary: Vocabulary) -> pa.Array:
    if kind == "ids":
        return _id_lists(coded)
    if kind == "n_tokens":
        return pa.array([len(c) // 4 for c in coded], pa.int64())
    if kind == "ids_sha256":
        return pa.array([hashlib.sha256(c).hexdigest() for c in coded], pa.string())
    decoded = (vocabulary.decode(np.frombuffer(c, "<i4")) for c in coded)
    if kind == "decoded":
        return pa.array(decoded, pa.binary())
    return pa.array([hashlib.sha256(d).hexdigest() for d in decoded], pa.string())


def _id_lists(coded: list[bytes]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(c) // 4 for c in coded])])
    values = pa.array(np.frombuffer(b"".join(coded), "<i4"), pa.int32())
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)


def _with(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, values], [*batch.schema.names, name])


def _schema(df: DataFrame, name: str, kind: DataType) -> StructType:
    if name in df.columns:
        raise ValueError(f"the input has a column {name} already")
    return StructType([*df.schema.fields, StructField(name, kind)])


def encode(df: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """Adds ``ids``: the token ids of each whole text, array<int>."""
    shipped = _ship(df.sparkSession, ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shipped.value, pattern)
        for whole in batches:
            for batch in steps(whole, text, STEP_BYTES):
                yield _with(batch, ids, _id_lists(codec.encode(batch.column(text).to_pylist())))

    return df.mapInArrow(run, _schema(df, ids, ArrayType(IntegerType())))


def decode(df: DataFrame, ranks: dict[bytes, int], ids: str = "token_ids", decoded: str = "decoded") -> DataFrame:
    """Adds ``decoded``: the bytes of the ids; null ids give no bytes."""
    shipped = _ship(df.sparkSession, ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(shipped.value)
        for batch in batches:
            column = batch.column(ids)
            values = [vocabulary.decode(x.values.to_numpy()) if x.is_valid else b"" for x in column]
            yield _with(batch, decoded, pa.array(values, pa.binary()))

    return df.mapInArrow(run, _schema(df, decoded, BinaryType()))


def _ship(spark: SparkSession, ranks: dict[bytes, int]):
    """Broadcast of a vocabulary: its size is fixed by the rank file, not by the data."""
    return spark.sparkContext.broadcast(ranks)
