"""Token counts per section by offset-mapped attribution.

Every whole document is encoded once.  The byte lengths of its tokens give each token's byte span, the
lead bytes of the text turn byte offsets into character offsets, and the ordered token spans are joined
to the ordered section spans by interval search.  A section is a line with its line feed; an empty text
has one empty section.

A token that touches several sections is allocated by a named rule:
``start``: to the section of its first character; ``end``: to that of its last character;
``most``: to the section with most of its characters, the first of equals.
A token that covers part of a character counts as touching it.

A text whose runs of blanks are too long for the library's splitter (some hundred thousand) is split here by the
same pattern; its pieces are encoded one by one.

Rows: a null text has no section and gives no row.  Repeated ids give their rows repeatedly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, functions as F

from hearthmap.llm.bpe import read_ranks
from hearthmap.llm.words import raw, steps

RULES = ("start", "end", "most")
_SCHEMA = (
    "doc_id long, section long, char_start long, char_end long, n_tokens long, n_crossing long, doc_tokens long"
)


def token_bytes(encoding: tiktoken.Encoding, lengths: np.ndarray, text: str) -> np.ndarray:
    """Byte offsets of the token edges of a text, 0 first."""
    try:
        ids = encoding.encode_to_numpy(text, disallowed_special=())
    except ValueError:
        # the library's own splitter gives up on very long runs of blanks
        pieces = regex.compile(encoding._pat_str).findall(text)
        ids = np.array([i for piece in pieces for i in encoding._encode_single_piece(piece)], np.int64)
    return np.concatenate([[0], np.cumsum(lengths[ids])])


def allocate(edges: np.ndarray, lead: np.ndarray, sections: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens per section and tokens that touch the section and another one.

    ``edges``: byte offsets of the token edges; ``lead``: characters begun up to each byte offset;
    ``sections``: character offsets of the section edges.
    """
    n = len(sections) - 1
    start = lead[edges[:-1] + 1] - 1  # the character that the token's first byte lies in
    end = lead[edges[1:]]  # one after the character of its last byte
    first = np.clip(np.searchsorted(sections, start, "right") - 1, 0, n - 1)
    last = np.clip(np.searchsorted(sections, end - 1, "right") - 1, 0, n - 1)
    crossing = np.flatnonzero(first != last)
    chosen = last.copy() if rule == "end" else first.copy()
    touched = np.zeros(n + 1, np.int64)
    for t in crossing:
        touched[first[t]] += 1
        touched[last[t] + 1] -= 1
        if rule == "most":
            spans = np.arange(first[t], last[t] + 1)
            inside = np.minimum(sections[spans + 1], end[t]) - np.maximum(sections[spans], start[t])
            chosen[t] = spans[np.argmax(inside)]
    return np.bincount(chosen, minlength=n)[:n], np.cumsum(touched)[:n]


def section_tokens(documents: DataFrame, rank_file: str, pattern: str, rule: str = "start") -> DataFrame:
    """Per section: doc_id, section, char_start, char_end, n_tokens, n_crossing, doc_tokens."""
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    ranks = documents.sparkSession.sparkContext.broadcast(read_ranks(rank_file))  # fixed by the file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks.value, special_tokens={})
        lengths = np.zeros(max(ranks.value.values()) + 1, np.int64)
        for token, rank in ranks.value.items():
            lengths[rank] = len(token)
        for whole in batches:
            for batch in steps(whole):
                yield _count(batch, encoding, lengths, rule)

    rows = documents.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(run, _SCHEMA)


def _count(batch: pa.RecordBatch, encoding: tiktoken.Encoding, lengths: np.ndarray, rule: str) -> pa.RecordBatch:
    data, bounds = raw(batch.column("text"))
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    ids = batch.column("doc_id").to_pylist()
    columns: list[list[np.ndarray]] = [[] for _ in range(6)]
    sizes = []
    for i, text in enumerate(batch.column("text").to_pylist()):
        begin, stop = bounds[i], bounds[i + 1]
        chars = lead[begin : stop + 1] - lead[begin]
        feeds = np.flatnonzero(data[begin:stop] == 10) + 1
        sections = np.concatenate([[0], chars[feeds], [chars[-1]]])
        if len(feeds) and feeds[-1] == stop - begin:
            sections = sections[:-1]  # the last line is ended by its line feed
        tokens = token_bytes(encoding, lengths, text)
        if tokens[-1] != stop - begin:
            raise ValueError(f"the tokens of document {ids[i]} do not cover its text")
        counts, crossing = allocate(tokens, chars, sections, rule)
        n = len(counts)
        sizes.append(n)
        parts = (np.arange(n), sections[:-1], sections[1:], counts, crossing, np.full(n, len(tokens) - 1))
        for column, part in zip(columns, parts):
            column.append(part)
    owner = pa.array(np.repeat(np.arange(len(ids)), sizes))
    values = [pa.array(np.concatenate(c).astype(np.int64) if c else np.zeros(0, np.int64)) for c in columns]
    names = ["doc_id", "section", "char_start", "char_end", "n_tokens", "n_crossing", "doc_tokens"]
    return pa.RecordBatch.from_arrays([batch.column("doc_id").take(owner), *values], names)
