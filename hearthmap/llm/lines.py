"""Line-first cleaning: rules per line, failed lines removed, documents that lose too much rejected.

A line (split at line feeds) fails when one of these holds:
* punctuation: its last word does not end in closing punctuation, or more than ``SYMBOL_PERCENT`` of its
  characters are symbols, or more than ``SHOUT_PERCENT`` of its words end in ``!!``;
* navigation: it has ``NAVIGATION_MARKS`` or more words that are mere separators (``|``, ``>``, ...);
* boilerplate: it has one of the ``BOILERPLATE`` phrases.
Lines without a word never fail.  A document is rejected when it loses more than ``LOST_PERCENT`` of its
words, or when its base figures fail (fewer than ``LEAST_WORDS`` words, or more than half of its words in
repeated three-word windows).

Rows: null and empty texts have no words and are rejected by the base rule.  Repeated ids are judged one
by one.  Empty table: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from hearthmap.llm.words import RangeHash, Words, find_words, mix, raw, steps, windows_hash

LEAST_WORDS = 50
REPEAT_PERCENT = 50
LOST_PERCENT = 30
SYMBOL_PERCENT = 10
SHOUT_PERCENT = 50
NAVIGATION_MARKS = 2
CLOSING = tuple(".!?:;,\"')]}…”’»。！？")
SEPARATOR_WORDS = ("|", ">", "»", "·", "•", "/", "::", "→")
BOILERPLATE = (
    "all rights reserved",
    "licensed under the",
    "released under the",
    "terms of use",
    "terms of service",
    "privacy policy",
    "cookie policy",
    "use cookies",
    "enable javascript",
    "sign up for our newsletter",
    "click here to",
    "lorem ipsum",
)
_BOILERPLATE_PATTERN = "|".join(BOILERPLATE)

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, n_lines long, n_failed_lines long, n_lost_words long, cleaned string"
)


def _per_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``values`` (one per byte) over each range of ``bounds``."""
    sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def _duplicates(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Flags: the value occurs more than once; it occurred earlier."""
    order = np.argsort(keys, kind="stable")
    same = np.zeros(len(keys) + 1, bool)
    same[1:-1] = keys[order][1:] == keys[order][:-1]
    several, earlier = np.empty(len(keys), bool), np.empty(len(keys), bool)
    several[order], earlier[order] = same[:-1] | same[1:], same[:-1]
    return several, earlier


def repeat_words(hashes: np.ndarray, words: Words, n_texts: int) -> np.ndarray:
    """Words of each text in three-word windows that occur twice or more in it."""
    owner = words.owner
    n = len(hashes) - 2
    marked = np.zeros(len(hashes), bool)
    if n > 0:
        inner = np.flatnonzero(owner[:n] == owner[2:])
        keys = mix(windows_hash(hashes, 3)[inner] ^ mix(owner[inner].astype(np.uint64) + np.uint64(1)))
        hit = inner[_duplicates(keys)[0]]
        for j in range(3):
            marked[hit + j] = True
    return np.bincount(owner[marked], minlength=n_texts)


class _Lines:
    """Lines of a run of texts: byte ranges, owners and the words in each."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, words: Words):
        feeds = np.flatnonzero(data == 10)
        # a text's lines start at its start and after its line feeds
        start = np.concatenate([bounds[:-1], feeds + 1])
        owner = np.concatenate([np.arange(len(bounds) - 1), np.searchsorted(bounds, feeds, "right") - 1])
        order = np.lexsort((start, owner))
        self.start, self.owner = start[order], owner[order]
        last = np.append(self.owner[1:] != self.owner[:-1], True) if len(self.owner) else np.zeros(0, bool)
        following = np.append(self.start[1:] - 1, 0) if len(self.owner) else self.start
        self.end = np.where(last, bounds[self.owner + 1], following)
        self.first_word = np.searchsorted(words.start, self.start)
        self.after_word = np.searchsorted(words.start, self.end)
        self.n_words = self.after_word - self.first_word


def _failed(data: np.ndarray, lines: _Lines, words: Words, boilerplate: np.ndarray) -> np.ndarray:
    """Flags of the lines with a word that fail a rule."""
    full = np.flatnonzero(lines.n_words)
    failed = np.zeros(len(lines.start), bool)
    if not len(full):
        return failed
    start, end, owner = lines.start[full], lines.end[full], lines.owner[full]
    last_word_end = words.end[lines.after_word[full] - 1]

    def ends_in(mark: str, at: np.ndarray) -> np.ndarray:
        tail = mark.encode()
        good = at >= len(tail)
        for j, byte in enumerate(tail):
            good &= data[np.maximum(at - len(tail) + j, 0)] == byte
        return good

    closed = np.zeros(len(full), bool)
    for mark in CLOSING:
        closed |= ends_in(mark, last_word_end)
    symbols = np.concatenate([[0], np.cumsum(_SYMBOL[data])])
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    noisy = 100 * (symbols[end] - symbols[start]) > SYMBOL_PERCENT * (chars[end] - chars[start])

    def share(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flags)])
        return sums[lines.after_word[full]] - sums[lines.first_word[full]]

    length = words.end - words.start
    loud = 100 * share(ends_in("!!", words.end) & (length >= 2)) > SHOUT_PERCENT * lines.n_words[full]
    marks = np.zeros(len(words.start), bool)
    for word in SEPARATOR_WORDS:
        marks |= ends_in(word, words.end) & (length == len(word.encode()))
    navigation = share(marks) >= NAVIGATION_MARKS
    failed[full] = ~closed | noisy | loud | navigation
    # the phrases are looked for in the lines of the few texts that have one
    for i in np.flatnonzero(boilerplate[owner]):
        line = data[start[i] : end[i]].tobytes().decode().lower()
        failed[full[i]] |= any(phrase in line for phrase in BOILERPLATE)
    return failed


def _judge(batch: pa.RecordBatch) -> pa.RecordBatch:
    data, bounds = raw(batch.column("text"))
    n = batch.num_rows
    words = find_words(data, bounds)
    n_words = np.diff(words.bounds)
    hashed = RangeHash(data)
    chars = (data & 0xC0) != 0x80
    in_word = np.zeros(len(data) + 1, np.int8)
    in_word[words.start] += 1
    np.add.at(in_word, words.end, -1)
    in_word = np.cumsum(in_word[:-1]).astype(bool)
    lines = _Lines(data, bounds, words)
    full = np.flatnonzero(lines.n_words)
    keys = mix(hashed(lines.start[full], lines.end[full]) ^ mix(lines.owner[full].astype(np.uint64)))
    n_dup = np.bincount(lines.owner[full][_duplicates(keys)[1]], minlength=n)
    n_repeat = repeat_words(hashed(words.start, words.end), words, n)
    has_phrase = pc.match_substring_regex(batch.column("text").fill_null(""), _BOILERPLATE_PATTERN, ignore_case=True)
    failed = _failed(data, lines, words, has_phrase.to_numpy(zero_copy_only=False))
    lost = np.bincount(lines.owner[failed], weights=lines.n_words[failed], minlength=n).astype(np.int64)
    n_failed = np.bincount(lines.owner[failed], minlength=n)
    base_failed = (n_words < LEAST_WORDS) | (100 * n_repeat > REPEAT_PERCENT * n_words)
    kept = ~base_failed & (100 * lost <= LOST_PERCENT * n_words)
    texts = batch.column("text").to_pylist()
    first_line = np.searchsorted(lines.owner, np.arange(n + 1))
    for i in np.flatnonzero(n_failed):
        here = range(first_line[i], first_line[i + 1])
        texts[i] = b"\n".join(
            data[lines.start[j] : lines.end[j]].tobytes() for j in here if not failed[j]
        ).decode()
    longs = (n_words, _per_text(chars & in_word, bounds), _per_text(_SYMBOL[data], bounds), n_dup, n_repeat)
    more = (np.bincount(lines.owner, minlength=n), n_failed, lost)
    as_long = lambda xs: [pa.array(x.astype(np.int64)) for x in xs]
    return pa.RecordBatch.from_arrays(
        [
            batch.column("doc_id"),
            *as_long(longs),
            pa.array(base_failed),
            pa.array(kept),
            *as_long(more),
            pa.array(texts, pa.string()),
        ],
        [field.strip().split()[0] for field in _SCHEMA.split(",")],
    )


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in steps(whole):
            yield _judge(batch)


def clean_lines(documents: DataFrame) -> DataFrame:
    """Per document: base figures, verdict, line counts and ``cleaned``, the text of the lines kept."""
    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(_clean, _SCHEMA)
