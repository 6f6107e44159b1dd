"""Fill-in-the-middle: texts cut in three and reordered, the cuts found in a Fenwick tree of block counts.

A text is a run of units (``char``: code points, ``word``: a word with the blanks after it, ``line``: a line
with its line feed).  Two cuts, given as numbers of units, make a prefix, a middle and a suffix.  The texts of
one step are laid out as fixed blocks of ``BLOCK`` bytes (the last block of a text may be shorter); a Fenwick
tree holds the units and the code points that begin in each block.  A cut is found by binary lifting down the
tree, which ends at the block that holds the unit, and then inside that block alone; the code points before the
cut are a prefix sum of the same tree and a count inside the block.  All cuts of a step descend together, so a
cut costs the depth of the tree and one block, however long the text is.

Forms: ``plain`` (the text itself), ``psm`` (prefix, suffix, middle) and ``spm`` (suffix, prefix, middle), each
part after its mark.  Marks must not occur in the text, so such a text stays plain and every output can be
taken apart again (:func:`restored`).

Draws come from a digest of a seed and the id, so that reruns agree: the cuts from the first two numbers, plain
or not from the third, the order from the fourth.

Rows: a null text counts as empty, and an empty one is plain with n = 0.  A null id draws as the empty string
does.  Repeated rows give equal rows; other columns are dropped.  Empty table: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from hearthmap.llm.words import find_words, raw, steps

BLOCK = 512
PREFIX, SUFFIX, MIDDLE = MARKS = ("<P>", "<S>", "<M>")
REORDERED_PERCENT = 90
SUFFIX_FIRST_PERCENT = 20
SEED = "1"
UNITS = ("char", "word", "line")
_DRAWS = ("h1", "h2", "h3", "h4")
_SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


class Fenwick:
    """Prefix sums over fixed blocks; ``descend`` finds the block that holds a given unit."""

    def __init__(self, counts: np.ndarray):
        n = len(counts)
        places = np.arange(1, n + 1)
        sums = np.concatenate([[0], np.cumsum(counts)])
        self.tree = np.concatenate([[0], sums[places] - sums[places - (places & -places)]])
        self._top = 1 << max(n.bit_length() - 1, 0)

    def before(self, block: np.ndarray) -> np.ndarray:
        """Sum over the blocks before each given one."""
        at, total = block.copy(), np.zeros(len(block), np.int64)
        while at.any():
            total += self.tree[at]
            at -= at & -at
        return total

    def descend(self, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Block that holds the unit of each 0-based rank, and the rank inside that block."""
        at, left = np.zeros(len(rank), np.int64), rank.copy()
        step = self._top
        while step:
            to = at + step
            fits = to < len(self.tree)
            here = self.tree[np.where(fits, to, 0)]
            go = fits & (here <= left)
            at, left = np.where(go, to, at), left - np.where(go, here, 0)
            step >>= 1
        return at, left


def unit_starts(data: np.ndarray, bounds: np.ndarray, unit: str) -> np.ndarray:
    """Flags of the bytes that a unit begins at; a text that is not empty begins with one."""
    if unit == "char":
        return (data & 0xC0) != 0x80
    flags = np.zeros(len(data) + 1, bool)
    if unit == "word":
        words = find_words(data, bounds)
        first = words.bounds[:-1][np.diff(words.bounds) > 0]
        flags[np.delete(words.start, first)] = True  # blanks before a text's first word belong to its unit
    else:
        feeds = np.flatnonzero(data == 10) + 1
        flags[np.setdiff1d(feeds, bounds)] = True
    flags[bounds[:-1]] = True
    flags[bounds[-1]] = False
    empty = bounds[:-1] == bounds[1:]
    starts = bounds[:-1][empty]
    # the start of an empty text is a unit only where it is the start of a longer one as well
    flags[np.setdiff1d(starts, bounds[:-1][~empty])] = False
    return flags[:-1]


@dataclass
class Cutter:
    """Cut places of the texts of one step."""

    bounds: np.ndarray
    n_units: np.ndarray

    def __init__(self, data: np.ndarray, bounds: np.ndarray, unit: str):
        self.bounds = bounds
        sizes = np.diff(bounds)
        n_blocks = -(-sizes // BLOCK)
        self._first = np.concatenate([[0], np.cumsum(n_blocks)])
        owner = np.repeat(np.arange(len(sizes)), n_blocks)
        self._start = bounds[owner] + BLOCK * (np.arange(len(owner)) - self._first[owner])
        self._units = unit_starts(data, bounds, unit)
        self._chars = self._units if unit == "char" else unit_starts(data, bounds, "char")
        self.units = Fenwick(self._per_block(self._units))
        self.chars = self.units if unit == "char" else Fenwick(self._per_block(self._chars))
        base = self.units.before(self._first)
        self._base, self.n_units = base[:-1], np.diff(base)

    def _per_block(self, flags: np.ndarray) -> np.ndarray:
        return np.add.reduceat(flags, self._start, dtype=np.int64) if len(self._start) else np.zeros(0, np.int64)

    def cut(self, text: np.ndarray, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte place after the first ``units`` units of each given text, and the code points before it."""
        place, chars = self.bounds[text + 1].copy(), np.zeros(len(text), np.int64)
        inner = np.flatnonzero(units < self.n_units[text])
        block, left = self.units.descend(self._base[text[inner]] + units[inner])
        size = len(self._units)
        # inside the block: its bytes as one row, at most BLOCK of them
        for some in np.array_split(np.arange(len(inner)), max(1, len(inner) * BLOCK // 4_000_000)):
            cells = self._start[block[some]][:, None] + np.arange(BLOCK)
            inside = self._units[np.minimum(cells, size - 1)]
            nth = inside & (np.cumsum(inside, 1) == left[some, None] + 1)
            at = nth.argmax(1)
            place[inner[some]] = self._start[block[some]] + at
            held = self._chars[np.minimum(cells, size - 1)] & (np.arange(BLOCK) < at[:, None])
            chars[inner[some]] = held.sum(1)
        chars[inner] += self.chars.before(block)
        whole = np.flatnonzero(units >= self.n_units[text])
        chars[whole] = self.chars.before(self._first[text[whole] + 1])
        return place, chars - self.chars.before(self._first[text])


def _cut_step(batch: pa.RecordBatch, unit: str) -> pa.RecordBatch:
    data, bounds = raw(batch.column("text"))
    cutter = Cutter(data, bounds, unit)
    n = cutter.n_units
    h1, h2, h3, h4 = (batch.column(h).to_numpy() for h in _DRAWS)
    everyone = np.arange(batch.num_rows)
    low, low_chars = cutter.cut(everyone, np.minimum(h1 % (n + 1), h2 % (n + 1)))
    high, high_chars = cutter.cut(everyone, np.maximum(h1 % (n + 1), h2 % (n + 1)))
    content = data.tobytes()
    p, s, m = (mark.encode() for mark in MARKS)
    forms, outputs = [], []
    for a, x, y, b, third, fourth in zip(bounds[:-1].tolist(), low.tolist(), high.tolist(), bounds[1:].tolist(), h3 % 100, h4 % 100):
        text = content[a:b]
        if not text or third >= REORDERED_PERCENT or any(mark in text for mark in (p, s, m)):
            forms.append("plain")
            outputs.append(text)
        elif fourth < SUFFIX_FIRST_PERCENT:
            forms.append("spm")
            outputs.append(b"".join([s, content[y:b], p, content[a:x], m, content[x:y]]))
        else:
            forms.append("psm")
            outputs.append(b"".join([p, content[a:x], s, content[y:b], m, content[x:y]]))
    plain = np.array([f == "plain" for f in forms], bool)
    return pa.RecordBatch.from_arrays(
        [
            batch.column("doc_id"),
            pa.array(n.astype(np.int64)),
            pa.array(forms, pa.string()),
            pa.array(low_chars, pa.int64(), mask=plain),
            pa.array(high_chars - low_chars, pa.int64(), mask=plain),
            pa.array(outputs, pa.binary()).cast(pa.string()),
        ],
        [field.split()[0] for field in _SCHEMA.split(", ")],
    )


def draws(doc_id: Column, seed: str = SEED) -> list[Column]:
    """Four numbers below 2**32 from the digest of ``seed:id``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(h) for i, h in enumerate(_DRAWS)]


def fill_in_middle(documents: DataFrame, unit: str = "char", seed: str = SEED) -> DataFrame:
    """Per document: doc_id, n (units), form, prefix_chars and middle_chars (null if plain), output."""
    if unit not in UNITS:
        raise ValueError(f"unit is one of {UNITS}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in steps(whole):
                yield _cut_step(batch, unit)

    doc_id = F.col("doc_id").cast("long")
    return documents.select(doc_id.alias("doc_id"), "text", *draws(doc_id, seed)).mapInArrow(run, _SCHEMA)


def restored(output: Column, form: Column) -> Column:
    """The exact text of an output: marks occur once each in outputs that are not plain."""
    part = lambda c, mark, i: F.split_part(c, F.lit(mark), F.lit(i))
    last = part(output, MIDDLE, 2)
    prefix = {"psm": part(part(output, SUFFIX, 1), PREFIX, 2), "spm": part(part(output, MIDDLE, 1), PREFIX, 2)}
    suffix = {"psm": part(part(output, MIDDLE, 1), SUFFIX, 2), "spm": part(part(output, PREFIX, 1), SUFFIX, 2)}
    whole = {f: F.concat(prefix[f], last, suffix[f]) for f in prefix}
    return F.when(form == "psm", whole["psm"]).when(form == "spm", whole["spm"]).otherwise(output)
