"""Language identification by a linear-chain conditional random field over words.

Every word is labelled, so code-switched text is resolved word by word; a document's language is the
label with the largest sum of posterior word probabilities, its score their mean.

Features of a word (A-Z folded, UTF-8 bytes): prefixes and suffixes of one to four bytes, byte bigrams
and trigrams, and the word itself (the lexicon).  They are hashed into ``BUCKETS`` weights per label.
Transition weights are learned with them: training sequences are spliced from two passages of different
documents, so that switches occur.  Posterior probabilities come from forward-backward, run over all
texts of a step at once, one word position at a time.

The model is fitted on a bounded sample: at most ``SAMPLE_TEXTS`` texts per language, those of the
smallest text hash, and ``SAMPLE_WORDS`` words of each from a place given by the hash.  Prediction reads
every word of every text.

Rows: a text that is null or has no letter is ``und`` with score 0.  Words without a letter do not vote.
Ties go to the first label in code point order.  Without labelled rows every text is ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window, functions as F

from hearthmap.llm.scratch import small_batches
from hearthmap.llm.words import RangeHash, find_words, lower_ascii, raw, steps

BUCKETS = 1 << 16
AFFIX = 4
NGRAMS = (2, 3)
SAMPLE_TEXTS = 400
SAMPLE_WORDS = 80
ROUNDS = 30
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray  # (buckets, labels)
    switch: np.ndarray  # (labels, labels)


@dataclass
class _Features:
    """Buckets of the features of each word: affixes and lexicon as a matrix, n-grams by byte position."""

    fixed: np.ndarray
    grams: list[np.ndarray]
    first: list[np.ndarray]
    after: list[np.ndarray]


def _features(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> _Features:
    hashed = RangeHash(data)
    bucket = lambda h, kind: ((h + np.uint64(kind)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(48)).astype(np.int32) % BUCKETS
    fixed = [bucket(hashed(start, end), 1)]
    for k in range(1, AFFIX + 1):
        fixed.append(bucket(hashed(start, np.minimum(start + k, end)), 10 + k))
        fixed.append(bucket(hashed(np.maximum(end - k, start), end), 20 + k))
    grams, first, after = [], [], []
    places = np.arange(len(data) + 1)
    for n in NGRAMS:
        at = places[: max(len(data) - n + 1, 0)]
        grams.append(bucket(hashed(at, at + n), 30 + n))
        first.append(np.minimum(start, len(at)))
        after.append(np.clip(end - n + 1, first[-1], len(at)))
    return _Features(np.stack(fixed, 1), grams, first, after)


def _emissions(features: _Features, weights: np.ndarray) -> np.ndarray:
    """Scores of the labels of each word."""
    scores = np.empty((len(features.fixed), weights.shape[1]))
    for label in range(weights.shape[1]):
        column = np.ascontiguousarray(weights[:, label])
        total = column[features.fixed].sum(1, dtype=np.float64)
        for grams, first, after in zip(features.grams, features.first, features.after):
            sums = np.concatenate([[0.0], np.cumsum(column[grams], dtype=np.float64)])
            total += sums[after] - sums[first]
        scores[:, label] = total
    return scores


class _Chains:
    """Layout of many sequences by word position: position t of all sequences that long is one block."""

    def __init__(self, counts: np.ndarray):
        order = np.argsort(-counts, kind="stable")
        rank = np.empty(len(counts), np.int64)
        rank[order] = np.arange(len(counts))
        longest = int(counts.max(initial=0))
        # sequences with more than t words
        alive = len(counts) - np.searchsorted(np.sort(counts), np.arange(longest), "right")
        self.blocks = np.concatenate([[0], np.cumsum(alive)])
        owner = np.repeat(np.arange(len(counts)), counts)
        within = np.arange(len(owner)) - np.repeat(np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
        self.place = self.blocks[within] + rank[owner]

    def posterior(self, scores: np.ndarray, switch: np.ndarray, pairs: np.ndarray | None = None) -> np.ndarray:
        """Posterior label probabilities of each word; adds expected label pairs to ``pairs``."""
        local = np.empty_like(scores)
        local[self.place] = np.exp(scores - scores.max(1, keepdims=True, initial=-np.inf))
        local += 1e-300
        step = np.exp(switch - switch.max())
        back = np.ascontiguousarray(step.T)
        forward, backward = np.empty_like(local), np.ones_like(local)
        edges = self.blocks.tolist()
        for t in range(len(edges) - 1):
            a, b = edges[t], edges[t + 1]
            now = local[a:b] if not t else (forward[edges[t - 1] : edges[t - 1] + b - a] @ step) * local[a:b]
            forward[a:b] = now / now.sum(1, keepdims=True)
        for t in range(len(edges) - 3, -1, -1):
            a, c, d = edges[t], edges[t + 1], edges[t + 2]
            coming = local[c:d] * backward[c:d]
            before = coming @ back
            total = before.sum(1, keepdims=True)
            backward[a : a + d - c] = before / total
            if pairs is not None:
                here = forward[a : a + d - c]
                joint = here[:, :, None] * step[None] * coming[:, None, :]
                pairs += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
        both = forward * backward
        both /= both.sum(1, keepdims=True)
        return both[self.place]


def fit(texts: list[tuple[str, list[str]]], labels: list[str]) -> Model:
    """Train on (language, words) in the given order, spliced two by two."""
    place = {label: i for i, label in enumerate(labels)}
    data = lower_ascii(np.frombuffer(" ".join(w for _, words in texts for w in words).encode(), np.uint8))
    found = find_words(data, np.array([0, len(data)]))
    counts = np.array([len(words) for _, words in texts])
    gold = np.repeat([place[lang] for lang, _ in texts], counts)
    joined = np.add.reduceat(counts, np.arange(0, len(counts), 2))
    chains = _Chains(joined)
    features = _features(data, found.start, found.end)
    n, k = len(gold), len(labels)
    wanted = np.eye(k)[gold]
    ends = np.cumsum(joined)[:-1] - 1
    inner = np.ones(n - 1, bool)
    inner[ends] = False
    seen = np.zeros((k, k))
    np.add.at(seen, (gold[:-1][inner], gold[1:][inner]), 1)
    grams = [
        (np.concatenate([g[a:b] for a, b in zip(first, after)]), np.repeat(np.arange(n), after - first))
        for g, first, after in zip(features.grams, features.first, features.after)
    ]
    flat = np.concatenate([features.fixed.ravel(), *[g for g, _ in grams]])
    words = np.concatenate([np.repeat(np.arange(n), features.fixed.shape[1]), *[w for _, w in grams]])
    weights, switch = np.zeros((BUCKETS, k)), np.zeros((k, k))
    squares, switch_squares = np.full_like(weights, 1e-8), np.full_like(switch, 1e-8)
    for _ in range(ROUNDS):
        expected = np.zeros((k, k))
        error = wanted - chains.posterior(_emissions(features, weights), switch, expected)
        slope = np.stack([np.bincount(flat, error[words, i], BUCKETS) for i in range(k)], 1)
        slope = slope / n - 1e-6 * weights
        squares += slope**2
        weights += 0.3 * slope / np.sqrt(squares)
        slope = (seen - expected) / n - 1e-6 * switch
        switch_squares += slope**2
        switch += 0.3 * slope / np.sqrt(switch_squares)
    return Model(labels, weights.astype(np.float32), switch)


def sample(labelled: DataFrame, texts: int = SAMPLE_TEXTS, words: int = SAMPLE_WORDS):
    """Bounded training sample of (text, lang) rows, in hash order: [(lang, words), ...].

    Repeated texts count once.  A first aggregate finds each language's hash limit, so that only about
    twice the texts wanted are ranked.
    """
    order = F.xxhash64("text")
    rows = labelled.where("text is not null and lang is not null").select("lang", "text", order.alias("h"))
    limits = rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n"))
    span = F.lit(2.0**64) * F.least(F.lit(1.0), 2 * texts / F.col("n") + 0.01)
    limits = limits.select(F.col("lang").alias("_lang"), (F.lit(-(2.0**63)) + span).alias("_limit"))
    # one row per language, which is one column of the model
    near = rows.join(F.broadcast(limits), F.col("lang") == F.col("_lang")).where(F.col("h") <= F.col("_limit"))
    once = near.groupBy("lang", "h").agg(F.min("text").alias("text"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    split = F.expr(r"regexp_extract_all(text, '([^\\x20\\x09-\\x0D]+)', 1)")
    picked = once.withColumn("_rank", rank).where(F.col("_rank") <= texts).withColumn("w", split)
    picked = picked.where(F.size("w") > 0)
    begin = F.pmod(F.xxhash64("h"), F.greatest(F.size("w") - words, F.lit(0)) + 1).cast("int") + 1
    found = picked.select("lang", "h", F.slice("w", begin, words).alias("w")).collect()  # bounded above
    found.sort(key=lambda r: (r["h"], r["lang"]))
    return [(r["lang"], list(r["w"])) for r in found]


def train(labelled: DataFrame) -> Model:
    found = sample(labelled)
    labels = sorted({lang for lang, _ in found})
    if not labels:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros((0, 0)))
    return fit(found, labels)


def _predict(batch: pa.RecordBatch, column: str, model: Model) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Label, score and certainty of each text."""
    data, bounds = raw(batch.column(column))
    data = lower_ascii(data)
    words = find_words(data, bounds)
    counts = np.diff(words.bounds)
    letter = ((data >= ord("a")) & (data <= ord("z"))) | (data >= 0x80)
    sums = np.concatenate([[0], np.cumsum(letter)])
    votes = (sums[words.end] > sums[words.start]).astype(np.float64)
    scores = _emissions(_features(data, words.start, words.end), model.weights)
    posterior = _Chains(counts).posterior(scores, model.switch) * votes[:, None]
    k = len(model.labels)
    total = np.stack([np.bincount(words.owner, posterior[:, i], len(counts)) for i in range(k)], 1)
    voters = np.bincount(words.owner, votes, len(counts))
    best = total.argmax(1)
    score = np.round(total.max(1) / np.maximum(voters, 1), 9)
    texts = batch.column(column).to_pylist()
    known = np.array([v > 0 and bool(_LETTER.search(t or "")) for v, t in zip(voters, texts)], bool)
    labels = [model.labels[b] if ok else UNKNOWN for b, ok in zip(best, known)]
    sure = np.bincount(words.owner, posterior.max(1, initial=0.0), len(counts)) / np.maximum(voters, 1)
    return labels, np.where(known, score, 0.0), np.where(known, sure, 0.0)


def identify(
    df: DataFrame,
    model: Model,
    text: str = "text",
    lang: str = "lang_pred",
    score: str = "score",
    certainty: str | None = None,
) -> DataFrame:
    """Adds the predicted language of each whole text and its score.

    ``certainty`` adds how well the labels explain the words: the mean over the words of the posterior of each
    word's best label.  A text in several languages has a low score and a high certainty.
    The model's size is fixed by ``BUCKETS`` and the number of languages, not by the data.
    """
    from pyspark.sql.types import StructType

    clash = {lang, score, certainty} & set(df.columns)
    if clash:
        raise ValueError(f"the input has columns {sorted(clash)} already")
    schema = StructType([f for f in df.schema.fields]).add(lang, "string").add(score, "double")
    if certainty is not None:
        schema = schema.add(certainty, "double")
    small_batches(df.sparkSession)
    shipped = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shipped.value
        for whole in batches:
            for batch in steps(whole, text):
                if fitted.labels:
                    labels, *scores = _predict(batch, text, fitted)
                else:
                    labels, scores = [UNKNOWN] * batch.num_rows, [np.zeros(batch.num_rows)] * 2
                columns = [*batch.columns, pa.array(labels, pa.string()), *[pa.array(s) for s in scores]]
                yield pa.RecordBatch.from_arrays(columns[: len(schema)], schema.names)

    return df.mapInArrow(run, schema)


def fold(doc_id: Column) -> Column:
    """Third of the documents that a row belongs to; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3
