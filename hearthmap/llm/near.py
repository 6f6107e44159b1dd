"""Near-duplicate documents by MinHash.

128 universal hash minima per document, banded; every band group is compared with a leader and confirmed on
full shingle sets; components by alternating large-star and small-star.

Documents with equal sets form one class and only the class's smallest document is banded, so that
copies cost one row each.  A band group is never paired out: its members are compared with one leader,
those below the threshold are grouped again under a new leader, and so on.  Jaccard distance obeys the
triangle inequality, so a member x with similarity u to the leader can only be linked with a member y of
similarity s >= u when s - u <= 1 - threshold; just those pairs stay open, and only if x and y are not in
one component yet.  What is still left after ``ROUNDS`` leaders stays open within its band group, across
components only.  So every pair that shares a band and is linked ends up in one component.

Open pairs are bounded before they are formed.  A shingle that no other open document holds cannot be
common.  Let c of x's shingles be the leader's too and e of its others be held by other open documents:
x and y have at most min(c) + min(e) in common.  Copies that were changed apart from each other hold few
such others, so that a group of them needs few comparisons though each of its members is near many.

Two documents at the threshold of 0.75 share none of 32 bands of 4 minima with probability 5e-6.

Rows: null text, no word: empty set, linked with nothing.  Null id: linked with nothing, component null.
Rows that repeat an id count as one document.  Empty table: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from hearthmap.llm.components import components
from hearthmap.llm.scratch import Scratch
from hearthmap.llm.words import lower_ascii, mix, raw, shingle_sets, steps

BANDS, BAND_ROWS = 32, 4
# Linked: PERCENT * size of the union <= 100 * size of the intersection.
PERCENT = 75
# Leaders of a band group before the rest of the group is compared as it is.
ROUNDS = 3
# Share of equal minima below which two documents are not compared on their sets.  It is five standard
# deviations below a similarity of 0.5, the least that matters at a threshold of 0.75.
LEAST_AGREEMENT = 0.3
# The same for open pairs, where only links matter: five standard deviations below the threshold.
LEAST_LINKED = 0.55
# Broadcast a list of documents to compare up to this many ids (8 bytes each); beyond, shuffle it.
BROADCAST_IDS = 1_000_000

_random = np.random.default_rng(20_240_607)
_FACTORS = _random.integers(1, 2**63, BANDS * BAND_ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_TERMS = _random.integers(0, 2**63, BANDS * BAND_ROWS, np.uint64)

_SIGNATURE = "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>, minima binary"


def _minima(sets: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One row of minima per text that has shingles."""
    result = np.empty((len(first) - 1, len(_FACTORS)), np.uint64)
    for j, (a, b) in enumerate(zip(_FACTORS, _TERMS)):
        result[:, j] = np.minimum.reduceat(sets * a + b, first[:-1])
    return result


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in steps(whole):
            data, bounds = raw(batch.column("text"))
            sets, first = shingle_sets(lower_ascii(data), bounds)
            sizes = np.diff(first)
            full = np.flatnonzero(sizes)
            bands = minima = pa.nulls(batch.num_rows)
            sums = np.zeros((2, batch.num_rows), np.uint64)
            if len(full):
                filled = np.append(first[:-1][full], len(sets))
                lows = _minima(sets, filled)
                keys = np.zeros((len(full), BANDS), np.uint64)
                for j in range(BAND_ROWS):
                    keys = mix(keys ^ lows[:, j::BAND_ROWS])
                keys = mix(keys + np.arange(BANDS, dtype=np.uint64))
                sums[0, full] = np.add.reduceat(mix(sets + np.uint64(1)), filled[:-1])
                sums[1, full] = np.add.reduceat(mix(sets ^ np.uint64(0xA5A5A5A5A5A5A5A5)), filled[:-1])
                take = np.full(batch.num_rows, -1)
                take[full] = np.arange(len(full))
                index = pa.array(take, mask=take < 0)
                offsets = pa.array(np.arange(len(full) + 1, dtype=np.int32) * BANDS)
                bands = pa.ListArray.from_arrays(offsets, pa.array(keys.ravel().view(np.int64))).take(index)
                low = (lows & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                minima = pa.array([row.tobytes() for row in low], pa.binary()).take(index)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(sizes.astype(np.int64)),
                    pa.array(sums[0].view(np.int64)),
                    pa.array(sums[1].view(np.int64)),
                    bands.cast(pa.list_(pa.int64())),
                    minima.cast(pa.binary()),
                ],
                ["doc_id", "n_shingles", "set_a", "set_b", "bands", "minima"],
            )


def _agreement(least: float):
    """Pairs whose minima agree often enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                left, right = (
                    np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(batch.num_rows, -1)
                    for c in ("minima_a", "minima_b")
                )
                good = pa.array((left == right).mean(axis=1) >= least)
                yield batch.select(["a", "b"]).filter(good)

    return run


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, shingle) for every distinct shingle of every text."""
    for whole in batches:
        for batch in steps(whole):
            data, bounds = raw(batch.column("text"))
            sets, first = shingle_sets(lower_ascii(data), bounds)
            ids = batch.column("doc_id").take(pa.array(np.repeat(np.arange(batch.num_rows), np.diff(first))))
            yield pa.RecordBatch.from_arrays([ids, pa.array(sets.view(np.int64))], ["doc_id", "shingle"])


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sizes of the intersection and union of the shingle sets of each pair."""
    for whole in batches:
        for batch in steps(whole, "text_b"):
            sets = []
            for column in ("text_a", "text_b"):
                data, bounds = raw(batch.column(column))
                sets.append(shingle_sets(lower_ascii(data), bounds))
            (a, a0), (b, b0) = sets
            common = np.array(
                [
                    len(np.intersect1d(a[a0[i] : a0[i + 1]], b[b0[i] : b0[i + 1]], assume_unique=True))
                    for i in range(batch.num_rows)
                ],
                np.int64,
            )
            union = np.diff(a0) + np.diff(b0) - common
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b"), pa.array(common), pa.array(union.astype(np.int64))],
                ["a", "b", "common", "union"],
            )


class _Comparison:
    """Compares pairs of class leaders by signature, then on the full sets of their texts."""

    def __init__(self, signatures: DataFrame, documents: DataFrame, scratch: Scratch):
        self.signatures, self.documents, self.scratch = signatures, documents, scratch

    @staticmethod
    def _only(wanted: DataFrame):
        """Cuts rows down to the wanted ids: a short list of ids goes to the rows, else the rows to the ids."""
        few = wanted.count() <= BROADCAST_IDS
        return lambda rows: rows.join(F.broadcast(wanted) if few else wanted, "doc_id", "left_semi")

    def shared(self, ids: DataFrame) -> DataFrame:
        """(doc_id, n, held): number of shingles, and of those that another document of ``ids`` holds; written."""
        wanted = self.scratch.write(ids.distinct())
        only = self._only(wanted)
        shingles = only(self.documents).distinct().mapInArrow(_shingles, "doc_id long, shingle long")
        single = shingles.groupBy("shingle").agg(F.count("*").alias("times"), F.min("doc_id").alias("doc_id"))
        single = single.where("times = 1").groupBy("doc_id").agg(F.count("*").alias("single"))
        sizes = only(self.signatures).groupBy("doc_id").agg(F.min("n_shingles").alias("n"))
        held = F.col("n") - F.coalesce("single", F.lit(0))
        result = self.scratch.write(sizes.join(single, "doc_id", "left").select("doc_id", "n", held.alias("held")))
        self.scratch.drop(wanted)
        return result

    def __call__(self, pairs: DataFrame, least: float = LEAST_AGREEMENT) -> DataFrame:
        """Rows (a, b, common, union) of those pairs whose signatures agree; written."""
        pairs = self.scratch.write(pairs)
        wanted = self.scratch.write(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
        only = self._only(wanted)
        minima = only(self.signatures).select("doc_id", "minima")
        signed = pairs.join(minima.toDF("a", "minima_a"), "a").join(minima.toDF("b", "minima_b"), "b")
        near = signed.mapInArrow(_agreement(least), "a long, b long").distinct()
        texts = self.scratch.write(only(self.documents).distinct())
        paired = near.join(texts.toDF("a", "text_a"), "a").join(texts.toDF("b", "text_b"), "b")
        schema = "a long, b long, common long, union long"
        result = self.scratch.write(paired.mapInArrow(_overlaps, schema).distinct())
        self.scratch.drop(pairs, wanted, texts)
        return result


def _linked(overlaps: DataFrame, percent: int) -> DataFrame:
    return overlaps.where(100 * F.col("common") >= percent * F.col("union")).select("a", "b")


def near_duplicates(documents: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Per row of ``documents`` (doc_id, text): doc_id, n_shingles, component_id, kept."""
    scratch = Scratch(documents.sparkSession)
    documents = documents.select(F.col("doc_id").cast("long"), "text")
    signatures = scratch.write(documents.mapInArrow(_signatures, _SIGNATURE))
    full = signatures.where("n_shingles > 0 and doc_id is not null")
    classes = scratch.write(
        full.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    )
    copies = scratch.write(
        full.select("doc_id", "set_a", "set_b")
        .join(classes.where("n > 1"), ["set_a", "set_b"])
        .select(F.col("first").alias("a"), F.col("doc_id").alias("b"))
    )
    leaders = full.join(
        classes.select("set_a", "set_b", F.col("first").alias("doc_id")), ["set_a", "set_b", "doc_id"], "left_semi"
    )
    banded = leaders.select(F.explode("bands").alias("band"), "doc_id")
    shared = scratch.write(_several(banded))
    members = scratch.write(banded.join(shared, "band").distinct())
    scratch.drop(shared)

    compare = _Comparison(signatures, documents, scratch)
    links = copies.where("a <> b")
    stars, left = [], members
    while len(stars) < ROUNDS:
        star, left = _star(left, compare, percent, scratch)
        stars.append(star)
        links = links.unionAll(_linked(star, percent))
        if left.isEmpty():
            break
    roots = scratch.write(components(links, scratch))
    across = _across(stars, left, roots, percent, compare, scratch)
    more = _linked(compare(across, LEAST_LINKED), percent)
    if not more.isEmpty():
        roots = scratch.write(components(links.unionAll(more), scratch))
    known = signatures.select("doc_id", "n_shingles")
    result = scratch.write(
        known.join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(
            "doc_id",
            "n_shingles",
            F.coalesce("root", "doc_id").alias("component_id"),
            F.col("doc_id").eqNullSafe(F.coalesce("root", "doc_id")).alias("kept"),
        )
    )
    scratch.keep(result)
    return result


def _several(members: DataFrame) -> DataFrame:
    """Bands with more than one document."""
    ends = members.groupBy("band").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    return ends.where("low < high").select("band")


def _leaders(members: DataFrame) -> DataFrame:
    """(band, a): the member that meets most others over all its bands, the smallest of equals.

    Copies that were each changed apart are nearer to what they were made from than to each other; the
    common original meets most of them.
    """
    sizes = members.groupBy("band").agg(F.count("*").alias("n"))
    reach = members.join(sizes, "band").groupBy("doc_id").agg(F.sum("n").alias("reach"))
    best = F.max(F.struct("reach", (-F.col("doc_id")).alias("less"))).alias("best")
    return members.join(reach, "doc_id").groupBy("band").agg(best).select("band", (-F.col("best.less")).alias("a"))


def _star(members: DataFrame, compare: _Comparison, percent: int, scratch: Scratch):
    """Compare band groups with their leaders.

    Returns (band, a: leader, b: member, common, union) for all members, with nulls where the signatures
    already differ, and the members (band, doc_id, leader, common) to be grouped again.
    """
    members = members.select("band", "doc_id")
    grouped = members.join(_leaders(members), "band").where("a <> doc_id").withColumnRenamed("doc_id", "b")
    overlaps = compare(grouped.select("a", "b").distinct())
    star = scratch.write(grouped.join(overlaps, ["a", "b"], "left"))
    low = star.where(~F.coalesce(100 * F.col("common") >= percent * F.col("union"), F.lit(False)))
    low = low.select("band", F.col("b").alias("doc_id"), F.col("a").alias("leader"), "common")
    left = scratch.write(low.join(_several(low), "band"))
    return star, left


def _across(
    stars: list[DataFrame], left: DataFrame, roots: DataFrame, percent: int, compare: _Comparison, scratch: Scratch
) -> DataFrame:
    """Pairs that the leaders' comparisons leave open, in different components.

    All high members of a band group are in its leader's component, so only low members of other
    components meet them.
    """
    lows, highs = None, None
    for number, star in enumerate(stars):
        # no share: too few equal minima for one that matters
        share = F.col("common") / F.col("union")
        high = F.coalesce(100 * F.col("common") >= percent * F.col("union"), F.lit(False))
        known = star.select(F.lit(number).alias("star"), "band", "a", "b", "common", share.alias("share"), high.alias("high"))
        low = _apart(known.where(~F.col("high") & (F.col("share") >= 2 * percent / 100 - 1)), roots).drop("high")
        lows = low if lows is None else lows.unionAll(low)
        highs = known if highs is None else highs.unionAll(known)
    group = ["star", "band"]
    lows = scratch.write(lows)
    highs = scratch.write(highs.where("high").drop("high").join(lows.select(group).distinct(), group, "left_semi"))
    # what is left of a band group that lies in one component has nothing open
    rooted = left.join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    rooted = rooted.withColumn("root", F.coalesce("root", "doc_id"))
    ends = rooted.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    rest = scratch.write(rooted.join(ends.where("low < high").select("band"), "band"))

    # documents that take part, with the leaders, so that what a member has from its leader counts as held
    ids = lambda table, *names: table.select(F.explode(F.array(*names)).alias("doc_id"))
    shared = compare.shared(ids(lows, "a", "b").unionAll(ids(highs, "b")).unionAll(ids(rest, "doc_id", "leader")))
    extra = F.col("held") - F.col("common")

    def possible(common, sizes):
        """Whether so many common shingles suffice for a link of sets whose sizes have this sum."""
        return (100 + percent) * common >= percent * sizes

    low = lows.join(shared.withColumnRenamed("doc_id", "b"), "b").withColumn("extra", extra)
    high = highs.join(shared.withColumnRenamed("doc_id", "b"), "b").withColumn("extra", extra)
    best = high.groupBy(group).agg(F.max("extra").alias("most"), F.min("n").alias("least_n"))
    low = low.join(best, group).where(
        possible(F.col("common") + F.least("extra", "most"), F.col("n") + F.col("least_n"))
    )
    x, y = low.alias("x"), high.select(*group, "b", "common", "share", "n", "extra").alias("y")
    meet = (F.col("x.star") == F.col("y.star")) & (F.col("x.band") == F.col("y.band"))
    meet &= F.col("y.share") - F.col("x.share") <= 1 - percent / 100 + 1e-9
    together = F.least("x.common", "y.common") + F.least("x.extra", "y.extra")
    meet &= possible(together, F.col("x.n") + F.col("y.n"))
    met = x.join(y, meet).select(F.col("x.b").alias("a"), F.col("y.b").alias("b"))

    sized = rest.join(shared, "doc_id")
    least = sized.groupBy("band").agg(F.min("n").alias("least_n"))
    sized = sized.join(least, "band").where(possible(F.col("held"), F.col("n") + F.col("least_n")))
    x, y = (sized.withColumn("extra", extra).alias(side) for side in ("x", "y"))
    meet = (F.col("x.band") == F.col("y.band")) & (F.col("x.root") < F.col("y.root"))
    # all members of a band group had one last leader; where a share is not known, so is what comes from it
    by_leader = F.least("x.common", "y.common") + F.least("x.extra", "y.extra")
    by_leader = F.when(F.col("x.common").isNotNull() & F.col("y.common").isNotNull(), by_leader)
    meet &= possible(F.coalesce(by_leader, F.least("x.held", "y.held")), F.col("x.n") + F.col("y.n"))
    met = met.unionAll(x.join(y, meet).select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b")))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows whose ``a`` and ``b`` are in different components."""
    of = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    pairs = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return pairs.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).drop("root_a", "root_b")
