"""Near-duplicate vectors by PCA-ordered tiled comparison.

Vectors are scaled to length one and turned so that their dimensions are in order of variance (eigenvectors
of the summed outer products).  They are sorted by the first of these and packed into tiles of bounded
bytes.  A pair of tiles is skipped when their first dimensions are too far apart.  Inside a pair of tiles
products are added up a few leading dimensions at a time; the products of the rest are bounded by the
norms of the two suffixes, and the comparison stops when no pair can reach the threshold any more, or
goes on with just the pairs that can.  Those left are confirmed by the cosine of the given vectors in
double precision.

Equal vectors form one class that is compared once, weighted by its size.  A pair of tiles returns, per
linked class, the number of linked rows and one edge to its local component, never all pairs.

Rows: vectors that are null, empty, zero or hold a null or non-finite component link with nothing, and so
do rows without id; vectors of different length do not link.  Vectors that repeat an id share its links
and component.  Empty table: no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from hearthmap.llm.components import components
from hearthmap.llm.scratch import Scratch

THRESHOLD = 0.9
# Bytes of the double-precision vectors of one tile.
TILE_BYTES = 2_000_000
LEADING = 16
ROWS_AT_ONCE = 1024
# Share of open pairs below which they are finished one by one.
FEW = 0.02
_SLACK = 1e-9


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


def _outer_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Summed outer products of the unit vectors by dimension count, one row per cell."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        size = np.asarray(batch.column("size"))
        for d in np.unique(size).tolist():
            rows = batch.filter(pa.array(size == d))
            unit = _unit(_matrix(rows.column("vector"), rows.num_rows))
            sums[d] = sums.get(d, 0) + unit.T @ unit
    for d, total in sums.items():
        cells = pa.array(np.arange(d * d))
        yield pa.RecordBatch.from_arrays([pa.array([d] * (d * d), pa.int64()), cells, pa.array(total.ravel())], ["size", "cell", "value"])


def _unit(vectors: np.ndarray) -> np.ndarray:
    # scaled first, so that no square overflows or vanishes
    scaled = vectors / np.abs(vectors).max(1, keepdims=True)
    return scaled / np.sqrt((scaled**2).sum(1, keepdims=True))


def rotations(classes: DataFrame) -> dict[int, np.ndarray]:
    """By dimension count: eigenvectors in order of falling eigenvalue (d x d numbers on the driver)."""
    cells = classes.select("vector", "size").mapInArrow(_outer_sums, "size long, cell long, value double")
    sums: dict[int, np.ndarray] = {}
    for row in cells.groupBy("size", "cell").agg(F.sum("value").alias("value")).toLocalIterator():
        sums.setdefault(row["size"], np.zeros(row["size"] ** 2))[row["cell"]] = row["value"]
    return {d: np.linalg.eigh(s.reshape(d, d))[1][:, ::-1] for d, s in sums.items()}


def _first_axis(turn: dict[int, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.asarray(batch.column("size"))
            for d in np.unique(size).tolist():
                rows = batch.filter(pa.array(size == d))
                along = _unit(_matrix(rows.column("vector"), rows.num_rows)) @ turn[d][:, 0]
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(along)], [*rows.schema.names, "along"])

    return run


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one partition, sorted, to tiles of bounded bytes."""
    size, held, bytes_held = None, [], 0

    def tile() -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        along = table["along"].to_numpy()
        return pa.RecordBatch.from_arrays(
            [
                pa.array([size], pa.int64()),
                pa.array([along.min()]),
                pa.array([along.max()]),
                *[pa.array([table[c].to_numpy().astype("<i8").tobytes()], pa.binary()) for c in ("id", "n")],
                pa.array([table["vector"].combine_chunks().flatten().to_numpy().astype("<f8").tobytes()], pa.binary()),
            ],
            ["size", "low", "high", "ids", "counts", "vectors"],
        )

    for batch in batches:
        at = 0
        sizes = np.asarray(batch.column("size"))
        while at < batch.num_rows:
            d = int(sizes[at])
            if held and (d != size or bytes_held >= TILE_BYTES):
                yield tile()
                held, bytes_held = [], 0
            size = d
            other = np.flatnonzero(sizes[at:] != d)
            same = int(other[0]) if len(other) else batch.num_rows - at
            room = max(1, (TILE_BYTES - bytes_held) // (8 * d))
            take = min(same, room)
            held.append(batch.slice(at, take))
            bytes_held += take * 8 * d
            at += take
    if held:
        yield tile()


def _close(a: np.ndarray, b: np.ndarray, turn: np.ndarray, least: float) -> np.ndarray:
    """Boolean matrix: pairs of rows whose cosine reaches ``least``."""
    d = a.shape[1]
    ua, ub = _unit(a), _unit(b)
    ta, tb = ua @ turn, ub @ turn
    rest = lambda t: np.sqrt(np.maximum(np.cumsum((t**2)[:, ::-1], 1)[:, ::-1], 0))
    ra, rb = rest(ta), rest(tb)
    result = np.zeros((len(a), len(b)), bool)
    for begin in range(0, len(a), ROWS_AT_ONCE):
        rows = slice(begin, min(begin + ROWS_AT_ONCE, len(a)))
        product = np.zeros((rows.stop - begin, len(b)))
        i = j = np.zeros(0, np.int64)
        for k in range(0, d, LEADING):
            product += ta[rows, k : k + LEADING] @ tb[:, k : k + LEADING].T
            bound = product
            if k + LEADING < d:
                bound = product + np.outer(ra[rows, k + LEADING], rb[:, k + LEADING])
            open_pairs = bound >= least - _SLACK
            count = np.count_nonzero(open_pairs)
            if count <= FEW * open_pairs.size or k + LEADING >= d:
                i, j = np.nonzero(open_pairs)
                break
        for part in range(0, len(i), 200_000):
            x, y = i[part : part + 200_000] + begin, j[part : part + 200_000]
            cosine = np.einsum("ij,ij->i", ua[x], ub[y])
            good = cosine >= least
            result[x[good], y[good]] = True
    return result


def _labels(close: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Component numbers of the rows and columns of a boolean matrix, by spreading the least number."""
    n, m = close.shape
    rows = np.arange(n)
    columns = rows.copy() if same else np.arange(n, n + m)
    none = n + m
    while True:
        before = rows.copy(), columns.copy()
        for at in range(0, n, ROWS_AT_ONCE):
            part = slice(at, at + ROWS_AT_ONCE)
            seen = np.where(close[part], columns[None], none).min(1, initial=none)
            rows[part] = np.minimum(rows[part], seen)
            back = np.where(close[part], rows[part, None], none).min(0, initial=none)
            columns = np.minimum(columns, back)
        if same:
            rows = columns = np.minimum(rows, columns)
        if np.array_equal(before[0], rows) and np.array_equal(before[1], columns):
            return rows, columns


def _compare(turn: dict[int, np.ndarray], least: float):
    def tile(row: dict, side: str):
        ids = np.frombuffer(row[f"ids_{side}"], "<i8")
        counts = np.frombuffer(row[f"counts_{side}"], "<i8")
        return ids, counts, np.frombuffer(row[f"vectors_{side}"], "<f8").reshape(len(ids), -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                same = row["a"] == row["b"]
                ids, counts, a = tile(row, "a")
                other_ids, other_counts, b = tile(row, "b")
                close = _close(a, b, turn[row["size"]], least)
                if same:
                    np.fill_diagonal(close, False)
                x, y = np.flatnonzero(close.any(1)), np.flatnonzero(close.any(0))
                if not len(x):
                    continue
                close = close[np.ix_(x, y)]
                left, right = _labels(close, same)
                nodes, links = ids[x], close @ other_counts[y]
                label = left
                if not same:
                    nodes = np.concatenate([nodes, other_ids[y]])
                    links = np.concatenate([links, counts[x] @ close])
                    label = np.concatenate([left, right])
                root = np.full(len(x) + len(y) + 1, np.iinfo(np.int64).max)
                np.minimum.at(root, label, nodes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(nodes), pa.array(links.astype(np.int64)), pa.array(root[label])], ["a", "links", "b"]
                )

    return run


def near_vectors(embeddings: DataFrame, least: float = THRESHOLD) -> DataFrame:
    """Per row of (vec_id, embedding): vec_id, n_links, component_id, kept."""
    spark = embeddings.sparkSession
    scratch = Scratch(spark)
    vector = F.col("embedding").cast("array<double>")
    sound = (F.size("vector") > 0) & F.forall(
        "vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    )
    sound &= F.exists("vector", lambda x: x != 0) & F.col("vec_id").isNotNull()
    rows = embeddings.select(F.col("vec_id").cast("long"), vector.alias("vector"))
    rows = rows.withColumn("sound", F.coalesce(sound, F.lit(False)))
    classes = scratch.write(
        rows.where("sound").groupBy("vector").agg(F.min("vec_id").alias("id"), F.count("*").alias("n"))
        .withColumn("size", F.size("vector").cast("long"))
    )
    turn = rotations(classes)
    total = classes.agg(F.sum(8 * F.col("size")).alias("bytes")).first()["bytes"] or 0
    parts = max(1, math.ceil(total / TILE_BYTES))
    ordered = classes.mapInArrow(_first_axis(turn), "vector array<double>, id long, n long, size long, along double")
    ordered = ordered.repartitionByRange(parts, "size", "along", F.xxhash64("id")).sortWithinPartitions("size", "along")
    tiles = scratch.write(
        ordered.mapInArrow(_pack, "size long, low double, high double, ids binary, counts binary, vectors binary")
        .withColumn("tile", F.monotonically_increasing_id())
    )
    reach = math.sqrt(max(0.0, 2 - 2 * least)) + _SLACK
    close = _tile_pairs(tiles, reach, scratch)
    side = lambda s: tiles.select(
        F.col("tile").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("ids", "counts", "vectors")]
    )
    compared = close.join(side("a"), "a").join(side("b"), "b")
    found = scratch.write(compared.mapInArrow(_compare(turn, least), "a long, links long, b long"))
    links = found.groupBy("a").agg(F.sum("links").alias("links"))
    roots = components(found.select("a", "b"), scratch)

    copies = rows.where("sound").join(classes.where("n > 1").select("vector", "id", "n"), "vector")
    # by class: rows in it, linked rows of other classes, component
    facts = scratch.write(
        classes.groupBy("id").agg(F.max("n").alias("n"))
        .join(links.withColumnRenamed("a", "id"), "id", "left")
        .join(roots.withColumnRenamed("node", "id"), "id", "left")
        .select(
            "id",
            (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
            F.coalesce("root", "id").alias("component_id"),
        )
    )
    single = classes.where("n = 1").select(F.col("id").alias("vec_id"), "id")
    known = single.unionAll(copies.select("vec_id", "id")).join(facts, "id")
    known = known.select("vec_id", "n_links", "component_id")
    unsound = rows.where("not sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    result = known.unionAll(unsound)
    return result.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _tile_pairs(tiles: DataFrame, reach: float, scratch: Scratch) -> DataFrame:
    """(a, b, size): pairs of tiles that can hold a link, each tile with itself included.

    A tile is met with those whose first dimension begins within reach of its end: both list the
    strips of width ``reach`` that they touch, and are joined on them.
    """
    strip = lambda c: F.floor(F.col(c) / reach).cast("long")
    spans = tiles.select("tile", "size", "low", "high")
    left = spans.select(
        F.col("tile").alias("a"), "size", F.col("high").alias("end"), F.explode(F.sequence(strip("low"), strip("high") + 1)).alias("strip")
    )
    right = spans.select(
        F.col("tile").alias("b"), "size", F.col("low").alias("begin"), F.explode(F.sequence(strip("low"), strip("high"))).alias("strip")
    )
    met = left.join(right, ["size", "strip"]).where((F.col("begin") - F.col("end") <= reach) & (F.col("a") <= F.col("b")))
    return scratch.write(met.select("a", "b", "size").distinct())
