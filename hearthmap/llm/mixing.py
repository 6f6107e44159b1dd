"""Mixing sources to target weights by systematic sampling.

Sources in code point order (null last) weigh 1, 2, 3, 1, 2, 3, ... and share all words by weight; a
target stops at ``MOST_COPIES`` times its source's words and the excess is shared again by weight.
That is: target = min(3 * size, (total - capped) * weight / weights), with the capped sources being
those of the smallest 3 * size / weight.

Every document of a source expects target / source_size copies.  Documents are put in order of size
within their source, the expected copies are summed up along that order, one offset in [0, 1) per
source is added, and a document is emitted once per integer that its stretch of the sum crosses.  Two
neighbours have nearly equal sizes, so the words taken come within about one large document of the
target, and no document is taken more than three times.

The running sum of a source is its expectation times the position in the order.  Positions come from
one range-partitioned sort of (source, size, id): counts per partition give every partition its offset,
and a source with a third of all rows is simply spread over many partitions.

Rows: null text has size 0.  A source without words has target 0 and takes nothing.  A null source is a
source of its own.  Repeated ids are documents of their own.  Empty table: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from hearthmap.llm.scratch import Scratch
from hearthmap.llm.words import find_words, raw, steps

WEIGHTS = (1, 2, 3)
MOST_COPIES = 3
SEED = "mix-1"


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in steps(whole):
            words = find_words(*raw(batch.column("text")))
            keep = [c for c in batch.schema.names if c != "text"]
            size = pa.array(np.diff(words.bounds).astype(np.int64))
            yield pa.RecordBatch.from_arrays([*map(batch.column, keep), size], [*keep, "size"])


def sizes(documents: DataFrame, row: str | None = None) -> DataFrame:
    """(doc_id, source, size) and the row number column, if any: words of each text."""
    rows = documents.select(F.col("doc_id").cast("long"), "source", *([row] if row else []), "text")
    kind = f", {row} long" if row else ""
    return rows.mapInArrow(_sizes, f"doc_id long, source string{kind}, size long")


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """(source, n, source_size, target): one row per source; single-task windows over that table only."""
    by_source = sized.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))
    rows = by_source.withColumn("weight", weight).withColumn("cap", most * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    rows = rows.withColumns(
        {
            "total": F.sum("source_size").over(whole),
            "capped": F.coalesce(F.sum("cap").over(upto), F.lit(0)),
            "weights": F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(upto), F.lit(0)),
        }
    )
    # the first source, in that order, that its share does not fill to the cap ends the capped ones
    share = (F.col("total") - F.col("capped")) * F.col("weight") / F.col("weights")
    rows = rows.withColumn("free", share <= F.col("cap"))
    first_free = F.struct("capped", "weights")
    rows = rows.withColumn("end", F.min(F.when(F.col("free"), first_free)).over(whole))
    level = (F.col("total") - F.col("end.capped")) * F.col("weight") / F.col("end.weights")
    target = F.when(F.col("capped") >= F.col("end.capped"), F.least(level, F.col("cap").cast("double")))
    target = F.coalesce(target, F.col("cap").cast("double"))
    return rows.select("source", "n", "source_size", target.alias("target"))


def _offset(source: Column, seed: str) -> Column:
    """In [0, 1), from the seed and the source."""
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(source, F.lit("\x00"))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / 2**32


def mix(documents: DataFrame, seed: str = SEED, row: str | None = None) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, copies, taken.

    ``row`` may name a column that numbers the rows; it is carried along and settles ties of equal ids.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark)
    sized = scratch.write(sizes(documents, row))
    wanted = scratch.write(targets(sized))
    spread = [F.md5(F.col("doc_id").cast("string")), F.col("doc_id"), *([F.col(row)] if row else [])]
    placed = scratch.write(
        sized.repartitionByRange(
            int(spark.conf.get("spark.sql.shuffle.partitions")), F.col("source").asc_nulls_last(), "size", *spread
        ).withColumn("part", F.spark_partition_id())
    )
    # one row per partition and source in it
    counts = placed.groupBy("source", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(
        Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = scratch.write(counts.select("source", "part", F.coalesce(before, F.lit(0)).alias("before")))
    inside = F.row_number().over(Window.partitionBy("part", "source").orderBy("size", *spread))
    ranked = placed.withColumn("rank", inside)
    ranked = _beside(ranked, starts, ["source", "part"]).withColumn("rank", F.col("rank") + F.col("before"))
    rows = _beside(ranked, wanted, ["source"])
    rate = F.coalesce(F.least(F.col("target") / F.col("source_size"), F.lit(float(MOST_COPIES))), F.lit(0.0))
    offset = _offset(F.col("source"), seed)
    crossed = F.floor(F.col("rank") * rate + offset) - F.floor((F.col("rank") - 1) * rate + offset)
    copies = F.when(F.col("source_size") > 0, F.least(crossed, F.lit(MOST_COPIES))).otherwise(0).cast("long")
    figures = [copies.alias("copies"), (copies * F.col("size")).alias("taken")]
    return rows.select("doc_id", *([row] if row else []), "source", "size", "source_size", "target", *figures)


def _beside(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """Join to a table with one row per key, null keys included."""
    other = table.withColumnsRenamed({k: f"_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    condition = same[0]
    for s in same[1:]:
        condition &= s
    return rows.join(other, condition).drop(*[f"_{k}" for k in keys])
