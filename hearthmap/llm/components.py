"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from hearthmap.llm.scratch import Scratch


def _fingerprint(edges: DataFrame) -> tuple:
    """One row: number of edges and an order-free sum over them."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Every node ties its larger neighbours to the smallest node it knows."""
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = scratch.write(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
    tied = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    result = scratch.write(tied.where("u <> v").distinct())
    scratch.drop(least)
    return result


def _small_star(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Every node ties its smaller neighbours and itself to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    tied = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = least.select("u", F.col("m").alias("v"))
    return scratch.write(tied.where("u <> v").unionAll(own).distinct())


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows (node, root) for every node of ``links`` (long columns a, b); root is the smallest reachable.

    Loops, repeated and reversed links are allowed, links with a null end are ignored; no links give no
    rows.  Both steps aggregate before they shuffle.  A root has very many larger neighbours: there the
    minima are written and join the edges in a plain join, which splits a skewed node.
    """
    edges = scratch.write(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .where("a <> b")
        .distinct()
    )
    seen = _fingerprint(edges)
    while seen[0]:
        large = _large_star(edges, scratch)
        small = _small_star(large, scratch)
        scratch.drop(edges, large)
        edges, before, seen = small, seen, _fingerprint(small)
        if seen == before:
            break
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(
        roots.select("node", F.col("node").alias("root"))
    )
