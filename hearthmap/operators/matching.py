"""Propensity scores and one-to-one nearest matching on the score.

Matching rule: treated units in order of falling score (ties by id) each take the closest free
control; of two controls at the same distance the one with the higher score, then the smaller id.

How it scales.  Units with equal scores are interchangeable up to their id order, so the axis is
reduced to one row per distinct score with two counts, however many units share a score.  The axis is cut
into chunks that are swept side by side; ``sweep.py`` follows their states and says which chunk has to be
swept again from which incoming units.  Whoever is served by number (first come, first served; the nearest
free controls at the end of the axis) is paired by a join.  Only one short record per chunk reaches the
driver, and a task holds one chunk's waiting and free units.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import asdict

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from hearthmap.functions.joins import lookup_join
from hearthmap.operators.absorbed import FEW_BYTES, Fit, covariates, fit, level_bytes, model_rows
from hearthmap.operators.sweep import Chunk, Coordinator, Order, Result, Sweep, Unit
from hearthmap.session import materialise, new_shared_path

# Longest run of unit pairs described by one row before it is expanded.
SEGMENT = 50_000
# Chunks grow with the data beyond this number of them: the driver follows one record per chunk.
MOST_CHUNKS = 1_000


# ---------------------------------------------------------------- score

def complete_cases(df: DataFrame, columns: list[str], drop_incomplete: bool) -> DataFrame:
    """Rows without missing covariates; raises on missing ones unless told to drop them."""
    if drop_incomplete:
        return df.na.drop("any", subset=columns)
    missing = df.where(F.greatest(*[F.col(c).isNull().cast("int") for c in columns], F.lit(0)) == 1)
    if not missing.isEmpty():
        raise ValueError(f"missing values in {columns}")
    return df


# Rounds of reweighting at most, and the relative change of the deviance that ends them (fixed values, those
# of the usual logistic regression).
ROUNDS, CLOSE_ENOUGH = 25, 1e-8


def propensity_score(
    df: DataFrame,
    treated: str,
    numeric: list[str],
    categorical: list[str],
    *,
    drop_incomplete: bool = False,
    out: str = "distance",
) -> DataFrame:
    """Fitted probability of treatment from a logistic regression.

    Rows are collapsed to cells of equal covariates and treatment.  Every round is a weighted regression on
    the cells, in which the categorical covariate's levels are swept out: they may be any number, and
    the driver sees a small system only.
    """
    data = complete_cases(df, [*numeric, *categorical], drop_incomplete)
    x = covariates(data, numeric, categorical)
    if x.names:
        # sums of squares lose no digits around the means
        middle = data.agg(*[F.avg(c) for c in x.columns]).first()
        x.columns = [c - F.lit(m or 0.0) for c, m in zip(x.columns, middle)]
    rows = model_rows(data, x, _t=F.col(treated).cast("int"))
    xs = [c for c in rows.columns if c not in ("_l", "_t")]
    cells = materialise(rows.groupBy("_l", *xs, "_t").agg(F.count(F.lit(1)).cast("double").alias("_c")))
    y = F.col("_t").cast("double")
    current, last = cells.withColumn("_eta", F.when(F.col("_t") == 1, 1.0).otherwise(-1.0) * math.log(3.0)), math.inf
    few = level_bytes(cells.select("_l").distinct().count(), len(xs)) <= FEW_BYTES
    model = previous = None
    for _ in range(ROUNDS + 1):
        bounded = F.greatest(F.least(F.col("_eta"), F.lit(30.0)), F.lit(-30.0))
        mu = 1 / (1 + F.exp(-bounded))
        spread = mu * (1 - mu)
        miss = F.log(F.when(F.col("_t") == 1, mu).otherwise(1 - mu)) * F.col("_c") * -2
        refit = fit(
            current, len(xs), F.col("_c") * spread, F.col("_eta") + (y - mu) / spread, F.lit(0), {"_deviance": miss}, few
        )
        deviance = refit.totals["_deviance"]
        if deviance > last + CLOSE_ENOUGH:
            model = previous  # no step leads further down, as where the arms do not overlap at all
            break
        if abs(deviance - last) < CLOSE_ENOUGH * (abs(deviance) + 0.1):
            break
        last = deviance if model is not None else math.inf  # the start is no fit
        previous, model = model, refit
        current = _predicted(cells, "_l", [F.col(c) for c in xs], model, "_eta")
    named = data.withColumn("_l", x.level)
    scored = _predicted(named, "_l", x.columns, model, out)
    return scored.withColumn(out, 1 / (1 + F.exp(-F.col(out)))).drop("_l")


def _predicted(df: DataFrame, level: str, columns: list[Column], model: Fit, out: str) -> DataFrame:
    """Adds the fitted linear predictor."""
    starts = model.levels.select(F.col("_l").alias("_level"), model.intercept().alias("_start"))
    slopes = sum((F.lit(model.slopes[0][i]) * columns[i] for i in model.kept), F.lit(0.0))
    joined = lookup_join(df, starts, [(level, "_level")], written=True)  # a few rows or a written table
    return joined.withColumn(out, F.col("_start") + slopes).drop("_start")


# ---------------------------------------------------------------- sweeps on Spark

# ``at``: place in the given queue (served), among the leftover treated from the front (left) or among the
# leftover controls from the bottom (free); ``facts``: the chunk's result for the driver
STATE = (
    "chunk int, kind string, at bigint, ts double, tr bigint, cs double, cr bigint, n bigint, facts string"
)


def _swept(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, Sweep, bool]]:
    """Sweep sorted rows batch by batch; yields (chunk, sweep, finished).

    A chunk's rows come as one run: the given stack bottom first, the given queue front first, then its
    scores falling.  It is never held as a whole.
    """
    chunk, sweep, given = None, None, ([], [])
    for pdf in batches:
        for target, part in pdf.groupby("target", sort=False):
            if chunk != target:
                if chunk is not None:
                    yield chunk, sweep or Sweep(given[1], given[0]), True
                chunk, sweep, given = int(target), None, ([], [])
            incoming = part["part"].to_numpy() < 2
            for row in part[incoming].itertuples():
                given[row.part].append(Unit(row.score, int(row.rank), int(row.n), False))
            scores = part[~incoming]
            if len(scores):
                sweep = sweep or Sweep(given[1], given[0])
                for row in zip(scores["score"].tolist(), scores["nt"].tolist(), scores["nc"].tolist()):
                    sweep.step(*row)
                yield chunk, sweep, False
    if chunk is not None:
        yield chunk, sweep or Sweep(given[1], given[0]), True


def _states(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs, controls handed to the given queue, leftovers and the result of every chunk."""
    for chunk, sweep, finished in _swept(batches):
        pairs, served = sweep.flush()
        rows = [("pair", 0, ts, tr, cs, cr, n, None) for ts, tr, cs, cr, n in pairs]
        rows += [("served", at, None, None, cs, cr, n, None) for at, cs, cr, n in served]
        if finished:
            at = 0
            for u in sweep.queue:
                if u.own:
                    rows.append(("left", at, u.score, u.rank, None, None, u.n, None))
                    at += u.n
            at = 0
            for u in sweep.free:
                if u.own:
                    rows.append(("free", at, None, None, u.score, u.rank, u.n, None))
                    at += u.n
            rows.append(("facts", 0, None, None, None, None, 0, json.dumps(asdict(sweep.result()))))
        if rows:
            names = ["kind", "at", "ts", "tr", "cs", "cr", "n", "facts"]
            types = ["str", "int64", "float64", "Int64", "float64", "Int64", "int64", "object"]
            out = pd.DataFrame(rows, columns=names).astype(dict(zip(names, types)))
            out.insert(0, "chunk", chunk)
            yield out


class _Axis:
    """The distinct scores with their counts, cut into chunks; chunk 0 has the highest scores."""

    def __init__(self, units: DataFrame, rows_per_chunk: int):
        self.spark = units.sparkSession
        runs = materialise(
            units.groupBy("_s").agg(
                F.sum("_t").cast("long").alias("_nt"), F.sum(1 - F.col("_t")).cast("long").alias("_nc")
            )
        )
        size = max(rows_per_chunk, -(-runs.count() // MOST_CHUNKS))
        chunks = max(1, -(-runs.count() // size))
        placed = runs.repartitionByRange(chunks, F.col("_s").desc()).withColumn("_chunk", F.spark_partition_id())
        # units before a score inside its chunk, in the one sorted run that a chunk is
        earlier = Window.partitionBy("_chunk").orderBy(F.col("_s").desc()).rowsBetween(Window.unboundedPreceding, -1)
        before = {f"_before{c}": F.coalesce(F.sum(c).over(earlier), F.lit(0)) for c in ("_nt", "_nc")}
        self.runs = materialise(placed.withColumns(before))
        # one row per chunk
        facts = self.runs.groupBy("_chunk").agg(F.sum("_nt"), F.sum("_nc"), F.max("_s"), F.min("_s")).collect()
        self.names = sorted(r[0] for r in facts)
        by_name = {r[0]: Chunk(*r[1:]) for r in facts}
        self.chunks = [by_name[n] for n in self.names]
        self._path = new_shared_path(self.spark, "sweeps")

    def states(self) -> DataFrame:
        """All swept states so far, with the round that each is from."""
        return self.spark.read.schema(f"{STATE}, round int").parquet(self._path)

    def sweep(self, number: int, orders: list[Order]) -> dict[int, Result]:
        """Sweep the ordered chunks side by side, each in a task of its own."""
        targets = self._small([(self.names[o.chunk],) for o in orders], "_chunk int")
        # bounded: one row per chunk
        scores = self.runs.join(F.broadcast(targets), "_chunk").select(
            F.col("_chunk").alias("target"),
            F.lit(2).alias("part"),
            F.lit(0).alias("o1"),
            (-F.col("_s")).alias("o2"),
            F.col("_s").alias("score"),
            F.lit(0).cast("long").alias("rank"),
            F.lit(0).cast("long").alias("n"),
            F.col("_nt").alias("nt"),
            F.col("_nc").alias("nc"),
        )
        rows = scores
        # where no control above is free, scores of those who wait do not matter
        counted = [(self.names[o.chunk], 1, 0, 0.0, math.nan, 0, o.waiting, 0, 0) for o in orders if o.waiting and not o.stack]
        if counted:
            rows = rows.unionAll(self._small(counted, scores.schema))
        handed = self._handed([o for o in orders if o.stack])
        if handed is not None:
            rows = rows.unionAll(handed)
        placed = rows.repartition(len(orders), "target").sortWithinPartitions("target", "part", "o1", "o2")
        placed.mapInPandas(_states, STATE).write.parquet(f"{self._path}/round={number}")
        index = {n: i for i, n in enumerate(self.names)}
        found = self.states().where((F.col("round") == number) & (F.col("kind") == "facts")).select("chunk", "facts")
        return {index[r["chunk"]]: Result(**json.loads(r["facts"])) for r in found.collect()}

    def _handed(self, orders: list[Order]) -> DataFrame | None:
        """Leftovers of earlier chunks that are handed to the ordered ones, cut to their segments."""
        cut = []
        for o in orders:
            for part, segments in ((0, o.stack), (1, o.queue)):
                base = 0
                for s in segments:
                    cut.append((self.names[o.chunk], part, self.names[s.chunk], s.round, s.low, s.high, base))
                    base += s.high - s.low
        if not cut:
            return None
        # bounded: at most MOST_CHUNKS ** 2 / 2 short rows
        segments = F.broadcast(self._small(cut, "target int, part int, chunk int, round int, low bigint, high bigint, base bigint"))
        leftover = self.states().where(F.col("kind").isin("free", "left")).select(
            "chunk", "round", (F.col("kind") == "left").cast("int").alias("part"), "at",
            F.coalesce("ts", "cs").alias("score"), F.coalesce("tr", "cr").alias("first"), "n",
        )
        first_come = self.runs.where("_nt > 0").select(
            F.col("_chunk").alias("chunk"), F.lit(-1).alias("round"), F.lit(1).alias("part"), F.col("_before_nt").alias("at"),
            F.col("_s").alias("score"), F.lit(0).cast("long").alias("first"), F.col("_nt").alias("n"),
        )
        held = leftover.unionAll(first_come).join(segments, ["chunk", "round", "part"])
        low, high = F.greatest("low", "at"), F.least(F.col("high"), F.col("at") + F.col("n"))
        in_queue = F.col("base") + low - F.col("low")
        # the unit at the bottom of a run has its highest rank
        in_stack = F.col("first") + F.col("n") - (high - F.col("at"))
        return held.where(low < high).select(
            "target",
            "part",
            F.col("chunk").alias("o1"),
            F.col("at").cast("double").alias("o2"),
            "score",
            F.when(F.col("part") == 1, in_queue).otherwise(in_stack).alias("rank"),
            (high - low).alias("n"),
            F.lit(0).cast("long").alias("nt"),
            F.lit(0).cast("long").alias("nc"),
        )

    def _small(self, rows: list[tuple], schema) -> DataFrame:
        return self.spark.createDataFrame(rows, schema)

    def pairs(self, done: Coordinator) -> DataFrame:
        """(ts, tr, cs, cr): scores and ranks of all matched units."""
        schema = "chunk int, round int, entered bigint, served bigint"
        places = [(self.names[i], s.round, s.entered, s.served) for i, s in enumerate(done.settled)]
        # bounded: one row per chunk
        swept = F.broadcast(self._small([p for p in places if p[1] is not None], schema))
        first_come = F.broadcast(self._small([p for p in places if p[1] is None], schema))
        states = self.states().join(swept, ["chunk", "round"])
        served, entered = done.waiting
        rest, above = [], 0
        for s in reversed(done.rest):
            rest.append((self.names[s.chunk], s.round, s.high, served + above))
            above += s.high
        end = min(entered, served + above)  # numbers from here on stay unmatched
        at_end = F.broadcast(self._small(rest, "chunk int, round int, high bigint, first bigint"))
        number = lambda start, place: (F.col(start) + F.col(place)).alias("number")
        zero = F.lit(0).cast("long")
        runs = self.runs.join(first_come, F.col("_chunk") == F.col("chunk"))
        waiting = states.where("kind = 'left'").select(number("entered", "at"), "ts", "tr", "n").unionAll(
            runs.where("_nt > 0").select(number("entered", "_before_nt"), F.col("_s"), zero, "_nt")
        )
        high = F.least(F.col("high"), F.col("at") + F.col("n"))
        nearest_first = self.states().where("kind = 'free'").join(at_end, ["chunk", "round"]).where(F.col("at") < F.col("high"))
        taking = (
            states.where("kind = 'served'")
            .select(number("served", "at"), "cs", "cr", "n")
            .unionAll(runs.where("_nc > 0").select(number("served", "_before_nc"), F.col("_s"), zero, "_nc"))
            .unionAll(
                nearest_first.select(
                    F.col("first") + F.col("high") - high, "cs", F.col("cr") + F.col("n") - (high - F.col("at")), high - F.col("at")
                )
            )
        )
        direct = _single(states.where("kind = 'pair'").select("ts", "tr", "cs", "cr", "n"), "tr", "cr")
        left = _single(waiting.where(F.col("number") < end), "number", "tr")
        taken = _single(taking.where(F.col("number") < end), "number", "cr")
        return direct.unionByName(left.join(taken, "number").drop("number"))


def _single(runs: DataFrame, *counted: str) -> DataFrame:
    """One row per unit of a run of ``n``; ``counted`` columns rise along it.  Long runs are cut first."""
    start = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(SEGMENT).cast("long")))
    cut = runs.withColumn("_i", start).withColumns({c: F.col(c) + F.col("_i") for c in counted})
    step = F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.col("n") - F.col("_i"), F.lit(SEGMENT)) - 1))
    return cut.withColumn("_j", step).withColumns({c: F.col(c) + F.col("_j") for c in counted}).drop("n", "_i", "_j")


def _ranked_units(units: DataFrame) -> DataFrame:
    """Every unit with its 0-based rank by id among units of equal score and treatment.

    Range partitioning splits a score shared by very many units; ranks are the place inside the
    partition plus the counts in earlier partitions.
    """
    placed = materialise(
        units.repartitionByRange("_s", "_t", "_id").withColumn("_part", F.spark_partition_id())
    )
    cell = ["_s", "_t", "_part"]
    earlier = Window.partitionBy("_s", "_t").orderBy("_part").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = placed.groupBy(*cell).agg(F.count(F.lit(1)).alias("_n")).withColumn(
        "_offset", F.coalesce(F.sum("_n").over(earlier), F.lit(0))
    )
    inside = Window.partitionBy(*cell).orderBy("_id")
    return lookup_join(placed, offsets.drop("_n"), cell, "inner", unique=True).select(
        "_s", "_t", "_id", (F.row_number().over(inside) - 1 + F.col("_offset")).alias("_rank")
    )


def nearest_pairs(
    df: DataFrame,
    id_col: str,
    treated: str,
    score: str = "distance",
    *,
    rows_per_chunk: int = 100_000,
) -> DataFrame:
    """Greedy one-to-one nearest matching without replacement: treated_id, control_id, gap."""
    units = materialise(
        df.select(
            F.col(id_col).alias("_id"),
            F.col(treated).cast("int").alias("_t"),
            F.col(score).cast("double").alias("_s"),
        ).where(F.col("_s").isNotNull() & F.col("_t").isNotNull())
    )
    axis = _Axis(units, rows_per_chunk)
    id_type = units.schema["_id"].dataType
    if not axis.chunks:
        none = F.lit(None)
        return units.select(
            F.col("_id").alias("treated_id"), none.cast(id_type).alias("control_id"), "_s"
        ).withColumnRenamed("_s", "gap")
    coordinator = Coordinator(axis.chunks)
    coordinator.run(axis.sweep)
    by_rank = axis.pairs(coordinator)
    ranked = _ranked_units(units)
    treated_side = ranked.where(F.col("_t") == 1).select(
        F.col("_s").alias("ts"), F.col("_rank").alias("tr"), F.col("_id").alias("treated_id")
    )
    control_side = ranked.where(F.col("_t") == 0).select(
        F.col("_s").alias("cs"), F.col("_rank").alias("cr"), F.col("_id").alias("control_id")
    )
    return (
        by_rank.join(treated_side, ["ts", "tr"])
        .join(control_side, ["cs", "cr"])
        .select("treated_id", "control_id", F.abs(F.col("ts") - F.col("cs")).alias("gap"))
    )


# ---------------------------------------------------------------- matched data

def matched_data(df: DataFrame, pairs: DataFrame, id_col: str) -> DataFrame:
    """Matched rows with weight and pair label (``subclass`` is the treated unit's id)."""
    members = pairs.select(
        F.inline(
            F.array(
                F.struct(F.col("treated_id").alias("_member"), F.col("treated_id").alias("subclass")),
                F.struct(F.col("control_id").alias("_member"), F.col("treated_id").alias("subclass")),
            )
        )
    )
    return lookup_join(df, members, [(id_col, "_member")], "inner", unique=True).withColumn(
        "weights", F.lit(1.0)
    )


def match_flags(df: DataFrame, pairs: DataFrame, id_col: str) -> DataFrame:
    """Every row with ``matched`` 0/1."""
    members = pairs.select(F.explode(F.array("treated_id", "control_id")).alias("_member"))
    flagged = lookup_join(
        df, members.withColumn("matched", F.lit(1)), [(id_col, "_member")], unique=True
    )
    return flagged.fillna(0, subset=["matched"])
