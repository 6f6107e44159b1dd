import random

import numpy as np
import pytest
from conftest import table
from pyspark.sql import functions as F

from hearthmap.functions.tails import normal_two_sided
from hearthmap.operators import balance, effects, matching, sweep


def greedy(units):
    """Plain sequential matching: the definition."""
    treated = sorted((-s, i) for i, t, s in units if t == 1)
    free = {i: s for i, t, s in units if t == 0}
    pairs = {}
    for minus, i in treated:
        if not free:
            break
        best = min(free, key=lambda j: (abs(free[j] + minus), -free[j], j))
        pairs[i] = best
        del free[best]
    return pairs


def matched(frame, units, **options):
    df = frame(units, "id long, t int, distance double")
    return {r["treated_id"]: r["control_id"] for r in matching.nearest_pairs(df, "id", "t", **options).collect()}


def test_known_case(frame):
    units = [(1, 1, 0.90), (2, 1, 0.86), (3, 1, 0.60), (11, 0, 0.88), (12, 0, 0.62), (13, 0, 0.10)]
    assert matched(frame, units) == {1: 11, 2: 12, 3: 13}


def _units(rng, n, share, shift, grid):
    units = []
    for i in range(n):
        t = int(rng.random() < share)
        units.append((i, t, round((rng.random() + (shift if t else 0)) * grid) / 1024))
    return units


CASES = [
    (200, 0.2, 0.0, 10**5), (200, 0.2, 0.8, 10**5), (200, 0.6, 0.3, 10**5), (200, 0.8, 0.0, 50),
    (200, 0.5, -0.4, 1000), (150, 0.5, 0.0, 3), (120, 0.3, 0.2, 1),
]


@pytest.mark.parametrize("case", CASES)
def test_equals_sequential_matching(frame, case):
    units = _units(random.Random(str(case)), *case)
    pairs = matched(frame, units, rows_per_chunk=12)
    assert pairs == greedy(units)
    assert len(set(pairs.values())) == len(pairs)


def test_one_sided_inputs(frame):
    assert matched(frame, [(1, 1, 0.5), (2, 1, 0.4)]) == {}
    assert matched(frame, [(1, 0, 0.5)]) == {}
    assert matched(frame, []) == {}


class _Local:
    """Sweeps of chunks without Spark, for many random instances."""

    def __init__(self, units, chunks):
        counts = {}
        for _, t, s in units:
            counts.setdefault(s, [0, 0])[0 if t else 1] += 1
        axis = sorted(counts, reverse=True)
        size = -(-len(axis) // chunks)
        self.parts = [[(s, *counts[s]) for s in axis[i : i + size]] for i in range(0, len(axis), size)]
        self.rows, self.swept, self.largest, self.kept = len(axis), 0, 0, {}
        self.ids = {}
        for i, t, s in sorted(units):
            self.ids.setdefault((s, t), []).append(i)
        facts = [sweep.Chunk(sum(r[1] for r in p), sum(r[2] for r in p), p[0][0], p[-1][0]) for p in self.parts]
        self.coordinator = sweep.Coordinator(facts)
        self.coordinator.run(self._sweep)

    def _cut(self, segments, kind):
        for s in segments:
            at = 0
            own = [sweep.Unit(x, 0, t) for x, t, _ in self.parts[s.chunk] if t]
            for u in own if s.round < 0 else self.kept[s.chunk, s.round][kind]:
                low, high = max(s.low - at, 0), min(s.high - at, u.n)
                if low < high:
                    yield u, low, high
                at += u.n

    def _sweep(self, number, orders):
        found = {}
        for o in orders:
            queue, at = [], 0
            if o.stack:
                for u, low, high in self._cut(o.queue, 2):
                    queue.append(sweep.Unit(u.score, at, high - low, False))
                    at += high - low
            elif o.waiting:
                queue = [sweep.Unit(float("nan"), 0, o.waiting, False)]
            stack = [sweep.Unit(u.score, u.rank + u.n - high, high - low, False) for u, low, high in self._cut(o.stack, 3)]
            rows = len(self.parts[o.chunk])
            self.swept += rows
            self.largest = max(self.largest, rows + len(queue) + len(stack))
            w = sweep.Sweep(queue, stack)
            for r in self.parts[o.chunk]:
                w.step(*r)
            found[o.chunk] = w.result()
            self.kept[o.chunk, number] = (w.pairs, w.served, [u for u in w.queue if u.own], [u for u in w.free if u.own])
        return found

    def pairs(self):
        pairs, left, taken = {}, {}, {}
        for i, s in enumerate(self.coordinator.settled):
            entered, served = s.entered, s.served
            if s.round is None:
                for x, t, c in self.parts[i]:
                    left |= {entered + k: self.ids[x, 1][k] for k in range(t)}
                    taken |= {served + k: self.ids[x, 0][k] for k in range(c)}
                    entered, served = entered + t, served + c
                continue
            direct, given, waiting, _ = self.kept[i, s.round]
            for ts, tr, cs, cr, n in direct:
                pairs |= {self.ids[ts, 1][tr + k]: self.ids[cs, 0][cr + k] for k in range(n)}
            for at, cs, cr, n in given:
                taken |= {served + at + k: self.ids[cs, 0][cr + k] for k in range(n)}
            for u in waiting:
                left |= {entered + k: self.ids[u.score, 1][u.rank + k] for k in range(u.n)}
                entered += u.n
        number, end = self.coordinator.waiting
        for s in reversed(self.coordinator.rest):
            controls = [self.ids[u.score, 0][u.rank + u.n - 1 - b] for u in self.kept[s.chunk, s.round][3] for b in range(u.n)]
            for control in reversed(controls[: s.high]):
                if number < end:
                    taken[number] = control
                number += 1
        return pairs | {left[k]: taken[k] for k in left if k in taken}


def test_chunk_states_on_random_instances():
    rng = random.Random(17)
    for _ in range(1500):
        units = _units(rng, rng.randint(2, 80), rng.choice([0.1, 0.3, 0.5, 0.7, 0.9]), rng.choice([0, 0.3, -0.3, 0.8]), rng.choice([4, 50, 10**6]))
        assert _Local(units, rng.choice([1, 3, 8, 25])).pairs() == greedy(units)


# name -> share of treated, score by (random numbers, treated)
AXES = {
    "as many of both": (0.5, lambda r, t: r.random()),
    "few treated": (0.2, lambda r, t: r.gauss(0.5 * t, 1)),
    "scarce controls": (0.7, lambda r, t: r.gauss(0.5 * t, 1)),
    "free controls just above": (0.5, lambda r, t: r.random() if t or r.random() < 0.7 else 1 + r.random()),
    "free controls far above": (0.5, lambda r, t: r.random() if t or r.random() < 0.6 else 3 + r.random()),
}


@pytest.mark.parametrize("name", AXES)
def test_few_chunks_are_swept_again(name):
    """Less than two more sweeps of the axis in a handful of rounds, and no task with a twentieth of it."""
    share, score = AXES[name]
    rng = random.Random(5)
    units = [(i, t, score(rng, t)) for i, t in enumerate(int(rng.random() < share) for _ in range(40_000))]
    local = _Local(units, 100)
    assert local.swept - local.rows < 2 * local.rows
    assert local.largest < local.rows / 20
    assert max(k[1] for k in local.kept) <= 8
    small = _Local(units[:3000], 30)
    assert small.pairs() == greedy(units[:3000])


def _study(n=160, seed=8):
    rng = np.random.default_rng(seed)
    x1, x2 = rng.normal(0, 1, n), rng.uniform(0, 1, n)
    cat = rng.choice(["a", "b", "c"], n)
    p = 1 / (1 + np.exp(-(-0.8 + 0.9 * x1 + 0.5 * (cat == "b"))))
    t = (rng.random(n) < p).astype(int)
    y = 1 + 0.7 * t + 0.5 * x1 - 0.2 * x2 + 0.3 * (cat == "c") + rng.normal(0, 0.5, n)
    return [(i, int(t[i]), float(x1[i]), float(x2[i]), str(cat[i]), float(y[i])) for i in range(n)]


SCHEMA = "id long, t int, x1 double, x2 double, cat string, y double"


def _design(rows, interactions=False):
    base = np.array([[1.0, r[2], r[3], r[4] == "b", r[4] == "c"] for r in rows], dtype=float)
    if not interactions:
        return base
    t = np.array([[r[1]] for r in rows], dtype=float)
    return np.hstack([base[:, :1], t, base[:, 1:], t * base[:, 1:]])


def test_propensity_score(frame):
    rows = _study()
    out = matching.propensity_score(frame(rows, SCHEMA), "t", ["x1", "x2"], ["cat"])
    got = {r["id"]: r["distance"] for r in out.collect()}
    X, t = _design(rows), np.array([r[1] for r in rows], dtype=float)
    beta = np.zeros(X.shape[1])
    for _ in range(50):
        mu = 1 / (1 + np.exp(-X @ beta))
        beta += np.linalg.solve(X.T @ (X * (mu * (1 - mu))[:, None]), X.T @ (t - mu))
    expected = 1 / (1 + np.exp(-X @ beta))
    assert max(abs(got[r[0]] - expected[i]) for i, r in enumerate(rows)) < 1e-8


def test_score_with_many_levels(frame):
    """Two thousand levels: the score equations hold, and no column stands for a level."""
    rng = np.random.default_rng(4)
    n = 12_000
    x, level = rng.normal(2020, 5, n), rng.integers(0, 2000, n)
    t = (rng.random(n) < 1 / (1 + np.exp(-(0.2 * (x - 2020) + (level % 7 - 3) * 0.3)))).astype(int)
    df = frame([(i, int(t[i]), float(x[i]), f"L{level[i]:04d}") for i in range(n)], "id long, t int, x double, g string")
    out = matching.propensity_score(df, "t", ["x"], ["g"])
    assert "L1234 =" not in out._jdf.queryExecution().optimizedPlan().toString()
    rows = out.select("t", "x", "g", "distance").toPandas()
    miss = rows.t - rows.distance
    # levels with both outcomes have an intercept of their own, which balances them
    mixed = rows.groupby("g").t.transform("mean").between(0.001, 0.999)
    assert miss[mixed].groupby(rows.g[mixed]).sum().abs().max() < 1e-3
    assert abs((miss * (rows.x - 2020)).sum()) < 1e-2


def test_score_where_arms_do_not_overlap(frame):
    df = frame([(i, int(i >= 20), float(i), "a" if i % 2 else "b") for i in range(40)], "id long, t int, x double, g string")
    got = {r["id"]: r["distance"] for r in matching.propensity_score(df, "t", ["x"], ["g"]).collect()}
    assert all((got[i] > 0.9) == (i >= 20) for i in got if abs(i - 19.5) > 2)


def test_effect_with_many_levels(frame):
    """Absorbed levels give what indicator columns give."""
    rng = np.random.default_rng(9)
    n, k = 3000, 300
    level, x, t = np.arange(n) % k, rng.normal(size=n), np.arange(n) // k % 2
    w = rng.integers(1, 4, n).astype(float)
    y = 0.5 * t + 0.1 * x * t + 0.01 * level + rng.normal(size=n)
    rows = [(int(t[i]), float(x[i]), f"{level[i]:03d}", float(y[i]), float(w[i]), int(i // 2)) for i in range(n)]
    df = frame(rows, "t int, x double, g string, y double, weights double, subclass long")
    dummies = (level[:, None] == np.arange(1, k)).astype(float)
    base = np.hstack([np.ones((n, 1)), x[:, None], dummies])
    X = np.hstack([base[:, :1], t[:, None], base[:, 1:], t[:, None] * base[:, 1:]])
    inverse = np.linalg.pinv(X.T @ (X * w[:, None]))
    beta = inverse @ X.T @ (w * y)
    e = w * (y - X @ beta)
    scores = np.add.reduceat(X * e[:, None], np.arange(0, n, 2))
    contrast = np.concatenate([[0, 1], np.zeros(k), base[t == 1, 1:].mean(0)])
    rank = np.linalg.matrix_rank(X)
    v = inverse @ scores.T @ scores @ inverse * (n / 2) / (n / 2 - 1) * (n - 1) / (n - rank)
    row = effects.treated_effect(df, "t", "y", ["x"], ["g"]).first()
    assert rank == 2 * k + 2
    assert row["estimate"] == pytest.approx(contrast @ beta) and row["std_error"] == pytest.approx(np.sqrt(contrast @ v @ contrast))
    got = {r["term"]: r["estimate"] for r in effects.weighted_model(df, "t", "y", ["x"], ["g"]).collect()}
    names = ["(Intercept)", "t", "x", *[f"g_{i:03d}" for i in range(1, k)], "t:x", *[f"t:g_{i:03d}" for i in range(1, k)]]
    assert got == {name: pytest.approx(b, rel=1e-7, abs=1e-7) for name, b in zip(names, beta)}


def test_levels_that_one_arm_lacks(frame):
    rows = [(0, "a", 1.0), (0, "a", 3.0), (0, "b", 4.0), (1, "b", 7.0), (1, "b", 9.0), (1, "c", 5.0), (0, "b", 6.0)]
    df = frame([(t, g, y, 1.0, i) for i, (t, g, y) in enumerate(rows)], "t int, g string, y double, weights double, subclass long")
    got = {r["term"]: r["estimate"] for r in effects.weighted_model(df, "t", "y", [], ["g"]).collect()}
    # a: untreated only, b: both, c: treated only
    assert got == {"(Intercept)": 2.0, "t": 3.0, "g_b": 3.0, "t:g_b": None, "g_c": 0.0, "t:g_c": None}
    assert effects.treated_effect(df, "t", "y", [], ["g"]).first()["estimate"] == pytest.approx(3.0)
    with pytest.raises(ValueError):
        effects.weighted_model(df.where("g <> 'b'"), "t", "y", [], ["g"])


def test_missing_covariates(frame):
    df = frame([*_study(40), (99, 1, None, 0.1, "a", 1.0)], SCHEMA)
    with pytest.raises(ValueError):
        matching.propensity_score(df, "t", ["x1"], ["cat"])
    assert matching.propensity_score(df, "t", ["x1"], ["cat"], drop_incomplete=True).count() == 40


@pytest.fixture(scope="module")
def matched_study(frame):
    from hearthmap.plans.study import matched_study as run

    rows = _study()
    return rows, run(frame(rows, SCHEMA), id_col="id", treated="t", outcome="y", numeric=["x1", "x2"], categorical=["cat"])


def test_balance(matched_study):
    rows, result = matched_study
    pairs = {r["treated_id"]: r["control_id"] for r in result.pairs.collect()}
    used = set(pairs) | set(pairs.values())
    after = {r["variable"]: r for r in result.after.collect()}
    treated_all = np.array([r[2] for r in rows if r[1]])
    m1 = np.array([r[2] for r in rows if r[1] and r[0] in used])
    m0 = np.array([r[2] for r in rows if not r[1] and r[0] in used])
    x = after["x1"]
    assert x["mean_treated"] == pytest.approx(m1.mean()) and x["mean_control"] == pytest.approx(m0.mean())
    assert x["std_mean_diff"] == pytest.approx((m1.mean() - m0.mean()) / treated_all.std(ddof=1))
    assert x["var_ratio"] == pytest.approx(m1.var(ddof=1) / m0.var(ddof=1))
    grid = np.unique(np.concatenate([m1, m0]))
    gaps = np.abs([(m1 <= g).mean() - (m0 <= g).mean() for g in grid])
    assert x["ecdf_mean"] == pytest.approx(gaps.mean()) and x["ecdf_max"] == pytest.approx(gaps.max())
    b = after["cat_b"]
    p1 = np.mean([r[4] == "b" for r in rows if r[1] and r[0] in used])
    p0 = np.mean([r[4] == "b" for r in rows if not r[1] and r[0] in used])
    p = np.mean([r[4] == "b" for r in rows if r[1]])
    assert b["std_mean_diff"] == pytest.approx((p1 - p0) / np.sqrt(p * (1 - p))) and b["var_ratio"] is None
    assert b["ecdf_max"] == pytest.approx(abs(p1 - p0))
    by_id = {r[0]: r for r in rows}
    gap = np.mean([abs(by_id[a][2] - by_id[c][2]) for a, c in pairs.items()]) / treated_all.std(ddof=1)
    assert {r["variable"]: r["pair_dist"] for r in result.pair_gaps.collect()}["x1"] == pytest.approx(gap)
    n1 = len(treated_all)
    assert table(result.sizes, "sample", "control", "treated") == [
        ("All", len(rows) - n1, n1), ("Matched", len(pairs), len(pairs)), ("Unmatched", len(rows) - n1 - len(pairs), n1 - len(pairs))
    ]


def test_model_and_effect(matched_study):
    rows, result = matched_study
    pairs = {r["treated_id"]: r["control_id"] for r in result.pairs.collect()}
    cluster = {i: a for a, c in pairs.items() for i in (a, c)}
    data = [r for r in rows if r[0] in cluster]
    X, y = _design(data, True), np.array([r[5] for r in data])
    inverse = np.linalg.inv(X.T @ X)
    beta = inverse @ X.T @ y
    names = ["(Intercept)", "t", "x1", "x2", "cat_b", "cat_c", "t:x1", "t:x2", "t:cat_b", "t:cat_c"]
    got = {r["term"]: r["estimate"] for r in result.model.collect()}
    assert got == {n: pytest.approx(b, rel=1e-8, abs=1e-9) for n, b in zip(names, beta)}
    treated = np.array([r[1] == 1 for r in data])
    base = _design(data)[treated, 1:].mean(axis=0)
    contrast = np.concatenate([[0, 1], np.zeros(len(base)), base])
    scores = {}
    for r, x, e in zip(data, X, y - X @ beta):
        scores[cluster[r[0]]] = scores.get(cluster[r[0]], 0) + x * e
    meat = sum(np.outer(s, s) for s in scores.values())
    g, n, k = len(scores), len(data), X.shape[1]
    v = inverse @ meat @ inverse * g / (g - 1) * (n - 1) / (n - k)
    se = np.sqrt(contrast @ v @ contrast)
    row = result.effect.first()
    assert row["estimate"] == pytest.approx(contrast @ beta) and row["std_error"] == pytest.approx(se)
    assert row["p"] == pytest.approx(normal_two_sided(contrast @ beta / se)) and row["n_clusters"] == g


def test_aliased_columns_are_left_out(frame):
    rows = [(i, i % 2, float(i), 2.0 * i, "a", float(3 * i + (i % 2))) for i in range(12)]
    df = frame(rows, SCHEMA).withColumn("weights", F.lit(1.0))
    got = {r["term"]: r["estimate"] for r in effects.weighted_model(df, "t", "y", ["x1", "x2"], []).collect()}
    assert got["x2"] is None and got["t:x2"] is None
    assert got["x1"] == pytest.approx(3.0) and got["t"] == pytest.approx(1.0)


def test_unmatched_balance_of_levels_only(frame):
    df = frame(_study(30), SCHEMA)
    out = balance.balance_table(df, "t", [], ["cat"])
    assert {r["variable"] for r in out.collect()} == {"cat_a", "cat_b", "cat_c"}
