import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridhazard.operators import events as E
from gridhazard.operators import ordered as O
from gridhazard.operators import quantiles as Q


@pytest.mark.parametrize("width", [1, 5, 1000])
def test_fill_lag_islands_across_buckets(spark, width):
    rnd = random.Random(width)
    rows = [(k, t, rnd.choice([None, float(t)])) for k in "ab" for t in sorted(rnd.sample(range(60), 25))]
    d = spark.createDataFrame(rows, "k string, t bigint, v double").withColumn("b", F.floor(F.col("t") / width))
    got = {(r.k, r.t): r for r in O.neighbours_known(d, ["k"], "b", "t", "v").collect()}
    lag = {(r.k, r.t): r.p for r in O.shifted(d, ["k"], "b", "t", "t", "p", 1).collect()}
    lead = {(r.k, r.t): r.p for r in O.shifted(d, ["k"], "b", "t", "t", "p", -1).collect()}
    isl = {(r.k, r.t): r.island for r in O.islands(d, ["k"], "b", "t", 3).collect()}
    pos = {(r.k, r.t): r.n for r in O.dense_position(d, ["k"], "b", "t", "n").collect()}
    for k in "ab":
        mine = [(t, v) for kk, t, v in rows if kk == k]
        start = None
        for i, (t, v) in enumerate(mine):
            prev = max((x for x in mine[: i + 1] if x[1] is not None), default=None)
            nxt = min((x for x in mine[i:] if x[1] is not None), default=None)
            r = got[(k, t)]
            assert (r.prev and (r.prev.o0, r.prev.v)) == prev
            assert (r.next and (r.next.o0, r.next.v)) == nxt
            assert lag[(k, t)] == (mine[i - 1][0] if i else None)
            assert lead[(k, t)] == (mine[i + 1][0] if i + 1 < len(mine) else None)
            if i == 0 or t - mine[i - 1][0] > 3:
                start = t
            assert isl[(k, t)] == start
            assert pos[(k, t)] == i + 1


@pytest.mark.parametrize("bounded", [True, False])
def test_exact_quantiles_both_ways(spark, bounded):
    rnd = np.random.default_rng(3)
    rows = [("hot", 7.0)] * 400 + [("hot", float(x)) for x in rnd.lognormal(0, 2, 500)]
    rows += [("small", float(x)) for x in rnd.normal(size=6)] + [("one", 5.0), ("small", float("nan")), ("one", None)]
    d = spark.createDataFrame(rows, "k string, v double")
    probs = [0.0, 0.05, 0.5, 0.77, 1.0]
    out = Q.exact_quantiles(d, ["k"], "v", probs, bounded=bounded)
    for r in out.collect():
        vals = [v for k, v in rows if k == r.k and v is not None and v == v]
        assert list(r)[1:] == pytest.approx(list(np.percentile(vals, [p * 100 for p in probs])), rel=1e-12)
    assert out.count() == 3


def test_mode_smallest_on_ties(spark):
    d = spark.createDataFrame([("a", 3), ("a", 1), ("a", 3), ("a", 1), ("a", 9), ("b", None), ("b", 4)], "k string, v int")
    assert {r.k: r.m for r in Q.mode_per_key(d, ["k"], "v", "m").collect()} == {"a": 1, "b": 4}


def greedy(points, passes, half):
    left, picks = dict(points), []
    while left:
        t = min(left, key=lambda x: (left[x], x))
        v = left[t]
        picks.append((t, v))
        left = {s: w for s, w in left.items() if abs(s - t) > half}
        if not passes(v):
            break
    return picks, left


@pytest.mark.parametrize("seed", range(3))
def test_greedy_storms_equal_sequential_search(spark, seed):
    rnd = random.Random(seed)
    n = 400
    rows = [(t, float(-rnd.choice([10, 20, 150, 160, 160, 200])), float(rnd.choice([1, 5, 8, 9]))) for t in range(n)]
    dst, left = greedy({t: d for t, d, _ in rows}, lambda v: v < -140, 36)
    kp, _ = greedy({t: -k for t, _, k in rows if t in left}, lambda v: v <= -8, 36)
    want = {(t, v, 1) for t, v in dst} | {(t, -v, 2) for t, v in kp}
    d = spark.createDataFrame(rows, "t bigint, dst double, kp double").repartition(3)
    got = {(r.t, r.value, r.phase) for r in E.greedy_storms(d).collect()}
    assert got == want


def test_sessions_two_passes_equal_one(spark):
    rnd = random.Random(5)
    times = sorted(rnd.sample(range(3000), 60))
    runs = [[times[0], times[0]]]
    for t in times[1:]:
        if t - runs[-1][1] <= 24:
            runs[-1][1] = t
        else:
            runs.append([t, t])
    merged = []
    for a, b in runs:
        if merged and a - merged[-1][1] <= 48:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    d = E.storm_sessions(spark.createDataFrame([(t,) for t in times], "t bigint"))
    assert sorted((r.start_t, r.end_t) for r in d.collect()) == [(a - 24, b + 24) for a, b in merged]


def test_overlap_pairs_once(spark):
    w = spark.createDataFrame([(0, 200), (300, 310)], "start_t bigint, end_t bigint")
    n = spark.createDataFrame([("x", 10, 190), ("y", 200, 300), ("z", 250, 260)], "name string, event_start bigint, event_end bigint")
    got = sorted((r.name, r.start_t) for r in E.overlapping(w, n).collect())
    assert got == [("x", 0), ("y", 0), ("y", 300)]


def test_mask_runs_drop_short(spark):
    mask = [1, 1, 1, 1, 0, 1, 1, 0, 0, 1, 1, 1, 1, 1]
    d = spark.createDataFrame([(t + 20, bool(m)) for t, m in enumerate(mask)], "t bigint, m boolean")
    assert sorted((r.start_t, r.end_t) for r in E.mask_runs(d, "m", 3).collect()) == [(20, 23), (29, 33)]
