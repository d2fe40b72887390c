"""Hard negatives against a search of all pairs in whole numbers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridhazard.llm.negatives import Block, angles_to, far_apart, lengths, mine, overlapping, scored

LONG = (1 << 63) - 1
#: Names that the operator uses for its own columns.
CLASH = ("id", "mark", "dim", "home", "data", "angles", "norm", "score", "shard", "rank", "vector")


def whole(vector):
    if vector is None or any(x is None or not math.isfinite(x) or not math.isfinite(256 * x) for x in vector):
        return None
    return tuple(math.floor(256 * x) for x in vector)


def brute(rows, every, positives=5, negatives=3, share=(50, 95)):
    told = {(i, label, whole(v)) for i, v, label in rows if i is not None and label is not None and whole(v) is not None}
    out = []
    for anchor, label, a in told:
        if anchor % every:
            continue
        near = [(max(-LONG - 1, min(LONG, sum(p * q for p, q in zip(a, x)))), i, own) for i, own, x in told if i != anchor and len(x) == len(a)]
        best = lambda found, k: sorted({(-s, i) for s, i in found})[:k]
        for score, positive in best([(s, i) for s, i, own in near if own == label], positives):
            score = -score
            hard = best([(s, i) for s, i, own in near if own != label and share[0] * score <= 100 * s <= share[1] * score], negatives)
            out += [(anchor, positive, rank, i, score, -s) for rank, (s, i) in enumerate(hard, 1)]
    return sorted(out)


def found(spark, rows, every, **options):
    kind = "vec_id long, embedding array<double>, label int, " + ", ".join(f"{c} string" for c in CLASH)
    table = spark.createDataFrame([(*r, *CLASH) for r in rows], kind).repartition(3)
    names = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    return sorted(tuple(r[n] for n in names) for r in mine(table, F.col("vec_id") % every == 0, **options).collect())


def clustered(rng, n, d, groups=6):
    centres = rng.normal(size=(groups, d))
    return [(centres[k % groups] + rng.normal(size=d) * rng.choice([0.05, 0.4, 1.5])).tolist() for k in range(n)]


@pytest.mark.parametrize("seed,every", [(1, 7), (2, 3)])
def test_rows_equal_brute_force(spark, seed, every):
    rng = np.random.default_rng(seed)
    rows = [(i, v, int(rng.integers(0, 4))) for i, v in enumerate(clustered(rng, 160, 5))]
    rows += [(i, rng.normal(size=3).round(1).tolist(), i % 3) for i in range(160, 220)]  # another length, with ties
    rows += [(300, None, 1), (301, [1.0, None, 2.0], 1), (302, [float("nan")] * 3, 0), (303, [float("inf"), 0.0, 0.0], 1), (304, [1e307, 0.0, 0.0], 1)]
    rows += [(None, [1.0, 2.0, 3.0], 1), (305, [1.0, 2.0, 3.0], None), (306, [0.0] * 3, 0), (307, [0.0] * 3, 1), (308, [], 1), (309, [], 2), (315, [], 1), (None, None, None)]
    rows += rows[:5] + [(0, [9.0] * 5, 1), (0, [9.0] * 5, 2), (1, [1.0] * 5, 1)]  # repeated rows; rows of one id that differ
    assert found(spark, rows, every) == brute(rows, every)


def test_scores_beyond_doubles_and_longs(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.integers(-9, 10, 4) * 10.0 ** int(rng.integers(0, 9))).tolist(), i % 2) for i in range(60)]
    assert found(spark, rows, 5) == brute(rows, 5)
    big = [(i, [1e30 * (1 + i % 3), -1e30, 1.0], i % 2) for i in range(20)]
    assert {r[4] for r in found(spark, big, 5)} <= {LONG, -LONG - 1}


@pytest.mark.parametrize("rows", [[], [(0, [1.0, 2.0], 1)], [(0, [1.0, 2.0], 1), (1, [1.0, 2.0], 1)], [(0, None, None)]])
def test_few_rows(spark, rows):
    assert found(spark, rows, 1) == []


def test_other_shares_and_counts(spark):
    rng = np.random.default_rng(6)
    rows = [(i, v, i % 3) for i, v in enumerate(clustered(rng, 120, 8))]
    options = {"positives": 2, "negatives": 7, "share": (10, 130)}
    assert found(spark, rows, 4, references=3, **options) == brute(rows, 4, **options)


def block(ids, x, refs, home):
    angles = angles_to(x, refs)
    order = np.argsort(angles[:, home], kind="stable")
    return Block(x.shape[1], len(refs), np.array(ids)[order], x[order].tobytes(), angles[order].tobytes(), lengths(x)[order], home)


def test_windows_lose_no_row():
    rng = np.random.default_rng(8)
    for trial in range(200):
        d = int(rng.integers(1, 12))
        x = np.floor(np.array(clustered(rng, 120, d, 3)) * 10.0 ** rng.integers(0, 5))
        near = np.floor((x[:1] + rng.normal(size=(40, d)) * np.abs(x[0]).max() * rng.choice([0.001, 0.05])) * rng.choice([1, 3]))
        refs = far_apart(x, 6, 1)
        anchors, rows = block(range(120), x, refs, 0), block(range(1000, 1040), near, refs, int(rng.integers(0, 6)))
        truth = anchors.x @ rows.x.T
        low = np.quantile(truth, rng.random(), axis=1).round()
        high = np.where(rng.random(120) < 0.5, np.inf, low + rng.integers(0, 1000, 120))
        got = {(int(anchors.ids[i]), int(k)): s for i, ids, values in scored(anchors, rows, low, high) for k, s in zip(ids, values)}
        for i in range(120):
            for j in np.flatnonzero((truth[i] >= low[i]) & (truth[i] <= high[i])):
                assert got[int(anchors.ids[i]), int(rows.ids[j])] == truth[i, j]


def test_clusters_out_of_the_window_are_not_scored():
    rng = np.random.default_rng(9)
    x = np.array(clustered(rng, 600, 32, 12)) * 1000
    x = np.floor(np.repeat(x[:12], 50, axis=0) + rng.normal(size=(600, 32)) * 20)
    refs = far_apart(x, 12, 1)
    blocks = [block(range(50 * k, 50 * k + 50), x[50 * k:50 * k + 50], refs, int(np.argmin(angles_to(x[50 * k:50 * k + 1], refs)))) for k in range(12)]
    low = 0.9 * lengths(blocks[3].x) ** 2
    hit = [len(overlapping(blocks[3], b, low, np.full(50, np.inf))[0]) for b in blocks]
    assert hit[3] == 50 and sum(hit) < 150
