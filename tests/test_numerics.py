import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridhazard.operators import economy as EC
from gridhazard.operators import extremes as X
from gridhazard.operators import fields as V
from gridhazard.operators import geo as G
from gridhazard.operators import reliability as L
from gridhazard.operators import series as R


def test_nearest_fill_ties_and_edges(spark):
    vals = [None, None, 1.0, None, None, None, 5.0, None]
    d = spark.createDataFrame([("s", t, v) for t, v in enumerate(vals)], "site string, t bigint, v double")
    got = [r.f for r in R.nearest_filled(d, ["site"], "v", "f").orderBy("t").collect()]
    assert got == [1.0, 1.0, 1.0, 1.0, 1.0, 5.0, 5.0, 5.0]


def test_shared_grid_is_dealt_once_by_its_first_key(spark):
    rows = [(s, c, t, t, float(s + t)) for s in range(6) for c in ("a", "b") for t in (3, 5, 9) if (s + t) % 4] + [(1, "a", 9, 99, -1.0), (None, "a", 3, 1, 2.0)]
    d = spark.createDataFrame(rows, "site bigint, channel string, t bigint, seq bigint, value double")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        grid = R.on_shared_grid(d, ["site", "channel"], "value", "v")
        out = grid.groupBy("site", "t").agg(F.max(F.struct("channel", "v")).alias("m"))
        got = {(r.site, r.channel, r.t): r.v for r in grid.collect()}
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    first = {(s, c, t): v for s, c, t, seq, v in rows if seq != 99 and s is not None}
    keys = {(s, c) for s, c, *_ in rows}
    assert got == {(*k, t): first.get((*k, t)) for k in keys for t in (3, 5, 9)}
    assert "Exchange" not in plan[:plan.index("SortMergeJoin")]


def test_detrend_removes_a_line(spark):
    d = spark.createDataFrame([("s", 480000 + t, 3.0 + 0.5 * t) for t in range(50)], "site string, t bigint, v double")
    assert max(abs(r.r) for r in R.detrended(d, ["site"], "v", "r").collect()) < 1e-8


def test_trim_falls_back_when_short(spark):
    rows = [(0, "a", t) for t in range(20)] + [(0, "b", t) for t in range(5)]
    d = R.trimmed(spark.createDataFrame(rows, "storm int, site string, t bigint"), "storm", "site", 4)
    got = {r.site: r.c for r in d.groupBy("site").agg(F.collect_list("t").alias("c")).collect()}
    assert sorted(got["a"]) == list(range(4, 16)) and got["b"] == [2]


def brute_peaks(s, distance, share, top):
    c = [i for i in range(1, len(s) - 1) if s[i] > s[i - 1] and s[i] > s[i + 1]]
    kept = []
    for i in sorted(c, key=lambda i: (-s[i], i)):
        if all(abs(i - j) >= distance for j in kept):
            kept.append(i)

    def prom(i):
        left, right = i, i
        lo, hi = s[i], s[i]
        while left >= 0 and s[left] <= s[i]:
            lo, left = min(lo, s[left]), left - 1
        while right < len(s) and s[right] <= s[i]:
            hi, right = min(hi, s[right]), right + 1
        return s[i] - max(lo, hi)

    good = [i for i in kept if prom(i) >= share * max(s)]
    return set(sorted(good, key=lambda i: (-s[i], i))[:top]) or {int(np.argmax(s))}


@pytest.mark.parametrize("seed", range(2))
def test_peaks_match_brute_force(spark, seed):
    s = np.abs(np.random.default_rng(seed).normal(size=150).cumsum())
    flat = [(1, t, float(5 - t)) for t in range(6)]
    d = spark.createDataFrame([(0, t, float(v)) for t, v in enumerate(s)] + flat, "storm int, t bigint, s double")
    got = V.activity_peaks(d, 10, 0.2, 3).collect()
    assert {r.t for r in got if r.storm == 0} == brute_peaks(list(s), 10, 0.2, 3)
    assert [r.t for r in got if r.storm == 1] == [0]  # no peak: the maximum


def test_gaussian_filter_mirrors_the_ends(spark):
    s = np.random.default_rng(1).normal(size=7)
    d = spark.createDataFrame([(0, t, float(v)) for t, v in enumerate(s)], "storm int, t bigint, s double")
    out = R.window_arrays(d, "storm", "s").select(F.explode(R.gaussian_smoothed(F.col("samples"), 1.0)).alias("x")).select("x.*")
    w, ext = np.array(R.gaussian_weights(1.0, 4)), np.pad(s, 4, mode="symmetric")
    want = [float(w @ ext[i : i + 9]) for i in range(7)]
    assert [r.s for r in out.orderBy("t").collect()] == pytest.approx(want)


def test_synthesised_field_is_the_linear_map(spark):
    obs = [(1, 40.0, -100.0), (2, 45.0, -90.0), (3, 35.0, -110.0)]
    sites = [(10, 41.0, -99.0), (11, 36.0, -95.0)]
    rnd = np.random.default_rng(0)
    b = {(t, o): rnd.normal(size=2) for t in range(30) for o, _, _ in obs}
    od = spark.createDataFrame([(5, o, la, lo) for o, la, lo in obs], "storm int, obs int, lat double, lon double")
    sd = spark.createDataFrame(sites, "site int, lat double, lon double")
    bd = spark.createDataFrame([(5, t, o, float(v[0]), float(v[1])) for (t, o), v in b.items()], "storm int, t bigint, obs int, bx double, by double")
    got = {(r.t, r.site): (r.bx, r.by) for r in V.synthesised_field(bd, V.transfer_weights(od, sd, 2)).collect()}
    m = V.transfer_matrix([o[1] for o in obs], [o[2] for o in obs], [s[1] for s in sites], [s[2] for s in sites])
    for t in range(30):
        out = m @ np.r_[[b[(t, o)][0] for o, _, _ in obs], [b[(t, o)][1] for o, _, _ in obs]]
        for k, (s, _, _) in enumerate(sites):
            assert got[(t, s)] == pytest.approx((out[k], out[k + 2]))


def test_products_of_weights_and_field_are_not_exchanged(spark):
    rnd = np.random.default_rng(1)
    field = [(t, s, float(rnd.normal()), float(rnd.normal())) for t in range(12) for s in range(9) if (t + s) % 5] + [(3, 1, 0.5, None), (3, 2, 0.5, 2.0)]
    weights = [(line, s, float(rnd.normal()), float(rnd.normal())) for line in (None, *range(40)) for s in range(0, 9, 1 + (line or 0) % 3)]
    e = spark.createDataFrame(field, "t bigint, site bigint, ex double, ey double")
    w = spark.createDataFrame(weights, "line bigint, site bigint, wx double, wy double")
    out = V.line_voltages(e, w, blocks=5)
    want = {}
    for t, s, ex, ey in field:
        for line, at, wx, wy in weights:
            if at == s:
                want[t, line] = want.get((t, line), 0.0) + (0.0 if ey is None else wx * ex + wy * ey)
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert {(r.t, r.line): r.v for r in out.collect()} == pytest.approx(want)
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert "Exchange" not in plan[:plan.index("SortMergeJoin")]


def test_groups_of_weighed_sites_do_not_grow_with_the_sites(spark, monkeypatch):
    real = V.transfer_matrix

    def bounded(obs_lat, obs_lon, site_lat, site_lon):
        if len(site_lat) > 500:
            raise ValueError(f"{len(site_lat)} sites in one group")
        return real(obs_lat, obs_lon, site_lat, site_lon)

    monkeypatch.setattr(V, "transfer_matrix", bounded)
    od = spark.createDataFrame([(5, 1, 40.0, -100.0)], "storm int, obs int, lat double, lon double")
    sd = spark.range(6000).select(F.col("id").alias("site"), (30.0 + F.col("id") % 20).alias("lat"), (-120.0 + F.col("id") % 50).alias("lon"))
    assert V.transfer_weights(od, sd).count() == 6000


def test_transfer_reproduces_a_uniform_field_nearby():
    lat, lon = np.meshgrid([35.0, 40.0, 45.0], [-110.0, -100.0, -90.0])
    m = V.transfer_matrix(lat.ravel(), lon.ravel(), [41.0], [-99.0])
    bx, by = m @ np.r_[np.full(9, 100.0), np.zeros(9)]
    assert bx == pytest.approx(100.0, rel=0.2) and abs(by) < 20


def test_electric_field_of_a_constant_impedance(spark):
    t = np.arange(64)
    bx = np.sin(2 * np.pi * 4 * t / 64)
    f = spark.createDataFrame([(1, 2, int(i), float(v), 0.0) for i, v in zip(t, bx)], "storm int, site int, t bigint, bx double, by double")
    z = [(2, p, "yx", 2.0, 0.0) for p in (60.0, 60.0 * 64 * 10)]
    z = spark.createDataFrame(z, "site int, period double, element string, z_re double, z_im double")
    e = V.electric_field(f, z, 60.0).orderBy("t").collect()
    assert [r.ey for r in e] == pytest.approx(list(2 * bx), abs=1e-9)
    assert max(abs(r.ex) for r in e) == 0


def test_bootstrap_draws_follow_the_sorted_pool(spark):
    rnd = np.random.default_rng(2)
    vals = np.r_[np.full(300, 4.25), rnd.lognormal(1, 1, 200).round(2)]
    d = spark.createDataFrame([(1, float(v)) for v in vals], "e int, x double")
    pool = X.sampling_pool(d, "e", "x")
    got = X.bootstrap_draws(pool, 0.5, attempts=5, n_years=39).collect()
    from gridhazard.functions.rng import uniform

    u = spark.createDataFrame([(1, a, k) for a in range(5) for k in range(39)], "entity int, attempt int, k int")
    us = {(r.attempt, r.k): r.u for r in u.withColumn("u", uniform(7, "entity", "attempt", "k")).collect()}
    s = np.sort(vals)
    assert len(got) == 195
    assert all(r.x == s[int(us[(r.attempt, r.k)] * len(s))] for r in got)


def test_truncated_fit_beats_its_neighbourhood(spark):
    from math import erfc, log, sqrt

    rng = np.random.default_rng(4)
    samples = {"a": rng.lognormal(1.0, 0.6, 400), "b": -rng.lognormal(-3.0, 1.5, 60), "c": rng.uniform(5, 9, 39)}
    rows = [(e, 0, float(v)) for e, x in samples.items() for v in x]
    rows += [("few", 0, 1.0 + k) for k in range(4)] + [("flat", 0, 2.0)] * 9 + [("heavy", 0, float(10.0 ** k)) for k in range(12)]
    rows += [("odd", 0, v) for v in (float("nan"), float("inf"), 0.0)]
    fits = {r.entity: r for r in X.fitted_truncated(spark.createDataFrame(rows, "entity string, attempt int, x double")).collect()}
    assert set(samples) <= set(fits) and not {"few", "flat", "odd"} & set(fits)
    for e, x in samples.items():
        mu, sigma, xmin, n = fits[e].mu, fits[e].sigma, fits[e].xmin, fits[e].n
        assert xmin == pytest.approx(max(abs(x).min(), np.percentile(abs(x), 1.0))) and fits[e].sgn == np.sign(x.mean())
        y = np.log(abs(x)[abs(x) >= xmin])

        def loss(m, s):
            return ((y - m) ** 2).mean() / (2 * s * s) + log(s) + log(0.5 * erfc((log(xmin) - m) / (s * sqrt(2))))

        best = loss(mu, sigma)
        assert n == len(y) and sigma > 0
        for dm in (-0.02, 0.02):
            for ds in (-0.02, 0.02):
                assert loss(mu + dm * sigma, sigma * (1 + ds)) > best


def test_truncated_fit_stays_native(spark):
    plan = X.fitted_truncated(spark.createDataFrame([("a", 0, 1.0)], "entity string, attempt int, x double"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_points_and_centres_without_a_place_take_no_part(spark):
    inf, nan = float("inf"), float("nan")
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, inf, 0.0), (3, nan, 0.0), (4, None, 1.0), (5, 1e9, -inf)], "id long, x double, y double")
    centres = spark.createDataFrame([(7, 3.0, 4.0), (8, nan, nan), (9, inf, 0.0), (10, None, 0.0)], "cid long, x double, y double")
    assert [tuple(r) for r in G.nearest_centres(points, centres, "id", "cid", 0.5).collect()] == [(1, 7, 5.0)]
    assert G.nearest_centres(points, centres.filter("cid > 7"), "id", "cid", 0.5).collect() == []


@pytest.mark.parametrize("cell", [0.001, 0.05, 3.0])
def test_nearest_centre_is_exact(spark, cell):
    rnd = np.random.default_rng(8)
    p = np.r_[rnd.normal(0, 0.02, (60, 2)), rnd.uniform(-1, 1, (38, 2)), [[50.0, 50.0], [-900.0, 3.0]]]  # two far away
    c = np.r_[rnd.normal(0, 0.02, (30, 2)), rnd.uniform(-1, 1, (5, 2))]
    pd_ = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(p)], "id int, x double, y double")
    cd = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(c)], "cid int, x double, y double")
    got = {r.id: r.cid for r in G.nearest_centres(pd_, cd, "id", "cid", cell).collect()}
    d = ((p[:, None] - c[None]) ** 2).sum(2)
    assert got == {i: int(d[i].argmin()) for i in range(len(p))}


def test_projection_and_centroid(spark):
    x, y = G.albers(F.lit(-96.0), F.lit(23.0))
    r = spark.range(1).select(x.alias("x"), y.alias("y")).first()
    assert (r.x, r.y) == (pytest.approx(0, abs=1e-6), pytest.approx(0, abs=1e-6))
    v = lambda a, b: F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"))
    ring = F.array(v(0.0, 0.0), v(4.0, 0.0), v(4.0, 2.0), v(0.0, 2.0))
    s = spark.range(1).select(G.shoelace(ring).alias("s")).first().s
    assert (s.area, s.cx, s.cy) == (8.0, 2.0, 1.0)


def test_referencing_along_a_line(spark):
    v = [(0.0, 0.0), (3.0, 0.0), (3.0, 4.0)]
    lines = spark.createDataFrame([("L", v)], "line string, vertices array<struct<x:double,y:double>>")
    pts = spark.createDataFrame([("a", 1.0, 0.01), ("b", 3.02, 2.0), ("c", 9.0, 9.0)], "sub string, x double, y double")
    d = G.near_lines(G.line_segments(lines, "line"), pts, "line", "sub", 0.05, 0.7).collect()
    got = {r.sub: (r.dist, r.pos) for r in d}
    assert got["a"] == (pytest.approx(0.01), pytest.approx(1.0)) and got["b"] == (pytest.approx(0.02), pytest.approx(5.0)) and "c" not in got


def test_stopping_rule_in_batches_equals_the_rule_over_all_draws(spark, monkeypatch):
    rows = [(1, "s", u, 500.0, 10.0 + u) for u in range(3)] + [(2, "s", u, 0.0, 5.0) for u in range(2)] + [(3, "s", 0, 60.0, 7.0), (3, "t", 0, 20.0, 7.0), (4, "s", 0, 1.0, 0.0)]
    units = spark.createDataFrame(rows, "realization int, scenario string, sub_id int, gic double, pop double")
    made = []
    drawn = L.with_draws
    monkeypatch.setattr(L, "with_draws", lambda d, n, *a: (out := drawn(d, n, *a), made.append(out.select("realization", "scenario", "draw").distinct().count()))[0])
    rule = {"batch": 50, "minimum": 100, "give_up": 220, "tolerance": 0.1, "cap": 380}
    got = {(r.realization, r.scenario): (r.n_stop, round(r.pop, 9)) for r in L.stopped_means(units, ["pop"], "pop", **rule).collect()}
    monkeypatch.undo()
    totals = L.draw_totals(L.with_failures(L.with_failure_chance(L.with_draws(units, 380))), ["pop"]).toPandas().sort_values("draw")
    want = {}
    for key, d in totals.groupby(["realization", "scenario"]):
        x = d["pop"].to_numpy()
        for n in (*range(50, 380, 50), 380):
            m = x[:n].mean()
            if n >= 100 and ((1.96 * x[:n].std(ddof=1) / np.sqrt(n) / m < 0.1) if m else n > 220):
                break
        want[key] = (n, round(x[:n].mean(), 9))
    assert got == want and len({n for n, _ in got.values()}) >= 3
    assert sum(made) == sum(n for n, _ in got.values())  # no draw past a stop


def test_stopping_rule_defaults():
    import inspect

    told = inspect.signature(L.stopped_means).parameters
    assert [told[k].default for k in ("batch", "minimum", "give_up", "tolerance", "cap")] == [2000, 5000, 10000, 0.1, 20000]


def test_inverse_equals_dense(spark):
    rnd = np.random.default_rng(3)
    m = rnd.uniform(0, 0.15, (4, 4))
    d = spark.createDataFrame([(f"s{i}", f"s{j}", float(m[i, j])) for i in range(4) for j in range(4)], "row string, col string, a double")
    want = np.linalg.inv(np.eye(4) - m)
    got = {(r.row, r.col): r.a for r in EC.sector_inverse(d).collect()}
    assert all(got[(f"s{i}", f"s{j}")] == pytest.approx(want[i, j], rel=1e-9) for i in range(4) for j in range(4))


def test_inverse_converges_or_raises(spark):
    one = lambda a: spark.createDataFrame([("s", "s", a)], "row string, col string, a double")
    assert EC.sector_inverse(one(0.999)).first().a == pytest.approx(1000.0)
    with pytest.raises(RuntimeError):
        EC.sector_inverse(one(1.0), doublings=6)


def test_dasymetric_keeps_totals(spark):
    px = spark.createDataFrame([(z, s) for z in range(3) for s in (0, 0, 1, z)], "zcta int, sub int")
    am = spark.createDataFrame([(z, 10.0 * (z + 1)) for z in range(3)], "zcta int, pop double")
    assert EC.dasymetric(px, "zcta", "sub", am, ["pop"]).agg(F.sum("pop")).first()[0] == pytest.approx(60.0)


def test_allocation_keeps_state_totals(spark):
    est = spark.createDataFrame([(z, "11", "S", float(z + 1)) for z in range(4)] + [(9, "UNCLFD", "S", 2.0)], "zcta int, naics string, state string, est double")
    gdp = spark.createDataFrame([("S", "11", 100.0), ("S", "92", 50.0)], "state string, naics string, gdp double")
    got = {r.naics: r.g for r in EC.allocated_output(est, gdp).groupBy("naics").agg(F.sum("gdp").alias("g")).collect()}
    assert got == {"11": pytest.approx(100.0), "UNCLFD": pytest.approx(50.0)}


def test_inverse_distance_keeps_every_point(spark):
    pts = spark.createDataFrame([(1, 0.0, 0.0), (2, 10.0, 10.0)], "id int, x double, y double")
    sites = spark.createDataFrame([(0.05, 0.0, 3.0), (0.0, 0.05, 5.0), (-3.0, 0.0, 9.0)], "sx double, sy double, v double")
    got = {r.id: (r.value, r.n) for r in G.inverse_distance(pts, sites, "id", "v", 0.1).collect()}
    assert got == {1: (pytest.approx(4.0), 2), 2: (3.0, 0)}


def polyline(points):
    return [{"x": float(x), "y": float(y)} for x, y in points]


VERTICES = "vertices array<struct<x:double,y:double>>"


def test_lines_meet_regions_without_a_vertex_inside(spark):
    square = [(0, 0), (4, 0), (4, 4), (0, 4)]
    rings = spark.createDataFrame([("r", polyline(square)), ("far", polyline([(x + 50, y) for x, y in square]))], "region string, ring array<struct<x:double,y:double>>")
    lines = {
        "crosses": [(-9, 1), (9, 2)], "inside": [(1, 1), (2, 2), (1, 3)], "around": [(-1, -1), (-1, 5), (5, 5), (5, -1)], "touches": [(-3, 4), (9, 4)],
        "corner": [(-1, 1), (1, -1)], "at a corner": [(4, 4), (9, 9)], "out": [(5, 0), (9, 9)], "along": [(1, 0), (3, 0)], "misses": [(-1, 6), (6, -1)], "point": [(1, 1)], "both": [(-5, 2), (60, 2)]}
    d = spark.createDataFrame([(k, polyline(v)) for k, v in lines.items()] + [("empty", [])], f"line string, {VERTICES}")
    for cell in (0.7, 3.0, 500.0):
        got = {(r.line, r.region) for r in G.lines_meeting_rings(d, rings, "line", "region", cell).collect()}
        want = {"crosses", "inside", "touches", "at a corner", "along", "point", "both", "misses"}
        assert got == {(k, "r") for k in want | {"corner"}} | {("both", "far")}


def test_pieces_of_a_line_sum_to_its_length(spark):
    rng = np.random.default_rng(5)
    walk = np.cumsum(rng.normal(size=(300, 2)), axis=0)
    steps = np.hypot(*np.diff(walk, axis=0).T)
    at = np.append(0, np.cumsum(steps))
    cuts = np.sort(np.concatenate([[0, at[-1], at[100]], rng.uniform(0, at[-1], 20)]))
    pairs = spark.createDataFrame([(1, k, float(a), float(b)) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))], "line int, piece int, pos_b double, pos_a double")
    line = spark.createDataFrame([(1, polyline(walk))], f"line int, {VERTICES}")
    total = 0.0
    for r in G.line_pieces(line, pairs, "line").collect():
        x = np.array([(v["x"], v["y"]) for v in r.vertices])
        low, high = sorted((r.pos_a, r.pos_b))
        assert np.hypot(*np.diff(x, axis=0).T).sum() == pytest.approx(high - low)
        for end, p in ((x[0], low), (x[-1], high)):
            assert end == pytest.approx([np.interp(p, at, walk[:, 0]), np.interp(p, at, walk[:, 1])])
        total += high - low
    assert total == pytest.approx(at[-1])
    seg = G.line_segments(line, "line").orderBy("seg").toPandas()
    assert seg["before"].to_numpy() == pytest.approx(at[:-1]) and seg["len"].to_numpy() == pytest.approx(steps)


def test_output_from_final_demand_equals_the_inverse(spark):
    import numpy as np

    from gridhazard.operators import economy as E

    m = np.array([[0.1, 0.2, 0.0], [0.1, 0.2, 0.1], [0.2, 0.1, 0.05]])
    a = spark.createDataFrame([(f"s{i}", f"s{j}", float(m[i, j])) for i in range(3) for j in range(3)], "row string, col string, a double")
    f = {("p", 1): [5.0, 0.0, 0.0], ("p", 2): [0.0, -3.0, 7.0], ("q", 1): [1e9, 1.0, 2.0], ("q", 2): [0.0, 0.0, 0.0]}
    rows = [(k[0], k[1], f"s{i}", v[i]) for k, v in f.items() for i in range(3)] + [("z", 1, "outside", 4.0), ("z", 1, "outside", 2.0), (None, 1, "s0", 0.0)]
    got = {(r.run, r.n, r.sector): r.x for r in E.demand_outputs(a, spark.createDataFrame(rows, "run string, n int, sector string, shock double"), ["run", "n"]).collect()}
    inverse = np.linalg.inv(np.eye(3) - m)
    for k, v in f.items():
        want = inverse @ np.array(v)
        assert [got[(*k, f"s{i}")] for i in range(3)] == pytest.approx(list(want), rel=1e-9, abs=1e-9)
    assert (None, 1, "s0") in got
    assert got[("z", 1, "outside")] == 6.0  # a sector without coefficients calls for nothing else


def test_output_from_final_demand_raises_without_a_convergent_series(spark):
    from gridhazard.operators import economy as E

    a = spark.createDataFrame([("s", "s", 1.5)], "row string, col string, a double")
    f = spark.createDataFrame([(1, "s", 1.0)], "k int, sector string, shock double")
    with pytest.raises(RuntimeError, match="settle"):
        E.demand_outputs(a, f, ["k"], max_rounds=2)
    assert E.demand_outputs(a, f.filter("k > 1"), ["k"]).count() == 0


def test_use_accounts_take_known_cells_and_total_them(spark):
    from gridhazard.operators import economy as E

    use = spark.createDataFrame(
        [("11", "21", 5.0), ("22", "21", 7.0), ("23", "21", None), ("V001", "21", 2.0), ("11", "F010", 4.0), ("11", "T019", 99.0), ("T001", "21", 99.0),
         ("T018", "21", 50.0), ("T018", "F010", 99.0), (None, "21", 99.0), ("11", None, 99.0)],
        "code string, column_code string, value double",
    )
    groups = {"11": "AGR", "21": "MINING", "22": "UTIL_CONST", "23": "UTIL_CONST"}
    d = E.use_accounts(use, groups, ("V001",), ("F010",), "T018")
    got = {(r.account, r.row, r.col): r.value for r in d.collect()}
    assert got == {
        ("flow", "AGR", "MINING"): 5.0, ("flow", "UTIL_CONST", "MINING"): 7.0, ("flow", None, "MINING"): 12.0, ("flow", "AGR", None): 5.0, ("flow", "UTIL_CONST", None): 7.0,
        ("value_added", "V001", "MINING"): 2.0, ("value_added", None, "MINING"): 2.0, ("value_added", "V001", None): 2.0,
        ("final_demand", "AGR", "F010"): 4.0, ("final_demand", None, "F010"): 4.0, ("final_demand", "AGR", None): 4.0,
        ("output", "T018", "MINING"): 50.0, ("output", None, "MINING"): 50.0, ("output", "T018", None): 50.0,
    }
    assert [tuple(r) for r in E.account_totals(d, "final_demand", "row").collect()] == [("AGR", 4.0)]


def test_stops_of_lines_are_not_exchanged_nor_found_twice(spark):
    from gridhazard.operators import topology as T

    at = lambda *v: F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in v])
    lines = spark.range(3000).select(F.col("id").alias("line"), at((0, 0), (1, 0), (1, 1)).alias("vertices"))
    points = spark.range(5).select(F.col("id").alias("sub"), (F.col("id") * 0.3).alias("x"), F.lit(0.01).alias("y"))
    pairs = T.along(G.near_lines(G.line_segments(lines, "line"), points, "line", "sub", 0.05, 0.1), "line", ["pos", "sub"], "sub")
    d = T.segment_ids(pairs.select("line", "a", "b"), "line")
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert plan.count(" Exchange ") == 1 and plan.count("BroadcastHashJoin") == 1  # segments are dealt once, hits never
    assert sorted(map(tuple, d.filter("line = 1").collect())) == [(1, 0, 1, "1_0_1"), (1, 1, 2, "1_1_2"), (1, 2, 3, "1_2_3")]
    pieces = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (2, 3)], "a int, b int")
    assert sorted(map(tuple, T.adjacency(pieces).collect())) == [(1, 2), (2, 1), (2, 3), (3, 2)]


def test_first_valid_attempts_read_the_levels_once(spark):
    rows = [(e, a, p, float("nan") if (e, a, p) == (1, 1, 50) else None if (e, a, p) == (2, 0, 25) else a + p / 100)
            for e in (1, 2, None) for a in range(4) for p in (25, 50)]
    levels = spark.createDataFrame(rows, "entity bigint, attempt int, period int, value double")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = X.first_valid(levels, 2)
        plan = out._jdf.queryExecution().executedPlan().toString()
        got = sorted((r.entity, r.attempt, r.period, r.sample) for r in out.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1
    assert got == [(1, 0, 25, 0), (1, 0, 50, 0), (1, 2, 25, 1), (1, 2, 50, 1), (2, 1, 25, 0), (2, 1, 50, 0), (2, 2, 25, 1), (2, 2, 50, 1)]


def test_draws_are_made_in_tasks_of_a_bounded_number(spark, monkeypatch):
    pool = spark.createDataFrame([(e, float(v), 1) for e in range(40) for v in range(1, 6)], "entity bigint, x double, copies bigint")
    plans = []
    for most in (X.DRAW_ROWS, 100):
        monkeypatch.setattr(X, "DRAW_ROWS", most)
        out = X.bootstrap_draws(pool, 5.0, attempts=5, n_years=10)
        plans.append((out._jdf.queryExecution().executedPlan().toString(), sorted(map(tuple, out.collect()))))
    assert "REPARTITION_BY_NUM" in plans[1][0] and "Exchange hashpartitioning(entity#" in plans[1][0]
    assert any(line.rstrip().split(", REPARTITION_BY_NUM")[0].endswith(", 20)") for line in plans[1][0].splitlines() if "REPARTITION_BY_NUM" in line)
    assert plans[0][1] == plans[1][1] and len(plans[0][1]) == 40 * 50


def test_segments_meet_points_of_the_cells_they_pass(spark):
    """As brute force finds; points met are few for each hit, and pieces do not look their segments up."""
    rng = np.random.default_rng(11)
    radius, walks = 0.01, np.cumsum(rng.normal(scale=0.3, size=(6, 12, 2)), axis=1)
    walks[4, :, 0], walks[5, :, 1] = 0.25, -0.5  # upright and level ones, on the borders of cells
    walks[3, 5] = walks[3, 4]  # a segment without length
    pts = np.concatenate([rng.uniform(-1.5, 1.5, (4000, 2)), walks[:, 3], walks[:, 4] + [radius * 0.999, 0], [[0.25, y] for y in np.arange(-1, 1, 0.05)]])
    lines = spark.createDataFrame([(k, polyline(w)) for k, w in enumerate(walks)] + [(9, polyline([(0.0, 0.0), (float("inf"), 1.0), (float("nan"), 0.0)]))], f"line int, {VERTICES}")
    points = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(pts)], "sub int, x double, y double")
    d = G.near_lines(G.line_segments(lines, "line"), points, "line", "sub", radius, 0.5)
    got = {(r.line, r.sub): (r.dist, r.pos, r.seg) for r in d.collect()}
    want = {}
    for k, w in enumerate(walks):
        step = np.diff(w, axis=0)
        size = np.hypot(*step.T)
        before = np.append(0, np.cumsum(size))
        for s in range(len(step)):
            t = np.clip(((pts - w[s]) @ step[s]) / max(size[s] ** 2, 1e-300), 0, 1)
            dist = np.hypot(*(w[s] + t[:, None] * step[s] - pts).T)
            for p in np.flatnonzero(dist <= radius):
                want[k, p] = min(want.get((k, p), (9.0,)), (dist[p], before[s] + t[p] * size[s], s))
    assert got.keys() == want.keys()
    assert all(got[k][:2] == pytest.approx(want[k][:2], abs=1e-9) for k in want)
    stops = sorted((r for r in d.collect() if r.line == 0), key=lambda r: (r.pos, r.sub))
    pairs = spark.createDataFrame([(0, a.pos, b.pos, a.seg, b.seg) for a, b in zip(stops, stops[1:])], "line int, pos_a double, pos_b double, seg_a int, seg_b int")
    told, found = G.line_pieces(lines, pairs, "line"), G.line_pieces(lines, pairs.drop("seg_a", "seg_b"), "line")
    key = lambda r: (r.pos_a, r.pos_b)
    for p, q in zip(sorted(told.collect(), key=key), sorted(found.collect(), key=key)):
        assert np.array(p.vertices) == pytest.approx(np.array(q.vertices), abs=1e-12)


def test_points_met_for_a_segment_are_few_for_each_hit(spark):
    """A long slanting segment stands in the cells it passes: 400 points on a lattice, of which a hundredth is near it."""
    line = spark.createDataFrame([(1, polyline([(0.0, 0.0), (0.95, 0.95)]))], f"line int, {VERTICES}")
    points = spark.range(400).select("id", (F.floor(F.col("id") / 20) * 0.05 + 0.013).alias("x"), (F.col("id") % 20 * 0.05).alias("y"))
    d = G.near_lines(G.line_segments(line, "line"), points, "line", "id", 0.01, 0.5)
    joined = [n for n in _nodes(d._jdf.queryExecution().analyzed()) if n.nodeName() == "Join"]
    rows = spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, joined[0]).count()
    assert 19 <= d.count() and rows < 100


def _nodes(plan):
    yield plan
    children = plan.children()
    for k in range(children.size()):
        yield from _nodes(children.apply(k))
