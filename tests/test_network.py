import numpy as np
import pytest
from benchmark_grid import INF, LINES, NO_NEUTRAL, SUBSTATIONS, TRANSFORMERS
from pyspark.sql import functions as F

from gridhazard.functions.fixed_values import WINDING_OHM
from gridhazard.functions.scalar import east_north_km
from gridhazard.operators import network as N

BUS_SUB = {b: s[0] for s in SUBSTATIONS for b in s[1]}


def grid(spark):
    sub = {s[0]: s for s in SUBSTATIONS}
    rows = []
    for name, a, b, r, _ in LINES:
        p, q = sub[BUS_SUB[a]], sub[BUS_SUB[b]]
        rows.append((0, name, a, b, r, p[3], p[4], q[3], q[4]))
    d = spark.createDataFrame(rows, "realization int, line string, a int, b int, r double, la1 double, lo1 double, la2 double, lo2 double")
    east, north = east_north_km(*[F.col(c) for c in ("la1", "lo1", "la2", "lo2")])
    lines = d.select("realization", "line", "a", "b", "r", F.explode(F.array(
        F.struct(F.lit("east").alias("scenario"), east.alias("v")), F.struct(F.lit("north").alias("scenario"), north.alias("v"))
    )).alias("s")).select("realization", "line", "a", "b", "r", "s.*")
    tr = spark.createDataFrame(
        [(0, BUS_SUB[b1], n, t, b1, b2, 100 + BUS_SUB[b1], w1, w2) for n, t, w1, b1, w2, b2 in TRANSFORMERS],
        "realization int, sub_id int, name string, type string, bus1 int, bus2 int, neutral int, w1 double, w2 double",
    )
    st = spark.createDataFrame(
        [(0, s[0], 100 + s[0], s[2]) for s in SUBSTATIONS if s[0] != NO_NEUTRAL], "realization int, sub_id int, neutral int, rg double"
    )
    return lines, tr, st


def assembled(spark):
    lines, tr, st = grid(spark)
    single = lines.filter("scenario = 'east'")
    branches = N.line_branches(single).unionByName(N.transformer_branches(tr))
    earth = N.earthing(st)
    return lines, tr, st, earth, branches, N.stamped(branches, earth)


def test_matrix_is_symmetric_with_zero_row_sums_before_earthing(spark):
    _, _, _, _, branches, _ = assembled(spark)
    m = {(r.i, r.j): r.y for r in N.stamped(branches).collect()}
    assert all(m[(j, i)] == pytest.approx(y) for (i, j), y in m.items())
    for i in {i for i, _ in m}:
        assert sum(y for (a, _), y in m.items() if a == i) == pytest.approx(0, abs=1e-9)
    assert m[(5, 11)] == 0.0  # open line


def test_solution_matches_dense_algebra_on_both_paths(spark):
    lines, tr, st, earth, _, coo = assembled(spark)
    keep = N.grounded_nodes(coo, earth)
    inside = coo.join(keep, ["realization", "i"], "left_semi").join(keep.withColumnRenamed("i", "j"), ["realization", "j"], "left_semi")
    rhs = N.injections(lines).join(keep, ["realization", "i"], "left_semi")
    nodes = sorted(r.i for r in keep.collect())
    assert 7 not in nodes and 1 not in nodes  # generator-side buses carry nothing
    m, b = np.zeros((len(nodes),) * 2), {s: np.zeros(len(nodes)) for s in ("east", "north")}
    for r in inside.collect():
        m[nodes.index(r.i), nodes.index(r.j)] = r.y
    for r in rhs.collect():
        b[r.scenario][nodes.index(r.i)] = r.b
    m += 1e-6 * np.eye(len(nodes))
    for limit in (10**6, 0):
        v = N.solve(inside, rhs, group_entries=limit, tol=1e-9)
        got = {(r.scenario, r.i): r.v for r in v.collect()}
        for s in b:
            assert [got[(s, i)] for i in nodes] == pytest.approx(list(np.linalg.solve(m, b[s])), rel=1e-5, abs=1e-5)
    g = {(r.scenario, r.sub_id): r.gic for r in N.ground_currents(st.select("realization", "sub_id", "neutral"), earth, v, ["east", "north"]).collect()}
    for s in b:
        assert sum(x for (k, _), x in g.items() if k == s) == pytest.approx(0, abs=0.01)
    assert g[("east", 1)] == 0.0
    res = N.residuals(inside, v, rhs).collect()
    assert all(r.residual < 1e-3 for r in res)
    w = N.winding_currents(tr, v, ["east"]).filter("name = 'T5'").collect()
    assert {r.winding for r in w} == {"Series", "Common"}
    # Kirchhoff at a neutral: its three-phase ground current is three times the winding currents into it.
    n2 = N.winding_currents(tr, v, ["east"]).filter("sub_id = 2").agg(F.sum("gic")).first()[0]
    assert 3 * n2 == pytest.approx(g[("east", 2)], abs=0.05)


def test_components_long_chain_star_and_keys(spark):
    chain = [(0, i, i + 1) for i in range(200)]
    star = [(1, 500, k) for k in range(300, 420)] + [(1, 7, 8)]
    lab = N.components(spark.createDataFrame(chain + star, "realization int, a int, b int"))
    got = {(r.realization, r.node): r.label for r in lab.collect()}
    assert {v for (k, _), v in got.items() if k == 0} == {0}
    assert got[(1, 500)] == 300 and got[(1, 419)] == 300 and got[(1, 8)] == 7


def test_exact_share_of_open_groundings(spark):
    st = spark.range(250).select(F.lit(3).alias("realization"), F.col("id").alias("sub_id"))
    d = N.random_grounding(st, share_open=0.05, skip=(1, 2)).collect()
    assert sum(r.rg == INF for r in d) == 12  # floor(0.05 * 248)
    assert all(0.1 <= r.rg < 0.2 for r in d if r.rg is not None and r.rg != INF)
    assert {r.sub_id for r in d if r.rg is None} == {1, 2}


def test_every_variant_keeps_a_step_up_unit(spark):
    rows = [(k, k % 3, f"T{k}_{i}", "GSU") for k in range(60) for i in range(1)]
    d = N.limited_gsus(spark.createDataFrame(rows, "realization int, sub_id int, name string, type string"))
    assert d.select("realization").distinct().count() == 60


def test_added_units_have_unique_names(spark):
    rows = [(k, 1, f"T{i}", "Auto") for k in range(40) for i in range(2)]
    d = N.added_units(spark.createDataFrame(rows, "realization int, sub_id int, name string, type string"))
    per = d.groupBy("realization").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("name").alias("u")).collect()
    assert all(r.n == r.u and 3 <= r.n <= 5 for r in per)


def test_config_diff(spark):
    a = spark.createDataFrame([("x", "A"), ("y", "B"), ("z", None)], "name string, type string")
    b = spark.createDataFrame([("x", "A"), ("y", "C"), ("w", "A"), ], "name string, type string")
    assert {r.name: r.change for r in N.config_diff(a, b, "name", ["type"]).collect()} == {"y": "type", "z": "removed", "w": "added"}


def test_base_and_variant_currents_match_dense_algebra(spark):
    """One solve for both configurations; each equals its own dense system, open parts carry nothing."""
    lines = [("L1", 1, 2, 0.5), ("L2", 2, 3, 1.0), ("L3", 1, 3, 2.0), ("L4", 3, 4, 1.5)]
    volts = {"L1": 5.0, "L2": -2.0, "L3": 1.0, "L4": 3.0}
    units = [(1, "T1", "GSU", 1, 1, 11), (2, "T2", "GY-D", 2, 2, 12), (4, "T4", "GSU", 4, 4, 14)]
    sites = [(1, 11, 0.1), (2, 12, 0.2), (4, 14, 0.15)]

    def tables(blocked, opened):
        rows = [(0, "A", n, a, b, 1e15 if n in blocked else r, 0.0 if n in blocked else volts[n]) for n, a, b, r in lines]
        return (
            spark.createDataFrame(rows, "realization bigint, scenario string, line string, a int, b int, r double, v double"),
            spark.createDataFrame([(0, *u) for u in units], "realization bigint, sub_id int, name string, type string, bus1 int, bus2 int, neutral int"),
            spark.createDataFrame([(0, s, n, 1e15 if s in opened else rg) for s, n, rg in sites], "realization bigint, sub_id int, neutral int, rg double"),
        )

    cases = {"base": ((), ()), "var": (("L3",), (2,)), "cut": (("L4",), (4,))}
    system = N.ConfigSystem({c: tables(*x) for c, x in cases.items()})
    got = {(r.config, r.part, r.name): r.gic for r in system.currents(system.voltages(), ["A"]).collect()}
    w = {name: WINDING_OHM[kind][0] for _, name, kind, *_ in units}
    for c, (blocked, opened) in cases.items():
        nodes = [1, 2, 3, 11, 12] + ([] if c == "cut" else [4, 14])  # beyond an open line and an open ground nothing is solved
        at = {n: k for k, n in enumerate(nodes)}
        y, b = 1e-6 * np.eye(len(nodes)), np.zeros(len(nodes))
        branches = [(a, e, 1 / r, volts[n] / r) for n, a, e, r in lines if n not in blocked] + [(u[3], u[5], 1 / w[u[1]], 0.0) for u in units]
        for a, e, g, i in branches:
            if a in at and e in at:
                p, q = at[a], at[e]
                y[p, p] += g; y[q, q] += g; y[p, q] -= g; y[q, p] -= g  # noqa: E702
                b[q] += i; b[p] -= i  # noqa: E702
        for s, n, rg in sites:
            if n in at and s not in opened:
                y[at[n], at[n]] += 1 / (3 * rg)
        v = dict(zip(nodes, np.linalg.solve(y, b)))
        for n, a, e, r in lines:
            want = 0.0 if n in blocked else round(volts[n] / r + (v.get(a, 0.0) - v.get(e, 0.0)) / r, 2)
            assert got[(c, "line", n)] == pytest.approx(want, abs=0.0101)
        for s, name, _, bus, _, n in units:
            assert got[(c, "HV", name)] == pytest.approx((v.get(bus, 0.0) - v.get(n, 0.0)) / w[name], abs=1e-5)
        for s, n, rg in sites:
            assert got[(c, "ground", str(s))] == pytest.approx(0.0 if s in opened else v.get(n, 0.0) / rg, abs=1e-5)
    side = {r.part: r for r in N.compared_currents(system.currents(system.voltages(), ["A"])).collect()}
    assert side["line"].n_base == side["line"].n_var == 4 and side["line"].total_base != side["line"].total_var


def test_peak_snapshots_take_the_nearest_grid_time(spark):
    series = spark.createDataFrame([(t, k, float(t * k)) for t in (0, 10, 20, 30, 100) for k in (1, 2)] + [(30, 3, float("nan"))], "t bigint, line bigint, v double")
    peaks = spark.createDataFrame([(-50.0,), (5.0,), (14.9,), (15.1,), (30.0,), (31.0,), (64.9,), (500.0,), (None,)], "t double")
    for width in (3, 25, 10_000):
        got = {(r.snapshot, r.t) for r in N.peak_snapshots(series, peaks, width).collect()}
        assert got == {(1, 0), (2, 10), (3, 20), (4, 30), (5, 100)}
    assert N.peak_snapshots(series, peaks.filter("t > 60"), 7).filter("line = 3").count() == 1
    assert N.peak_snapshots(series.filter("t > 1000"), peaks, 7).count() == 0
    assert N.peak_snapshots(series, peaks.filter("t > 1000"), 7).count() == 0
    top = {r.line: r.v for r in N.storm_maximum(series.withColumn("v", -F.col("v"))).collect()}
    assert top == {1: 100.0, 2: 200.0}  # amounts; a line without any number has no row
    scen = N.replay_scenarios(N.peak_snapshots(series, peaks, 25), N.storm_maximum(series), "may").select("scenario").distinct()
    assert {r[0] for r in scen.collect()} == {*(f"V_may_{k}" for k in range(1, 6)), "V_may_peak_max"}


def test_wide_windings_keep_gaps_and_drop_unplaced_transformers(spark):
    c = spark.createDataFrame([(0, "100", "T1", "HV", 1.0), (0, "500", "T1", "HV", 2.0), (0, "100", "T1", "LV", None), (0, "500", "T2", "HV", 3.0)],
                              "realization int, hazard string, name string, winding string, gic double")
    t = spark.createDataFrame([(0, "T1", 7, 40.0, -100.0), (1, "T2", 8, 41.0, -101.0)], "realization int, name string, sub_id int, latitude double, longitude double")
    d = N.wide_windings(c, t)
    assert d.columns == ["realization", "name", "winding", "100-year-hazard A/ph", "500-year-hazard A/ph", "sub_id", "latitude", "longitude"]
    assert sorted(tuple(r)[2:6] for r in d.collect()) == [("HV", 1.0, 2.0, 7), ("LV", None, None, 7)]
    assert N.wide_windings(c, t, ["500", "9"]).columns[3:5] == ["500-year-hazard A/ph", "9-year-hazard A/ph"]
    assert N.wide_windings(c.filter("name = 'x'"), t).count() == 0


def test_parts_are_solved_on_their_own_and_settle_in_few_rounds(spark, monkeypatch):
    import numpy as np

    rounds = []
    write = N.cut_lineage
    monkeypatch.setattr(N, "cut_lineage", lambda df, *a, **k: (rounds.append(1), write(df, *a, **k))[1])
    chain = [(1, k, k + 1) for k in range(200)] + [(1, 900, 900), (2, 5, 7), (2, 7, 6), (2, 6, 5), (2, 8, 9)]
    lab = {(r.realization, r.node): r.label for r in N.components(spark.createDataFrame(chain, "realization int, a int, b int")).collect()}
    assert lab == {(1, k): 0 for k in range(201)} | {(1, 900): 900} | {(2, k): 5 for k in (5, 6, 7)} | {(2, 8): 8, (2, 9): 8}
    assert len(rounds) < 16
    # two parts of 4 and 7 entries, one of which is over the limit of a group of 5
    entries = [(0, 0, 3.0), (1, 1, 3.0), (0, 1, -1.0), (1, 0, -1.0), (2, 2, 4.0), (3, 3, 4.0), (4, 4, 4.0), (2, 3, -1.0), (3, 2, -1.0), (3, 4, -1.0), (4, 3, -1.0)]
    coo = spark.createDataFrame([(1, *e) for e in entries], "realization int, i int, j int, y double")
    earth = spark.createDataFrame([(1, 0, 1.0), (1, 4, 1.0)], "realization int, i int, y double")
    parts = N.grounded_parts(coo, earth)
    assert sorted(map(tuple, parts.collect())) == [(1, 0, 0), (1, 1, 0), (1, 2, 2), (1, 3, 2), (1, 4, 2)]
    rhs = spark.createDataFrame([(1, s, i, float(i + k)) for k, s in enumerate("AB") for i in range(5)], "realization int, scenario string, i int, b double")
    alone = []
    whole = N._solve_distributed
    monkeypatch.setattr(N, "_solve_distributed", lambda system, *a: (alone.append(system.count()), whole(system, *a))[1])
    m = np.zeros((5, 5))
    for i, j, y in entries:
        m[i, j] = y
    for limit in (5, 100):
        got = {(r.scenario, r.i): r.v for r in N.solve(coo, rhs, group_entries=limit, parts=parts).collect()}
        for k, s in enumerate("AB"):
            want = np.linalg.solve(m + 1e-6 * np.eye(5), np.arange(5.0) + k)
            assert [got[s, i] for i in range(5)] == pytest.approx(list(want), rel=1e-7)
    assert alone == [7]


def test_lines_of_all_scenarios_are_dealt_out_once(spark, tmp_path):
    from gridhazard.plans.currents import line_scenarios, voltages_at_ends

    rows = [(1, 5, 7, "A", 0.02, 0.1), (1, 5, 7, "A", 0.04, 0.3), (1, 5, 7, "N", 0.06, 0.5), (2, 5, 7, "A", None, 0.7), (1, 6, 7, None, 0.01, None),
            (1, None, 7, "A", 0.09, 0.9), (None, 5, 7, "A", 0.09, 0.9)]
    d = spark.createDataFrame(rows, "l_linenumber int, l_suppkey bigint, l_partkey bigint, l_returnflag string, l_discount double, l_tax double")
    d.write.parquet(f"{tmp_path}/lineitem.parquet")
    ls = line_scenarios(spark, str(tmp_path))
    plan = ls._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    got = {(r.realization, r.a, r.b, r.scenario): (r.r and round(r.r, 9), r.v) for r in ls.collect()}
    assert got == {(1, 5, 1000007, "A"): (0.053, 0.2), (1, 5, 1000007, "N"): (0.053, 0.5), (2, 5, 1000007, "A"): (None, 0.7), (1, 6, 1000007, None): (0.023, None)}
    nodes = voltages_at_ends(ls)
    assert "Union" not in nodes._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.realization, r.scenario or "", r.i) for r in nodes.collect()) == [
        (1, "", 6), (1, "", 1000007), (1, "A", 5), (1, "A", 1000007), (1, "N", 5), (1, "N", 1000007), (2, "A", 5), (2, "A", 1000007)]


def test_broadcast_tables_are_bounded_by_their_written_bytes(spark):
    from gridhazard.session import BROADCAST_BYTES, configure

    (key, most), = BROADCAST_BYTES.items()
    before = spark.conf.get(key)
    try:
        for given, want in (("10m", most), ("256k", 256 << 10), ("-1", -1)):
            spark.conf.set(key, given)
            configure(spark)
            assert int(spark.conf.get(key)) == want
    finally:
        spark.conf.set(key, before)


def test_corridors_are_drawn_where_their_lines_stand(spark):
    """A draw is a hash, so lines are neither brought together nor joined with themselves; lines without an end or class go as before."""
    rows = [(k % 3, a, b, 500 if k % 2 else 345, 0.1, 1.0) for k, (a, b) in enumerate([(1, 2), (2, 1), (3, 4), (4, 3), (5, 9), (9, 5)] * 40)]
    lines = spark.createDataFrame(rows + [(0, 1, 2, None, 0.1, 1.0), (None, 1, 2, 500, 0.1, 1.0)], "realization int, a int, b int, volt int, r double, v double")
    hubs = spark.createDataFrame([(2,), (2,), (9,)], "node int")
    d = N.corridor_blocking(lines, hubs, (0.4, 0.2), 0.3)
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 2 and plan.count("Aggregate") == 2  # hubs alone are made distinct, for either end
    got = d.collect()
    assert len(got) == len(rows) and 0 < sum(r.blocked for r in got) < len(got)
    drawn = {}
    for r in got:
        assert drawn.setdefault((r.realization, min(r.a, r.b), max(r.a, r.b), r.volt), r.blocked) == r.blocked
        assert (r.r, r.v) == ((1e15, 0.0) if r.blocked else (0.1, 1.0))


def test_groups_are_solved_from_a_stream_of_small_batches(spark, monkeypatch):
    """Several groups in one task, cut anywhere by batches; entries to nodes outside of the equations are left out."""
    monkeypatch.setattr(N, "SPAN", 5)
    rng_ = np.random.default_rng(3)
    entries, want, right = [], {}, []
    for real in ("base:1", "var:1"):
        n = 40
        m = np.zeros((n, n))
        for i, j in rng_.integers(0, n, (120, 2)):
            if i != j:
                m[i, j] = m[j, i] = -1.0
        m += np.diag(1.0 - m.sum(1))
        entries += [(real, int(i) * 7, int(j) * 7, float(m[i, j])) for i, j in zip(*np.nonzero(m))] + [(real, 0, 9999, 0.0)]
        for s in "AB" if real == "var:1" else "A":
            b = rng_.normal(size=n)
            right += [(real, s, int(i) * 7, float(b[i])) for i in range(n)] + [(real, s, 9999, 1.0)]
            x = np.linalg.solve(m + 1e-6 * np.eye(n), b)
            want |= {(real, s, i * 7): x[i] for i in range(n)}
    coo = spark.createDataFrame(entries, "realization string, i int, j int, y double")
    rhs = spark.createDataFrame(right, "realization string, scenario string, i int, b double")
    parts = coo.select("realization", "i").distinct().withColumn("part", F.lit(0))
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(key, "7")
    try:
        for block in (8, 1):
            v = N.solve(coo, rhs, rhs_block=block, parts=parts)
            plan = v._jdf.queryExecution().executedPlan().toString()
            assert "MapInArrow" in plan and "CoGroups" not in plan  # no group is gathered as one table
            got = {(r.realization, r.scenario, r.i): r.v for r in v.collect()}
            assert got.keys() == want.keys()
            assert all(got[k] == pytest.approx(want[k], rel=1e-6, abs=1e-7) for k in want)
    finally:
        spark.conf.unset(key)


def test_products_meet_an_entry_once_for_all_scenarios(spark):
    coo = spark.createDataFrame([(1, 0, 0, 2.0), (1, 0, 1, -1.0), (1, 1, 0, -1.0), (1, 1, 1, 3.0)], "realization int, i int, j int, y double")
    v = spark.createDataFrame([(1, "A", 0, 1.0), (1, "A", 1, 2.0), (1, "B", 1, 5.0)], "realization int, scenario string, i int, v double")
    for wide in (16, 1):
        N.WIDE, before = wide, N.WIDE
        try:
            got = {(r.scenario, r.i): r.yv for r in N.products(coo, v).collect()}
        finally:
            N.WIDE = before
        assert got == {("A", 0): 0.0, ("A", 1): 5.0, ("B", 0): -5.0, ("B", 1): 15.0}
    assert N.products(coo, v.filter("v > 9")).count() == 0


def test_branches_are_read_and_summed_once(spark):
    rows = [(1, 0, 1, 2.0), (1, 1, 0, 3.0), (1, 1, 1, 5.0), (1, 2, None, 7.0), (1, None, None, 9.0)]
    d = N.stamped(spark.createDataFrame(rows, "realization int, a int, b int, y double"), spark.createDataFrame([(1, 0, 0.5)], "realization int, i int, y double"))
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert {(r.i, r.j): r.y for r in d.collect()} == {
        (0, 0): 5.5, (1, 1): 10.0, (0, 1): -5.0, (1, 0): -5.0, (2, 2): 7.0, (2, None): -7.0, (None, 2): -7.0, (None, None): 7.0}
