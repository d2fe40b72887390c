"""Network realizations, nodal equations and induced currents.

Everything is keyed by ``realization``; matrices are coordinate tables
``(realization, i, j, y)`` and right-hand sides ``(realization, i, scenario, b)``.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridhazard.functions import rng
from gridhazard.functions.fixed_values import INF, VARIANT, WINDING_OHM
from gridhazard.functions.scalar import finite_or
from gridhazard.operators.ordered import dense_position, neighbours_known
from gridhazard.session import cut_lineage, drop_scratch

GROUP_ENTRIES = 16_000_000  # largest system (matrix entries of a part of a realization) solved inside one group, about 0.5 GB
FILL = 500_000  # entries up to which small systems share a group
SPAN = 500_000  # entries of such a system multiplied at once
GROUP_TASKS = 2000  # most tasks that groups are dealt to
WIDE = 16  # scenarios that stand side by side in one row
SINGLE = ("GSU", "GY-D", "GSU w/ GIC BD")
WYE = ("GY-GY-D", "GY-GY")


# ------------------------------------------------------------- sampling


def sampled_transformers(stations, n_realizations, seed=42) -> DataFrame:
    """Transformers per realization and station ``(sub_id, hv_bus, lv_bus)``.

    An artificial low-voltage bus (name ending in ``lv``) gets one or two GY-D
    units, any other one to three units of equally likely types.
    """
    d = stations.withColumn("realization", F.explode(F.sequence(F.lit(0), F.lit(n_realizations - 1))))
    artificial = F.col("lv_bus").endswith("lv")
    u = rng.uniform(seed, "realization", "sub_id")
    n = F.when(artificial, F.floor(u * 2) + 1).otherwise(F.floor(u * 3) + 1)
    d = d.withColumn("unit", F.explode(F.sequence(F.lit(1), n.cast("int"))))
    kind = rng.pick(("GY-GY", "GY-GY-D", "Auto"), rng.uniform(seed + 1, "realization", "sub_id", "unit"))
    return d.withColumn("type", F.when(artificial, F.lit("GY-D")).otherwise(kind))


def numbered(transformers, width=1000) -> DataFrame:
    """Running number and name ``T_<sub>_<k>`` inside each realization."""
    d = transformers.withColumn("_b", F.floor(F.col("sub_id") / width))
    d = dense_position(d, ["realization"], ["_b"], ["sub_id", "unit"], "k")
    return d.withColumn("name", F.concat_ws("_", F.lit("T"), "sub_id", "k")).drop("_b")


def counted_transformers(stations, counts, limit=3) -> DataFrame:
    """Up to ``limit`` copies of a station's own type by its known transformer count (default 1)."""
    n = F.least(F.coalesce("n_transformers", F.lit(1)), F.lit(limit)).cast("int")
    return stations.join(counts, "sub_id", "left").withColumn("unit", F.explode(F.sequence(F.lit(1), n)))


def with_windings(transformers) -> DataFrame:
    """Winding resistances by transformer type."""
    w1 = F.create_map(*[x for k, v in WINDING_OHM.items() for x in (F.lit(k), F.lit(v[0]))])
    w2 = F.create_map(*[x for k, v in WINDING_OHM.items() for x in (F.lit(k), F.lit(v[1]))])
    return transformers.withColumns({"w1": w1[F.col("type")], "w2": w2[F.col("type")]})


def random_grounding(stations, share_open=0.01, seed=5, low=0.1, high=0.2, skip=()) -> DataFrame:
    """Grounding resistance per (realization, sub_id); exactly floor(share * n) stations open.

    The stations to open are the lowest draws of a realization. Draws are placed
    by slices of [0, 1), so no realization is ranked in one task.
    """
    d = stations.withColumn("_skip", F.col("sub_id").isin(list(skip)) if skip else F.lit(False))
    fixed = d.filter("_skip").withColumn("rg", F.lit(None).cast("double"))
    d = d.filter(~F.col("_skip")).withColumn("_u", rng.uniform(seed, "realization", "sub_id"))
    sizes = d.groupBy("realization").agg(F.floor(F.count(F.lit(1)) * share_open).alias("_k"))
    d = d.withColumn("_b", F.floor(F.col("_u") * 256))
    d = dense_position(d, ["realization"], ["_b"], ["_u", "sub_id"], "_r").join(sizes, "realization")
    rg = rng.uniform_between(low, high, rng.uniform(seed + 1, "realization", "sub_id"))
    d = d.withColumn("rg", F.when(F.col("_r") <= F.col("_k"), F.lit(INF)).otherwise(rg))
    cols = [c for c in stations.columns] + ["rg"]
    return d.select(*cols).unionByName(fixed.select(*cols))


def blocked_lines(lines, p, seed=9) -> DataFrame:
    """Direct-current blocking with probability ``p``: infinite resistance, no voltage."""
    hit = rng.uniform(seed, "realization", "line") < p
    return lines.withColumns({
        "blocked": hit.cast("int"),
        "r": F.when(hit, F.lit(INF)).otherwise(F.col("r")),
        "v": F.when(hit, F.lit(0.0)).otherwise(F.col("v")),
    })


# -------------------------------------------------------------- assembly


def transformer_branches(transformers) -> DataFrame:
    """Resistive branches (a, b, y) of each transformer ``(type, bus1, bus2, neutral, w1, w2)``."""
    def branch(a, b, w):
        return F.struct(F.col(a).alias("a"), F.col(b).alias("b"), F.try_divide(F.lit(1.0), F.col(w)).alias("y"))

    kind = F.col("type")
    parts = (
        F.when(kind.isin(*SINGLE), F.array(branch("bus1", "neutral", "w1")))
        .when(kind == "Auto", F.array(branch("bus2", "bus1", "w1"), branch("bus2", "neutral", "w2")))
        .when(kind.isin(*WYE), F.array(branch("bus1", "neutral", "w1"), branch("bus2", "neutral", "w2")))
    )
    return transformers.select("realization", F.explode(parts).alias("p")).select("realization", "p.*")


def line_branches(lines) -> DataFrame:
    """Branches of lines; a blocked line (infinite r) has zero admittance."""
    return lines.select("realization", F.col("a"), F.col("b"), F.try_divide(F.lit(1.0), F.col("r")).alias("y"))


def stamped(branches, earthing=None) -> DataFrame:
    """Coordinate entries of the admittance matrix; earthing ``(realization, i, y)`` joins the diagonal.

    Branches are read once and summed once per pair of nodes; the sums are turned round afterwards.
    """
    a, b, y = F.col("a"), F.col("b"), F.col("y")
    ent = lambda i, j, x: F.struct(i.alias("i"), j.alias("j"), x.alias("y"))
    low, high = F.when(a <= b, a).otherwise(b), F.when(a <= b, b).otherwise(a)
    entries = F.when(a == b, F.array(ent(a, a, y))).when(a.isNull() & b.isNull(), F.array(ent(a, b, 0.0 * y))).otherwise(
        F.array(ent(low, high, -y), ent(a, a, y), ent(b, b, y)))
    e = branches.select("realization", F.explode(entries).alias("e")).select("realization", "e.*")
    if earthing is not None:
        e = e.unionByName(earthing.select("realization", "i", F.col("i").alias("j"), "y"))
    sums = e.groupBy("realization", "i", "j").agg(F.sum("y").alias("y"))
    turned = lambda i, j: F.struct(F.col(i).alias("i"), F.col(j).alias("j"))
    ways = F.when(F.col("i").eqNullSafe(F.col("j")), F.array(turned("i", "j"))).otherwise(F.array(turned("i", "j"), turned("j", "i")))
    return sums.select("realization", F.explode(ways).alias("e"), "y").select("realization", "e.i", "e.j", "y")


def earthing(stations) -> DataFrame:
    """1 / (3 Rg) at the neutral, 0 for an open one."""
    y = F.when(F.col("rg") == INF, 0.0).otherwise(F.try_divide(F.lit(1.0), 3.0 * F.col("rg")))
    return stations.select("realization", F.col("neutral").alias("i"), y.alias("y"))


def injections(lines) -> DataFrame:
    """Nodal injections per scenario: V/R into the receiving node, out of the sending node."""
    i = finite_or(F.try_divide(F.col("v"), F.col("r")), 0.0)
    pair = F.array(
        F.struct(F.col("b").alias("i"), i.alias("x")), F.struct(F.col("a").alias("i"), (-i).alias("x"))
    )
    return (
        lines.select("realization", "scenario", F.explode(pair).alias("p"))
        .groupBy("realization", "scenario", F.col("p.i").alias("i")).agg(F.sum("p.x").alias("b"))
    )


# ------------------------------------------------------------ components


def components(edges, keys=("realization",), max_rounds=60) -> DataFrame:
    """Connected components of ``edges(keys, a, b)``: label = least node of the component.

    Every round points each node at the least of itself and its neighbours, follows these pointers to their ends and
    goes on with the ends as nodes and the edges between them, so edges and nodes at least halve: only the first
    round reads all edges. The minima run partially, so a node with very many edges is no bottleneck. Pointers double
    their reach each time, so long chains need few steps. Results of rounds are written to the shared folder.
    """
    keys = list(keys)
    edges = cut_lineage(edges.select(*keys, "a", "b"))
    passed = []
    for _ in range(max_rounds):
        roots = _pointed(edges, keys, max_rounds)
        passed.append(roots)
        at = lambda c: roots.select(*keys, F.col("node").alias(c), F.col("label").alias(f"_{c}"))
        moved = edges.join(at("a"), keys + ["a"]).join(at("b"), keys + ["b"])
        edges = cut_lineage(
            moved.filter("_a != _b").select(*keys, F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct(),
            replaces=edges,
        )
        if edges.isEmpty():
            drop_scratch(edges)
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    labels = passed.pop()
    while passed:  # an end of a round without edges left has its own label
        inner = labels.select(*keys, F.col("node").alias("label"), F.col("label").alias("_far"))
        nodes = passed.pop()
        labels = cut_lineage(nodes.join(inner, keys + ["label"], "left").select(*keys, "node", F.coalesce("_far", "label").alias("label")), replaces=nodes)
    return labels


def _pointed(edges, keys, max_rounds) -> DataFrame:
    """Each node and the end of the chain of pointers from it, each to the least of a node and its neighbours."""
    both = edges.select(*keys, F.col("a").alias("node"), "b").union(edges.select(*keys, "b", "a"))
    to = cut_lineage(both.groupBy(*keys, "node").agg(F.min(F.least("node", "b")).alias("label")))
    for _ in range(max_rounds):
        far = to.select(*keys, F.col("node").alias("label"), F.col("label").alias("_far"))
        nxt = cut_lineage(to.join(far, keys + ["label"]).select(*keys, "node", F.col("_far").alias("label"), (F.col("label") != F.col("_far")).alias("_on")), replaces=to)
        if nxt.filter("_on").isEmpty():
            settled = nxt.drop("_on")
            settled._scratch_path = nxt._scratch_path
            return settled
        to = nxt.drop("_on")
        to._scratch_path = nxt._scratch_path
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def grounded_parts(coo, earth) -> DataFrame:
    """Active nodes (non-zero row) whose component holds a grounded node, with the component as ``part``.

    The matrix is symmetric, so entries above the diagonal tell all neighbours.
    """
    edges = coo.filter((F.col("i") <= F.col("j")) & (F.col("y") != 0)).select(
        "realization", F.col("i").alias("a"), F.col("j").alias("b")
    )
    lab = components(edges)
    live = earth.filter(F.col("y") > 0).select("realization", F.col("i").alias("node")).distinct()
    ok = lab.join(live, ["realization", "node"]).select("realization", "label").distinct()
    return lab.join(ok, ["realization", "label"], "left_semi").select("realization", F.col("node").alias("i"), F.col("label").alias("part"))


def grounded_nodes(coo, earth) -> DataFrame:
    """Active nodes (non-zero row) whose component holds a grounded node."""
    return grounded_parts(coo, earth).select("realization", "i")


# ----------------------------------------------------------------- solve


class _Rows:
    """The matrix of one group as rows of ascending nodes. Products go through SPAN entries at a time."""

    def __init__(self, i, j, y, ridge):
        self.ridge = ridge
        rows = np.concatenate(i)
        i.clear()
        new = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
        self.nodes, self.starts, self.n = rows[new], new, len(new)
        del rows
        for k in range(len(j)):
            j[k], there = self.places(j[k])
            if not there.all():  # an entry to a node outside of the equations
                y[k] = np.where(there, y[k], 0.0)
        self.cols, self.vals = np.concatenate(j), np.concatenate(y)
        j.clear(), y.clear()
        ends = np.append(self.starts, len(self.cols))
        self.spans, at = [], 0
        while at < self.n:
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + SPAN, side="right")) - 1)
            self.spans.append((at, to, int(ends[at]), int(ends[to])))
            at = to
        self.diagonal = np.full(self.n, float(ridge))
        for at, to, low, high in self.spans:
            own = np.repeat(np.arange(at, to), np.diff(ends[at : to + 1]))
            on = own == self.cols[low:high]
            self.diagonal[at:to] += np.bincount(own[on] - at, self.vals[low:high][on], to - at)

    def places(self, nodes):
        at = np.minimum(np.searchsorted(self.nodes, nodes), self.n - 1).astype(np.int32)
        return at, self.nodes[at] == nodes

    def times(self, x):
        out = self.ridge * x
        for at, to, low, high in self.spans:
            cols, vals, starts = self.cols[low:high], self.vals[low:high], self.starts[at:to] - low
            for k in range(len(x)):
                out[k, at:to] += np.add.reduceat(vals * x[k][cols], starts)
        return out


def _pcg(matrix, b, tol, max_iter):
    """Jacobi-preconditioned conjugate gradients, one row of ``b`` for each right-hand side."""
    inv = 1.0 / np.where(matrix.diagonal > 0, matrix.diagonal, 1.0)
    dot = lambda p, q: np.einsum("kn,kn->k", p, q)
    x, r = np.zeros_like(b), b.copy()
    p = inv * r
    rz = dot(r, p)
    goal = tol * np.maximum(np.sqrt(dot(b, b)), 1e-30)
    for _ in range(max_iter):
        if (np.sqrt(dot(r, r)) <= goal).all():
            break
        ap = matrix.times(p)
        den = dot(p, ap)
        alpha = np.where(den > 0, rz / np.where(den > 0, den, 1.0), 0.0)[:, None]
        x += alpha * p
        r -= alpha * ap
        del ap
        z = inv * r
        nxt = dot(r, z)
        p *= np.where(rz > 0, nxt / np.where(rz > 0, rz, 1.0), 0.0)[:, None]
        p += z
        rz = nxt
    # The running residual drifts from the true one; what counts is the true one.
    r = b - matrix.times(x)
    missed = np.flatnonzero(np.sqrt(dot(r, r)) > 1e3 * goal)
    return x, missed


def solve(coo, rhs, rhs_block=8, group_entries=GROUP_ENTRIES, tol=1e-10, ridge=1e-6, max_iter=2000, parts=None) -> DataFrame:
    """Node voltages ``(realization, scenario, i, v)`` of (Y + ridge) v = b.

    ``parts (realization, i, part)`` names the nodes of the equations, and as ``part`` those that no entry links to the
    nodes of another one, as the components of the grid; each part is a system of its own (without it, a realization is
    one). Entries and right-hand sides at other nodes are left out. Systems up to ``group_entries`` matrix entries
    (counted) are solved in one group with ``rhs_block`` scenarios at a time, small ones several together; larger ones
    by conjugate gradients whose matrix product and dot products are Spark joins and sums over the whole table.
    """
    node, group = ["realization", "i"], ["realization", "part"]
    parts = coo.select(*node).distinct().withColumn("part", F.lit(0)) if parts is None else parts.select(*node, "part")
    system = cut_lineage(coo.select(*node, "j", finite_or(F.col("y"), 0.0).alias("y")).join(parts, node))
    rhs = cut_lineage(rhs.select("realization", "scenario", "i", finite_or(F.col("b"), 0.0).alias("b")).join(parts, node))
    sizes = cut_lineage(system.groupBy(*group).agg(F.count(F.lit(1)).alias("n")))
    fits = sizes.filter(F.col("n") <= group_entries)
    little = fits.filter(F.col("n") <= FILL).groupBy("realization").agg(F.ceil(F.sum("n") / FILL).alias("bins"))
    label = F.when(F.col("n") > FILL, F.concat(F.lit("part "), F.col("part").cast("string"))).otherwise(F.pmod(F.xxhash64("part"), F.col("bins")).cast("string"))
    groups = cut_lineage(fits.join(little, "realization", "left").select(*group, label.alias("group")))
    # Numbers of groups, so that each gets a task of its own; there are few, as little parts share one.
    order = Window.orderBy("realization", "group")
    numbers = cut_lineage(groups.select("realization", "group").distinct().select("realization", "group", (F.row_number().over(order) - 1).alias("number")))
    groups = groups.join(numbers, ["realization", "group"]).select(*group, "number")
    done = _solve_grouped(system.join(groups, group).drop("part"), rhs.join(groups, group).drop("part"), numbers.count(), rhs_block, tol, ridge, max_iter)
    large = sizes.filter(F.col("n") > group_entries).select(*group)
    if large.isEmpty():
        return done
    rest = system.join(large, group, "left_semi").drop("part")
    diag = rest.select(*node).distinct().select("realization", "i", F.col("i").alias("j"), F.lit(ridge).alias("y"))
    rest = rest.unionByName(diag).groupBy("realization", "i", "j").agg(F.sum("y").alias("y"))
    rest = _solve_distributed(rest, rhs.join(large, group, "left_semi").drop("part"), tol, max_iter)
    return done.unionByName(rest.select(*done.columns))


def _solve_grouped(system, rhs, groups, rhs_block, tol, ridge, max_iter):
    """Groups one after the other in tasks that read their rows as a stream, entries by node and then right-hand sides."""
    names = sorted(r[0] for r in rhs.select("scenario").distinct().collect() if r[0] is not None)
    many = max(1, len(names[::rhs_block]))
    cell = lambda block: (F.col("number") * many + block).cast("int").alias("cell")
    blocks = system.withColumn("block", F.explode(F.array(*[F.lit(k) for k in range(many)])))
    left = blocks.select("realization", cell(F.col("block")), F.lit(-1).alias("col"), "i", "j", "y")
    k = F.array_position(F.array(*[F.lit(s) for s in names or [""]]), F.col("scenario")).cast("int") - 1
    right = rhs.filter("scenario IS NOT NULL").select("realization", cell(F.floor(k / rhs_block)), (k % rhs_block).alias("col"), "i", F.col("i").alias("j"), F.col("b").alias("y"))
    tasks = max(1, min(GROUP_TASKS, groups * many))
    rows = left.unionByName(right).repartitionById(tasks, F.pmod(F.col("cell"), F.lit(tasks))).sortWithinPartitions("cell", "col", "i")
    node, real = system.schema["i"].dataType.simpleString(), system.schema["realization"].dataType.simpleString()
    at = {c: k for k, c in enumerate(rows.columns)}

    def pieces(batch):
        n = batch.num_rows
        ends = [0, *(np.flatnonzero(np.diff(batch.column(at["cell"]).to_numpy())) + 1).tolist(), n]
        return [batch.slice(a, b - a) for a, b in zip(ends, ends[1:]) if b > a]

    def solved(now, i, j, y, right):
        if not i or not right:
            return
        matrix = _Rows(i, j, y, ridge)
        given = sorted({int(k) for _, cols, _ in right for k in np.unique(cols)})
        b = np.zeros((len(given), matrix.n))
        for nodes, cols, values in right:
            place, there = matrix.places(nodes)
            b[np.searchsorted(given, cols[there]), place[there]] = values[there]
        right.clear()
        mine = [names[now[0] % many * rhs_block + k] for k in given]
        v, missed = _pcg(matrix, b, tol, max_iter)
        if len(missed):
            raise RuntimeError(f"solver did not settle in {max_iter} rounds: realization {now[1]}, scenario {mine[missed[0]]}")
        for k, name in enumerate(mine):
            for low in range(0, matrix.n, 100_000):
                part = matrix.nodes[low : low + 100_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.repeat(now[1], len(part)), pa.repeat(name, len(part)), pa.array(part), pa.array(v[k, low : low + 100_000])],
                    names=["realization", "scenario", "i", "v"],
                )

    def work(batches):
        now, i, j, y, right = None, [], [], [], []
        array = lambda d, c: d.column(at[c]).to_numpy(zero_copy_only=False)
        for batch in batches:
            for d in pieces(batch):
                first = d.column(at["cell"])[0].as_py()
                if now is None or first != now[0]:
                    if now is not None:
                        yield from solved(now, i, j, y, right)
                    now, i, j, y, right = (first, d.column(at["realization"])[0]), [], [], [], []
                entry = array(d, "col") < 0
                if entry.any():
                    i.append(array(d, "i")[entry]), j.append(array(d, "j")[entry]), y.append(array(d, "y")[entry])
                if not entry.all():
                    right.append((array(d, "i")[~entry], array(d, "col")[~entry], array(d, "y")[~entry]))
        if now is not None:
            yield from solved(now, i, j, y, right)

    return rows.mapInArrow(work, f"realization {real}, scenario string, i {node}, v double")


def _solve_distributed(system, rhs, tol, max_iter):
    key, node = ["realization", "scenario"], ["realization", "scenario", "i"]
    scen = rhs.select(*key).distinct()
    system = cut_lineage(system)
    diag = system.filter(F.col("i") == F.col("j")).select("realization", "i", F.col("y").alias("d"))
    state = (
        diag.join(scen, "realization").join(rhs, node, "left")
        .select(*node, "d", F.coalesce("b", F.lit(0.0)).alias("r"))
        .withColumns({"x": F.lit(0.0), "p": F.col("r") / F.col("d")})
    )
    state = cut_lineage(state)
    norms = state.groupBy(*key).agg(
        F.sum(F.col("r") * F.col("r")).alias("bb"), F.sum(F.col("r") * F.col("r") / F.col("d")).alias("rz")
    )
    norms = cut_lineage(norms)
    both = moved = last_sums = None
    for _ in range(max_iter):
        ap = (
            system.join(state.select(*key, F.col("i").alias("j"), "p"), ["realization", "j"])
            .groupBy(*node).agg(F.sum(F.col("y") * F.col("p")).alias("ap"))
        )
        both = cut_lineage(state.join(ap, node), replaces=both)
        alpha = both.groupBy(*key).agg(F.sum(F.col("p") * F.col("ap")).alias("pap")).join(norms, key).select(
            *key, F.when(F.col("pap") > 0, F.col("rz") / F.col("pap")).otherwise(0.0).alias("alpha"), "rz", "bb"
        )
        moved = cut_lineage(
            both.join(alpha, key).select(
                *node, "d", "p", "rz", "bb", (F.col("x") + F.col("alpha") * F.col("p")).alias("x"),
                (F.col("r") - F.col("alpha") * F.col("ap")).alias("r"),
            ),
            replaces=moved,
        )
        sums = moved.groupBy(*key).agg(
            F.sum(F.col("r") * F.col("r") / F.col("d")).alias("rz2"), F.sum(F.col("r") * F.col("r")).alias("rr"),
            F.first("rz").alias("rz"), F.first("bb").alias("bb"),
        )
        sums = last_sums = cut_lineage(sums, replaces=last_sums)
        done = sums.filter(F.col("rr") > tol * tol * F.col("bb")).isEmpty()
        if done:
            return moved.select(*node, F.col("x").alias("v"))
        beta = sums.select(*key, F.when(F.col("rz") > 0, F.col("rz2") / F.col("rz")).otherwise(0.0).alias("beta"))
        state = moved.join(beta, key).select(
            *node, "d", "r", "x", (F.col("r") / F.col("d") + F.col("beta") * F.col("p")).alias("p")
        )
        norms = sums.select(*key, "bb", F.col("rz2").alias("rz"))
    raise RuntimeError(f"solver did not settle in {max_iter} rounds")


def products(coo, voltages) -> DataFrame:
    """Y v ``(realization, scenario, i, yv)``. Scenarios stand side by side while entries are met and summed, so an entry is one row for all."""
    node = ["realization", "i"]
    names = sorted(r[0] for r in voltages.select("scenario").distinct().collect() if r[0] is not None)
    out = []
    for low in range(0, max(len(names), 1), WIDE):
        some = names[low : low + WIDE]
        of = lambda k: F.when(F.col("scenario") == F.lit(some[k]), F.col("v"))  # noqa: B023, E731
        wide = voltages.groupBy("realization", F.col("i").alias("j")).agg(F.sum(F.lit(0)).alias("_"), *[F.sum(of(k)).alias(f"v{k}") for k in range(len(some))]).drop("_")
        sums = coo.select(*node, "j", "y").join(wide, ["realization", "j"]).groupBy(*node).agg(
            F.count(F.lit(1)).alias("_"), *[F.sum(F.col("y") * F.col(f"v{k}")).alias(f"v{k}") for k in range(len(some))])
        each = F.array(*[F.struct(F.lit(s).alias("scenario"), F.col(f"v{k}").alias("yv")) for k, s in enumerate(some)]) if some else F.array().cast("array<struct<scenario:string,yv:double>>")
        out.append(sums.select(*node, F.explode(each).alias("e")).select("realization", "e.scenario", "i", "e.yv").filter("yv IS NOT NULL"))
    return reduce(DataFrame.unionByName, out)


def injections_of(coo, voltages, ridge=1e-6) -> DataFrame:
    """The injections (Y + ridge) v that given node voltages belong to."""
    yv = products(coo, voltages).select("realization", "scenario", "i", F.col("yv").alias("b"))
    own = voltages.select("realization", "scenario", "i", (F.lit(ridge) * F.col("v")).alias("b"))
    return yv.unionByName(own).groupBy("realization", "scenario", "i").agg(F.sum("b").alias("b"))


def residuals(coo, voltages, rhs) -> DataFrame:
    """Largest |Y v - b| per (realization, scenario)."""
    key = ["realization", "scenario"]
    d = products(coo, voltages).join(rhs, key + ["i"], "full_outer")
    off = F.abs(F.coalesce("yv", F.lit(0.0)) - F.coalesce("b", F.lit(0.0)))
    return d.groupBy(*key).agg(F.max(off).alias("residual"), F.max(F.abs(F.coalesce("b", F.lit(0.0)))).alias("size"))


# -------------------------------------------------------------- currents


def _at(df, voltages, column, out):
    v = voltages.select("realization", "scenario", F.col("i").alias(column), F.col("v").alias(out))
    return df.join(v, ["realization", "scenario", column], "left").withColumn(out, F.coalesce(out, F.lit(0.0)))


def line_currents(lines, voltages) -> DataFrame:
    """V/R + (v_a - v_b)/R per line and scenario, half-even to 2 digits."""
    d = _at(_at(lines, voltages, "a", "_va"), voltages, "b", "_vb")
    y = F.try_divide(F.lit(1.0), F.col("r"))
    return d.withColumn("i_line", F.bround(F.col("v") * y + (F.col("_va") - F.col("_vb")) * y, 2)).drop("_va", "_vb")


def winding_currents(transformers, voltages, scenarios) -> DataFrame:
    """Winding currents by type; nodes outside the solved system are at 0, W = 0 gives 0."""
    d = transformers.withColumn("scenario", F.explode(F.array(*[F.lit(s) for s in scenarios])))
    for c, o in (("bus1", "_v1"), ("bus2", "_v2"), ("neutral", "_vn")):
        d = _at(d, voltages, c, o)
    y = lambda w: F.when(F.col(w) != 0, F.try_divide(F.lit(1.0), F.col(w))).otherwise(0.0)
    flow = lambda n, a, b, w: F.struct(F.lit(n).alias("winding"), ((F.col(a) - F.col(b)) * y(w)).alias("gic"))
    kind = F.col("type")
    parts = (
        F.when(kind.isin(*SINGLE), F.array(flow("HV", "_v1", "_vn", "w1")))
        .when(kind == "Auto", F.array(flow("Series", "_v1", "_v2", "w1"), flow("Common", "_v2", "_vn", "w2")))
        .when(kind.isin(*WYE), F.array(flow("HV", "_v1", "_vn", "w1"), flow("LV", "_v2", "_vn", "w2")))
    )
    return d.select("realization", "scenario", "sub_id", "name", "type", F.explode(parts).alias("f")).select(
        "realization", "scenario", "sub_id", "name", "type", "f.*"
    )


def ground_currents(stations, earth, voltages, scenarios) -> DataFrame:
    """Three-phase ground current 3 Y_e v per substation; missing nodes give 0."""
    d = stations.withColumn("scenario", F.explode(F.array(*[F.lit(s) for s in scenarios])))
    d = d.join(earth.withColumnRenamed("i", "neutral").withColumnRenamed("y", "_ye"), ["realization", "neutral"], "left")
    d = _at(d, voltages, "neutral", "_vn")
    return d.select("realization", "scenario", "sub_id", (3.0 * F.coalesce("_ye", F.lit(0.0)) * F.col("_vn")).alias("gic"))


def attach_voltages(lines, voltages, first_sign, second_sign):
    """Line voltages with polarity taken from the first event, else the second, else +1; unmatched 0."""
    d = (
        lines.join(voltages, "line", "left")
        .join(first_sign.select("line", F.col("sgn").alias("_a")), "line", "left")
        .join(second_sign.select("line", F.col("sgn").alias("_b")), "line", "left")
    )
    sign = F.coalesce(F.nullif("_a", F.lit(0.0)), F.nullif("_b", F.lit(0.0)), F.lit(1.0))
    return d.withColumn("matched", F.col("v").isNotNull().cast("int")).withColumn(
        "v", F.coalesce("v", F.lit(0.0)) * sign
    ).drop("_a", "_b")


def replay_snapshots(series, start, every) -> DataFrame:
    """Snapshots of a storm replay from ``start`` on, at whole multiples of ``every`` positions (long form).

    Snapshot numbers count the distinct times, of which there are as many as the
    storm has grid positions.
    """
    d = series.filter((F.col("t") >= start) & (F.pmod("t", F.lit(every)) == 0))
    times = d.select("t").distinct().withColumn("snapshot", F.row_number().over(Window.orderBy("t")))
    return d.join(times, "t")


def peak_snapshots(series, peaks, width) -> DataFrame:
    """Snapshots of a storm replay at a list of peak times ``(t)``: the grid time nearest to each peak.

    A tie goes to the earlier time; peaks that share a grid time give one snapshot; snapshots
    are numbered in time order. Times are looked up inside slices of ``width``, so neither the
    grid nor the list is sorted in one task.
    """
    grid = series.select(F.col("t").cast("double").alias("t"), F.lit(0).alias("peak")).filter("t IS NOT NULL").distinct()
    wanted = peaks.select(F.col("t").cast("double").alias("t"), F.lit(1).alias("peak")).filter("t IS NOT NULL").distinct()
    d = grid.unionByName(wanted).withColumns({"known": F.when(F.col("peak") == 0, F.col("t")), "slice": F.floor(F.col("t") / width)})
    d = neighbours_known(d, [], "slice", ["t", "peak"], "known").filter("peak = 1")
    before, after = F.col("prev")["v"], F.col("next")["v"]
    near = F.when(after.isNull() | (F.col("t") - before <= after - F.col("t")), before).otherwise(after)
    times = d.select(near.alias("t")).filter("t IS NOT NULL").distinct().withColumn("slice", F.floor(F.col("t") / width))
    times = dense_position(times, [], "slice", "t", "snapshot").select(F.col("t").alias("_t"), "snapshot")
    return series.join(times, F.col("t").cast("double") == F.col("_t")).drop("_t")


def storm_maximum(series) -> DataFrame:
    """Largest amount of each line over a whole storm; values that are no number take no part."""
    size = F.abs(F.when(~F.isnan("v"), F.col("v")))
    return series.groupBy("line").agg(F.max(size).alias("v")).filter("v IS NOT NULL")


def replay_scenarios(snapshots, maximum, storm) -> DataFrame:
    """Snapshots and the storm's maximum as scenarios ``(scenario, line, v)`` of one table.

    Long form: a line that has no value in a scenario has no row there and injects nothing.
    """
    each = snapshots.select(F.concat(F.lit(f"V_{storm}_"), F.col("snapshot").cast("string")).alias("scenario"), "line", "v")
    return each.unionByName(maximum.select(F.lit(f"V_{storm}_peak_max").alias("scenario"), "line", "v"))


def wide_windings(currents, transformers, hazards=None) -> DataFrame:
    """Winding currents ``(realization, hazard, name, winding, gic)`` as one row per winding.

    One column ``<hazard>-year-hazard A/ph`` for each hazard, in order; ``hazards`` may state
    them, else they are found in the data (as many as there will be columns). Joined with
    ``transformers (realization, name, sub_id, latitude, longitude)``; windings of
    transformers that are not listed go. A hazard without a value for a winding is null.
    """
    if hazards is None:
        hazards = [r["hazard"] for r in currents.select("hazard").filter("hazard IS NOT NULL").distinct().sort("hazard").collect()]
    named = [F.first(F.when(F.col("hazard") == h, F.col("gic")), ignorenulls=True).alias(f"{h}-year-hazard A/ph") for h in hazards]
    key = ["realization", "name", "winding"]
    wide = currents.groupBy(*key).agg(*named) if named else currents.select(*key).distinct()
    place = transformers.select("realization", "name", "sub_id", "latitude", "longitude")
    return wide.join(place, ["realization", "name"])


# ------------------------------------------------- structured variations


def corridor_blocking(lines, hub_nodes, p_by_class, bump, seed=21) -> DataFrame:
    """Block whole corridors (same end nodes and class) together; hubs raise the chance."""
    key = ["realization", "lo", "hi", "volt"]
    ends = lines.withColumns({"lo": F.least("a", "b"), "hi": F.greatest("a", "b")}).dropna(subset=key)
    p = F.when(F.col("volt") >= 500, p_by_class[0]).otherwise(p_by_class[1])
    hubs = hub_nodes.select("node").distinct()
    for c in ("lo", "hi"):
        ends = ends.join(hubs.select(F.col("node").alias(c), F.lit(True).alias(f"_{c}")), c, "left")
    chance = F.least(F.lit(1.0), p + F.when(F.col("_lo") | F.col("_hi"), F.lit(bump)).otherwise(0.0))
    # The draw is a hash of the corridor, so all its lines draw alike without being brought together.
    drawn = ends.withColumn("blocked", (rng.uniform(seed, *key) < chance).cast("int"))
    return drawn.select(*lines.columns, "blocked").withColumns({
        "r": F.when(F.col("blocked") == 1, F.lit(VARIANT["blocked_ohm"])).otherwise(F.col("r")),
        "v": F.when(F.col("blocked") == 1, F.lit(0.0)).otherwise(F.col("v")),
    })


def toggled_types(transformers, named, seed=31) -> DataFrame:
    """Random swaps between compatible types; ``named`` units swap GY-GY and GY-GY-D first."""
    u1 = rng.uniform(seed, "realization", "name")
    u2 = rng.uniform(seed, "realization", "name", part=1)
    kind = F.col("type")
    swap = F.when(kind == "GY-GY-D", "GY-GY").otherwise("GY-GY-D")
    new = (
        F.when(F.col("name").isin(list(named)) & (u1 < VARIANT["p_swap_delta"]), swap)
        .when((kind == "Auto") & (u2 < VARIANT["p_auto_to_wye"]), "GY-GY")
        .when((kind == "GY-GY") & (u2 < VARIANT["p_auto_to_wye"]), "Auto")
        .otherwise(kind)
    )
    return transformers.withColumn("type", new)


def is_gsu(c="type"):
    return F.col(c).startswith("GSU")


def limited_gsus(transformers, locked=(), seed=41) -> DataFrame:
    """Keep 2, 1 or 0 step-up units per site; locked sites keep all; at least one unit overall.

    The kept units are the lowest draws of a site; the rank filter is cut to two
    rows per site before the shuffle.
    """
    keep2, keep1 = VARIANT["p_keep2"], VARIANT["p_keep2"] + VARIANT["p_keep1"]
    gsu = transformers.filter(is_gsu()).withColumn("_u", rng.uniform(seed, "realization", "name"))
    lock = F.col("sub_id").isin(list(locked)) if locked else F.lit(False)
    draw = rng.uniform(seed + 1, "realization", "sub_id")
    target = F.when(draw < keep2, 2).when(draw < keep1, 1).otherwise(0)
    w = Window.partitionBy("realization", "sub_id").orderBy("_u", "name")
    first_two = gsu.filter(~lock).withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= 2)
    kept = first_two.filter(F.col("_r") <= target).drop("_r").unionByName(gsu.filter(lock))
    empty = gsu.select("realization").distinct().join(
        kept.select("realization").distinct(), "realization", "left_anti"
    )
    w1 = Window.partitionBy("realization").orderBy("_u", "name")
    rescue = (
        gsu.join(empty, "realization", "left_semi")
        .withColumn("_r", F.row_number().over(w1)).filter(F.col("_r") <= 1).drop("_r")
    )
    return transformers.filter(~is_gsu()).unionByName(kept.unionByName(rescue).drop("_u"))


def gsu_blocking(transformers, seed=51) -> DataFrame:
    """Put a blocking device on step-up units at random."""
    on = rng.uniform(seed, "realization", "name") < VARIANT["p_bd_on"]
    new = F.when(on, "GSU w/ GIC BD").otherwise("GSU")
    return transformers.withColumn("type", F.when(is_gsu(), new).otherwise(F.col("type")))


def added_units(transformers, locked=(), seed=61) -> DataFrame:
    """Add one to three copies of non-step-up units outside locked sites, with fresh names."""
    pool = transformers.filter(~is_gsu())
    if locked:
        pool = pool.filter(~F.col("sub_id").isin(list(locked)))
    sizes = pool.groupBy("realization").agg(F.count(F.lit(1)).alias("_n"))
    k = rng.weighted_pick(VARIANT["new_count"], VARIANT["new_weights"], rng.uniform(seed, "realization"))
    wanted = sizes.withColumn("_k", F.explode(F.sequence(F.lit(1), k))).withColumn(
        "_p", (F.floor(rng.uniform(seed + 1, "realization", "_k") * F.col("_n")) + 1).cast("bigint")
    )
    ranked = dense_position(
        pool.withColumn("_b", rng.uniform(seed + 2, "realization", "name")).withColumn("_c", F.floor(F.col("_b") * 64)),
        ["realization"], ["_c"], ["_b", "name"], "_p",
    ).drop("_b", "_c")
    new = ranked.join(wanted.select("realization", "_p", "_k"), ["realization", "_p"])
    w = Window.partitionBy("realization", "name").orderBy("_k")  # at most three rows
    nth = F.row_number().over(w)
    fresh = F.when(nth == 1, F.concat("name", F.lit("X"))).otherwise(F.concat("name", F.lit("X_"), (nth - 1).cast("string")))
    return transformers.unionByName(new.withColumn("_new", fresh).withColumn("name", F.col("_new")).drop("_new", "_p", "_k"))


def regrounded_sites(stations, transformers, locked=(), seed=71) -> DataFrame:
    """Open some site groundings, then ground again every site with an unblocked step-up unit."""
    lock = F.col("sub_id").isin(list(locked)) if locked else F.lit(False)
    opened = (~lock) & (rng.uniform(seed, "realization", "sub_id") < VARIANT["p_site_block"])
    d = stations.withColumn("rg", F.when(opened, F.lit(VARIANT["blocked_ohm"])).otherwise(F.col("rg")))
    need = (
        transformers.filter(is_gsu() & ~F.col("type").contains("w/ GIC BD"))
        .select("realization", "sub_id").distinct().withColumn("_need", F.lit(True))
    )
    again = rng.uniform_between(VARIANT["rg_low"], VARIANT["rg_high"], rng.uniform(seed, "realization", "sub_id", part=1))
    is_open = F.isnan("rg") | (F.col("rg") >= VARIANT["blocked_ohm"] / 10)
    return d.join(need, ["realization", "sub_id"], "left").withColumn(
        "rg", F.when(F.col("_need") & ~lock & is_open, again).otherwise(F.col("rg"))
    ).drop("_need")


def station_lists(transformers) -> DataFrame:
    """Transformers touching a station with either bus ``(sub1, sub2)``, as sorted name lists.

    A station's list is its own few units, so the list stays short.
    """
    d = transformers.select("realization", "name", F.explode(F.array_distinct(F.array("sub1", "sub2"))).alias("sub_id"))
    return d.groupBy("realization", "sub_id").agg(F.array_sort(F.collect_set("name")).alias("names"))


def config_diff(base, variant, key, columns) -> DataFrame:
    """What changed between two tables: added, removed or changed rows and columns."""
    keys = [key] if isinstance(key, str) else list(key)
    b = base.select(*keys, *[F.col(c).alias(f"b_{c}") for c in columns], F.lit(True).alias("_in_b"))
    v = variant.select(*keys, *[F.col(c).alias(f"v_{c}") for c in columns], F.lit(True).alias("_in_v"))
    d = b.join(v, keys, "full_outer")
    changes = F.concat_ws(",", *[F.when(~F.col(f"b_{c}").eqNullSafe(F.col(f"v_{c}")), F.lit(c)) for c in columns])
    kind = F.when(F.col("_in_b").isNull(), "added").when(F.col("_in_v").isNull(), "removed").otherwise(changes)
    return d.select(*keys, kind.alias("change")).filter(F.col("change") != "")


def variant_grid(lines, transformers, sites, hubs, named=(), locked=()):
    """One random variant of every realization: its lines, transformers and sites.

    Corridors of ``lines (realization, line, a, b, volt, r, v)`` are blocked together, units of
    ``transformers (realization, sub_id, name, type)`` change type, are limited, blocked and
    added, and ``sites (realization, sub_id, neutral, rg)`` are opened or grounded again.
    """
    chances = (VARIANT["p_block_500"], VARIANT["p_block_345"])
    units = cut_lineage(toggled_types(transformers, named))
    units = cut_lineage(gsu_blocking(limited_gsus(units, locked)))
    units = cut_lineage(added_units(units, locked))
    return corridor_blocking(lines, hubs, chances, VARIANT["hub_bump"]), units, regrounded_sites(sites, units, locked)


def stacked_configs(tables) -> DataFrame:
    """Tables of several configurations as one; the realization becomes ``<config>:<realization>``."""
    parts = [d.withColumn("realization", F.concat(F.lit(f"{c}:"), F.col("realization").cast("string"))) for c, d in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def split_configs(df) -> DataFrame:
    """``config`` and ``realization`` (text) out of the stacked key."""
    key = F.col("realization")
    return df.withColumns({"config": F.substring_index(key, ":", 1), "realization": F.substring_index(key, ":", -1)})


class ConfigSystem:
    """Lines, transformers and sites of several configurations, stamped into one keyed system.

    ``configs`` maps a name to (lines, transformers, sites); lines carry one row per scenario.
    Resistances at the blocking value count as open, so what hangs on them alone is left out
    of the equations instead of making them nearly singular.
    """

    def __init__(self, configs):
        lines, units, sites = (stacked_configs({c: t[k] for c, t in configs.items()}) for k in range(3))
        is_open = lambda c: F.col(c) >= VARIANT["blocked_ohm"] / 10
        # All three are read for the equations and again for the currents.
        self.lines = cut_lineage(lines.withColumn("r", F.when(is_open("r"), F.lit(INF)).otherwise(F.col("r"))))
        self.sites = cut_lineage(sites.withColumn("rg", F.when(is_open("rg"), F.lit(INF)).otherwise(F.col("rg"))))
        self.units = cut_lineage(with_windings(units))
        self.earth = earthing(self.sites)
        once = self.lines.groupBy("realization", "line", "a", "b").agg(F.min("r").alias("r"))
        #: All entries; the equations are those at ``nodes``.
        self.matrix = cut_lineage(stamped(line_branches(once).unionByName(transformer_branches(self.units)), self.earth))
        self.parts = cut_lineage(grounded_parts(self.matrix, self.earth))
        self.nodes = self.parts.select("realization", "i")

    def injections(self) -> DataFrame:
        return injections(self.lines)

    def voltages(self, rhs=None, **how) -> DataFrame:
        """Node voltages of all configurations and scenarios from one solve."""
        return cut_lineage(solve(self.matrix, self.injections() if rhs is None else rhs, parts=self.parts, **how))

    def currents(self, voltages, scenarios) -> DataFrame:
        """Currents ``(config, realization, scenario, part, name, gic)`` of lines, windings and grounds."""
        key = ["realization", "scenario"]
        parts = (
            line_currents(self.lines, voltages).select(*key, F.lit("line").alias("part"), F.col("line").alias("name"), F.col("i_line").alias("gic")),
            winding_currents(self.units, voltages, scenarios).select(*key, F.col("winding").alias("part"), "name", "gic"),
            ground_currents(self.sites.select("realization", "sub_id", "neutral"), self.earth, voltages, scenarios).select(
                *key, F.lit("ground").alias("part"), F.col("sub_id").cast("string").alias("name"), "gic"
            ),
        )
        return split_configs(reduce(DataFrame.unionByName, parts))


def compared_currents(currents, base="base", other="var") -> DataFrame:
    """Number, total and largest amount of the currents of two configurations side by side."""
    size = F.abs("gic")
    aggs = []
    for c in (base, other):
        mine = F.when(F.col("config") == c, size)
        aggs += [F.count(mine).alias(f"n_{c}"), F.sum(mine).alias(f"total_{c}"), F.max(mine).alias(f"largest_{c}")]
    return currents.groupBy("realization", "scenario", "part").agg(*aggs)


def outer_results(left, right, key, names) -> DataFrame:
    """Result tables side by side, every key present, missing values 0."""
    a = left.select(key, F.col("gic").alias(names[0]))
    b = right.select(key, F.col("gic").alias(names[1]))
    return a.join(b, key, "full_outer").na.fill(0.0, list(names))
