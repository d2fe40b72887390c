"""Hard-negative mining by angular triangle filtering.

Components become whole numbers. Each row stores its angles to ``references`` directions, picked far apart from a sample
of at most ``SAMPLE`` rows. With an anchor's own angles the triangle inequality bounds the angle between the two, and so
the cosine; times the norms that is an interval of scores, widened by more than any rounding. A window of scores thus
allows a window of stored angles: blocks of rows whose angles to some reference lie outside are passed over, the rows of
the others stand in order of the angle to their home reference, and only the slice within the window gets integer scores.

An anchor's positives are searched among rows of its label, with its least kept score as the window's lower end, which
rises as blocks pass. Negatives are searched among all other labels with one window for each positive. Blocks hold rows of
one label and home; anchors are dealt to the shards that hold their blocks, and each task keeps the best few of an
anchor. No row is left out: what the angles cannot exclude is scored. With vectors that are nearly independent of each
other angles to references differ little, and nearly all is scored.

Rows with a null id, label or vector, or any component that is null, not finite, or so after scaling, take no part.
Vectors of different lengths are not compared. A row is no candidate of an anchor of its own id. Rows alike
count once; rows of one id that differ are candidates, and anchors, of their own. Zero and empty vectors score 0. A score
beyond a long is the long's end. Empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridhazard.session import cut_lineage

SCALE = 256
BLOCK, ANCHORS, SAMPLE = 1024, 256, 2048
#: Anchors whose best a task holds at once; beyond that it hands them on and starts anew.
HELD = 20_000
EXACT = float(1 << 53)
LONG = (1 << 63) - 1


def whole_vectors(column):
    """(rows, matrix of whole numbers) for each length of vector; rows with a component that is no finite number are left out."""
    sizes = np.asarray(column.value_lengths().fill_null(0))
    flat = np.asarray(column.flatten().cast(pa.float64()).fill_null(float("nan")))
    ends = np.cumsum(sizes)
    for d in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == d)
        with np.errstate(over="ignore"):
            x = np.floor(flat[(ends[rows] - d)[:, None] + np.arange(d)] * SCALE)
        good = np.isfinite(x).all(axis=1)
        yield rows[good], x[good]


def lengths(x):
    top = np.abs(x).max(axis=1, initial=1.0, keepdims=True)  # no overflow of squares
    return top[:, 0] * np.sqrt(((x / top) ** 2).sum(axis=1))


def directions(x):
    return x / np.maximum(lengths(x), 1.0)[:, None]


def far_apart(x, count, seed):
    """Unit rows among x, each the farthest from those before it; random ones where x has too few."""
    rng = np.random.default_rng((seed, x.shape[1]))
    spare = directions(rng.normal(size=(count, x.shape[1])) * 1e6)
    if not len(x) or not x.shape[1]:
        return spare
    u = directions(x)
    chosen, near = [], np.full(len(u), -1.0)
    for _ in range(min(count, len(u))):
        at = int(np.argmin(near))
        chosen.append(u[at])
        near = np.maximum(near, u @ u[at])
    return np.concatenate([np.array(chosen), spare])[:count]


def angles_to(x, refs):
    return np.arccos(np.clip(directions(x) @ refs.T, -1.0, 1.0))


def slack(d):
    """More than the rounding of two angles between vectors of d components."""
    return 8 * np.sqrt((d + 4) * 2.0 ** -52)


def angle_range(low, high, norm, least, most, d):
    """(from, to) of the angles at which a row with a norm from least to most can score from low to high; from > to if none."""
    low, high = low - 1 - 1e-9 * norm * most, high + 1 + 1e-9 * norm * most
    with np.errstate(divide="ignore", invalid="ignore"):
        at_least = np.where(low > 0, low / (norm * most), low / (norm * least))  # cosine, loosest over the norms
        at_most = np.where(high >= 0, high / (norm * least), high / (norm * most))
    at_least, at_most = np.nan_to_num(at_least, nan=-1.0), np.nan_to_num(at_most, nan=1.0)
    to = np.where(at_least > 1, -1.0, np.arccos(np.clip(at_least, -1, 1)) + slack(d))
    start = np.where(at_most < -1, 4.0, np.arccos(np.clip(at_most, -1, 1)) - slack(d))
    return np.maximum(start, 0.0), to


def reference_window(theta, start, to):
    """(from, to) of the angle to a reference at angle theta from the anchor, given that the row is at start..to from it."""
    return np.maximum(theta - to, start - theta), np.minimum(theta + to, 2 * np.pi - start - theta)


class Block:
    """Rows of one label and home, in order of the angle to it."""

    def __init__(self, dim, refs, ids, data, angles, norms, home):
        self.dim, self.ids, self.home = dim, np.asarray(ids, np.int64), home
        self.x = np.frombuffer(data).reshape(len(self.ids), dim)
        self.angles = np.frombuffer(angles).reshape(len(self.ids), refs)
        self.norms = np.asarray(norms, np.float64)


def scores(anchors, rows, bound):
    """Inner products as whole numbers: doubles where their sums are exact, else Python's integers, cut at a long's ends."""
    if bound < EXACT:
        return anchors @ rows.T
    a, x = (np.array([[int(v) for v in row] for row in m], object).reshape(m.shape) for m in (anchors, rows))
    return np.maximum(np.minimum(a @ x.T, LONG), -LONG - 1)


def best(ids, values, k):
    """The k best (ids, values), each pair once: highest value first, then least id."""
    pairs = sorted({(-v, i) for v, i in zip(values, ids)})[:k]
    return [i for _, i in pairs], [-v for v, _ in pairs]


class Best:
    """The best k of each key that a task has seen."""

    def __init__(self, k):
        self.k, self.kept = k, {}

    def floor(self, key):
        held = self.kept.get(key)
        return held[1][-1] if held and len(held[1]) == self.k else None

    def add(self, key, ids, values):
        """More candidates, as arrays of equal length."""
        some = self.k + len(ids) - len(np.unique(ids))  # rows alike count once
        if len(ids) > some:  # ties with the last are kept for the ids to tell
            last = np.sort(values)[-some]
            ids, values = ids[values >= last], values[values >= last]
        ids, values = ids.tolist(), [int(v) for v in values]
        old = self.kept.get(key, ([], []))
        self.kept[key] = best(old[0] + ids, old[1] + values, self.k)


def overlapping(anchors: Block, rows: Block, low, high):
    """(anchors, first row, end) whose slice of the block may score from low to high; arrays over the chosen anchors."""
    least, most = rows.norms.min(), rows.norms.max()
    start, to = angle_range(low, high, anchors.norms, least, most, anchors.dim)
    near, far = reference_window(anchors.angles, start[:, None], to[:, None])
    spare = slack(anchors.dim)
    some = (start <= to) & ((near <= rows.angles.max(axis=0) + spare) & (far >= rows.angles.min(axis=0) - spare)).all(axis=1)
    chosen = np.flatnonzero(some)
    own = rows.angles[:, rows.home]
    first = np.searchsorted(own, near[chosen, rows.home] - spare, "left")
    end = np.searchsorted(own, far[chosen, rows.home] + spare, "right")
    some = first < end
    return chosen[some], first[some], end[some]


def scored(anchors: Block, rows: Block, low, high):
    """(anchor, ids, scores) of each anchor's slice."""
    chosen, first, end = overlapping(anchors, rows, low, high)
    if not len(chosen):
        return
    lo, hi = int(first.min()), int(end.max())
    table = scores(anchors.x[chosen], rows.x[lo:hi], float(anchors.norms.max() * rows.norms.max()) * 1.01 + 1)
    for k, i in enumerate(chosen.tolist()):
        a, z = first[k] - lo, end[k] - lo
        ids, values = rows.ids[lo + a:lo + z], table[k, a:z]
        other = ids != anchors.ids[i]
        yield i, (ids if other.all() else ids[other]), (values if other.all() else values[other])


def block_pair(row, refs, side):
    return Block(row["dim"], refs, row[f"{side}_ids"], row[f"{side}_data"], row[f"{side}_angles"], row[f"{side}_norms"], row[f"{side}_home"])


def find_positives(batches, k, refs):
    kept = Best(k)

    def hand_on():
        for (anchor, mark), (ids, values) in kept.kept.items():
            yield pa.RecordBatch.from_pydict({
                "anchor": pa.array([anchor] * len(ids), pa.int64()), "mark": pa.array([mark] * len(ids), pa.int64()),
                "id": pa.array(ids, pa.int64()), "score": pa.array(values, pa.int64())})
        kept.kept.clear()

    for batch in batches:
        for row in batch.to_pylist():
            anchors, rows, marks = block_pair(row, refs, "a"), block_pair(row, refs, "x"), row["a_mark"]
            floors = [kept.floor((i, m)) for i, m in zip(anchors.ids.tolist(), marks)]
            low = np.array([-np.inf if f is None else float(f) for f in floors])
            for i, ids, values in scored(anchors, rows, low, np.full(len(low), np.inf)):
                some = values >= floors[i] if floors[i] is not None else np.ones(len(ids), bool)
                if some.any():
                    kept.add((int(anchors.ids[i]), marks[i]), ids[some], values[some])
            if len(kept.kept) > HELD:
                yield from hand_on()
    yield from hand_on()


def find_negatives(batches, k, share, refs):
    """``share``: least and most hundredths of the positive's score."""
    kept = Best(k)

    def hand_on():
        for (anchor, mark, positive, score), (ids, values) in kept.kept.items():
            n = len(ids)
            yield pa.RecordBatch.from_pydict({
                name: pa.array(v, pa.int64()) for name, v in (
                    ("anchor", [anchor] * n), ("mark", [mark] * n), ("positive", [positive] * n), ("positive_score", [score] * n),
                    ("id", ids), ("score", values))})
        kept.kept.clear()

    for batch in batches:
        for row in batch.to_pylist():
            anchors, rows, marks = block_pair(row, refs, "a"), block_pair(row, refs, "x"), row["a_mark"]
            windows = []
            for i, (anchor, mark) in enumerate(zip(anchors.ids.tolist(), marks)):
                own = []
                for told in row["a_positives"][i]:
                    positive, score = told["id"], told["score"]
                    key = (anchor, mark, positive, score)
                    low, high, floor = -(-share[0] * score // 100), share[1] * score // 100, kept.floor(key)
                    low = low if floor is None else max(low, floor)
                    if low <= high:
                        own.append((key, low, high))
                windows.append(own)
            low = np.array([min((float(w[1]) for w in own), default=np.inf) for own in windows])
            high = np.array([max((float(w[2]) for w in own), default=-np.inf) for own in windows])
            for i, ids, values in scored(anchors, rows, low, high):
                for key, a, z in windows[i]:
                    some = (values >= a) & (values <= z)
                    if some.any():
                        kept.add(key, ids[some], values[some])
            if len(kept.kept) > HELD:
                yield from hand_on()
    yield from hand_on()


def measured(rows: DataFrame, refs) -> DataFrame:
    """(dim, label, home, id, mark, asks, data, angles, norm) of every row that takes part."""

    def measure(batches):
        for batch in batches:
            for at, x in whole_vectors(batch.column("vector")):
                if not len(at):
                    continue
                own, d = pa.array(at), x.shape[1]
                angles = angles_to(x, refs.get(d, far_apart(x[:0], refs["count"], refs["seed"])))
                yield pa.RecordBatch.from_pydict({
                    "dim": pa.array(np.full(len(at), d), pa.int32()), "home": pa.array(np.argmin(angles, axis=1), pa.int32()),
                    **{c: batch.column(c).take(own) for c in ("label", "id", "mark", "asks")},
                    "data": pa.array([v.tobytes() for v in x], pa.binary()), "angles": pa.array([v.tobytes() for v in angles], pa.binary()),
                    "norm": pa.array(lengths(x), pa.float64())})

    return rows.mapInArrow(measure, "dim int, home int, label string, id long, mark long, asks boolean, data binary, angles binary, norm double")


def packed(rows: DataFrame, side, size, refs, more="") -> DataFrame:
    """Blocks of at most ``size`` rows of a partition that are alike in (dim, label, home), in order of the angle to home."""
    extra = [m.split(" ", 1)[0] for m in more.split("; ") if m]

    def block(key, held):
        dim, label, home = key
        held.sort(key=lambda r: np.frombuffer(r["angles"])[home])
        out = {"dim": [dim], f"{side}_label": [label], f"{side}_home": [home], f"{side}_ids": [[r["id"] for r in held]],
               f"{side}_data": [b"".join(r["data"] for r in held)], f"{side}_angles": [b"".join(r["angles"] for r in held)],
               f"{side}_norms": [[r["norm"] for r in held]]} | {f"{side}_{c}": [[r[c] for r in held]] for c in extra}
        return pa.RecordBatch.from_pylist([{k: v[0] for k, v in out.items()}], schema=arrow)

    fields = [("dim", pa.int32()), (f"{side}_label", pa.string()), (f"{side}_home", pa.int32()), (f"{side}_ids", pa.list_(pa.int64())),
              (f"{side}_data", pa.binary()), (f"{side}_angles", pa.binary()), (f"{side}_norms", pa.list_(pa.float64()))]
    told = pa.list_(pa.struct([("id", pa.int64()), ("score", pa.int64())]))
    kinds = {"mark": pa.list_(pa.int64()), "positives": pa.list_(told)}
    arrow = pa.schema(fields + [(f"{side}_{c}", kinds[c]) for c in extra])

    def pack(batches):
        held: dict[tuple, list] = {}
        for batch in batches:
            for row in batch.to_pylist():
                key = row["dim"], row["label"], row["home"]
                own = held.setdefault(key, [])
                own.append(row)
                if len(own) == size:
                    yield block(key, held.pop(key))
        for key, own in held.items():
            yield block(key, own)

    schema = f"dim int, {side}_label string, {side}_home int, {side}_ids array<long>, {side}_data binary, {side}_angles binary, {side}_norms array<double>"
    return rows.mapInArrow(pack, schema + "".join(f", {side}_{m.replace(' ', ' array<', 1)}>" for m in more.split("; ") if m))


def mine(vectors: DataFrame, is_anchor, positives=5, negatives=3, share=(50, 95), references=16, id_col="vec_id", vector_col="embedding", label_col="label", seed=5) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    For each anchor and each of its best ``positives`` rows of its label: the best ``negatives`` rows of other labels that
    score between the shares, in hundredths, of the positive's score.
    """
    rows = vectors.select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).alias("vector"),
        F.coalesce(is_anchor, F.lit(False)).alias("asks")).filter("id is not null and label is not null and vector is not null")
    rows = rows.withColumn("mark", F.xxhash64("label", "vector"))
    sample = rows.orderBy(F.xxhash64("id", "mark")).limit(SAMPLE).select("vector").toArrow().combine_chunks()
    column = sample.column("vector").combine_chunks() if sample.num_rows else None
    refs = {"count": references, "seed": seed}
    for _, x in whole_vectors(column) if column is not None else ():
        refs[x.shape[1]] = far_apart(x, references, seed)
    found = cut_lineage(measured(rows, refs))
    total = found.count()
    salts = 1 + total // (64 * 8 * BLOCK)  # a cell may hold any share of the rows; a salted one is a bounded number
    spread = found.repartition("dim", "label", "home", F.pmod(F.xxhash64("id"), F.lit(salts)))
    blocks = packed(spread.drop("asks", "mark"), "x", BLOCK, references)
    shards = max(1, min(1024, total // (8 * BLOCK)))
    blocks = cut_lineage(blocks.withColumn("shard", F.pmod(F.xxhash64("x_label", "x_home", "x_ids"), F.lit(shards)).cast("int")))
    asked = found.filter("asks").drop("asks").withColumn("home", F.lit(0))
    by_label = packed(asked.repartition("dim", "label", F.pmod(F.xxhash64("id"), F.lit(salts))), "a", ANCHORS, references, "mark long")
    places = blocks.select("dim", "shard", "x_label").distinct()
    to_own = by_label.join(places.withColumnRenamed("x_label", "a_label"), ["dim", "a_label"])
    pairs = to_own.join(blocks.withColumn("a_label", F.col("x_label")), ["dim", "shard", "a_label"])
    best_first = Window.partitionBy("anchor", "mark").orderBy(F.desc("score"), "id")
    near = pairs.mapInArrow(lambda b: find_positives(b, positives, references), "anchor long, mark long, id long, score long")
    near = cut_lineage(near).distinct().withColumn("rank", F.row_number().over(best_first)).filter(F.col("rank") <= positives)
    told = near.groupBy("anchor", "mark").agg(F.collect_list(F.struct("id", "score")).alias("positives"))
    with_positives = asked.dropDuplicates(["id", "mark"]).join(told.withColumnRenamed("anchor", "id"), ["id", "mark"])
    asking = packed(with_positives.repartition("dim", "label", F.pmod(F.xxhash64("id"), F.lit(salts))), "a", ANCHORS, references, "mark long; positives array<struct<id:long,score:long>>")
    to_others = cut_lineage(asking).join(places.select("dim", "shard").distinct(), "dim")
    pairs = to_others.join(blocks, ["dim", "shard"]).filter("a_label != x_label")
    hard = pairs.mapInArrow(lambda b: find_negatives(b, negatives, share, references),
                            "anchor long, mark long, positive long, positive_score long, id long, score long")
    hard_first = Window.partitionBy("anchor", "mark", "positive", "positive_score").orderBy(F.desc("score"), "id")
    ranked = cut_lineage(hard).distinct().withColumn("rank", F.row_number().over(hard_first)).filter(F.col("rank") <= negatives)
    return ranked.select(
        F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), "rank", F.col("id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"))
