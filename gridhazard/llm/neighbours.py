"""Approximate nearest neighbours by cross-polytope hashing.

Each of ``tables`` hash tables turns unit vectors by ``axes`` pseudo-rotations, three rounds of random signs and a
fast Hadamard transform each, and files a vector under its nearest signed axes. A query probes the ``probes``
likeliest axis tuples of each table, and every vector filed there is ranked by its exact cosine in double precision.
Nothing is capped: every vector is filed in every table and every vector of a probed bucket is compared.

Filed vectors are packed into blocks of bounded rows, split by a salt that grows with the input, so a bucket with
a third of all rows is many blocks and passes through many tasks. Blocks meet the blocks of queries of their
bucket in a join; each task keeps the best few of each query it has seen.

Vectors that are null, zero, or hold null or non-finite components take no part, nor do null ids. Vectors are
compared with those of their own length only. A row is no candidate of a query of its own id; rows that are
alike count once. Ties go to the smaller id. A query whose probed buckets hold fewer than k other vectors is compared with all
vectors, block by block, so it has fewer rows only where there are fewer candidates. Empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridhazard.session import cut_lineage

BLOCK = 1024
CLOSE = 1e-9  # far above rounding: what is within this of the last rank is ranked exactly


def hadamard(x):
    """Fast Walsh-Hadamard transform of each row, scaled to keep lengths."""
    rows, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(rows, d // (2 * h), 2, h)
        x = np.concatenate([x[:, :, :1] + x[:, :, 1:], x[:, :, :1] - x[:, :, 1:]], axis=2).reshape(rows, d)
        h *= 2
    return x / np.sqrt(d)


def signed_axes(x, seed):
    """Each row's weight along every signed axis after a pseudo-rotation."""
    width = 1 << max(0, x.shape[1] - 1).bit_length()
    rng = np.random.default_rng(seed)
    y = np.zeros((len(x), width))
    y[:, :x.shape[1]] = x
    for _ in range(3):
        y = hadamard(y * rng.choice([-1.0, 1.0], width))
    return np.concatenate([y, -y], axis=1)


def buckets(x, table, axes, probes, seed):
    """Rows x probes: the likeliest buckets of each unit vector in a table, likeliest first."""
    best, weight = np.zeros((len(x), 1), np.int64), np.zeros((len(x), 1))
    for axis in range(axes):
        along = signed_axes(x, (seed, table, axis))
        near = np.argsort(-along, axis=1, kind="stable")[:, :probes]
        total = weight[:, :, None] + np.take_along_axis(along, near, 1)[:, None, :]
        place = best[:, :, None] * along.shape[1] + near[:, None, :]
        total, place = total.reshape(len(x), -1), place.reshape(len(x), -1)
        first = np.argsort(-total, axis=1, kind="stable")[:, :probes]
        best, weight = np.take_along_axis(place, first, 1), np.take_along_axis(total, first, 1)
    return best


def vectors_of(batch):
    """(ids, matrix in double precision) for each length of vector in a batch of (id, vector)."""
    column = batch.column("vector")
    sizes = np.asarray(column.value_lengths().fill_null(0))
    flat = np.asarray(column.flatten().cast(pa.float64()).fill_null(float("nan")))
    ends = np.cumsum(sizes)
    ids = np.asarray(batch.column("id"))
    for d in np.unique(sizes[sizes > 0]).tolist():
        rows = np.flatnonzero(sizes == d)
        x = flat[(ends[rows] - d)[:, None] + np.arange(d)]
        good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
        yield ids[rows[good]], x[good]


def unit(x):
    top = np.abs(x).max(axis=1, keepdims=True)  # no overflow of squares
    return x / top / np.linalg.norm(x / top, axis=1, keepdims=True)


def filed(vectors: DataFrame, tables, axes, probes, seed) -> DataFrame:
    """(dim, tab, bucket, id, data) of every vector in every table, or under every probe."""

    def file(batches):
        for batch in batches:
            for ids, x in vectors_of(batch):
                data = [row.tobytes() for row in x]
                u = unit(x)
                for table in range(tables):
                    for place in buckets(u, table, axes, probes, seed).T if len(ids) else ():
                        yield pa.RecordBatch.from_pydict({
                            "dim": pa.array(np.full(len(ids), x.shape[1]), pa.int32()), "tab": pa.array(np.full(len(ids), table), pa.int32()),
                            "bucket": pa.array(place, pa.int64()), "id": pa.array(ids, pa.int64()), "data": pa.array(data, pa.binary())})

    return vectors.mapInArrow(file, "dim int, tab int, bucket long, id long, data binary")


def packed(rows: DataFrame, name: str) -> DataFrame:
    """(dim, tab, bucket, ids, data): rows of a bucket in a partition, at most BLOCK in a block."""

    def pack(batches):
        held: dict[tuple, list] = {}

        def block(key, rows):
            dim, tab, bucket = key
            return pa.RecordBatch.from_pydict({
                "dim": pa.array([dim], pa.int32()), "tab": pa.array([tab], pa.int32()), "bucket": pa.array([bucket], pa.int64()),
                f"{name}_ids": pa.array([[r[0] for r in rows]], pa.list_(pa.int64())), f"{name}_data": pa.array([b"".join(r[1] for r in rows)], pa.binary())})

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("dim", "tab", "bucket", "id", "data")]
            for dim, tab, bucket, key, data in zip(*columns):
                rows = held.setdefault((dim, tab, bucket), [])
                rows.append((key, data))
                if len(rows) == BLOCK:
                    yield block((dim, tab, bucket), held.pop((dim, tab, bucket)))
        for place, rows in held.items():
            yield block(place, rows)

    return rows.mapInArrow(pack, f"dim int, tab int, bucket long, {name}_ids array<long>, {name}_data binary")


def cosines(a, b):
    """Cosine of each pair of rows, always summed in the same order."""
    ta, tb = np.abs(a).max(axis=-1, keepdims=True), np.abs(b).max(axis=-1, keepdims=True)
    a, b = a / ta, b / tb
    return (a * b).sum(axis=-1) / (np.sqrt((a * a).sum(axis=-1)) * np.sqrt((b * b).sum(axis=-1)))


def best_of(ids, scores, k):
    """Places of the k best: highest score first, then the least id."""
    return np.lexsort((ids, -scores))[:k]


def rank_blocks(batches, k):
    """The k best candidates of each query over the block pairs of a partition."""
    kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for dim, q_ids, q_data, x_ids, x_data in zip(*(batch.column(c).to_pylist() for c in ("dim", "q_ids", "q_data", "x_ids", "x_data"))):
            q, x = np.frombuffer(q_data).reshape(-1, dim), np.frombuffer(x_data).reshape(-1, dim)
            q_ids, x_ids = np.array(q_ids), np.array(x_ids)
            rough = unit(q) @ unit(x).T
            rough[q_ids[:, None] == x_ids[None, :]] = -np.inf
            for i, key in enumerate(q_ids.tolist()):
                near = rough[i]
                old = kept.get(key)
                floor = max(old[1].min() if old is not None and len(old[1]) == k else -2.0, np.partition(near, len(near) - k)[len(near) - k] if len(near) > k else -2.0)
                some = np.flatnonzero(near >= floor - CLOSE)
                if not len(some):
                    continue
                ids, scores = x_ids[some], cosines(q[i], x[some])
                if old is not None:
                    ids, scores = np.concatenate([old[0], ids]), np.concatenate([old[1], scores])
                pairs = np.unique(np.rec.fromarrays([ids, scores]))
                ids, scores = pairs["f0"], pairs["f1"]
                top = best_of(ids, scores, k)
                kept[key] = (ids[top], scores[top])
    for key, (ids, scores) in kept.items():
        yield pa.RecordBatch.from_pydict({
            "query_id": pa.array(np.full(len(ids), key), pa.int64()), "vec_id": pa.array(ids, pa.int64()), "score": pa.array(scores, pa.float64())})


def nearest(vectors: DataFrame, is_query, k=5, tables=16, probes=6, axes=1, id_col="vec_id", vector_col="embedding", seed=11) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for each row where ``is_query`` holds."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"), is_query.alias("asks")).filter("id is not null and size(vector) > 0")
    total = rows.count()
    # a bucket holds at most all rows: with that many salts even a third of them is a bounded number in a task
    salts = 1 + total // (128 * 4 * BLOCK)
    keys = ["dim", "tab", "bucket"]
    index = filed(rows.select("id", "vector"), tables, axes, 1, seed).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)))
    index = packed(index.repartition(*keys, "salt").drop("salt"), "x")
    asked = packed(filed(rows.filter("asks").select("id", "vector"), tables, axes, probes, seed).repartition(*keys), "q")
    found = index.join(asked, keys).mapInArrow(lambda batches: rank_blocks(batches, k), "query_id long, vec_id long, score double")
    ranked = cut_lineage(best_rows(cut_lineage(found), k))
    enough = ranked.groupBy(F.col("query_id").alias("id")).agg(F.count("*").alias("n")).filter(F.col("n") >= k)
    short = cut_lineage(rows.filter("asks").select("id", "vector").join(enough, "id", "left_anti"))
    if short.isEmpty():
        return ranked
    # too few vectors in the probed buckets: these queries meet all vectors, block by block
    shards = max(1, min(1024, total // (8 * BLOCK)))
    every = filed(rows.select("id", "vector"), 1, axes, 1, seed).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)))
    every = packed(every.repartition(*keys, "salt").drop("salt"), "x").withColumn("shard", F.pmod(F.xxhash64("bucket", "x_ids"), F.lit(shards)))
    few = packed(filed(short, 1, axes, 1, seed).repartition(*keys), "q").withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
    whole = every.drop("tab", "bucket").join(few.drop("tab", "bucket"), ["dim", "shard"]).drop("shard")
    whole = best_rows(cut_lineage(whole.mapInArrow(lambda batches: rank_blocks(batches, k), "query_id long, vec_id long, score double")), k)
    return ranked.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti").union(whole)


def best_rows(found: DataFrame, k) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k best rows, alike ones once."""
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.distinct().withColumn("rank", F.row_number().over(best))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
