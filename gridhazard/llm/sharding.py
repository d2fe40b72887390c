"""Sharding by balanced label propagation: linked documents move towards their neighbours' shards under quotas.

Documents with equal texts are linked; all neighbours of a document share its text, so counts by (text, shard)
hold every neighbourhood without listing pairs. Documents start spread evenly by hash. In each round a Spark join
gives every linked document the shard with room that most of its neighbours are in (ties by hash), if that are more
than in its own, and it moves if the quota allows: a shard takes linked documents up to its capacity, drawn by hash
in proportion. Documents without links have no edge to cut and make room wherever it is needed.

Law ``rows``: at the end every shard gets its exact share, counts differing by one at most. Within a shard,
linked documents stand first and together, and what exceeds the share, single documents before all, goes to
the shards with room. Places are ranks inside (shard, bucket) plus sums over the buckets before; buckets are split
by id where one text is held by many, so no task sorts more than about ``bucket_rows`` rows however hot a text is.

A null text has size 8 and the checksum of no bytes and is linked with empty texts. Rows with null or repeated
ids are placed like others. An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridhazard.session import cut_lineage


def shares(total: int, shards: int) -> list[int]:
    return [total // shards + (s < total % shards) for s in range(shards)]


def looked_up(values, key):
    """Value of a short list at the key."""
    return F.element_at(F.array(*(F.lit(int(v)).cast("long") for v in values)), (key + 1).cast("int"))


def by_shard(rows: DataFrame, shards: int) -> list[int]:
    counts = {r.shard: r.n for r in rows.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    return [counts.get(s, 0) for s in range(shards)]


def propagate(nodes: DataFrame, shards: int, capacity: list[int], rounds: int) -> DataFrame:
    """Nodes (.., text_key, mark, copies, shard) after the rounds; only nodes with copies move."""
    linked = by_shard(nodes.filter("copies > 1"), shards)
    for turn in range(rounds):
        roomy = F.array(*(F.lit(s) for s in range(shards) if linked[s] < capacity[s])).cast("array<int>")
        seen = nodes.filter("copies > 1").groupBy("text_key", "shard").agg(F.count("*").alias("n"))
        vote = F.struct("n", F.xxhash64("text_key", "shard").alias("tie"), "shard")
        near = seen.groupBy("text_key").agg(F.collect_list(vote).alias("near"))  # at most one entry for each shard
        wish = nodes.join(near, "text_key", "left")
        here = F.array_max(F.filter("near", lambda x: x["shard"] == F.col("shard")))
        best = F.array_max(F.filter("near", lambda x: F.array_contains(roomy, x["shard"])))
        wish = cut_lineage(wish.withColumn("target", F.when(best > here, best["shard"])).drop("near"))
        come = {r.target: r.n for r in wish.filter("target is not null").groupBy("target").agg(F.count("*").alias("n")).collect()}
        if not come:
            return wish.drop("target")
        scale = 1 << 30
        open_ = [int(scale * min(1.0, (capacity[s] - linked[s]) / come[s])) if s in come else 0 for s in range(shards)]
        own = F.when(F.col("copies") > min(capacity) // 8, F.col("mark"))  # a hot text's documents one by one
        drawn = F.pmod(F.xxhash64("text_key", own, F.lit(turn)), F.lit(scale))
        let_in = F.col("target").isNotNull() & (drawn < looked_up(open_, F.coalesce("target", F.lit(0))))
        nodes = cut_lineage(wish.withColumn("shard", F.when(let_in, F.col("target")).otherwise(F.col("shard"))).drop("target"))
        linked = by_shard(nodes.filter("copies > 1"), shards)
    return nodes


def ranked(nodes: DataFrame, total: int, shards: int, bucket_rows: int) -> DataFrame:
    """Nodes with ``place``: rank in the shard from 0, linked documents first and texts together."""
    buckets = max(1, total // (shards * bucket_rows))
    single = F.when(F.col("copies") > 1, 0).otherwise(1)
    hot = F.col("copies") > bucket_rows
    spread = F.when(hot, F.pmod(F.xxhash64("text_key", "mark"), F.lit(buckets))).otherwise(F.pmod(F.xxhash64("text_key"), F.lit(buckets)))
    rows = cut_lineage(nodes.withColumn("bucket", F.struct(single.alias("single"), spread.alias("spread"))))
    counts = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = counts.select("shard", "bucket", (F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n")).alias("before"))
    inside = Window.partitionBy("shard", "bucket").orderBy("text_key", "mark", "id")
    return rows.withColumn("rank", F.row_number().over(inside) - 1).join(before, ["shard", "bucket"]).withColumn("place", F.col("before") + F.col("rank")).drop("bucket", "before", "rank")


def shard_documents(docs: DataFrame, shards=24, id_col="doc_id", text_col="text", rounds=6, bucket_rows=20_000) -> DataFrame:
    """One row per document: id, size, text_crc32, law, shard, slot, grown_shard."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.unhex(F.md5(text)).alias("text_key"), F.xxhash64(F.col(id_col)).alias("mark"))
    rows = cut_lineage(rows)
    copies = rows.groupBy("text_key").agg(F.count("*").alias("copies")).filter("copies > 1")
    nodes = rows.join(copies, "text_key", "left").withColumn("copies", F.coalesce("copies", F.lit(1).cast("long")))
    nodes = cut_lineage(nodes.withColumn("shard", F.pmod(F.xxhash64("mark", "text_key"), F.lit(shards)).cast("int")))
    total = nodes.count()
    share = shares(total, shards)
    placed = ranked(propagate(nodes, shards, share, rounds), total, shards, bucket_rows)
    placed = cut_lineage(placed)
    held = by_shard(placed, shards)
    # what exceeds the share of its shard fills the free slots, in order of shard and place
    extra = [max(0, h - s) for h, s in zip(held, share)]
    free = [max(0, s - h) for h, s in zip(held, share)]
    first_extra, first_free = [sum(extra[:s]) for s in range(shards)], [sum(free[:s]) for s in range(shards)]
    over = F.col("place") >= looked_up(share, F.col("shard"))
    index = looked_up(first_extra, F.col("shard")) + F.col("place") - looked_up(share, F.col("shard"))
    taker = reduce(lambda expr, s: expr.when(index < first_free[s] + free[s], s), [s for s in range(shards) if free[s]], F.when(F.lit(False), 0))
    moved = F.when(over, taker).otherwise(F.col("shard")).cast("int")
    slot = F.when(over, looked_up(held, moved) + index - looked_up(first_free, moved)).otherwise(F.col("place"))
    return placed.select(
        F.col("id").alias(id_col), "size", "text_crc32", F.lit("rows").alias("law"), moved.alias("shard"), slot.cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))
