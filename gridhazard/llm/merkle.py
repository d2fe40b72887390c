"""Merkle manifest of a table: few stored levels, proofs from recomputed subtrees.

Leaves are digests of rows. In each branch (a value of the branch column) they ascend by the order columns; a pair of
consecutive nodes, or a last one alone, becomes the digest of their hexadecimal texts, until one node is left, the
branch's subroot. Subroots in order of their branches (null first) make the root likewise.

Only every ``every``-th level is written to the shared folder: an aligned subtree of 2**every stored nodes is one
bounded group, whose task hashes it up to the next stored level. Proofs are read from the top down. A group of stored
nodes meets the proof of the node above it, recomputes its own interior nodes, hands every member its siblings
followed by the proof from above, and forgets the interior again. No join has more rows of a key than a subtree has nodes,
so a branch with most rows is as many groups as it needs; a lost executor repeats subtrees of one band of levels.

A proof is a byte string, leaf to root: for each level 0 (alone), or 1 (sibling to the left) or 2 (to the right) and
the 32 bytes of the sibling. ``folded`` walks a leaf up its proof.

Rows that are alike are leaves of their own; rows with one id in a branch stand in order of their digests, null ids
first. Null fields are told from empty ones. A branch of one row is its leaf; a table of one row has an empty proof.
An empty table has no rows and no root. Extra columns are not read; names may clash.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from gridhazard.session import cut_lineage

EVERY = 10
ALONE, LEFT, RIGHT = b"\x00", b"\x01", b"\x02"


def field(column):
    """A value as text that no other value has: '-' for null, else its length in bytes, a colon and the value."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def row_digest(*columns):
    """Digest of a row's columns in the given order."""
    return F.unhex(F.sha2(F.concat(*[field(c) for c in columns]).cast("binary"), 256))


def parent(left, right=b""):
    return sha256((left.hex() + right.hex()).encode()).digest()


def numbered(rows: DataFrame, order) -> DataFrame:
    """Adds ``pos``, gapless from 0 in each branch by the order columns, and ``total``, the branch's rows; written once.

    Rows are dealt by ranges, so that no branch, and no run of equal rows, has to fit in a task.
    """
    rows = rows.withColumn("tie", F.monotonically_increasing_id())
    rows = rows.repartitionByRange("branch", *order, "tie").sortWithinPartitions("branch", *order, "tie").drop("tie")
    placed = cut_lineage(rows.withColumn("spot", F.monotonically_increasing_id()))
    part = F.shiftright("spot", 33)
    runs = placed.groupBy("branch", part.alias("part")).agg(F.min("spot").alias("first"), F.count("*").alias("n"))
    whole = Window.partitionBy("branch")
    before = F.sum("n").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select("branch", "part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"), F.sum("n").over(whole).alias("total"))
    out = placed.withColumn("part", part).join(runs, ["branch", "part"])
    return out.withColumn("pos", F.col("spot") + F.col("shift")).drop("part", "spot", "shift")


def height(total):
    """Levels above the leaves of a branch."""
    return (total - 1).bit_length()


def pair_up(nodes):
    return [parent(*nodes[k:k + 2]) for k in range(0, len(nodes), 2)]


def groups_of(batch):
    """For each subtree of a batch: its row, and places of its nodes by position among the batch's nodes."""
    column = batch.column("nodes")
    sizes = np.asarray(column.value_lengths())
    flat = column.flatten()
    pos = np.asarray(flat.field("pos"))
    ends = np.cumsum(sizes)
    places = [begin + np.argsort(pos[begin:end], kind="stable") for begin, end in zip(ends - sizes, ends)]
    return flat, sizes, places


def subtrees(nodes: DataFrame, every) -> DataFrame:
    """(branch, block, total, nodes) of the aligned subtrees of a stored level."""
    block = F.shiftright("pos", every).alias("block")
    return nodes.groupBy("branch", block, "total").agg(F.collect_list(F.struct(*[c for c in nodes.columns if c not in ("branch", "total")])).alias("nodes"))


def next_stored(nodes: DataFrame, level, every) -> DataFrame:
    """The nodes ``every`` levels above those of ``level``, or the subroot where it comes before."""

    def climb(batches):
        for batch in batches:
            flat, _, places = groups_of(batch)
            digest, tops = flat.field("digest"), []
            for at, total in zip(places, batch.column("total").to_pylist()):
                row = digest.take(pa.array(at)).to_pylist()
                for _ in range(min(every, height(total) - level)):
                    row = pair_up(row)
                tops.append(row[0])
            yield pa.RecordBatch.from_arrays([batch.column("branch"), batch.column("block"), batch.column("total"), pa.array(tops, pa.binary())], ["branch", "pos", "total", "digest"])

    return subtrees(nodes.select("branch", "pos", "total", "digest"), every).mapInArrow(climb, "branch string, pos long, total long, digest binary")


def stored_levels(leaves: DataFrame, every=EVERY) -> list[DataFrame]:
    """Stored tables of all branches: leaves (branch, pos, total, digest, ...), then every ``every``-th level, written."""
    tables = [leaves]
    most = leaves.agg(F.max("total")).first()[0] or 1
    for level in range(0, height(most), every):
        open_nodes = tables[-1].filter(F.col("total") > F.lit(1).cast("long") * (1 << level))
        tables.append(cut_lineage(next_stored(open_nodes, level, every)))
    return tables


def subroots(tables, every=EVERY) -> DataFrame:
    """(branch, digest) of all branches: the stored nodes that nothing stands above."""
    out = None
    for k, nodes in enumerate(tables):
        done = nodes.filter(F.col("total") <= 1 << (k * every)).select("branch", "digest")
        out = done if out is None else out.union(done)
    return out


def proofs(tables, above: DataFrame, every=EVERY) -> DataFrame:
    """Leaves with their ``proof``. ``above``: (branch, proof) of the subroots. Adds ``subroot``."""
    over = None
    for k in range(len(tables) - 1, -1, -1):
        level, nodes = k * every, tables[k]
        kept = [c for c in nodes.columns if c not in ("branch", "total", "pos")]
        done = nodes.filter(F.col("total") <= 1 << level).join(above, "branch")
        done = done.select("branch", "pos", "total", *kept, F.col("digest").alias("subroot"), "proof")
        if over is None:
            over = done
            continue
        groups = subtrees(nodes.filter(F.col("total") > 1 << level), every)
        up = over.select("branch", F.col("pos").alias("block"), "subroot", "proof")
        schema = done.schema

        def spread(batches, level=level, kept=tuple(kept)):
            for batch in batches:
                flat, sizes, places = groups_of(batch)
                digest, out = flat.field("digest"), []
                for at, total, tail in zip(places, batch.column("total").to_pylist(), batch.column("proof").to_pylist()):
                    row, index = digest.take(pa.array(at)).to_pylist(), np.arange(len(at))
                    steps: list[list[bytes]] = [[] for _ in at]
                    for _ in range(min(every, height(total) - level)):
                        for leaf, i in enumerate(index.tolist()):
                            steps[leaf].append(LEFT + row[i - 1] if i & 1 else RIGHT + row[i + 1] if i + 1 < len(row) else ALONE)
                        row, index = pair_up(row), index >> 1
                    out += [b"".join(s) + tail for s in steps]
                order = pa.array(np.concatenate(places) if places else np.zeros(0, np.int64))
                told, times = flat.take(order), pa.array(np.repeat(np.arange(len(sizes)), sizes))
                columns = {"branch": batch.column("branch").take(times), "total": batch.column("total").take(times),
                           "subroot": batch.column("subroot").take(times), "proof": pa.array(out, pa.binary())}
                columns |= {c: told.field(c) for c in ("pos", *kept)}
                yield pa.RecordBatch.from_pydict({name: columns[name] for name in schema.names})

        under = groups.join(up, ["branch", "block"]).mapInArrow(spread, schema)
        over = under.union(done)
    return over


def walk(digest, proof):
    """(root, digest of the siblings' texts) from a leaf and its proof."""
    told, at = sha256(), 0
    while at < len(proof):
        side, at = proof[at], at + 1
        if not side:
            digest = parent(digest)
            continue
        other, at = proof[at:at + 32], at + 32
        told.update(other.hex().encode())
        digest = parent(other, digest) if side == 1 else parent(digest, other)
    return digest, told.digest()


def folded(rows: DataFrame, leaf_col) -> DataFrame:
    """Adds ``folded``, the root that a leaf and its proof give, and ``proof_digest``, of its siblings' texts."""
    names = rows.columns

    def fold(batches):
        for batch in batches:
            found = [walk(d, p) for d, p in zip(batch.column(leaf_col).to_pylist(), batch.column("proof").to_pylist())]
            extra = [pa.array([f[k] for f in found], pa.binary()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], [*names, "folded", "proof_digest"])

    schema = StructType([*rows.schema.fields, StructField("folded", BinaryType()), StructField("proof_digest", BinaryType())])
    return rows.mapInArrow(fold, schema)


def manifest(docs: DataFrame, id_col="doc_id", branch_col="lang", fields=("doc_id", "source", "lang", "n_chars", "text"), every=EVERY, **more):
    """(leaves, root): id, digest, subroot and proof of every row, and the root's bytes (None for an empty table).

    ``more``: further columns by name, computed on the rows and carried along with the leaves.
    """
    branch = F.coalesce(F.concat(F.lit("+"), F.col(branch_col).cast("string")), F.lit(""))
    rows = docs.select(
        branch.alias("branch"), F.col(id_col).alias("id"), row_digest(*[F.col(c) for c in fields]).alias("digest"),
        *[c.alias(name) for name, c in more.items()])
    tables = stored_levels(numbered(cut_lineage(rows), ["id", "digest"]), every)
    heads = subroots(tables, every).select(F.lit("").alias("branch"), F.col("branch").alias("name"), "digest")
    top = stored_levels(numbered(heads, ["name"]), every)
    last = subroots(top, every).first()
    above = proofs(top, top[0].select("branch").distinct().withColumn("proof", F.lit(b"")), every)
    out = proofs(tables, above.select(F.col("name").alias("branch"), "proof"), every)
    return out.select("id", "digest", *more, "subroot", "proof"), last and bytes(last["digest"])


def verified(docs: DataFrame, changed, id_col="doc_id", fields=("doc_id", "source", "lang", "n_chars", "text"), **options) -> DataFrame:
    """(id, digest, subroot, root, proof_digest, folded, verified): rows after a change held against their proofs.

    ``changed`` maps field names to the columns that they hold now; the proofs are of the rows as given.
    """
    now = row_digest(*[changed.get(c, F.col(c)) for c in fields])
    leaves, root = manifest(docs, id_col, fields=fields, now=now, **options)
    out = folded(leaves, "now").withColumn("root", F.lit(root).cast("binary"))
    return out.select("id", "digest", "subroot", "root", "proof_digest", "folded", (F.col("folded") == F.col("root")).alias("verified"))
