"""Benchmark decontamination by Wu-Manber search over words.

Words are maximal runs of ASCII letters (folded to lower case), ASCII digits and non-ASCII bytes. Every
window of ``n`` consecutive item words is a test string; an item of fewer words is one window. Test strings
of one length m share a table of shifts indexed by the hash of a block of two words: how far the search may
move without passing over an end of a test string. Where the shift is zero, the bucket of that suffix hash
is searched for the window's hash, and the words' bytes are compared directly.

All documents of a chunk are searched in step, cut into segments of equal length, so one very long text does
not leave the others waiting. The test strings are split into groups of at most ``group_bytes`` of item text;
their tables are built in tasks and written, and each group is one narrow pass over the documents, so what the driver
holds and what is broadcast at once is bounded.

Nulls and empty texts have no words: nothing is hit. A null ``item_id`` hits words but is not listed among
the items. Repeated rows are judged alike, one by one. An empty item table contaminates nothing. Extra
columns are not read by ``decontaminate``, and are kept as they are by ``drop_contaminated``.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridhazard.llm.bytescan import ASCII_LOWER, byte_class, mix64, span_hashes, text_chunks, word_spans, words_of_rows
from gridhazard.session import cut_lineage

WORD = byte_class([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)], inside=False)
WORD[0x41:0x5B] = True  # upper case is folded before words are taken
SEGMENT = 256
BLOCK_FACTOR = np.uint64(0xC2B2AE3D27D4EB4F)


def block_hashes(words, m):
    """Hash of the block that ends at each word: two words, or one where test strings are single words."""
    out = words.copy()
    if m > 1:
        out[1:] = mix64(words[:-1] * BLOCK_FACTOR + words[1:])
    return out


def window_hashes(words, ends, m):
    """Hash of the m words that end at each of the given positions."""
    total = np.zeros(len(ends), np.uint64)
    for k in range(m):
        total = mix64(total + words[ends - (m - 1) + k])
    return total


class Tables:
    """Shift table and suffix buckets of the test strings of one length."""

    def __init__(self, m, strings):
        # strings: {tuple of word bytes: set of item ids}
        self.m, self.texts = m, list(strings)
        self.items = [sorted(i for i in strings[t] if i is not None) for t in self.texts]
        flat = b"".join(w for t in self.texts for w in t)
        ends = np.cumsum([len(w) for t in self.texts for w in t])
        starts = np.concatenate([[0], ends[:-1]])
        words = span_hashes(np.frombuffer(flat, np.uint8), starts, ends)
        block = 2 if m > 1 else 1
        default = m - block + 1
        blocks = block_hashes(words, m).reshape(-1, m)
        bits = max(12, int(np.ceil(np.log2(8 * max(1, blocks.size)))))
        self.mask = np.uint64((1 << bits) - 1)
        self.shift = np.full(1 << bits, default, np.uint8)
        for q in range(block - 1, m):
            np.minimum.at(self.shift, (blocks[:, q] & self.mask).astype(np.int64), m - 1 - q)
        self.suffix = np.unique(blocks[:, m - 1])
        full = window_hashes(words, np.arange(len(self.texts)) * m + m - 1, m)
        order = np.argsort(full)
        self.full, self.which = full[order], order

    @classmethod
    def of(cls, state):
        self = cls.__new__(cls)
        self.__dict__.update(state)
        return self

    def search(self, lowered, words, starts, ends, first):
        """(end word, test string) of every occurrence; ``first``: first word of each row."""
        m = self.m
        blocks = block_hashes(words, m)
        slots = self.shift[(blocks & self.mask).astype(np.int64)]
        lo, hi = first[:-1] + (m - 1), first[1:]
        count = np.maximum(0, -(-(hi - lo) // SEGMENT))
        rows = np.repeat(np.arange(len(lo)), count)
        part = np.arange(len(rows)) - np.repeat(np.cumsum(count) - count, count)
        at = lo[rows] + part * SEGMENT
        stop = np.minimum(hi[rows], at + SEGMENT)
        found = []
        while len(at):
            step = slots[at]
            stay = step == 0
            found.append(at[stay])
            at = at + np.maximum(step, 1)
            more = at < stop
            at, stop = at[more], stop[more]
        spots = np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)
        # suffix bucket, then the window's place in it
        b = np.searchsorted(self.suffix, blocks[spots])
        b[b == len(self.suffix)] = 0
        spots = spots[self.suffix[b] == blocks[spots]]
        full = window_hashes(words, spots, m)
        lo_k, hi_k = np.searchsorted(self.full, full, "left"), np.searchsorted(self.full, full, "right")
        out = []
        for spot, a, z in zip(spots.tolist(), lo_k.tolist(), hi_k.tolist()):
            for k in range(a, z):
                which = int(self.which[k])
                here = range(spot - m + 1, spot + 1)
                if all(lowered[starts[i]:ends[i]] == w for i, w in zip(here, self.texts[which])):
                    out.append((spot, which))
        return out


def text_words(text):
    """The words of one item text, as bytes."""
    data = np.frombuffer((text or "").encode(), np.uint8)
    low = ASCII_LOWER[data].tobytes()
    starts, ends = word_spans(data, np.array([0, len(data)]), WORD)
    return [low[a:b] for a, b in zip(starts.tolist(), ends.tolist())]


def tables_of(items, n):
    """Search tables of a group of (item id, text), one for each length of test string."""
    by_length: dict[int, dict] = {}
    for item, text in items:
        words = text_words(text)
        m = min(n, len(words))
        for k in range(len(words) - m + 1 if m else 0):
            by_length.setdefault(m, {}).setdefault(tuple(words[k:k + m]), set()).add(item)
    return [Tables(m, strings) for m, strings in sorted(by_length.items())]


def scan(column, tables):
    """For each text: number of words, hit word ranges (flat start, end pairs), item ids as strings."""
    n_words, ranges, items = [], [], []
    for _, data, offs in text_chunks(column):
        starts, ends = word_spans(data, offs, WORD)
        words = span_hashes(data, starts, ends, ASCII_LOWER)
        first = words_of_rows(starts, offs)
        lowered = ASCII_LOWER[data].tobytes()
        cover = np.zeros(len(words) + 1, np.int64)
        named = [set() for _ in range(len(offs) - 1)]
        for t in tables:
            got = t.search(lowered, words, starts, ends, first)
            if not got:
                continue
            spots = np.array([g[0] for g in got])
            np.add.at(cover, spots - t.m + 1, 1)
            np.add.at(cover, spots + 1, -1)
            for row, which in set(zip((np.searchsorted(first, spots, "right") - 1).tolist(), (g[1] for g in got))):
                named[row].update(t.items[which])
        hit = np.cumsum(cover)[:-1] > 0
        for row in range(len(offs) - 1):
            a, z = int(first[row]), int(first[row + 1])
            n_words.append(z - a)
            part = hit[a:z]
            if part.any():
                edge = np.flatnonzero(np.diff(np.concatenate([[0], part.view(np.int8), [0]])))
                ranges.append(edge.astype(np.int32).tolist())
            else:
                ranges.append([])
            items.append(sorted(str(i) for i in named[row]))
    return n_words, ranges, items


def merged(old, new):
    """Union of two flat lists of ranges."""
    if not old or not new:
        return old or new
    out: list[int] = []
    for a, z in sorted([*zip(old[::2], old[1::2]), *zip(new[::2], new[1::2])]):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], z)
        else:
            out += [a, z]
    return out


def group_tables(items: DataFrame, item_id: str, text: str, group_bytes: int, n: int) -> DataFrame:
    """(group, tables): pickled search tables of groups of at most about ``group_bytes`` of text, made in tasks and written once."""
    kept = items.select(F.col(item_id).cast("string").alias("item"), F.col(text).alias("text"))

    def build(batches):
        group, size, made = [], 0, 0

        def row():
            at = TaskContext.get().partitionId() << 32 | made
            return pa.RecordBatch.from_pydict({"group": pa.array([at], pa.int64()), "tables": pa.array([pickle.dumps([vars(t) for t in tables_of(group, n)])], pa.binary())})

        for batch in batches:
            for item, value in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist()):
                need = len((value or "").encode())
                if group and size + need > group_bytes:
                    yield row()
                    group, size, made = [], 0, made + 1
                group.append((item, value))
                size += need
        if group:
            yield row()

    return cut_lineage(kept.mapInArrow(build, "group long, tables binary"))


def broadcasts(items: DataFrame, item_id, text, group_bytes, n):
    """The groups' tables, shared with the tasks one after another; the driver holds one group at a time."""
    tables = group_tables(items, item_id, text, group_bytes, n)
    sc = items.sparkSession.sparkContext
    for group in sorted(r["group"] for r in tables.select("group").collect()):
        yield sc.broadcast(bytes(tables.filter(F.col("group") == group).first()["tables"]))


class Loaded:
    """Unpickles a group's tables once in a task."""

    def __init__(self, shared):
        self.shared, self.tables = shared, None

    def __call__(self):
        if self.tables is None:
            self.tables = [Tables.of(state) for state in pickle.loads(self.shared.value)] if self.shared is not None else []
        return self.tables


def decontaminate(docs: DataFrame, items: DataFrame, n=10, id_col="doc_id", text_col="text", item_id="item_id",
                  item_text="text", group_bytes=8 << 20) -> DataFrame:
    """One row per document: id, n_words, n_hit, n_items, items (ids as sorted strings), hits (word ranges)."""
    df = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    groups = list(broadcasts(items, item_id, item_text, group_bytes, n)) or [None]
    for k, group in enumerate(groups):
        start, end = k == 0, k == len(groups) - 1

        def search(batches, group=group, start=start, end=end):
            tables = Loaded(group)
            for batch in batches:
                words, ranges, found = scan(batch.column("text"), tables())
                if not start:
                    ranges = [merged(a, b) for a, b in zip(batch.column("hits").to_pylist(), ranges)]
                    found = [sorted({*a, *b}) for a, b in zip(batch.column("items").to_pylist(), found)]
                cols = {"id": batch.column("id")} | ({} if end else {"text": batch.column("text")})
                cols |= {"n_words": pa.array(words, pa.int64()), "hits": pa.array(ranges, pa.list_(pa.int32())),
                         "items": pa.array(found, pa.list_(pa.string()))}
                yield pa.RecordBatch.from_pydict(cols)

        kind = docs.schema[id_col].dataType.simpleString()
        df = df.mapInArrow(search, f"id {kind}," + ("" if end else "text string,") + "n_words long, hits array<int>, items array<string>")
    covered = F.aggregate(
        F.sequence(F.lit(0), F.size("hits") - 2, F.lit(2)), F.lit(0).cast("long"),
        lambda s, i: s + F.element_at("hits", i + 2) - F.element_at("hits", i + 1),
    )
    return df.select(
        F.col("id").alias(id_col), "n_words", F.when(F.size("hits") > 0, covered).otherwise(F.lit(0).cast("long")).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"), "items", "hits",
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, n=10, text_col="text", item_id="item_id", item_text="text",
                      group_bytes=8 << 20) -> DataFrame:
    """The documents without any test string, all columns as they are."""
    df = docs
    for group in broadcasts(items, item_id, item_text, group_bytes, n):

        def clean(batches, group=group):
            tables = Loaded(group)
            for batch in batches:
                _, ranges, _ = scan(batch.column(batch.schema.get_field_index(text_col)), tables())
                yield batch.filter(pa.array([not r for r in ranges], pa.bool_()))

        df = df.mapInArrow(clean, docs.schema)
    return df
