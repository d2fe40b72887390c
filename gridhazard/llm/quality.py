"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration.

One pass over whole texts takes ``len(STATS)`` statistics of each document; they are written once and both
fitting and scoring read them. A Gaussian kernel on the standardised statistics is approximated by cosines of
random projections. Tasks sum the normal equations of their labelled rows, the sums are added, and the ridge
weights solve them. Scores of a fold that the weights have not seen are calibrated by pool-adjacent-violators,
interpolated between block centres, so scores lie in 0 to 1 and keep their order.

Fitting takes at most about ``max_labelled`` labelled rows, chosen by a hash of the statistics and id; all else
covers every row. Null and empty texts have zero statistics and a score like any other. Labels that are null,
or whose id is null or unknown, teach nothing; of repeated labels of an id the largest counts. Without labels of
both kinds every score is their mean, or 0.5 without any. Repeated rows get equal scores. Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridhazard.llm.bytescan import ASCII_LOWER, byte_class, span_hashes, text_chunks, word_spans, words_of_rows
from gridhazard.llm.common import draw
from gridhazard.session import cut_lineage

SPACE = [(0x09, 0x0D), (0x20, 0x20)]
NOT_SPACE = byte_class(SPACE, inside=False)
LINE = byte_class([(0x0A, 0x0A), (0x0D, 0x0D)], inside=False)
#: Shares of the text's bytes: upper case, lower case, digits, beyond ASCII, and marks of different use.
SHARES = tuple(byte_class(r) for r in (
    [(0x41, 0x5A)], [(0x61, 0x7A)], [(0x30, 0x39)], [(0x80, 0xFF)], SPACE, [(0x21, 0x21)], [(0x3F, 0x3F)], [(0x2C, 0x2C)], [(0x2E, 0x2E)],
    [(0x23, 0x26), (0x2A, 0x2A)], [(0x7C, 0x7C)], [(0x22, 0x22), (0x27, 0x29)], [(0x2F, 0x2F), (0x3A, 0x3A), (0x3D, 0x3D), (0x40, 0x40)], [(0x5B, 0x60), (0x7B, 0x7B), (0x7D, 0x7F)],
))
STATS = 24
FEATURES = 512


def row_sums(values, offs):
    sums = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
    return sums[offs[1:]] - sums[offs[:-1]]


def distinct_share(hashes, first):
    """Distinct hashes of each row over its hashes; 0 where it has none."""
    return np.array([len(np.unique(hashes[a:z])) / (z - a) if z > a else 0.0 for a, z in zip(first[:-1].tolist(), first[1:].tolist())])


def statistics(column) -> np.ndarray:
    """Rows x STATS of a text column."""
    out = []
    for _, data, offs in text_chunks(column):
        size = np.diff(offs).astype(float)
        starts, ends = word_spans(data, offs, NOT_SPACE)
        first = words_of_rows(starts, offs)
        words = span_hashes(data, starts, ends, ASCII_LOWER)
        n = np.diff(first).astype(float)
        length = (ends - starts).astype(float)
        per_word = np.maximum(n, 1)
        mean = row_sums(length, first) / per_word
        spread = np.sqrt(np.maximum(row_sums(length ** 2, first) / per_word - mean ** 2, 0))
        again = np.zeros(len(words))
        again[1:] = words[1:] == words[:-1]
        again[first[:-1][first[:-1] < len(words)]] = 0
        capital = (data[starts] >= 0x41) & (data[starts] <= 0x5A) if len(starts) else np.zeros(0)
        l_starts, l_ends = word_spans(data, offs, LINE)
        l_first = words_of_rows(l_starts, offs)
        lines = span_hashes(data, l_starts, l_ends)
        n_lines = np.diff(l_first).astype(float)
        out.append(np.column_stack([
            *(row_sums(share[data], offs) / np.maximum(size, 1) for share in SHARES),
            np.log1p(size), np.log1p(n), mean, spread, distinct_share(words, first), row_sums(again, first) / per_word,
            row_sums(capital, first) / per_word, np.log1p(n_lines), distinct_share(lines, l_first), n / np.maximum(n_lines, 1) / 100,
        ]))
    return np.concatenate(out) if out else np.zeros((0, STATS))


def with_statistics(docs: DataFrame, id_col, text_col, *extra) -> DataFrame:
    """(id, extra columns, stats array<double>) of every document."""
    rows = docs.select(F.col(id_col).alias("id"), *extra, F.col(text_col).alias("text"))
    keep = [f for f in rows.schema.fields if f.name != "text"]

    def measure(batches):
        for batch in batches:
            stats = statistics(batch.column("text"))
            flat = pa.array(stats.ravel(), pa.float64())
            ends = pa.array(np.arange(len(stats) + 1) * STATS, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(f.name) for f in keep), pa.ListArray.from_arrays(ends, flat)], [*(f.name for f in keep), "stats"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keep)
    return rows.mapInArrow(measure, f"{kinds}, stats array<double>")


def fourier(stats, centre, scale, turns, phase):
    """Random Fourier features, with a constant."""
    z = np.sqrt(2.0 / len(phase)) * np.cos(((stats - centre) / scale) @ turns + phase)
    return np.column_stack([z, np.ones(len(z))])


def pool_adjacent(scores, labels, weight=1.0):
    """Isotonic fit: centres and values of the blocks of pool-adjacent-violators."""
    order = np.argsort(scores, kind="stable")
    blocks: list[list[float]] = []  # [sum of labels, count, sum of scores]
    for s, y in zip(scores[order].tolist(), labels[order].tolist()):
        blocks.append([y, weight, s * weight])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            top = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], top)]
    # half a row of either label keeps values inside 0 and 1
    return np.array([b[2] / b[1] for b in blocks]), np.array([(b[0] + 0.5 * weight) / (b[1] + weight) for b in blocks])


def stack(column) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, STATS)


class Model:
    def __init__(self, centre, scale, turns, phase, weights, knots, values):
        self.centre, self.scale, self.turns, self.phase, self.weights, self.knots, self.values = centre, scale, turns, phase, weights, knots, values

    def score(self, stats):
        if self.weights is None:
            return np.full(len(stats), self.values[0])
        raw = fourier(stats, self.centre, self.scale, self.turns, self.phase) @ self.weights
        return np.clip(np.interp(raw, self.knots, self.values), 0.0, 1.0)


def fit(rows: DataFrame, max_labelled, ridge=1.0, width=5.0, seed=17) -> Model:
    """Weights from rows of (id, stats, label)."""
    n = rows.count()
    pick = F.xxhash64("id", "stats")
    kept = rows.withColumn("pick", pick)
    if n > max_labelled:
        kept = kept.filter(draw("pick") < max_labelled / n)
    kept = cut_lineage(kept.select("stats", F.col("label").cast("double").alias("label"), (F.pmod(F.col("pick").bitwiseXOR(F.lit(0x5BD1E995)), F.lit(4)) == 0).alias("aside")))
    spark = rows.sparkSession

    def moments(batches):
        n, y, a, b = 0, 0.0, np.zeros(STATS), np.zeros(STATS)
        for batch in batches:
            s = stack(batch.column("stats"))
            n, y = n + len(s), y + float(np.asarray(batch.column("label")).sum())
            a, b = a + s.sum(axis=0), b + (s ** 2).sum(axis=0)
        yield pa.RecordBatch.from_pydict({"n": [n], "y": [y], "a": [a.tolist()], "b": [b.tolist()]})

    parts = kept.coalesce(8).mapInArrow(moments, "n long, y double, a array<double>, b array<double>").toPandas()
    total = int(parts["n"].sum()) if len(parts) else 0
    positive = float(parts["y"].sum()) if len(parts) else 0.0
    if total == 0 or positive in (0.0, float(total)):
        return Model(None, None, None, None, None, None, np.array([positive / total if total else 0.5]))
    centre = np.sum(parts["a"].tolist(), axis=0) / total
    scale = np.sqrt(np.maximum(np.sum(parts["b"].tolist(), axis=0) / total - centre ** 2, 1e-12)) + 1e-6
    rng = np.random.default_rng(seed)
    turns, phase = rng.normal(size=(STATS, FEATURES)) / width, rng.uniform(0, 2 * np.pi, FEATURES)
    shared = spark.sparkContext.broadcast((centre, scale, turns, phase))

    def normal_equations(batches):
        gram, right = np.zeros((FEATURES + 1, FEATURES + 1)), np.zeros(FEATURES + 1)
        for batch in batches:
            use = ~np.asarray(batch.column("aside").to_pylist(), dtype=bool)
            z = fourier(stack(batch.column("stats"))[use], *shared.value)
            gram += z.T @ z
            right += z.T @ np.asarray(batch.column("label"))[use]
        yield pa.RecordBatch.from_pydict({"gram": pa.array([gram.tobytes()], pa.binary()), "right": pa.array([right.tobytes()], pa.binary())})

    # the sample is bounded, so are its partitions and the sums that reach the driver
    summed = kept.coalesce(8).mapInArrow(normal_equations, "gram binary, right binary").collect()
    gram = sum(np.frombuffer(r.gram).reshape(FEATURES + 1, -1) for r in summed)
    right = sum(np.frombuffer(r.right) for r in summed)
    weights = np.linalg.solve(gram + ridge * np.eye(FEATURES + 1), right)
    aside = kept.filter("aside").select("stats", "label").toPandas()
    if len(aside):
        raw = fourier(np.array(aside["stats"].tolist()), centre, scale, turns, phase) @ weights
        knots, values = pool_adjacent(raw, aside["label"].to_numpy())
    else:
        knots, values = np.array([0.0, 1.0]), np.array([0.0, 1.0])
    return Model(centre, scale, turns, phase, weights, knots, values)


def score_quality(docs: DataFrame, labels: DataFrame, learn, id_col="doc_id", text_col="text", label_id="doc_id", label_col="quality",
                  max_labelled=40_000) -> DataFrame:
    """One row per document: id, learn (the condition), score. Learns labels only from rows where ``learn`` holds."""
    rows = cut_lineage(with_statistics(docs, id_col, text_col, learn.alias("learn")))
    known = labels.select(F.col(label_id).alias("id"), F.col(label_col).alias("label")).dropna().groupBy("id").agg(F.max("label").alias("label"))
    model = fit(rows.filter("learn").join(known, "id"), max_labelled)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({
                "id": batch.column("id"), "learn": batch.column("learn"), "score": pa.array(shared.value.score(stack(batch.column("stats"))), pa.float64())})

    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(score, f"id {kind}, learn boolean, score double").withColumnRenamed("id", id_col)
