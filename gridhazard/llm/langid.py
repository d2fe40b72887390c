"""Language identification: multinomial naive Bayes over hashed character n-grams.

Tasks count hashed n-grams of their learning rows by language; the counts are summed by Spark. What the driver
gathers at once is at most ``DIMS`` counts for each language of a block of ``LANGUAGES``, turned into a matrix of
log probabilities and broadcast. Each text is scored whole, as the product of its sparse n-gram counts with
that matrix. More languages are more blocks: the texts are written with the best language so far and the sum of likelihoods
relative to it, and the next block goes on from there, so there is no limit to their number.

A text that is null or has no letter is ``und`` with score 0. Rows with a null language or text are not learnt
from. Without anything to learn from, every text is ``und``. Ties go to the least language name. Repeated rows
count once each. Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridhazard.llm.bytescan import byte_class, text_chunks
from gridhazard.session import cut_lineage

DIMS = 1 << 16
ORDERS = (2, 3)
LANGUAGES = 64
LETTER = byte_class([(0x41, 0x5A), (0x61, 0x7A)])
#: Code points below U+0250 in lower case, ASCII characters that are no letters as a space.
FOLD = np.array([ord(chr(i).lower()) if len(chr(i).lower()) == 1 else i for i in range(0x250)], np.uint32)
FOLD[[i for i in range(128) if not chr(i).isalpha()]] = 32


def code_points(data, offs):
    """Folded code points of a chunk, and the offsets of its rows among them."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    before = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    low = points < len(FOLD)
    out = points.copy()
    out[low] = FOLD[points[low]]
    return out, before[offs]


def gram_slots(points, order):
    """Hash slot of the n-gram that starts at each code point but the last ``order - 1``."""
    n = len(points) - order + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    h = np.full(n, order * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
    for k in range(order):
        h = (h ^ points[k:k + n]) * np.uint32(0x01000193)
        h = h ^ (h >> np.uint32(15))
    return (h * np.uint32(0x85EBCA6B) >> np.uint32(16)).astype(np.int64)


def count_grams(batches):
    """(language, slot, count) of a partition's rows of (text, lang)."""
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), dtype=object)
        for row, data, offs in text_chunks(batch.column("text")):
            points, at = code_points(data, offs)
            sizes = np.diff(at)
            names, index = np.unique(langs[row:row + len(sizes)].astype(str), return_inverse=True)
            owner = np.repeat(index, sizes)
            left = np.repeat(at[1:], sizes) - np.arange(len(points))
            for order in ORDERS:
                slots = gram_slots(points, order)
                inside = left[:len(slots)] >= order
                got = np.bincount((owner[:len(slots)] * DIMS + slots)[inside], minlength=len(names) * DIMS).reshape(-1, DIMS)
                for name, part in zip(names, got):
                    counts[name] = counts[name] + part if name in counts else part
    for name, part in counts.items():
        slots = np.flatnonzero(part)
        yield pa.RecordBatch.from_pydict({
            "lang": pa.array([name] * len(slots), pa.string()), "slot": pa.array(slots, pa.int32()), "n": pa.array(part[slots], pa.int64()),
        })


def fit(kept: DataFrame, langs, alpha=0.5):
    """DIMS x languages log probabilities of the given languages from rows of (text, lang)."""
    rows = kept.filter(F.col("lang").isin(langs))
    counted = rows.mapInArrow(count_grams, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    place = F.array_position(F.array(*[F.lit(name) for name in langs]), F.col("lang")) - 1
    counted = counted.select(place.cast("int").alias("place"), "slot", "n").toArrow()
    counts = np.zeros((DIMS, len(langs)))
    counts[np.asarray(counted["slot"]), np.asarray(counted["place"])] = np.asarray(counted["n"])
    counts += alpha
    return np.log(counts) - np.log(counts.sum(axis=0, keepdims=True))


def score_texts(column, table):
    """Log-likelihood of each text under each language of a block."""
    out = []
    for row, data, offs in text_chunks(column):
        points, at = code_points(data, offs)
        total = np.zeros((len(at) - 1, len(table)))
        for order in ORDERS:
            slots = gram_slots(points, order)
            stop = np.minimum(np.maximum(at[1:] - order + 1, at[:-1]), len(slots))
            start = np.minimum(at[:-1], len(slots))
            for k in range(len(table)):
                sums = np.concatenate([[0.0], np.cumsum(table[k][slots])])
                total[:, k] += sums[stop] - sums[start]
        out.append(total)
    return np.concatenate(out) if out else np.zeros((0, len(table)))


def has_letter(column):
    """Whether each text has a letter."""
    out = []
    for row, data, offs in text_chunks(column):
        letters = np.concatenate([[0], np.cumsum(LETTER[data])])
        plain = letters[offs[1:]] > letters[offs[:-1]]
        out += [p or any(c.isalpha() for c in column[row + i].as_py() or "") for i, p in enumerate(plain.tolist())]
    return np.array(out, bool)


def identify(docs: DataFrame, learn, id_col="doc_id", text_col="text", lang_col="lang", block=LANGUAGES) -> DataFrame:
    """One row per document: id, learn (the condition), lang_pred, score. Learns from the rows where ``learn`` holds.

    Languages are scored ``block`` at a time, each block in a pass over the texts that keeps the best so far and the sum
    of all likelihoods relative to it.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"), learn.alias("learn"))
    kept = rows.filter("learn and lang is not null and text is not null").select("text", "lang")
    langs = sorted(r["lang"] for r in kept.select("lang").distinct().collect())
    kind = docs.schema[id_col].dataType.simpleString()
    state = "best string, top double, rest double"
    passes = [langs[k:k + block] for k in range(0, len(langs), block)]
    scored = rows.select("id", "learn", "text", F.lit("und").alias("best"), F.lit(float("-inf")).alias("top"), F.lit(0.0).alias("rest"))
    for turn, names in enumerate(passes):
        shared = docs.sparkSession.sparkContext.broadcast((names, np.ascontiguousarray(fit(kept, names).T)))

        def score(batches, shared=shared):
            names, table = shared.value
            for batch in batches:
                total = score_texts(batch.column("text"), table)
                at = total.argmax(axis=1)
                top = total[np.arange(len(at)), at]
                rest = np.exp(total - top[:, None]).sum(axis=1)
                old_top, old_rest = np.asarray(batch.column("top")), np.asarray(batch.column("rest"))
                best = np.where(top > old_top, np.array(names, object)[at], np.array(batch.column("best").to_pylist(), object))
                most = np.maximum(top, old_top)
                rest = rest * np.exp(top - most) + old_rest * np.exp(old_top - most)
                columns = [batch.column(c) for c in ("id", "learn", "text")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(best, pa.string()), pa.array(most, pa.float64()), pa.array(rest, pa.float64())],
                                                 ["id", "learn", "text", "best", "top", "rest"])

        scored = scored.mapInArrow(score, f"id {kind}, learn boolean, text string, {state}")
        if turn < len(passes) - 1:
            scored = cut_lineage(scored)

    def tell(batches):
        for batch in batches:
            known, rest = has_letter(batch.column("text")), np.asarray(batch.column("rest"))
            known &= rest > 0
            names = np.where(known, np.array(batch.column("best").to_pylist(), object), "und")
            scores = np.where(known, 1.0 / np.maximum(rest, 1.0), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("learn"), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                                             ["id", "learn", "lang_pred", "score"])

    out = scored.mapInArrow(tell, f"id {kind}, learn boolean, lang_pred string, score double")
    return out.withColumnRenamed("id", id_col)
