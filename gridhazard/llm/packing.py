"""Packing: order-preserving dynamic programming over cuts at document and sentence ends.

Documents are tokenised whole and kept in the order in which they are read. A sequence holds the tokens between
two cuts; cuts may fall at document ends (free), at sentence ends, and at other tokens, each at a price in
tokens, and each sequence has a small price too, which keeps sequences long. The cost of a packing is its
padding plus these prices. The least cost up to cut j is a minimum
over the cuts i within one sequence before j of cost(i) + padding; as padding falls with the distance alone,
the minimum slides along and a monotone queue finds it in constant time. A sequence whose length is a power of
two needs no padding, which adds one transition for each power.

Tasks pack their input partition in blocks of bounded tokens; the last sequence of a block is carried into
the next one, and only a partition's end is packed as it is. Nothing is shuffled, and a repeated task makes
the same sequences. Sequence ids hold the partition in the upper bits and count up within it, without gaps.

Null and empty texts are the end token alone. Repeated rows are packed once each. A null id stays null.
An empty table gives no pieces. Extra columns are not read.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridhazard.llm.bytescan import CHUNK_BYTES, SpanHasher, byte_class, text_chunks, word_spans, words_of_rows

LENGTH = 2048
SENTENCE_PRICE, TOKEN_PRICE, SEQUENCE_PRICE = 4, 24, 16
BLOCK_TOKENS = 1 << 17
#: Between other cuts, one at every so many tokens.
STRIDE = 32
KNOWN_WORDS = 1 << 20
PIECE = byte_class([(0x09, 0x0D), (0x20, 0x20)], inside=False)
ASCII_LETTER = byte_class([(0x41, 0x5A), (0x61, 0x7A)])
#: ASCII marks between which and a letter every tokenizer word ends; an apostrophe may begin one.
ASCII_MARK = byte_class([(0x21, 0x26), (0x28, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E)])
SENTENCE_ENDS = tuple(mark + "</w>" for mark in (".", "!", "?", "...", "!!", "!!!", "?!"))


def load(path):
    """(tokenizer, ids that end a word, ids that end a sentence) of a file, kept in the worker between tasks.

    The cores of an executor have a task each, so the tokenizer runs in the task's own thread: a pool of threads in every
    worker keeps memory of its own for each of them.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import tokenizers

    kept = tokenizers.__dict__.setdefault("_kept_by_path", {})
    if path not in kept:
        tok = tokenizers.Tokenizer.from_file(path)
        vocab = tok.get_vocab()
        ends = np.zeros(max(vocab.values()) + 1, bool)
        ends[[i for w, i in vocab.items() if w.endswith("</w>")]] = True
        stops = np.array(sorted(vocab[w] for w in SENTENCE_ENDS if w in vocab), np.uint32)
        special = tuple(t.content.encode() for t in tok.get_added_tokens_decoder().values())
        kept[path] = {"tok": tok, "ends": ends, "stops": stops, "special": special, "hash": np.zeros(0, np.uint64),
                      "at": np.zeros(0, np.int64), "size": np.zeros(0, np.int64), "ids": np.zeros(0, np.uint32)}
    return kept[path]


def encode_words(held, words):
    """Ids of each of the given byte strings. Plain words go to the tokenizer many at a time."""
    tok, ends = held["tok"], held["ends"]
    out: list = [None] * len(words)
    texts = [w.decode("utf-8", "replace") for w in words]
    plain = [k for k, t in enumerate(texts) if t.isalpha() and t.lower().isalpha() and unicodedata.is_normalized("NFC", t)]
    others = sorted(set(range(len(texts))) - set(plain))
    runs = [plain[k:k + 500] for k in range(0, len(plain), 500)]
    for run, coded in zip(runs, tok.encode_batch_fast([" ".join(texts[k] for k in run) for run in runs], add_special_tokens=False)):
        ids = np.array(coded.ids, np.uint32)
        stop = np.flatnonzero(ends[ids]) + 1
        if len(stop) != len(run):  # not one word each after all
            others += run
            continue
        begin = 0
        for k, end in zip(run, stop.tolist()):
            out[k] = ids[begin:end]
            begin = end
    for k, coded in zip(others, tok.encode_batch_fast([texts[k] for k in others], add_special_tokens=False)):
        out[k] = np.array(coded.ids, np.uint32)
    return out


def known_places(held, data, hashes, starts, ends):
    """Place of each word among the worker's known words; unknown ones are encoded first."""
    unique, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    if len(held["hash"]) > KNOWN_WORDS:
        held.update(hash=np.zeros(0, np.uint64), at=np.zeros(0, np.int64), size=np.zeros(0, np.int64), ids=np.zeros(0, np.uint32))
    place = np.searchsorted(held["hash"], unique)
    new = np.ones(len(unique), bool)
    inside = place < len(held["hash"])
    new[inside] = held["hash"][place[inside]] != unique[inside]
    if new.any():
        raw, first = data.tobytes(), first[new]
        coded = encode_words(held, [raw[a:z] for a, z in zip(starts[first].tolist(), ends[first].tolist())])
        size = np.array([len(c) for c in coded], np.int64)
        at = len(held["ids"]) + np.cumsum(size) - size
        where = place[new]
        held.update(
            hash=np.insert(held["hash"], where, unique[new]), at=np.insert(held["at"], where, at), size=np.insert(held["size"], where, size),
            ids=np.concatenate([held["ids"], *coded]).astype(np.uint32, copy=False))
        place = np.searchsorted(held["hash"], unique)
    return place[inverse]


def gather(held, places):
    """Ids and counts of known words, in order."""
    start, size = held["at"][places], held["size"][places]
    total = np.cumsum(size)
    index = np.repeat(start - (total - size), size) + np.arange(total[-1] if len(total) else 0)
    return held["ids"][index], size


def token_rows(column, held, end_id, chunk_bytes=CHUNK_BYTES):
    """Token ids of each text with the end token, in order.

    A tokenizer word never holds white space, nor a letter beside a mark, so a text's ids are those of its parts
    between such borders. A chunk with a special token's text in it is encoded text by text instead.
    """
    for row, data, offs in text_chunks(column, chunk_bytes):
        raw = data.tobytes()
        if any(s in raw for s in held["special"]):
            texts = [raw[a:z].decode("utf-8", "replace") for a, z in zip(offs[:-1].tolist(), offs[1:].tolist())]
            for coded in held["tok"].encode_batch_fast(texts, add_special_tokens=False):
                yield np.array([*coded.ids, end_id], np.uint32)
            continue
        starts, ends = word_spans(data, offs, PIECE)
        letter, mark = ASCII_LETTER[data], ASCII_MARK[data]
        cut = np.flatnonzero((letter[:-1] & mark[1:]) | (mark[:-1] & letter[1:])) + 1 if len(data) else np.zeros(0, np.int64)
        heads, tails = np.zeros(len(data) + 1, bool), np.zeros(len(data) + 1, bool)
        heads[starts] = tails[ends] = True
        cut = cut[~heads[cut]]  # a border of a text is one already
        heads[cut] = tails[cut] = True
        starts, ends = np.flatnonzero(heads), np.flatnonzero(tails)
        places = known_places(held, data, SpanHasher(data)(starts, ends), starts, ends)
        ids, size = gather(held, places)
        edge = np.concatenate([[0], np.cumsum(size)])[words_of_rows(starts, offs)]
        for a, z in zip(edge[:-1].tolist(), edge[1:].tolist()):
            yield np.append(ids[a:z], np.uint32(end_id))


def cut_places(ids, doc_ends, stops, length, fine_from):
    """Places where a sequence may end, in order, and the price of each."""
    n = len(ids)
    price = np.full(n + 1, -1, np.int64)
    price[STRIDE::STRIDE] = TOKEN_PRICE
    price[fine_from:] = TOKEN_PRICE
    price[np.flatnonzero(np.isin(ids, stops)) + 1] = SENTENCE_PRICE
    price[doc_ends] = 0
    price[0] = price[n] = 0
    places = np.flatnonzero(price >= 0)
    return places, price[places]


def best_cuts(places, prices, length):
    """Ends of the sequences of least padding plus prices, with a monotone queue over the last ``length`` tokens."""
    index = np.full(int(places[-1]) + 1, -1, np.int64)
    index[places] = np.arange(len(places))
    powers = places[:, None] - np.array([1 << k for k in range(length.bit_length()) if 1 << k < length])
    exact = np.where(powers >= 0, index[np.maximum(powers, 0)], -1)  # cuts a power of two before
    row, column = np.nonzero(exact >= 0)
    begin = np.searchsorted(row, np.arange(len(places) + 1)).tolist()
    source_of, at, price = exact[row, column].tolist(), places.tolist(), (prices + SEQUENCE_PRICE).tolist()
    cost, back = [0] * len(at), [0] * len(at)
    queue: deque[tuple[int, int, int]] = deque([(0, 0, 0)])  # (cost + place, place, index): ascending in cost + place
    for j in range(1, len(at)):
        end = at[j]
        first = end - length
        while queue[0][1] < first:
            queue.popleft()
        key, _, source = queue[0]
        best = key - first
        for i in source_of[begin[j]:begin[j + 1]]:
            if cost[i] < best:
                best, source = cost[i], i
        best += price[j]
        cost[j], back[j] = best, source
        key = best + end
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, end, j))
    cuts, j = [], len(at) - 1
    while j:
        cuts.append(at[j])
        j = back[j]
    return cuts[::-1]


def pack_partition(batches, path, end_id, length, chunk_bytes=CHUNK_BYTES):
    held, part = load(path), TaskContext.get().partitionId()
    sequence = part << 40
    waiting: list[tuple[object, np.ndarray, int, int]] = []  # (id, ids, first token left, tokens in the document)

    def flush(last):
        nonlocal waiting, sequence
        parts = [ids[start:] for _, ids, start, _ in waiting]
        ids = np.concatenate(parts)
        doc_ends = np.cumsum([len(p) for p in parts])
        cuts = best_cuts(*cut_places(ids, doc_ends, held["stops"], length, len(ids) - 2 * length if last and len(ids) > 2 * length else 0 if last else len(ids)), length)
        if not last:
            cuts = cuts[:-1]  # the last sequence goes on with the next block
        rows = {k: [] for k in ("id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")}
        doc, doc_start = 0, 0
        begin = 0
        for cut in cuts:
            here = begin
            while here < cut:
                key, own, first, total = waiting[doc]
                stop = min(cut, int(doc_ends[doc]))
                a = first + here - doc_start
                piece = own[a:a + stop - here]
                for name, value in zip(rows, (key, a, len(piece), zlib.crc32(piece.astype("<u4").tobytes()), total, sequence, here - begin)):
                    rows[name].append(value)
                here = stop
                if stop == doc_ends[doc]:
                    doc, doc_start = doc + 1, stop
            sequence, begin = sequence + 1, cut
        left = waiting[doc:]
        if left and begin > doc_start:
            key, own, first, total = left[0]
            left[0] = (key, own, first + begin - doc_start, total)
        waiting = left
        return rows

    def batch_of(rows, id_type):
        return pa.RecordBatch.from_arrays(
            [pa.array(rows["id"], id_type), *(pa.array(rows[k], pa.int64()) for k in list(rows)[1:])], list(rows))

    size, id_type = 0, None
    for batch in batches:
        id_type = batch.schema.field("id").type
        for key, ids in zip(batch.column("id").to_pylist(), token_rows(batch.column("text"), held, end_id, chunk_bytes)):
            waiting.append((key, ids, 0, len(ids)))
            size += len(ids)
            if size >= BLOCK_TOKENS:
                yield batch_of(flush(False), id_type)
                size = sum(len(ids) - start for _, ids, start, _ in waiting)
    if waiting:
        yield batch_of(flush(True), id_type)


def pack(docs: DataFrame, tokenizer_path: str, id_col="doc_id", text_col="text", end_id=1, length=LENGTH, chunk_bytes=CHUNK_BYTES) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Tokenising takes some 80 bytes of memory for each byte of a chunk of ``chunk_bytes``; the rows do not depend on it.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    out = rows.mapInArrow(
        lambda batches: pack_partition(batches, tokenizer_path, end_id, length, chunk_bytes),
        f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return out.withColumnRenamed("id", id_col)
