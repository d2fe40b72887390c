"""BPE encoding and decoding through an index of pair occurrences.

Texts are cut at blanks; normalising and cutting a piece into byte-level words is left to the tokenizer file's own rules. The new
words of a batch stand behind one another as a linked list of symbols, and an index maps the rank of every pair that can be
merged to all positions where it occurs. Active ranks are taken in ascending order from a heap: all positions of a rank are
merged at once, from left to right where they overlap, and only the lists of the pairs beside them grow. A position whose pair
has changed meanwhile is passed over when its rank comes up. If a merge could make a pair of a lower rank than its own, a
word merges one pair at a time.

A partition keeps the ids of the pieces it has met, at most ``KNOWN_PIECES``, so a piece is encoded about once; nothing
is shuffled and a repeated task gives the same ids. Special tokens in a text are their own ids. Ids are little-endian
unsigned 32-bit integers in a binary column.

A null text is encoded as an empty one: no ids. Decoding joins the ids' tokens with blanks, as a tokenizer without a decoder
does, skips ids that the vocabulary lacks, and decodes null or no ids as the empty text. Bytes that are not UTF-8 read as
the replacement character. Repeated rows, null ids of rows and further columns stay as they are.
"""

from __future__ import annotations

import heapq
import json
import re
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

KNOWN_PIECES = 1 << 19


def byte_letters():
    """The letters that stand for bytes in byte-level vocabularies: printable ones for themselves, others from 256 on."""
    printable = [b for lo, hi in ((0x21, 0x7E), (0xA1, 0xAC), (0xAE, 0xFF)) for b in range(lo, hi + 1)]
    others = [b for b in range(256) if b not in set(printable)]
    return {**{b: chr(b) for b in printable}, **{b: chr(256 + k) for k, b in enumerate(others)}}


def token_names(path):
    """Token of each id of a tokenizer file."""
    with open(path, encoding="utf-8") as file:
        told = json.load(file)
    return {i: token for token, i in [*told["model"]["vocab"].items(), *((t["content"], t["id"]) for t in told["added_tokens"])]}


class Numbering(dict):
    """Numbers new keys in the order in which they come."""

    def __missing__(self, key):
        self[key] = number = len(self)
        return number


class WordBPE:
    """Merges and vocabulary of a tokenizer file whose words are byte-level with a suffix at their ends."""

    def __init__(self, path):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        model = told["model"]
        if model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")):
            raise ValueError("a BPE model without dropout, unknown token, prefix or byte fallback is needed")
        if told["post_processor"] or told["decoder"]:
            raise ValueError("a tokenizer without post-processor and decoder is needed")
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in told["added_tokens"]):
            raise ValueError("added tokens are found in the text as it is")
        tok = Tokenizer.from_file(path)
        self.normalise, self.cut = tok.normalizer.normalize_str, tok.pre_tokenizer.pre_tokenize_str
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in told["added_tokens"]}
        self.names = {i: token for token, i in [*vocab.items(), *self.special.items()]}
        self.any_special = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        letters = byte_letters().values()
        self.inner = np.full(512, -1, np.int64)
        self.last = np.full(512, -1, np.int64)
        for letter in letters:
            self.inner[ord(letter)], self.last[ord(letter)] = vocab[letter], vocab[letter + suffix]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.left = np.array([vocab[a] for a, _ in merges], np.int64)
        self.right = np.array([vocab[b] for _, b in merges], np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.width = max(self.names) + 1
        keys = self.left * self.width + self.right
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        least = np.full(self.width, len(merges))  # of the pairs that a token is part of
        np.minimum.at(least, self.left, np.arange(len(merges)))
        np.minimum.at(least, self.right, np.arange(len(merges)))
        self.ascending = bool((least[self.made] > np.arange(len(merges))).all())

    def ranks(self, a, b):
        """Rank of each pair of symbols, -1 where it cannot be merged. Symbol -1 is none."""
        key = a * self.width + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.order[at], -1) if len(self.keys) else np.full(len(a), -1)

    def merge(self, sym, starts, ends):
        """Symbols after all merges, -1 where one is gone. Words are the runs from starts to ends (exclusive)."""
        n = len(sym)
        sym = np.append(sym, -1)  # beyond any word
        following, before = np.arange(1, n + 2), np.arange(-1, n)
        following[ends - 1], before[starts] = n, n
        word = None if self.ascending else np.repeat(np.arange(len(starts)), ends - starts)
        positions: dict[int, list] = {}
        active: list[int] = []

        def enter(at):
            rank = self.ranks(sym[at], sym[following[at]])
            at, rank = at[rank >= 0], rank[rank >= 0]
            if not len(at):
                return
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cuts = np.flatnonzero(np.diff(rank)) + 1
            bounds = [0, *cuts.tolist(), len(at)]
            for r, lo, hi in zip(rank[bounds[:-1]].tolist(), bounds, bounds[1:]):
                held = positions.get(r)
                if held is None:
                    positions[r] = [at[lo:hi]]
                    heapq.heappush(active, r)
                else:
                    held.append(at[lo:hi])

        enter(np.arange(n))
        while active:
            r = heapq.heappop(active)
            held = positions.pop(r)
            at = held[0] if len(held) == 1 else np.unique(np.concatenate(held))
            a, b = self.left[r], self.right[r]
            at = at[(sym[at] == a) & (sym[following[at]] == b)]
            if a == b and len(at) > 1:  # every other one of a run that overlaps
                chained = np.append(False, following[at[:-1]] == at[1:])
                place = np.arange(len(at))
                at = at[(place - np.maximum.accumulate(np.where(chained, 0, place))) % 2 == 0]
            if word is not None and len(at):
                first = np.append(True, np.diff(word[at]) > 0)
                if not first.all():
                    positions[r] = [at[~first]]
                    heapq.heappush(active, r)
                at = at[first]
            if not len(at):
                continue
            gone = following[at]
            beyond = following[gone]
            sym[at], sym[gone] = self.made[r], -1
            following[at], before[beyond] = beyond, at
            beside = np.concatenate([before[at], at])
            enter(np.unique(beside[beside < n]))
        return sym[:n]

    def words(self, words):
        """(ids of all words one after another, number of ids of each)."""
        if not words:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        starts = np.append(0, ends[:-1])
        sym = self.inner[letters]
        sym[ends - 1] = self.last[letters[ends - 1]]
        sym = self.merge(sym, starts, ends)
        kept = sym >= 0
        return sym[kept].astype(np.uint32), np.add.reduceat(kept, starts, dtype=np.int64)

    def pieces(self, text):
        """Parts of a text between blanks, and ids of special tokens, in order."""
        parts = self.any_special.split(text) if self.any_special else [text]
        out: list = []
        for k, part in enumerate(parts):
            if k % 2:
                out.append(self.special[part])
            else:
                out += part.replace("\n", " ").split(" ")
        return out


def spread(flat, sizes, places):
    """The chosen runs of a flat array, in order, and the size of each."""
    begin = np.cumsum(sizes) - sizes
    chosen = sizes[places]
    ends = np.cumsum(chosen)
    at = np.repeat(begin[places] - (ends - chosen), chosen) + np.arange(ends[-1] if len(ends) else 0)
    return flat[at], chosen


class Encoder:
    """The pieces that a partition has met and their ids."""

    def __init__(self, bpe: WordBPE, known=KNOWN_PIECES):
        self.bpe, self.most = bpe, known
        self.forget()

    def forget(self):
        self.numbers, self.flat, self.sizes = Numbering(), np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def learn(self):
        """Encodes the pieces numbered since the last call."""
        cut, normalise, words = self.bpe.cut, self.bpe.normalise, Numbering()
        runs, sizes = [], []
        for piece in islice(self.numbers, len(self.sizes), None):
            own = [piece] if isinstance(piece, int) else [w for w, _ in cut(normalise(piece))]
            runs += [words[w] for w in own]
            sizes.append(len(own))
        coded, n_ids = self.bpe.words([w for w in words if not isinstance(w, int)])
        if len(n_ids) < len(words):  # special tokens stand between the words
            own = np.array([isinstance(w, int) for w in words])
            every = np.ones(len(words), np.int64)
            every[~own] = n_ids
            ids = np.zeros(int(every.sum()), np.uint32)
            place = np.repeat(own, every)
            ids[~place], ids[place] = coded, [w for w in words if isinstance(w, int)]
            coded, n_ids = ids, every
        ids, lengths = spread(coded, n_ids, np.array(runs, np.int64))
        ends = np.append(0, np.cumsum(lengths))[np.append(0, np.cumsum(np.array(sizes, np.int64)))]
        self.flat = np.concatenate([self.flat, ids])
        self.sizes = np.concatenate([self.sizes, np.diff(ends)])

    def __call__(self, texts):
        """(ids of all texts one after another, number of ids of each)."""
        if len(self.numbers) > self.most:
            self.forget()
        numbers, counts = [], []
        for text in texts:
            own = self.bpe.pieces(text)
            numbers.append(np.fromiter(map(self.numbers.__getitem__, own), np.int64, len(own)))
            counts.append(len(own))
        self.learn()
        ids, sizes = spread(self.flat, self.sizes, np.concatenate(numbers) if numbers else np.zeros(0, np.int64))
        ends = np.append(0, np.cumsum(sizes))[np.append(0, np.cumsum(np.array(counts, np.int64)))]
        return ids, np.diff(ends)


def runs_of(column, limit=2 << 20):
    """Texts of a column in runs of about ``limit`` bytes, so that temporaries stay small."""
    run, size = [], 0
    for value in column.cast(pa.binary()):
        run.append(value.as_py() or b"")
        size += len(run[-1])
        if size >= limit:
            yield [t.decode("utf-8", "replace") for t in run]
            run, size = [], 0
    yield [t.decode("utf-8", "replace") for t in run]


def encode(docs: DataFrame, path, text_col="text", ids_col="ids", count_col="n_tokens") -> DataFrame:
    """The rows with ``ids_col`` (binary) and ``count_col`` (long) in place of the text."""
    kept = [f for f in docs.schema.fields if f.name.lower() not in (text_col.lower(), ids_col.lower(), count_col.lower())]
    names = [f.name for f in kept]

    def run(batches):
        encoder = Encoder(WordBPE(path))
        for batch in batches:
            parts = [encoder(texts) for texts in runs_of(batch.column(len(names)))]
            ids = np.concatenate([p[0] for p in parts])
            sizes = np.concatenate([p[1] for p in parts])
            offsets = np.append(0, np.cumsum(sizes) * 4).astype(np.int64)
            packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(ids.astype("<u4"))])
            columns = [batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([*columns, packed.cast(pa.binary()), pa.array(sizes, pa.int64())], [*names, ids_col, count_col])

    schema = StructType([*kept, StructField(ids_col, BinaryType()), StructField(count_col, LongType())])
    return docs.select(*[f"`{n}`" for n in names], text_col).mapInArrow(run, schema)


def decode(rows: DataFrame, path, ids_col="ids", text_col="text") -> DataFrame:
    """The rows with ``text_col`` beside their ids."""
    kept = [f for f in rows.schema.fields if f.name.lower() != text_col.lower()]
    names = [f.name for f in kept]

    def run(batches):
        token = token_names(path)
        for batch in batches:
            texts = []
            for value in batch.column(ids_col):
                ids = np.frombuffer(value.as_py() or b"", "<u4").tolist()
                texts.append(" ".join([token[i] for i in ids if i in token]))
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(texts, pa.string())], [*names, text_col])

    return rows.select(*[f"`{n}`" for n in names]).mapInArrow(run, StructType([*kept, StructField(text_col, StringType())]))
