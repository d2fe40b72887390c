"""BPE by pair occurrences against the tokenizers library."""

import hashlib
import json
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gridhazard.llm.bpe import Encoder, WordBPE, byte_letters, decode, encode
from gridhazard.llm.queries import op11_bpe_round_trip

PATH = public_tokenizers.path("word_bpe_49k.json")
POOL = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "aa", "aaaa", "'s", "'LL", "İ", "Σ", "ς", "é", "é", " ", "  ", "\n", "\t", "\x1c",
        "\x85", " ", "　", "１", "½", "中文", "́", "ﬁ", "K", "Å", "ẞ", "ǅ", "한", "👍🏽", "‍", "-", "--", "42", "Don't", "THE"]


def some_texts(rng, n):
    planes = [(32, 0x250), (0x250, 0xD800), (0xE000, 0x20000)]
    return ["".join(rng.choice(POOL) if rng.random() < 0.7 else chr(rng.randrange(*rng.choice(planes))) for _ in range(rng.randrange(40))) for _ in range(n)]


def same(encoder, tok, texts):
    ids, sizes = encoder(texts)
    ends = np.append(0, np.cumsum(sizes))
    return [ids[a:z].tolist() for a, z in zip(ends, ends[1:])] == [c.ids for c in tok.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("known", [1 << 19, 3])
def test_ids_equal_the_library(known):
    tok, encoder, rng = Tokenizer.from_file(PATH), Encoder(WordBPE(PATH), known), random.Random(5)
    for _ in range(4):
        assert same(encoder, tok, some_texts(rng, 1500))
    assert same(encoder, tok, []) and same(encoder, tok, [""]) and same(encoder, tok, ["<|endoftext|>"]) and same(encoder, tok, ["x" * 50_000 + " y" * 30_000])


def test_merges_in_any_order(tmp_path):
    """Merges whose results take part in earlier ones: a word then merges one pair at a time."""
    letters = byte_letters().values()
    rng = random.Random(7)
    for trial in range(6):
        vocab = {}
        for token in [*letters, *[x + "</w>" for x in letters]]:
            vocab.setdefault(token, len(vocab))
        made, merges = ["a", "b", "c", "a</w>", "b</w>"], []
        for _ in range(40):
            x, y = rng.choice([m for m in made if "<" not in m]), rng.choice(made)
            if x + y not in vocab and len(x + y) < 14:
                vocab[x + y] = len(vocab)
                merges.append([x, y])
                made.append(x + y)
        rng.shuffle(merges)
        told = json.load(open(PATH, encoding="utf-8"))
        told["model"] |= {"vocab": vocab, "merges": merges}
        told["added_tokens"] = []
        path = tmp_path / f"{trial}.json"
        path.write_text(json.dumps(told))
        bpe = WordBPE(str(path))
        texts = [" ".join("".join(rng.choice("aab c" if k % 2 else "abc") for _ in range(rng.randrange(30))) for _ in range(4)) for k in range(400)]
        assert same(Encoder(bpe), Tokenizer.from_file(str(path)), texts)
    assert not bpe.ascending


def test_round_trip_of_rows(spark):
    texts = [None, "", " ", "Same text", "Same text", "<|endoftext|> it's", "long " * 80_000, "é" * 9, "�"] + some_texts(random.Random(1), 60)
    clash = {c: F.lit(c) for c in ("n_tokens", "ids", "row", "text of a row")}
    rows = spark.createDataFrame([(None if k == 3 else k // 2, t) for k, t in enumerate(texts)], "doc_id long, text string").withColumns(clash)
    coded = encode(rows.repartition(3), PATH)
    assert set(coded.columns) == {"doc_id", "row", "text of a row", "ids", "n_tokens"}
    found = decode(coded, PATH).collect()
    tok = Tokenizer.from_file(PATH)
    want = []
    for k, t in enumerate(texts):
        ids = tok.encode(t or "", add_special_tokens=False).ids
        want.append((None if k == 3 else k // 2, len(ids), np.array(ids, "<u4").tobytes(), tok.decode(ids, skip_special_tokens=False)))
    assert sorted(((r["doc_id"], r["n_tokens"], bytes(r["ids"]), r["text"]) for r in found), key=str) == sorted(want, key=str)
    assert decode(encode(rows.limit(0), PATH), PATH).collect() == []


def test_decode_of_null_and_unknown_ids(spark):
    rows = spark.createDataFrame([(1, None), (2, b""), (3, np.array([49407, 999_999, 0], "<u4").tobytes())], "id long, ids binary")
    assert [r["text"] for r in decode(rows, PATH).orderBy("id").collect()] == ["", "", "<|endoftext|> !"]


def test_query_equals_the_library(spark):
    sf = "/root/testdata/sf0.001"
    tok = Tokenizer.from_file(PATH)
    want = []
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = tok.encode(r["text"] or "", add_special_tokens=False).ids
        text = tok.decode(ids, skip_special_tokens=False)
        want.append((r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert sorted(map(tuple, op11_bpe_round_trip(spark, sf).collect())) == sorted(want)
