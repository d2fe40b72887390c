"""Merkle manifest against a tree built in memory."""

from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from gridhazard.llm.merkle import manifest, verified, walk

#: Names that the operator uses for its own columns.
CLASH = ("branch", "digest", "pos", "total", "proof", "subroot", "tie", "id")
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def h(*texts):
    return sha256("".join(texts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[k] for k in FIELDS)))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][k:k + 2]) for k in range(0, len(out[-1]), 2)])
    return out


def siblings(tree, at):
    out = []
    for row in tree[:-1]:
        other = at ^ 1
        out.append((None if other >= len(row) else row[other], at & 1))
        at //= 2
    return out


def brute(rows, changed):
    """Sorted (doc_id, leaf, subroot, root, proof digest, folded root, verified)."""
    branches = {}
    for row in rows:
        branches.setdefault(row["lang"], []).append(row)
    names = sorted(branches, key=lambda b: (b is not None, (b or "").encode()))
    trees = {}
    for b in names:
        branches[b].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        trees[b] = levels([leaf(r) for r in branches[b]])
    top = levels([trees[b][-1][0] for b in names])
    out = []
    for k, b in enumerate(names):
        for at, row in enumerate(branches[b]):
            path, node = siblings(trees[b], at) + siblings(top, k), leaf(changed(row))
            for other, right in path:
                node = h(node) if other is None else h(other, node) if right else h(node, other)
            told = h(*(other for other, _ in path if other is not None))
            out.append((row["doc_id"], leaf(row), trees[b][-1][0], top[-1][0], told, node, node == top[-1][0]))
    return sorted(out, key=str)


def longer(row):
    return {**row, "n_chars": None if row["n_chars"] is None else row["n_chars"] + (row["doc_id"] or 0) % 2}


def rows_of(n, langs):
    out = []
    for i in range(n):
        text = (None, "", "ünï code " * (i % 7), "plain")[i % 4] if i != 5 else "long " * 60_000
        out.append({"doc_id": None if i % 29 == 3 else i // 2 * 3, "text": text, "lang": langs[i * i % len(langs)],
                    "source": None if i % 5 == 0 else f"s{i % 3}", "n_chars": None if i % 6 == 0 else i})
    return out + out[:2] * 2  # repeated rows


@pytest.mark.parametrize("n,langs,every", [(90, ("en", None, "", "é", "-", "en", "en"), 2), (37, ("en",), 1), (50, ("a", "b", "c"), 10), (61, (None, "zh"), 3)])
def test_manifest_equals_a_tree_in_memory(spark, n, langs, every):
    rows = rows_of(n, langs)
    kind = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASH)
    docs = spark.createDataFrame([(*[r[k] for k in ("doc_id", "text", "lang", "source", "n_chars")], *CLASH) for r in rows], kind).repartition(3)
    more = F.col("n_chars") + F.coalesce(F.col("doc_id"), F.lit(0)) % 2
    found = verified(docs, {"n_chars": more}, every=every).collect()
    texts = [(r["id"], *(bytes(r[c]).hex() for c in ("digest", "subroot", "root", "proof_digest", "folded")), r["verified"]) for r in found]
    assert sorted(texts, key=str) == brute(rows, longer)
    assert any(r["verified"] for r in found) and not all(r["verified"] for r in found)


def test_proofs_fold_and_stand_alone(spark):
    rows = rows_of(40, ("x", "y", None))
    docs = spark.createDataFrame([tuple(r[k] for k in FIELDS) for r in rows], "doc_id long, source string, lang string, n_chars long, text string")
    leaves, root = manifest(docs, every=2)
    found = leaves.collect()
    assert len(found) == len(rows)
    assert all(walk(bytes(r["digest"]), bytes(r["proof"]))[0] == root for r in found)


@pytest.mark.parametrize("lang", ["en", None])
def test_one_row_and_no_row(spark, lang):
    kind = "doc_id long, source string, lang string, n_chars long, text string"
    one = spark.createDataFrame([(1, "s", lang, 2, None)], kind)
    row = verified(one, {}).first()
    assert row["digest"] == row["subroot"] == row["root"] == row["folded"] and row["verified"]
    assert bytes(row["proof_digest"]).hex() == h()
    assert verified(one.limit(0), {}).collect() == []
