"""One query per operator, with production parameters, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridhazard.llm import sqltext
from gridhazard.llm.bpe import decode, encode
from gridhazard.llm.common import SMALL_BATCH_BYTES, held_out, prepare
from gridhazard.llm.decontaminate import decontaminate
from gridhazard.llm.jaccard import near_copies
from gridhazard.llm.langid import identify
from gridhazard.llm.licences import find_licences, licence_sql
from gridhazard.llm.merkle import verified
from gridhazard.llm.negatives import mine
from gridhazard.llm.neighbours import nearest
from gridhazard.llm.packing import pack
from gridhazard.llm.quality import score_quality
from gridhazard.llm.secrets import find_secrets
from gridhazard.llm.sharding import shard_documents
from gridhazard.llm.toxicity import score_toxicity
from gridhazard.plans.registry import query, table


@query("", sqltext.DECONTAMINATE)
def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit words and items of every document, against windows of ten words of every benchmark item."""
    found = decontaminate(table(prepare(spark), sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items",
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


@query("")
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt from the rows that are not held out."""
    out = identify(table(prepare(spark), sf_dir, "documents"), ~held_out())
    return out.select("doc_id", (~F.col("learn")).alias("held_out"), "lang_pred", "score")


@query("")
def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learnt from labels of rows that are not held out."""
    out = score_quality(table(prepare(spark), sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held_out())
    return out.select("doc_id", (~F.col("learn")).alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


@query("")
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, learnt from rows that are not held out."""
    out = score_toxicity(table(prepare(spark), sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held_out())
    return out.select("doc_id", (~F.col("learn")).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


@query("")
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens."""
    return pack(table(prepare(spark), sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("", sqltext.NEAR_COPIES)
def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of every document, links at 90 percent of three-word shingles."""
    return near_copies(table(prepare(spark, SMALL_BATCH_BYTES), sf_dir, "documents"), size=3, num=90, den=100).select("doc_id", "n_shingles", "component_id")


@query("", sqltext.SECRETS)
def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document. A source is an owner, its documents in one language are a repository."""
    docs = table(prepare(spark), sf_dir, "documents")
    return find_secrets(docs, F.col("source"), F.concat_ws("/", F.coalesce("source", F.lit("?")), F.coalesce("lang", F.lit("?"))))


@query("")
def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """24 shards of documents with equal counts, equal texts together as far as they fit."""
    return shard_documents(table(prepare(spark), sf_dir, "documents"))


@query("")
def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors found for every fiftieth id."""
    return nearest(table(prepare(spark), sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query("", licence_sql())
def op10_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence sentences of every document and the licences they make."""
    return find_licences(table(prepare(spark), sf_dir, "documents"))


@query("", sqltext.MERKLE)
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root and proof of every document, and the root that a changed row folds up to."""
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    longer = F.col("n_chars") + F.when(crc % 7 == 0, 1).otherwise(0)
    out = verified(table(prepare(spark), sf_dir, "documents"), {"n_chars": longer})
    return out.select(
        F.col("id").alias("doc_id"), *[F.lower(F.hex(c)).alias(n) for c, n in (
            ("digest", "leaf"), ("subroot", "subroot"), ("root", "root"), ("proof_digest", "proof_sha256"), ("folded", "folded_root"))], "verified")


@query("")
def op11_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document and the text that they are decoded to, as digests."""
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = table(prepare(spark), sf_dir, "documents").select("doc_id", "text")
    out = decode(encode(docs, path), path)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


@query("", sqltext.HARD_NEGATIVES)
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three hard negatives for each of the five positives of every fiftieth id; the label of every seventh moves on by one."""
    rows = table(prepare(spark), sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.withColumn("label", moved), F.col("vec_id") % 50 == 0)
