"""The corpus pipeline: toxic documents go, near copies go, contaminated documents go, secrets are masked, the rest is packed.

Every stage works on all that the one before kept. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridhazard.llm.common import SMALL_BATCH_BYTES, SMALL_CHUNK_BYTES, held_out, prepare
from gridhazard.llm.decontaminate import drop_contaminated
from gridhazard.llm.jaccard import drop_near_copies
from gridhazard.llm.packing import pack
from gridhazard.llm.secrets import redact
from gridhazard.llm.toxicity import drop_toxic
from gridhazard.plans.registry import query, table
from gridhazard.session import cut_lineage


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.3, learnt from labels of rows that are not held out."""
    return drop_toxic(docs, table(prepare(spark), sf_dir, "labels"), ~held_out())


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of 80 percent of five-word shingles join."""
    prepare(spark, SMALL_BATCH_BYTES)
    return drop_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without ten consecutive words of a benchmark item."""
    return drop_contaminated(docs, table(prepare(spark), sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, owner-specific secrets masked; n_chars follows the text."""
    repo = F.concat_ws("/", F.coalesce("source", F.lit("?")), F.coalesce("lang", F.lit("?")))
    out = redact(docs, F.col("source"), repo)
    return out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2048 tokens, in chunks that fit beside the heap the stages before have filled."""
    prepare(spark, SMALL_BATCH_BYTES)
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), chunk_bytes=SMALL_CHUNK_BYTES)


STAGES = [
    ("toxicity", toxicity),
    ("ngram_jaccard_join", near_copies),
    ("benchmark_decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("packing", packing),
]

#: The trained filter, the tokenizer and the cuts have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut_lineage(docs)
    return docs


@query("", ORACLE_SQL)
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir)
