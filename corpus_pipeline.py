"""The corpus pipeline: quality classifier, near-duplicates, personal data, source mix, packed sequences.

Each stage takes (spark, docs, sf_dir), where docs is what the stage before kept, and
returns a table, which is written as Parquet and read again as the next one's docs.  All but the last
keep the columns of documents:

* quality: documents that the neighbour vote scores below 0.7 go; it learns from the labels of the corpus;
* near_dedup: one document of each SimHash class stays (the smallest id);
* pii: every span of personal data is replaced by its kind;
* mix: each document appears as often as the source mix takes it;
* pack: the texts of the mix as token pieces of full sequences with their ids, neighbours on a Hilbert curve together.

Null and empty texts, repeated rows, empty tables and extra columns are handled as the operators state; without labels
the quality stage keeps all documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage.llm import mixing, packing, pii, quality, simhash
from stowage.llm.common import stage_table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_quality(docs, labels, mod=4, held=2, threshold=0.7)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.simhash_dedup(docs, width=3, max_bits=3)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact_pii(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs, weights=(5, 2, 1), share=1.5, most=2.0)


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = packing.pack(docs, length=2048, tokenizer="byte_bpe_50k")
    return out.select("doc_id", F.col("row").alias("copy"), "start", "length", "ids", F.crc32("ids").alias("ids_crc32"),
                      "doc_tokens", "sequence_id", "offset")


STAGES = [("quality", quality_stage), ("near_dedup", near_dedup_stage), ("pii", pii_stage), ("mix", mix_stage),
          ("pack", pack_stage)]

#: No SQL: the votes, fingerprints, labelers and tokenizer are beyond it; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; the rows of the last one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stage_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
