"""The corpus pipeline: quality rules, near-duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; between stages the rows are
written as Parquet and read again; a stage's rows are removed once the next one's are written. All
stages but the last return the columns of documents, also columns of any other name.

Null and empty texts, and texts of fewer than 50 words, fail the base rule of the first stage. Very long
texts are judged, compared, scanned and packed whole. Of rows with equal texts the smallest doc_id
stays; rows that share this id, or have a null one, all stay. An empty table, or one of which
nothing is kept, gives an empty one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from furrow.llm import minhash_dedup, packing, quality_rules, secret_scan
from furrow.llm.common import own_dir
from furrow.session import removed


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the learned list rejects go."""
    return quality_rules.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one of the smallest id."""
    return minhash_dedup.keep_one(docs, words=5, percent=80)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; the documents stay."""
    return secret_scan.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 4096 tokens."""
    return packing.pieces(docs, "word_bpe_49k.json", length=4096, end_id=2)


STAGES = [("quality rules", quality), ("minhash near-dedup", near_duplicates), ("secret scans", secrets), ("packing", pack)]

#: The learned list, the automaton's marks and the curve have no SQL form; the tests hold the
#: pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = f"{own_dir(spark)}/pipeline-{k}-{uuid.uuid4().hex}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            if before is not None:
                removed(spark, before)
            before = path
    return docs
