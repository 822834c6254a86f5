"""Corpus preparation in stages; each stage works on the documents that the one before it kept.

    language ID -> exact dedup -> SimHash near-dedup -> PII surrogates -> packing

A stage takes (spark, docs, sf_dir) and gives documents of the same columns, the last one the
pieces of packed sequences.  Its result is written as Parquet and read again as the next one's input.
Columns beyond those of documents are left out by every stage; an empty table gives no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fallpoint.llm.common import only_rows, shared_folder
from fallpoint.llm.exact_dedup import exact_dedup
from fallpoint.llm.language_id import fit, identify
from fallpoint.llm.packing import pack
from fallpoint.llm.pii import pseudonymise
from fallpoint.llm.queries import PII_KEY, WORD_BPE
from fallpoint.llm.simhash import near_representatives

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def small_batches(spark: SparkSession) -> None:
    """Texts go to the Python workers a few hundred at a time: what lies between Spark and a worker is held several times over."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that are too far from every language: null texts, texts without letters, other scripts.

    The languages are learnt from the documents' own ``lang``; without any nothing can be told and all go.  Null ids and
    repeated rows stay as they are."""
    small_batches(spark)
    model = fit(docs)
    return identify(docs.select(*COLUMNS), model).where(~F.col("rejected")).select(*COLUMNS)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each text; of rows repeated with id and text one stays.  A null text counts as empty."""
    small_batches(spark)
    kept = exact_dedup(docs).where("kept")
    stays = kept.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("_key"), F.col("text_sha256").alias("_sha"))
    return only_rows(docs.select(*COLUMNS), stays)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each group of near copies, a null id only where there is no other; of rows repeated with id and text one stays.

    Null and empty texts are one text."""
    small_batches(spark)
    return near_representatives(docs).select(*COLUMNS)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data; n_chars follows the new text.  Null and empty texts, null ids and repeated rows stay."""
    return pseudonymise(docs.select(*COLUMNS), PII_KEY).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences, with the CRC-32 of their ids.  A null or empty text is its end id alone; repeated rows are packed each."""
    small_batches(spark)
    return pack(docs, WORD_BPE).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_stage), ("exact_dedup", exact_stage), ("simhash_dedup", near_stage), ("pii", pii_stage), ("packing", packing_stage)]

ORACLE_SQL = None  # several stages are beyond SQL; tests hold them against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; what lies between them is in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{k}-{name}")
            docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"pipeline": run}
SQL: dict[str, str] = {}
