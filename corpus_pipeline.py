"""From raw documents to token ids: five stages, each written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import line_dedup, mixing, ngram_join, pieces, toxicity
from tessera.llm.common import cut_table, drop_tables, table


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, learned from this stage's documents, rejects go; the others stay as they are.

    Null and empty texts, repeated rows, null ids and very long texts are scored like any; without labels nothing is rejected."""
    return toxicity.without_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat others, or nearly so, are kept once; documents with no line left go. n_chars follows the text.

    Null and empty texts and rows with a null id stay as they are; rows that share an id keep a line that each has at the same place."""
    out = line_dedup.dedup_lines(docs, drop_emptied=True)
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType))).select(*docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that of the smallest id; so do texts without words and rows with a null id. Rows that share
    an id are one document, and stay or go together."""
    return ngram_join.one_of_each(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, rows that repeat or have a null id each by their own count. A null source is one."""
    return mixing.mixed(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, decoded of each row of the mix; a null text is encoded as an empty one."""
    import public_tokenizers

    return pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", without_toxic),
    ("line dedup", without_repeated_lines),
    ("n-gram join", without_near_copies),
    ("mixing", mixed),
    ("pieces", encoded),
]

#: Learned scores, fuzzy lines and token ids have no SQL; tests/llm/test_brute_force.py holds each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. A stage's table is deleted once the next one's is written; empty tables pass through all stages."""
    docs, older = table(spark, sf_dir, "documents"), []
    for _, stage in STAGES[:-1]:
        newer: list[str] = []
        docs = cut_table(stage(spark, docs, sf_dir), newer)
        drop_tables(spark, older)
        older = newer
    return STAGES[-1][1](spark, docs, sf_dir)
