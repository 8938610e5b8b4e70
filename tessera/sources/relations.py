"""The engine's relations from the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    name = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return d.select(F.col("doc_id").alias("id"), F.concat(F.lit("/"), "source", F.lit("/"), "lang", F.lit("/"), name).alias("path"), name.alias("filename"), F.col("source").alias("category"), F.col("lang").alias("matter_id"), (F.lit(1.7e9) + F.col("doc_id") * 3600).alias("mtime"), F.col("text").alias("content"))


def queries(spark: SparkSession, sf_dir: str, n_words: int = 6) -> DataFrame:
    """The first words of each benchmark passage, as queries."""
    b = table(spark, sf_dir, "benchmark")
    return b.select(F.col("item_id").alias("qid"), F.array_join(F.slice(F.split("text", " "), 1, n_words), " ").alias("query"))


def qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qid, id, rel): a document that holds a passage is relevant to its query."""
    b, d = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents")
    return holding_passages(d.select("doc_id", "text"), b.select("item_id", F.col("text").alias("passage")), b.count() <= 20_000)


def holding_passages(documents: DataFrame, passages: DataFrame, few: bool) -> DataFrame:
    """(qid, id, rel) of the documents (doc_id, text) that hold a passage (item_id, passage) as a substring.

    A passage's words between two spaces are words between spaces of any text that holds it, save its first and last. So a passage is tried on
    the texts alone that have the one of them that the fewest have; those of fewer than three words on all. few: the passages are
    a stated, counted query set, and are broadcast."""
    hint = (lambda x: F.broadcast(x)) if few else (lambda x: x)
    parts = F.split("passage", " ")
    inner = passages.where(F.size(parts) >= 3).select("item_id", "passage", F.slice(parts, F.lit(2), F.size(parts) - 2).alias("inner"))
    each = inner.select("item_id", "passage", F.explode(F.array_distinct("inner")).alias("word"))
    words = documents.select("doc_id", "text", F.explode(F.array_distinct(F.split("text", " "))).alias("word"))
    counts = words.join(hint(each.select("word").distinct()), "word").groupBy("word").agg(F.count("*").alias("n"))
    rarest = each.join(hint(counts), "word").groupBy("item_id", "passage").agg(F.min_by("word", F.struct("n", "word")).alias("word"))
    found = words.join(hint(rarest), "word").where(F.contains("text", F.col("passage"))).select("item_id", "doc_id")
    short = documents.join(hint(passages.where(F.size(parts) < 3)), F.contains("text", F.col("passage"))).select("item_id", "doc_id")
    return found.unionByName(short).select(F.col("item_id").alias("qid"), F.col("doc_id").alias("id"), F.lit(1).alias("rel"))
