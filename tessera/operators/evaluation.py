"""Retrieval metrics over relations: run (qid, id, rank), qrels (qid, id, rel)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T


def per_query(run: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """(qid, ndcg, ap, recall, precision, mrr) for each query with relevant rows; a query without hits scores 0.

    One join and one window: gains, running hits and the first hit come from the same sorted pass; the ideal order is of all qrels.
    """
    gain = lambda rel, rank: (F.pow(F.lit(2.0), rel) - 1) / F.log2(rank + 1)
    good = qrels.where("rel > 0")
    by = Window.partitionBy("qid").orderBy(F.col("rel").desc(), "id")
    ideal = good.withColumn("r", F.row_number().over(by)).groupBy("qid").agg(F.sum(F.when(F.col("r") <= k, gain(F.col("rel"), F.col("r")))).alias("idcg"), F.count("*").alias("n"))
    hit = run.where(F.col("rank") <= k).join(good, ["qid", "id"])
    upto = Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    hit = hit.withColumn("hits", F.count("*").over(upto))
    got = hit.groupBy("qid").agg(F.sum(gain(F.col("rel"), F.col("rank"))).alias("dcg"), F.sum(F.col("hits") / F.col("rank")).alias("precisions"), F.count("*").alias("found"), F.min("rank").alias("first"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    out = ideal.join(got, "qid", "left")
    return out.select("qid", zero(F.col("dcg") / F.col("idcg")).alias("ndcg"), zero(F.col("precisions") / F.least(F.col("n"), F.lit(k))).alias("ap"), zero(F.col("found") / F.col("n")).alias("recall"), zero(F.col("found") / F.lit(float(k))).alias("precision"), zero(1 / F.col("first")).alias("mrr"))


def means(metrics: DataFrame, by: list[str] | None = None) -> DataFrame:
    names = ["ndcg", "ap", "recall", "precision", "mrr"]
    return metrics.groupBy(*(by or [])).agg(F.count("*").alias("queries"), F.count_if(F.col("recall") > 0).alias("queries_with_hits"), *[F.round(F.avg(n), 6).alias(n) for n in names])


def reduction(baseline: Column, got: Column) -> Column:
    """By how many per cent got is below a baseline; 0 for a baseline of 0 or less."""
    return F.when(baseline > 0, (1 - got / baseline) * 100).otherwise(F.lit(0.0))


def token_counts(run: DataFrame, qrels: DataFrame, files: DataFrame, chunks: DataFrame) -> DataFrame:
    """(qid, oracle_tokens, full_tokens, chunk_tokens, vs_oracle, vs_full) of each query of the run (qid, id): the tokens of all relevant
    texts, of the texts found, each once, and of their best chunks (qid, tokens); and by how much the last is below the others.

    A text's tokens are counted once, however many queries ask for it."""
    asked = run.select("id").unionByName(qrels.select("id")).distinct()
    sizes = files.join(asked, "id", "left_semi").select("id", T.token_estimate(T.words(F.col("content"))).cast("long").alias("t"))
    of = lambda rows, name: rows.select("qid", "id").distinct().join(sizes, "id").groupBy("qid").agg(F.sum("t").alias(name))
    out = run.select("qid").distinct().join(of(qrels.where("rel > 0"), "oracle_tokens"), "qid", "left").join(of(run, "full_tokens"), "qid", "left").join(chunks.groupBy("qid").agg(F.sum("tokens").cast("long").alias("chunk_tokens")), "qid", "left")
    out = out.select("qid", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("oracle_tokens", "full_tokens", "chunk_tokens")])
    return out.withColumn("vs_oracle", reduction(F.col("oracle_tokens"), F.col("chunk_tokens"))).withColumn("vs_full", reduction(F.col("full_tokens"), F.col("chunk_tokens")))


def token_summary(counts: DataFrame) -> DataFrame:
    """One row from token_counts(): sums, means a query, the reduction of the sums and the mean of the queries' reductions."""
    kinds = ("oracle", "full", "chunk")
    sums = [F.sum(f"{k}_tokens").alias(f"{k}_total") for k in kinds]
    means_ = [F.avg(f"{k}_tokens").alias(f"{k}_mean") for k in kinds]
    out = counts.agg(F.count("*").alias("queries"), *sums, *means_, F.avg("vs_oracle").alias("mean_vs_oracle"), F.avg("vs_full").alias("mean_vs_full"))
    return out.withColumn("overall_vs_oracle", reduction(F.col("oracle_total"), F.col("chunk_total"))).withColumn("overall_vs_full", reduction(F.col("full_total"), F.col("chunk_total")))
