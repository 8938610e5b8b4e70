"""Fusion of lanes by kind of source: cloud files, connectors, images, audio, video, and all of them together.

Lanes are relations (qid, id, score, rank), cut to their best rows already, so what is fused here grows with the queries alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import fuzzy
from tessera.operators.retrieval import holding, top


def lane_limit(k: int, least: int = 50) -> int:
    """Rows a lane hands over for k results."""
    return max(least, 8 * k)


def cloud(lexical: DataFrame, semantic: DataFrame, owners: DataFrame, k: int) -> DataFrame:
    """(qid, path, score, id, matched_chunks, rank): 1 / rank of a chunk in the lexical lane and 0.85 / rank in the semantic one, added up;
    of a file (owners: id, path) its best chunk counts, with the number of its chunks met."""
    parts = lexical.select("qid", "id", (1.0 / F.col("rank")).alias("s")).unionByName(semantic.select("qid", "id", (0.85 / F.col("rank")).alias("s")))
    chunks = parts.groupBy("qid", "id").agg(F.round(F.sum("s"), 12).alias("score")).join(owners, "id")
    best = chunks.groupBy("qid", "path").agg(F.max(F.struct("score", (-F.col("id")).alias("i"))).alias("b"), F.count("*").alias("matched_chunks"))
    return top(best.select("qid", "path", F.col("b.score").alias("score"), (-F.col("b.i")).alias("id"), "matched_chunks"), k, tie="path")


def connector(lexical: DataFrame, chunks: DataFrame, queries: DataFrame, k: int, exclude: list[str] | None = None) -> DataFrame:
    """(qid, uri, score, matched_chunks, rank): BM25, and 2.5 if the title holds the query, 1.5 if the chunk does; the best chunk of a uri.
    chunks: id, uri, title, text. Chunks are met in the lane's order; one that beats all before it takes their place and isn't counted."""
    kept = chunks.where(~F.col("uri").isin(exclude)) if exclude else chunks
    q = F.lower(T.strip(F.col("query")))
    bonus = F.when(F.contains(F.lower("title"), q), 2.5).otherwise(0.0) + F.when(F.contains(F.lower("text"), q), 1.5).otherwise(0.0)
    rows = lexical.join(kept, "id").join(queries.select("qid", "query"), "qid").select("qid", "uri", F.col("rank").alias("place"), (F.greatest("score", F.lit(0.0)) + bonus).alias("score"))
    before = F.max("score").over(Window.partitionBy("qid", "uri").orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
    best = rows.withColumn("before", before).groupBy("qid", "uri").agg(F.max("score").alias("score"), (1 + F.count_if(F.col("score") <= F.col("before"))).alias("matched_chunks"))
    return top(best, k, tie="uri")


def ocr_score(bm25: Column, mode: str) -> Column:
    """Of a BM25 score s of 0 or more. faithful: 1 / (1 - s), negative above 1 and nothing at 1; fixed: s / (1 + s), which grows with s."""
    if mode == "fixed":
        return bm25 / (1 + bm25)
    if mode == "faithful":
        return F.when(bm25 != 1, 1 / (1 - F.when(bm25 != 1, bm25)))
    raise ValueError(f"unknown mode {mode}")


def image(semantic: DataFrame, ocr: DataFrame, images: DataFrame, queries: DataFrame, k: int, mode: str = "faithful") -> DataFrame:
    """(qid, id, score, semantic, ocr, match_type, rank): 3 semantic + 1.4 ocr + 1.8 name, for rows of either lane; images: id, filename.

    A name counts from a similarity of 0.88 to the query, fully from 0.97; scores of 0 or less go."""
    empty = F.lit(None).cast("double")
    parts = semantic.select("qid", "id", F.greatest("score", F.lit(0.0)).alias("sem"), empty.alias("bm25")).unionByName(ocr.select("qid", "id", empty.alias("sem"), F.col("score").alias("bm25")))
    met = parts.groupBy("qid", "id").agg(F.max("sem").alias("sem"), F.max("bm25").alias("bm25")).join(images.select("id", "filename"), "id").join(queries.select("qid", "query"), "qid")
    like = fuzzy.ratios(fuzzy.plain_name(F.col("query")), fuzzy.plain_name(F.col("filename"))) / 100
    met = met.select("qid", "id", F.coalesce("sem", F.lit(0.0)).alias("semantic"), F.coalesce(ocr_score(F.col("bm25"), mode), F.lit(0.0)).alias("ocr"), like.alias("like"))
    met = met.withColumn("name", F.when(F.col("like") >= 0.97, 1.0).when(F.col("like") >= 0.88, F.col("like")).otherwise(0.0))
    kind = F.when((F.col("semantic") > 0) & ((F.col("ocr") > 0) | (F.col("name") > 0)), "hybrid").when(F.col("semantic") > 0, "semantic").when(F.col("name") > 0, "filename").otherwise("ocr")
    scored = met.select("qid", "id", F.round(3.0 * F.col("semantic") + 1.4 * F.col("ocr") + 1.8 * F.col("name"), 9).alias("score"), "semantic", "ocr", kind.alias("match_type"))
    return top(scored.where("score > 0"), k)


def ordered_union(lanes: list[DataFrame], most: int = 100) -> DataFrame:
    """(qid, id, place) of lanes (qid, id, rank): the first lane's rows in their order, then what the next has beside them, and so on; of each
    query the first ``most``."""
    rows = reduce(DataFrame.unionByName, [x.select("qid", "id", F.struct(F.lit(i).alias("lane"), "rank").alias("at")) for i, x in enumerate(lanes)])
    first = rows.groupBy("qid", "id").agg(F.min("at").alias("at"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy("at", "id"))).where(F.col("place") <= most).select("qid", "id", "place")


def images_by_name(queries: DataFrame, images: DataFrame, answered: DataFrame, k: int, least: float = 70.0) -> DataFrame:
    """(qid, id, score, rank) for queries (qid, query) that no lane has answered (qid): images (id, filename) whose name is near a word of
    theirs, by 1.8 times the best partial ratio."""
    words = queries.join(answered.select("qid").distinct(), "qid", "left_anti").select("qid", F.explode(F.array_distinct(T.tokens(F.col("query")))).alias("word"))
    named = images.select("id", F.lower("filename").alias("name"))
    near = words.join(fuzzy.near_names(words, named, least), "word").groupBy("qid", "name").agg(F.max("score").alias("s"))
    return top(near.join(named, "name").select("qid", "id", (F.col("s") / 100 * 1.8).alias("score")), k)


def audio(lexical: DataFrame, files: DataFrame, category: str, k: int) -> DataFrame:
    """(qid, id, score, transcript, rank): rows of the lane whose file is of the category, with the first 500 characters of the text."""
    of = files.where(F.lower("category") == category.lower()).select("id", F.left("content", F.lit(500)).alias("transcript"))
    return top(lexical.select("qid", "id", "score").join(of, "id"), k)


def video(frames_near: DataFrame, context: DataFrame, transcripts: DataFrame, frames: DataFrame, k: int) -> DataFrame:
    """(qid, video_id, score, context_match, transcript_match, rank); frames: id, video_id; transcripts are by video_id.

    A video starts with its best frame's score, of 0.15 at least, or else with 0.2; matches in what its frames show and in its transcript
    add bm25 / 20, up to 0.35 and 0.3 each; with any such match the sum stops at 0.99. As all parts are 0 or more, the cap commutes with
    adding them one by one, so their order is of no account."""
    near = frames_near.where("score >= 0.15").join(frames, "id").groupBy("qid", "video_id").agg(F.max("score").alias("s"))
    near = near.select("qid", "video_id", "s", F.lit(None).cast("double").alias("context"), F.lit(None).cast("double").alias("spoken"))
    seen = context.join(frames, "id").select("qid", "video_id", F.lit(None).cast("double").alias("s"), F.least(F.lit(0.35), F.abs("score") / 20).alias("context"), F.lit(None).cast("double").alias("spoken"))
    said = transcripts.select("qid", "video_id", F.lit(None).cast("double").alias("s"), F.lit(None).cast("double").alias("context"), F.least(F.lit(0.3), F.abs("score") / 20).alias("spoken"))
    all_parts = near.unionByName(seen).unionByName(said).groupBy("qid", "video_id").agg(F.max("s").alias("s"), F.sum("context").alias("context"), F.sum("spoken").alias("spoken"))
    boost = F.coalesce("context", F.lit(0.0)) + F.coalesce("spoken", F.lit(0.0))
    any_match = F.col("context").isNotNull() | F.col("spoken").isNotNull()
    score = F.when(any_match, F.least(F.lit(0.99), F.coalesce("s", F.lit(0.2)) + boost)).otherwise(F.col("s"))
    scored = all_parts.select("qid", "video_id", F.round(score, 9).alias("score"), F.col("context").isNotNull().alias("context_match"), F.col("spoken").isNotNull().alias("transcript_match"))
    return top(scored.where("score > 0"), k, tie="video_id")


def unified(lanes: dict[str, DataFrame], k: int) -> DataFrame:
    """(qid, modality, item, score, place, low_confidence) of lanes (qid, item, score): one list, by score; low if a query's scores all are
    below 0.1. The lanes' scales differ, as they do in what they come from."""
    rows = reduce(DataFrame.unionByName, [x.select("qid", F.lit(m).alias("modality"), F.col("item").cast("string").alias("item"), "score") for m, x in lanes.items()])
    w = Window.partitionBy("qid").orderBy(F.col("score").desc(), "modality", "item")
    rows = rows.withColumn("low_confidence", F.max("score").over(Window.partitionBy("qid")) < 0.1)
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def code_candidates(files: DataFrame, symbols: DataFrame, queries: DataFrame, k: int = 100, per_path: int = 300, per_symbol: int = 500, most: int | None = 8) -> DataFrame:
    """(qid, id, score, reasons, rank): files for a question about code. files: id, path, line_count, mtime; symbols: id, name.

    Each of the first ``most`` distinct tokens, or of all, of two characters or more adds 2 to files whose path holds it, 3 to those with such a symbol; the
    newest 200 files, or twice k, have 0.25 to start with. Of a token's files the newest count, and of its symbols' the first."""
    tokens = F.array_distinct(F.filter(T.tokens(F.col("query")), lambda t: F.length(t) >= 2))
    tokens = tokens if most is None else F.slice(tokens, 1, most)
    t = queries.select("qid", F.explode(tokens).alias("tok"))
    words = t.select("tok").distinct()
    newest = Window.partitionBy("tok").orderBy(F.col("mtime").desc(), "id")
    terms = words.withColumnRenamed("tok", "term")
    met = lambda rows, column: rows.withColumn("word", F.lower(column)).join(holding(rows.select(F.lower(column).alias("word")), terms), "word").withColumnRenamed("term", "tok")
    by_path = met(files, "path").withColumn("n", F.row_number().over(newest)).where(F.col("n") <= per_path).select("tok", "id", F.lit(2.0).alias("s"), F.concat(F.lit("path:"), "tok").alias("reason"))
    named = met(symbols, "name").select("tok", "id").distinct()
    by_symbol = named.withColumn("n", F.row_number().over(Window.partitionBy("tok").orderBy("id"))).where(F.col("n") <= per_symbol).select("tok", "id", F.lit(3.0).alias("s"), F.concat(F.lit("symbol:"), "tok").alias("reason"))
    found = by_path.unionByName(by_symbol).join(t, "tok").select("qid", "id", "s", "reason")
    # A stated number of rows, so that it can go to each query.
    fallback = files.orderBy(F.col("mtime").desc(), "id").limit(max(200, 2 * k)).select("id")
    found = found.unionByName(queries.select("qid").crossJoin(F.broadcast(fallback)).select("qid", "id", F.lit(0.25).alias("s"), F.lit("fallback").alias("reason")))
    scored = found.groupBy("qid", "id").agg(F.sum("s").alias("score"), F.array_sort(F.collect_set("reason")).alias("reasons")).join(files.select("id", "line_count"), "id")
    w = Window.partitionBy("qid").orderBy(F.col("score").desc(), F.asc_nulls_last("line_count"), "id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= max(10, k))
