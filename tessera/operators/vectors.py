"""Vector operators: exact nearest neighbours, hashed word embeddings, greedy near-duplicate filtering in order."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIM = 256


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


#: Queries in a block, and bytes of all blocks up to which they are broadcast.
BLOCK, BROADCAST_BYTES = 1024, 64 << 20


def packed(rows: DataFrame, id_col: str, vec_col: str, size: int) -> DataFrame:
    """(ids, vecs, n): rows in packs of up to ``size``, as they lie in their partitions; no shuffle. Null ids and vectors are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for x in range(0, len(b), size):
                part = b.iloc[x : x + size]
                yield pd.DataFrame({"ids": [part["id"].to_numpy(np.int64).tobytes()], "vecs": [np.stack(part["vec"].to_numpy()).astype(np.float64).tobytes()], "n": [len(part)]})

    return rows.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec")).where("id is not null and vec is not null").mapInPandas(run, "ids binary, vecs binary, n long")


def nearest(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", n_queries: int | None = None) -> DataFrame:
    """(qid, id, score, rank) of the k nearest by cosine, angular (1 - distance / 2 of unit vectors, not below 0) or l2 distance.

    queries (qid, q) are a stated set, met by all vectors, of one length all: packs of either side are multiplied as matrices, and of each
    product a query's best k go on. The packs of queries are broadcast if their bytes are few. Vectors of norm 0 have no cosine and are left out
    where one is asked for."""
    tiles, blocks = packed(vectors, "id", "embedding", 8192), packed(queries, "qid", "q", BLOCK)
    blocks = blocks.select(F.col("ids").alias("q_ids"), F.col("vecs").alias("q_vecs"), F.col("n").alias("q_n"))
    width = queries.agg(F.max(F.size("q"))).first()[0] or 0
    few = n_queries is not None and n_queries * width * 8 <= BROADCAST_BYTES

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                ids, x = np.frombuffer(r.ids, np.int64), np.frombuffer(r.vecs, np.float64).reshape(r.n, -1)
                qids, q = np.frombuffer(r.q_ids, np.int64), np.frombuffer(r.q_vecs, np.float64).reshape(r.q_n, -1)
                if metric == "l2":
                    s = -np.sqrt(np.stack([((x - v) ** 2).sum(axis=1) for v in q]))  # as squares of sums, near vectors would lose their digits
                else:
                    with np.errstate(invalid="ignore", divide="ignore"):
                        s = (q @ x.T) / np.linalg.norm(q, axis=1)[:, None] / np.linalg.norm(x, axis=1)
                    if metric == "angular":
                        s = np.maximum(0, 1 - np.sqrt(np.maximum(0, 2 * (1 - s))) / 2)
                s = np.round(s, 9)
                order = [np.lexsort((ids, -row))[:k] for row in np.where(np.isnan(s), -np.inf, s)]
                of = np.repeat(np.arange(len(q)), [len(o) for o in order])
                at = np.concatenate(order)
                ok = ~np.isnan(s[of, at])
                yield pd.DataFrame({"qid": qids[of][ok], "id": ids[at][ok], "score": s[of, at][ok]})

    if metric not in ("cosine", "angular", "l2"):
        raise ValueError(f"unknown metric {metric}")
    scored = tiles.crossJoin(F.broadcast(blocks) if few else blocks).mapInPandas(best, "qid long, id long, score double")
    w = Window.partitionBy("qid").orderBy(F.col("score").desc(), "id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def hashed(words: list[str]) -> np.ndarray:
    """Signed feature hashing of words to DIM numbers of norm 1; no words: the first axis."""
    v = np.zeros(DIM)
    for w in words:
        d = hashlib.blake2b(w.encode(), digest_size=16).digest()
        v[int.from_bytes(d[:4], "little") % DIM] += (1.0 if d[4] & 1 else -1.0) * (1 + int.from_bytes(d[5:7], "little") % 100 / 400)
    n = np.sqrt((v * v).sum())
    if n == 0:
        v[0] = n = 1.0
    return v / n


def embedding_hash(vector: Column) -> Column:
    """The sha256, in hex, of a vector's bytes as 32-bit floats, by which a changed embedding is told; null for none."""

    @F.pandas_udf("string")
    def digest(x: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else hashlib.sha256(np.asarray(v, "<f4").tobytes()).hexdigest() for v in x], dtype=object)

    return digest(vector)


def hash_embed(tokens: Column) -> Column:
    @F.pandas_udf("array<double>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series([hashed(list(w) if w is not None else []) for w in b])

    return embed(tokens)


def greedy_distinct(frames: DataFrame, threshold: float = 0.85, most: int | None = None, group: str = "video_id", order: str = "ts") -> DataFrame:
    """(group, id) kept in order: a frame stays iff its cosine with every kept one before it is below the threshold, up to ``most`` if given.

    Order decides, so each group is one task; a block of frames is held against all that is kept by one product, and what is left of it
    against itself. The kept vectors lie in one array that grows by doubling."""

    def keep(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([order, "id"])
        kept, n, ids = None, 0, []
        for at in range(0, len(rows), 512):
            part = rows.iloc[at : at + 512]
            x = np.stack(part["embedding"].to_numpy()).astype(float)
            x = x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-12)
            far = (kept[:n] @ x.T).max(axis=0) < threshold if n else np.ones(len(x), bool)
            among = x @ x.T
            new: list[int] = []
            for i in np.flatnonzero(far):
                if (most is None or n + len(new) < most) and (not new or among[i, new].max() < threshold):
                    new.append(i)
            if new:
                if kept is None or n + len(new) > len(kept):
                    bigger = np.empty((max(2 * n, n + len(new), 64), x.shape[1]))
                    bigger[:n] = kept[:n] if n else 0
                    kept = bigger
                kept[n : n + len(new)] = x[new]
                n += len(new)
                ids += part["id"].iloc[new].tolist()
        return pd.DataFrame({group: [rows[group].iloc[0]] * len(ids), "id": ids})

    return frames.groupBy(group).applyInPandas(keep, f"{group} {frames.schema[group].dataType.simpleString()}, id long")


def hash_embed_md5(tokens: DataFrame, dim: int = DIM) -> DataFrame:
    """(id, slot, value) of (id, term) rows: the hashed embedding in sparse form, on the JVM, with md5 as its hash. Norm 1 an id."""
    h = tokens.select("id", F.md5("term").alias("h"))
    number = lambda at, n: F.conv(F.substring("h", at, n), 16, 10).cast("int")
    h = h.select("id", (number(1, 4) % dim).alias("slot"), (F.when(number(5, 1) % 2 == 1, 1.0).otherwise(-1.0) * (1 + number(6, 4) % 100 / 400)).alias("x"))
    sums = h.groupBy("id", "slot").agg(F.sum("x").alias("x"))
    return sums.select("id", "slot", (F.col("x") / F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy("id")))).alias("value"))


def nearest_approx(vectors: DataFrame, queries: DataFrame, k: int, dim: int, tables: int = 72, bits: int = 6, seed: int = 3) -> DataFrame:
    """(qid, id, score, rank) by cosine among rows that share a bucket with the query: in each of ``tables`` tables a bucket is the signs
    of ``bits`` random projections. Buckets this coarse let most pairs through, so no pair is shuffled: packs of either side are multiplied, and
    of each product a query's best k go on among those that share a bucket. Work grows with vectors times queries, memory doesn't."""
    if bits > 8:
        raise ValueError("8 bits a bucket at most")
    planes = np.random.default_rng(seed).standard_normal((tables, bits, dim)).round(6)

    def buckets(x: np.ndarray) -> np.ndarray:
        """(tables, rows) numbers of buckets."""
        return ((np.einsum("nd,tbd->tnb", x, planes, optimize=True) > 0) << np.arange(bits)).sum(axis=2).astype(np.uint8)

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                ids, x = np.frombuffer(r.ids, np.int64), np.frombuffer(r.vecs, np.float64).reshape(r.n, -1)
                qids, q = np.frombuffer(r.q_ids, np.int64), np.frombuffer(r.q_vecs, np.float64).reshape(r.q_n, -1)
                shared = np.zeros((len(q), len(x)), bool)
                for of_q, of_x in zip(buckets(q), buckets(x)):
                    shared |= of_q[:, None] == of_x
                with np.errstate(invalid="ignore", divide="ignore"):
                    s = np.round((q @ x.T) / np.linalg.norm(q, axis=1)[:, None] / np.linalg.norm(x, axis=1), 9)
                shared &= ~np.isnan(s)
                s[~shared] = -np.inf
                order = [np.lexsort((ids, -row))[:k] for row in s]
                of, at = np.repeat(np.arange(len(q)), [len(o) for o in order]), np.concatenate(order)
                ok = shared[of, at]
                yield pd.DataFrame({"qid": qids[of][ok], "id": ids[at][ok], "score": s[of, at][ok]})

    tasks = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tiles, blocks = packed(vectors, "id", "embedding", 2048).repartition(tasks), packed(queries, "qid", "q", BLOCK)
    blocks = blocks.select(F.col("ids").alias("q_ids"), F.col("vecs").alias("q_vecs"), F.col("n").alias("q_n"))
    few = queries.count() * dim * 8 <= BROADCAST_BYTES
    scored = tiles.crossJoin(F.broadcast(blocks) if few else blocks).mapInPandas(best, "qid long, id long, score double")
    w = Window.partitionBy("qid").orderBy(F.col("score").desc(), "id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
