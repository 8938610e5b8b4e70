"""Exact top-k by inner product with Fagin's threshold algorithm.

Candidates are dealt into tiles. A tile holds, for each dimension, its rows sorted by that component. For a query the lists are read
side by side, from the end that helps it; every row met is scored in full, and reading stops once the bound, the score of a row that
had the last component read in every list, is below the k-th best score: no unread row can then enter, nor tie. Scores are integers.
Each pair of a query block and a tile is one unit of work and returns at most k rows a query; a window keeps the best k of all.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import table
from tessera.llm.tiles import each, finite, pack

#: Rows in a tile of candidates and in a block of queries, about.
TILE, BLOCK = 8192, 1024


def product(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exact: as float64 where no sum can pass 2^53, else as 64-bit integers where none can pass 2^63,
    else as Python's, which must then fit into 64 bits."""
    most = float(np.abs(x).max(initial=0)) * float(np.abs(q).sum())
    if most < 2**53:
        return (x @ q).astype(np.int64)
    if most < 2**62:
        return x.astype(np.int64) @ q.astype(np.int64)
    out = x.astype(np.int64).astype(object) @ q.astype(np.int64).astype(object)
    if any(not -(2**63) <= v < 2**63 for v in np.atleast_1d(out)):
        raise ArithmeticError("a score does not fit into 64 bits")
    return np.asarray(out, np.int64)


def bound(last: np.ndarray, q: np.ndarray) -> float:
    """At least the inner product: a float64 sum with room for its rounding."""
    each = last * q
    return float(each.sum() + np.abs(each).sum() * (2.0**-50) * len(q))


class Lists:
    """A tile's vectors (whole numbers) with a sorted list for each dimension."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, copies: np.ndarray | None = None):
        self.ids, self.x, self.copies = ids, x, np.ones(len(ids), np.int64) if copies is None else copies
        self.order = np.argsort(x, axis=0, kind="stable")
        self.sorted = np.take_along_axis(x, self.order, axis=0)

    def top(self, q: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Ids and scores of the k best rows but those with id ``own``, each as often as it has copies, ties to smaller ids; how many rows
        were scored."""
        n, used = len(self.ids), np.nonzero(q)[0]
        seen = self.ids == own
        met = int(seen.sum())
        if not len(used):
            best = np.sort(np.repeat(self.ids, np.where(seen, 0, self.copies)))[:k]
            return best, np.zeros(len(best), np.int64), 0
        signs = q[used] > 0
        ids, scores, depth, step, scored = np.empty(0, np.int64), np.empty(0, np.int64), 0, 4 * k, 0
        while depth < n:
            until = min(n, depth + step)
            at = np.arange(depth, until)[:, None]
            rows = np.unique(self.order[np.where(signs, n - 1 - at, at), used])
            rows = rows[~seen[rows]]
            seen[rows] = True
            scored += len(rows)
            ids = np.concatenate([ids, np.repeat(self.ids[rows], self.copies[rows])])
            scores = np.concatenate([scores, np.repeat(product(self.x[rows], q), self.copies[rows])])
            best = np.lexsort((ids, -scores))[:k]
            ids, scores = ids[best], scores[best]
            depth, step = until, step * 2
            last = np.where(signs, self.sorted[n - depth, used], self.sorted[depth - 1, used])
            if scored + met == n or len(ids) == k and scores[-1] > bound(last, q[used]):
                break
        return ids, scores, scored


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024, tile: int = TILE, block: int = BLOCK, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, <id>, score): for each row of ``queries`` the k rows of ``vectors``, but that of its own id, with the highest
    inner product of floor(scale * x); all of them, if fewer; ties to the smaller id.

    Vectors that are null, empty or hold null or non-finite components take no part, nor do null ids; only vectors of one length
    meet. Every row counts: rows that share an id are candidates of their own, and queries of their own, whose rows stand under the one
    query_id; a row repeated in ``vectors`` is there as often in the k, and one repeated in ``queries`` is answered as often. A component
    beyond 2^53 when scaled, or a score beyond 64 bits, fails the job with an ArithmeticError. Empty tables, of either kind, give no rows.
    Other columns are ignored.
    """
    kind = vectors.schema[id_col].dataType.simpleString()

    def whole(df: DataFrame, size: int) -> DataFrame:
        rows = df.select(df[id_col].cast("long").alias("id"), df[vec_col].cast("array<double>").alias("vec")).where(F.col("id").isNotNull() & finite("vec"))
        whole = F.transform("vec", lambda x: F.when(F.abs(x * scale) <= 2.0**53, F.floor(x * scale).cast("double")).otherwise(F.raise_error(F.lit("ArithmeticError: a scaled component is beyond 2^53")).cast("double")))
        rows = rows.select("id", whole.alias("vec")).groupBy("id", "vec").agg(F.count("*").alias("copies"))
        rows = rows.withColumn("dim", F.size("vec"))
        tiles = rows.groupBy("dim").agg(F.ceil(F.count("*") / size).alias("tiles"))
        return pack(rows.join(tiles, "dim").withColumn("tile", F.pmod(F.xxhash64("id", "vec"), F.col("tiles"))), ["dim", "tiles", "tile"])

    tiles, blocks = whole(vectors, tile), whole(queries, block)
    # Each tile goes to every block of queries: these carry the tile numbers, so that both sides meet on an even key.
    n_tiles = tiles.groupBy("dim").agg(F.max("tiles").alias("t"))
    n_blocks = blocks.groupBy("dim").agg(F.max("tiles").alias("b"))
    left = tiles.drop("tiles").join(n_blocks, "dim").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("b") - 1))).drop("b", "keys")
    right = blocks.select("dim", F.col("tile").alias("block"), F.col("ids").alias("q_ids"), F.col("vecs").alias("q_vecs"), F.col("copies").alias("q_copies"), F.col("n").alias("q_n")).join(n_tiles, "dim")
    right = right.withColumn("tile", F.explode(F.sequence(F.lit(0).cast("long"), F.col("t") - 1))).drop("t")
    columns = ["query_id", "block", "number", "times", "id", "score"]

    def work(row) -> dict:
        copies = np.minimum(np.frombuffer(row.copies, np.int64), k)  # more of one row can't be among k
        lists = Lists(np.frombuffer(row.ids, np.int64), np.frombuffer(row.vecs, np.float64).reshape(row.n, -1), copies)
        q_ids, q = np.frombuffer(row.q_ids, np.int64), np.frombuffer(row.q_vecs, np.float64).reshape(row.q_n, -1)
        found = [lists.top(v, own, k)[:2] for own, v in zip(q_ids, q)]
        of = np.repeat(np.arange(len(q)), [len(i) for i, _ in found])
        return {"query_id": q_ids[of], "block": row.block, "number": of, "times": np.frombuffer(row.q_copies, np.int64)[of], "id": np.concatenate([i for i, _ in found]), "score": np.concatenate([s for _, s in found])}

    met = left.join(right, ["dim", "tile", "block"]).repartition(F.col("tile"), F.col("block"))
    found = met.mapInPandas(each(work, columns), "query_id long, block long, number long, times long, id long, score long")
    # A query is told by its block and its number there: pack() sorts by id, then vector, so that every tile sees it under the same number.
    best = Window.partitionBy("query_id", "block", "number").orderBy(F.col("score").desc(), "id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    ranked = ranked.withColumn("time", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    return ranked.select(F.col("query_id").cast(kind), F.col("rank").cast("int"), F.col("id").cast(kind).alias(id_col), "score")


def op3_exact_topk(spark, sf_dir: str) -> DataFrame:
    """top_k() of the embeddings whose vec_id is divisible by 100 against all."""
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where("vec_id % 100 = 0"))
