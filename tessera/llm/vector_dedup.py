"""Near-duplicate vectors by int8 tile products with error bounds.

Vectors of one label are dealt into tiles; each pair of tiles is one unit of work. Unit vectors v are held as s * q + e with q
in int8 and the norm of e known for each vector, so |cos(a, b) - s_a s_b q_a.q_b| <= |e_a| |s_b q_b| + |e_b| |s_a q_a| + |e_a| |e_b|
holds rigorously. Tile products of the q (exact in float32: sums stay under 2^24) with that bound leave the pairs possibly above the
threshold, and only those are computed from the vectors in double precision. From 1,040 components on the tile products are taken in
float64, where they are exact again. A unit of work returns counts for each vector and a
spanning forest of its links, never the pairs themselves, so its output stays within the size of its two tiles.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import components, cut, roots, table
from tessera.llm.tiles import finite, pack

THRESHOLD = 0.98
#: Vectors in a tile, about.
TILE = 4096
#: Rows of a tile that are multiplied at once, and pairs that are computed in double precision at once.
ROWS, PAIRS = 512, 100_000


def quantised(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes (int8), scales, and upper bounds for the norms of the coded vectors and of the errors."""
    scale = np.abs(unit).max(axis=1) / 127
    q = np.rint(unit / scale[:, None]).astype(np.int8)
    coded = q * scale[:, None]
    return q, scale, np.linalg.norm(coded, axis=1) * (1 + 1e-12), np.linalg.norm(unit - coded, axis=1) * (1 + 1e-12) + 1e-12


def tile_links(a: np.ndarray, b: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray, int]:
    """Index pairs (of a, of b) with cosine >= threshold, and how many were computed in full; same: a is b, pairs once."""
    # A power of two for each vector changes no cosine, and keeps squares of large and small components in range.
    a, b = (np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None]) for x in (a, b))
    exact = np.float32 if a.shape[1] < 1040 else np.float64
    ua, ub = a / np.linalg.norm(a, axis=1)[:, None], b / np.linalg.norm(b, axis=1)[:, None]
    qa, sa, na, ea = quantised(ua)
    qb, sb, nb, eb = quantised(ub)
    codes, most_n, most_e = qb.astype(exact).T.copy(), nb.max(), eb.max()
    #: In units of s_a, as float32, with room for its rounding.
    least = ((threshold - (ea * most_n + most_e * na + ea * most_e) - 1e-5) / sa).astype(np.float32)
    sb32, left, right, tried = sb.astype(np.float32), [], [], 0
    norm_a, norm_b = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
    for r in range(0, len(a), ROWS):
        from_column = r if same else 0
        near = qa[r : r + ROWS].astype(exact) @ codes[:, from_column:]
        near *= sb32[from_column:]
        i, j = np.nonzero(near >= least[r : r + ROWS, None])
        i, j = i + r, j + from_column
        if same:
            i, j = i[j > i], j[j > i]
        tried += len(i)
        for k in range(0, len(i), PAIRS):
            x, y = i[k : k + PAIRS], j[k : k + PAIRS]
            ok = np.einsum("ij,ij->i", a[x], b[y]) / (norm_a[x] * norm_b[y]) >= threshold
            left.append(x[ok])
            right.append(y[ok])
    none = [np.empty(0, np.int64)]
    return np.concatenate(left or none), np.concatenate(right or none), tried


def link_vectors(vectors: DataFrame, threshold: float = THRESHOLD, tile: int = TILE, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, n_links, component_id, kept) for each row: links join vectors of equal, non-null label with cosine >= threshold.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do vectors of different
    lengths. Rows that share an id stay rows of their own, each with the links of its own vector, but are one node of the graph that
    component_id is taken from. A row with a null id links with nothing, has a null component_id and is kept. Equal vectors are
    compared once and counted as often as they occur; copies of each other are linked. Empty tables give no rows. Other columns are
    ignored, whatever their names.
    """
    kind = vectors.schema[id_col].dataType.simpleString()
    rows = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[label_col].alias("label"), vectors[vec_col].cast("array<double>").alias("vec"))
    text = F.concat_ws(",", F.transform("vec", lambda x: x.cast("string")))
    valid = F.col("id").isNotNull() & F.col("label").isNotNull() & finite("vec") & F.exists("vec", lambda x: x != 0)
    rows = cut(rows.select("id", "label", "vec", F.when(valid, F.sha2(F.concat_ws("|", F.col("label").cast("string"), text), 256)).alias("same")))
    used = rows.where("same is not null")
    distinct = used.groupBy("same").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    one = used.groupBy("same").agg(F.min("label").alias("label"), F.min("vec").alias("vec"))
    reps = distinct.join(one, "same").select(F.xxhash64("same").alias("key"), F.col("rep").alias("id"), "label", "vec", "copies", F.size("vec").alias("dim"))
    tiles = reps.groupBy("label", "dim").agg(F.ceil(F.count("*") / tile).alias("tiles"))
    placed = reps.join(tiles, ["label", "dim"]).withColumn("tile", F.pmod(F.col("key"), F.col("tiles")))
    packed = pack(placed, ["label", "dim", "tiles", "tile"])
    other = packed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    pairs = other.select("label", "dim", F.least("tile", "other").alias("p"), F.greatest("tile", "other").alias("q"), "tile", "ids", "keys", "copies", "vecs", "n")

    def work(group: pd.DataFrame) -> pd.DataFrame:
        parts = [(np.frombuffer(r.ids, np.int64), np.frombuffer(r.keys, np.int64), np.frombuffer(r.copies, np.int64), np.frombuffer(r.vecs, np.float64).reshape(r.n, -1)) for r in group.sort_values("tile").itertuples()]
        if len(parts) == 1 and group["p"].iloc[0] != group["q"].iloc[0]:  # the other tile is empty
            return pd.DataFrame({"key": [], "n": [], "id": [], "root": []})
        (ids, keys, count, x), (ids_b, keys_b, count_b, y), same = parts[0], parts[-1], len(parts) == 1
        i, j, _ = tile_links(x, y, threshold, same)
        if same:
            n = np.bincount(i, count[j], len(ids)) + np.bincount(j, count[i], len(ids))
        else:
            n = np.concatenate([np.bincount(i, count_b[j], len(ids)), np.bincount(j, count[i], len(ids_b))])
            j, ids, keys = j + len(ids), np.concatenate([ids, ids_b]), np.concatenate([keys, keys_b])
        order = np.argsort(ids, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        root = ids[order][roots(len(ids), place[i], place[j])[place]]
        linked = n > 0
        return pd.DataFrame({"key": keys[linked], "n": n[linked].astype(np.int64), "id": ids[linked], "root": root[linked]})

    found = cut(pairs.groupBy("label", "dim", "p", "q").applyInPandas(work, "key long, n long, id long, root long"))
    counts = found.groupBy("key").agg(F.sum("n").alias("n"))
    class_of = distinct.select("same", "rep", "copies", F.xxhash64("same").alias("key")).join(counts, "key", "left").select("same", "rep", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"))
    member = cut(rows.select("id", "same").join(class_of, "same", "left").select("id", "rep", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")))
    edges = found.select(F.col("id").alias("u"), F.col("root").alias("v")).unionByName(member.where("id <> rep").select(F.col("id").alias("u"), F.col("rep").alias("v")))
    whole = components(edges)
    out = member.join(whole, member["id"] == whole["node"], "left").select("id", "n_links", F.coalesce("component", "id").alias("component_id"))
    out = out.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)))
    return out.select(F.col("id").cast(kind).alias(id_col), "n_links", "component_id", "kept")


def op1_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    """link_vectors() of all embeddings: one row for each vector."""
    return link_vectors(table(spark, sf_dir, "embeddings"))
