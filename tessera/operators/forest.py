"""A stored forest of random-projection trees for approximate neighbours, kept up lazily.

A tree halves its vectors by planes between two of them until a leaf holds few. Large nodes are split level by level, by joins of rows with
their node's plane; nodes below a size are finished in one task each. Changed vectors only mark the forest as dirty; the next search routes
them to their leaves, and of these splits only those that have grown too large. Leaves lie in hash buckets, of which the touched are rewritten.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.lineage import cut
from tessera.operators.replace import Table
from tessera.operators.vectors import BROADCAST_BYTES, packed
from tessera.streaming.stateful import exists

#: Trees, vectors that a leaf holds at most, vectors below which a node is split by one task, share from which a split is no use.
TREES, LEAF, GROUP, ONE_SIDED = 12, 48, 20_000, 0.95
#: How near a plane a query looks at both sides, as the cosine of its angle to it.
MARGIN = 0.12
#: Queries in a block; rows that a task of a search holds before it drops all but each query's best.
QUERIES, HELD = 4096, 1_000_000
NODE = "node string, plane array<double>"
ENTRY = "leaf string, id long, vec array<double>"


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def bits(ids: np.ndarray, salt: str) -> np.ndarray:
    """A fixed coin for each id."""
    seed = np.frombuffer(salt.encode().ljust(8, b"_")[-8:], np.uint64)[0]
    h = (ids.astype(np.uint64) ^ seed) * np.uint64(0x9E3779B97F4A7C15)
    return (h >> np.uint64(61) & np.uint64(1)).astype(bool)


def grown(node: str, ids: np.ndarray, x: np.ndarray, leaf: int) -> tuple[list, list]:
    """Nodes (node, plane) and leaves (leaf, place in ids) below a node. A plane that leaves nearly all on one side is none: coins decide, and
    who searches goes both ways."""
    nodes, leaves, todo = [], [], [(node, np.arange(len(ids)))]
    while todo:
        name, at = todo.pop()
        if len(at) <= leaf:
            leaves.append((name, at))
            continue
        rng = np.random.default_rng([len(at), int(ids[at].min()) & 0xFFFFFFFF, len(name)])
        plane, side = None, None
        for _ in range(3):
            a, b = unit(x[rng.choice(at, 2, replace=False)])
            s = x[at] @ (a - b) > 0
            if np.linalg.norm(a - b) > 1e-9 and max(s.mean(), 1 - s.mean()) <= ONE_SIDED:
                plane, side = unit(a - b), s
                break
        if side is None:
            side = bits(ids[at], name)
            if side.all() or not side.any():
                side = np.arange(len(at)) % 2 == 0
        nodes.append((name, plane.tolist() if plane is not None else None))
        todo += [(name + "1", at[side]), (name + "0", at[~side])]
    return nodes, leaves


class Forest:
    """In a folder: the nodes, a row for each version of one; the leaves' entries; what has changed and isn't in the leaves yet."""

    def __init__(self, spark: SparkSession, folder: str, leaf: int = LEAF, buckets: int = 32):
        self.spark, self.folder, self.leaf = spark, folder, leaf
        self.leaves = Table(spark, f"{folder}/leaves", ENTRY, "leaf", buckets)

    def nodes(self) -> DataFrame:
        return self.spark.read.schema(NODE).parquet(f"{self.folder}/nodes")

    def pending(self) -> DataFrame:
        """(batch, id, vec): changes by batch, a null vector for what has gone; of one id the last counts."""
        place, shape = f"{self.folder}/pending", "batch long, id long, vec array<double>"
        rows = self.spark.read.schema(shape).parquet(place) if exists(self.spark, place) else self.spark.createDataFrame([], shape)
        return rows.where(F.col("batch") > self.done())

    def done(self) -> int:
        return self.leaves.batches().agg(F.max("batch")).first()[0]

    @property
    def dirty(self) -> bool:
        return not self.pending().isEmpty()

    def status(self) -> DataFrame:
        """(vectors, leaves, nodes, dirty), one row."""
        t = self.leaves.rows().agg(F.count_distinct("id").alias("vectors"), F.count_distinct("leaf").alias("leaves"))
        return t.crossJoin(self.nodes().agg(F.count("*").alias("nodes"))).withColumn("dirty", F.lit(self.dirty))

    @staticmethod
    def build(vectors: DataFrame, folder: str, trees: int = TREES, leaf: int = LEAF, group: int = GROUP, buckets: int = 32) -> Forest:
        """A new forest of vectors (id, embedding); null vectors and those of norm 0 are left out."""
        spark = vectors.sparkSession
        forest = Forest(spark, folder, leaf, buckets)
        rows = usable(vectors).withColumn("node", F.explode(F.array(*[F.lit(f"{t}:") for t in range(trees)])))
        rows = cut(rows)
        small, nodes = None, None
        while True:
            counts = rows.groupBy("node").agg(F.count("*").alias("n"))
            big = F.broadcast(cut(counts.where(F.col("n") > group).select("node")))  # as many as there are groups at most, like their planes
            ready = rows.join(big, "node", "left_anti")
            small = ready if small is None else small.unionByName(ready)
            rows = rows.join(big, "node", "left_semi")
            if rows.isEmpty():
                break
            planes = cut(split_planes(rows))
            nodes = planes if nodes is None else nodes.unionByName(planes)
            rows = cut(moved(rows, F.broadcast(planes)))
        made = finished(small, leaf)
        forest._store(made, nodes, 0)
        return forest

    def _store(self, made: DataFrame, more_nodes: DataFrame | None, batch: int, touched: DataFrame | None = None) -> None:
        made = cut(made)
        nodes = made.where("id is null").select("node", "plane")
        nodes = nodes if more_nodes is None else nodes.unionByName(more_nodes)
        nodes.write.mode("append").parquet(f"{self.folder}/nodes")
        self.leaves.replace(made.where("id is not null").select(F.col("node").alias("leaf"), "id", "vec"), batch, touched)

    def change(self, vectors: DataFrame, gone: DataFrame | None = None) -> None:
        """Note vectors (id, embedding) that are new or changed, those without a direction as gone, and ids that have gone. Nothing is split before it is asked for."""
        last = self.spark.read.parquet(f"{self.folder}/pending").agg(F.max("batch")).first()[0] if exists(self.spark, f"{self.folder}/pending") else self.done()
        vec = F.col("embedding").cast("array<double>")
        rows = vectors.select(F.col("id").cast("long").alias("id"), F.when(F.exists(vec, lambda x: x != 0), vec).alias("vec")).where("id is not null")
        if gone is not None:
            rows = rows.unionByName(gone.select(F.col("id").cast("long").alias("id"), F.lit(None).cast("array<double>").alias("vec")))
        rows.select(F.lit(max(last, self.done()) + 1).cast("long").alias("batch"), "id", "vec").write.mode("append").parquet(f"{self.folder}/pending")

    def refreshed(self) -> int:
        """Bring pending changes into the leaves; how many leaves were touched. Others, and the nodes above, stay as they are."""
        pending = cut(self.pending())
        if pending.isEmpty():
            return 0
        batch = pending.agg(F.max("batch")).first()[0]
        last = pending.groupBy("id").agg(F.max_by(F.struct("vec"), "batch")["vec"].alias("vec"))
        stored = self.leaves.rows()
        old = cut(stored.join(last.select("id"), "id", "left_semi").select("leaf").distinct())
        trees = self.nodes().select(F.split("node", ":")[0].alias("t")).unionByName(stored.select(F.split("leaf", ":")[0].alias("t"))).distinct()
        new = self.routed(last.where("vec is not null").crossJoin(F.broadcast(trees)).select("id", "vec", F.concat("t", F.lit(":")).alias("node")))
        touched = cut(old.unionByName(new.select(F.col("node").alias("leaf"))).distinct())
        kept = stored.join(touched, "leaf", "left_semi").join(last.select("id"), "id", "left_anti").select(F.col("leaf").alias("node"), "id", "vec")
        self._store(finished(kept.unionByName(new.select("node", "id", "vec")), self.leaf), None, batch, touched)
        return touched.count()

    def routed(self, rows: DataFrame) -> DataFrame:
        """rows (id, vec, node) down to their leaves, a level at a time."""
        out, nodes = None, self.nodes()
        while True:
            rows = cut(rows.join(nodes.withColumn("inner", F.lit(True)), "node", "left"))
            there = rows.where("inner is null").select("id", "vec", "node")
            out = there if out is None else out.unionByName(there)
            rows = moved(rows.where("inner").select("id", "vec", "node"), nodes)
            if rows.isEmpty():
                return cut(out)

    def nearest(self, queries: DataFrame, k: int, margin: float = MARGIN, group: int = GROUP) -> DataFrame:
        """(qid, id, score, rank) by cosine among the vectors of the leaves that queries (qid, q), numbered by longs, come to; near a plane they
        go to both sides. Pending changes are brought in first.

        Neither ways nor pairs are shuffled: packs of leaves meet blocks of queries, and each query's best k of a task go on."""
        self.refreshed()
        blocks = query_blocks(queries)
        packs = self._packs(group).crossJoin(blocks)
        scored = packs.mapInPandas(lambda batches: searched(batches, k, margin), "qid long, id long, score double")
        scored = scored.groupBy("qid", "id").agg(F.max("score").alias("score"))  # once for each tree that has the vector in a leaf
        w = Window.partitionBy("qid").orderBy(F.col("score").desc(), "id")
        return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

    def _packs(self, group: int) -> DataFrame:
        """(root, names, sizes, ids, vecs, nodes, planes): the entries of some leaves below a root, leaf by leaf, and the nodes on the ways to
        them. Roots lie at one depth, that of some ``group`` vectors if planes halve them; below a larger one leaves are dealt out by hash."""
        stored = self.leaves.rows()
        n = stored.groupBy(F.split("leaf", ":")[0]).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
        depth = max(0, int(np.ceil(np.log2(max(1, n / group)))))
        root = lambda name: F.left(name, F.locate(":", name) + depth)
        entries = stored.select(root(F.col("leaf")).alias("root"), "leaf", "id", "vec")
        roots = cut(entries.groupBy("root").agg(F.ceil(F.count("*") / group).alias("parts")))
        entries = entries.join(F.broadcast(roots), "root").select("root", F.pmod(F.hash("leaf"), F.col("parts")).alias("part"), "leaf", "id", "vec")
        packs = entries.groupBy("root", "part").applyInPandas(pack, "root string, names array<string>, sizes array<int>, ids binary, vecs binary")
        above = roots.select("root", F.explode(F.sequence(F.locate(":", F.col("root")), F.length("root"))).alias("at"))
        above = above.where(F.col("at") < F.length("root")).select("root", F.left("root", F.col("at")).alias("node"))
        nodes = self.nodes()
        met = nodes.join(F.broadcast(above), "node").select("root", "node", "plane")
        met = met.unionByName(nodes.where(F.length("node") >= F.locate(":", F.col("node")) + depth).select(root(F.col("node")).alias("root"), "node", "plane"))
        ways = met.groupBy("root").agg(F.collect_list(F.struct("node", "plane")).alias("ways")).select("root", F.col("ways.node").alias("nodes"), F.col("ways.plane").alias("planes"))
        return packs.join(ways, "root", "left")


def pack(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["leaf", "id"])
    sizes = rows.groupby("leaf", sort=True).size()
    x = np.stack(rows["vec"].to_numpy()).astype(np.float64)
    return pd.DataFrame({"root": [rows["root"].iloc[0]], "names": [sizes.index.tolist()], "sizes": [sizes.tolist()], "ids": [rows["id"].to_numpy(np.int64).tobytes()], "vecs": [x.tobytes()]})


def query_blocks(queries: DataFrame) -> DataFrame:
    """queries (qid, q) in blocks, broadcast if their bytes are few; null ones and those of norm 0, which have no cosine, are left out."""
    q = usable(queries.select(F.col("qid").alias("id"), F.col("q").alias("embedding")))
    n, width = q.agg(F.count("*"), F.coalesce(F.max(F.size("vec")), F.lit(0))).first()
    blocks = packed(q.repartition(max(1, -(-n // QUERIES))), "id", "vec", QUERIES).select(F.col("ids").alias("q_ids"), F.col("vecs").alias("q_vecs"), F.col("n").alias("q_n"))
    return F.broadcast(blocks) if n * width * 8 <= BROADCAST_BYTES else blocks


def searched(batches: Iterator[pd.DataFrame], k: int, margin: float) -> Iterator[pd.DataFrame]:
    """(qid, id, score) of the k best of a task's packs by query, each id once. Queries go down a pack's nodes together, and a leaf's entries
    are multiplied with those that come to it."""
    held: list[pd.DataFrame] = []

    def best() -> pd.DataFrame:
        rows = pd.concat(held).sort_values(["qid", "score", "id"], ascending=[True, False, True]).drop_duplicates(["qid", "id"])
        return rows.groupby("qid").head(k)

    for b in batches:
        for r in b.itertuples(index=False):
            ids, qids = np.frombuffer(r.ids, np.int64), np.frombuffer(r.q_ids, np.int64)
            x, q = unit(np.frombuffer(r.vecs, np.float64).reshape(len(ids), -1)), unit(np.frombuffer(r.q_vecs, np.float64).reshape(r.q_n, -1))
            ends = np.cumsum(r.sizes)
            leaves = {name: slice(end - size, end) for name, size, end in zip(r.names, r.sizes, ends)}
            nodes = dict(zip(r.nodes, r.planes)) if r.nodes is not None else {}
            s, i = np.full((len(q), k), -np.inf), np.full((len(q), k), -1)
            todo = [(r.root[: r.root.index(":") + 1], np.arange(len(q)))]
            while todo:
                name, at = todo.pop()
                if not len(at) or not (name.startswith(r.root) or r.root.startswith(name)):
                    continue
                if name in nodes:
                    plane = nodes[name]
                    angle = q[at] @ np.asarray(plane, float) if plane is not None else np.zeros(len(at))
                    near = np.abs(angle) < margin if plane is not None else np.ones(len(at), bool)
                    todo += [(name + "1", at[near | (angle > 0)]), (name + "0", at[near | (angle <= 0)])]
                elif name in leaves:
                    found = np.round(q[at] @ x[leaves[name]].T, 9)
                    better = found.max(axis=1) >= s[at, -1]
                    at, found = at[better], found[better]
                    found, of = np.concatenate([s[at], found], axis=1), np.concatenate([i[at], np.broadcast_to(ids[leaves[name]], found.shape)], axis=1)
                    order = np.lexsort((of, -found), axis=1)[:, :k]
                    s[at], i[at] = np.take_along_axis(found, order, 1), np.take_along_axis(of, order, 1)
            of, place = np.nonzero(s > -np.inf)
            held.append(pd.DataFrame({"qid": qids[of], "id": i[of, place], "score": s[of, place]}))
            if sum(map(len, held)) > HELD:
                held = [best()]
    if held:
        yield best()


def dot(a: str, b: str):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def usable(vectors: DataFrame) -> DataFrame:
    rows = vectors.select(F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("vec"))
    return rows.where("id is not null and vec is not null").where(F.exists("vec", lambda x: x != 0))


def split_planes(rows: DataFrame) -> DataFrame:
    """(node, plane) of rows (id, vec, node) of a few large nodes: between the two vectors of a node that hashes pick; none where that leaves nearly all on one side."""
    pick = lambda n: F.min_by("id", F.xxhash64("id", "node", F.lit(n)))
    norm = lambda v: F.transform(v, lambda x: x / F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, y: s + y * y)))
    picked = F.broadcast(rows.groupBy("node").agg(pick(1).alias("a_id"), pick(2).alias("b_id")))
    ends = rows.join(picked, "node").where("id in (a_id, b_id)").groupBy("node")
    two = ends.agg(*[F.first(F.when(F.col("id") == F.col(f"{e}_id"), F.col("vec")), True).alias(e) for e in "ab"]).select("node", norm(F.col("a")).alias("a"), norm(F.col("b")).alias("b"))
    two = two.select("node", F.zip_with("a", "b", lambda x, y: x - y).alias("d"))
    planes = F.broadcast(cut(two.select("node", F.when(F.exists("d", lambda x: F.abs(x) > 1e-9), norm(F.col("d"))).alias("plane"))))
    shares = rows.join(planes, "node").groupBy("node").agg(F.avg(F.when(dot("vec", "plane") > 0, 1.0).otherwise(0.0)).alias("share"))
    even = F.greatest("share", 1 - F.col("share")) <= ONE_SIDED
    return planes.join(shares, "node").select("node", F.when(even, F.col("plane")).alias("plane"))


def moved(rows: DataFrame, planes: DataFrame) -> DataFrame:
    """rows (id, vec, node) one level down."""
    both = rows.join(planes, "node")
    side = F.when(F.col("plane").isNull(), F.pmod(F.xxhash64("id", "node"), F.lit(2)) == 1).otherwise(dot("vec", "plane") > 0)
    return both.select("id", "vec", F.concat("node", F.when(side, "1").otherwise("0")).alias("node"))


def finished(rows: DataFrame, leaf: int) -> DataFrame:
    """(node, id, vec, plane): the leaves' entries below the nodes of rows (node, id, vec), and nodes, those without an id. A node is a task's
    group: of GROUP vectors when a forest is built, of a leaf and what has come to it when it is refreshed."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id")
        ids, x = group["id"].to_numpy(np.int64), np.stack(group["vec"].to_numpy())
        nodes, leaves = grown(group["node"].iloc[0], ids, x, leaf)
        out = [pd.DataFrame({"node": [n for n, _ in nodes], "id": pd.array([None] * len(nodes), "Int64"), "vec": [None] * len(nodes), "plane": [p for _, p in nodes]})]
        out += [pd.DataFrame({"node": name, "id": pd.array(ids[at], "Int64"), "vec": list(x[at]), "plane": None}) for name, at in leaves]
        return pd.concat([o for o in out if len(o)])

    return rows.groupBy("node").applyInPandas(run, "node string, id long, vec array<double>, plane array<double>")
