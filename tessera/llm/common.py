"""Shared parts of the training-data operators: storage for cut lineages, word and shingle hashing, components."""

from __future__ import annotations

import ctypes
import gc
import hashlib
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and read it from there, so that lost executors cost no recomputation.

    The folder is the session's ``spark.checkpoint.dir``; where that is unset, the caller must have set one on the context.
    """
    cut_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_dir(spark: SparkSession) -> None:
    """See that the context has a checkpoint folder: that of ``spark.checkpoint.dir``, or, on a local master only, a temporary one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """These names, each made longer until no column of df has it, in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def cut_table(df: DataFrame, scratch: list[str] | None = None) -> DataFrame:
    """As cut(), but as Parquet: smaller where rows are many, and read by column. scratch: a list that the table's path is added to."""
    cut_dir(df.sparkSession)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if scratch is not None:
        scratch.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_tables(spark: SparkSession, scratch: list[str]) -> None:
    """Delete tables that cut_table() has written, once all that reads them has been written itself."""
    for path in scratch:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    scratch.clear()


def release() -> None:
    """Give what a Python worker has freed back to the system: idle workers stay in memory beside the next stage's tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # no such call in this C library
        gc.collect()


#: Edges that one task reads in a round of components(), about.
EDGES = 1 << 16


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of undirected edges (u, v): rows (node, component), component the smallest node.

    Alternating large-star and small-star contraction: each round is two aggregations by node, joined back to the edges, so
    a hub's edges are combined map-side and split by AQE; rounds grow with the logarithm of a component's diameter. Nodes
    without an edge to another node are not returned. Null ends are ignored.
    """
    e = edges.select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).where("u is not null and v is not null and u <> v").distinct()
    e, before = cut(e), None
    for _ in range(max_rounds):
        if before:  # edges don't grow in number, and few of them need few tasks and files
            e = e.coalesce(before[0] // EDGES + 1)
        now = e.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()
        if now[0] == 0 or now == before:
            break
        before = now
        both = e.select(F.col("a").alias("n"), F.col("b").alias("o")).unionByName(e.select(F.col("b").alias("n"), F.col("a").alias("o")))
        least = both.groupBy("n").agg(F.min("o").alias("m"))
        large = both.join(least, "n").where("o > n").select(F.col("o").alias("a"), F.least("m", "n").alias("b")).distinct()
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lower, "a")
        e = cut(small.select("a", F.col("m").alias("b")).unionByName(small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct())
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 and edges a-b, the smallest node of each node's component."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            break
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root


class WordHashes(dict):
    """64-bit hash of a word's bytes; kept for words seen before, up to ``limit`` of them."""

    limit = 100_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        self[word] = h
        return h


MULTIPLIERS = tuple(int(x) | 1 for x in np.random.default_rng(5).integers(1, 2**63, 8))


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingle_hashes(text: str | None, cache: WordHashes, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the text's ``width``-word shingles; fewer words: the whole sequence as one; none: empty.

    Words are runs other than space, tab, line feed, vertical tab, form feed and carriage return, with A-Z lower-cased:
    exactly what lower() and split() do to bytes.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(cache.__getitem__, words), np.uint64, n)
    k = min(width, n)
    out = np.full(n - k + 1, k, np.uint64)
    for i in range(k):
        out = out * np.uint64(MULTIPLIERS[i]) + h[i : n - k + 1 + i]
    return np.unique(mix(out))


def crc_train(id_col: str) -> F.Column:
    """Whether a row's labels may be learned from: crc32 of the id as text is not divisible by 5."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 != 0
