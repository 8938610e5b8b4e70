"""Incremental maintenance of tables as merges: no row-by-row updates, no constraints, every tie explicit."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.lineage import numbered, unused

TRANSITIONS = [("QUEUED", "FETCHING"), ("FETCHING", "FETCHED"), ("FETCHING", "FAILED"), ("FETCHED", "QUEUED"), ("FAILED", "QUEUED")]


def upsert_newest(old: DataFrame, new: DataFrame, key: str = "path", order: str = "mtime") -> DataFrame:
    """The newest row a key; of equally new ones the old one."""
    new_, n_ = unused(old.unionByName(new, allowMissingColumns=True), "new", "n")
    both = old.withColumn(new_, F.lit(0)).unionByName(new.withColumn(new_, F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(F.col(order).desc(), new_)
    return both.withColumn(n_, F.row_number().over(w)).where(F.col(n_) == 1).drop(n_, new_)


def changed(old: DataFrame, new: DataFrame, key: str = "path", order: str = "mtime", slack: float = 0.001) -> DataFrame:
    """Rows of new that aren't in old with a time within slack."""
    k, t = unused(new, "k", "t")
    o = old.select(F.col(key).alias(k), F.col(order).alias(t))
    return new.join(o, (F.col(key) == F.col(k)) & (F.abs(F.col(order) - F.col(t)) < slack), "left_anti")


def delete_prefix(df: DataFrame, prefix: str, spare: list[str] | None = None) -> DataFrame:
    """Without the rows below a folder, but those of spared categories; /a/b doesn't reach /a/bc."""
    under = (F.col("path") == prefix) | F.startswith("path", F.lit(prefix.rstrip("/") + "/"))
    return df.where(~(under & ~F.col("category").isin(spare))) if spare else df.where(~under)


def requeue(manifest: DataFrame, listing: DataFrame) -> DataFrame:
    """(path, size, modified, state): a listed file stays FETCHED iff it was, with the same size and time; else it is queued."""
    m = manifest.select(F.col("path").alias("p"), F.col("size").alias("s"), F.col("modified").alias("t"), "state")
    same = (F.col("s").eqNullSafe(F.col("size"))) & (F.col("t").eqNullSafe(F.col("modified"))) & (F.col("state") == "FETCHED")
    return listing.join(m, F.col("p") == F.col("path"), "left").select("path", "size", "modified", F.when(same, "FETCHED").otherwise("QUEUED").alias("state"))


def claim(manifest: DataFrame, workers: int) -> DataFrame:
    """Queued files in the order smallest first, dealt to workers in turn: (path, place, worker). A queue of any length is numbered over as
    many tasks as its sort has."""
    q = manifest.where("state = 'QUEUED'").select("path", F.coalesce("size", F.lit(0)).alias("size"))
    return numbered(q, "place", "size", "path").select("path", "place", F.pmod(F.col("place") - 1, F.lit(workers)).alias("worker"))


def guard(changes: DataFrame) -> DataFrame:
    """changes (before, after) with whether the step is allowed."""
    steps = F.array(*[F.lit(f"{a}>{b}") for a, b in TRANSITIONS])
    return changes.withColumn("allowed", F.array_contains(steps, F.concat_ws(">", "before", "after")))


def assemble(pieces: DataFrame, key: str, order: str, text: str, glue: str = "") -> DataFrame:
    """(key, text): pieces of each key joined in order."""
    parts = F.array_sort(F.collect_list(F.struct(order, text)))
    return pieces.groupBy(key).agg(F.array_join(parts[text], glue).alias("text"))


def content_sync(old: DataFrame, new: DataFrame, key: str = "uri") -> DataFrame:
    """(key, change): inserted, updated, unchanged (same hash and same time) or deleted, by one full join."""
    o = old.select(F.col(key).alias("_k"), F.sha2("body", 256).alias("_h"), F.col("updated_at").alias("_u"))
    n = new.select(key, F.sha2("body", 256).alias("h"), F.col("updated_at").alias("u"))
    change = F.when(F.col("_k").isNull(), "inserted").when(F.col(key).isNull(), "deleted").when((F.col("h") == F.col("_h")) & F.col("u").eqNullSafe(F.col("_u")), "unchanged").otherwise("updated")
    return n.join(o, F.col(key) == F.col("_k"), "full_outer").select(F.coalesce(key, "_k").alias(key), change.alias("change"))


def hit_counts(hits: DataFrame) -> DataFrame:
    """(source_path, hit_count, last_seen) from (query, source_path, ts): a query counts once for each path."""
    once = hits.groupBy("query", "source_path").agg(F.max("ts").alias("ts"))
    return once.groupBy("source_path").agg(F.count("*").alias("hit_count"), F.max("ts").alias("last_seen"))
