"""Changes of files, from one listing to the next: created, modified, deleted, and moved.

Two listings give events by one join. On the stream of these events a deletion and a creation of one content within a window are one move:
an outer interval join, so that what finds no partner in time comes out as what it was.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: kind: created, modified or deleted; number tells files of one content apart that were created, or deleted, in one listing.
EVENT = "kind string, path string, hash string, number long, ts timestamp"


def between(before: DataFrame, after: DataFrame, ts) -> DataFrame:
    """EVENT rows from listings (path, hash) to the next: one for each path that came, went or has other content. ts: the time of the second.

    Null hashes are contents of their own that never match. Only files that changed are numbered, in the order of their paths."""
    b, a = before.select("path", F.col("hash").alias("old")), after.select("path", "hash", F.lit(True).alias("there"))
    both = b.withColumn("was", F.lit(True)).join(a, "path", "full_outer")
    kind = F.when(F.col("was").isNull(), "created").when(F.col("there").isNull(), "deleted").when(~F.col("old").eqNullSafe(F.col("hash")), "modified")
    rows = both.select(kind.alias("kind"), "path", F.coalesce("hash", "old").alias("hash")).where("kind is not null")
    number = F.row_number().over(Window.partitionBy("kind", "hash").orderBy("path"))
    return rows.select("kind", "path", "hash", number.cast("long").alias("number"), F.lit(ts).cast("timestamp").alias("ts"))


def sides(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    gone = events.where("kind = 'deleted'").select(F.col("path").alias("source"), F.col("hash").alias("gone_hash"), F.col("number").alias("gone_number"), F.col("ts").alias("gone_ts"))
    come = events.where("kind = 'created'").select(F.col("path").alias("target"), F.col("hash").alias("come_hash"), F.col("number").alias("come_number"), F.col("ts").alias("come_ts"))
    return gone, come


def joined(gone: DataFrame, come: DataFrame, window: str) -> DataFrame:
    """(kind, path, source, ts): created, deleted, or moved from source to path. The k-th deletion of a content in its listing goes with the
    k-th creation in its own: many files of one content, moved at once, make as many rows, not as many as there are pairs."""
    near = F.expr(f"come_ts between gone_ts - interval {window} and gone_ts + interval {window}")
    same = (F.col("gone_hash") == F.col("come_hash")) & (F.col("gone_number") == F.col("come_number")) & near
    kind = F.when(F.col("source").isNull(), "created").when(F.col("target").isNull(), "deleted").otherwise("moved")
    out = gone.join(come, same, "full_outer")
    moved = F.when(F.col("target").isNotNull(), F.col("source"))
    return out.select(kind.alias("kind"), F.coalesce("target", "source").alias("path"), moved.alias("source"), F.coalesce("come_ts", "gone_ts").alias("ts"))


def moves(events: DataFrame, window: str = "10 minutes") -> DataFrame:
    """created, deleted and moved of EVENT rows, in a batch; modified ones don't take part. Within the window a content may find more than one
    partner in other listings: each is a row."""
    return joined(*sides(events), window)


def moves_stream(events: DataFrame, window: str = "10 minutes", delay: str = "1 minute") -> DataFrame:
    """moves() on a stream: a partner is waited for until the watermark has passed the window; later events are left out."""
    gone, come = sides(events)
    return joined(gone.withWatermark("gone_ts", delay), come.withWatermark("come_ts", delay), window)
