"""Structured Streaming forms of the counters and the debounce, with batch twins that give the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.operators.lineage import checkpoints


def accepted(times: list[float], last: float | None, gap: float) -> list[bool]:
    """Leading edge: an event counts iff it is at least gap seconds after the last one that counted."""
    out = []
    for t in times:
        ok = last is None or t - last >= gap
        last = t if ok else last
        out.append(ok)
    return out


def debounce(events: DataFrame, gap: float = 2.0) -> DataFrame:
    """(key, ts) accepted, from (key, ts seconds); a fold in order of time, one key at a time."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ts")
        return rows[accepted(rows["ts"].tolist(), None, gap)][["key", "ts"]]

    return events.select("key", "ts").groupBy("key").applyInPandas(run, "key string, ts double")


def debounce_stream(events: DataFrame, gap: float = 2.0) -> DataFrame:
    """debounce() on a stream: the last accepted time of each key is its state."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("ts")
        last = state.get[0] if state.exists else None
        ok = accepted(rows["ts"].tolist(), last, gap)
        if any(ok):
            state.update((float(rows["ts"][ok].max()),))
        yield rows[ok][["key", "ts"]]

    return events.select("key", "ts").groupBy("key").applyInPandasWithState(run, "key string, ts double", "last double", "append", GroupStateTimeout.NoTimeout)


def hits_stream(events: DataFrame) -> DataFrame:
    """(source_path, hit_count, last_seen): running counts, complete output."""
    return events.groupBy("source_path").agg(F.count("*").alias("hit_count"), F.max("ts").alias("last_seen"))


def trend_stream(events: DataFrame, late: str = "1 day") -> DataFrame:
    """(day, n, value) of closed days; events later than the watermark are left out."""
    g = events.withWatermark("ts", late).groupBy(F.window("ts", "1 day")).agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return g.select(F.to_date("window.start").alias("day"), "n", "value")


def drained(stream: DataFrame, name: str, mode: str, keys: list[str] | None = None, folder: str | None = None) -> DataFrame:
    """Run a stream over all that is there now, each batch to a table of its own below the shared folder, and read what it gave: all rows in
    append mode, the last batch's in complete mode, in update mode each key's from the last batch that has it.

    A batch that is run again writes the same table again. folder: where to go on from an earlier run; by default a new
    one, named so."""
    folder = folder or shared_folder(stream.sparkSession, name)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/progress").foreachBatch(write).trigger(availableNow=True).start()
    q.awaitTermination()
    spark, names = stream.sparkSession, [f.name for f in stream.schema.fields]
    if q.lastProgress is None and not exists(spark, f"{folder}/rows"):
        return spark.createDataFrame([], stream.schema)
    rows = spark.read.option("basePath", f"{folder}/rows").parquet(f"{folder}/rows/*")
    if mode == "complete":
        rows = rows.where(F.col("batch") == rows.agg(F.max("batch")).first()[0])
    elif mode == "update":
        rows = rows.groupBy(*keys).agg(F.max(F.struct("batch", *[n for n in names if n not in keys])).alias("row")).select(*keys, *[F.col("row")[n].alias(n) for n in names if n not in keys])
    return rows.select(*names)


def drained_to_end(stream: DataFrame, last: DataFrame, shape, mode: str = "append", keys: list[str] | None = None) -> DataFrame:
    """drained() over a stream and, once that is through, over some rows that end it, by which the watermark passes all others.

    last: rows of the stream's columns, of times after all others; shape: a function from the joined stream to what is asked."""
    spark = stream.sparkSession
    folder = shared_folder(spark, "stream")
    last.limit(0).write.parquet(f"{folder}/last")
    joined = shape(stream.unionByName(spark.readStream.schema(stream.schema).parquet(f"{folder}/last")))
    drained(joined, "stream", mode, keys, folder)
    last.write.mode("append").parquet(f"{folder}/last")
    return drained(joined, "stream", mode, keys, folder)


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A new folder's path below the one that driver and executors share."""
    checkpoints(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{kind}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
