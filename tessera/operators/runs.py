"""A log of indexing runs: what became of each file, and each run's counts, taken in the pass that writes them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tessera.streaming.stateful import exists

#: started and ended in epoch milliseconds.
RUN = "run long, root string, started long, ended long, status string, total long, processed long, counts map<string, long>"
EVENT = "run long, path string, extension string, modality string, mtime double, status string, reason string, error string, backend string"
STATUSES = ("indexed", "skipped_unchanged", "skipped_unsupported", "purged", "failed")
#: Statuses after which an unchanged file needn't be looked at again.
DONE = ("indexed", "skipped_unchanged", "skipped_unsupported")


class RunLog:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _table(self, name: str, schema: str) -> DataFrame:
        place = f"{self.folder}/{name}"
        return self.spark.read.schema(schema).parquet(place) if exists(self.spark, place) else self.spark.createDataFrame([], schema)

    def runs(self) -> DataFrame:
        """RUN rows of the runs that have ended, well or not."""
        return self._table("runs", RUN)

    def events(self) -> DataFrame:
        return self._table("events", EVENT)

    def next_run(self) -> int:
        return (self.events().agg(F.max("run")).first()[0] or 0) + 1

    def completed(self) -> DataFrame:
        """(path, mtime) that some run has done with; a run that broke off counts as far as it came."""
        return self.events().where(F.col("status").isin(*DONE)).select("path", "mtime").distinct()

    def record(self, run: int, root: str, started: int, ended: int, events: DataFrame, backend: str = "text") -> dict[str, int]:
        """Append a run's events (path, modality, mtime, status, reason, error) and its row; the counts by status, observed while the events
        were written. A status that is none of STATUSES fails the run."""
        known = F.when(F.col("status").isin(*STATUSES), F.col("status")).otherwise(F.raise_error(F.concat(F.lit("no status: "), F.coalesce("status", F.lit("null")))).cast("string"))
        suffix = F.regexp_extract("path", r"(\.[^./\\]+)$", 1)
        rows = events.select(F.lit(run).cast("long").alias("run"), "path", F.lower(suffix).alias("extension"), "modality", F.col("mtime").cast("double").alias("mtime"), known.alias("status"), "reason", "error", F.lit(backend).alias("backend"))
        seen = Observation(f"run-{run}")
        observed = rows.observe(seen, F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in STATUSES])
        observed.write.mode("append").parquet(f"{self.folder}/events")
        counts = {k: int(v) for k, v in seen.get.items()}
        total, failed = counts.pop("total"), counts["failed"]
        status = "completed" if not failed else "completed_with_errors"
        self.spark.createDataFrame([(run, root, started, ended, status, total, total - failed, counts)], RUN).coalesce(1).write.mode("append").parquet(f"{self.folder}/runs")
        return counts | {"total": total}


FEEDBACK = "query string, excluded string, note string, at long"


def append_feedback(spark: SparkSession, folder: str, rows: DataFrame) -> None:
    """Append feedback (query, excluded: an array of paths, note, at) to the log in the folder; the paths as one text, joined by commas."""
    rows.select("query", F.array_join("excluded", ",").alias("excluded"), "note", F.col("at").cast("long").alias("at")).write.mode("append").parquet(f"{folder}/feedback")


def feedback(spark: SparkSession, folder: str) -> DataFrame:
    place = f"{folder}/feedback"
    return spark.read.schema(FEEDBACK).parquet(place) if exists(spark, place) else spark.createDataFrame([], FEEDBACK)
