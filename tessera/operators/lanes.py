"""Lanes of a search side by side, each with a time limit of its own: what is late or fails is left out, and said so."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from threading import Event, Thread

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession

from tessera.operators import fusion
from tessera.streaming.stateful import shared_folder

#: Seconds that a lane of each kind may take.
LIMITS = {"text": 8.0, "audio": 8.0, "image": 10.0, "video": 12.0}
LIMIT = 8.0
ERROR = "modality string, error string, seconds double"


def run(spark: SparkSession, lanes: dict[str, Callable[[], DataFrame]], limits: dict[str, float] | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """The lanes that were through in time, as written tables, and (modality, error, seconds) of the others: `timeout`, or what went wrong.

    Each lane is planned and written in a thread of its own, under a tag by which its jobs, and no others, are cancelled when its time is
    over. limits: seconds by lane."""
    limits = LIMITS | (limits or {})
    folder = shared_folder(spark, "lanes")

    def one(name: str, lane: Callable[[], DataFrame]) -> tuple[str, DataFrame | None, str | None, float]:
        tag, late, through, began = f"lane-{name}-{uuid.uuid4().hex}", Event(), Event(), time.monotonic()

        def watch() -> None:
            if not through.wait(limits.get(name, LIMIT)):
                late.set()
                while not through.wait(0.2):  # a lane may be between two jobs, or before its first
                    spark.sparkContext.cancelJobsWithTag(tag)

        watcher, out, error = Thread(target=watch, daemon=True), None, None
        spark.sparkContext.addJobTag(tag)
        watcher.start()
        try:
            rows = lane()
            if not late.is_set():
                rows.write.parquet(f"{folder}/{name}")
                out = spark.read.schema(rows.schema).parquet(f"{folder}/{name}")
        except Exception as e:  # whatever a lane fails of, the others answer
            error = f"{type(e).__name__}: {str(e).splitlines()[0][:300] if str(e) else ''}"
        finally:
            through.set()
            watcher.join()
            spark.sparkContext.removeJobTag(tag)
        if late.is_set():
            out, error = None, "timeout"
        return name, out, error, time.monotonic() - began

    done: list[tuple] = []
    threads = [InheritableThread(lambda n=n, f=f: done.append(one(n, f))) for n, f in lanes.items()]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    return {n: out for n, out, _, _ in done if out is not None}, spark.createDataFrame([(n, e, s) for n, _, e, s in done if e is not None], ERROR)


def unified(spark: SparkSession, lanes: dict[str, Callable[[], DataFrame]], k: int, limits: dict[str, float] | None = None) -> tuple[DataFrame | None, DataFrame]:
    """fusion.unified() of the lanes (qid, item, score) that were through in time, null if none was, and the others' errors."""
    found, errors = run(spark, lanes, limits)
    return (fusion.unified({n: found[n] for n in lanes if n in found}, k) if found else None), errors
