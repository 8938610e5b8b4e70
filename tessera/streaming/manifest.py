"""The fetch manifest as a state machine on a stream, and its batch twin.

A file is QUEUED, FETCHING by a worker with a lease, FETCHED or FAILED. Events that a state doesn't allow are without effect. A lease
that runs out puts the file back into the queue and drops the pieces that had come. Events may come in any order within the
watermark's delay: they wait until the watermark has passed them, so what is given depends on their times alone, not on batches or restarts.
"""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: at: when, in milliseconds; n: tells events of one time apart. listed: size and modified; claim: worker; piece: worker, number, text; done:
#: worker, number (of pieces); failed: worker, text (the error); requeue.
EVENT = "path string, at long, n long, kind string, worker string, size long, modified string, number int, text string"
COLUMNS = [c.split()[0] for c in EVENT.split(", ")]
#: One row for each change of a file's state; content with FETCHED, error with FAILED.
CHANGE = "path string, seq long, at long, before string, after string, worker string, content string, error string"
FILE = "state string, size long, modified string, worker string, until long, seq long"
LEASE_MS = 10 * 60 * 1000
EXPIRED = "lease expired"


class File:
    """One file's state, the pieces that have come, and the changes so far."""

    def __init__(self, path: str, state=None, size=None, modified=None, worker=None, until=None, seq=0, pieces=None):
        self.path, self.state, self.size, self.modified, self.worker, self.until, self.seq = path, state, size, modified, worker, until, seq
        self.pieces: dict[int, str] = pieces or {}
        self.changes: list[tuple] = []

    def row(self) -> tuple:
        return self.state, self.size, self.modified, self.worker, self.until, self.seq

    def to(self, after: str, at: int, worker=None, until=None, content=None, error=None) -> None:
        self.changes.append((self.path, self.seq, at, self.state, after, worker if worker is not None else self.worker, content, error))
        self.state, self.worker, self.until, self.seq = after, worker, until, self.seq + 1
        self.pieces = {}

    def expire(self, now: int) -> None:
        if self.state == "FETCHING" and self.until <= now:
            self.to("QUEUED", self.until, error=EXPIRED)

    def take(self, e, lease: int) -> None:
        """One event, after all earlier ones."""
        self.expire(e.at)
        if e.kind == "listed":
            same = self.state == "FETCHED" and (self.size, self.modified) == (e.size, e.modified)
            self.size, self.modified = e.size, e.modified
            if self.state is None or self.state != "QUEUED" and not same:
                self.to("QUEUED", e.at)
        elif e.kind == "claim" and self.state == "QUEUED":
            self.to("FETCHING", e.at, worker=e.worker, until=e.at + lease)
        elif e.kind == "requeue" and self.state in ("FETCHED", "FAILED"):
            self.to("QUEUED", e.at)
        elif self.state == "FETCHING" and e.worker == self.worker:  # of a worker that has lost its lease nothing counts
            if e.kind == "piece" and e.number is not None and e.number >= 0:
                self.pieces[e.number] = e.text or ""
            elif e.kind == "failed":
                self.to("FAILED", e.at, error=e.text)
            elif e.kind == "done":
                missing = [i for i in range(e.number or 0) if i not in self.pieces]
                if missing:
                    self.to("FAILED", e.at, error=f"{len(missing)} of {e.number} pieces missing")
                else:
                    self.to("FETCHED", e.at, content="".join(self.pieces[i] for i in range(e.number or 0)))


def whole(v):
    """A pandas cell as Python's: NaN, NaT and NA as None, whole numbers as int."""
    return None if v is None or v is pd.NA or v != v else int(v) if isinstance(v, (int, float)) or hasattr(v, "item") else v


Event = namedtuple("Event", COLUMNS)


def in_order(rows: list[tuple]) -> list:
    """EVENT rows by time, then number; repeated deliveries of one event count once."""
    return [Event(*r) for r in sorted({(r[1], r[2]): r for r in rows}.values(), key=lambda r: (r[1], r[2]))]


def replayed(events: DataFrame, lease: int = LEASE_MS, now: int | None = None) -> DataFrame:
    """CHANGE rows of events (EVENT), one file at a time; leases that have run out by ``now`` (by default, all) end too."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        file = File(rows["path"].iloc[0])
        for e in in_order([tuple(map(whole, r)) for r in rows[COLUMNS].astype(object).itertuples(index=False)]):
            file.take(e, lease)
        file.expire(now if now is not None else 2**62)
        return pd.DataFrame(file.changes, columns=[c.split()[0] for c in CHANGE.split(", ")])

    return events.where("path is not null").groupBy("path").applyInPandas(run, CHANGE)


class Machine(StatefulProcessor):
    """File by path: a value for its state, lists for its pieces and for events that the watermark hasn't passed, timers for both."""

    def __init__(self, lease: int):
        self.lease = lease

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.file = handle.getValueState("file", FILE)
        self.pieces = handle.getListState("pieces", "number int, text string")
        self.waiting = handle.getListState("waiting", EVENT)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            events = [tuple(map(whole, r)) for r in frame[COLUMNS].astype(object).itertuples(index=False)]
            self.waiting.appendList(events)
            for at in {e[1] for e in events}:
                self.handle.registerTimer(at)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        waiting = [tuple(map(whole, r)) for r in self.waiting.get()]
        due, rest = [r for r in waiting if r[1] <= now], [r for r in waiting if r[1] > now]
        row = self.file.get() if self.file.exists() else (None,) * 5 + (0,)
        file = File(key[0], *map(whole, row), pieces={int(i): t for i, t in self.pieces.get()})
        before = dict(file.pieces)
        for e in in_order(due):
            file.take(e, self.lease)
        file.expire(now)
        if due or file.changes:
            self.file.update(file.row())
        if file.pieces != before:
            self.pieces.clear()
            if file.pieces:
                self.pieces.put(list(file.pieces.items()))
        if due:
            self.waiting.clear()
            if rest:
                self.waiting.put(rest)
        if file.state == "FETCHING" and file.changes:
            self.handle.registerTimer(file.until)
        if file.changes:
            yield pd.DataFrame(file.changes, columns=[c.split()[0] for c in CHANGE.split(", ")])

    def close(self) -> None:
        pass


def machine(events: DataFrame, lease: int = LEASE_MS, delay: str = "1 minute") -> DataFrame:
    """replayed() on a stream of EVENT rows, as far as the watermark has come; a row with a null path only moves the watermark."""
    timed = events.select(*COLUMNS, F.timestamp_millis("at").alias("time")).withWatermark("time", delay)
    return timed.withColumn("path", F.coalesce("path", F.lit(""))).groupBy("path").transformWithStateInPandas(Machine(lease), CHANGE, "append", "eventTime").where("path <> ''")


def with_state_store(spark: SparkSession) -> None:
    """Use the state store that lists and timers need; streams keep the one they began with in their checkpoint."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
