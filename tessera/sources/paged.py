"""Services that answer page by page, as a Spark source: batch and stream readers that follow cursors, wait and try again.

A service lists collections, and a collection's objects that were edited within a span of time, each list in answers that name the next
one's cursor. Cursors can only be followed one by one, so the reader is parallel over collections: the driver lists these, tasks list
what they hold. A stream's offset is a time of edits, not a cursor: the span between two offsets can be asked again after a restart.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

# Tries of a request, the statuses that are worth another try, results of an answer.
ATTEMPTS, AGAIN, SIZE = 5, (500, 502, 503, 504), 100
#: Paths whose recorded answers lie in one bucket.
PER_BUCKET = 500
SCHEMA = "collection string, id string, edited long, body string"


class ServiceError(Exception):
    """An answer that no further try will mend."""

    def __init__(self, status: int, detail: str = ""):
        super().__init__(f"the service answered {status}: {detail}")
        self.status = status


class Http:
    """Answers over HTTP, with a bearer token if there is one."""

    def __init__(self, base: str, token: str | None = None, timeout: float = 30.0):
        self.base, self.timeout = base.rstrip("/"), timeout
        self.headers = {"Accept": "application/json"} | ({"Authorization": f"Bearer {token}"} if token else {})

    def get(self, path: str, params: dict, attempt: int) -> tuple[int, dict, dict]:
        url = f"{self.base}/{path}?{urllib.parse.urlencode(params)}"
        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers=self.headers), timeout=self.timeout) as r:
                return r.status, dict(r.headers), json.loads(r.read())
        except urllib.error.HTTPError as e:
            return e.code, dict(e.headers), {"detail": e.read().decode("utf-8", "replace")}
        except (urllib.error.URLError, TimeoutError) as e:
            return 503, {}, {"detail": str(e)}


class Recorded:
    """Answers that record() has written below a folder which driver and executors share; only the files asked for are read. Who asks for many
    paths does so bucket by bucket (placed()), or a bucket is read again for each of them."""

    def __init__(self, folder: str):
        self.folder, self.held = folder, {}

    def answers(self, path: str) -> dict:
        system, root = opened(self.folder)
        if "n" not in self.held:
            self.held["n"] = buckets_of(self.folder)
        bucket = zlib.crc32(path.encode()) % self.held["n"]
        if self.held.get("bucket") != bucket:  # one at a time: a bucket's size is the caller's choice
            files = system.get_file_info(pafs.FileSelector(f"{root}/answers/bucket={bucket}", allow_not_found=True))
            found = {}
            for info in files:
                if info.base_name.startswith("part-"):
                    with system.open_input_stream(info.path, compression=None) as f:
                        found |= {(r["path"], r["cursor"]): r for r in map(json.loads, f.read().decode().splitlines())}
            self.held |= {"bucket": bucket, "found": found}
        return self.held["found"]

    def get(self, path: str, params: dict, attempt: int) -> tuple[int, dict, dict]:
        found = self.answers(path).get((path, str(params.get("cursor", ""))))
        if found is None:
            return 404, {}, {"detail": f"no object {path}"}
        status = found["statuses"][min(attempt, len(found["statuses"]) - 1)]
        if status != 200:
            return status, {"Retry-After": "1"}, {}
        results = [json.loads(r) for r in found["results"]]
        since, until = params.get("since"), params.get("until")
        kept = [r for r in results if (since is None or r["edited"] > int(since)) and (until is None or r["edited"] <= int(until))] if since is not None or until is not None else results
        return 200, {}, {"results": kept, "next_cursor": found.get("next"), "has_more": found.get("next") is not None}


def opened(folder: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a shared folder: a plain or file: path, or any URI that pyarrow knows."""
    if folder.startswith("file:"):
        folder = "/" + folder[5:].lstrip("/")
    return (pafs.LocalFileSystem(), folder) if folder.startswith("/") else pafs.FileSystem.from_uri(folder)


def transport(url: str, token: str | None = None) -> Http | Recorded:
    return Http(url, token) if url.startswith(("http://", "https://")) else Recorded(url)


def buckets_of(folder: str) -> int:
    system, root = opened(folder)
    with system.open_input_stream(f"{root}/buckets") as f:
        return int(f.read())


def bucket_of(path: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(path.cast("binary")), F.lit(buckets))


def placed(rows: DataFrame, url: str, path: Column, tasks: int) -> DataFrame:
    """rows dealt out to tasks so that the answers to their paths are found together: recorded ones bucket by bucket, others anyhow."""
    if isinstance(transport(url), Http):
        return rows.repartition(tasks, path)
    bucket = bucket_of(path, buckets_of(url))
    return rows.repartition(tasks, bucket).sortWithinPartitions(bucket)


def record(answers: DataFrame, folder: str, buckets: int | None = None) -> None:
    """Write answers (path, cursor, next, statuses, results) for Recorded: the statuses that one try after the other gets, the last of them for
    good; the results, as JSON texts, of those that are 200; the cursor of the next answer, null at the end. A first answer's cursor is ''.
    buckets: as many as paths need, if not given, so that a bucket stays small however many there are."""
    if buckets is None:
        buckets = max(16, -(-answers.agg(F.approx_count_distinct("path")).first()[0] // PER_BUCKET))
    rows = answers.select("path", "cursor", "next", "statuses", "results", bucket_of(F.col("path"), buckets).alias("bucket"))
    rows.repartition("bucket").write.partitionBy("bucket").option("compression", "none").json(f"{folder}/answers")
    system, root = opened(folder)
    with system.open_output_stream(f"{root}/buckets") as f:
        f.write(str(buckets).encode())


@dataclass
class Client:
    """Requests that are tried again: after the time the service asks for if there are too many, after a growing time if it fails."""

    via: Http | Recorded
    size: int = SIZE
    pause: float = 1.0
    sleep: Callable[[float], None] = time.sleep

    def answer(self, path: str, **params) -> dict:
        for attempt in range(ATTEMPTS):
            status, headers, body = self.via.get(path, {k: v for k, v in params.items() if v is not None}, attempt)
            last = attempt == ATTEMPTS - 1
            if status == 429 and not last:
                self.sleep(self.pause * max(1.0, seconds(headers.get("Retry-After", "1"))))
            elif status in AGAIN and not last:
                self.sleep(self.pause * (1.0 + attempt))
            elif status >= 400:
                raise ServiceError(status, str(body.get("detail", ""))[:500])
            else:
                return body
        raise AssertionError("unreachable")

    def results(self, path: str, **params) -> Iterator[dict]:
        """The results of all answers, in order; a cursor that leads back to itself ends the list, as would one that is missing."""
        cursor = None
        while True:
            body = self.answer(path, cursor=cursor, size=self.size, **params)
            yield from body.get("results") or []
            following = body.get("next_cursor")
            if not body.get("has_more") or not following or following == cursor:
                return
            cursor = following


def seconds(text: str) -> float:
    try:
        return float(text)
    except ValueError:
        return 1.0


@dataclass
class Collections(InputPartition):
    """What one task lists: some collections, within a span of edits."""

    names: list[str]
    since: int | None = None
    until: int | None = None


class _Lists:
    """What both readers share; options: path (the service's address or a folder of recorded answers), token, size, pause, tasks."""

    def __init__(self, options: dict):
        self.options = dict(options)

    def client(self) -> Client:
        o = self.options
        return Client(transport(o["path"], o.get("token")), int(o.get("size", SIZE)), float(o.get("pause", 1.0)))

    def spread(self, since: int | None = None, until: int | None = None) -> list[Collections]:
        names, tasks = sorted(r["id"] for r in self.client().results("collections")), int(self.options.get("tasks", 64))
        return [Collections(names[i::tasks], since, until) for i in range(min(tasks, len(names)))]

    def read(self, partition: Collections) -> Iterator[tuple]:
        client = self.client()
        for name in partition.names:
            for r in client.results(f"collections/{name}", since=partition.since, until=partition.until):
                yield name, r["id"], int(r["edited"]), json.dumps(r, sort_keys=True, ensure_ascii=False)


class PagedReader(_Lists, DataSourceReader):
    def partitions(self) -> list[Collections]:
        return self.spread() or [Collections([])]


class PagedStreamReader(_Lists, DataSourceStreamReader):
    """Offsets are times of edits: a batch asks for what was edited after its start, up to its end."""

    def initialOffset(self) -> dict:
        return {"edited": int(self.options.get("since", -1))}

    def latestOffset(self) -> dict:
        newest = max((int(r["edited"]) for r in self.client().results("head")), default=-1)
        return {"edited": max(newest, self.initialOffset()["edited"])}

    def partitions(self, start: dict, end: dict) -> list[Collections]:
        return self.spread(start["edited"], end["edited"])

    def commit(self, end: dict) -> None:
        """Nothing to give back: the service keeps its objects."""


class PagedSource(DataSource):
    """spark.read.format("paged") and spark.readStream.format("paged"), once registered with spark.dataSource.register()."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PagedReader:
        return PagedReader(self.options)

    def streamReader(self, schema) -> PagedStreamReader:
        return PagedStreamReader(self.options)
