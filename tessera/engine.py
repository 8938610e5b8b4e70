"""What a user calls: a folder's files as a collection, searches of it, chunks around a chunk, texts, and views of its code.

Arguments out of range are clamped. Every answer is a DataFrame; nothing is collected but the one file that neighbours() looks up.
"""

from __future__ import annotations

import base64
import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import catalog, code, maintenance, projects
from tessera.operators import retrieval as R
from tessera.operators.lineage import cut
from tessera.operators.runs import RunLog
from tessera.sources import extract
from tessera.streaming.stateful import shared_folder

FILES = "id long, path string, filename string, category string, matter_id string, mtime double, content string"


def now_ms() -> int:
    return int(time.time() * 1000)


def clamp(value: int | None, least: int, most: int) -> int | None:
    return None if value is None else max(least, min(most, int(value)))


class Engine:
    """files: (id, path, filename, category, matter_id, mtime, content); none at first, unless some are given. home: a folder, which driver
    and executors share, for the run log and what is indexed; by default a new one below the shared folder."""

    def __init__(self, spark: SparkSession, files: DataFrame | None = None, home: str | None = None):
        self.spark, self._home, self._log = spark, home, None
        self.files = files if files is not None else spark.createDataFrame([], FILES)

    @property
    def home(self) -> str:
        self._home = self._home or shared_folder(self.spark, "engine")
        return self._home

    @property
    def log(self) -> RunLog:
        self._log = self._log or RunLog(self.spark, f"{self.home}/log")
        return self._log

    def index_folder(self, folder: str, glob: str = "*", modalities: list[str] | None = None, matter_id: str | None = None) -> DataFrame:
        """Reads the files below a folder: new and newer ones replace the stored ones, those below it that are gone go, as does what
        lies in noise folders; files of other modalities, where some are named, are neither read in nor purged. Returns (path, action).

        The folder is listed first; only new and newer files are opened, and of these not the ones that the log has as unreadable
        at the same time of change. What was found, done and counted goes into the run log; the stored files are a written table."""
        run, started = self.log.next_run(), now_ms()
        found = extract.list_files(self.spark, folder, glob)
        found = found.where(~F.arrays_overlap(F.split("path", "/"), F.array(*[F.lit(x) for x in projects.NOISE_FOLDERS])))
        ours = F.contains("path", F.lit(folder.rstrip("/") + "/")) & F.col("filename").rlike("^" + T.glob_regex(glob))
        if modalities:
            found, ours = found.where(F.col("category").isin(modalities)), ours & F.col("category").isin(modalities)
        found = cut(found)
        actions = cut(projects.scan_actions(self.files.where(ours), found))
        fresh = found.join(actions.where("action in ('update', 'insert')").select("path"), "path", "left_semi")
        known = self.log.events().where("status = 'skipped_unsupported'").select("path", "mtime").distinct()
        again = cut(fresh.join(known, ["path", "mtime"], "left_semi"))
        read = extract.with_contents(fresh.join(again.select("path"), "path", "left_anti"))
        read = cut(read.unionByName(again.withColumns({"content": F.lit(None).cast("string"), "error": F.lit(None).cast("string")})))
        rows = read.where("error is null").select(F.xxhash64("path").alias("id"), "path", "filename", "category", F.lit(matter_id).cast("string").alias("matter_id"), "mtime", "content")
        # Stored rows stay as they are unless a path has changed; a file that can't be read keeps what is stored of it.
        gone = actions.where("action = 'purge'").select("path").unionByName(rows.select("path"))
        files = self.files.join(gone, "path", "left_anti").unionByName(rows)
        place = f"{self.home}/files/run={run}"
        files.write.mode("overwrite").parquet(place)
        self.files = self.spark.read.schema(files.schema).parquet(place)
        status = F.when(F.col("error").isNotNull(), "failed").when(F.col("content").isNull(), "skipped_unsupported").otherwise("indexed")
        none = F.lit(None).cast("string")
        events = read.select("path", F.col("category").alias("modality"), "mtime", status.alias("status"), F.when(F.col("content").isNull() & F.col("error").isNull(), "no reader").alias("reason"), "error")
        skipped = found.join(actions.where("action = 'skip'"), "path").select("path", F.col("category").alias("modality"), "mtime", F.lit("skipped_unchanged").alias("status"), none.alias("reason"), none.alias("error"))
        purged = actions.where("action = 'purge'").select("path", T.modality(F.col("path")).alias("modality"), F.lit(None).cast("double").alias("mtime"), F.lit("purged").alias("status"), none.alias("reason"), none.alias("error"))
        self.counts = self.log.record(run, folder, started, now_ms(), events.unionByName(skipped).unionByName(purged))
        return actions

    def forget(self, prefix: str, spare: list[str] | None = None) -> None:
        self.files = maintenance.delete_prefix(self.files, prefix, spare)

    def queries(self, query: str | DataFrame) -> DataFrame:
        """One query as a table of one row; a table (qid, query) as it is."""
        return query if isinstance(query, DataFrame) else self.spark.createDataFrame([(0, query)], "qid long, query string")

    def search(self, query: str | DataFrame, top_k: int = 20, mode: str = "hybrid", matter_id: str | None = None, exclude: list[str] | None = None, chunks: int | None = None, tokens: int | None = None) -> DataFrame:
        """(qid, id, score, rank, path, ...) of the best files, 1 to 200; with ``chunks``, 1 to 4, also their best chunks, of no more than
        1 to 4,000 tokens but for the first."""
        asked = self.queries(query)
        pool = self.files.where("content is not null")
        hits = R.search(pool, asked, k=clamp(top_k, 1, 200), mode=mode, matter_id=matter_id, exclude=exclude, n_queries=1 if isinstance(query, str) else None)
        if chunks is not None:
            hits = R.best_chunks(hits, pool, asked, max_chunks=clamp(chunks, 1, 4), budget=clamp(tokens, 1, 4000))
        return hits.join(self.files.select("id", "path", "category", "matter_id"), "id")

    def neighbours(self, chunk_id: str, direction: str = "next", count: int = 1) -> DataFrame:
        """(path, category, matter_id, chunk, chunk_id, chunk_index, chunk_total) of 1 to 5 chunks after a chunk, or before it, the nearest first.

        LookupError: file_not_found, no_chunks; ValueError: invalid_direction, or an id that names no chunk."""
        named = json.loads(base64.urlsafe_b64decode(chunk_id + "=" * (-len(chunk_id) % 4)))
        size, overlap, direction = F.lit(int(named["cc"])), F.lit(int(named["ov"])), direction.lower().strip()
        file = self.files.where(F.col("id") == int(named["fid"])).withColumn("chunks", T.char_chunks(F.col("content"), size, overlap))
        total = file.select(F.coalesce(F.size("chunks"), F.lit(0)).alias("n")).head()
        if total is None:
            raise LookupError("file_not_found")
        if total.n <= 0:
            raise LookupError("no_chunks")
        if direction not in ("next", "prev"):
            raise ValueError("invalid_direction")
        at, n = int(named["idx"]), clamp(count, 1, 5)
        wanted = F.col("c.index").between(at + 1, at + n) if direction == "next" else F.col("c.index").between(at - n, at - 1)
        rows = file.select("id", "path", "category", "matter_id", F.size("chunks").alias("chunk_total"), F.explode("chunks").alias("c")).where(wanted)
        out = rows.select("path", "category", "matter_id", F.col("c.text").alias("chunk"), T.text_chunk_id(F.col("id"), F.col("c.index"), size, overlap).alias("chunk_id"), F.col("c.index").alias("chunk_index"), "chunk_total")
        return out.orderBy(F.abs(F.col("chunk_index") - at))

    def content(self, paths: list[str], most: int = 5000) -> DataFrame:
        """(path, found, text, cut) of these files."""
        return catalog.content(self.files, self.spark.createDataFrame([(p,) for p in paths], "path string"), max(0, most))

    def lines(self, path: str, first: int = 1, last: int = 200) -> DataFrame:
        """(path, text) of a file's lines from first to last."""
        return self.files.where(F.col("path") == path).select("path", projects.line_range(F.col("content"), F.lit(first), F.lit(last)).alias("text"))

    def sources(self) -> DataFrame:
        """(category, files, newest) of what is stored."""
        return self.files.groupBy("category").agg(F.count("*").alias("files"), F.max("mtime").alias("newest"))

    def code_index(self) -> dict[str, DataFrame]:
        """roots, folders, languages, symbols, modules and dependencies of the stored files."""
        facts = code.symbols(self.files)
        return {
            "roots": projects.project_roots(self.files), "folders": projects.top_folders(self.files), "languages": projects.languages(self.files),
            "symbols": facts.where("kind not in ('import', 'internal')"), "modules": projects.modules(facts), "dependencies": code.dependencies(self.files),
        }
