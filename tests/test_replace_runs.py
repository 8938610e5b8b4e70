import os

import pytest
from pyspark.sql import functions as F

from tessera.engine import Engine
from tessera.operators import replace as R
from tessera.operators.runs import RunLog

SCHEMA = "document long, chunk_index int, chunk_text string"


def held(table):
    return sorted(tuple(r) for r in table.rows().collect())


def files_below(folder):
    return {(os.path.join(d, f), os.stat(os.path.join(d, f)).st_mtime_ns) for d, _, fs in os.walk(folder) for f in fs}


def test_a_documents_rows_are_replaced_as_one(spark, tmp_path):
    t = R.Table(spark, str(tmp_path), SCHEMA, "document", buckets=5)
    rows = lambda *x: spark.createDataFrame(list(x), SCHEMA)
    assert held(t) == [] and t.replace(rows(*[(d, i, f"{d}.{i}") for d in range(10) for i in range(d % 3 + 1)], (None, 0, "no")), 1)
    first = held(t)
    before = files_below(tmp_path / "rows")
    assert not t.replace(rows((1, 0, "again")), 1) and held(t) == first and files_below(tmp_path / "rows") == before
    assert t.replace(rows((2, 0, "new"), (77, 5, "more")), 2, spark.createDataFrame([(2,), (3,), (None,)], "document long"))
    assert held(t) == sorted([r for r in first if r[0] not in (2, 3)] + [(2, 0, "new"), (77, 5, "more")])
    touched = [r.touched for r in t.batches().orderBy("batch").collect()]
    assert touched[0] == 5 and touched[1] <= 3
    same = {p for p, _ in before & files_below(tmp_path / "rows") if "_bucket=" in p and p.endswith(".parquet")}
    assert len({p.split("_bucket=")[1][0] for p in same}) == 5 - touched[1]  # the other buckets' files are as they were


def test_a_bucket_can_lose_all_its_rows(spark, tmp_path):
    t = R.Table(spark, str(tmp_path), SCHEMA, "document", buckets=1)
    t.replace(spark.createDataFrame([(1, 0, "a")], SCHEMA), 1)
    assert t.replace(spark.createDataFrame([], SCHEMA), 2, spark.createDataFrame([(1,)], "document long")) and held(t) == []
    assert t.replace(spark.createDataFrame([], SCHEMA), 3) and held(t) == []


def test_chunks_of_cloud_and_code(spark):
    text = "a" * 900 + " " * 780 + "b" * 10
    got = R.cloud_chunks(spark.createDataFrame([(1, text), (2, None), (3, " ")], "id long, content string")).collect()
    assert [(r.document, r.chunk_index, r.start_offset, r.end_offset, len(r.chunk_text)) for r in got] == [(1, 0, 0, 900, 900), (1, 1, 780, 1680, 120), (1, 2, 1560, 1690, 10)]
    code = R.code_chunks(spark.createDataFrame([("p", "\n".join(f"l{i}" for i in range(150)))], "path string, content string")).collect()
    assert [(r.chunk_index, r.start_line, r.end_line) for r in code] == [(0, 1, 80), (1, 61, 140), (2, 121, 150)]


def test_run_log(spark, tmp_path):
    log = RunLog(spark, str(tmp_path))
    shape = "path string, modality string, mtime double, status string, reason string, error string"
    assert log.next_run() == 1 and log.completed().isEmpty()
    rows = [("/a/b.TXT", "text", 1.0, "indexed", None, None), ("/a/c", "unknown", 2.0, "skipped_unsupported", "no reader", None), ("/a/d.md", "text", 3.0, "failed", None, "io")]
    counts = log.record(1, "/a", 5, 9, spark.createDataFrame(rows, shape))
    assert counts == {"total": 3, "indexed": 1, "skipped_unsupported": 1, "failed": 1, "skipped_unchanged": 0, "purged": 0}
    run = log.runs().first()
    assert (run.run, run.status, run.total, run.processed, run.counts["failed"], run.started, run.ended) == (1, "completed_with_errors", 3, 2, 1, 5, 9)
    assert sorted(map(tuple, log.completed().collect())) == [("/a/b.TXT", 1.0), ("/a/c", 2.0)] and log.next_run() == 2
    assert [r.extension for r in log.events().orderBy("path").collect()] == [".txt", "", ".md"]
    with pytest.raises(Exception, match="no status"):
        log.record(2, "/a", 0, 0, spark.createDataFrame([("x", "text", 0.0, "odd", None, None)], shape))


def test_unchanged_files_are_not_opened(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for name in ("a.txt", "b.txt", "c.pdf"):
        (folder / name).write_text("old")
    e = Engine(spark, home=str(tmp_path / "home"))
    e.index_folder(str(folder))
    assert e.counts == {"total": 3, "indexed": 2, "skipped_unsupported": 1, "skipped_unchanged": 0, "purged": 0, "failed": 0}
    was = os.stat(folder / "a.txt")
    (folder / "a.txt").write_text("other text, same time")
    os.utime(folder / "a.txt", ns=(was.st_atime_ns, was.st_mtime_ns))
    os.remove(folder / "b.txt")
    (folder / "d.txt").write_text("new")
    e.index_folder(str(folder))
    assert {r.filename: r.content for r in e.files.collect()} == {"a.txt": "old", "c.pdf": None, "d.txt": "new"}
    assert (e.counts["indexed"], e.counts["skipped_unchanged"], e.counts["purged"]) == (1, 2, 1)
    assert [r.run for r in e.log.runs().orderBy("run").collect()] == [1, 2]
    assert e.log.events().where(F.col("run") == 2).count() == 4
