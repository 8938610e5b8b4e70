import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions.stem import stem
from tessera.operators import fusion as X
from tessera.operators import retrieval as R
from tessera.operators import vectors as V
from tessera.plans import registry
from tessera.sources import repository

DATA = "/root/testdata/sf0.001"
TEXTS = ["running dogs ran home", "the runner rung a bell", "conditional relational operators", "she runs and runs", "Operator, operate; operating!", ""]


def lane(spark, rows):
    return spark.createDataFrame(rows, "qid long, id long, score double, rank int")


def index(text_rows, tokenizer):
    c = sqlite3.connect(":memory:")
    c.execute(f"create virtual table f using fts5(filename, content, tokenize='{tokenizer}')")
    c.executemany("insert into f(rowid, filename, content) values (?, 'x', ?)", list(enumerate(text_rows, 1)))
    return c


def test_stems_and_stemmed_lane_match_a_full_text_index(spark):
    words = sorted({w for t in (r[0] for r in spark.read.parquet(f"{DATA}/documents.parquet").select("text").collect()) for w in (t or "").lower().split() if w.isascii() and w.isalpha()})
    c = index(words, "porter ascii")
    c.execute("create virtual table v using fts5vocab(f, 'instance')")
    theirs = dict(c.execute("select doc, term from v where col = 'content'").fetchall())
    assert [stem(w) for w in words] == [theirs[i] for i in range(1, len(words) + 1)]

    files = spark.createDataFrame([(i, "x", t) for i, t in enumerate(TEXTS, 1)], "id long, filename string, content string")
    queries = spark.createDataFrame([(1, "running operator")], "qid long, query string")
    mine = {r["id"]: r["score"] for r in R.bm25(files, queries, stemmed=True).collect()}
    found = index(TEXTS, "porter unicode61").execute("select rowid, -bm25(f) from f where f match 'running* OR operator*'").fetchall()
    assert mine == pytest.approx(dict(found), abs=1e-6)


def test_a_lane_of_every_term(spark):
    files = spark.createDataFrame([(i, "x", t) for i, t in enumerate(TEXTS, 1)], "id long, filename string, content string")
    queries = spark.createDataFrame([(1, "runs and"), (2, "runs nowhere")], "qid long, query string")
    assert [(r["qid"], r["id"]) for r in R.bm25(files, queries, prefix=False, every=True).collect()] == [(1, 4)]


def test_approximate_neighbours_against_all_pairs(spark):
    got = registry.queries()["knn_lsh"](spark, DATA).toPandas()
    e = spark.read.parquet(f"{DATA}/embeddings.parquet").toPandas().sort_values("vec_id")
    x = np.stack(e["embedding"]).astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    met = total = 0
    for q in e["vec_id"][e["vec_id"] % 20 == 0]:
        row = int(np.flatnonzero(e["vec_id"] == q)[0])
        best = set(e["vec_id"].to_numpy()[np.argsort(-(x @ x[row]), kind="stable")[:5]])
        met, total = met + len(best & set(got[got["qid"] == q]["id"])), total + 5
    assert met / total >= 0.9


def test_stemmed_query_gives_ranked_rows(spark):
    got = registry.queries()["porter_bm25"](spark, DATA).toPandas()
    assert len(got) and got["rank"].between(1, 10).all() and (got["score"] > 0).all()


def test_connector_counts_chunks_that_do_not_win(spark):
    lex = lane(spark, [(1, 1, 3.0, 1), (1, 2, 2.0, 2), (1, 3, 1.0, 3), (1, 4, 0.5, 4)])
    chunks = spark.createDataFrame([(1, "u", "t", "plain"), (2, "u", "the cat", "a cat"), (3, "u", "t", "x"), (4, "w", None, None)], "id long, uri string, title string, text string")
    got = X.connector(lex, chunks, spark.createDataFrame([(1, " Cat ")], "qid long, query string"), 5)
    assert [(r["uri"], r["score"], r["matched_chunks"]) for r in got.orderBy("rank").collect()] == [("u", 6.0, 2), ("w", 0.5, 1)]


def test_video_sums_stop_at_the_cap(spark):
    near = lane(spark, [(1, 1, 0.9, 1), (1, 2, 0.1, 2), (1, 3, 1.0, 3)])
    seen = lane(spark, [(1, 1, 6.0, 1), (1, 2, 100.0, 2)])
    frames = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, video_id string")
    said = spark.createDataFrame([(1, "b", 2.0)], "qid long, video_id string, score double")
    got = {r["video_id"]: (r["score"], r["context_match"], r["transcript_match"]) for r in X.video(near, seen, said, frames, 5).collect()}
    assert got == {"a": (0.99, True, False), "b": (pytest.approx(0.65), True, True), "c": (1.0, False, False)}


def test_image_names_and_both_ocr_modes(spark):
    images = spark.createDataFrame([(1, "red_car.png"), (2, "tree.png"), (3, "x.png")], "id long, filename string")
    q = spark.createDataFrame([(1, "Red car")], "qid long, query string")
    near, ocr = lane(spark, [(1, 1, 0.0, 1), (1, 2, 0.5, 2)]), lane(spark, [(1, 2, 0.5, 1), (1, 3, 1.0, 2)])
    got = {m: {r["id"]: (r["score"], r["match_type"]) for r in X.image(near, ocr, images, q, 5, m).collect()} for m in ("faithful", "fixed")}
    assert got["faithful"] == {1: (1.8, "filename"), 2: (pytest.approx(4.3), "hybrid")}
    assert got["fixed"] == {1: (1.8, "filename"), 2: (pytest.approx(1.5 + 1.4 / 3), "hybrid"), 3: (pytest.approx(0.7), "ocr")}


def test_unified_marks_low_confidence(spark):
    one = spark.createDataFrame([(1, "a", 0.05), (2, "b", 0.5)], "qid long, item string, score double")
    two = spark.createDataFrame([(1, 7, 0.09)], "qid long, item long, score double")
    got = X.unified({"text": one, "audio": two}, 5).orderBy("qid", "place").collect()
    assert [(r["qid"], r["modality"], r["item"], r["low_confidence"]) for r in got] == [(1, "audio", "7", True), (1, "text", "a", True), (2, "text", "b", False)]


def test_commits_and_ignore_files(spark):
    lines = spark.createDataFrame([("h1|10|a|b",), ("h2|20|c",), ("odd",), (None,), ("h3|x|d",)], "value string")
    assert [tuple(r) for r in repository.commits(lines).collect()] == [("h1", 10, "a|b"), ("h2", 20, "c")]
    assert [tuple(r) for r in repository.commits(lines, since=15).collect()] == [("h2", 20, "c")]
    patterns = repository.ignore_patterns("# c\n\n!keep\n/build/\n*.pyc\ndocs/*.md\n")
    assert patterns == ["build/", "*.pyc", "docs/*.md"]
    paths = ["build", "build/x", "builder/x", "a/b.pyc", "docs/a.md", "a/docs/a.md", "b.py"]
    rows = spark.createDataFrame([(p,) for p in paths], "path string").select(repository.ignored(F.col("path"), patterns).alias("i")).collect()
    assert [r["i"] for r in rows] == [True, True, False, True, True, False, False]


def test_numbers_lines_hashes_and_names(spark, tmp_path):
    import hashlib

    import numpy as np
    from pyspark.sql import functions as F

    from tessera.functions import text as T
    from tessera.operators import fusion as X
    from tessera.operators import runs
    from tessera.operators import vectors as V

    n = spark.createDataFrame([(v,) for v in (-1, 0, 999, 1000, 1250, 1_000_000, 12_345_678)], "n long")
    assert [r[0] for r in n.select(T.short_number(F.col("n"))).collect()] == ["N/A", "0", "999", "1.0K", "1.3K", "1.0M", "12.3M"]
    lines = spark.createDataFrame([([],), ([0, 0],), ([3, 3, 3],), ([0, 7, 14, 1],)], "v array<long>")
    assert [r[0] for r in lines.select(T.sparkline(F.col("v"))).collect()] == ["", "··", "███", "▁▅█▁"]
    v = spark.createDataFrame([([1.0, -0.5],), (None,)], "v array<float>").select(V.embedding_hash(F.col("v"))).collect()
    assert [r[0] for r in v] == [hashlib.sha256(np.array([1.0, -0.5], np.float32).tobytes()).hexdigest(), None]
    lanes = [spark.createDataFrame(x, "qid long, id long, rank int") for x in ([(0, 5, 1), (0, 3, 2)], [(0, 9, 1), (0, 5, 2), (1, 4, 1)])]
    assert sorted(map(tuple, X.ordered_union(lanes, 3).collect())) == [(0, 3, 2), (0, 5, 1), (0, 9, 3), (1, 4, 1)]
    q = spark.createDataFrame([(0, "holiday photo"), (1, "answered"), (2, "zzz")], "qid long, query string")
    images = spark.createDataFrame([(1, "Holidays.png"), (2, "answered.png"), (3, "x.png")], "id long, filename string")
    got = X.images_by_name(q, images, spark.createDataFrame([(1,)], "qid long"), 5).collect()
    assert [(r.qid, r.id, round(r.score, 6)) for r in got] == [(0, 1, 1.8)]
    runs.append_feedback(spark, str(tmp_path), spark.createDataFrame([("q", ["a", "b"], "bad", 5), ("r", [], None, 6)], "query string, excluded array<string>, note string, at int"))
    assert sorted(map(tuple, runs.feedback(spark, str(tmp_path)).collect()), key=str) == [("q", "a,b", "bad", 5), ("r", "", None, 6)]
