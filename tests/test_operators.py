import math
import re

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import code, fuzzy
from tessera.operators import maintenance as M
from tessera.operators import retrieval as R
from tessera.streaming import stateful


def test_chunks_and_ids(spark):
    df = spark.createDataFrame([("a" * 1000,), ("a" * 100 + " " * 100 + "b" * 100,), ("",)], "t string")
    got = [[(c["index"], c["start"], c["end"]) for c in (r[0] or [])] for r in df.select(T.char_chunks(F.col("t"), F.lit(520), F.lit(60))).collect()]
    assert got[0] == [(0, 0, 520), (1, 460, 980), (2, 920, 1000)] and got[2] == []
    assert [(c["index"], c["start"], c["end"]) for c in df.select(T.char_chunks(F.col("t"), F.lit(100), F.lit(0))).collect()[1][0]] == [(0, 0, 100), (1, 200, 300)]
    assert spark.range(1).select(T.text_chunk_id(F.lit(1), F.lit(0), F.lit(520), F.lit(60))).first()[0] == "eyJmaWQiOjEsImlkeCI6MCwiY2MiOjUyMCwib3YiOjYwfQ"


def test_token_estimate(spark):
    df = spark.createDataFrame([(n,) for n in (1, 2, 10, 30)], "n int")
    assert [r[0] for r in df.select(T.token_estimate(F.col("n"))).collect()] == [1, 3, 14, 40]


def test_fusion(spark):
    a = spark.createDataFrame([(0, 1, 1), (0, 2, 2), (0, 3, 3)], "qid int, id int, rank int")
    b = spark.createDataFrame([(0, 2, 1), (0, 1, 2), (0, 4, 3)], "qid int, id int, rank int")
    got = {r["id"]: r["score"] for r in R.fuse([(a, 1.0), (b, 0.8)]).collect()}
    assert {k: round(v, 10) for k, v in got.items()} == {1: 0.0292966684, 2: 0.0292437864, 3: 0.0158730159, 4: 0.0126984127}


def test_trigram_lane_against_brute_force(spark):
    docs = [(1, "a.txt", "anan ananas banana"), (2, "b.txt", "nothing here"), (3, "anan.md", ""), (4, "c", "aaaa xyz")]
    q = [(1, "anan"), (2, "aaa xyz"), (3, "zz")]
    f = spark.createDataFrame(docs, "id long, filename string, content string")
    got = {(r["qid"], r["id"]): r["score"] for r in R.trigram(f, spark.createDataFrame(q, "qid long, query string")).collect()}
    dl = {i: sum(max(len(x) - 2, 0) for x in (a, b)) for i, a, b in docs}
    want = {}
    for qid, text in q:
        for t in (t for t in text.split() if len(t) >= 3):
            tf = {i: sum(len(re.findall(f"(?={t})", x)) for x in (a, b)) for i, a, b in docs}
            n = sum(v > 0 for v in tf.values())
            idf = max(math.log((4 - n + 0.5) / (n + 0.5)), 0) or 1e-6
            for i, v in tf.items():
                if v:
                    want[qid, i] = want.get((qid, i), 0) + idf * v * 2.2 / (v + 1.2 * (0.25 + 0.75 * dl[i] / (sum(dl.values()) / 4)))
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-8 for k in want)


def test_fuzzy_ratios():
    assert fuzzy.ratio("abcd", "abxd") == 75.0 and fuzzy.partial_ratio("report", "my_report_2020") == 100.0 and fuzzy.partial_ratio("", "") == 100.0


def test_code_facts():
    assert ("class", "A", 1) in code.facts("python", "class A:\n    def f(self): pass\n") and code.facts("python", "def (") == []
    assert code.facts("rust", "pub fn a() {}\nenum B {}") == [("function", "a", 1), ("class", "B", 2)]
    assert code.declared("x/package.json", '{"dependencies": {"a": "1"}}') == [("a", "1", "dependencies")] and code.declared("package.json", "[") == []


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([("a", 1.0, "x"), ("b", 5.0, "y")], "path string, mtime double, c string")
    new = spark.createDataFrame([("a", 2.0, "z"), ("b", 5.0, "w"), ("c", 1.0, "v")], "path string, mtime double, c string")
    once = M.upsert_newest(old, new)
    want = [("a", 2.0, "z"), ("b", 5.0, "y"), ("c", 1.0, "v")]
    assert sorted(map(tuple, once.collect())) == want and sorted(map(tuple, M.upsert_newest(once, new).collect())) == want


def test_debounce_stream_is_the_batch(spark, tmp_path):
    rows = [("a", 0.0), ("a", 1.0), ("a", 2.5), ("b", 1.0), ("a", 4.0), ("a", 4.6)]
    spark.createDataFrame(rows, "key string, ts double").write.parquet(str(tmp_path / "e"))
    batch = stateful.debounce(spark.read.parquet(str(tmp_path / "e")))
    stream = stateful.drained(stateful.debounce_stream(spark.readStream.schema("key string, ts double").parquet(str(tmp_path / "e"))), "debounced", "append")
    assert sorted(map(tuple, batch.collect())) == sorted(map(tuple, stream.collect())) == [("a", 0.0), ("a", 2.5), ("a", 4.6), ("b", 1.0)]


def test_queue_is_numbered_in_full(spark):
    rows = [(f"p{i}", None if i % 7 == 0 else i * 37 % 900, "QUEUED" if i % 3 else "FETCHED") for i in range(6000)]
    got = M.claim(spark.createDataFrame(rows, "path string, size long, state string"), 4).collect()
    queue = [p for p, s, state in sorted(rows, key=lambda r: (r[1] or 0, r[0])) if state == "QUEUED"]
    assert {r.path: (r.place, r.worker) for r in got} == {p: (i + 1, i % 4) for i, p in enumerate(queue)}


def test_queue_query_gives_all_queued(spark):
    from tessera.plans import table_queries as Q

    d = "/root/testdata/sf0.001"
    assert Q.QUERIES["manifest_queue"](spark, d).count() == spark.read.parquet(f"{d}/orders.parquet").where("o_orderstatus = 'O'").count() > 500


def test_search_takes_stems_and_near_file_names(spark):
    rows = [(1, "/a/x.txt", "x.txt", "alpha running shoes"), (2, "/a/alpha_plan.txt", "alpha_plan.txt", "alpha beta gamma delta"), (3, "/a/budget_report.txt", "budget_report.txt", "nothing of the kind")]
    f = spark.createDataFrame([(i, p, n, "c", "m", 1.0, t) for i, p, n, t in rows], "id long, path string, filename string, category string, matter_id string, mtime double, content string")
    q = spark.createDataFrame([(1, "alpha"), (2, "runs"), (3, "budgetx"), (4, "x.txt"), (5, "qqqq")], "qid long, query string")
    got = {(r.qid, r.id): r.score for r in R.search(f, q, n_queries=5).collect()}
    plain = {(r.qid, r.id): r.score for r in R.search(f, q, n_queries=5, names=False).collect()}
    assert abs(got[1, 2] - plain[1, 2] - 1.25) < 0.05 and got[1, 2] > 1.25 > got[1, 1]
    assert (2, 1) in got and (2, 1) not in plain
    assert abs(got[3, 3] - fuzzy.partial_ratio("budgetx", "budget_report.txt") / 100) < 1e-9 and not any(k[0] == 3 for k in plain)
    assert got[4, 1] == 5.0 and not any(k[0] == 5 for k in got)


def test_fuzzy_names_of_query_words(spark):
    from tessera.plans import more_queries as Q
    from tessera.sources.relations import files, queries

    d = "/root/testdata/sf0.001"
    words = {w for r in queries(spark, d).select(T.tokens(F.col("query")).alias("w")).collect() for w in r.w if len(w) >= 4}
    names = [r.filename.lower() for r in files(spark, d).collect()]
    best = {w: max(fuzzy.partial_ratio(w, n) for n in names) for w in words}
    got = {r.query: r.best for r in Q.fuzzy_partial_ratio(spark, d).collect()}
    assert got == {w: round(s, 6) for w, s in best.items() if s >= 70}
    pairs = spark.createDataFrame([(w, n) for w in ("docx", "odc_1", "coddle", "abcd", "report") for n in ("doc_1.txt", "do", "my_report_2")], "word string, name string")
    assert all(r.m or fuzzy.partial_ratio(r.word, r.name) < 70 for r in pairs.withColumn("m", fuzzy.may_reach("word", "name", 70)).collect())
