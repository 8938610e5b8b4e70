"""What the third round's findings were about, held against plain versions."""

import numpy as np
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import code
from tessera.operators import fusion as X
from tessera.operators import retrieval as R
from tessera.operators import vectors as V
from tessera.sources import relations

FILES = [(1, "/src/red_fox.py", "The red fox, the RED fox and redder"), (2, "/src/a.py", "fox red"), (3, "/x/empty.py", ""), (4, "/x/en.py", "xx-yy zz, red! red fox"), (5, "/red fox/b.py", "none of it")]
ASKED = [(0, "red fox"), (1, "en zz"), (2, "!"), (3, ""), (4, "Redder and the"), (5, "x-y"), (6, "red red fo")]


def test_lexical_scores_are_those_of_all_pairs(spark):
    f, q = spark.createDataFrame(FILES, "id long, path string, content string"), spark.createDataFrame(ASKED, "qid long, query string")
    toks = F.array_distinct(F.filter(T.tokens(F.col("query")), lambda t: F.length(t) >= 2))
    plain = f.crossJoin(q).select("qid", "id", F.round(code.chunk_lexical_score(toks, F.lower("query"), F.col("path"), F.col("content")), 6).alias("s")).where("s > 0")
    got = code.lexical_scores(f, q, 7).select("qid", "id", F.round("score", 6))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect()))


def test_places_are_those_of_the_whole_text(spark):
    f = spark.createDataFrame([(i, c) for i, _, c in FILES] + [(6, None), (7, "aaaa aaa\naa")], "id long, content string")
    terms = spark.createDataFrame([("red",), ("aa",), ("x",), ("a\na",), ("nothing",)], "term string")
    plain = f.crossJoin(terms).select("id", "term", T.occurrences(F.col("content"), F.col("term")).alias("n")).where("n > 0")
    got = R.places(f, F.split("content", " "), terms).select("id", "term", "times")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect()))


def test_passages_are_found_where_they_stand(spark):
    d = spark.createDataFrame([(1, "one two three four five"), (2, "xone two threex"), (3, "one  two three"), (4, None), (5, "two")], "doc_id long, text string")
    b = spark.createDataFrame([(0, "one two three"), (1, "two"), (2, "one  two"), (3, "ne two thre"), (4, "one nine three"), (5, "e two three four f")], "item_id long, passage string")
    plain = d.join(b, F.contains("text", F.col("passage"))).select("item_id", "doc_id")
    got = relations.holding_passages(d, b, True)
    assert got._jdf.queryExecution().executedPlan().toString().count("NestedLoopJoin") == 1  # for those of fewer than three words alone
    assert sorted((r[0], r[1]) for r in got.collect()) == sorted(map(tuple, plain.collect()))


def test_code_candidates_take_all_tokens_if_asked_to(spark):
    files = spark.createDataFrame([(1, "a.py", 1, 1.0), (2, "b.py", None, 2.0)], "id long, path string, line_count long, mtime double")
    symbols = spark.createDataFrame([(1, "t9"), (2, "t0")], "id long, name string")
    q = spark.createDataFrame([(0, " ".join(f"t{i}" for i in range(10)))], "qid long, query string")
    got = {r["id"]: r["score"] for r in X.code_candidates(files, symbols, q, most=None).collect()}
    assert got == {1: 3.25, 2: 3.25}
    assert [r["id"] for r in X.code_candidates(files, symbols, q, most=None).orderBy("rank").collect()] == [1, 2]
    assert {r["id"]: r["score"] for r in X.code_candidates(files, symbols, q).collect()} == {1: 0.25, 2: 3.25}


def test_approximate_neighbours_are_scored_without_shuffling_pairs(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), [float(v) for v in rng.standard_normal(8)]) for i in range(300)]
    v = spark.createDataFrame(rows, "id long, embedding array<double>")
    q = v.where("id % 20 = 0").select(F.col("id").alias("qid"), F.col("embedding").alias("q"))
    out = V.nearest_approx(v, q, 3, 8, tables=4, bits=3)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "MapInPandas" in plan
    planes = np.random.default_rng(3).standard_normal((4, 3, 8)).round(6)
    x = np.array([r[1] for r in rows])
    signs = np.einsum("nd,tbd->ntb", x, planes) > 0
    u, want = x / np.linalg.norm(x, axis=1, keepdims=True), set()
    for i in range(0, 300, 20):
        near = [(-round(float(u[i] @ u[j]), 9), j) for j in range(300) if (signs[i] == signs[j]).all(axis=1).any()]
        want |= {(i, j) for _, j in sorted(near)[:3]}
    assert {(r["qid"], r["id"]) for r in out.collect()} == want


def test_lanes_count_texts_and_words_once(spark):
    f = spark.createDataFrame([(i, f"n{i}.txt", c) for i, _, c in FILES], "id long, filename string, content string")
    q = spark.createDataFrame(ASKED, "qid long, query string")
    for lane, options, kept in ((R.bm25, {"prefix": False}, 2), (R.bm25, {"stemmed": True}, 3), (R.trigram, {}, 2)):
        plan = lane(f, q, 5, n_queries=7, **options)._jdf.queryExecution().optimizedPlan().toString()
        # Postings, which weights and scores ask for, and the words where their number is asked for too.
        assert plan.count("InMemoryRelation") == kept


def test_best_chunks_cuts_no_text_that_no_hit_names(spark):
    f = spark.createDataFrame([(i, c) for i, _, c in FILES] + [(6, None)], "id long, content string")
    q, hits = spark.createDataFrame(ASKED, "qid long, query string"), spark.createDataFrame([(0, 1), (0, 3), (1, 4), (2, 6), (4, 1)], "qid long, id long")
    out = R.best_chunks(hits, f, q)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    joined = plan[plan.index("Join Inner", plan.index("Join Inner") + 1) :]  # the inner one: texts and hits
    assert "transform(" not in joined and "chars" not in joined
    assert sorted((r["qid"], r["id"], r["chunk_text"]) for r in out.collect()) == [(0, 1, FILES[0][2]), (1, 4, FILES[3][2]), (4, 1, FILES[0][2])]  # those without a text have no chunk
