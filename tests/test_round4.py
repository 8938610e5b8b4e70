import random
import re

from tessera.operators import code
from tessera.operators import postings as P
from tessera.operators import retrieval as R


def test_no_lane_is_asked_for_a_files_name(spark, monkeypatch):
    files = spark.createDataFrame([(i, f"/a/doc_{i}.txt", f"doc_{i}.txt", "c", "en", "red apples" if i % 2 else "green pears") for i in range(1, 9)], "id long, path string, filename string, category string, matter_id string, content string")
    queries = spark.createDataFrame([(1, " DOC_3.TXT "), (2, "apples"), (3, "doc_99.txt")], "qid long, query string")
    asked = {}
    for name in ("bm25", "trigram"):
        lane = getattr(R, name)
        monkeypatch.setattr(R, name, lambda files, queries, lane=lane, name=name, **more: asked.__setitem__(name, {r.qid for r in queries.collect()}) or lane(files, queries, **more))
    got = {(r.qid, r.id): r.score for r in R.search(files, queries, 10, n_queries=3, names=False).collect()}
    assert asked == {"bm25": {2, 3}, "trigram": {2, 3}}
    assert got[(1, 3)] == 5.0 and {id for q, id in got if q == 2} == {1, 3, 5, 7} and len([1 for q, _ in got if q == 3]) == 8


def test_a_lane_without_weight_is_left_out(spark, monkeypatch):
    files = spark.createDataFrame([(1, "/a/x.txt", "x.txt", "c", "en", "red apples"), (2, "/a/y.txt", "y.txt", "c", "en", "pineapples"), (3, "/a/z.txt", "z.txt", "c", "de", "apples")], "id long, path string, filename string, category string, matter_id string, content string")
    queries, asked = spark.createDataFrame([(1, "apple")], "qid long, query string"), []
    for name in ("bm25", "trigram"):
        lane = getattr(R, name)
        monkeypatch.setattr(R, name, lambda *files, lane=lane, name=name, **more: asked.append(name) or lane(*files, **more))
    for mode, lanes, found in (("bm25_only", ["bm25"], {1}), ("trigram_only", ["trigram"], {1, 2}), ("hybrid", ["bm25", "trigram"], {1, 2})):
        asked.clear()
        got = R.search(files, queries, 10, mode=mode, matter_id="en", n_queries=1, names=False).collect()
        assert asked == lanes and {r.id for r in got} == found


def test_many_names_meet_texts_without_a_shuffle_of_common_words(spark, tmp_path, monkeypatch):
    draw = random.Random(4)
    words = [a + b + c for a in "abcd" for b in "aeio" for c in ("ns", "rt", "ning", "rted")]
    text = lambda: " ".join(words[min(int(draw.expovariate(0.15)), len(words) - 1)] for _ in range(60))
    files = spark.createDataFrame([(i, f"/a/{i}.txt", f"{i}.txt", "m", text()) for i in range(50)], "id long, path string, filename string, matter_id string, content string")
    queries = spark.createDataFrame([(1, "a b ain"), (2, "cor dart ans bert"), (3, "ning")], "qid long, query string")
    index = P.Index.create(files, str(tmp_path), per_shard=9)
    rows = lambda df: sorted(map(tuple, df.collect()))
    lanes = [(R.bm25, {}), (R.bm25, {"stemmed": True}), (R.trigram, {}), (R.bm25, {"index": index}), (R.trigram, {"index": index})]
    before = [rows(lane(files, queries, 9, n_queries=3, **more)) for lane, more in lanes]
    assert all(before)
    monkeypatch.setattr(R, "KEYS", 12)
    assert [rows(lane(files, queries, 9, n_queries=3, **more)) for lane, more in lanes] == before
    for lane, more in lanes[:3]:
        met = []
        monkeypatch.setattr(R, "kept", lambda df: met.append(df) or df)
        lane(files, queries, 9, n_queries=3, **more)
        monkeypatch.undo()
        monkeypatch.setattr(R, "KEYS", 12)
        plan = met[-1]._jdf.queryExecution().executedPlan().toString()
        assert "LeftAnti" in plan and plan.index("HashAggregate") < plan.index("Union") and "Exchange" not in plan[: plan.index("Union")]


def test_code_scores_do_not_shuffle_texts_for_common_words_or_whole_queries(spark, monkeypatch):
    draw = random.Random(5)
    words = ["an", "rain", "train", "Trainer", "banana", "a", "of", "ofof", "x_an"]
    texts = [(i, f"/src/{draw.choice(words)}_{i}.txt", None if i == 3 else " ".join(draw.choices(words, k=12))) for i in range(40)]
    asked = [(1, "rain an"), (2, "of an Train"), (3, "ANAN of"), (4, "a"), (5, "an banana"), (6, "- ."), (7, "src")]
    f, q = spark.createDataFrame(texts, "id long, path string, content string"), spark.createDataFrame(asked, "qid long, query string")

    def plain(query, path, text):
        query, path, text = query.lower(), path.lower(), (text or "").lower()
        tokens = [t for t in dict.fromkeys(re.findall(r"\w+", query)) if len(t) >= 2]
        return 2.5 * (query in path) + 4.0 * (query in text) + sum(1.5 * (t in path) + 0.9 * min(4, sum(w.count(t) for w in re.findall(r"\w+", text))) for t in tokens)

    want = {(n, i): round(s, 6) for n, query in asked for i, path, text in texts if (s := plain(query, path, text)) > 0}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for keys in (2_000_000, 12):
            monkeypatch.setattr(R, "KEYS", keys)
            got = code.lexical_scores(f, q, 7)
            plan = got._jdf.queryExecution().executedPlan().toString()
            if keys > 12:  # with few keys the seldom words are met by a shuffle
                assert not re.search(r"hashpartitioning\(id#\d+L?, \d+\), ENSURE_REQUIREMENTS", plan) and "SortMergeJoin" not in plan
            else:
                assert "LeftAnti" in plan and plan.count("REPARTITION_BY_NUM") == 2
            assert {(r.qid, r.id): round(r.score, 6) for r in got.collect()} == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_searches_make_no_index(spark, monkeypatch):
    from tessera.plans import text_queries as Q

    def made(spark, d):
        raise AssertionError("an index of all texts is made")

    monkeypatch.setattr(Q, "_index", made)
    for name in ("fused_search", "text_search"):
        assert Q.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 100
