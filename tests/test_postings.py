import random

import pytest

from tessera.operators import postings as P
from tessera.operators import retrieval as R

FILES = "id long, path string, filename string, matter_id string, content string"
VOCABULARY = ["red", "redder", "blue", "green", "über", "x1", "a", "fox", "lazy", "jumping", "jumps"]


def made(ids, seed):
    rng = random.Random(seed)
    return [(i, f"/p/doc_{i}.txt", f"doc_{i}.txt", "m", None if i % 17 == 3 else " ".join(rng.choices(VOCABULARY, weights=range(1, 12), k=rng.randint(0, 40)))) for i in ids]


def asked(spark):
    return spark.createDataFrame([(0, "red fox fox"), (1, "über"), (2, "nothing here"), (3, "doc 4 blue"), (4, ""), (5, "a lazy jump"), (6, "txt")], "qid long, query string")


def rows(df):
    return sorted(tuple(r) for r in df.select("qid", "id", "score", "rank").collect())


def same(spark, index, files, lanes=False):
    q = asked(spark)
    assert rows(P.top(index, q, 5, first=1)) == rows(R.bm25(files, q, 5, prefix=False))
    if lanes:
        assert rows(R.bm25(files, q, 20, stemmed=True, index=index)) == rows(R.bm25(files, q, 20, stemmed=True))
        assert rows(R.trigram(files, q, 20, index=index)) == rows(R.trigram(files, q, 20))


def test_index_gives_the_rows_of_the_texts_through_updates(spark, tmp_path):
    old = {r[0]: r for r in made(range(60), 1)}
    index = P.Index.create(spark.createDataFrame(list(old.values()), FILES), f"{tmp_path}/a", per_shard=7, buckets=3)
    assert index.n_shards == 9
    for seed, changed, gone in ((2, [*range(50, 70)], [1, 2, 999]), (3, [1, 55, 70], [60, 3]), (4, [2], [])):
        new = {r[0]: r for r in made(changed, seed)}
        dead = spark.createDataFrame([(i,) for i in gone], "id long") if gone else None
        index = index.update(spark.createDataFrame(list(new.values()), FILES), dead)
        old = {i: r for i, r in (old | new).items() if i not in gone}
    files = spark.createDataFrame(list(old.values()), FILES)
    same(spark, index, files, lanes=True)
    whole = index.compacted(f"{tmp_path}/b", per_shard=10)
    assert whole.segments == [0] and sorted(whole.words().collect()) == sorted(index.words().collect())
    same(spark, whole, files)


def test_only_promising_shards_are_read(spark, tmp_path):
    rare = [(i, "", "", "m", "common " * 3 + ("rare " * 5 if i in (5, 700) else "other")) for i in range(2000)]
    index = P.Index.create(spark.createDataFrame(rare, FILES), str(tmp_path), per_shard=50)
    q, report = spark.createDataFrame([(0, "rare common")], "qid long, query string"), []
    assert rows(P.top(index, q, 2, report=report)) == rows(R.bm25(spark.createDataFrame(rare, FILES), q, 2, prefix=False))
    assert report[0] == 40 and report[1] <= 3


def test_search_by_the_index_is_search_by_texts(spark, tmp_path):
    files = spark.createDataFrame(made(range(40), 7), FILES)
    index = P.Index.create(files, str(tmp_path), per_shard=9)
    assert rows(R.search(files, asked(spark), 10, index=index)) == rows(R.search(files, asked(spark), 10))
    with pytest.raises(ValueError):
        R.search(files, asked(spark), prefilter=True, index=index)


def test_words_of_texts_meet_a_query_without_a_shuffle_of_their_own(spark, tmp_path):
    files = spark.createDataFrame(made(range(40), 3), FILES)
    index = P.Index.create(files, str(tmp_path), per_shard=9)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for options in ({"prefix": False}, {"prefix": True}, {"index": index}):
            plan = R.bm25(files, asked(spark), 5, n_queries=7, **options)._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_an_update_shuffles_no_block(spark, tmp_path):
    files = spark.createDataFrame([(i, f"doc_{i}.txt", f"w{i % 5} common") for i in range(40)], "id long, filename string, content string")
    index = P.Index.create(files, str(tmp_path), per_shard=4)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        blocks = index.touched(spark.createDataFrame([(3,), (7,), (3,)], "id long"))
        plan = blocks._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        held = {r[0] for r in blocks.select("entries.id").selectExpr("explode(id)").collect()}
        assert {3, 7} <= held < set(range(40))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
