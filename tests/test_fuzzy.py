import random

import pytest

from tessera.operators import fuzzy


def plain(words, names, least):
    return {(w, n, round(s, 9)) for w in words for n in names if (s := fuzzy.partial_ratio(w, n)) >= least}


@pytest.mark.parametrize("seed, letters, least", [(1, "ab", 70), (2, "abcdefgh", 70), (3, "abc_é👍", 85)])
def test_near_names_are_those_of_all_pairs(spark, seed, letters, least):
    rng = random.Random(seed)
    made = lambda n, longest: {"".join(rng.choices(letters, k=rng.randint(0, longest))) for _ in range(n)}
    words, names = made(60, 9), made(60, 14)
    for w in list(words)[:20]:  # a word's letters, some lost, within a name
        kept = "".join(c for c in w if rng.random() > 0.2)
        names.add(rng.choice(letters) * rng.randint(0, 3) + kept + rng.choice(letters) * rng.randint(0, 3))
    got = fuzzy.near_names(spark.createDataFrame([(w,) for w in [*words, None, "ab", "ab"]], "word string"), spark.createDataFrame([(n,) for n in [*names, None]], "name string"), least).collect()
    assert {(r.word, r.name, round(r.score, 9)) for r in got} == plain(words | {"ab"}, names, least) and len(got) == len({(r.word, r.name) for r in got})


def test_bound_holds_for_every_string():
    rng = random.Random(5)
    for _ in range(20_000):
        a, b = ("".join(rng.choices("abcd", k=rng.randint(1, 12))) for _ in range(2))
        a, b = sorted((a, b), key=len)
        pairs = lambda t: [t[i] + t[i + d] for d in (1, 2) for i in range(len(t) - d)]
        x, y = pairs(a), pairs(b)
        if fuzzy.partial_ratio(a, b) >= 70:
            assert sum(min(x.count(p), y.count(p)) for p in set(x)) >= fuzzy.least_shared(len(a), 70)


def test_real_names_and_no_nested_loop(spark):
    d = "/root/testdata/sf0.001"
    from tessera.plans import registry

    q = registry.queries()
    out = q["fuzzy_part_names"](spark, d)
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString() and "Cartesian" not in out._jdf.queryExecution().executedPlan().toString()
    p = spark.read.parquet(f"{d}/part.parquet").collect()
    from tessera.functions import text as T
    from pyspark.sql import functions as F

    words = {r[0] for r in spark.read.parquet(f"{d}/part.parquet").select(F.explode(T.tokens(F.col("p_name")))).collect()}
    names = {r.p_type.lower() for r in p} | {r.p_brand.lower() for r in p}
    assert {(r.word, r.name, r.score) for r in out.collect()} == {(w, n, round(s, 6)) for w, n, s in plain(words, names, 70)}
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id").collect()
    b = spark.read.parquet(f"{d}/benchmark.parquet").collect()
    asked = {w for r in b for w in fuzzy_words(r.text) if len(w) >= 4}
    best = {}
    for w, _, s in plain(asked, {f"doc_{r.doc_id}.txt" for r in docs}, 70):
        best[w] = max(best.get(w, 0), round(s, 6))
    assert {r.query: r.best for r in q["fuzzy_partial_ratio"](spark, d).collect()} == best


def fuzzy_words(text):
    import re

    return re.findall(r"\b\w+\b", " ".join(text.split(" ")[:6]).lower())


def test_names_that_differ_in_letters_no_word_has_are_one_shape(spark):
    words, names = ["text", "doc", "x", "", "tx👍"], [f"doc_{i}.txt" for i in range(200)] + ["", "_", "7", "\u0000doc", "tex👍", "d1o2c", "15", "16"]
    w, n = spark.createDataFrame([(x,) for x in [*words, None]], "word string"), spark.createDataFrame([(x,) for x in [*names, None]], "name string")
    shapes = {r.name: r.shape for r in fuzzy.shaped(w, n).collect()}
    assert shapes["doc_12.txt"] == shapes["doc_99.txt"] == "doc\0\0\0\0txt" and shapes["15"] == shapes["16"] == "\0\0" and shapes[""] == "" and len(shapes) == len(names)
    assert len(set(shapes.values())) == 9
    got = fuzzy.near_names(w, n, 70)
    assert {(r.word, r.name, round(r.score, 9)) for r in got.collect()} == plain(words, names, 70)
    odd = ["\u0000\u0000", "doc"]  # a word that has the mark itself
    got = fuzzy.near_names(spark.createDataFrame([(x,) for x in odd], "word string"), n, 70)
    assert {(r.word, r.name, round(r.score, 9)) for r in got.collect()} == plain(odd, names, 70)
