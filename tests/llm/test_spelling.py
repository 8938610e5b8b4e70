import random
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import spelling


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = (a, b) if len(a) < len(b) else (b, a)
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(words, times):
    """By comparing all pairs."""
    out = {}
    for w, n in words.items():
        others = sorted((-m, o) for o, m in words.items() if o != w and one_apart(w, o))
        form = others[0][1] if others and -others[0][0] >= times * n else None
        out[w] = [form, w, n, len(others), words[form] if form else None]
    for w, r in out.items():
        while out[r[1]][0]:
            r[1] = out[r[1]][0]
    return {w: tuple(r) for w, r in out.items()}


def found(df, times):
    rows = spelling.variants(df, times).collect()
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(got) == len(rows)
    return got


@settings(max_examples=6, deadline=None)
@given(st.dictionaries(st.text("aab*é👍", max_size=5), st.integers(1, 5000), max_size=60))
def test_matches_all_pairs(spark, words):
    df = spark.createDataFrame([(w, n, 0, "") for w, n in words.items()], "word string, n int, rest int, me string")
    assert found(df, 3) == plain(words, 3)


def test_chains_lead_to_the_last_form(spark):
    words = {"a" * k: 10**k for k in range(1, 12)} | {"b" + "a" * k: 1 for k in range(1, 5)}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    got = found(df, 10)
    assert got == plain(words, 10)
    assert got["a"][1] == "a" * 11


def test_odd_words(spark):
    df = spark.createDataFrame([(None, 5), ("x", None), ("y", 0), ("", 50), ("z", 5)], "word string, n long")
    assert found(df, 10) == {"": (None, "", 50, 1, None), "z": ("", "", 5, 1, 50)}
    assert found(df.limit(0), 10) == {}
    with pytest.raises(ValueError):
        spelling.variants(df, 1)


def test_query_counts_runs_of_whole_texts(spark, tmp_path):
    rng = random.Random(9)
    base = ["Ähnlich-wörter", "strasse×n", "international", "internationl", "foo bar12 bazquux", "ÉCOLEÉCOLE", "écoleécole", "mississippi mississipi", "MISSISSIPPI"]
    texts = [None, "", " \n"] + [" ".join(rng.choices(base, k=rng.randint(1, 80))) for _ in range(60)] + ["international " * 20_000]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "international mississippi"), (5, texts[5]), (5, texts[6])]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    words = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            words[run] += 1
    want = plain({w: n for w, n in words.items() if len(w) >= 7 and n >= 2}, 10)
    rows = spelling.op13_spelling_variants(spark, str(tmp_path)).collect()
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows} == want and len(rows) == len(want)
