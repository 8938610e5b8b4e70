"""The operators and the pipeline's stages against plain versions, and the odd cases that they define."""

import itertools
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import sentencepiece

import corpus_pipeline
import public_tokenizers
from tessera.llm import entries, line_dedup, mixing, ngram_join, pii, quality, secrets_scan, threshold_topk, toxicity, vector_dedup
from tessera.llm.common import roots
from test_llm_operators import ODD, removable, table

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(entries.ORACLES))
def test_query_matches_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    cur = con.execute(entries.ORACLES[name])
    columns = [c[0] for c in cur.description]
    mine = entries.QUERIES[name](spark, SMALL)
    assert sorted(mine.columns) == sorted(columns)
    assert sorted(map(tuple, mine.select(*columns).collect())) == sorted(map(tuple, cur.fetchall()))


def test_long_vectors_and_rows_that_share_an_id(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(6, 1536))
    x = np.vstack([base, base + rng.normal(size=base.shape) * 0.05, base * 1e200, base * 1e-200])
    rows = [(i, [float(c) for c in v], 1) for i, v in enumerate(x)] + [(None, [float(c) for c in base[0]], 1), (3, [float(c) for c in base[3]], None), (50, [float(c) for c in base[0]], 1), (50, [float(c) for c in base[1]], 1)]
    df = spark.createDataFrame([(*r, 0, 1, 2) for r in rows], "vec_id long, embedding array<double>, label int, id int, key int, same int")
    got = sorted(((-1 if r.vec_id is None else r.vec_id, r.n_links, r.component_id, r.kept) for r in vector_dedup.link_vectors(df).collect()), key=str)
    # Of each base four are alike; id 50 has a copy of the first and one of the second, and joins the two.
    want = [(i, 3 + (i % 6 < 2), 0 if i % 6 < 2 else i % 6, i in (0, 2, 3, 4, 5)) for i in range(24)] + [(-1, 0, None, True), (3, 0, 3, True), (50, 4, 0, False), (50, 4, 0, False)]
    assert [g for g in got] == sorted(want, key=str)


def test_scores_beyond_float64(spark):
    big = 2**26 * 3.0
    rows = [(0, [big + 1, big + 3]), (100, [big + 5, big + 7]), (2, [big + 5, big + 9])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r.vec_id): r.score for r in threshold_topk.top_k(df, df.where("vec_id % 100 = 0"), scale=1).collect()}
    assert got == {(q, i): sum(int(a) * int(b) for a, b in zip(x, y)) for q, x in rows for i, y in rows if q % 100 == 0 and q != i}
    assert threshold_topk.top_k(df.limit(0), df).count() == threshold_topk.top_k(df, df.limit(0)).count() == 0


def plain_spans(text):
    out = []
    for kind, (name, pattern) in enumerate({"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}.items()):
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m[0] if c in "0123456789"]
            doubled = [d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(reversed(digits))]
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if name == "ip" else False, "card": 14 <= len(digits) <= 19 and sum(doubled) % 10 == 0, "phone": 10 <= len(digits) <= 15}[name]
            if ok:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_base_spans_by_plain_patterns():
    r = random.Random(8)
    bits = ["a", "b.c", "@", ".", "-", "+", " ", "1", "23", "4111111111111111", "4111 1111 1111 1111", "10.0.0.1", "256.1.1.1", "(212)", "555-0147", "+1", "é", "\n", "x@y.z", "%", "_", "0"]
    for _ in range(6000):
        text = "".join(r.choice(bits) for _ in range(r.randint(0, 14)))
        assert pii.base_spans(text) == plain_spans(text), text


def test_viterbi_by_all_taggings():
    rng = np.random.default_rng(0)
    for length in (1, 2, 4):
        e, move = rng.normal(size=(5, length, 5)), rng.normal(size=(5, 5))
        got = pii.viterbi(e, move)
        for run, tags in zip(e, got):
            cost = lambda t: sum(run[i, k] for i, k in enumerate(t)) + sum(move[a, b] for a, b in zip((0, *t), (*t, 0)))  # noqa: B023, E731
            assert tuple(tags) == max(itertools.product(range(5), repeat=length), key=cost)


def test_spans_do_not_depend_on_words_seen_before():
    words = ["ab.cd-" * 8 + "@host1", "ab.cd-" * 8 + "xhost1", "1" * 5, "1111+", "9" * 300 + "@h"]
    field = pii.train()
    alone = [pii.Finder(field).find([w])[0] for w in words]
    for order in itertools.permutations(range(len(words))):
        finder = pii.Finder(field)
        assert {i: finder.find([words[i]])[0] for i in order} == dict(enumerate(alone))


def test_pii_of_odd_rows(spark):
    rows = [(None, "a@b.cd"), (1, "a@b.cd"), (1, "a@b.cd"), (2, None), (3, "z " * 20000 + "a@b.cd")]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, spans int")
    assert sorted((str(r.doc_id), r.n_email) for r in pii.find_pii(df).collect()) == [("1", 1), ("1", 1), ("2", 0), ("3", 1), ("None", 1)]
    assert pii.find_pii(df.limit(0)).count() == 0


def test_ledgers(spark):
    docs = table(spark, ODD + [(i, f"token={i}abcdef and {'0123456789abcdef' * 2}{i:x}") for i in range(40)])
    whole = {r.doc_id: r.found for r in secrets_scan.findings(docs).collect()}
    full = secrets_scan.scan(docs).cache()
    part = full.where("pmod(hash(blob, rule), 3) <> 0")
    for ledger in (full, part, full.unionByName(part), full.unionByName(spark.createDataFrame([("x", None, [])], secrets_scan.empty_ledger(spark).schema))):
        assert {r.doc_id: r.found for r in secrets_scan.findings(docs, ledger).collect()} == whole
    assert secrets_scan.scan(docs, part).count() == full.count() - part.count()
    newer = tuple(secrets_scan.Rule(r.kind, 2, r.pattern, r.group, 12 if r.kind == "assign" else r.least) if r.kind == "assign" else r for r in secrets_scan.RULES)
    again = secrets_scan.scan(docs, full, newer)
    assert {r.rule for r in again.collect()} == {"assign@2"} and again.count() == full.select("blob").distinct().count()
    assert {r.doc_id: r.found for r in secrets_scan.findings(docs, full, newer).collect()} == {r.doc_id: r.found for r in secrets_scan.findings(docs, rules=newer).collect()}
    assert secrets_scan.findings(docs.limit(0), full).count() == 0


def test_toxic_scores_by_a_plain_scan(spark):
    """Scores of all texts from the model's numbers alone: every segment by brute force, then the curve."""
    docs, labels = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.score_texts(docs, model).collect()}

    def word(w):
        return next((model.scores[k] for k in [w] + [w[:n] + "*" for n in (7, 6, 5, 4) if len(w) > n] if k in model.scores), model.other)

    def best(s):
        top, at = 0.0, None
        total = np.concatenate([[0.0], np.cumsum(s)])
        low = 0
        for j in range(1, len(total)):
            if total[j] - total[low] > top + 1e-12:
                top, at = total[j] - total[low], (low, j)
            if total[j] <= total[low]:
                low = j
        return top, at

    def every(s):
        top, at = best(s)
        return [] if at is None else every(s[: at[0]]) + [top] + every(s[at[1] :])

    for r in docs.collect():
        s = [word(w) for w in re.findall(r"[^\W\d_]+", r.text.lower())]
        x = [model.rate * v - np.log(len(s)) - model.log_k for v in every(s)]
        top = max([-10.0, *x]) if s else -10.0
        rest = min(sum(v for v in x if v > 0) - max(top, 0.0), 60.0) if s else 0.0
        a, b, c = model.curve
        assert got[r.doc_id] == pytest.approx(1 / (1 + np.exp(-(a + b * min(top, 40.0) + c * rest))), abs=1e-6)


def test_toxic_training_takes_an_id_once(spark):
    docs = spark.createDataFrame([(i % 7, f"word{i % 7} foul" if i % 2 else "clean text", 1) for i in range(70)], "doc_id long, text string, y int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(7)], "doc_id long, toxic int")
    assert len(toxicity.score_texts(docs, toxicity.train(docs, labels)).collect()) == 70


def test_least_risk_has_no_slope(spark):
    """The weights that are found have a zero gradient, taken by differences of the risk over all rows."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 3)) + np.repeat([[0.0], [1.5]], 200, axis=0)
    rows = spark.createDataFrame([(i, bytearray(v.tobytes())) for i, v in enumerate(x)], "id long, x binary").repartition(5)
    m = quality.Model(x.mean(axis=0), x.std(axis=0), rng.normal(size=(3, 8)), rng.uniform(0, 6, 8), np.zeros(0))
    p, u, prior = quality.expanded(x[200:300], m), quality.expanded(x, m), 0.5
    w = quality.minimise(p, rows, m, prior, ridge=0.01)

    def risk(w):
        negative = np.logaddexp(0, u @ w).mean() - prior * np.logaddexp(0, p @ w).mean()
        assert negative >= 0
        return prior * np.logaddexp(0, -(p @ w)).mean() + negative + 0.005 * (w @ w)

    slope = [(risk(w + d) - risk(w - d)) / 2e-4 for d in np.eye(len(w)) * 1e-4]
    assert np.abs(slope).max() < 5e-3
    apart = quality.replace(m, weights=quality.minimise(p, rows, m, None))
    assert 0.3 < quality.estimated_prior(rows, apart, x[300:]) < 0.8


def test_mix_of_rows_that_share_an_id_or_have_none(spark):
    rows = [(None if i % 3 == 0 else 5, "w " * (i % 9), "a" if i % 2 else None, 1, 2) for i in range(90)] + [(5, "w w w", "a", 1, 2)] * 30
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, copies long, copy long").repartition(4)
    counts = mixing.copies(df.select("doc_id", "text", "source"))
    out = mixing.mixed(df)
    assert out.columns == df.columns and out.count() == counts.agg({"copies": "sum"}).first()[0] > 0
    words = lambda r: len((r.text or "").split())
    taken = Counter()
    for r in out.collect():
        taken[r.source] += words(r)
    for source, target in {(r.source, r.target) for r in counts.collect()}:
        assert abs(taken[source] - target) <= 0.1 * target + 20


def test_stages_against_plain_versions(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.distinct().collect()}
        out = line_dedup.cut_table(stage(spark, docs, SMALL))
        after = out.collect()
        if name == "toxicity":
            scores = {r.doc_id: r.score for r in toxicity.score_texts(docs, toxicity.train(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))).collect()}
            assert {r.doc_id for r in after} == {i for i, s in scores.items() if s < 0.5} and all(before[r.doc_id] == r for r in after)
        elif name == "line dedup":
            first, places = {}, defaultdict(list)
            for i in sorted(before):
                for k, line in enumerate(before[i].text.split("\n")):
                    if line.strip(" \t\x0b\f\r"):
                        first.setdefault(line, (i, k))
                        places[line].append((i, k))
            names = list(first)
            near = {names[i] for i in removable(names)}
            must = {p for line in names if line not in near for p in places[line] if p != first[line]}
            may = {p for line in near for p in places[line]}
            for r in after:
                kept = iter(r.text.split("\n"))
                lines = before[r.doc_id].text.split("\n")
                assert r.n_chars == len(r.text) and all(line in kept for line in [x for k, x in enumerate(lines) if (r.doc_id, k) not in must | may])
                assert len(r.text.split("\n")) <= len([k for k in range(len(lines)) if (r.doc_id, k) not in must])
            gone = sum(len(before[i].text.split("\n")) for i in before) - sum(len(r.text.split("\n")) for r in after)
            assert gone >= 0.95 * len(must | may)
        elif name == "n-gram join":
            sets = {}
            for i, r in before.items():
                w = r.text.lower().split()
                sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
            ids = sorted(sets)
            pairs = [(a, b) for a in range(len(ids)) for b in range(a) if (x := sets[ids[a]]) and (y := sets[ids[b]]) and 100 * len(x & y) >= 75 * len(x | y)]
            root = roots(len(ids), *np.array(pairs, int).reshape(-1, 2).T)
            assert sorted(r.doc_id for r in after) == [ids[i] for i in range(len(ids)) if root[i] == i]
        elif name == "mixing":
            con = duckdb.connect()
            con.register("documents", docs.toPandas())
            size = {i: len(re.findall(r"[^ \t\n\x0b\f\r]+", r.text)) for i, r in before.items()}
            want = {i: taken // size[i] for i, taken in con.execute(f"select doc_id, taken from ({entries.ORACLES['op10_mixing']})").fetchall() if taken}
            assert Counter(r.doc_id for r in after if size[r.doc_id]) == want
        else:
            sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
            assert len(after) == docs.count()
            for r in after:
                ids = sp.encode(before[r.doc_id].text, add_eos=True)
                assert (r.n_tokens, r.decoded) == (len(ids), sp.decode(ids))
        docs = out


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_take_odd_tables(spark, name, stage, tmp_path):
    spark.read.parquet(f"{SMALL}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    schema = spark.read.parquet(f"{SMALL}/documents.parquet").schema
    rows = [(1, "one two\nthree", "en", "a", 13), (1, "one two\nthree", "en", "a", 13), (None, "x", None, None, None), (2, None, "en", "b", None), (3, "", "en", "b", 0), (4, " \n", None, "c", 2), (5, "long " * 9000, "en", None, 45000)]
    for kept in (rows, []):
        df = spark.createDataFrame(kept, schema)
        out = stage(spark, df, str(tmp_path))
        assert out.count() >= 0 and (name == "pieces" or out.columns == df.columns)


def test_empty_and_repeated_documents_of_the_join(spark):
    docs = table(spark, ODD + ODD)
    got = {r.doc_id: r.component_id for r in ngram_join.link_texts(docs).collect()}
    assert got == {i: 1004 if i == 1005 else i for i, _ in ODD}
    assert ngram_join.one_of_each(docs).count() == 2 * (len(ODD) - 1)
