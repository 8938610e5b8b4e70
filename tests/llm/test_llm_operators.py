import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest

import public_tokenizers
import sentencepiece
from tessera.llm import line_dedup, mixing, ngram_join, pieces, pii, quality, secrets_scan, threshold_topk, toxicity, vector_dedup
from tessera.llm.common import components, roots

MODEL = public_tokenizers.path("piece_bpe_32k.model")
SHAPE = "doc_id long, text string, source string, lang string, n_chars long, id long, u long, __id long"


def table(spark, texts, parts=3):
    rows = [(i, t, f"s{i % 3}" if i % 5 else None, "en", len(t or ""), -i, 0, 7) for i, t in texts]
    return spark.createDataFrame(rows, SHAPE).repartition(parts)


ODD = [(1000, None), (1001, ""), (1002, " \n\t"), (1003, "x" * 30000), (1004, "tie tie tie tie tie tie"), (1005, "tie tie tie tie tie tie")]


def test_components(spark):
    e = spark.createDataFrame([(5, 4), (4, 3), (3, 9), (20, 21), (7, 7), (None, 1)], "u long, v long")
    assert dict(map(tuple, components(e).collect())) == {3: 3, 4: 3, 5: 3, 9: 3, 20: 20, 21: 20}
    assert components(e.limit(0)).count() == 0


def test_vectors_link(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(30, 16))
    x = np.vstack([base, base[:20] + rng.normal(size=(20, 16)) * 0.1, base[:5] * 3, base[:5]])
    rows = [(i * 2, [float(c) for c in v], i % 3 % 2) for i, v in enumerate(x)]
    rows += [(901, None, 0), (903, [0.0] * 16, 0), (905, [float("nan")] + [1.0] * 15, 0), (907, [None] + [1.0] * 15, 0), (909, rows[0][1], None), (911, [], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    for tile in (4096, 7):
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vector_dedup.link_vectors(df, tile=tile).collect()}
        unit = x / np.linalg.norm(x, axis=1)[:, None]
        label = np.array([r[2] for r in rows[: len(x)]])
        link = (unit @ unit.T >= 0.98) & (label[:, None] == label)
        np.fill_diagonal(link, False)
        root = roots(len(x), *np.nonzero(link))
        for i in range(len(x)):
            assert got[2 * i] == (link[i].sum(), 2 * root[i], root[i] == i)
        assert all(got[i] == (0, i, True) for i in range(901, 912, 2)) and len(got) == len(rows)
    assert vector_dedup.link_vectors(df.limit(0)).count() == 0


def test_topk(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(-3, 4, size=(300, 8)) / 8
    rows = [(i, [float(c) for c in v], 0) for i, v in enumerate(x)] + [(400, None, 0), (500, [float("inf")] * 8, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    got = defaultdict(list)
    for r in sorted(threshold_topk.top_k(df, df.where("vec_id % 100 = 0"), tile=64).collect(), key=lambda r: r["rank"]):
        got[r.query_id].append((r.vec_id, r.score))
    q = np.floor(x * 1024).astype(int)
    for i in (0, 100, 200):
        s = q @ q[i]
        want = [(j, s[j]) for j in np.lexsort((np.arange(300), -s)) if j != i][:10]
        assert got[i] == want
    assert set(got) == {0, 100, 200}


def test_pii_base_and_field(spark):
    texts = ODD + [(1, "mail a.b@c.de and 1.2.3.4, card 4111 1111 1111 1111 or +1 (499) 555-6503."), (2, "1.2.3.4.5 a@b@c.de"), (3, "pay 1234 5678 9012 3456 now")]
    got = {r.doc_id: r for r in pii.find_pii(table(spark, texts)).collect()}
    assert (got[1].n_email, got[1].n_ip, got[1].n_card, got[1].n_phone) == (1, 1, 1, 1)
    assert got[1000].base_sha256 == hashlib.sha256(b"").hexdigest() and got[1000].spans == "" and len(got) == len(texts)
    assert got[3].n_card == 0 and got[3].spans == "card:4:23"
    assert pii.train().certain


def test_secrets(spark):
    pats = {"assign": r"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", "access": "AKIA[A-Z0-9]+", "hex": "[0-9a-f]+"}
    r = random.Random(3)
    bits = ["password", "Token", " ", "=", ":", "'", "abcdef", "12", "AKIA", "ABCDEFGHIJKLMNOP", "0123456789abcdef0123456789", "é", "😀", "API_KEY", "\n"]
    texts = ODD + [(i, "".join(r.choice(bits) for _ in range(r.randint(0, 25)))) for i in range(300)]
    docs = table(spark, texts)
    got = {x.doc_id: [(f.start, f.rank, f.end) for f in x.found if f.rank < 3] for x in secrets_scan.findings(docs).collect()}
    for i, t in texts:
        want = []
        for k, (name, p) in enumerate(pats.items()):
            for m in re.finditer(p, t or "", re.I if name == "assign" else 0):
                if name == "assign" and len(m[1]) >= 6 or name == "access" and len(m[0]) >= 20 or name == "hex" and len(m[0]) >= 24:
                    want.append((m.start(), k, m.end()))
        assert got[i] == sorted(want)
    ledger = secrets_scan.scan(docs)
    assert secrets_scan.scan(docs, ledger).count() == 0


def test_pieces_match_the_library(spark):
    codec, sp, r = pieces.Codec(pieces.read_model(MODEL)), sentencepiece.SentencePieceProcessor(model_file=MODEL), random.Random(1)
    names = [p.replace("▁", " ") for p in codec.t.halves]
    texts = [t for _, t in ODD] + ["".join(r.choice(" aaabcdethin\n\t▁ßé漢😀0123.,<s>\x00") for _ in range(r.randint(0, 40))) for _ in range(1500)] + ["".join(r.choice(names) for _ in range(6)) for _ in range(1500)]
    for t in texts:
        ids = sp.encode(t or "", add_eos=True)
        assert codec.encode(t) == ids and codec.decode(ids) == sp.decode(ids)
        assert codec.digest(t) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest())
    pairs = [(r.choice(list(codec.t.halves)), r.choice(list(codec.t.halves))) for _ in range(300)]
    assert all(codec.compatible(a, b) == (pieces.merged(a + b, codec.t.rank)[0] == [a, b]) for a, b in pairs)
    assert {x.doc_id for x in pieces.digests(table(spark, ODD), MODEL).collect()} == {i for i, _ in ODD}


def test_words_of_pieces_are_read_off_at_once(monkeypatch):
    codec, sp = pieces.Codec(pieces.read_model(MODEL)), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    monkeypatch.setattr(codec, "chunk", None)  # asked only for chunks with a character that isn't a piece
    for t in ("the quick brown fox, unhelpfulness", "été doublean", " two  spaces", "a"):
        ids = sp.encode(t, add_eos=True)
        assert codec.digest(t) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest())


def test_forgotten_pairs_are_found_again():
    codec = pieces.Codec(pieces.read_model(MODEL))
    first = codec.encode("unhelpfulness of the quick")
    codec.held = 200_000
    codec.chunks.clear(), codec.spaced.clear()
    assert codec.encode("forgetfulness") and codec.held < 200_000 and codec.encode("unhelpfulness of the quick") == first


def test_segments_are_maximal():
    r = random.Random(1)

    def brute(s):
        best = max(((sum(s[i:j]), i - j, -i) for i in range(len(s)) for j in range(i + 1, len(s) + 1)), default=(0, 0, 0))
        if best[0] <= 0:
            return []
        i = -best[2]
        j = i - best[1]
        return brute(s[:i]) + [best[0]] + brute(s[j:])

    for _ in range(400):
        s = [r.uniform(-2, 2) for _ in range(r.randint(0, 12))]
        assert [round(x[2], 9) for x in toxicity.segments(np.array(s))] == [round(v, 9) for v in brute(s)]


@pytest.mark.parametrize("op, label, least, auc", [(toxicity.op4_toxicity, "toxic", 0.5, 0.9), (quality.op9_quality, "quality", 0.3, 0.95)])
def test_held_out_accuracy(spark, op, label, least, auc):
    d = "/root/testdata/sf0.1"
    got = op(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").toPandas()
    y, rank = got[label].to_numpy() == 1, got["score"].rank().to_numpy()
    n = y.sum()
    assert (rank[y].sum() - n * (n + 1) / 2) / (n * (~y).sum()) > auc and ((got["score"] >= least) == y).mean() > 0.96


def test_scores_of_odd_rows(spark):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i, _ in ODD] + [(None, 1, 1), (1003, None, None)], "doc_id long, quality int, toxic int")
    rows = ODD + ODD[:2] + [(None, "no id"), (None, None)]
    docs = spark.createDataFrame([(i, t, "a", 0, 1, 2, 3) for i, t in rows], "doc_id long, text string, source string, y int, p int, score int, x int").repartition(3)
    found = [toxicity.score_texts(docs, toxicity.train(docs, labels)), toxicity.score_texts(docs, toxicity.train(docs.limit(0), labels.limit(0)))]
    found += [quality.quality(docs, labels), quality.quality(docs, labels.limit(0))]
    for got in found:
        got = got.collect()
        assert sorted(map(str, (r.doc_id for r in got))) == sorted(str(i) for i, _ in rows) and all(0 <= r.score <= 1 for r in got)
    assert quality.quality(docs.limit(0), labels).count() == 0
    kept = toxicity.without_toxic(docs, toxicity.train(docs.limit(0), labels.limit(0)), least=2.0)
    assert kept.columns == docs.columns and kept.count() == len(rows)


def test_lines(spark):
    line = "alpha bravo charlie delta echo foxtrot golf hotel india juliett kilo lima mike november oscar papa quebec romeo sierra tango uniform victor whiskey"
    texts = [(1, line + "\nkeep this one"), (2, line.replace("golf", "gulf")), (3, "other\n\nkeep this one\nother"), *ODD]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(table(spark, texts)).collect()}
    assert got[1] == texts[0][1] and got[2] == "" and got[3] == "other\n" and got[1000] is None and got[1002] == " \n\t"
    assert got[1004] == ODD[4][1] and got[1005] == "" and len(got) == len(texts)
    assert 2 not in {r.doc_id for r in line_dedup.dedup_lines(table(spark, texts), drop_emptied=True).collect()}
    assert line_dedup.dedup_lines(table(spark, texts).limit(0)).count() == 0


def test_ngram_join(spark, monkeypatch):
    r = random.Random(5)
    v, texts = [f"w{i}" for i in range(40)], list(ODD)
    base = [[r.choice(v) for _ in range(r.randint(1, 60))] for _ in range(25)]
    for i in range(350):
        b = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 2, 3])):
            b[r.randrange(len(b))] = r.choice([*v, f"z{r.random()}"])
        texts.append((i * 2, " ".join(b)))
    sets = {}
    for i, t in texts:
        w = (t or "").split()
        sets[i] = {tuple(w[j : j + min(5, len(w))]) for j in range(max(1, len(w) - 4))} if w else set()
    ids = sorted(sets)
    link = [(a, b) for a in range(len(ids)) for b in range(a) if (x := sets[ids[a]]) and (y := sets[ids[b]]) and 100 * len(x & y) >= 75 * len(x | y)]
    root = roots(len(ids), np.array([a for a, _ in link]), np.array([b for _, b in link]))
    want = {i: (len(sets[i]), ids[root[k]]) for k, i in enumerate(ids)}
    for cell in (2_000_000, 400):
        monkeypatch.setattr(ngram_join, "CELL", cell)
        assert {x.doc_id: (x.n_shingles, x.component_id) for x in ngram_join.link_texts(table(spark, texts)).collect()} == want
    assert ngram_join.link_texts(table(spark, texts).limit(0)).count() == 0


def test_mixing(spark):
    r = random.Random(2)
    texts = ODD + [(i, "w " * r.randint(1, 50)) for i in range(600)]
    docs = table(spark, texts)
    got = mixing.copies(docs).toPandas()
    assert len(got) == len(texts) and got["copies"].between(0, 2).all()
    whole = got.drop_duplicates("source")
    assert abs(whole["target"].sum() - 1.5 * got["size"].sum()) < 1e-6 and (whole["target"] <= 2 * whole["source_size"] + 1e-9).all()
    taken = (got["copies"] * got["size"]).groupby(got["source"].fillna("-")).sum()
    target = whole.set_index(whole["source"].fillna("-"))["target"].sort_index()
    assert (abs(taken - target) < 0.05 * target + 60).all()
    assert got.sort_values("doc_id")["copies"].tolist() == mixing.copies(docs).toPandas().sort_values("doc_id")["copies"].tolist()
    assert mixing.mixed(docs).columns == docs.columns and mixing.mixed(docs).count() == got["copies"].sum()
    assert mixing.copies(docs.limit(0)).count() == 0


def crowd():
    """Lines of one template that share much and are mostly below the similarity, and near copies of each."""
    import random

    pick = random.Random(7)
    words = [f"{a}{b}{c}" for a in ("bra", "chi", "del", "fox", "gol") for b in ("vo", "mer", "tan", "lis") for c in ("na", "rek", "sum", "ton")]
    frame = pick.sample(words, 24)
    lines = []
    for _ in range(60):
        line = frame.copy()
        for i in pick.sample(range(24), 5):
            line[i] = pick.choice(words)
        near = line.copy()
        near[pick.randrange(24)] = pick.choice(words)
        lines += [" ".join(line), " ".join(near)]
    return lines


def shingled(line):
    low = line.lower()
    return {low[j : j + 10] for j in range(max(1, len(low) - 9))}


def removable(lines, share=0.75):
    """Of distinct lines, the places of those that aren't their component's first, by comparing all that share a shingle."""
    sets, held = [shingled(x) for x in lines], defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            held[x].append(i)
    true = []
    for i, s in enumerate(sets):
        shared = defaultdict(int)
        for x in s:
            for j in held[x]:
                if j > i:
                    shared[j] += 1
        true += [(i, j) for j, n in shared.items() if n >= share * (len(s) + len(sets[j]) - n)]
    root = roots(len(lines), *np.array(true, int).reshape(-1, 2).T)
    return {i for i in range(len(lines)) if root[i] != i}


def test_lines_of_crowded_bands_are_compared_in_full(spark):
    """Lines removed are those that all pairs of one template's lines would have removed, and all pairs that share a band are compared."""
    lines = crowd()
    df = spark.createDataFrame([(i, line) for i, line in enumerate(lines)], "doc_id long, text string")
    expected = removable(lines)
    got = {r.doc_id for r in line_dedup.duplicate_lines(df).collect()}
    assert len(expected) > 30 and got <= expected and len(got) >= 0.95 * len(expected)

    s = line_dedup.signatures(df.select(df["text"].alias("line"))).toPandas()
    names, signs = {x.key: x.line for x in df.selectExpr("xxhash64(text) as key", "text as line").collect()}, s[[f"s{i}" for i in range(9)]].to_numpy()
    sets, keys = [shingled(names[k]) for k in s["key"]], s["key"].to_numpy()
    pairs = [(i, j) for i in range(len(s)) for j in range(i) if any((signs[i, b] == signs[j, b]).all() for b in map(list, line_dedup.BANDS)) and len(sets[i] & sets[j]) >= 0.75 * len(sets[i] | sets[j])]
    root = roots(len(s), *np.array(pairs).T)
    first = {}
    for i, k in enumerate(keys):
        place = lines.index(names[k])
        first[root[i]] = min(first.get(root[i], place), place)
    assert got == set(range(len(lines))) - set(first.values())
    members = line_dedup.banded(spark.createDataFrame(s))
    none = spark.createDataFrame([], "node long, component long")
    assert line_dedup.mixed_bands(members, none).groupBy("band").count().where("count <= 5").count() == 0


def test_bands_of_three_hold_every_pair_of_min_hashes_once():
    pairs = [p for b in line_dedup.BANDS for p in ((b[0], b[1]), (b[0], b[2]), (b[1], b[2]))]
    assert len(line_dedup.BANDS) == 12 and len({tuple(sorted(p)) for p in pairs}) == len(pairs) == 36


def test_lines_against_all_pairs_of_a_table(spark):
    """At least nine in ten of the lines that comparing all pairs would remove go, and no other line."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lines, places = {}, defaultdict(list)
    for r in docs.orderBy("doc_id").collect():
        for pos, line in enumerate((r.text or "").split("\n")):
            if line.strip(" \t\x0b\f\r"):
                lines.setdefault(line, (r.doc_id, pos))
                places[line].append((r.doc_id, pos))
    names = list(lines)
    near = {names[i] for i in removable(names)}
    equal = {p for line in names if line not in near for p in places[line] if p != lines[line]}
    fuzzy = {p for line in near for p in places[line]}
    got = {(r.doc_id, pos) for r in line_dedup.duplicate_lines(docs).collect() for pos in r.removed}
    assert equal <= got <= equal | fuzzy and len(got & fuzzy) >= 0.9 * len(fuzzy) > 0


def test_lines_of_odd_rows(spark):
    rows = [(None, "one line of a row without an id\ntwo"), (1, "one line of a row without an id\ntwo"), (1, "one line of a row without an id\ntwo"), (2, "x" * 20000 + " end"), (3, "x" * 20000 + " End"), (4, "two"), (5, ""), (6, None)]
    df = spark.createDataFrame([(i, t, 0, 1, 2, 3) for i, t in rows], "doc_id long, text string, removed int, cut int, id int, key int")
    out = line_dedup.dedup_lines(df)
    assert out.columns == df.columns
    got = sorted(((str(r.doc_id), r.text) for r in out.collect()), key=str)
    assert got == sorted([("None", rows[0][1]), ("1", rows[1][1]), ("1", rows[1][1]), ("2", rows[3][1]), ("3", ""), ("4", ""), ("5", ""), ("6", None)], key=str)


def test_lines_that_differ_in_case_or_short_words(spark):
    line = "Alpha Bravo Charlie Delta Echo Foxtrot Golf Hotel India Juliett Kilo Lima"
    short = "go to it as we do so on up at my ex or an ax"
    df = spark.createDataFrame([(1, line), (2, line.upper()), (3, short), (4, short.title())], "doc_id long, text string")
    assert {r.doc_id for r in line_dedup.duplicate_lines(df).collect()} == {2, 4}
    assert line_dedup.HASHES >= 9


def test_lines_are_compared_by_every_character(spark):
    """Short lines and lines without spaces are near copies too; numbers beyond the start of a word's window count."""
    chinese = "".join(chr(0x4E00 + 37 * i % 2000) for i in range(120))
    heading = "Licensed under the Apache License version 2.0"
    report = "Measured temperature humidity pressure visibility "
    texts = [chinese, chinese[:60] + "\u4e00" + chinese[61:], heading, heading + ".", "https://example.org/a/very/long/path/to/some/page/0001", "https://example.org/a/very/long/path/to/some/page/0002"]
    texts += [report + "12 45 77 31 90 26 58 14", report + "98 13 54 62 17 83 49 70", "ab", "AB", "cd"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in line_dedup.duplicate_lines(df).collect()} == {1, 3, 5, 9}
    found = df.select(line_dedup.shingle_set("text").alias("s")).collect()
    assert [len(r.s) for r in found] == [len(shingled(t)) for t in texts]


def test_lines_are_split_and_hashed_once(spark):
    """A text's lines aren't split off again for each line that stays, and blocks of hashes hold each shingle of a line and no other."""
    texts = ["ab", "Measured temperature humidity pressure visibility 12 45 77", "x" * 300, "", "a\U0001f600" * 40]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    plan = line_dedup.dedup_lines(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" in plan and "get(split(" not in plan
    rows = line_dedup.hashed(df, "text")
    sets = {r.doc_id: set(r.s) for r in df.select("doc_id", line_dedup.shingle_set("text").alias("s")).collect()}
    got = defaultdict(set)
    for r in rows.collect():
        got[r.doc_id] |= {r[h] for h in line_dedup.HASHED}
    assert got == sets and rows.count() == sum(-(-max(1, len(t.encode("utf-16-be")) // 2 - 9) // line_dedup.STEP) for t in texts)


def test_topk_counts_every_row_of_an_id(spark):
    rows = [(5, [0.1, 0.0]), (5, [0.9, 0.9]), (5, [0.9, 0.9]), (7, [0.5, 0.5]), (100, [1.0, 1.0]), (100, [1.0, 0.0]), (100, [1.0, 0.0]), (200, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    for tile, block in ((8192, 1024), (1, 1)):
        got = defaultdict(list)
        for r in threshold_topk.top_k(df, df.where("vec_id % 100 = 0"), k=4, tile=tile, block=block).collect():
            got[r.query_id].append((r["rank"], r.vec_id, r.score))
        want = defaultdict(list)
        for q, v in rows:
            if q % 100 == 0:
                scored = sorted((-sum(int(a * 1024 // 1) * int(b * 1024 // 1) for a, b in zip(v, w)), i) for i, w in rows if i != q)
                want[q] += [(n + 1, i, -s) for n, (s, i) in enumerate(scored[:4])]
        assert {q: sorted(x) for q, x in got.items()} == {q: sorted(x) for q, x in want.items()}


def test_topk_refuses_what_does_not_fit(spark):
    for rows in ([(0, [1e30]), (1, [1 / 1024])], [(0, [2.0**42]), (1, [2.0**42])]):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        with pytest.raises(Exception, match="ArithmeticError"):
            threshold_topk.top_k(df, df.where("vec_id = 0")).collect()


def test_mix_agrees_in_any_order_of_rows(spark):
    rng = random.Random(8)
    rows = [(None if i % 2 else 5, " ".join(rng.choices("abcdefgh", k=6)), "s", {"a": i % 3}, i % 4) for i in range(80)]
    seen = set()
    for seed in range(3):
        rng.shuffle(rows)
        df = spark.createDataFrame(rows, "doc_id long, text string, source string, m map<string,int>, mark int").repartition(seed + 2)
        seen.add(tuple(sorted((str(r.doc_id), r.text, r.m["a"], r.mark) for r in mixing.mixed(df).collect())))
    assert len(seen) == 1
