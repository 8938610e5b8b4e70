import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.llm import merkle

SHAPE = "doc_id long, source string, lang string, n_chars long, text string, idx long, leaf string, g int"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def framed(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def plain_tree(nodes, fanout):
    """The last node, and each node's (before, after) of each level."""
    paths, held = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        nodes_up, held_up = [], []
        for i in range(0, len(nodes), fanout):
            run = nodes[i : i + fanout]
            for k in range(len(run)):
                for m in held[i + k]:
                    paths[m].append(("".join(run[:k]), "".join(run[k + 1 :])))
            nodes_up.append(sha(*run))
            held_up.append([m for part in held[i : i + fanout] for m in part])
        nodes, held = nodes_up, held_up
    return nodes[0], paths


def plain(rows, fanout):
    """Counts of (doc_id, leaf, subroot, root, path)."""
    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append((r[0] is not None, r[0] or 0, sha(*map(framed, r[:5]))))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: plain_tree([x[2] for x in sorted(groups[g])], fanout) for g in names}
    root, above = plain_tree([trees[g][0] for g in names], fanout)
    out = Counter()
    for g, up in zip(names, above):
        for (known, i, leaf), path in zip(sorted(groups[g]), trees[g][1]):
            out[i if known else None, leaf, trees[g][0], root, tuple(path + up)] += 1
    return out


def made(n, seed):
    rng = random.Random(seed)
    texts = [None, "", "a\nb", "é\n\n", "x" * 50_000, "tie"]
    rows = [(rng.choice([None, *range(n)]), rng.choice([None, "", "+", "hot", "hot", "hot", "é", "z", "Z"]), rng.choice([None, "en"]), rng.choice([None, 3]), rng.choice(texts), 0, "l", 1) for _ in range(n)]
    return rows + rows[: n // 4]


@pytest.mark.parametrize("n, fanout", [(1, 3), (4, 2), (150, 3), (150, 7)])
def test_proofs_match_a_plain_tree(spark, n, fanout):
    rows = made(n, n + fanout)
    docs = spark.createDataFrame(rows, SHAPE).repartition(5)
    got = merkle.build(docs, fanout=fanout, keep={"doc_id": docs["doc_id"], "path_": F.lit(1)}).proofs
    found = Counter((r.doc_id, r.leaf, r.subroot, r.root, tuple(tuple(s) for s in r.path)) for r in got.collect())
    assert found == plain(rows, fanout)


def test_nodes_hold_every_level(spark):
    docs = spark.createDataFrame([(i, f"s{i % 4 // 3}", "en", 1, f"t{i}", 0, "", 0) for i in range(20)], SHAPE)
    nodes = [r.asDict() for r in merkle.build(docs).nodes.collect()]
    assert Counter((r["part"], r["group"], r["level"]) for r in nodes) == {("group", "s0", 0): 15, ("group", "s0", 1): 5, ("group", "s0", 2): 2, ("group", "s0", 3): 1, ("group", "s1", 0): 5, ("group", "s1", 1): 2, ("group", "s1", 2): 1, ("root", None, 0): 2, ("root", None, 1): 1}
    at = {(r["part"], r["group"], r["level"], r["idx"]): r["digest"] for r in nodes}
    assert at["group", "s0", 1, 1] == sha(*[at["group", "s0", 0, i] for i in (3, 4, 5)])
    assert at["root", None, 1, 0] == sha(at["root", None, 0, 0], at["root", None, 0, 1])


def test_empty_table_and_bad_fanout(spark):
    docs = spark.createDataFrame([], SHAPE)
    out = merkle.build(docs)
    assert out.proofs.count() == 0 and out.nodes.count() == 0
    with pytest.raises(ValueError):
        merkle.build(docs, fanout=1)


def test_tampering_shows(spark, tmp_path):
    rows = [(i, "hot" if i % 3 else None, None, i, "a\nb" if i % 2 else "ab", 0, "", 0) for i in range(40)] + [(None, "hot", "en", 1, "a\nb", 0, "", 0), (50, "hot", "en", 1, None, 0, "", 0)]
    spark.createDataFrame(rows, SHAPE).write.parquet(f"{tmp_path}/documents.parquet")
    import zlib

    for r in merkle.op11_merkle_manifest(spark, str(tmp_path)).collect():
        hit = r.doc_id is not None and r.doc_id < 50 and r.doc_id % 2 == 1 and zlib.crc32(str(r.doc_id).encode()) % 2 == 0
        assert r.verified == (not hit) == (r.folded_root == r.root)
