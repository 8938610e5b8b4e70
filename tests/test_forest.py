import numpy as np

from tessera.operators import forest as V


def frame(spark, ids, x):
    return spark.createDataFrame([(int(i), [float(c) for c in v]) for i, v in zip(ids, x)], "id long, embedding array<float>")


def recall(forest, spark, ids, x, asked, k=5):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    q = spark.createDataFrame([(int(i), [float(c) for c in x[list(ids).index(i)]]) for i in asked], "qid long, q array<float>")
    got = {}
    for r in forest.nearest(q, k).collect():
        got.setdefault(r.qid, set()).add(r.id)
    hits = 0
    for i in asked:
        best = set(np.asarray(ids)[np.argsort(-(u @ u[list(ids).index(i)]), kind="stable")[:k]].tolist())
        hits += len(best & got.get(i, set()))
    return hits / (k * len(asked))


def test_forest_is_kept_up_leaf_by_leaf(spark, tmp_path):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(20, 24))
    x = (centres[rng.integers(0, 20, 600)] + rng.normal(size=(600, 24)) * 0.5).astype(np.float32).astype(float)
    ids = np.arange(600)
    f = V.Forest.build(frame(spark, [*ids, 9000, 9001], [*x, np.zeros(24), np.ones(24)]).where("id <> 9001"), str(tmp_path), trees=6, leaf=32, group=200)
    assert f.status().first()[:2] == (600, f.leaves.rows().select("leaf").distinct().count()) and not f.dirty
    assert f.leaves.rows().groupBy("leaf").count().agg({"count": "max"}).first()[0] <= 32 and f.leaves.rows().count() == 6 * 600
    assert recall(f, spark, ids, x, ids[::20]) >= 0.9

    before = {(r.leaf, r.id): tuple(r.vec) for r in f.leaves.rows().collect()}
    x[5], new = x[100] + 0.01, x[7] + 0.02
    f.change(frame(spark, [5, 700], [x[5], new]), spark.createDataFrame([(9,), (5000,)], "id long"))
    f.change(frame(spark, [8], [np.zeros(24)]))
    assert f.dirty and {(r.leaf, r.id): tuple(r.vec) for r in f.leaves.rows().collect()} == before
    touched = f.refreshed()
    after = {(r.leaf, r.id): tuple(r.vec) for r in f.leaves.rows().collect()}
    assert not f.dirty and f.refreshed() == 0 and 0 < touched <= 6 * 5 < len({leaf for leaf, _ in before})
    changed = {leaf for (leaf, i), v in (before.items() ^ after.items())}
    assert len(changed) <= touched + 12  # the touched, and what they have split into
    assert {i for _, i in after} == set(range(600)) - {8, 9} | {700} and len(after) == 6 * 599
    left = [i for i in range(600) if i not in (8, 9)] + [700]
    now = np.array([x[i] for i in left[:-1]] + [new]).astype(np.float32).astype(float)
    assert recall(f, spark, left, now, [*left[::20], 5, 700]) >= 0.9


def test_equal_vectors_and_tiny_forests(spark, tmp_path):
    same = frame(spark, range(100), [np.ones(4)] * 100)
    f = V.Forest.build(same, f"{tmp_path}/a", trees=2, leaf=10, group=40)
    assert f.leaves.rows().groupBy("leaf").count().agg({"count": "max"}).first()[0] <= 10
    q = spark.createDataFrame([(0, [1.0] * 4), (1, None)], "qid long, q array<double>")
    assert [(r.qid, r.id, r.score) for r in f.nearest(q, 3).orderBy("rank").collect()] == [(0, 0, 1.0), (0, 1, 1.0), (0, 2, 1.0)]
    f = V.Forest.build(same.limit(3), f"{tmp_path}/b", trees=2)
    assert f.status().first()[:3] == (3, 2, 0) and f.nearest(q, 5).count() == 3


def test_search_by_packs_finds_what_walking_the_trees_finds(spark, tmp_path):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(500, 8)) + np.repeat([[0.0] * 8, [4.0] * 8], [350, 150], axis=0)
    f = V.Forest.build(frame(spark, range(500), x), str(tmp_path), trees=3, leaf=12, group=100)
    f.change(frame(spark, [500, 501], [x[3], x[3] + 0.01]))
    asked = spark.createDataFrame([(i, [float(c) for c in x[i]]) for i in range(0, 500, 20)] + [(1000, [0.0] * 8)], "qid long, q array<double>")
    got = {g: {(r.qid, r.id, r.score, r.rank) for r in f.nearest(asked, 4, group=g).collect()} for g in (20_000, 40)}
    assert all(r[0] != 1000 for r in got[40])  # no direction, no cosine
    nodes, leaves = {r.node: r.plane for r in f.nodes().collect()}, {}
    for r in f.leaves.rows().collect():
        leaves.setdefault(r.leaf, []).append((r.id, np.array(r.vec)))
    plain = set()
    for i in range(0, 500, 20):
        q, todo, found = np.array(x[i], np.float64), ["0:", "1:", "2:"], {}
        while todo:
            name = todo.pop()
            if name not in nodes:
                found |= {id: round(float(q @ v / np.linalg.norm(q) / np.linalg.norm(v)), 9) for id, v in leaves.get(name, [])}
                continue
            angle = 0 if nodes[name] is None else q @ np.array(nodes[name]) / np.linalg.norm(q)
            todo += [name + s for s, goes in (("1", angle > 0), ("0", angle <= 0)) if goes or abs(angle) < V.MARGIN]
        plain |= {(i, id, s, n + 1) for n, (s, id) in enumerate(sorted((-s, id) for id, s in found.items())[:4])}
    plain = {(q, id, -s, n) for q, id, s, n in plain}
    assert got[20_000] == got[40] == plain
