import random

import pytest

from tessera.operators import links as L


def plain_layers(edges):
    nodes = {n for e in edges for n in e}
    to = {n: {v for u, v in edges if u == n} for n in nodes}
    reach = {}
    for n in nodes:
        seen, todo = set(), [n]
        while todo:
            for v in to[todo.pop()] - seen:
                seen.add(v)
                todo.append(v)
        reach[n] = seen
    component = {n: min([n] + [m for m in reach[n] if n in reach[m]]) for n in nodes}
    layer = {}

    def depth(c):
        if c not in layer:
            below = {component[v] for n in nodes if component[n] == c for v in to[n]} - {c}
            layer[c] = max((depth(b) + 1 for b in below), default=0)
        return layer[c]

    return {(n, component[n], depth(component[n])) for n in nodes}


@pytest.mark.parametrize("n, m", [(12, 18), (40, 46)])
def test_circles_and_layers(spark, n, m):
    rng = random.Random(n)
    edges = {(u, v) for u, v in ((rng.randrange(n), rng.randrange(n)) for _ in range(m)) if u != v}
    df = spark.createDataFrame([*edges, *list(edges)[:3], (3, 3), (None, 1)], "u long, v long").repartition(3)
    assert {tuple(r) for r in L.layers(df).collect()} == plain_layers(edges)


def test_no_circle_and_no_edge(spark):
    df = spark.createDataFrame([(1, 2), (2, 3)], "u long, v long")
    assert {tuple(r) for r in L.strong(df).collect()} == {(1, 1), (2, 2), (3, 3)}
    assert L.layers(df.limit(0)).count() == 0 and L.strong(df.limit(0)).count() == 0


def test_links_go_to_the_longest_suffix(spark):
    targets = spark.createDataFrame([("a/b/c.py",), ("x/b/c.py",), ("q/c.py",), ("zz/y/b/c.py",)], "path string")
    links = spark.createDataFrame([("s", "b/c.py"), ("s", "./x/b/c.py"), ("s", "c.py"), ("s", "k/q/c.py"), ("s", "none.py"), ("t", "/y//b/c.py"), ("t", ""), ("t", None)], "source string, link string")
    got = {(r.source, r.link): r.target for r in L.resolved(links, targets).collect()}
    assert got == {("s", "b/c.py"): "a/b/c.py", ("s", "./x/b/c.py"): "x/b/c.py", ("s", "c.py"): "q/c.py", ("s", "k/q/c.py"): "q/c.py", ("t", "/y//b/c.py"): "zz/y/b/c.py"}
