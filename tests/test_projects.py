from pyspark.sql import functions as F

from tessera.operators import connector as C
from tessera.operators import projects as P


def test_roots(spark):
    paths = ["a/.git/HEAD", "a/x/package.json", "a/x/y/z.py", "b/pkg/go.mod", "b/pkg/c/d.go", "c/tsconfig.json", "c/w/q.ts", "d/e/f.txt", "top.py"]
    got = {r.folder: (r.root, r.method) for r in P.project_roots(spark.createDataFrame([(p,) for p in paths], "path string")).collect()}
    assert got["a/x/y"] == ("a", "vcs") and got["b/pkg/c"] == ("b/pkg", "manifest") and got["c/w"] == ("c", "framework")
    assert got["d/e"] == ("d/e", "fallback") and got[""] == ("", "fallback")


def test_listed_and_lines(spark):
    f = spark.createDataFrame([("B.py",), ("a.py",), ("n/c.txt",)], "path string")
    assert [r.path for r in P.listed(f, [".py"], most=1).collect()] == ["a.py"] and P.listed(f, exclude=["n/*"]).count() == 2 and P.listed(f, most=0).count() == 0
    t = spark.createDataFrame([("a\r\nb\x85c\n",), ("",), (None,)], "t string")
    got = t.select(P.line_range(F.col("t"), F.lit(2), F.lit(9)).alias("x"), P.line_range(F.col("t"), F.lit(5), F.lit(3)).alias("none")).collect()
    assert got[0].x == "b\nc" and got[0].none == "" and got[1].x == "" and got[2].x is None


def test_module_views(spark):
    facts = spark.createDataFrame([("a.py", "function", "f", 3), ("a.py", "class", "A", 1), ("a.py", "import", "os", 2), ("a.py", "import", "os", 9)], "path string, kind string, name string, line int")
    got = P.modules(facts).first()
    assert got.symbols == ["class:A:1", "function:f:3"] and got.imports == ["os"]


def test_properties(spark):
    values = [
        ('{"type": "title", "title": [{"plain_text": " A"}, {"text": {"content": "b "}}]}', "Ab"), ('{"type": "select", "select": null}', ""),
        ('{"type": "multi_select", "multi_select": [{"name": "x"}, {"name": ""}, {"name": "y"}]}', "x, y"), ('{"type": "date", "date": {"start": "2020", "end": null}}', "2020"),
        ('{"type": "number", "number": 0}', ""), ('{"type": "number", "number": 2.5}', "2.5"), ('{"type": "checkbox", "checkbox": false}', "false"),
        ('{"type": "people", "people": [{"id": "u1"}, {"name": "N", "id": "u2"}]}', "u1, N"), ('{"type": "relation", "relation": [{"id": "r"}]}', "r"),
        ('{"type": "formula", "formula": {"string": null, "number": 3}}', "3"), ('{"type": "rollup", "rollup": {}}', ""),
    ]
    rows = spark.createDataFrame(values, "v string, want string").select(C.property_text(F.from_json("v", C.PROPERTY)).alias("got"), "want")
    assert all(r.got == r.want for r in rows.collect())


def test_reached_goes_round_cycles(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 5)], "parent long, child long")
    assert sorted(map(tuple, C.reached(spark.createDataFrame([(1,)], "id long"), links).collect())) == [(1, 0), (2, 1), (3, 2)]


def test_tombstones(spark):
    stored = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "path string, id int")
    events = spark.createDataFrame([("a", "deleted", 1), ("a", "created", 2), ("b", "modified", 1), ("b", "deleted", 5)], "path string, change string, ts long")
    stays, gone = P.after_events(stored, events)
    assert sorted(r.path for r in stays.collect()) == ["a", "c"] and [tuple(r) for r in gone.collect()] == [("b", 5)]
