"""Links between files: what they lead to, which files hang together in circles, in which layers they stand, and what they say of a project."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import catalog
from tessera.operators import projects as P
from tessera.operators.lineage import cut

#: How a file names another, how much of a text and how many files of a project are looked at, how many links are counted;
#: the suffixes that are looked at; names of test files; readme and change files; least files and share for a consistent naming.
IMPORT, CHARACTERS, CODE_FILES, MOST_LINKS = r"(?:from|import|require|use|include)\s*(?:\(|from)?\s*['\"]([^'\"]+)['\"]", 8000, 300, 10
CODE = ["py", "js", "ts", "tsx", "jsx", "go", "rs", "java", "kt", "php", "rb"]
TEST = r"^test_|_test\.py$|\.test\.|\.spec\."
READMES, CHANGES = ["README", "README.md", "README.txt"], ["CHANGELOG", "CHANGELOG.md", "HISTORY.md"]
LEAST_FILES, LEAST_SHARE = 8, 0.65


def suffixes(path: Column) -> Column:
    """The path's last segment, its last two, and so on, up to the whole path; empty segments and . don't count."""
    parts = F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))
    return F.when(F.size(parts) > 0, F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.size(parts) - n + 1, n), "/"))).otherwise(F.array().cast("array<string>"))


def resolved(links: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, link, target) of links (source, link): the path among targets (path) that ends with the link's longest suffix of segments
    that any of them ends with; of several the shortest path, then the first. Links that end like no path are left out.

    Both sides meet by equal suffixes. Only the suffixes that links ask for are kept of the targets, and of each only its best path, so a
    name that many paths end with brings one row."""
    asked = links.select("source", "link", F.explode(F.array_distinct(suffixes(F.col("link")))).alias("end")).distinct()
    ends = targets.select("path", F.explode(suffixes(F.col("path"))).alias("end")).join(asked.select("end").distinct(), "end", "left_semi")
    best = ends.groupBy("end").agg(F.min(F.struct(F.length("path").alias("n"), "path"))["path"].alias("target"))
    found = asked.join(best, "end")
    return found.groupBy("source", "link").agg(F.max_by("target", F.length("end")).alias("target"))


def ends_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("u").alias("node")).unionByName(edges.select(F.col("v").alias("node"))).distinct()


def trimmed(edges: DataFrame) -> DataFrame:
    """edges without those of nodes that none leads to, or that lead to none, over and over: such nodes are in no circle."""
    while True:
        left = cut(edges.join(edges.select(F.col("v").alias("u")).distinct(), "u", "left_semi").join(edges.select(F.col("u").alias("v")).distinct(), "v", "left_semi").select("u", "v"))
        if left.count() == edges.count():
            return left
        edges = left


def strong(edges: DataFrame) -> DataFrame:
    """(node, component) of all ends of directed edges (u, v): the smallest node of those that lead to a node and are led to by it.

    By colours: each node takes the largest node that leads to it; those of one colour that lead back to the colour's own node are a
    component and go, with what then can't be in a circle. Rounds grow with the length of the longest path, and each brings at least one
    component; all are joins and aggregations by node, over the edges that are left. Null ends and loops are left out.
    """
    edges = edges.where("u is not null and v is not null and u <> v").select("u", "v").distinct()
    edges = cut(edges)
    nodes, found, left = ends_of(edges), None, trimmed(edges)
    while not left.isEmpty():
        colour = cut(ends_of(left).select("node", F.col("node").alias("colour"), F.lit(True).alias("moved")))
        while not colour.where("moved").isEmpty():
            came = left.join(colour.where("moved").select(F.col("node").alias("u"), "colour"), "u").groupBy(F.col("v").alias("node")).agg(F.max("colour").alias("came"))
            new = colour.join(came, "node", "left").select("node", F.greatest("colour", "came").alias("colour"), F.coalesce(F.col("came") > F.col("colour"), F.lit(False)).alias("moved"))
            colour = cut(new)
        colour = colour.select("node", "colour")
        inside = left.join(colour.select(F.col("node").alias("u"), F.col("colour").alias("c")), "u").join(colour.select(F.col("node").alias("v"), "colour"), "v").where("c = colour").select("u", "v")
        inside = cut(inside)
        back = colour.where("node = colour")
        front = back
        while True:
            step = inside.join(front.select(F.col("node").alias("v"), "colour"), "v").select(F.col("u").alias("node"), "colour").distinct()
            front = cut(step.join(back.select("node"), "node", "left_anti"))
            if front.isEmpty():
                break
            back = cut(back.unionByName(front))
        found = back if found is None else found.unionByName(back)
        gone = back.select("node")
        left = trimmed(cut(left.join(gone.select(F.col("node").alias("u")), "u", "left_anti").join(gone.select(F.col("node").alias("v")), "v", "left_anti").select("u", "v")))
    if found is None:
        return nodes.select("node", F.col("node").alias("component"))
    least = found.groupBy("colour").agg(F.min("node").alias("component"))
    named = found.join(least, "colour").select("node", "component")
    return cut(nodes.join(named, "node", "left").select("node", F.coalesce("component", "node").alias("component")))


def layers(edges: DataFrame) -> DataFrame:
    """(node, component, layer): nodes that lead to none outside their circle are in layer 0, the others one above the highest that they lead
    to. One round a layer, over the links between components that are left."""
    parts = strong(edges)
    of = lambda end: parts.select(F.col("node").alias(end), F.col("component").alias(f"c_{end}"))
    left = cut(edges.join(of("u"), "u").join(of("v"), "v").where("c_u <> c_v").select(F.col("c_u").alias("u"), F.col("c_v").alias("v")).distinct())
    open_, layer, out = cut(parts.select(F.col("component").alias("node")).distinct()), 0, None
    while not open_.isEmpty():
        now = cut(open_.join(left.select(F.col("u").alias("node")), "node", "left_anti").withColumn("layer", F.lit(layer)))
        out = now if out is None else out.unionByName(now)
        open_ = cut(open_.join(now.select("node"), "node", "left_anti"))
        left = cut(left.join(now.select(F.col("node").alias("v")), "v", "left_anti"))
        layer += 1
    if out is None:
        return parts.withColumn("layer", F.lit(0))
    return parts.join(out.withColumnRenamed("node", "component"), "component").select("node", "component", "layer")


def rolled_up(files: DataFrame) -> DataFrame:
    """(folder, files, bytes) of every folder above any of the files (path, size), itself and all below it counted."""
    above = F.transform(F.sequence(F.lit(1), F.size("parts") - 1), lambda n: F.array_join(F.slice("parts", 1, n), "/"))
    rows = files.groupBy(P.folder(F.col("path")).alias("own")).agg(F.count("*").alias("n"), F.sum("size").alias("s"))  # before folders are taken apart
    rows = rows.withColumn("parts", F.split(F.concat("own", F.lit("/x")), "/")).where(F.size("parts") > 1)
    return rows.select(F.explode(above).alias("folder"), "n", "s").groupBy("folder").agg(F.sum("n").alias("files"), F.sum("s").alias("bytes"))


def signals(files: DataFrame) -> DataFrame:
    """catalog.SIGNALS but the marker ones, and what they come from, of files (root, path, content), paths relative to their root.

    Links count, up to MOST_LINKS, that a root's first CODE_FILES files of code, by path, make within their first CHARACTERS: to relative
    paths, or to a file's name without its suffix. Files in noise folders are no signal but for these folders themselves."""
    parts, name = F.split("path", "/"), F.element_at(F.split("path", "/"), -1)
    noise = F.array_intersect(F.slice(parts, 1, F.size(parts) - 1), F.array(*[F.lit(x) for x in P.NOISE_FOLDERS]))
    rows = files.select("root", "path", "content", name.alias("name"), noise.alias("noise"), F.regexp_replace(name, r"(?<=.)\.[^.]*$", "").alias("stem"))
    folders = rows.where(F.size("noise") > 0).select("root").distinct().withColumn("generated_or_dependency_dirs", F.lit(True))
    own = rows.where(F.size("noise") == 0)
    styles = own.groupBy("root", T.name_style(F.col("stem")).alias("style")).agg(F.count("*").alias("n"))
    # Of equally frequent styles the first in this order counts.
    order = {"snake": 3, "kebab": 2, "camel": 1, "other": 0}
    main = styles.groupBy("root").agg(F.max(F.struct("n", F.create_map(*[F.lit(x) for kv in order.items() for x in kv])[F.col("style")].alias("o"), "style")).alias("m"))
    top = F.size(F.split("path", "/")) == 1
    counts = own.groupBy("root").agg(F.count("*").alias("files"), F.count_if(F.lower("name").rlike(TEST)).alias("tests"), F.bool_or(top & F.col("name").isin(READMES)).alias("readme"), F.bool_or(top & F.col("name").isin(CHANGES)).alias("changes"))
    place = F.row_number().over(Window.partitionBy("root").orderBy("path"))
    code = own.where(T.suffix(F.col("name")).isin(CODE)).select("root", "path", place.alias("place")).where(F.col("place") <= CODE_FILES).select("root", "path")
    texts = own.select("root", "path", F.left("content", F.lit(CHARACTERS)).alias("content")).join(code, ["root", "path"])
    found = texts.select("root", "path", F.explode(F.regexp_extract_all("content", F.lit(IMPORT), F.lit(1))).alias("link")).withColumn("link", F.trim("link"))
    last = F.lower(F.element_at(F.split(F.element_at(F.split("link", "/"), -1), r"\."), -1))
    bases = own.select("root", F.lower("stem").alias("base")).distinct()
    inner = found.withColumn("base", last).join(bases.withColumn("there", F.lit(True)), ["root", "base"], "left")
    links = inner.where(F.coalesce("there", F.lit(False)) | F.col("link").rlike("^[./]")).groupBy("root").agg(F.least(F.count("*"), F.lit(MOST_LINKS)).alias("links"))
    out = rows.select("root").distinct()
    for more in (counts, main, links, folders):
        out = out.join(more, "root", "left")
    n, share = F.coalesce("files", F.lit(0)), F.col("m.n") / F.col("files")
    consistent = (n >= LEAST_FILES) & (F.col("m.style") != "other") & (share >= LEAST_SHARE)
    true = lambda c: F.coalesce(c, F.lit(False))
    return out.select(
        "root", n.alias("files"), F.coalesce("tests", F.lit(0)).alias("n_tests"), F.coalesce("links", F.lit(0)).alias("n_links"), F.col("m.style").alias("style"), F.round(share, 6).alias("share"),
        true(F.col("tests") > 0).alias("test_files"), true(F.col("links") > 0).alias("inter_file_imports"), true(F.col("readme") | F.col("changes")).alias("readme_or_changelog"), true(consistent).alias("consistent_naming"), true(F.col("generated_or_dependency_dirs")).alias("generated_or_dependency_dirs"),
    )


def project_scores(files: DataFrame, threshold: int = 40) -> DataFrame:
    """catalog.project_score() of each root, all eight signals taken from the files (root, path, content)."""
    top, name = F.size(F.split("path", "/")) == 1, F.element_at(F.split("path", "/"), -1)
    marks = files.groupBy("root").agg(F.bool_or(F.element_at(F.split("path", "/"), 1).isin(P.VCS)).alias("vcs_marker"), F.bool_or(top & name.isin(P.MANIFESTS)).alias("language_manifest"), F.bool_or(top & name.isin(P.FRAMEWORKS)).alias("framework_config"))
    return catalog.project_score(signals(files).join(marks, "root"), threshold)
