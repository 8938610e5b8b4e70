"""A Merkle manifest of a dataset, with DataFrame operations only.

Rows are leaves; the leaves of a group stand in one order, and every few consecutive nodes become their parent until one is left, the
group's subroot; subroots become the root in the same way. Each level is one window, by group and parent: its full frame, in order, is at once
what the parent hashes and what each child needs as siblings; the first child of each run carries the parent up, so that parents are there
once. Levels shrink by the fan-out, and each is written and read again. On the way back each node hands its own proof down to its children.
No group is held by one task: places in the order come from a range sort, whose parts are counted and offset, so a hot group is many parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut_table, drop_tables, table

FANOUT = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: monotonically_increasing_id() has the partition above, the row within it below.
PLACE_BITS = 33


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def framed(value: Column) -> Column:
    """A value so that no two rows of fields concatenate alike: `-` if null, else its length in UTF-8 bytes, a colon, and itself."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def group_key(group: Column) -> Column:
    """A group as text that sorts as groups do: null first, then by UTF-8 bytes."""
    return F.coalesce(F.concat(F.lit("+"), group.cast("string")), F.lit(""))


def numbered(rows: DataFrame, order: list[str], scratch: list[str]) -> DataFrame:
    """rows (g, ...) with idx, the place from 0 within g in the given order, and n, the number of rows of g.

    A range sort cuts the rows into parts; where a group begins in a part follows from the counts of that group in the parts before. The
    sorted rows are written first, so that parts stay what they were counted as when an executor is lost.
    """
    at = F.monotonically_increasing_id()
    rows = cut_table(rows.sort("g", *[F.col(c).asc_nulls_first() for c in order]).withColumn("at", at), scratch)
    part = F.shiftright("at", PLACE_BITS)
    counts = rows.groupBy("g", part.alias("part")).agg(F.min("at").alias("first"), F.count("*").alias("c"))
    line = Window.partitionBy("g").orderBy("part")
    before = F.sum("c").over(line.rowsBetween(Window.unboundedPreceding, 0)) - F.col("c")
    counts = counts.select("g", "part", (F.col("first") - before).alias("base"), F.sum("c").over(Window.partitionBy("g")).alias("n"))
    return rows.withColumn("part", part).join(counts, ["g", "part"]).withColumn("idx", F.col("at") - F.col("base")).drop("at", "base", "part")


def levels(leaves: DataFrame, fanout: int, scratch: list[str]) -> list[DataFrame]:
    """Tables (g, idx, n, h, before, after, up) from the leaves (g, idx, n, h, and what they carry) upwards: what stands before and after a
    node in its run, and the parent's digest with the run's first node. A group that is down to one node (n = 1) goes no further."""
    out, now = [], leaves
    while True:
        run = Window.partitionBy("g", F.floor(F.col("idx") / fanout)).orderBy("idx")
        place, several = (F.col("idx") % fanout).cast("int"), F.col("n") > 1
        tied = now.withColumn("run", F.collect_list("h").over(run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        before = F.when(several, F.array_join(F.slice("run", F.lit(1), place), ""))
        after = F.when(several, F.array_join(F.slice("run", place + 2, F.lit(fanout)), ""))
        up = F.when(several & (place == 0), digest(F.array_join("run", "")))
        out.append(cut_table(tied.withColumns({"before": before, "after": after, "up": up}).drop("run"), scratch))
        now = out[-1].where("up is not null").select("g", F.floor(F.col("idx") / fanout).alias("idx"), F.ceil(F.col("n") / fanout).alias("n"), F.col("up").alias("h"))
        if now.isEmpty():
            return out


def handed_down(tables: list[DataFrame], tops: DataFrame, fanout: int) -> DataFrame:
    """The lowest table with (path, subroot); tops: (g, level, subroot, path), a group's last node, its level and its proof from there.
    path holds what stands before and after a node on each level, from the lowest up. A node takes its parent's path, the last node of a
    group the group's: a group has nodes above a level or ends there, so both are found by one key."""
    paths = None
    for level in reversed(range(len(tables))):
        above = tops.where(F.col("level") == level).select("g", F.lit(0).cast("long").alias("parent"), "path", "subroot")
        if paths is not None:
            above = above.unionByName(paths.select("g", F.col("idx").alias("parent"), "path", "subroot"))
        below = tables[level].withColumn("parent", F.floor(F.col("idx") / fanout))
        step = F.when(F.col("n") > 1, F.array(F.struct("before", "after"))).otherwise(F.array().cast(PATH))
        paths = below.join(above, ["g", "parent"]).withColumn("path", F.concat(step, "path")).drop("parent", "before", "after", "up")
    return paths


PATH = "array<struct<before: string, after: string>>"


def tops_of(tables: list[DataFrame]) -> DataFrame:
    """(g, h, level): the node that each group ends with."""
    out = None
    for level, t in enumerate(tables):
        top = t.where("n = 1").select("g", "h", F.lit(level).alias("level"))
        out = top if out is None else out.unionByName(top)
    return out


class Manifest:
    """proofs: one row for each row of the dataset, (the kept columns, leaf, subroot, root, path). nodes: (part, group, level, idx, digest)
    of all levels, where part is `group` for the trees of the groups and `root` for the tree above them."""

    def __init__(self, proofs: DataFrame, nodes: DataFrame):
        self.proofs, self.nodes = proofs, nodes


def build(docs: DataFrame, group_col: str = "source", order_col: str = "doc_id", fields: tuple = FIELDS, fanout: int = FANOUT, keep: dict[str, Column] | None = None) -> Manifest:
    """The manifest of docs: a leaf for each row, hashed over the fields; in a group leaves ascend by order_col.

    keep: columns to hand on with the proofs, by name. Nulls are values of their own: in
    a field, as a group (which comes first) and in the order (first too). Rows that share a group and an order value stand by their leaf, then
    by what is kept, so repeated rows are leaves of their own, alike but in different places. Empty and very long texts are hashed whole. The
    empty table has no proofs and no nodes. Columns beside the fields don't matter, whatever their names.
    """
    if fanout < 2:
        raise ValueError("a fan-out of two at least")
    spark, scratch, written = docs.sparkSession, [], []  # written: what the results read
    kept = F.struct(*[c.alias(k) for k, c in keep.items()]) if keep else F.lit(None).cast("string")
    leaf = digest(*[framed(docs[f]) for f in fields])
    rows = docs.select(group_key(docs[group_col]).alias("g"), docs[order_col].alias("o"), leaf.alias("h"), kept.alias("kept"))
    rows = cut_table(rows, scratch)  # texts are hashed once; the sort below samples these small rows, not the texts
    tables = levels(numbered(rows, ["o", "h", "kept"], scratch).drop("o"), fanout, written)
    ends = cut_table(tops_of(tables).select(F.lit("").alias("g"), F.col("g").alias("o"), "h", "level"), scratch)
    subroots = cut_table(numbered(ends, ["o"], scratch))
    upper = levels(subroots.select("g", "idx", "n", "h"), fanout, written)
    last = tops_of(upper).withColumn("path", F.array().cast(PATH)).withColumnRenamed("h", "subroot")
    above = handed_down(upper, last, fanout).select("idx", "path", F.col("subroot").alias("root"))
    tops = subroots.select("idx", F.col("o").alias("g"), F.col("h").alias("subroot"), "level").join(above, "idx")
    # The root goes down with the subroot as one text, so that it needs no join of its own: both are of 64 characters.
    tops = cut_table(tops.select("g", "level", F.concat("subroot", "root").alias("subroot"), "path"))
    drop_tables(spark, scratch)
    proofs = handed_down(tables, tops, fanout).select(*[F.col("kept").getField(k).alias(k) for k in keep or ()], F.col("h").alias("leaf"), F.substring("subroot", 1, 64).alias("subroot"), F.substring("subroot", 65, 64).alias("root"), "path")
    nodes = None
    for part, some in (("group", tables), ("root", upper)):
        for level, t in enumerate(some):
            group = F.when(F.col("g").startswith("+"), F.expr("substring(g, 2)"))
            here = t.select(F.lit(part).alias("part"), group.alias("group"), F.lit(level).alias("level"), "idx", F.col("h").alias("digest"))
            nodes = here if nodes is None else nodes.unionByName(here)
    return Manifest(proofs, nodes)


def siblings_digest(path: Column) -> Column:
    """The digest of all siblings from a leaf up to the root, left to right on each level."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def folded(path: Column, leaf: Column) -> Column:
    """The root that a leaf leads to by its path."""
    return F.aggregate(path, leaf, lambda node, s: digest(s["before"], node, s["after"]))


def op11_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    """build() of documents by source, and each row's proof tried on its text as tampered with: where crc32 of the id is even, line feeds go.
    Rows with a null id or text are left as they are."""
    docs = table(spark, sf_dir, "documents")
    hit = F.coalesce(F.crc32(docs["doc_id"].cast("string").cast("binary")) % 2 == 0, F.lit(False))
    text = F.when(hit, F.replace(docs["text"], F.lit("\n"), F.lit(""))).otherwise(docs["text"])
    tampered = digest(*[framed(text if f == "text" else docs[f]) for f in FIELDS])
    out = build(docs, keep={"doc_id": docs["doc_id"], "tampered": tampered}).proofs
    out = out.withColumn("folded_root", folded(F.col("path"), F.col("tampered")))
    return out.select("doc_id", "leaf", "subroot", "root", siblings_digest(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
