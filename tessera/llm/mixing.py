"""Mixing sources to target weights by systematic sampling, with DataFrame operations only.

Documents of a source stand in a line ordered by size; each covers its expected number of copies. With one random offset a
source, a document is emitted once for every whole number that falls into its stretch. Since neighbours in the line are of like
size, the words taken come near the target whatever the offset. The line of a hot source is cut into blocks (a size class and a
hash part each): block totals are summed first, then the documents within each block, so that no task holds a whole source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut, table

WEIGHTS = (3, 1, 2)
TOTAL = 1.5
MOST = 2.0
SEED = 20
#: Documents that a block of a source's line holds at most, about.
BLOCK = 100_000


def n_words(text: Column) -> Column:
    """Runs other than space, tab, line feed, vertical tab, form feed and carriage return; null: 0."""
    trimmed = F.regexp_replace(text, r"^[ \t\n\x0B\f\r]+", "")
    return F.coalesce(F.when(trimmed == "", F.lit(0)).otherwise(F.regexp_count(text, F.lit(r"[^ \t\n\x0B\f\r]++"))), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, total: float = TOTAL, most: float = MOST) -> DataFrame:
    """(source, name, absent, source_size, target) from one row a source: shares of ``total`` times all sizes in proportion to the weights,
    which repeat over the sources by code point, null last; none above ``most`` times its source's size, the excess shared out again.

    Sources reach their cap in the order of cap / weight; with the first m capped, the others get (total - caps of these m) *
    weight / weights of the others. A source is capped iff that share, with all before it capped, is not below its cap.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.select("source", "name", "absent", "source_size", w.alias("w")).withColumn("cap", F.col("source_size") * F.lit(most))
    up = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before, whole = up.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(1))
    s = s.withColumn("left", F.sum("source_size").over(whole) * F.lit(total) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    s = s.withColumn("others", F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    s = s.withColumn("capped", F.col("left") * F.col("w") / F.col("others") >= F.col("cap"))
    caps, open_w = F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0.0)).over(whole), F.sum(F.when(F.col("capped"), 0.0).otherwise(F.col("w"))).over(whole)
    share = F.when(F.col("capped"), F.col("cap")).otherwise((F.sum("source_size").over(whole) * F.lit(total) - caps) * F.col("w") / open_w)
    return s.select("source", "name", "absent", "source_size", F.least(F.greatest(share, F.lit(0.0)), F.col("cap")).alias("target"))


def hex_number(*columns, digits: int = 15) -> Column:
    """A whole number from the first hex digits of the columns' md5, null counting as no text."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *columns)), 1, digits), 16, 10).cast("long")


def row_hash(docs: DataFrame) -> Column:
    """A 64-bit hash of all columns; maps, which have none, by their entries."""
    held = [F.to_json(F.struct(docs[f.name])) if "map<" in f.dataType.simpleString() else docs[f.name] for f in docs.schema.fields]
    return F.xxhash64(*held)


def placed(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple, total: float, most: float, seed: int, carry: bool) -> DataFrame:
    """(row, id, source, size, source_size, target, copies): each row of docs, as a struct if it is to be carried along."""
    name, absent = F.coalesce(docs[source_col].cast("string"), F.lit("")), docs[source_col].isNull()
    whole = F.struct(*[docs[c] for c in docs.columns]) if carry else F.lit(None).cast("int")
    rows = docs.select(whole.alias("row"), docs[id_col].alias("id"), docs[source_col].alias("source"), name.alias("name"), absent.alias("absent"), n_words(docs[text_col]).alias("size"), row_hash(docs).alias("mark"))
    # Rows of one id and size stand by all that they hold, so that a rerun, or a task run again, puts them in the same places.
    rows = rows.withColumn("key", hex_number(F.coalesce(F.col("id").cast("string"), F.concat(F.lit("null "), F.col("mark").cast("string"))))).withColumn("class", F.floor(F.log2(F.col("size") + 1.0) * 8).cast("int"))
    light = cut(rows.drop("row"))
    rows = rows if carry else light.withColumn("row", F.lit(None).cast("int"))
    counted = light.groupBy("source", "name", "absent", "class").agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    per_source = targets(counted.groupBy("source", "name", "absent").agg(F.sum("words").alias("source_size")), weights, total, most)
    per_source = per_source.withColumn("each", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    offset = hex_number(F.lit(str(seed)), F.col("absent").cast("string"), "name", digits=5) / F.lit(float(1 << 20))
    per_source = per_source.withColumn("offset", offset).drop("source")
    # One number for all classes, so that rows need no join to learn it, and the window below deals them out by part too.
    parts = max(1, -(-(counted.agg(F.max("n")).first()[0] or 0) // BLOCK))
    part = F.pmod(F.shiftright("key", 20), F.lit(parts)).alias("part")
    line = Window.partitionBy("name", "absent").orderBy("class", "part")
    blocks = light.select("name", "absent", "class", part).groupBy("name", "absent", "class", "part").agg(F.count("*").alias("n"))
    blocks = blocks.withColumn("first", F.sum("n").over(line) - F.col("n"))
    info = blocks.join(per_source, ["name", "absent"]).select("name", "absent", "class", "part", "first", "source_size", "target", "each", "offset")
    within = Window.partitionBy("name", "absent", "class", "part").orderBy("size", "key", "id", "mark")
    dealt = rows.select(*rows.columns, part).withColumn("place", F.row_number().over(within))
    full = dealt.join(info, ["name", "absent", "class", "part"])
    after = F.floor((F.col("first") + F.col("place")) * F.col("each") + F.col("offset"))
    until = F.floor((F.col("first") + F.col("place") - 1) * F.col("each") + F.col("offset"))
    return full.select("row", "id", "source", "size", "source_size", "target", (after - until).cast("long").alias("copies"))


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = WEIGHTS, total: float = TOTAL, most: float = MOST, seed: int = SEED) -> DataFrame:
    """(id, source, size, source_size, target, copies): how often the mix emits each row.

    Null texts have size 0; null sources form a source of their own; sources without words take none; texts of any length count whole.
    Rows that repeat are separate rows, each with its own place, and so are rows with a null id. Ties in size go by a hash of the id,
    then the id, then a hash of the whole row, which also stands for a null id; rows alike in all columns change places unseen. The empty
    table gives no rows. Reruns agree: the offsets come from a hash of source and seed. Other columns, whatever their names, only tell
    rows of one id apart.
    """
    out = placed(docs, id_col, text_col, source_col, weights, total, most, seed, carry=False)
    return out.drop("row").withColumnRenamed("id", id_col)


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = WEIGHTS, total: float = TOTAL, most: float = MOST, seed: int = SEED) -> DataFrame:
    """The documents of the mix with the columns of docs, whatever their names, each row as often as copies() says; rows with 0 copies
    go. Rows are carried along, not found again by their ids: ids may repeat or be null."""
    rows = placed(docs, id_col, text_col, source_col, weights, total, most, seed, carry=True).where("copies > 0")
    rows = rows.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
    return rows.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    """copies() of documents: one row for each row, with the words that the mix takes from it."""
    c = copies(table(spark, sf_dir, "documents"))
    return c.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
