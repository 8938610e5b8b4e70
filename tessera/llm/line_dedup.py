"""Fuzzy line dedup by MinHash, with DataFrame operations only.

The shingles of a line, in lower case, are its runs of 10 characters from every place (a shorter line is one shingle). Lines are
exploded to shingles and aggregated again at once, before any shuffle, to nine min-hashes each; equal lines collapse in the same
aggregation. The nine min-hashes stand in a square of three by three, and each of the twelve lines of the affine plane over it
(rows, columns, slopes) makes a band of three: lines of similarity 0.75 share one with probability 0.975, of 0.85 with 0.998.

A band's lines stand in the order of their min-hashes; each is compared with the first and the four before it, so a band of any size
costs a linear number of pairs, and one of up to five lines is compared in full. Candidates are verified by the exact Jaccard
similarity of their whole shingle sets, and links are joined by distributed union-find. In bands that then still hold more than
one component, each line outside the band's largest component is compared with all lines of other components, inside the join's
condition: no pair is made that isn't a link. So the components are those of all pairs that share a band. Of each only the first
line, by document and place, stays; every line that is equal to an earlier one is found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import components, cut_table, drop_tables, fresh, table

SIMILARITY, CHARACTERS, BEFORE = 0.75, 10, 4
#: Bytes of keys that may be broadcast to find candidates' texts again; more are found by a shuffled join.
BROADCAST_BYTES = 8 << 20
#: Lines of a mixed band that one task compares with the band's lines outside the main component, about.
BLOCK = 1024
HASHES = 9
#: Shingles that are hashed together, in generated code.
STEP = 8
HASHED = [f"h{i}" for i in range(STEP)]
#: Three min-hashes each, any two of which are together in one: the lines of the affine plane of order three.
BANDS = [tuple(3 * x + (slope * x + c) % 3 for x in range(3)) for slope in range(3) for c in range(3)] + [tuple(3 * x + y for y in range(3)) for x in range(3)]


def seeds(n: int) -> list[int]:
    """Fixed numbers that turn one hash into n: a multiple of the golden ratio's bits each, as signed 64-bit numbers."""
    return [((i + 1) * 0x9E3779B97F4A7C15 + 2**63) % 2**64 - 2**63 for i in range(n)]


def code_points(line: str) -> Column:
    """A line in lower case with two bytes for each character (four for those beyond U+FFFF, which count as two), so that a place is
    found in constant time."""
    return F.encode(F.lower(line), "UTF-16BE")


def shingle(points: Column, start: Column, characters: int = CHARACTERS) -> Column:
    return F.substring(points, start * 2 + 1, F.lit(2 * characters))


def shingles(line: str, hashed_by=F.xxhash64) -> Column:
    """The hashes of a line's shingles, from all places. The array of one binds the code points, which else were made for each place."""
    firsts = lambda p: F.sequence(F.lit(1), F.greatest(F.lit(1), F.octet_length(p) - (2 * CHARACTERS - 1)), F.lit(2))
    each = lambda p: F.transform(firsts(p), lambda i: hashed_by(F.substring(p, i, F.lit(2 * CHARACTERS))))
    return F.get(F.transform(F.array(code_points(line)), each), F.lit(0))


def shingle_set(line: str) -> Column:
    """The distinct 64-bit hashes of a line's shingles."""
    return F.array_distinct(shingles(line))


def hashed(rows: DataFrame, line: str) -> DataFrame:
    """rows, once for every STEP places of a line: place, and instead of the line the columns h0, h1, ..., the hashes of its shingles from
    there on. Where the line has no more, its last shingle is repeated, which changes no set and no least hash.

    That is generated code; functions of arrays are interpreted, and take several times as long."""
    kept = [c for c in rows.columns if c != line]
    rows = rows.select(*kept, code_points(line).alias("points"))
    last = F.greatest(F.lit(0), (F.octet_length("points") / 2 - CHARACTERS).cast("int"))
    rows = rows.select("*", last.alias("last"), F.explode(F.sequence(F.lit(0), last, F.lit(STEP))).alias("place"))
    return rows.select(*kept, "place", *[F.xxhash64(shingle(F.col("points"), F.least(F.col("place") + i, F.col("last")))).alias(h) for i, h in enumerate(HASHED)])


def occurrences(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, pos, line) of all lines that aren't blank, of rows whose id isn't null."""
    rows = docs.select(docs[id_col].alias("id"), F.posexplode(F.split(docs[text_col], "\n", -1)).alias("pos", "line"))
    return rows.where(F.col("id").isNotNull() & (F.ltrim("line", F.lit(" \t\x0b\f\r")) != ""))


def signatures(lines: DataFrame) -> DataFrame:
    """(key, n, s0, s1, ...): each distinct line's 64-bit hash, how often it occurs, and its min-hashes. Should two different lines
    share a key, neither has a row."""
    rows = hashed(lines.select(F.xxhash64("line").alias("key"), F.xxhash64(F.lit(1), "line").alias("check"), "line"), "line")
    # The largest of the numbers is a min-hash too, that of the seed's complement.
    both = [(f, each, c) for c in seeds((HASHES + 1) // 2) for f, each in ((F.min, F.least), (F.max, F.greatest))][:HASHES]
    least = [f(each(*[h.bitwiseXOR(F.lit(c)) for h in map(F.col, HASHED)])).alias(f"s{i}") for i, (f, each, c) in enumerate(both)]
    grouped = rows.groupBy("key").agg(F.count(F.when(F.col("place") == 0, 1)).alias("n"), F.min("check").alias("c0"), F.max("check").alias("c1"), *least)
    return grouped.where("c0 = c1").select("key", "n", *[F.hash(f"s{i}").alias(f"s{i}") for i in range(HASHES)])


def duplicate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(id, removed): for each id with lines that repeat earlier ones, or nearly so, their places, from 0, as an array.

    Blank lines are never removed, nor are lines of rows with a null id or text; the empty table gives no rows. Rows that share an id
    are taken as one document's versions: a line that each holds at the same place is one line, of different lines there all but the
    first of their components go. Ties between equal places don't occur. A line of any length is read whole. Should two different
    lines share a 64-bit key, both stay. Other columns are ignored.
    """
    spark, scratch = docs.sparkSession, []
    lines = occurrences(docs, id_col, text_col)
    distinct = cut_table(signatures(lines), scratch)
    members = banded(distinct, scratch)
    pairs = cut_table(near_pairs(members), scratch)
    text = cut_table(texts_of(lines, cut_table(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct(), scratch)), scratch)
    links = cut_table(linked(pairs, text, similarity, scratch), scratch)
    whole = components(links)
    unsettled = cut_table(mixed_bands(members, whole), scratch)
    if not unsettled.isEmpty():
        more = cut_table(exhausted(unsettled, text, similarity, scratch), scratch)
        if not more.isEmpty():
            whole = components(whole.where("node <> component").select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(more))

    known = distinct.select("key", "n").join(whole, distinct["key"] == whole["node"], "left").where("n > 1 or component is not null")
    known = cut_table(known.select("key", F.coalesce("component", "key").alias("class")), scratch)
    repeated = cut_table(lines.select("id", "pos", F.xxhash64("line").alias("key")).join(known, "key").select("id", "pos", "class"))
    # Written, so that the join's two sides are plain shuffles, of which a hot class's can be split.
    stays = cut_table(repeated.groupBy("class").agg(F.min(F.struct("id", "pos")).alias("stays")))
    drop_tables(spark, scratch)
    gone = repeated.join(stays, "class").where(F.struct("id", "pos") != F.col("stays"))
    return gone.groupBy("id").agg(F.collect_set("pos").alias("removed")).withColumnRenamed("id", id_col)


def banded(distinct: DataFrame, scratch: list[str] | None = None) -> DataFrame:
    """(band, t, key, s0, ...): the rows of all bands of more than one line; t is the band's number among a line's."""
    names = [f"s{i}" for i in range(HASHES)]
    of = [F.xxhash64(F.lit(t), *[f"s{i}" for i in band]) for t, band in enumerate(BANDS)]
    # A window without an order sorts by one number alone, which costs a fraction of sorting by two.
    rows = distinct.select("key", F.explode(F.array(*of)).alias("band"))
    rows = rows.withColumn("size", F.count("key").over(Window.partitionBy("band")))
    rows = cut_table(rows.where("size > 1").select("key", "band"), scratch)
    number = F.coalesce(*[F.when(F.col("band") == h, F.lit(t)) for t, h in enumerate(of)])
    return cut_table(rows.join(distinct.select("key", *names), "key").select("band", number.alias("t"), "key", *names), scratch)


def near_pairs(members: DataFrame) -> DataFrame:
    """(a, b): each line of a band with the band's first and the BEFORE ones before it, in the order of their min-hashes."""
    order = Window.partitionBy("band").orderBy(*[f"s{i}" for i in range(HASHES)], "key")
    others = F.array(F.first("key").over(order), *[F.lag("key", i).over(order) for i in range(1, BEFORE + 1)])
    near = members.select("key", others.alias("others"))
    near = near.select("key", F.explode(F.array_distinct(F.array_compact("others"))).alias("other")).where("key <> other")
    return near.select(F.least("key", "other").alias("a"), F.greatest("key", "other").alias("b")).distinct()


def texts_of(lines: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, line, n): the text of each of these keys, and the size of its shingle set."""
    held = lines.withColumn("key", F.xxhash64("line")).join(F.broadcast(keys) if keys.count() * 32 <= BROADCAST_BYTES else keys, "key")
    return held.groupBy("key").agg(F.min("line").alias("line")).withColumn("n", F.size(shingle_set("line")))


def linked(pairs: DataFrame, text: DataFrame, similarity: float, scratch: list[str]) -> DataFrame:
    """Those of the pairs (a, b), as (u, v), whose shingle sets have at least this Jaccard similarity."""
    ends = [text.select(F.col("key").alias(k), F.col("line").alias(f"line_{k}"), F.col("n").alias(f"n_{k}")) for k in ("a", "b")]
    # Sets of sizes further apart than the similarity can't have it.
    both = pairs.join(ends[0], "a").join(ends[1], "b").where(F.least("n_a", "n_b") >= similarity * F.greatest("n_a", "n_b"))
    shared = F.size(F.array_intersect(shingles("line_a"), shingles("line_b")))
    # Written before the condition, which would compute the sets once for each time it names them.
    both = cut_table(both.select("a", "b", shared.alias("shared"), (F.col("n_a") + F.col("n_b")).alias("sizes")), scratch)
    return both.where(F.col("shared") >= similarity * (F.col("sizes") - F.col("shared"))).select(F.col("a").alias("u"), F.col("b").alias("v"))


def mixed_bands(members: DataFrame, whole: DataFrame) -> DataFrame:
    """members with class, main and blocks, of bands that hold lines of several components and haven't been compared in full: class is a
    line's component so far, main that of most of the band's lines."""
    classed = members.join(whole.withColumnRenamed("node", "key"), "key", "left").withColumn("class", F.coalesce("component", "key")).drop("component")
    counts = classed.groupBy("band", "class").agg(F.count("*").alias("held"))
    mixed = counts.groupBy("band").agg(F.max(F.struct("held", "class"))["class"].alias("main"), F.sum("held").alias("size"), F.count("*").alias("classes"))
    mixed = mixed.where((F.col("classes") > 1) & (F.col("size") > BEFORE + 1)).select("band", "main", F.ceil(F.col("size") / BLOCK).alias("blocks"))
    return classed.join(mixed, "band")


def exhausted(unsettled: DataFrame, text: DataFrame, similarity: float, scratch: list[str]) -> DataFrame:
    """(u, v): the links between lines of unsettled bands that are in different components.

    Of each pair one line at least is outside its band's main component; the pair is tried in the first band that it shares. It is
    tried on 32-bit hashes inside the join, and what passes is verified on the whole sets.
    """
    held = text.join(unsettled.select("key").distinct(), "key", "left_semi")
    small = held.select("key", "n", F.array_distinct(shingles("line", F.hash)).alias("h"))
    rows = unsettled.join(small, "key")
    x = rows.where("class <> main").select(*[F.col(c).alias(f"x_{c}") for c in rows.columns], F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("x_block"))
    rows = rows.withColumn("block", F.pmod("key", "blocks"))
    # Dealt out by number: rows are wide here, and splitting what little is uneven after that makes thousands of tasks.
    parts = int(text.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    x, rows = x.repartition(parts, "x_band", "x_block"), rows.repartition(parts, "band", "block")
    first = F.coalesce(*[F.when(F.expr(" and ".join(f"s{i} = x_s{i}" for i in band)), F.lit(t)) for t, band in enumerate(BANDS)])
    apart = (F.col("class") != F.col("x_class")) & ((F.col("class") == F.col("main")) | (F.col("x_key") < F.col("key"))) & (first == F.col("t"))
    sizes = F.least("n", "x_n") >= similarity * F.greatest("n", "x_n")
    shared = F.size(F.array_intersect("h", "x_h"))
    close = F.when(apart & sizes, shared * (1 + similarity) >= similarity * (F.col("n") + F.col("x_n")) - 2).otherwise(False)
    tried = x.join(rows, (F.col("band") == F.col("x_band")) & (F.col("block") == F.col("x_block")) & close)
    tried = cut_table(tried.select(F.least("key", "x_key").alias("a"), F.greatest("key", "x_key").alias("b")).distinct(), scratch)
    return linked(tried, text, similarity, scratch)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", drop_emptied: bool = False) -> DataFrame:
    """docs with the lines that duplicate_lines() names taken out of the text; columns and the other rows' texts as they are.

    drop_emptied: rows go that have lost all their lines but blank ones.
    Empty tables, null texts and rows with a null id pass through; extra columns may have any names.
    """
    id_, gone, cut_ = fresh(docs, "id", "removed", "cut")
    removed = duplicate_lines(docs, id_col, text_col).select(F.col(id_col).alias(id_), F.col("removed").alias(gone))
    joined = docs.join(removed, docs[id_col] == F.col(id_), "left")
    left = lambda lines: F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
    kept = lambda lines: F.array_join(F.transform(left(lines), lambda i: F.get(lines, i)), "\n")
    # The array of one binds the lines, which else were split off again for each place.
    text = F.when(F.col(gone).isNotNull(), F.get(F.transform(F.array(F.split(docs[text_col], "\n", -1)), kept), F.lit(0))).otherwise(docs[text_col])
    # An array of one, exploded: what follows reads the text, and would make it again wherever it is moved before a plain column.
    out = joined.select(*[docs[c] for c in docs.columns if c != text_col], F.col(gone).isNotNull().alias(cut_), F.explode(F.array(text)).alias(text_col))
    if drop_emptied:
        out = out.where(~F.col(cut_) | F.col(text_col).rlike(r"\S"))
    return out.select(*docs.columns)


def n_lines(text: str) -> Column:
    """One more than a text's line feeds; null: 0."""
    return F.coalesce(F.octet_length(text) - F.octet_length(F.replace(F.col(text), F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long")


def op5_line_dedup(spark, sf_dir: str) -> DataFrame:
    """One row for each row of documents: doc_id, n_lines, n_kept, kept_sha256 of the text without its duplicate lines. Null texts have
    no lines and the digest of the empty text; all else is as dedup_lines() says."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", n_lines("text").alias("n_lines"))
    out = dedup_lines(docs)
    return out.select("doc_id", "n_lines", n_lines("text").alias("n_kept"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
