"""A stored inverted index: postings in blocks with bounds, read block by block in the order of what they can still give.

Files are dealt to shards by a hash of their ids, and texts are shuffled once, by shard: words are counted and blocks made, met and added up
where a shard is. A block holds the files of one shard that hold one word, best first, with the largest
frequency and the shortest file among them: with the word's weight these bound what any file of the block gains by the word, whatever the
mean length has become since. The bounds of a query's words, added up over a shard, bound every file of it. So top() scores each query's
most promising shards, and of the others only those whose bound reaches the k-th score found: no file that belongs to the k is missed.

Changed files make a new segment, written beside the old ones and named in the log last; entries of files that a later segment has, or has
without words, no longer count. Counts by word are kept up by adding the difference, not by reading texts again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import retrieval as R
from tessera.operators.lineage import cut

PER_SHARD, BUCKETS = 2048, 32


class Index:
    """An index in a folder. n_shards is fixed when it is made; buckets is noted alone, as blocks lie by shard."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        log = spark.read.parquet(f"{folder}/log/segment=*").collect()  # a row for each update
        self.segments = sorted(r["segment"] for r in log)
        self.n_shards, self.buckets = log[0]["n_shards"], log[0]["buckets"]

    @staticmethod
    def create(files: DataFrame, folder: str, per_shard: int = PER_SHARD, buckets: int = BUCKETS) -> Index:
        """Index files (id, filename, content) into an empty folder. Null texts hold no words; ids are unique and not null."""
        n_shards = max(1, -(-files.count() // per_shard))
        _write(files, None, folder, 0, n_shards, buckets)
        return Index(files.sparkSession, folder)

    def table(self, name: str) -> DataFrame:
        paths = [f"{self.folder}/{name}/segment={s}" for s in self.segments]
        return self.spark.read.option("basePath", f"{self.folder}/{name}").parquet(*paths)

    def files(self) -> DataFrame:
        """(id, segment, dl, span) of the files as they are now: their words, and their trigrams, counted."""
        newest = self.table("files").groupBy("id").agg(F.max_by(F.struct("segment", "dl", "span", "live"), "segment").alias("f"))
        return newest.where("f.live").select("id", "f.segment", "f.dl", "f.span")

    def words(self) -> DataFrame:
        """(word, times, held): how often each word occurs, and in how many files."""
        return self.table("words").groupBy("word").agg(F.sum("times").alias("times"), F.sum("held").alias("held")).where("held > 0")

    def stats(self) -> DataFrame:
        """(n, avgdl, avgspan), one row."""
        return self.files().agg(F.count("*").alias("n"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl"), F.coalesce(F.avg("span"), F.lit(0.0)).alias("avgspan"))

    def entries(self, blocks: DataFrame) -> DataFrame:
        """The entries (id, tf, dl, span) of blocks, beside their other columns, of files as they are now."""
        rows = blocks.select(*[c for c in blocks.columns if c not in ("entries", "most_tf", "least_dl", "n", "total")], F.inline("entries"))
        if len(self.segments) > 1:
            live = R.counted(self.files().select(F.col("id").alias("live_id"), F.col("segment").alias("live_segment")))
            rows = rows.join(live, (F.col("id") == F.col("live_id")) & (F.col("segment") == F.col("live_segment")), "left_semi")
        return rows

    def met(self, names: DataFrame, *on: str, seen: DataFrame | None = None) -> DataFrame:
        """The entries of the blocks that names asks for, dealt out by shard: as lists, which are short."""
        blocks = self.table("blocks").select("word", "shard", "segment", "entries")
        blocks = blocks.join(names, list(on)) if seen is None else R.meet(blocks, names, seen)
        return self.entries(blocks.repartition(parts(self.spark, self.n_shards), "shard"))

    def of_words(self, names: DataFrame, seen: DataFrame | None = None) -> DataFrame:
        """(word, shard, id, tf, dl, span, and what names has) of the words that names (word, ...) asks for. seen: as for retrieval.meet(), if
        names may be many."""
        return self.met(names, "word", seen=seen)

    def touched(self, changed: DataFrame) -> DataFrame:
        """The blocks of the shards that files (id) are dealt to; shards are few, so no block is shuffled for it."""
        shards = changed.select(shard(F.col("id"), self.n_shards).alias("shard")).distinct()
        return self.table("blocks").join(F.broadcast(shards), "shard", "left_semi")

    def update(self, files: DataFrame, gone: DataFrame | None = None) -> Index:
        """The index after these files (id, filename, content) have come or changed and those of gone (id) have gone."""
        changed = files.select("id") if gone is None else files.select("id").unionByName(gone.select("id"))
        old = self.entries(self.touched(changed).select("word", "segment", "entries")).join(R.counted(changed.distinct()), "id", "left_semi")
        dropped = old.groupBy("word").agg((-F.sum("tf")).alias("times"), (-F.count("*")).alias("held"))
        _write(files, (dropped, gone), self.folder, self.segments[-1] + 1, self.n_shards, self.buckets)
        return Index(self.spark, self.folder)

    def compacted(self, folder: str, per_shard: int = PER_SHARD) -> Index:
        """The same index as one segment of another folder, without what no longer counts; no text is read."""
        files = self.files()
        n_shards = max(1, -(-files.count() // per_shard))
        blocks = self.table("blocks").select("word", "segment", "entries")
        rows = self.entries(blocks).drop("segment").withColumn("shard", shard(F.col("id"), n_shards)).repartition(parts(self.spark, n_shards), "shard")
        _store(rows, files.select("id", "dl", "span"), None, folder, 0, n_shards, self.buckets)
        return Index(self.spark, folder)


def shard(id: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(id), F.lit(n))


def parts(spark: SparkSession, n_shards: int) -> int:
    """Parts that shards are dealt to: twice as many as they, so that few meet in one."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * n_shards)


def _write(files: DataFrame, changes: tuple | None, folder: str, segment: int, n_shards: int, buckets: int) -> None:
    dl = F.size("t")
    span = F.greatest(F.length("filename") - 2, F.lit(0)) + F.greatest(F.length("content") - 2, F.lit(0))
    body = F.concat(T.tokens(F.col("filename")), T.tokens(F.col("content")))
    texts = files.select("id", "filename", "content", shard(F.col("id"), n_shards).alias("shard")).repartition(parts(files.sparkSession, n_shards), "shard")
    each = lambda texts, *more: texts.select("id", *more, body.alias("t"), F.coalesce(span, F.lit(0)).alias("span")).select("id", *more, "t", dl.alias("dl"), "span")
    rows = each(texts, "shard").select("shard", "id", "dl", "span", F.explode("t").alias("word")).groupBy("shard", "word", "id", "dl", "span").agg(F.count("*").cast("int").alias("tf"))
    _store(rows, each(files).select("id", "dl", "span"), changes, folder, segment, n_shards, buckets)


def _store(rows: DataFrame, files: DataFrame, changes: tuple | None, folder: str, segment: int, n_shards: int, buckets: int) -> None:
    """A segment of rows (shard, word, id, tf, dl, span), dealt out by shard, of files (id, dl, span); changes: the counts to add and the
    files (id) that have gone."""
    spark, to = rows.sparkSession, lambda name: f"{folder}/{name}/segment={segment}"
    # At most a shard's files in one list: a word that all files hold has as many blocks as there are shards.
    entry = F.struct((-F.col("tf")).alias("less"), "dl", "id", "span")
    blocks = rows.groupBy("shard", "word").agg(F.count("*").alias("n"), F.sum("tf").alias("total"), F.max("tf").alias("most_tf"), F.min("dl").alias("least_dl"), F.sort_array(F.collect_list(entry)).alias("e"))
    listed = F.transform("e", lambda e: F.struct(e["id"].alias("id"), (-e["less"]).alias("tf"), e["dl"].alias("dl"), e["span"].alias("span")))
    blocks = blocks.select("word", "shard", "n", "total", "most_tf", "least_dl", listed.alias("entries"))
    blocks.sortWithinPartitions("word", "shard").write.mode("overwrite").parquet(to("blocks"))
    words = spark.read.parquet(to("blocks")).groupBy("word").agg(F.sum("total").alias("times"), F.sum("n").alias("held"))
    live = files.withColumn("live", F.lit(True))
    if changes is not None:
        dropped, gone = changes
        words = words.unionByName(dropped.select("word", "times", "held")).groupBy("word").agg(F.sum("times").alias("times"), F.sum("held").alias("held"))
        if gone is not None:
            dead = gone.select("id").distinct().join(files.select("id"), "id", "left_anti")
            live = live.unionByName(dead.select("id", F.lit(0).alias("dl"), F.lit(0).alias("span"), F.lit(False).alias("live")))
    words.write.mode("overwrite").parquet(to("words"))
    live.write.mode("overwrite").parquet(to("files"))
    # Last: a segment that isn't in the log isn't read.
    spark.createDataFrame([(segment, n_shards, buckets)], "segment int, n_shards long, buckets int").coalesce(1).write.mode("overwrite").parquet(to("log"))


def top(index: Index, queries: DataFrame, k: int = 10, first: int = 2, report: list | None = None) -> DataFrame:
    """(qid, id, score, rank): BM25 over whole words, the same rows as retrieval.bm25(prefix=False) gives.

    Each query's ``first`` shards by bound are scored, then those whose bound reaches the k-th score. report: a list to which the numbers
    of (query, shard) that there were, and that were scored, are added."""
    terms = R.query_terms(queries)
    weights = terms.join(index.words().select(F.col("word").alias("term"), "held"), "term").crossJoin(F.broadcast(index.stats()))
    weights = R.counted(weights.select("qid", F.col("term").alias("word"), "avgdl", (F.col("times") * R.idf(F.col("n"), F.col("held"))).alias("w")))
    met = index.table("blocks").select("word", "shard", "most_tf", "least_dl").join(weights, "word")
    part = F.col("w") * R.term_score(F.col("most_tf"), F.col("least_dl"), F.col("avgdl"))
    # Of several segments' blocks of one word and shard the best bounds all; room for the rounding of sums.
    bounds = met.groupBy("qid", "shard", "word").agg(F.max(part).alias("part")).groupBy("qid", "shard").agg((F.sum("part") * (1 + 1e-9) + 1e-6).alias("bound"))
    order = R.Window.partitionBy("qid").orderBy(F.col("bound").desc(), "shard")
    bounds = cut(bounds.withColumn("place", F.row_number().over(order)))

    def scored(chosen: DataFrame) -> DataFrame:
        wanted = R.counted(chosen.select("qid", "shard").join(weights, "qid"))
        rows = index.met(R.counted(wanted.select("word", "shard").distinct()), "word", "shard").join(wanted, ["word", "shard"])
        gain = F.col("w") * R.term_score(F.col("tf"), F.col("dl"), F.col("avgdl"))
        return R.top(rows.groupBy("shard", "qid", "id").agg(F.round(F.sum(gain), 9).alias("score")), k).drop("rank", "shard")

    best = cut(scored(bounds.where(F.col("place") <= first)))
    least = best.groupBy("qid").agg(F.count("*").alias("found"), F.min("score").alias("least"))
    others = bounds.where(F.col("place") > first).join(least, "qid", "left").where(F.coalesce(F.col("found") < k, F.lit(True)) | (F.col("bound") >= F.col("least")))
    if report is not None:
        report += [bounds.count(), others.count() + bounds.where(F.col("place") <= first).count()]
    return R.top(best.unionByName(scored(others)), k)


