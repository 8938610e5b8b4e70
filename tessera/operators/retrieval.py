"""Batched retrieval: queries are rows, every stage is keyed by qid, and ties go to the smaller id."""

from __future__ import annotations

import uuid

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.stem import stems
from tessera.operators import fuzzy
from tessera.operators.lineage import cut

K1, B, RRF, CANDIDATES = 1.2, 0.75, 60.0, 80
#: Rows of a query side up to which it is broadcast; larger ones are joined by a shuffle.
SMALL = 200_000
#: Rows of a few short columns, as of words or ids, up to which they are broadcast; texts of one part where texts are dealt out by id.
KEYS, PER_PART = 2_000_000, 4096


def hint(df: DataFrame, rows: int | None) -> DataFrame:
    """A broadcast hint, if the caller has counted the rows and they are few."""
    return F.broadcast(df) if rows is not None and rows <= SMALL else df


def counted(rows: DataFrame, most: int = KEYS) -> DataFrame:
    """rows, written, with a broadcast hint if they are few: what meets them then isn't shuffled."""
    rows = cut(rows)
    return F.broadcast(rows) if rows.count() <= most else rows


def kept(rows: DataFrame) -> DataFrame:
    """rows, computed once and held on the executors' disks, dealt out as they are: for what is asked for twice and costs much to compute. Each call
    holds its own, known by a name in the plan: files may have changed since the last one."""
    return rows.where(F.lit(uuid.uuid4().hex) != "").persist(StorageLevel.DISK_ONLY)


def dealt(files: DataFrame, *columns: str) -> DataFrame:
    """Columns (id, filename, content) dealt out by id, so many to a part: what is counted or added up by id from here on stays in its part, and
    a part's memory doesn't grow with the files. Words are best taken of them by explode_outer(): of explode() Spark makes a filter that it moves
    before the shuffle, where each text is cut once more."""
    return files.select(*(columns or ("id", "filename", "content"))).repartition(n_parts(files), "id")


def n_parts(files: DataFrame) -> int:
    return max(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-files.count() // PER_PART))


def meet(rows: DataFrame, names: DataFrame, seen: DataFrame, plain: DataFrame | None = None, dealt_out=lambda x: x, written: bool = False) -> DataFrame:
    """rows (word, ...) with what names (word, seen, ...) has of their words; seen (word, seen): how often each distinct word of the rows occurs.

    Few names are broadcast. Of more, those of the words that occur most are, with these words; the other words, many but seldom, are all that
    is shuffled, by word: of plain, which has the same rows as they lie, if given. dealt_out() deals out what these meet, as rows are.
    written: names are already."""
    names = names if written else cut(names)
    if names.count() <= KEYS:
        return rows.join(F.broadcast(names.drop("seen")), "word")
    level = F.floor(F.log2("seen")).alias("level")
    held = {r["level"]: r["count"] for r in seen.select(level).unionAll(names.select(level)).groupBy("level").count().collect()}  # a row for each power of 2
    often, total = max(held) + 1, 0
    for i in sorted(held, reverse=True):
        total += held[i]
        if total > KEYS:
            break
        often = i
    most = F.floor(F.log2("seen")) >= often
    known = rows.join(F.broadcast(names.where(most).drop("seen")), "word")
    rest = (rows if plain is None else plain).join(F.broadcast(seen.where(most).select("word")), "word", "left_anti").where("word is not null")
    return known.unionByName(dealt_out(rest.join(names.where(~most).drop("seen"), "word")))


def idf(n_docs: Column, df: Column) -> Column:
    x = F.log((n_docs - df + 0.5) / (df + 0.5))
    return F.when(x <= 0, 1e-6).otherwise(x)


def term_score(tf: Column, dl: Column, avgdl: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def top(scored: DataFrame, k: int, key: str = "qid", score: str = "score", tie: str = "id") -> DataFrame:
    """The k best rows a key, with their rank; Spark turns this into a limit before and after its shuffle."""
    w = Window.partitionBy(key).orderBy(F.col(score).desc(), F.col(tie))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def query_terms(queries: DataFrame, least: int = 1, stemmed: bool = False) -> DataFrame:
    """(qid, term, times): a token repeated in a query counts once for each repetition."""
    words = T.tokens(F.col("query"))
    t = queries.select("qid", (stems(words) if stemmed else words).alias("t")).select("qid", F.explode("t").alias("term"))
    return t.where(F.length("term") >= least).groupBy("qid", "term").agg(F.count("*").alias("times"))


def numbered_terms(terms: DataFrame, n_queries: int | None) -> tuple[DataFrame, DataFrame]:
    """(term, no) of the distinct terms, and (qid, term, times) with numbers for terms: postings then are short rows of numbers, which are joined
    and added up sooner, and in less memory, than words."""
    wanted = cut(terms.select("term").distinct()).withColumn("no", F.monotonically_increasing_id())
    return wanted, terms.join(hint(wanted, n_queries), "term").select("qid", F.col("no").alias("term"), "times")


def vocabulary(files: DataFrame, words: Column) -> DataFrame:
    """(word, times): the distinct words of all files and how often they occur; combined before the shuffle, so as small as they are few.
    Dealt out by number: few bytes, but much is done with each word, which one merged partition would do alone."""
    counts = files.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("times"))
    return counts.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "word")


def scored(postings: DataFrame, terms: DataFrame, stats: DataFrame, n_queries: int | None, by: tuple = ()) -> DataFrame:
    """(qid, id, score, held) of postings (term, id, dl, tf): held is how many of the query's terms a text has. stats: n, avgdl. Postings dealt
    out by id, or by a column of it (by), are added up where they are, if the queries are few."""
    found = postings.groupBy("term").agg(F.count("*").alias("df"))
    weights = terms.join(hint(found, n_queries), "term").crossJoin(F.broadcast(stats)).select("qid", "term", "avgdl", (F.col("times") * idf(F.col("n"), F.col("df"))).alias("w"))
    part = F.col("w") * term_score(F.col("tf"), F.col("dl"), F.col("avgdl"))
    return postings.join(hint(weights, n_queries), "term").groupBy(*by, "qid", "id").agg(F.round(F.sum(part), 9).alias("score"), F.count("*").alias("held")).drop(*by)


def bm25(files: DataFrame, queries: DataFrame, k: int = CANDIDATES, prefix: bool = True, n_queries: int | None = None, stemmed: bool = False, every: bool = False, index=None) -> DataFrame:
    """(qid, id, score, rank): BM25 over filename and content; with prefix, a query token stands for all words that start with it,
    as one term whose frequency and document count are those of all of them together. stemmed: texts and queries by Porter stems,
    a query's before its prefixes are looked up. every: only texts that hold all of a query's terms. index: a postings.Index of the files,
    which then aren't read.

    Terms are looked up among the distinct words, which alone are stemmed or cut to prefixes; texts meet them by whole words.
    """
    body = F.concat(T.tokens(F.col("filename")), T.tokens(F.col("content")))
    wanted, terms = numbered_terms(query_terms(queries, stemmed=stemmed), n_queries)
    whole = not prefix and not stemmed
    if index is not None:
        words, stats = index.words(), index.stats().select("n", "avgdl")
    elif whole:
        held = files.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size(body)), F.lit(0)).alias("held"))
        stats = held.select("n", (F.col("held") / F.col("n")).alias("avgdl"))
    else:
        words = kept(vocabulary(files, body))
        stats = files.agg(F.count("*").alias("n")).crossJoin(words.agg(F.coalesce(F.sum("times"), F.lit(0)).alias("held"))).select("n", (F.col("held") / F.col("n")).alias("avgdl"))
    if whole:
        names = wanted.select(F.col("term").alias("word"), F.col("no").alias("term"))
    else:
        seen = words.select("word", F.col("times").alias("seen"))
        names = seen.select("word", "seen", (F.get(stems(F.array("word")), F.lit(0)) if stemmed else F.col("word")).alias("s"))
        if prefix:
            lengths = wanted.agg(F.array_sort(F.collect_set(F.length("term"))).alias("lengths"))  # at most as many as words are long
            starts = F.transform(F.filter("lengths", lambda n: n <= F.length("s")), lambda n: F.substring("s", F.lit(1), n))
            names = names.crossJoin(F.broadcast(lengths)).select("word", "seen", F.explode(starts).alias("s"))
        names = names.join(hint(wanted, n_queries), F.col("s") == F.col("term")).select("word", "seen", F.col("no").alias("term"))
    if index is not None:
        rows = index.of_words(counted(names)) if whole else index.of_words(names, seen)
        postings, by = rows.groupBy("shard", "term", "id", "dl").agg(F.sum("tf").alias("tf")), ("shard",)
    else:
        each = lambda texts: texts.select("id", body.alias("t")).select("id", F.size("t").alias("dl"), F.explode_outer("t").alias("word"))
        rows = each(dealt(files))
        rows = rows.join(counted(names), "word") if whole else meet(rows, names, seen, each(files), lambda x: x.repartition(n_parts(files), "id"))
        postings, by = kept(rows.groupBy("term", "id", "dl").agg(F.count("*").alias("tf"))), ()
    out = scored(postings, terms, stats, n_queries, by)
    if every:
        out = out.join(hint(terms.groupBy("qid").agg(F.count("*").alias("held")), n_queries), ["qid", "held"])
    return top(out.drop("held"), k)


def trigram(files: DataFrame, queries: DataFrame, k: int = CANDIDATES, n_queries: int | None = None, index=None) -> DataFrame:
    """(qid, id, score, rank): BM25 over trigrams: a token of three characters or more is a phrase of trigrams, so a substring; its
    frequency counts overlapping places; a text's length is its number of trigrams.

    A token holds only word characters, so its places lie within words: it is looked up, by its first trigram, among the distinct
    words, and texts meet it by whole words. index: as for bm25().
    """
    numbers, terms = numbered_terms(query_terms(queries, least=3), n_queries)
    whole = lambda x: F.coalesce(F.regexp_extract_all(F.lower(x), F.lit(r"(?U)\w+"), F.lit(0)), F.array().cast("array<string>"))
    body = F.filter(F.concat(whole(F.col("filename")), whole(F.col("content"))), lambda w: F.length(w) >= 3)
    dl = F.greatest(F.length("filename") - 2, F.lit(0)) + F.greatest(F.length("content") - 2, F.lit(0))
    if index is not None:
        stats, words = index.stats().select("n", F.col("avgspan").alias("avgdl")), index.words().where(F.length("word") >= 3)
    else:
        stats = files.select(dl.alias("dl")).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
        words = kept(vocabulary(files, body))
    seen = words.select("word", F.col("times").alias("seen"))
    keyed = seen.select("word", "seen", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("word") - 2), lambda i: F.substring("word", i, F.lit(3))))).alias("key"))
    wanted = numbers.select("term", "no", F.left("term", F.lit(3)).alias("key"))
    places = F.size(F.filter(F.sequence(F.lit(1), F.length("word") - F.length("term") + 1), lambda i: F.substring("word", i, F.length("term")) == F.col("term")))
    names = keyed.join(hint(wanted, n_queries), "key").where(F.contains("word", F.col("term"))).select("word", "seen", "no", places.alias("times")).withColumnRenamed("no", "term")
    if index is not None:
        postings = index.of_words(names, seen).groupBy("shard", "term", "id", F.col("span").alias("dl")).agg(F.sum(F.col("tf") * F.col("times")).alias("tf"))
    else:
        each = lambda texts: texts.select("id", dl.alias("dl"), body.alias("t")).select("id", "dl", F.explode_outer("t").alias("word"))
        rows = meet(each(dealt(files)), names, seen, each(files), lambda x: x.repartition(n_parts(files), "id"))
        postings = kept(rows.groupBy("term", "id", "dl").agg(F.sum("times").alias("tf")))
    return top(scored(postings, terms, stats, n_queries, ("shard",) if index is not None else ()).drop("held"), k)


def holding(words: DataFrame, terms: DataFrame, *more: str) -> DataFrame:
    """(word, term) of all words (word) that hold a term (term) as a substring, met by the term's first three characters, or fewer if it has
    no more: no pair is tried that doesn't share these. Empty terms are held by none. more: columns of words to be kept."""
    key = lambda n: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("word") - n + 1), lambda i: F.substring("word", i, F.lit(n))))
    keys = F.flatten(F.array(*[F.when(F.length("word") >= n, key(n)).otherwise(F.array().cast("array<string>")) for n in (1, 2, 3)]))
    wanted = terms.select("term").distinct().where("term <> ''").withColumn("key", F.left("term", F.lit(3)))
    return words.select("word", *more).distinct().select("word", *more, F.explode(keys).alias("key")).join(wanted, "key").where(F.contains("word", F.col("term"))).select("word", *more, "term")


def places(files: DataFrame, words: Column, terms: DataFrame) -> DataFrame:
    """(id, term, times): how often each term (term) occurs, without overlap, in the words of each of the files that hold it. A term that crosses no
    word's end is so counted in the whole text: among the distinct words, which texts then meet by whole words."""
    each = files.select("id", F.explode(words).alias("word"))
    names = counted(holding(each.select("word").distinct(), terms).select("word", "term", T.occurrences(F.col("word"), F.col("term")).alias("n")))
    return each.join(names, "word").groupBy("id", "term").agg(F.sum("n").alias("times"))


def fuse(lanes: list[tuple[DataFrame, Column | float]], k: int | None = None) -> DataFrame:
    """Weighted reciprocal-rank fusion of (qid, id, rank): the sum of weight / (60 + rank)."""
    parts = None
    for lane, weight in lanes:
        part = lane.select("qid", "id", ((weight if isinstance(weight, Column) else F.lit(weight)) / (F.lit(RRF) + F.col("rank"))).alias("s"))
        parts = part if parts is None else parts.unionByName(part)
    scored = parts.groupBy("qid", "id").agg(F.round(F.sum("s"), 12).alias("score")).where("score > 0")
    return top(scored, k) if k else scored


def trimmed(text: Column, budget: int) -> Column:
    """As many words of a text as fit a token budget, and three dots."""
    words = F.regexp_extract_all(text, F.lit(r"(?U)\S+"), F.lit(0))
    return F.concat(F.array_join(F.slice(words, F.lit(1), F.lit(max(1, round(budget / 1.35)))), " "), F.lit(" ..."))


def best_chunks(hits: DataFrame, files: DataFrame, queries: DataFrame, max_chunks: int = 1, budget: int | None = None, ratio: float = 0.82) -> DataFrame:
    """Adds to (qid, id, ...) the best chunks of each text: the best, and more while they score at least ratio of it, in a token budget. A
    best one beyond the budget is trimmed to it and stands alone; the first of the others that doesn't fit ends the list.

    (…, chunk_index, chunk_id, matched_chunks, chunk_text, tokens, chunk_total, chunk_indices). Chunks are scored where they are cut: no
    shuffle has them all. Texts without a chunk go.
    """
    size, overlap = T.chunk_config(F.length("content"))
    hits = counted(hits)  # few beside the texts, of which none is moved then
    docs = files.select("id", "content").join(hits, "id").join(queries.select("qid", "query"), "qid")
    docs = docs.withColumn("cc", size).withColumn("ov", overlap).withColumn("words", T.tokens(F.col("query"))).withColumn("phrase", T.strip(F.col("query")))
    chunks = T.char_chunks(F.col("content"), F.col("cc"), F.col("ov"))
    scored = F.transform(chunks, lambda c: F.struct((-T.chunk_score(F.col("words"), F.col("phrase"), c["text"])).alias("less"), c["index"].alias("index"), c["text"].alias("text")))
    docs = docs.select(*hits.columns, "cc", "ov", F.size(chunks).alias("total"), F.slice(F.array_sort(scored), 1, max_chunks).alias("x"))
    docs = docs.where(F.size("x") > 0)  # of a column that asks the query too: on the texts' own length, all texts would be cut before they are met
    docs = docs.withColumn("x", F.filter("x", lambda c, i: (i == 0) | (c["less"] <= F.col("x")[0]["less"] * ratio)))
    cost = lambda text: T.token_estimate(T.words(text))
    docs = docs.withColumn("x", F.transform("x", lambda c: F.struct(c["index"].alias("index"), c["text"].alias("text"), cost(c["text"]).alias("tokens"))))
    if budget:
        short = F.struct(F.col("x")[0]["index"].alias("index"), trimmed(F.col("x")[0]["text"], budget).alias("text"), cost(trimmed(F.col("x")[0]["text"], budget)).alias("tokens"))
        used = lambda i: F.aggregate(F.slice("x", F.lit(1), i + 1), F.lit(0), lambda a, c: a + c["tokens"])
        docs = docs.withColumn("x", F.when(F.col("x")[0]["tokens"] > budget, F.array(short)).otherwise(F.filter("x", lambda c, i: used(i) <= budget)))
    first = F.col("x")[0]["index"]
    return docs.select(
        *hits.columns, first.alias("chunk_index"), T.text_chunk_id(F.col("id"), first, F.col("cc"), F.col("ov")).alias("chunk_id"), F.size("x").alias("matched_chunks"),
        F.array_join(F.col("x.text"), "\n\n---\n\n").alias("chunk_text"), F.aggregate("x", F.lit(0), lambda a, c: a + c["tokens"]).alias("tokens"), F.col("total").alias("chunk_total"), F.col("x.index").alias("chunk_indices"),
    )


#: Of the reference's names: the least partial ratio of a near name, the boost's factor and its cap, which every near name reaches.
NEAR_NAME, NAME_BOOST, NAME_CAP = 70.0, 2.5, 1.25
#: Modes that give the other lane no weight.
ONE_LANE = {"bm25_only": "word", "trigram_only": "trigram"}


def search(files: DataFrame, queries: DataFrame, k: int = 20, mode: str = "hybrid", matter_id: str | None = None, exclude: list[str] | None = None, prefilter: bool = False, n_queries: int | None = None, names: bool = True, index=None) -> DataFrame:
    """(qid, id, score, rank): both lanes' best 80, fused by rank; a query that is a file's name gets that file alone with score 5.

    names: the word lane is stemmed; a file whose name is near a word of the query (partial ratio of NEAR_NAME or more) gains up to
    NAME_CAP; where no lane finds a file, those of near names are found, with the ratio as score. Without: the fused lanes alone.
    matter_id and exclude (paths) apply after the lanes' limit, or before with prefilter. index: a postings.Index of all files, by which both
    lanes go without reading a text; counts of a part of the files, which prefilter asks for, it doesn't have.
    """
    if prefilter and index is not None:
        raise ValueError("an index of all files can't be used with prefilter")
    keep = F.lit(True) if matter_id is None else F.col("matter_id") == matter_id
    keep = keep & ~F.col("path").isin(exclude) if exclude else keep
    pool = files.where(keep) if prefilter else files
    asked = F.lower(T.strip(F.col("query"))) == F.lower("filename")
    exact = cut(hint(queries, n_queries).join(pool.select("id", "filename"), asked).groupBy("qid").agg(F.max("id").alias("id")).withColumn("score", F.lit(5.0)))
    queries = queries.join(exact.select("qid"), "qid", "left_anti")  # names have words that all files hold, so no lane is asked for them
    q = queries.withColumn("w", T.lane_weights(F.lit(mode), T.is_noisy(F.col("query"))))
    lanes = []
    for name, lane in (("word", bm25), ("trigram", trigram)):
        if mode in ONE_LANE and ONE_LANE[mode] != name:
            continue  # the mode's weight for it is 0
        found = lane(pool, queries, n_queries=n_queries, index=index, **({"stemmed": True} if names and lane is bm25 else {})).join(q.select("qid", F.col(f"w.{name}").alias("weight")), "qid")
        lanes.append((found, F.col("weight")))
    fused = fuse(lanes)
    if names:
        fused = cut(fused)  # at most 160 rows a query, which three joins below ask for
        words = q.select("qid", T.tokens(F.col("query")).alias("words"))
        near = lambda hits: hits.withColumn("near", fuzzy.best_ratios(F.col("words"), F.lower("filename")))
        alone = words.join(fused.select("qid").distinct(), "qid", "left_anti")
        known = near(fused.select("qid", "id", "score").join(pool.select("id", "filename"), "id").join(words, "qid"))
        boost = F.when(F.col("near") >= NEAR_NAME, F.least(F.lit(NAME_CAP), F.col("near") / 100 * NAME_BOOST)).otherwise(0.0)
        asked = alone.select("qid", F.explode("words").alias("word")).distinct()
        by_word = fuzzy.near_names(asked, pool.select(F.lower("filename").alias("name")), NEAR_NAME)
        best = asked.join(by_word, "word").groupBy("qid", "name").agg(F.max("score").alias("near"))
        found = best.join(pool.select("id", F.lower("filename").alias("name")), "name")
        fused = known.select("qid", "id", (F.col("score") + boost).alias("score")).unionByName(found.select("qid", "id", F.least(F.lit(1.0), F.col("near") / 100).alias("score")))
    fused = fused.unionByName(exact.select("qid", "id", "score"))
    if not prefilter and (matter_id is not None or exclude):
        fused = fused.join(files.where(keep).select("id"), "id")
    return top(fused, k)
