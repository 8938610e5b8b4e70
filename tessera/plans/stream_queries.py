"""Stateful streams over the supplied tables, and SQL that gives what they have given once they are through."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.sources.relations import table
from tessera.streaming import changes as C
from tessera.streaming import manifest as M
from tessera.streaming.stateful import drained_to_end, shared_folder

LEASE = 6 * 3600 * 1000
END = "2100-01-01"


def _events(spark, d):
    return spark.readStream.schema(table(spark, d, "events").schema).option("pathGlobFilter", "events*.parquet").option("recursiveFileLookup", "true").parquet(d)


def stream_manifest(spark, d):
    """Users' events as what happens to files of a fetch manifest: each file's state at the end, and what led there."""
    t, id = F.col("event_type"), F.col("event_id")
    kind = F.when(t == "view", "listed").when(t == "click", "claim").when(t == "purchase", "piece").when(t == "signup", "done").when(id % 3 == 0, "failed").otherwise("requeue")
    at = F.unix_millis(F.col("ts").cast("timestamp"))
    e = _events(spark, d).select(F.col("user_id").cast("string").alias("path"), at.alias("at"), id.alias("n"), kind.alias("kind"), F.concat(F.lit("w"), id % 2).alias("worker"), (id % 2).alias("size"), F.lit("m").alias("modified"), (id % 2).cast("int").alias("number"), F.concat(F.lit("t"), id).alias("text"))
    last = spark.createDataFrame([(None, 4102444800000, 0, "listed", None, None, None, None, None)], M.EVENT)
    M.with_state_store(spark)
    rows = drained_to_end(e, last, lambda s: M.machine(s, LEASE))
    newest = F.max_by("after", "seq")
    fetched = F.max_by(F.col("content"), F.when(F.col("content").isNotNull(), F.col("seq")))
    return rows.groupBy(F.col("path").cast("long").alias("path")).agg(newest.alias("state"), F.count("*").alias("n_changes"), F.count_if(F.col("error") == M.EXPIRED).alias("n_expired"), F.count_if(F.col("after") == "FETCHED").alias("n_fetched"), fetched.alias("content"))


def _listings(spark, d):
    """Three listings of documents' texts, an hour and then ten minutes apart: some come, some go, some change, some have another path."""
    docs = table(spark, d, "documents").select("doc_id", F.md5("text").alias("hash"))
    path = lambda folder: F.concat(F.lit(folder), F.col("doc_id").cast("string"))
    id = F.col("doc_id")
    first = docs.where(id % 7 != 0).select(path("/a/").alias("path"), "hash")
    second = docs.where(id % 5 != 0).select(F.when(id % 3 == 0, path("/b/")).otherwise(path("/a/")).alias("path"), F.when(id % 11 == 0, F.md5("hash")).otherwise(F.col("hash")).alias("hash"))
    third = docs.select(F.when(id % 3 == 0, path("/b/")).when(id % 5 == 0, path("/c/")).otherwise(path("/a/")).alias("path"), F.when(id % 11 == 0, F.md5("hash")).otherwise(F.col("hash")).alias("hash"))
    return first, second, third


def _changes(spark, d):
    a, b, c = _listings(spark, d)
    return C.between(a, b, "2024-01-01 10:00:00").unionByName(C.between(b, c, "2024-01-01 10:10:00"))


def listing_changes(spark, d):
    return _changes(spark, d).groupBy("kind", "ts").agg(F.count("*").alias("n"), F.countDistinct("hash").alias("contents")).withColumn("ts", F.date_format("ts", "HH:mm"))


def stream_moves(spark, d):
    """The moves among the changes, the stream having been fed one listing after the other."""
    folder = shared_folder(spark, "changes")
    _changes(spark, d).write.partitionBy("ts").parquet(folder)
    stream = spark.readStream.schema("kind string, path string, hash string, number long, ts timestamp").option("maxFilesPerTrigger", 4).parquet(folder)
    last = spark.createDataFrame([("created", "end", None, 0), ("deleted", "end", None, 0)], "kind string, path string, hash string, number long").withColumn("ts", F.lit(END).cast("timestamp"))
    rows = drained_to_end(stream, last, C.moves_stream)
    return rows.where("path <> 'end'").select("kind", "path", "source", F.date_format("ts", "HH:mm").alias("ts"))


QUERIES = {f.__name__: f for f in (stream_manifest, listing_changes, stream_moves)}

_MD5 = "case when doc_id % 11 = 0 then md5(md5(text)) else md5(text) end"
_CHANGES = f"""l1 as (select '/a/' || doc_id path, md5(text) hash from documents where doc_id % 7 <> 0),
 l2 as (select case when doc_id % 3 = 0 then '/b/' else '/a/' end || doc_id path, {_MD5} hash from documents where doc_id % 5 <> 0),
 l3 as (select case when doc_id % 3 = 0 then '/b/' when doc_id % 5 = 0 then '/c/' else '/a/' end || doc_id path, {_MD5} hash from documents),
 d1 as (select '10:00' ts, coalesce(l1.path, l2.path) path, coalesce(l2.hash, l1.hash) hash, case when l1.path is null then 'created' when l2.path is null then 'deleted' when l1.hash <> l2.hash then 'modified' end kind from l1 full join l2 on l1.path = l2.path),
 d2 as (select '10:10' ts, coalesce(l2.path, l3.path) path, coalesce(l3.hash, l2.hash) hash, case when l2.path is null then 'created' when l3.path is null then 'deleted' when l2.hash <> l3.hash then 'modified' end kind from l2 full join l3 on l2.path = l3.path),
 e as (select *, row_number() over (partition by ts, kind, hash order by path) number from (from d1 union all from d2) where kind is not null)"""
SQL = {
    "stream_manifest": f"""with recursive o as (select user_id path, epoch_ms(ts) at_ms, event_id n, case event_type when 'view' then 'listed' when 'click' then 'claim' when 'purchase' then 'piece' when 'signup' then 'done' else case when event_id % 3 = 0 then 'failed' else 'requeue' end end kind, 'w' || event_id % 2 w, event_id % 2 v, 't' || event_id txt, row_number() over (partition by user_id order by epoch_ms(ts), event_id) k from events),
 r(path, k, st, size, worker, ends, p0, changes, expired, fetched, content) as (
  select distinct path, 0::bigint, null::varchar, null::bigint, null::varchar, null::bigint, null::varchar, 0, 0, 0, null::varchar from o
  union all
  select path, k, s2, case when kind = 'listed' then v else size end, case when s2 = 'FETCHING' then case when kind = 'claim' and s1 = 'QUEUED' then w else w1 end end, case when s2 = 'FETCHING' then case when s1 = 'QUEUED' then at_ms + {LEASE} else ends end end,
   case when s2 = 'FETCHING' and s1 = 'FETCHING' then case when kind = 'piece' and w = w1 and v = 0 then txt else p1 end end, changes + ex + (s2 is distinct from s1)::int, expired + ex, fetched + (s2 = 'FETCHED' and s1 is distinct from s2)::int, case when s2 = 'FETCHED' and s1 is distinct from s2 then case when v = 0 then '' else p1 end else content end
  from (select *, case when kind = 'listed' then case when s1 is null or (s1 <> 'QUEUED' and not (s1 = 'FETCHED' and size = v)) then 'QUEUED' else s1 end when kind = 'claim' and s1 = 'QUEUED' then 'FETCHING' when kind = 'requeue' and s1 in ('FETCHED', 'FAILED') then 'QUEUED'
    when s1 = 'FETCHING' and w = w1 and kind = 'failed' then 'FAILED' when s1 = 'FETCHING' and w = w1 and kind = 'done' then case when v = 0 or p1 is not null then 'FETCHED' else 'FAILED' end else s1 end s2
   from (select o.*, r.size, r.ends, r.changes, r.expired, r.fetched, r.content, case when st = 'FETCHING' and ends <= at_ms then 1 else 0 end ex, case when st = 'FETCHING' and ends <= at_ms then 'QUEUED' else st end s1, case when st = 'FETCHING' and ends <= at_ms then null else worker end w1, case when st = 'FETCHING' and ends <= at_ms then null else p0 end p1
    from r join o on o.path = r.path and o.k = r.k + 1)))
 select path, case when st = 'FETCHING' then 'QUEUED' else st end state, changes + (st = 'FETCHING')::int n_changes, expired + (st = 'FETCHING')::int n_expired, fetched n_fetched, content from (select *, max(k) over (partition by path) last from r) where k = last and st is not null""",
    "listing_changes": f"with {_CHANGES} select kind, ts, count(*) n, count(distinct hash) contents from e group by all",
    "stream_moves": f"with {_CHANGES}, m as (select g.path source, c.path target, g.ts gts, c.ts cts from (select * from e where kind = 'deleted') g full join (select * from e where kind = 'created') c on g.hash = c.hash and g.number = c.number) select case when source is null then 'created' when target is null then 'deleted' else 'moved' end kind, coalesce(target, source) path, case when target is not null then source end source, coalesce(cts, gts) ts from m",
}
