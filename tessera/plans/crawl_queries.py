"""Queries over a workspace that answers page by page, made from the pages, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import sync as S
from tessera.sources import paged
from tessera.sources.relations import table
from tessera.streaming.stateful import drained, shared_folder

SPACES, SIZE = 12, 5
ACCOUNT = {"provider": "workspace", "account_id": "a1", "display_name": "All pages"}


def _objects(spark, d, generation: int):
    """(id, space, title, edited, html, statuses) of a generation: every fifth page comes with the second, in which every seventh is edited."""
    p, second = table(spark, d, "pages"), F.lit(generation == 2)
    id, edited = F.col("page_id"), second & (F.col("page_id") % 7 == 0)
    lost = F.when(second & (id % 10 == 0), F.array(F.lit(404))).when(second & (id % 10 == 1), F.array(F.lit(500)))
    statuses = lost.when(id % 4 == 1, F.array(F.lit(429), F.lit(200))).when(id % 4 == 2, F.array(F.lit(503), F.lit(500), F.lit(200))).otherwise(F.array(F.lit(200)))
    space = F.concat(F.lit("space-"), (F.conv(F.left(F.md5("url"), F.lit(2)), 16, 10).cast("int") % SPACES).cast("string"))
    rows = p.select(id, space.alias("space"), F.col("url").alias("title"), (id * 10 + F.when(edited, 5).otherwise(0)).alias("edited"), F.concat(F.coalesce("html", F.lit("")), F.when(edited, "<p>edited").otherwise("")).alias("html"), statuses.alias("statuses"))
    return rows if generation == 2 else rows.where("page_id % 5 <> 0")


def _chained(rows, path: str, page: str, results: str, statuses):
    """Answers of rows (path, page, at, result): one for each page of a path, with the next one's cursor."""
    from pyspark.sql import Window

    pages = rows.groupBy(path, page).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", results))), lambda x: x[results]).alias("results"), *([F.first("statuses").alias("statuses")] if statuses is None else []))
    line = Window.partitionBy(path).orderBy(page)
    cursor = F.when(F.row_number().over(line) == 1, "").otherwise(F.col(page).cast("string"))
    return pages.select(path, cursor.alias("cursor"), F.lead(F.col(page).cast("string")).over(line).alias("next"), *([F.col("statuses")] if statuses is None else [statuses.alias("statuses")]), "results")


def _service(spark, d, generation: int) -> dict:
    """The options of a recorded service: it lists every third page; the two after it are its child pages."""
    o = _objects(spark, d, generation)
    ok = F.array(F.lit(200))
    listed = o.where("page_id % 3 = 0").withColumn("path", F.concat(F.lit("collections/"), "space"))
    counts = listed.groupBy("path").agg(F.ceil(F.count("*") / SIZE).alias("n"))
    row = F.to_json(F.struct(F.col("page_id").cast("string").alias("id"), "edited", "title"))
    lists = _chained(listed.join(counts, "path").select("path", F.pmod(F.xxhash64("page_id"), F.col("n")).alias("page"), F.col("page_id").alias("at"), row.alias("result")), "path", "page", "result", F.array(F.lit(503), F.lit(200)))
    rich = lambda x: F.to_json(F.struct(x.alias("plain_text")))
    pieces = o.select("page_id", "statuses", F.posexplode(F.split("html", "<p>")).alias("i", "text"))
    block = lambda id, kind, payload: F.concat(F.lit('{"id":"'), id, F.lit(f'","kind":"{kind}","payload":'), payload, F.lit("}"))
    texts = pieces.select("page_id", "statuses", F.col("i").alias("at"), block(F.concat_ws("-", "page_id", "i"), "paragraph", F.concat(F.lit('{"rich_text":['), rich(F.col("text")), F.lit("]}"))).alias("result"))
    links = o.where("page_id % 3 = 0").select("page_id", "statuses", F.explode(F.array(F.lit(1), F.lit(2))).alias("k"))
    links = links.select("page_id", "statuses", (F.col("k") - 10).alias("at"), (F.col("page_id") + F.col("k")).cast("string").alias("child"))
    known = o.select(F.col("page_id").cast("string").alias("child"))
    links = links.join(known, "child").select("page_id", "statuses", "at", block(F.col("child"), "child_page", F.concat(F.lit('{"title":"child '), F.col("child"), F.lit('"}'))).alias("result"))
    blocks = texts.unionByName(links).withColumns({"path": F.concat(F.lit("objects/"), "page_id", F.lit("/blocks")), "page": F.floor((F.col("at") + 10) / SIZE)})
    whole = lambda path, results: results.select(F.lit(path).alias("path"), F.lit("").alias("cursor"), F.lit(None).cast("string").alias("next"), ok.alias("statuses"), "results")
    spaces = whole("collections", listed.select(F.to_json(F.struct(F.col("space").alias("id"))).alias("r")).distinct().agg(F.collect_list("r").alias("results")))  # SPACES at most
    head = whole("head", listed.agg(F.max("edited").alias("edited")).select(F.array(F.to_json(F.struct("edited"))).alias("results")))
    folder = shared_folder(spark, "service")
    paged.record(lists.unionByName(_chained(blocks, "path", "page", "result", None)).unionByName(spaces).unionByName(head), folder)
    return {"path": folder, "size": str(SIZE), "pause": "0"}


def paged_listing(spark, d):
    """What the service lists, read through the source."""
    options = _service(spark, d, 2)
    spark.dataSource.register(paged.PagedSource)
    return spark.read.format("paged").options(**options).load().select("collection", F.col("id").cast("long").alias("id"), "edited", F.get_json_object("body", "$.title").alias("title"))


def paged_stream(spark, d):
    """What was edited after a time, as a stream."""
    options = _service(spark, d, 2) | {"since": "400"}
    spark.dataSource.register(paged.PagedSource)
    return drained(spark.readStream.format("paged").options(**options).load(), "paged", "append").select(F.col("id").cast("long").alias("id"), "edited")


def connector_sync(spark, d):
    """Two syncs of one account: what the second did with each object, and its state then."""
    empty = spark.createDataFrame([], S.STATE)
    first = S.sync(spark, _service(spark, d, 1), ACCOUNT, empty, 1)
    second = S.sync(spark, _service(spark, d, 2), ACCOUNT, first.documents, 2)
    out = second.documents.join(second.actions, "id", "full_outer")
    return out.select(F.col("id").cast("long").alias("id"), "action", "status", F.md5("content").alias("content_md5"), "last_seen")


def connector_counts(spark, d):
    first = S.sync(spark, _service(spark, d, 1), ACCOUNT, spark.createDataFrame([], S.STATE), 1)
    second = S.sync(spark, _service(spark, d, 2), ACCOUNT, first.documents, 2)
    return first.counts.withColumn("generation", F.lit(1)).unionByName(second.counts.withColumn("generation", F.lit(2)))


QUERIES = {f.__name__: f for f in (paged_listing, paged_stream, connector_sync, connector_counts)}

_LISTED = f"l as (select 'space-' || (('0x' || md5(url)[1:2])::int % {SPACES}) collection, page_id id, page_id * 10 + case when page_id % 7 = 0 then 5 else 0 end edited, url title from pages where page_id % 3 = 0)"
_CONTENT = r"""list_transform(string_split(coalesce(html, ''), '<p>'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g'))"""
_SYNC = f"""g1 as (select * from pages where page_id % 5 <> 0), g2 as (select page_id, html || case when page_id % 7 = 0 then '<p>edited' else '' end html from pages),
 k1 as (select g1.page_id p, c.page_id c from g1 join g1 c on c.page_id in (g1.page_id + 1, g1.page_id + 2) where g1.page_id % 3 = 0), k2 as (select g2.page_id p, c.page_id c from g2 join g2 c on c.page_id in (g2.page_id + 1, g2.page_id + 2) where g2.page_id % 3 = 0),
 r1 as (select page_id from g1 where page_id % 3 = 0 union select c from k1),
 http as (select page_id, case page_id % 10 when 0 then 404 when 1 then 500 else 200 end s from g2),
 r2 as (select page_id from g2 where page_id % 3 = 0 union select page_id from r1 union select c from k2 join http on page_id = p where s = 200),
 n1 as (select p page_id, list('child ' || c order by c) names from k1 group by p), n2 as (select p page_id, list('child ' || c order by c) names from k2 group by p),
 t1 as (select page_id, array_to_string(list_filter(list_concat(coalesce(names, []), {_CONTENT}), lambda x: x <> ''), chr(10)) t from g1 left join n1 using(page_id)),
 t2 as (select page_id, array_to_string(list_filter(list_concat(coalesce(names, []), {_CONTENT}), lambda x: x <> ''), chr(10)) t from g2 left join n2 using(page_id)),
 a as (select r2.page_id id, r1.page_id is not null held, s, t1.t before, t2.t after from r2 join http using(page_id) left join r1 using(page_id) left join t1 on t1.page_id = r1.page_id join t2 on t2.page_id = r2.page_id),
 b as (select *, case when s = 200 then case when not held then 'inserted' when before = after then 'unchanged' else 'updated' end when s = 404 and held then 'deleted' else 'failed' end as action from a)"""
SQL = {
    "paged_listing": f"with {_LISTED} select * from l",
    "paged_stream": f"with {_LISTED} select id, edited from l where edited > 400",
    "connector_sync": f"with {_SYNC} select id, action, case when action = 'deleted' then 'deleted' when held or s = 200 then 'active' end status, md5(case when s = 200 then after when held then before end) content_md5, case when s = 200 then 2 when held then 1 end last_seen from b",
    "connector_counts": f"with {_SYNC} select count(*) fetched, count(*) updated, 0 unchanged, 0 failed, (select count(*) from g1 where page_id % 3 = 0) discovered, 1 generation from r1 union all select count(*) filter(s = 200), count(*) filter(action in ('inserted', 'updated')), count(*) filter(action = 'unchanged'), count(*) filter(action in ('deleted', 'failed')), (select count(*) from g2 where page_id % 3 = 0), 2 from b",
}
