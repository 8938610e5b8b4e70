"""Catalogue queries over the supplied tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import catalog as C
from tessera.plans.text_queries import FILES
from tessera.sources.relations import files, table

_PATHS = ["src/main.py", "bin/run", "a/cmd/tool.go", "tests/test_a.py", "a/b_test.py", "x.spec.ts", ".env", "conf/app.YAML", "lib/core.rs", "thumbs/p1.png", "a/p_thumbnail.jpg", "Program.cs", "a/.hidden.md", "v.mp4", "s.mp3"]


def _paths(spark, d):
    """A path of a fixed list for each part."""
    return table(spark, d, "part").select("p_partkey", F.element_at(F.array(*[F.lit(p) for p in _PATHS]), (F.col("p_partkey") % len(_PATHS) + 1).cast("int")).alias("path"))


def file_flags(spark, d):
    return _paths(spark, d).select("p_partkey", *C.file_flags(F.col("path")))


def ignored_paths(spark, d):
    return _paths(spark, d).groupBy("path", C.ignored(F.col("path"), "thumbs").alias("ignored")).agg(F.count("*").alias("n"))


def routed_events(spark, d):
    return C.routed(_paths(spark, d), ["text", "image", "video"], "thumbs").groupBy("modality").agg(F.count("*").alias("n"))


def not_blank(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 5 == 0, F.lit("  ")).when(F.col("doc_id") % 7 != 0, F.col("text")).alias("text"))
    return rows.where(C.not_blank(F.col("text"))).select("doc_id")


def doc_brief(spark, d):
    return table(spark, d, "documents").select("doc_id", C.brief(F.col("text")).alias("brief"))


def frame_labels(spark, d):
    return table(spark, d, "events").select("event_id", C.seconds_label(F.floor(F.col("value") * 10) / 10 - 5).alias("label"))


def share_bars(spark, d):
    counts = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(counts.agg(F.max("n").alias("most")))).select("event_type", C.bar(F.col("n"), F.col("most")).alias("bar"))


def plain_match(spark, d):
    q = F.concat_ws(" ", F.lit(" a"), F.when(F.col("item_id") % 2 == 0, "OR").otherwise("and"), F.substring("text", 1, 30), F.lit("Not* not  b* "))
    return table(spark, d, "benchmark").select("item_id", C.plain_match(q).alias("match"))


def project_score(spark, d):
    bits = [((F.col("p_partkey") / F.lit(2**i)).cast("long") % 2 == 1).alias(k) for i, k in enumerate(C.SIGNALS)]
    return C.project_score(table(spark, d, "part").select("p_partkey", *bits)).select("p_partkey", "score", "band", "is_code")


def image_upsert(spark, d):
    c = table(spark, d, "customer").select(F.concat(F.lit("/img/"), F.md5(F.col("c_custkey").cast("string")), F.lit(".png")).alias("path"), F.col("c_custkey").alias("id"), F.floor("c_acctbal").alias("mtime"))
    stored = c.where("id % 3 <> 0").withColumn("embedded", F.lit(True))
    return C.upsert_images(stored, c.where("id % 4 <> 0").select("path", (F.col("mtime") + F.col("id") % 2).alias("mtime")))


def merged_lanes(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("path"), (F.col("l_linenumber") % 2).alias("chunk"), F.when(F.col("l_returnflag") == "R", 0.0).otherwise(F.col("l_discount")).alias("lexical"), F.col("l_tax").alias("semantic"), F.array(F.lower("l_linestatus"), F.col("l_returnflag")).alias("tokens"), F.when(F.col("l_linenumber") > 2, "vector").otherwise("words").alias("source"))
    out = C.merge_lanes(rows, ["path", "chunk"], 0.6, 0.4)
    return out.select("path", "chunk", F.round("score", 6).alias("score"), F.array_join("tokens", ",").alias("tokens"), F.array_join("sources", ",").alias("sources"))


def ocr_coverage(spark, d):
    text = F.when(F.col("page_id") % 3 != 0, F.col("html"))
    return table(spark, d, "pages").agg(F.round(F.count_if(C.not_blank(text)) / F.count("*"), 4).alias("coverage"))


def known_and_found(spark, d):
    p = table(spark, d, "pages").select("url", "page_id")
    known, found = p.where("page_id % 3 <> 0").withColumn("origin", F.lit("known")), p.where("page_id % 2 = 0").withColumn("origin", F.lit("found"))
    return C.known_and_found(known, found, "url")


def preflight(spark, d):
    s = table(spark, d, "supplier")
    stored = s.select(F.concat(F.lit("n"), "s_nationkey").alias("folder"), F.concat(F.lit("f"), F.when(F.col("s_suppkey") % 4 == 0, "").otherwise(F.concat(F.lit("["), F.col("s_suppkey") % 4, F.lit("]"))), F.lit(".txt")).alias("filename"), F.col("s_nationkey").cast("string").alias("sha256"))
    stored = stored.groupBy("folder", "filename").agg(F.min("sha256").alias("sha256"))
    n = table(spark, d, "nation")
    up = n.select(F.concat(F.lit("n"), "n_nationkey").alias("folder"), F.lit("f.txt").alias("filename"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_nationkey").cast("string")).otherwise("other").alias("sha256"))
    return C.preflight(up, stored)


def delete_modality(spark, d):
    o, li = table(spark, d, "orders").select(F.col("o_orderkey").alias("path"), "o_orderstatus"), table(spark, d, "lineitem").select(F.col("l_orderkey").alias("file_path"))
    left = C.without_modality({"files": (o, "path"), "chunks": (li, "file_path")}, o.where("o_orderstatus = 'P'"))
    return left["files"].agg(F.count("*").alias("files")).crossJoin(left["chunks"].agg(F.count("*").alias("chunks")))


def delete_path(spark, d):
    f = files(spark, d)
    return C.without_path(C.without_path(f, "/src0/en/doc_1.txt"), "/src1/en/doc_2.txt", "src9").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


def fetch_content(spark, d):
    wanted = files(spark, d).where("id % 20 = 0").select("path").unionByName(spark.createDataFrame([("/none",)], "path string"))
    return C.content(files(spark, d), wanted, 500).select("path", "found", F.md5("text").alias("text_md5"), "cut")


QUERIES = {f.__name__: f for f in (file_flags, ignored_paths, routed_events, not_blank, doc_brief, frame_labels, share_bars, plain_match, project_score, image_upsert, merged_lanes, ocr_coverage, known_and_found, preflight, delete_modality, delete_path, fetch_content)}

_P = f"p as (select p_partkey, {_PATHS}[p_partkey % {len(_PATHS)} + 1] as path from part), f as (select *, lower(path) low, lower(string_split(path, '/')[-1]) nm from p)"
_IGNORE = "(starts_with(path, 'thumbs/') or regexp_matches(nm, '^.+_thumbnail\\.[^.]*$') or starts_with(nm, '.'))"
SQL = {
    "file_flags": rf"with {_P} select p_partkey, nm in ('main.py','app.py','server.py','manage.py','cli.py','index.js','index.ts','main.rs','main.go','program.cs') or regexp_matches(low, '(^|/)(cmd|bin)/') entry_point, starts_with(nm, 'test_') or ends_with(nm, '_test.py') or contains(nm, '.test.') or contains(nm, '.spec.') test, starts_with(nm, '.') or regexp_matches(nm, '\.(json|yaml|yml|toml|ini|cfg|conf|env|xml)$') config from f",
    "ignored_paths": f"with {_P} select path, {_IGNORE} as ignored, count(*) n from f group by all",
    "routed_events": rf"with {_P} select case when regexp_matches(nm, '\.(yaml|md)$') then 'text' when regexp_matches(nm, '\.(png|jpg)$') then 'image' else 'video' end modality, count(*) n from f where not {_IGNORE} and regexp_matches(nm, '\.(yaml|md|png|jpg|mp4)$') group by all",
    "not_blank": "select doc_id from documents where doc_id % 5 <> 0 and doc_id % 7 <> 0 and length(trim(text)) > 0",
    "doc_brief": r"with s as (select doc_id, trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) t from documents) select doc_id, nullif(substr(trim(regexp_split_to_array(t, '\r\n|[\n\r]')[1], ' ' || chr(9) || chr(11) || chr(12)), 1, 100), '') brief from s",
    "frame_labels": "with v as (select event_id, floor(value*10)/10 - 5 x from events) select event_id, case when x > 0 then printf('%.1f', x) || 's' else 'unknown' end as label from v",
    "share_bars": "with c as (select event_type, count(*) n from events group by all), b as (select event_type, round_even(n * 12.0 / max(n) over (), 0)::int k from c) select event_type, repeat('#', k) || repeat('-', 12 - k) bar from b",
    "plain_match": r"with q as (select item_id, ' a ' || case when item_id % 2 = 0 then 'OR' else 'and' end || ' ' || substr(text, 1, 30) || ' Not* not  b* ' q from benchmark) select item_id, array_to_string(list_filter(regexp_split_to_array(q, '\s+'), lambda t: upper(t) not in ('AND','OR','NOT','')), ' ') as match from q",
    "project_score": "with s as (select p_partkey, list_sum([case when (p_partkey >> i) & 1 = 1 then [40,30,20,15,15,10,10,10][i+1] else 0 end for i in range(8)])::int score from part) select *, case when score >= 40 then 'high' when score >= 20 then 'medium' else 'low' end band, score >= 40 is_code from s",
    "image_upsert": "with c as (select '/img/' || md5(c_custkey::varchar) || '.png' path, c_custkey id, floor(c_acctbal)::bigint mtime from customer), o as (select * from c where id % 3 <> 0), n as (select path, mtime + id % 2 mtime from c where id % 4 <> 0), t as (select max(id) top from o) select path, greatest(o.mtime, coalesce(n.mtime, o.mtime)) mtime, id, coalesce(n.mtime <= o.mtime, true) embedded from o left join n using(path) union all select path, mtime, (select top from t) + row_number() over (order by path), false from n where path not in (select path from o)",
    "merged_lanes": "with r as (select l_orderkey path, l_linenumber % 2 as chunk, case when l_returnflag = 'R' then 0.0 else l_discount end x, l_tax y, [lower(l_linestatus), l_returnflag] t, case when l_linenumber > 2 then 'vector' else 'words' end s from lineitem) select path, chunk, round(0.6*max(x) + 0.4*max(y), 6) score, array_to_string(list_sort(list_distinct(flatten(list(t)))), ',') tokens, array_to_string(list_sort(list_distinct(list(s))), ',') sources from r where 0.6*x + 0.4*y > 0 group by all",
    "ocr_coverage": "select round(count(*) filter (page_id % 3 <> 0 and length(trim(html)) > 0) / count(*), 4) coverage from pages",
    "known_and_found": "select url, page_id, 'found' origin from pages where page_id % 2 = 0 union all select url, page_id, 'known' from pages where page_id % 3 <> 0 and url not in (select url from pages where page_id % 2 = 0)",
    "preflight": "with s as (select distinct 'n' || s_nationkey folder, s_suppkey % 4 i from supplier), u as (select 'n' || n_nationkey folder, n_nationkey k from nation), x as (select *, exists(select 1 from s where s.folder = u.folder and i = 0) held, (select min(j) from range(1, 6) r(j) where j not in (select i from s where s.folder = u.folder)) free from u) select folder, 'f.txt' filename, case when k % 2 = 0 then k::varchar else 'other' end sha256, case when not held then 'accept' when k % 2 = 0 then 'reject' else 'rename' end as action, case when not held then 'f.txt' when k % 2 <> 0 then 'f[' || free || '].txt' end target from x",
    "delete_modality": "select (select count(*) from orders where o_orderstatus <> 'P') files, (select count(*) from lineitem where l_orderkey not in (select o_orderkey from orders where o_orderstatus = 'P')) chunks",
    "delete_path": f"with {FILES} select count(*) n, sum(id)::bigint ids from files where path <> '/src0/en/doc_1.txt'",
    "fetch_content": f"with {FILES} select path, true as found, md5(substr(content, 1, 500)) text_md5, length(content) > 500 cut from files where id % 20 = 0 union all select '/none', false, null, false",
}
