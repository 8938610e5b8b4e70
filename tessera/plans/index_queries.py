"""Queries of projects, scans and connectors over the supplied tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import code
from tessera.operators import connector as C
from tessera.operators import projects as P
from tessera.plans.catalog_queries import _PATHS, _paths
from tessera.plans.more_queries import FACTS, code_files
from tessera.sources.relations import table

_TOP, _NAMES = ["vendor", ".github", "Build"], [".git/HEAD", "package.json", "a.py", "b.rs", "README.md", "node_modules/x.js", "c.ts", "Makefile", "d.go", "next.config.js", "e.txt", "f.csproj"]


def _tree(spark, d, *more):
    """A listing of folders, made from the parts, with more columns of theirs."""
    top = F.coalesce(F.get(F.array(*[F.lit(x) for x in _TOP]), (F.col("p_partkey") % 13).cast("int")), F.concat(F.lit("r"), "p_size"))
    name = F.get(F.array(*[F.lit(x) for x in _NAMES]), (F.col("p_partkey") % len(_NAMES)).cast("int"))
    middle = F.concat(F.lit("m"), F.col("p_partkey") % 7, F.when(F.col("p_partkey") % 2 == 0, "/src/").otherwise("/"))
    return table(spark, d, "part").select(F.concat_ws("/", top, F.concat(middle, name)).alias("path"), F.concat_ws("\n", "p_name", "p_brand").alias("content"), *more)


def project_roots(spark, d):
    return P.project_roots(_tree(spark, d).select("path").distinct())


def nested_roots(spark, d):
    return P.nested_roots(_tree(spark, d).select("path").distinct())


def top_folders(spark, d):
    return P.top_folders(_tree(spark, d)).select("category", F.array_join("folders", ",").alias("folders"), "n")


def listed_files(spark, d):
    return P.listed(_tree(spark, d).select("path").distinct(), [".PY", "ts", "js"], ["*/node_modules/*", "r1*/m3/?.py"])


def mime_types(spark, d):
    return _paths(spark, d).groupBy("path", P.mime(F.col("path")).alias("mime")).agg(F.count("*").alias("n"))


def scan_actions(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("path"), (F.col("o_custkey") + 0.5).alias("mtime"))
    found = o.where("path % 5 <> 1").withColumn("mtime", F.col("mtime") + F.when(F.col("path") % 3 == 0, 1e-7).when(F.col("path") % 3 == 1, -2.0).otherwise(0.0))
    return P.scan_actions(o.where("path % 4 <> 1"), found)


def event_tombstones(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("path"), F.when(F.col("event_type") == "error", "deleted").otherwise("modified").alias("change"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"))
    stays, gone = P.after_events(e.select("path").distinct(), e)
    return stays.select("path", F.lit(None).cast("long").alias("deleted_at")).unionByName(gone.select("path", F.col("ts").alias("deleted_at")))


def line_range(spark, d):
    """Each document's lines from 2 to 5, and how many there are in all."""
    lines = table(spark, d, "documents").select("doc_id", F.md5(P.line_range(F.col("text"), F.lit(2), F.lit(5))).alias("lines_md5"), F.size(P.lines_of(F.col("text"))).alias("n_lines"))
    return lines


def language_summary(spark, d):
    return P.languages(_tree(spark, d))


def module_detail(spark, d):
    return P.modules(code.symbols(code_files(spark, d))).select("path", F.array_join("symbols", ",").alias("symbols"), F.array_join("imports", ",").alias("imports"))


_KINDS = ["paragraph", "to_do", "code", "bookmark", "image", "child_page", "heading_1"]


def _blocks(spark, d):
    """Conversations as pages of blocks: turn 0 is a page's first block, turns 2t + 1 and 2t + 2 stand below turn t."""
    rich = F.array(F.struct(F.col("text").alias("plain_text")))
    payload = F.to_json(F.struct(rich.alias("rich_text"), rich.alias("caption"), (F.col("conv_id") % 2 == 0).alias("checked"), F.when(F.col("conv_id") % 3 == 0, "sql").alias("language"), F.col("role").alias("url"), F.concat("role", F.lit("s")).alias("title")))
    number = F.col("conv_id") * 1000
    c = table(spark, d, "conversations").where("turn is not null")
    kind = F.get(F.array(*[F.lit(k) for k in _KINDS]), ((F.col("turn") + F.col("conv_id")) % len(_KINDS)).cast("int"))
    return c.select(F.col("conv_id").alias("object"), (number + F.col("turn")).alias("id"), F.when(F.col("turn") > 0, number + F.floor((F.col("turn") - 1) / 2)).alias("parent"), F.col("turn").alias("pos"), kind.alias("kind"), payload.alias("payload"))


def connector_pages(spark, d):
    """The text of each page, its blocks level by level."""
    blocks = _blocks(spark, d)
    levels = C.reached(blocks.where("parent is null").select("id"), blocks.where("parent is not null").select("parent", F.col("id").alias("child")))
    return C.page_texts(blocks, levels).select("object", F.md5("content").alias("content_md5"))


def connector_refs(spark, d):
    return C.child_refs(_blocks(spark, d).withColumn("id", F.col("id").cast("string")))


def connector_reached(spark, d):
    """Suppliers that three of them lead to, over links from s to 2s and 3s, with the least number of steps."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("child"))
    links = s.where("child % 2 = 0").select((F.col("child") / 2).cast("long").alias("parent"), "child").unionByName(s.where("child % 3 = 0").select((F.col("child") / 3).cast("long").alias("parent"), "child"))
    return C.reached(s.where("child in (1, 5, 7)").select(F.col("child").alias("id")), links)


def sync_actions(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("sha256"), "o_custkey")
    http = F.when(F.col("id") % 10 == 0, 404).when(F.col("id") % 10 == 1, 500).otherwise(200)
    return C.sync_actions(o.where("id % 3 <> 0"), o.select("id", http.alias("http_status"), F.when(F.col("o_custkey") % 2 == 0, F.col("sha256")).otherwise("x").alias("sha256")))


def known_objects(spark, d):
    s = table(spark, d, "supplier")
    rows = s.select(F.concat(F.lit("p"), F.col("s_nationkey") % 2).alias("provider"), F.lit("a").alias("account_id"), F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 5 == 0, "deleted").otherwise("active").alias("status"), F.when(F.col("s_suppkey") % 3 == 0, "page").otherwise("file").alias("object_type"), F.col("s_acctbal").alias("last_seen"))
    return C.known_objects(rows, "p1", "a", ["page", "database"]).select("id", "object_type")


QUERIES = {f.__name__: f for f in (project_roots, nested_roots, top_folders, listed_files, mime_types, scan_actions, event_tombstones, line_range, language_summary, module_detail, connector_pages, connector_refs, connector_reached, sync_actions, known_objects)}

_TREE = f"t as (select distinct coalesce({_TOP}[p_partkey % 13 + 1], 'r' || p_size) || '/m' || p_partkey % 7 || case when p_partkey % 2 = 0 then '/src/' else '/' end || {_NAMES}[p_partkey % {len(_NAMES)} + 1] path from part), f as (select path, regexp_replace(path, '/[^/]*$', '') folder, string_split(path, '/')[-1] nm from t)"
_BLOCKS = rf"b as (select conv_id, turn, conv_id * 1000 + turn id, role, {_KINDS}[(turn + conv_id) % {len(_KINDS)} + 1] kind, regexp_replace(text, '^\s+|\s+$', '', 'g') x from conversations)"
SQL = {
    "module_detail": f"with {FACTS} select path, coalesce(string_agg(kind || ':' || name || ':' || line, ',' order by line, name) filter (kind in ('class', 'function')), '') symbols, string_agg(distinct name, ',' order by name) filter (kind in ('import', 'internal')) imports from facts group by path",
    "project_roots": f"with {_TREE}, m as (select folder root, case when nm in ('package.json', 'Makefile', 'f.csproj') then 1 else 2 end place from f where nm in ('package.json', 'Makefile', 'f.csproj', 'next.config.js') union select replace(folder, '/.git', ''), 0 from f where ends_with(folder, '/.git')) select folder, coalesce(arg_min(root, place * 1000 - length(root)), folder) root, coalesce(['vcs','manifest','framework'][min(place) + 1], 'fallback') as method from (select distinct folder from f) left join m on folder = root or starts_with(folder, root || '/') group by folder",
    "nested_roots": rf"with {_TREE}, g as (select folder root, bool_or(nm in ('package.json', 'Makefile')) has_marker, count(*) filter (regexp_matches(nm, '\.(py|rs|js|ts|go)$')) code_files from f where not regexp_matches('/' || folder || '/', '/(\.git|node_modules|vendor|build)/') group by all), l as (select * from g where has_marker or code_files >= 3) select * from l where not exists (select 1 from l o where starts_with(l.root, o.root || '/'))",
    "top_folders": f"with {_TREE}, n as (select distinct string_split(path, '/')[1] n from t), c as (select n, case when n = 'vendor' then 'dependency_code' when n = 'Build' then 'generated_code' when n = '.github' then 'configuration' else 'application_code' end category from n) select category, string_agg(n, ',' order by n) folders, count(*) n from c group by category",
    "listed_files": rf"with {_TREE} select path from f where regexp_matches(nm, '\.(py|ts|js)$') and not contains(path, '/node_modules/') and not regexp_matches(path, '^r1.*/m3/.\.py$')",
    "mime_types": rf"with p as (select {_PATHS}[p_partkey % {len(_PATHS)} + 1] path from part) select path, case when ends_with(path, '.py') then 'text/x-python' when ends_with(path, '.png') then 'image/png' when ends_with(path, '.jpg') then 'image/jpeg' when ends_with(path, '.md') then 'text/markdown' when ends_with(path, '.mp4') then 'video/mp4' when ends_with(path, '.mp3') then 'audio/mpeg' else 'application/octet-stream' end mime, count(*) n from p group by all",
    "scan_actions": "select o_orderkey path, case when o_orderkey % 4 = 1 then 'insert' when o_orderkey % 5 = 1 then 'purge' when o_orderkey % 3 = 1 then 'update' else 'skip' end as action from orders where o_orderkey % 4 <> 1 or o_orderkey % 5 <> 1",
    "event_tombstones": "select user_id path, case when arg_max(event_type, (ts, event_type <> 'error')) = 'error' then epoch_us(max(ts)) end deleted_at from events group by user_id",
    "line_range": "with l as (select doc_id, string_split(text, chr(10)) a from documents), m as (select doc_id, case when a[-1] = '' then a[:len(a) - 1] else a end a from l) select doc_id, md5(array_to_string(a[2:5], chr(10))) lines_md5, len(a) n_lines from m",
    "language_summary": f"with n as (select {_NAMES}[p_partkey % {len(_NAMES)} + 1] nm from part), g as (select case nm when 'a.py' then 'python' when 'b.rs' then 'rust' when 'c.ts' then 'typescript' when 'd.go' then 'go' when 'package.json' then 'json' when 'README.md' then 'markdown' when 'Makefile' then 'make' when 'node_modules/x.js' then 'javascript' when 'next.config.js' then 'javascript' when 'e.txt' then 'text' else 'unknown' end as language from n) select language, count(*) files, 2 * count(*) as lines from g group by all",
    "connector_pages": rf"with {_BLOCKS}, x as (select *, case kind when 'to_do' then regexp_replace(case when conv_id % 2 = 0 then '[x] ' else '[ ] ' end || x, '\s+$', '') when 'code' then regexp_replace('[code:' || case when conv_id % 3 = 0 then 'sql' else 'plain' end || '] ' || x, '\s+$', '') when 'bookmark' then role when 'child_page' then role || 's' else x end line from b) select conv_id as object, md5(string_agg(line, chr(10) order by turn)) content_md5 from x where line <> '' group by conv_id",
    "connector_refs": f"with {_BLOCKS} select id::varchar id, 'page' object_type, role || 's' title from b where kind = 'child_page'",
    "connector_reached": "with recursive r as (select s_suppkey id, 0 as level from supplier where s_suppkey in (1, 5, 7) union select s_suppkey, level + 1 from r join supplier on s_suppkey = 2 * id or s_suppkey = 3 * id) select id, min(level) as level from r group by id",
    "sync_actions": "select o_orderkey id, case when o_orderkey % 10 = 0 then case when o_orderkey % 3 <> 0 then 'deleted' else 'failed' end when o_orderkey % 10 = 1 then 'failed' when o_orderkey % 3 = 0 then 'inserted' when o_custkey % 2 = 0 then 'unchanged' else 'updated' end as action from orders",
    "known_objects": "select s_suppkey id, 'page' object_type from supplier where s_nationkey % 2 = 1 and s_suppkey % 5 <> 0 and s_suppkey % 3 = 0",
}
