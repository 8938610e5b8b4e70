"""Queries of links between files and of what files say of a project, over a tree made from the parts, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import links as L
from tessera.operators import replace as R
from tessera.operators.runs import RunLog
from tessera.plans.index_queries import _NAMES, _TREE, _tree
from tessera.plans.text_queries import FILES
from tessera.sources.relations import files, table
from tessera.streaming.stateful import shared_folder


def _links(spark, d):
    """Each file names another, by the end of its path."""
    other = F.concat(F.lit("./m"), F.col("p_partkey") * 3 % 7, F.when(F.col("p_partkey") % 2 == 0, "/src/").otherwise("/"), F.get(F.array(*[F.lit(x) for x in _NAMES]), (F.col("p_partkey") * 5 % len(_NAMES)).cast("int")))
    return _tree(spark, d, other.alias("link")).select(F.col("path").alias("source"), "link").distinct()


def _resolved(spark, d):
    return L.resolved(_links(spark, d), _tree(spark, d).select("path").distinct())


def link_targets(spark, d):
    return _resolved(spark, d)


def link_layers(spark, d):
    """The files that links lead between, by circle and layer."""
    return L.layers(_resolved(spark, d).select(F.col("source").alias("u"), F.col("target").alias("v")))


def folder_sums(spark, d):
    return L.rolled_up(_tree(spark, d).select("path", F.length("content").alias("size")))


def _code(spark, d):
    """Files of 50 roots: those of even roots are named alike."""
    k = F.col("p_partkey")
    odd = F.get(F.array(*[F.lit(x) for x in _CODE_NAMES]), (k % len(_CODE_NAMES)).cast("int"))
    name = F.when((F.col("p_size") % 2 == 0) & (k % 5 != 0), F.concat(F.lit("part_"), k, F.lit(".py"))).otherwise(odd)
    folder = F.get(F.array(*[F.lit(x) for x in _CODE_FOLDERS]), (F.floor(k / 7) % len(_CODE_FOLDERS)).cast("int"))
    link = F.when(k % 6 == 0, F.lit("./x")).when(k % 6 == 1, F.lit("lib/index")).otherwise("os/none")
    rows = table(spark, d, "part").select(F.concat(F.lit("r"), "p_size").alias("root"), F.concat(folder, name).alias("path"), F.concat(F.lit("import '"), link, F.lit("'\n")).alias("content"))
    return rows.groupBy("root", "path").agg(F.min("content").alias("content"))


def root_signals(spark, d):
    return L.signals(_code(spark, d))


def root_scores(spark, d):
    return L.project_scores(_code(spark, d)).select("root", "score", "band", "is_code")


def chunks_replaced(spark, d):
    """Chunks of all documents' texts, after a first batch, a second one of what changed, came and went, and the second once more."""
    f, id = files(spark, d).select("id", "content"), F.col("id")
    t = R.Table(spark, shared_folder(spark, "chunks"), R.CHUNK, "document", 16)
    t.replace(R.cloud_chunks(f.where(id % 3 != 0)), 1)
    new = f.where((id % 3 == 0) | (id % 5 == 0)).withColumn("content", F.when(id % 5 == 0, F.concat(F.lit("new "), "content")).otherwise(F.col("content")))
    gone = f.where(id % 7 == 0).select(id.alias("document"))
    for _ in range(2):
        t.replace(R.cloud_chunks(new.where(id % 7 != 0)), 2, gone)
    return t.rows().select("document", "chunk_index", "start_offset", "end_offset", F.md5("chunk_text").alias("md5"))


def run_counts(spark, d):
    """What a run over the documents came to, counted as it was written; and what a second one may skip."""
    f, id = files(spark, d), F.col("id")
    status = F.when(id % 10 == 0, "failed").when(id % 10 == 1, "skipped_unsupported").when(id % 10 < 4, "skipped_unchanged").otherwise("indexed")
    log = RunLog(spark, shared_folder(spark, "log"))
    log.record(1, "/", 0, 1, f.select("path", F.lit("text").alias("modality"), "mtime", status.alias("status"), F.lit(None).cast("string").alias("reason"), F.when(id % 10 == 0, "io").alias("error")))
    done = log.completed().count()
    return log.runs().select("status", "total", "processed", F.explode("counts").alias("kind", "n"), F.lit(done).cast("long").alias("done"))


_CODE_NAMES = ["test_a.py", "b_test.py", "plain.go", "x.spec.ts", "index.js", "HEAD", "README.md", "HISTORY.md", "camelName.ts", "kebab-name.rb", "package.json", "tsconfig.json"]
_CODE_FOLDERS = ["", "src/", "node_modules/z/", "lib/core/"]
QUERIES = {f.__name__: f for f in (link_targets, link_layers, folder_sums, root_signals, root_scores, chunks_replaced, run_counts)}

_PATH = _TREE.split("select distinct ")[1].split(" path from part")[0]
_RESOLVED = f"""{_TREE}, k as (select distinct t.path source, './m' || p_partkey * 3 % 7 || case when p_partkey % 2 = 0 then '/src/' else '/' end || {_NAMES}[p_partkey * 5 % {len(_NAMES)} + 1] link from part join t on t.path = {_PATH}),
 tp as (select path, string_split(path, '/') p from t), ks as (select source, link, string_split(replace(link, './', ''), '/') p from k), n(n) as (values (1), (2), (3), (4)),
 te as (select path, len(p) - n + 1 a, n.n, array_to_string(p[len(p) - n + 1:], '/') e from tp, n where n <= len(p)), ke as (select source, link, n.n, array_to_string(p[len(p) - n + 1:], '/') e from ks, n where n <= len(p)),
 m as (select source, link, path, row_number() over (partition by source, link order by ke.n desc, length(path), path) r from ke join te on te.e = ke.e), res as (select source, link, path target from m where r = 1)"""
_SIGNALS = f"""c0 as (select 'r' || p_size root, {_CODE_FOLDERS}[(p_partkey // 7) % {len(_CODE_FOLDERS)} + 1] f, case when p_size % 2 = 0 and p_partkey % 5 <> 0 then 'part_' || p_partkey || '.py' else {_CODE_NAMES}[p_partkey % {len(_CODE_NAMES)} + 1] end nm, case p_partkey % 6 when 0 then './x' when 1 then 'lib/index' else 'os/none' end link from part), c as (select root, f, nm, min(link) link from c0 group by all),
 c2 as (select *, f || nm path, regexp_replace(nm, '\\.[^.]*$', '') stem, f = 'node_modules/z/' noise from c), own as (select * from c2 where not noise),
 st as (select root, case when regexp_full_match(stem, '[a-z0-9]+(_[a-z0-9]+)+') then 'snake' when regexp_full_match(stem, '[a-z0-9]+(-[a-z0-9]+)+') then 'kebab' when regexp_full_match(stem, '[a-z]+([A-Z][a-z0-9]*)+') then 'camel' else 'other' end style, count(*) n from own group by all),
 mn as (select root, arg_max(style, n * 10 + case style when 'snake' then 3 when 'kebab' then 2 when 'camel' then 1 else 0 end) style, max(n) n from st group by root),
 ct as (select root, count(*) files, count(*) filter (regexp_matches(lower(nm), '^test_|_test\\.py$|\\.test\\.|\\.spec\\.')) n_tests, bool_or(f = '' and nm in ('README.md', 'HISTORY.md')) rd from own group by root),
 bs as (select distinct root, lower(stem) b from own), cd as (select *, row_number() over (partition by root order by path) r from own where regexp_matches(nm, '\\.(py|ts|go|js|rb)$')),
 lk as (select root, least(10, count(*)) n_links from cd where r <= 300 and (link = './x' or (root, regexp_replace(link, '.*/', '')) in (select (root, b) from bs)) group by root),
 fo as (select distinct root, true g from c2 where noise), al as (select distinct root from c2),
 sg as (select root, coalesce(files, 0) files, coalesce(n_tests, 0) n_tests, coalesce(n_links, 0) n_links, style, round(n / files::double, 6) share, coalesce(n_tests > 0, false) test_files, coalesce(n_links > 0, false) inter_file_imports, coalesce(rd, false) readme_or_changelog, coalesce(files >= 8 and style <> 'other' and n / files::double >= 0.65, false) consistent_naming, coalesce(g, false) generated_or_dependency_dirs from al left join ct using(root) left join mn using(root) left join lk using(root) left join fo using(root))"""
SQL = {
    "link_targets": f"with {_RESOLVED} select * from res",
    "link_layers": f"""with recursive {_RESOLVED}, e as (select distinct source u, target v from res where source <> target), nodes as (select source x from res where source <> target union select target from res where source <> target), reach(a, b) as (select u, v from e union select a, v from reach join e on u = b),
 comp as (select x node, least(x, coalesce(min(r.b), x)) component from nodes left join (select r1.a, r1.b from reach r1 join reach r2 on r1.a = r2.b and r1.b = r2.a) r on r.a = x group by x),
 ce as (select distinct cu.component u, cv.component v from e join comp cu on cu.node = u join comp cv on cv.node = v where cu.component <> cv.component), up(c, d) as (select distinct component, 0 from comp union select u, d + 1 from up join ce on v = c), ly as (select c, max(d) d from up group by c)
 select node, component, d as layer from comp join ly on c = component""",
    "folder_sums": f"with {_TREE}, s as (select path, length(concat_ws(chr(10), p_name, p_brand)) z from part join t on t.path = {_PATH}), a as (select unnest([array_to_string(string_split(path, '/')[1:i], '/') for i in range(1, len(string_split(path, '/')))]) folder, z from s) select folder, count(*) files, sum(z)::bigint bytes from a group by folder",
    "root_signals": f"with {_SIGNALS} select * from sg",
    "root_scores": f"with {_SIGNALS}, mk as (select root, bool_or(f = '' and nm = 'package.json') lm, bool_or(f = '' and nm = 'tsconfig.json') fc from c2 group by root), sc as (select root, (30 * lm::int + 20 * fc::int + 15 * test_files::int + 15 * inter_file_imports::int + 10 * readme_or_changelog::int + 10 * consistent_naming::int + 10 * generated_or_dependency_dirs::int)::int score from sg join mk using(root)) select root, score, case when score >= 40 then 'high' when score >= 20 then 'medium' else 'low' end band, score >= 40 is_code from sc",
    "chunks_replaced": rf"""with {FILES}, f as (select id, case when id % 5 = 0 then 'new ' || content else content end content from files where id % 7 <> 0 union all select id, content from files where id % 7 = 0 and false),
 cfg as (select id, content, length(content) n from f), raw as (select id, content, n, unnest(range(0, greatest(0, cast(ceil((n-900)/780.0) as bigint))+1)) k from cfg where n > 0), cut as (select id, k*780 s, least(k*780+900, n) e, regexp_replace(substr(content, k*780+1, 900), '^\s+|\s+$', '', 'g') txt from raw)
 select id document, row_number() over (partition by id order by s) - 1 chunk_index, s start_offset, e end_offset, md5(txt) md5 from cut where txt <> ''""",
    "run_counts": "with s as (select case when doc_id % 10 = 0 then 'failed' when doc_id % 10 = 1 then 'skipped_unsupported' when doc_id % 10 < 4 then 'skipped_unchanged' else 'indexed' end s from documents) select 'completed_with_errors' status, (select count(*) from s) total, (select count(*) from s where s <> 'failed') processed, k.kind, (select count(*) from s where s = kind) n, (select count(*) from s where s <> 'failed') done from (values ('indexed'), ('skipped_unchanged'), ('skipped_unsupported'), ('purged'), ('failed')) k(kind)",
}
