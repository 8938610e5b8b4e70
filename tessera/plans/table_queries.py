"""Maintenance, analytics, evaluation and vector queries, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import evaluation as E
from tessera.operators import maintenance as M
from tessera.operators import retrieval as R
from tessera.operators import vectors as V
from tessera.plans.text_queries import _BM25, _CHUNKS, FILES, QS
from tessera.sources.relations import files, qrels, queries, table

_VEC = "v as (select vec_id id, embedding e, label from embeddings)"
_QREL = "qrels as (select item_id qid, doc_id id, 1 rel from benchmark b join documents d on contains(d.text, b.text))"
_METRICS = f"""{_BM25}, {_QREL}, run as (select qid, id, rank from ranked where rank <= 10),
 good as (select qid, id, rel, row_number() over (partition by qid order by rel desc, id) r from qrels), ideal as (select qid, sum(case when r <= 10 then (pow(2.0, rel)-1)/log2(r+1) end) idcg, count(*) n from good group by qid),
 hit as (select *, count(*) over (partition by qid order by rank) hits from run join qrels using(qid, id)), got as (select qid, sum((pow(2.0, rel)-1)/log2(rank+1)) dcg, sum(hits/rank) ps, count(*) found, min(rank) f from hit group by qid),
 m as (select qid, coalesce(dcg/idcg, 0) ndcg, coalesce(ps/least(n, 10), 0) ap, coalesce(found/n, 0) recall, coalesce(found/10.0, 0)::double "precision", coalesce(1/f, 0) mrr from ideal left join got using(qid))"""


def _vec(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def _q_vec(spark, d):
    return table(spark, d, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))


def knn_cosine(spark, d):
    q = _q_vec(spark, d)
    return V.nearest(_vec(spark, d), q, 5, "cosine", q.count()).withColumn("score", F.round("score", 6))


def knn_angular(spark, d):
    q = _q_vec(spark, d)
    return V.nearest(_vec(spark, d), q, 5, "angular", q.count()).withColumn("score", F.round("score", 4))


def knn_l2(spark, d):
    q = _q_vec(spark, d)
    return V.nearest(_vec(spark, d), q, 5, "l2", q.count()).withColumn("score", F.round("score", 4) + 0.0)


def hash_embed_blake2b(spark, d):
    v = files(spark, d).select("id", V.hash_embed(T.tokens(F.col("content"))).alias("v"))
    return v.select("id", F.round(F.array_max("v"), 6).alias("most"), F.round(V.dot(F.col("v"), F.col("v")), 6).alias("norm"))


def greedy_dedup(spark, d):
    f = _vec(spark, d).select("id", F.col("label").alias("video_id"), F.col("id").alias("ts"), "embedding")
    return V.greedy_distinct(f, 0.5)


def run_metrics(spark, d):
    q = queries(spark, d)
    return E.means(E.per_query(R.bm25(files(spark, d), q, 10, prefix=False, n_queries=q.count()), qrels(spark, d)))


def ndcg(spark, d):
    q = queries(spark, d)
    m = E.per_query(R.bm25(files(spark, d), q, 10, prefix=False, n_queries=q.count()), qrels(spark, d))
    return m.select("qid", *[F.round(c, 6).alias(c) for c in ("ndcg", "ap", "recall", "precision", "mrr")])


def _tokens(spark, d):
    q, f = queries(spark, d), files(spark, d)
    hits = R.bm25(f, q, 5, prefix=False, n_queries=q.count()).select("qid", "id")
    return E.token_counts(hits, qrels(spark, d), f, R.best_chunks(hits, f, q))


def token_reduction(spark, d):
    """Tokens of the relevant texts, of those found, and of the best chunks of these."""
    return _tokens(spark, d).withColumns({c: F.round(c, 4) for c in ("vs_oracle", "vs_full")})


def token_summary(spark, d):
    out = E.token_summary(_tokens(spark, d))
    return out.select("queries", "oracle_total", "full_total", "chunk_total", *[F.round(c, 4).alias(c) for c in out.columns if "mean" in c or "overall" in c])


def _two(spark, d):
    f = files(spark, d).select("path", "filename", "category", "mtime", F.md5("content").alias("h"))
    new = f.where("length(filename) % 2 = 0").withColumn("mtime", F.col("mtime") + F.when(F.col("h") < "8", 10).otherwise(0)).withColumn("h", F.concat(F.lit("n"), "h"))
    return f.where("h < 'c'"), new


_TWO = f"with {FILES}, f as (select path, filename, category, mtime, md5(content) h from files), old as (select * from f where h < 'c'), nw as (select path, filename, category, mtime + case when h < '8' then 10 else 0 end mtime, 'n'||h h from f where length(filename) % 2 = 0)"


def upsert_newest(spark, d):
    return M.upsert_newest(*_two(spark, d)).select("path", "mtime", "h")


def unchanged_skip(spark, d):
    return M.changed(*_two(spark, d)).select("path", "mtime")


def stale_rows(spark, d):
    old, new = _two(spark, d)
    return old.join(new.select("path"), "path", "left_anti").select("path")


def resume_semi(spark, d):
    old, new = _two(spark, d)
    return new.join(old.select("path", "mtime"), ["path", "mtime"], "left_semi").select("path")


def prefix_delete(spark, d):
    return M.delete_prefix(files(spark, d), "/src1").groupBy("category").agg(F.count("*").alias("n"))


def content_hash_sync(spark, d):
    p = table(spark, d, "pages").select(F.col("page_id").cast("string").alias("uri"), F.col("html").alias("body"), F.lit("a").alias("updated_at"), "page_id")
    new = p.where("page_id % 5 <> 0").withColumn("body", F.when(F.col("page_id") % 3 == 0, F.concat("body", F.lit("x"))).otherwise(F.col("body")))
    return M.content_sync(p.where("page_id % 7 <> 0"), new)


def _manifest(spark, d):
    o = table(spark, d, "orders")
    state = F.when(F.col("o_orderstatus") == "O", "QUEUED").when(F.col("o_orderstatus") == "F", "FETCHED").otherwise("FAILED")
    return o.select(F.col("o_orderkey").cast("string").alias("path"), F.floor("o_totalprice").alias("size"), F.col("o_orderpriority").alias("modified"), state.alias("state"))


_MAN = "m as (select o_orderkey::varchar path, floor(o_totalprice)::bigint size, o_orderpriority modified, case o_orderstatus when 'O' then 'QUEUED' when 'F' then 'FETCHED' else 'FAILED' end state from orders)"


def manifest_queue(spark, d):
    return M.claim(_manifest(spark, d), 4)


def manifest_requeue(spark, d):
    m = _manifest(spark, d)
    listing = m.select("path", F.when(F.col("size") % 2 == 0, F.col("size") + 1).otherwise(F.col("size")).alias("size"), "modified")
    return M.requeue(m, listing)


def manifest_counts(spark, d):
    s = ["QUEUED", "FETCHING", "FETCHED", "FAILED"]
    return _manifest(spark, d).agg(*[F.count_if(F.col("state") == x).alias(x.lower()) for x in s], F.count("*").alias("total"))


def state_guard(spark, d):
    m = _manifest(spark, d)
    return M.guard(m.select("path", F.col("state").alias("before"), F.when(F.col("size") % 2 == 0, "QUEUED").otherwise("FETCHING").alias("after")))


def buffer_assemble(spark, d):
    a = M.assemble(table(spark, d, "conversations"), "conv_id", "turn", "text", "\n")
    return a.select("conv_id", F.md5("text").alias("text_md5"))


def hit_counter(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("query"), F.concat(F.lit("u"), "user_id").alias("source_path"), "ts")
    return M.hit_counts(e.withColumn("query", F.floor(F.col("query") / 3))).select("source_path", "hit_count", F.date_format("last_seen", "yyyy-MM-dd HH:mm:ss").alias("last_seen"))


def top_searched(spark, d):
    return hit_counter(spark, d).orderBy(F.col("hit_count").desc(), F.col("last_seen").desc(), "source_path").limit(20)


def recent_sync(spark, d):
    e = table(spark, d, "events")
    last = e.groupBy("user_id").agg(F.max(F.struct("ts", "event_id")).alias("l"))
    return last.orderBy(F.col("l").desc()).limit(5).select("user_id", F.col("l.event_id").alias("event_id"))


def daily_trend(spark, d):
    """Events, users and value a day, days without events as 0."""
    e = table(spark, d, "events").withColumn("day", F.to_date("ts"))
    days = e.agg(F.explode(F.sequence(F.min("day"), F.max("day"))).alias("day"))
    g = e.groupBy("day").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("value"))
    return days.join(g, "day", "left").select(F.col("day").cast("string").alias("day"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("value", F.lit(0.0)).alias("value"))


def day_delta(spark, d):
    t = daily_trend(spark, d)
    return t.select("day", "n", (F.col("n") - F.lag("n").over(Window.orderBy("day"))).alias("delta"), F.round(F.col("n") / F.max("n").over(Window.partitionBy(F.lit(1))), 6).alias("ratio"))


def dir_stats(spark, d):
    """Files by top folder, with the folder's most frequent second level, ties by name."""
    f = files(spark, d).select(F.split("path", "/")[1].alias("top"), F.split("path", "/")[2].alias("sub"))
    g = f.groupBy("top", "sub").agg(F.count("*").alias("n"))
    best = g.groupBy("top").agg(F.sum("n").alias("file_count"), F.min(F.struct(-F.col("n"), "sub")).alias("b"))
    return best.select("top", "file_count", F.col("b.sub").alias("dominant"))


def lang_dist(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


def state_pivot(spark, d):
    return table(spark, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1))).na.fill(0)


def kpi_snapshot(spark, d):
    x = table(spark, d, "documents").agg(F.sum(F.octet_length("text")).alias("b"), F.count("*").alias("files"))
    naive, short = F.floor(F.col("b") / 4), F.floor(F.col("b") / 8)
    cut = F.round((1 - short / naive) * 100, 4)
    return x.select("files", naive.alias("naive"), short.alias("optimised"), cut.alias("reduction"), F.when(cut >= 55, "good").when(cut >= 25, "warn").otherwise("critical").alias("health"))


def modality_classify(spark, d):
    kinds = ["txt", "png", "mp4", "mp3", "bin"]
    n = F.element_at(F.array(*[F.lit(k) for k in kinds]), (F.col("p_partkey") % 5 + 1).cast("int"))
    p = table(spark, d, "part").select(F.concat(F.lit("/p/"), F.col("p_partkey").cast("string"), F.lit("."), n).alias("path"))
    return p.groupBy(T.modality(F.col("path")).alias("modality")).agg(F.count("*").alias("n"))


_NAMES = [f"x.{s}" for s in (*T.LANGUAGES, "zzz", "PY", "html")] + ["Dockerfile", "MAKEFILE", "CMakeLists.txt"]


def language_map(spark, d):
    n = F.element_at(F.array(*[F.lit(k) for k in _NAMES]), (F.col("p_partkey") % len(_NAMES) + 1).cast("int"))
    p = table(spark, d, "part").select(F.concat(F.lit("/p/"), n).alias("path"))
    return p.groupBy(T.language(F.col("path")).alias("language")).agg(F.count("*").alias("n"))


def name_style(spark, d):
    p = table(spark, d, "part").select(F.explode(F.array("p_name", F.replace("p_name", F.lit(" "), F.lit("_")), F.replace("p_name", F.lit(" "), F.lit("-")))).alias("name"))
    return p.groupBy(T.name_style(F.col("name")).alias("style")).agg(F.count("*").alias("n"))


def json_props(spark, d):
    e = table(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    return e.groupBy("event_type").agg(F.sum(k).alias("k"), F.count("*").alias("n"))


def paging(spark, d):
    return table(spark, d, "orders").orderBy(F.col("o_totalprice").desc(), "o_orderkey").offset(40).limit(20).select("o_orderkey", "o_totalprice")


def correlated_count(spark, d):
    for n in ("customer", "orders"):
        table(spark, d, n).createOrReplaceTempView(f"tq_{n}")
    return spark.sql("select c_custkey, (select count(*) from tq_orders o where o.o_custkey = c.c_custkey) as n from tq_customer c")


def left_distinct(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left").select("c_custkey", "o_orderpriority").distinct()


def three_way_join(spark, d):
    n, s, li = table(spark, d, "nation"), table(spark, d, "supplier"), table(spark, d, "lineitem")
    j = li.join(s, li["l_suppkey"] == s["s_suppkey"]).join(n, s["s_nationkey"] == n["n_nationkey"])
    return j.groupBy("n_name").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


def budget_sessions(spark, d):
    """Calls left of 4 for each user; the count starts again when the kind of event changes."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").withColumn("changed", F.coalesce((F.col("event_type") != F.lag("event_type").over(w)).cast("int"), F.lit(1)))
    e = e.withColumn("run", F.sum("changed").over(w))
    n = F.row_number().over(Window.partitionBy("user_id", "run").orderBy("ts", "event_id"))
    return e.select("event_id", F.greatest(F.lit(0), 4 - n).alias("left"), (n <= 4).alias("allowed"))


def tombstones(spark, d):
    s = content_hash_sync(spark, d)
    return s.select("uri", F.when(F.col("change") == "deleted", "deleted").otherwise("active").alias("status"))


NAMES = """knn_cosine knn_angular knn_l2 hash_embed_blake2b greedy_dedup run_metrics ndcg token_reduction token_summary upsert_newest unchanged_skip stale_rows resume_semi prefix_delete content_hash_sync
 manifest_queue manifest_requeue manifest_counts state_guard buffer_assemble hit_counter top_searched recent_sync daily_trend day_delta dir_stats lang_dist state_pivot kpi_snapshot modality_classify language_map
 name_style json_props paging correlated_count left_distinct three_way_join budget_sessions tombstones"""
QUERIES = {n: globals()[n] for n in NAMES.split()}


def _knn(score: str, places: int) -> str:
    return f"with {_VEC}, s as (select q.id qid, v.id, round({score}, 9) score from v, v q where q.id % 20 = 0), r as (select *, row_number() over (partition by qid order by score desc, id) rank from s) select qid, id, round(score, {places}) score, rank from r where rank <= 5"


_COS = "list_cosine_similarity(v.e::double[], q.e::double[])"
_SYNC = """o as (select page_id::varchar k, html body from pages where page_id % 7 <> 0), n as (select page_id::varchar uri, case when page_id % 3 = 0 then html||'x' else html end body from pages where page_id % 5 <> 0),
 s as (select coalesce(uri, k) uri, case when k is null then 'inserted' when uri is null then 'deleted' when n.body = o.body then 'unchanged' else 'updated' end change from n full join o on uri = k)"""
_HITS = "h as (select source_path, count(*) hit_count, strftime(max(ts), '%Y-%m-%d %H:%M:%S') last_seen, max(ts) mt from (select event_id // 3 q, 'u'||user_id source_path, max(ts) ts from events group by all) group by source_path)"
_DAYS = "t as (select strftime(day, '%Y-%m-%d') as day, coalesce(n, 0) n, coalesce(value, 0) as value from (select unnest(generate_series(min(ts::date)::timestamp, max(ts::date)::timestamp, interval 1 day)) as day from events) left join (select ts::date as day, count(*) n, round(sum(value), 2) as value from events group by all) using(day))"
_COUNT = r"greatest(1, round_even(len(regexp_extract_all(content, '\S+')) * 1.35::double, 0)::bigint)"
_TOKENS = f"""{_BM25}, {_QREL}, hits as (select qid, id from ranked where rank <= 5), {_CHUNKS}, ct as (select qid, sum(tokens)::bigint t from best where n = 1 group by qid), ft as (select qid, sum({_COUNT})::bigint t from hits join files using(id) group by qid), ot as (select qid, sum({_COUNT})::bigint t from qrels join files using(id) group by qid),
 tq as (select distinct qid from hits), tn as (select qid, coalesce(ot.t, 0) oracle_tokens, coalesce(ft.t, 0) full_tokens, coalesce(ct.t, 0) chunk_tokens from tq left join ot using(qid) left join ft using(qid) left join ct using(qid)),
 tc as (select *, case when oracle_tokens > 0 then (1 - chunk_tokens / oracle_tokens::double) * 100 else 0 end vs_oracle, case when full_tokens > 0 then (1 - chunk_tokens / full_tokens::double) * 100 else 0 end vs_full from tn)"""
SQL = {
    "knn_cosine": _knn(_COS, 6),
    "knn_angular": _knn(f"greatest(0, 1 - sqrt(greatest(0, 2*(1-{_COS})))/2)", 4),
    "knn_l2": _knn("-list_distance(v.e::double[], q.e::double[])", 4).replace("round(score, 4) score, rank", "round(score, 4) + 0.0 score, rank"),
    "token_reduction": f"{_TOKENS} select qid, oracle_tokens, full_tokens, chunk_tokens, round(vs_oracle, 4) vs_oracle, round(vs_full, 4) vs_full from tc",
    "token_summary": f"{_TOKENS} select count(*) queries, sum(oracle_tokens)::bigint oracle_total, sum(full_tokens)::bigint full_total, sum(chunk_tokens)::bigint chunk_total, round(avg(oracle_tokens), 4) oracle_mean, round(avg(full_tokens), 4) full_mean, round(avg(chunk_tokens), 4) chunk_mean, round(avg(vs_oracle), 4) mean_vs_oracle, round(avg(vs_full), 4) mean_vs_full, round((1 - sum(chunk_tokens) / sum(oracle_tokens)) * 100, 4) overall_vs_oracle, round((1 - sum(chunk_tokens) / sum(full_tokens)) * 100, 4) overall_vs_full from tc",
    "run_metrics": f'{_METRICS} select count(*) queries, count(*) filter(recall > 0) queries_with_hits, round(avg(ndcg), 6) ndcg, round(avg(ap), 6) ap, round(avg(recall), 6) recall, round(avg("precision"), 6) "precision", round(avg(mrr), 6) mrr from m',
    "ndcg": f'{_METRICS} select qid, round(ndcg, 6) ndcg, round(ap, 6) ap, round(recall, 6) recall, round("precision", 6) "precision", round(mrr, 6) mrr from m',
    "upsert_newest": f"{_TWO} select path, mtime, h from (select *, row_number() over (partition by path order by mtime desc, p) r from (select *, 0 p from old union all select *, 1 p from nw)) where r = 1",
    "unchanged_skip": f"{_TWO} select path, mtime from nw where not exists (select 1 from old where old.path = nw.path and abs(old.mtime - nw.mtime) < 0.001)",
    "stale_rows": f"{_TWO} select path from old where path not in (select path from nw)",
    "resume_semi": f"{_TWO} select path from nw where (path, mtime) in (select path, mtime from old)",
    "prefix_delete": f"with {FILES} select category, count(*) n from files where not starts_with(path, '/src1/') group by all",
    "content_hash_sync": f"with {_SYNC} select uri, change from s",
    "tombstones": f"with {_SYNC} select uri, case change when 'deleted' then 'deleted' else 'active' end status from s",
    "manifest_queue": f"with {_MAN}, q as (select path, row_number() over (order by coalesce(size, 0), path) place from m where state = 'QUEUED') select path, place, (place-1) % 4 worker from q",
    "manifest_requeue": f"with {_MAN} select path, case when size % 2 = 0 then size+1 else size end size, modified, case when size % 2 <> 0 and state = 'FETCHED' then 'FETCHED' else 'QUEUED' end state from m",
    "manifest_counts": f"with {_MAN} select count(*) filter(state='QUEUED') queued, count(*) filter(state='FETCHING') fetching, count(*) filter(state='FETCHED') fetched, count(*) filter(state='FAILED') failed, count(*) total from m",
    "state_guard": f"with {_MAN}, c as (select path, state before, case when size % 2 = 0 then 'QUEUED' else 'FETCHING' end \"after\" from m) select *, (before, \"after\") in (('QUEUED','FETCHING'),('FETCHING','FETCHED'),('FETCHING','FAILED'),('FETCHED','QUEUED'),('FAILED','QUEUED')) allowed from c",
    "buffer_assemble": "select conv_id, md5(string_agg(text, chr(10) order by turn)) text_md5 from conversations group by all",
    "hit_counter": f"with {_HITS} select source_path, hit_count, last_seen from h",
    "top_searched": f"with {_HITS} select source_path, hit_count, last_seen from h order by hit_count desc, mt desc, source_path limit 20",
    "recent_sync": "select user_id, event_id from (select user_id, event_id, ts, row_number() over (partition by user_id order by ts desc, event_id desc) r from events) where r = 1 order by ts desc, event_id desc limit 5",
    "daily_trend": f"with {_DAYS} select * from t",
    "day_delta": f"with {_DAYS} select day, n, n - lag(n) over (order by day) delta, round(n / max(n) over (), 6) ratio from t",
    "dir_stats": "with g as (select source top, lang sub, count(*) n from documents group by all) select top, sum(n)::bigint file_count, (array_agg(sub order by n desc, sub))[1] dominant from g group by top",
    "lang_dist": "select lang, count(*) n, sum(n_chars)::bigint chars from documents group by all",
    "state_pivot": "select o_orderpriority, count(*) filter(o_orderstatus='F') \"F\", count(*) filter(o_orderstatus='O') \"O\", count(*) filter(o_orderstatus='P') \"P\" from orders group by all",
    "kpi_snapshot": "with x as (select sum(octet_length(encode(text)))::bigint b, count(*) files from documents), y as (select files, b//4 naive, b//8 optimised, round((1-(b//8)/(b//4))*100, 4) reduction from x) select *, case when reduction >= 55 then 'good' when reduction >= 25 then 'warn' else 'critical' end health from y",
    "modality_classify": "select ['text','image','video','audio','unknown'][p_partkey%5+1] modality, count(*) n from part group by all",
    "language_map": f"with m as (select unnest({list(T.LANGUAGES)}) s, unnest({list(T.LANGUAGES.values())}) g), p as (select lower({_NAMES}[p_partkey%{len(_NAMES)}+1]) nm from part) select case nm when 'dockerfile' then 'dockerfile' when 'makefile' then 'make' when 'cmakelists.txt' then 'cmake' else coalesce(g, 'unknown') end as language, count(*) n from p left join m on nm = 'x.'||s group by all",
    "name_style": "with p as (select unnest([p_name, replace(p_name,' ','_'), replace(p_name,' ','-')]) name from part) select case when regexp_full_match(name, '[a-z0-9]+(_[a-z0-9]+)+') then 'snake' when regexp_full_match(name, '[a-z0-9]+(-[a-z0-9]+)+') then 'kebab' when regexp_full_match(name, '[a-z][a-z0-9]*([A-Z][a-z0-9]*)+') then 'camel' else 'other' end style, count(*) n from p group by all",
    "json_props": "select event_type, sum((props->>'$.k')::bigint)::bigint k, count(*) n from events group by all",
    "paging": "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 20 offset 40",
    "correlated_count": "select c_custkey, (select count(*) from orders where o_custkey = c_custkey) n from customer",
    "left_distinct": "select distinct c_custkey, o_orderpriority from customer left join orders on c_custkey = o_custkey",
    "three_way_join": "select n_name, count(*) n, round(sum(l_quantity), 2) quantity from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey group by all",
    "budget_sessions": "with a as (select *, coalesce((event_type <> lag(event_type) over w)::int, 1) c from events window w as (partition by user_id order by ts, event_id)), b as (select *, sum(c) over (partition by user_id order by ts, event_id) run from a), r as (select event_id, row_number() over (partition by user_id, run order by ts, event_id) n from b) select event_id, greatest(0, 4-n) \"left\", n <= 4 allowed from r",
}
