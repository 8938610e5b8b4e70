"""Queries without SQL, each held against brute force in the tests, or with SQL where it fits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import code, fuzzy
from tessera.operators import retrieval as R
from tessera.sources.extract import html_text as page_text
from tessera.sources.relations import files, queries, table
from tessera.streaming import stateful



def code_files(spark, d):
    """A source file or manifest for each part, by its number in turn: (path, content)."""
    p = table(spark, d, "part")
    key, size, brand = F.col("p_partkey").cast("string"), F.col("p_size").cast("string"), F.regexp_replace(F.lower("p_brand"), "[^a-z0-9]", "")
    text = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    kinds = [
        ("m", ".py", text("import os.path\nfrom .", brand, " import x\n\n\nclass C", key, ":\n    def f", size, "(self):\n        def g():\n            pass\n")),
        ("m", ".ts", text("import { x } from './", brand, "'\nconst y = require('lib", size, "/y')\n\nexport class B", key, " {}\nexport async function no() {}\n\nfunction go", size, "(a, b) {}\n")),
        ("m", ".rs", text("use crate::", brand, ";\nuse serde::de;\npub struct S", key, ";\nimpl S", key, " {\n    pub fn run", size, "() {}\n}\nenum E { A }\n")),
        ("broken", ".py", text("def f", key, "(:\n")),
        ("", "/package.json", text('{"dependencies": {"x', size, '": "^', key, '.0"}, "devDependencies": {"y": "2"}}')),
        ("", "/pyproject.toml", text('[project]\ndependencies = ["numpy>=', size, '", "', brand, '"]\n')),
        ("", "/Cargo.toml", text('[dependencies]\nserde = "', key, '"\ntokio = { version = "', size, '" }\n')),
        ("", "/go.mod", text("module m\nrequire (\n\tgithub.com/a/", brand, " v1.", size, ".3\n)\n")),
    ]
    path, content = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, (name, suffix, body) in enumerate(kinds):
        mine = F.col("p_partkey") % len(kinds) == i
        path, content = F.when(mine, F.concat(F.lit("r"), size, F.lit("/" + name), key, F.lit(suffix))).otherwise(path), F.when(mine, body).otherwise(content)
    return p.select(path.alias("path"), content.alias("content"))


def code_symbols(spark, d):
    return code.symbols(code_files(spark, d))


def manifest_deps(spark, d):
    return code.dependencies(code_files(spark, d))


def code_lexical_score(spark, d):
    q = queries(spark, d)
    return R.top(code.lexical_scores(files(spark, d), q, q.count()).withColumn("score", F.round("score", 6)), 5)


def fuzzy_partial_ratio(spark, d):
    """Best file name for each query word of four letters or more, from 70 up."""
    q = queries(spark, d).select(F.explode(T.tokens(F.col("query"))).alias("word")).where(F.length("word") >= 4).distinct()
    f = files(spark, d).select(F.lower("filename").alias("name"))
    return fuzzy.near_names(q, f, R.NEAR_NAME).groupBy(F.col("word").alias("query")).agg(F.round(F.max("score"), 6).alias("best"))


def fuzzy_part_names(spark, d):
    """Words of the parts' names that are near the name of a brand or a type, and how near."""
    p = table(spark, d, "part")
    words = p.select(F.explode(T.tokens(F.col("p_name"))).alias("word"))
    names = p.select(F.lower("p_type").alias("name")).unionByName(p.select(F.lower("p_brand").alias("name")))
    return fuzzy.near_names(words, names, R.NEAR_NAME).select("word", "name", F.round("score", 6).alias("score"))


def html_text(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(page_text(F.col("html"))).alias("text_md5"))


def debounce(spark, d):
    e = table(spark, d, "events").select(F.concat_ws("/", "user_id", "event_type").alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("us"))
    return stateful.debounce(e.select("key", (F.col("us") / 1e6).alias("ts")), 3600.0)


def _stream(spark, d):
    e = table(spark, d, "events")
    return spark.readStream.schema(e.schema).option("pathGlobFilter", "events*.parquet").parquet(d).withColumn("source_path", F.concat(F.lit("u"), "user_id"))


def stream_hits(spark, d):
    return stateful.drained(stateful.hits_stream(_stream(spark, d)), "hits", "complete").select("source_path", "hit_count", F.date_format("last_seen", "yyyy-MM-dd HH:mm:ss").alias("last_seen"))


def stream_trend(spark, d):
    """Each day's last state, open days too."""
    days = stateful.drained(stateful.trend_stream(_stream(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))), "trend", "update", ["day"])
    return days.select(F.col("day").cast("string").alias("day"), "n", F.round("value", 2).alias("value"))


QUERIES = {f.__name__: f for f in (code_symbols, manifest_deps, code_lexical_score, fuzzy_partial_ratio, fuzzy_part_names, html_text, debounce, stream_hits, stream_trend)}
_PART = "p as (select p_partkey k, p_size z, regexp_replace(lower(p_brand), '[^a-z0-9]', '', 'g') b, 'r' || p_size || '/' r from part)"
FACTS = f"""{_PART}, s as (select r || 'm' || k || '.py' path, unnest([('class', 'C' || k, 5), ('function', 'f' || z, 6), ('function', 'g', 7), ('import', 'os', 1), ('internal', b, 2)]) f from p where k % 8 = 0
 union all select r || 'm' || k || '.ts', unnest([('class', 'B' || k, 3), ('function', 'go' || z, 6), ('internal', './' || b, 1), ('import', 'lib' || z, 2)]) from p where k % 8 = 1
 union all select r || 'm' || k || '.rs', unnest([('function', 'run' || z, 5), ('class', 'S' || k, 3), ('class', 'E', 7), ('internal', 'crate::' || b, 1), ('import', 'serde', 2)]) from p where k % 8 = 2), facts as (select path, f[1] kind, f[2] name, f[3]::int line from s)"""
SQL = {
    "code_symbols": f"with {FACTS} select * from facts",
    "manifest_deps": f"""with {_PART}, s as (select r || k || '/package.json' path, unnest([('x' || z, '^' || k || '.0', 'dependencies'), ('y', '2', 'devDependencies')]) f from p where k % 8 = 4
 union all select r || k || '/pyproject.toml', unnest([('numpy', '>=' || z, 'dependencies'), (b, '', 'dependencies')]) from p where k % 8 = 5 union all select r || k || '/Cargo.toml', unnest([('serde', k::varchar, 'dependencies'), ('tokio', z::varchar, 'dependencies')]) from p where k % 8 = 6
 union all select r || k || '/go.mod', ('github.com/a/' || b, 'v1.' || z || '.3', 'require') from p where k % 8 = 7) select path, f[1] "name", f[2] version, f[3] section from s""",
    "stream_hits": "select 'u'||user_id source_path, count(*) hit_count, strftime(max(ts), '%Y-%m-%d %H:%M:%S') last_seen from events group by all",
    "stream_trend": "select strftime(ts, '%Y-%m-%d') \"day\", count(*) n, round(sum(value), 2) as value from events group by all",
}
