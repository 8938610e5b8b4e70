"""Secret scans with an incremental blob ledger, with DataFrame operations only.

Every version of a text is named by the sha256 of its content: a blob. A ledger holds which (blob, rule, rule version) have been
scanned, and what was found. A scan takes the distinct blobs of its input, scans each only by rules for which the ledger has no
row, and joins findings, old and new, back to every row that holds the blob. Spark has no function for the places of a pattern's
matches, but splitting a text by the pattern gives the pieces between them: a match starts after all pieces and matches before.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut_table, table


@dataclass(frozen=True)
class Rule:
    """Matches of pattern count if the text of ``group`` has at least ``least`` characters. Patterns are Java's, and have no
    choice of where a match ends but the longest, so that splitting and extracting agree."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: In the order in which spans that start together are listed. The first three are the base.
BASE = (
    Rule("assign", 1, r"(?:(?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 1, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}+"),
    Rule("hex", 1, r"[0-9a-f]{24,}+"),
)
RULES = (
    *BASE,
    Rule("private_key", 1, r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("web_token", 1, r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+"),
    Rule("login_url", 1, r"[a-z][a-z0-9+]{1,15}://[^\s/:@]{1,64}:[^\s/:@]{3,64}@"),
)
FINDING = "array<struct<start:long,rank:int,kind:string,end:long>>"


def blob_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def empty_ledger(spark) -> DataFrame:
    return spark.createDataFrame([], f"blob string, rule string, found {FINDING}")


def scan(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """Ledger rows (blob, rule, found) for all blobs of docs and rules without one: what to append to the ledger.

    Null texts are the empty blob. Equal texts are one blob and scanned once, however many rows hold them; the empty table gives no
    rows. Texts of any length are scanned whole. A ledger may hold a row twice; null rules in it count for nothing.
    """
    blobs = docs.select(blob_of(docs[text_col]).alias("blob"), F.coalesce(docs[text_col], F.lit("")).alias("text")).dropDuplicates(["blob"])
    keys = F.array(*[F.lit(r.key) for r in rules])
    if ledger is None:
        todo = blobs.withColumn("todo", keys)
    else:
        known = ledger.where("rule is not null").groupBy("blob").agg(F.collect_set("rule").alias("done"))
        todo = blobs.join(known, "blob", "left").withColumn("todo", F.array_except(keys, F.coalesce("done", F.array().cast("array<string>")))).where(F.size("todo") > 0)
    wanted = [F.array_contains("todo", r.key) for r in rules]
    matches = [F.when(w, F.regexp_extract_all("text", F.lit(r.pattern), F.lit(0))) for w, r in zip(wanted, rules)]
    seen = todo.select("blob", "text", "todo", *[m.alias(f"m{i}") for i, m in enumerate(matches)])

    def row(i: int, r: Rule) -> Column:
        hit = F.size(f"m{i}") > 0
        value = F.when(hit, F.regexp_extract_all("text", F.lit(r.pattern), F.lit(r.group))) if r.group else F.col(f"m{i}")
        pieces = F.when(hit, F.transform(F.split("text", r.pattern, -1), F.length))
        return F.struct(F.lit(r.key).alias("rule"), F.lit(r.kind).alias("kind"), F.lit(i).alias("rank"), F.when(hit, F.arrays_zip(pieces.alias("piece"), F.transform(f"m{i}", F.length).alias("length"), F.transform(value, lambda v: F.length(v) >= r.least).alias("ok"))).alias("m"))

    each = seen.select("blob", F.explode(F.filter(F.array(*[row(i, r) for i, r in enumerate(rules)]), lambda x: x["m"].isNotNull())).alias("r"))
    each = each.select("blob", "r.rule", "r.kind", "r.rank", F.posexplode("r.m").alias("i", "m")).where(F.col("m.length").isNotNull())
    until = Window.partitionBy("blob", "rule").orderBy("i")
    placed = each.withColumn("end", F.sum(F.col("m.piece") + F.col("m.length")).over(until)).where("m.ok")
    found = placed.groupBy("blob", "rule").agg(F.array_sort(F.collect_list(F.struct((F.col("end") - F.col("m.length")).alias("start"), "rank", "kind", "end"))).alias("found"))
    done = todo.select("blob", F.explode("todo").alias("rule"))
    return done.join(found, ["blob", "rule"], "left").select("blob", "rule", F.coalesce("found", F.array().cast(FINDING)).alias("found"))


def findings(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, found) for every row of docs: what the ledger and a scan for what it lacks have for the row's blob, by start and rule.

    A ledger's rows of other rules or versions are left aside, and of rows for one blob and rule one counts. Rows may repeat, ids may
    be null, and each row gives a row; other columns are ignored, whatever their names.
    """
    rows = scan(docs, ledger, rules, text_col)
    if ledger is not None:
        rows = rows.unionByName(ledger.where(F.col("rule").isin([r.key for r in rules])).dropDuplicates(["blob", "rule"]))
    by_blob = rows.where(F.size("found") > 0).groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("found"))).alias("found"))
    paths = docs.select(docs[id_col].alias("id"), blob_of(docs[text_col]).alias("blob"))
    return paths.join(by_blob, "blob", "left").select("id", F.coalesce("found", F.array().cast(FINDING)).alias("found")).withColumnRenamed("id", id_col)


def joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op7_secret_scan(spark, sf_dir: str) -> DataFrame:
    """One row for each row of documents. The ledger is written with the base rules' scan of all blobs first; the scan by all rules
    then finds it and looks only for the (blob, rule version) pairs that it lacks."""
    docs = table(spark, sf_dir, "documents")
    found = findings(docs, cut_table(scan(docs, rules=BASE)))
    kinds = [r.kind for r in BASE]
    base = F.filter("found", lambda s: s["kind"].isin(kinds))
    counts = [F.size(F.filter(F.col("found.kind"), lambda x: x == F.lit(k))).cast("long").alias(f"n_{k}") for k in kinds]  # noqa: B023
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))
