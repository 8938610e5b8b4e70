"""Workspace connectors: text of blocks and properties, objects reached by links, and what a sync does to the stored state."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators.lineage import cut

_RICH = "array<struct<plain_text: string, text: struct<content: string>>>"
#: What is read of a block's payload, whatever its type.
PAYLOAD = f"struct<rich_text: {_RICH}, caption: {_RICH}, checked: boolean, language: string, url: string, expression: string, title: string>"
_NAMED = "struct<name: string, id: string>"
#: A property value: its type, and the payload under the type's name.
PROPERTY = (
    f"struct<type: string, title: {_RICH}, rich_text: {_RICH}, select: {_NAMED}, status: {_NAMED}, multi_select: array<{_NAMED}>, people: array<{_NAMED}>, "
    "relation: array<struct<id: string>>, date: struct<start: string, `end`: string>, email: string, url: string, phone_number: string, number: string, "
    "checkbox: boolean, formula: struct<string: string, number: string, boolean: string, date: string>>"
)


def either(first: Column, then: Column) -> Column:
    """The first value unless it is null or empty."""
    return F.coalesce(F.when(first != "", first), then, F.lit(""))


def plain(rich: Column) -> Column:
    """The runs of a rich text, one after the other."""
    return T.strip(F.array_join(F.transform(rich, lambda x: either(x["plain_text"], x["text"]["content"])), ""))


def block_text(kind: Column, payload: Column) -> Column:
    """The line that a block of this type gives; payload is a struct PAYLOAD."""
    rich = F.coalesce(plain(payload["rich_text"]), F.lit(""))
    to_do = T.strip(F.concat(F.when(payload["checked"], "[x] ").otherwise("[ ] "), rich))
    code = T.strip(F.concat(F.lit("[code:"), either(payload["language"], F.lit("plain")), F.lit("] "), rich))
    out = F.when(kind == "to_do", to_do).when(kind == "code", code).when(kind == "bookmark", payload["url"]).when(kind == "equation", payload["expression"])
    out = out.when(kind.isin("image", "file", "pdf", "video"), plain(payload["caption"])).when(kind.isin("child_page", "child_database"), payload["title"])
    return F.coalesce(out.otherwise(rich), F.lit(""))


def property_text(value: Column) -> Column:
    """A property's value as text; value is a struct PROPERTY. Types that aren't known give nothing."""
    kind, names = value["type"], lambda xs, of: F.array_join(F.filter(F.transform(xs, of), lambda x: x != ""), ", ")
    first = lambda *keys: F.coalesce(*[value["formula"][k] for k in keys])
    number = F.when(~value["number"].isin("0", "0.0"), value["number"])
    return F.coalesce(
        F.when(kind == "title", plain(value["title"])).when(kind == "rich_text", plain(value["rich_text"])).when(kind == "select", value["select"]["name"])
        .when(kind == "status", value["status"]["name"]).when(kind == "multi_select", names(value["multi_select"], lambda x: F.coalesce(x["name"], F.lit(""))))
        .when(kind == "date", T.strip(F.concat(F.coalesce(value["date"]["start"], F.lit("")), F.lit(" "), F.coalesce(value["date"]["end"], F.lit("")))))
        .when(kind == "email", value["email"]).when(kind == "url", value["url"]).when(kind == "phone_number", value["phone_number"]).when(kind == "number", number)
        .when(kind == "checkbox", F.when(value["checkbox"], "true").otherwise("false"))
        .when(kind == "people", F.array_join(F.transform(value["people"], lambda x: either(x["name"], x["id"])), ", "))
        .when(kind == "relation", F.array_join(F.transform(value["relation"], lambda x: F.coalesce(x["id"], F.lit(""))), ", "))
        .when(kind == "formula", first("string", "number", "boolean", "date")), F.lit("")
    )


def reached(roots: DataFrame, links: DataFrame, key: str = "id") -> DataFrame:
    """(key, level) of the objects that roots lead to, each once, by links (parent, child): one join a level, until a level brings none.

    What is read again at each level is written: the links once, what has been reached as one table, so that neither plans nor tasks add up
    level upon level."""
    links = cut(links.select("parent", "child"))
    out = cut(roots.select(key).distinct().withColumn("level", F.lit(0)))
    front, level = out, 0
    while True:
        level += 1
        step = links.join(front.select(F.col(key).alias("parent")), "parent", "left_semi").select(F.col("child").alias(key)).distinct()
        front = cut(step.join(out.select(key), key, "left_anti").withColumn("level", F.lit(level)))
        if front.isEmpty():
            return out
        out = cut(out.unionByName(front).repartition(key))


def page_texts(blocks: DataFrame, levels: DataFrame) -> DataFrame:
    """(object, content) of blocks (object, id, pos, kind, payload as JSON) that stand in levels (id, level): the lines that aren't blank,
    a level after the other and within one by pos, which counts through the level."""
    line = block_text(F.col("kind"), F.from_json("payload", PAYLOAD))
    each = blocks.join(levels, "id").select("object", "level", "pos", line.alias("line")).where(T.strip(F.col("line")) != "")
    return each.groupBy("object").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("level", "pos", "line"))), lambda x: x["line"]), "\n").alias("content"))


def child_refs(blocks: DataFrame) -> DataFrame:
    """(id, object_type, title) of the pages and databases that blocks (id, kind, payload) name; without a title, the id stands for it."""
    title = F.from_json("payload", PAYLOAD)["title"]
    found = blocks.where(F.col("kind").isin("child_page", "child_database") & (F.col("id") != ""))
    return found.select("id", F.substring_index("kind", "_", -1).alias("object_type"), either(title, F.col("id")).alias("title"))


def sync_actions(stored: DataFrame, crawled: DataFrame) -> DataFrame:
    """(id, action) of crawled objects (id, http_status, sha256) against stored ones (id, sha256): inserted, updated and unchanged by the
    content's hash; deleted where the source says 403 or 404 of an object that is stored; failed otherwise."""
    both = crawled.join(stored.select("id", F.col("sha256").alias("held")), "id", "left")
    ok = F.col("http_status") == 200
    action = F.when(ok & F.col("held").isNull(), "inserted").when(ok & (F.col("held") != F.col("sha256")), "updated").when(ok, "unchanged")
    return both.select("id", action.when(F.col("http_status").isin(403, 404) & F.col("held").isNotNull(), "deleted").otherwise("failed").alias("action"))


def known_objects(documents: DataFrame, provider: str, account: str, kinds: list[str] | None = None) -> DataFrame:
    """An account's documents that aren't deleted, of these kinds, the newest first."""
    ours = [F.col("provider") == provider, F.col("account_id") == account, F.col("status") != "deleted", *([F.col("object_type").isin(kinds)] if kinds else [])]
    return documents.where(reduce(Column.__and__, ours)).orderBy(F.desc("last_seen"), "id")
