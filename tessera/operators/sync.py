"""Syncing a workspace: known and discovered objects are crawled level by level, and what was found is merged into the stored state."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import connector as C
from tessera.operators.lineage import cut
from tessera.sources import paged

REF = "id string, object_type string, title string"
#: The stored state: one row for each object of an account.
STATE = "provider string, account_id string, id string, object_type string, title string, content string, sha256 string, status string, error string, last_seen long"
#: What a crawl brings: a row for each block, or one with the status alone where an object has none or could not be had.
FOUND = "object string, http_status int, error string, id string, parent string, pos long, kind string, payload string"
#: Rows that a task hands over at once.
ROWS = 2000


def fetched(refs: DataFrame, options: dict) -> DataFrame:
    """FOUND rows of refs (id): all blocks of each object, over as many answers as it takes."""

    columns = [c.split()[0] for c in FOUND.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = paged.Client(paged.transport(options["path"], options.get("token")), int(options.get("size", paged.SIZE)), float(options.get("pause", 1.0)))
        frame = lambda rows: pd.DataFrame(rows, columns=columns).astype({"pos": "Int64"})
        rows: list[tuple] = []
        for b in batches:
            for object in b["id"]:
                try:
                    got = [(object, 200, None, r["id"], r.get("parent"), pos, r["kind"], json.dumps(r["payload"])) for pos, r in enumerate(client.results(f"objects/{object}/blocks"))]
                    rows += got or [(object, 200, None, None, None, None, None, None)]
                except paged.ServiceError as e:
                    rows.append((object, e.status, str(e), None, None, None, None, None))
                if len(rows) >= ROWS:
                    yield frame(rows)
                    rows = []
        if rows:
            yield frame(rows)

    tasks = int(refs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    path = F.concat(F.lit("objects/"), "id", F.lit("/blocks"))
    return paged.placed(refs.select("id"), options["path"], path, tasks).mapInPandas(run, FOUND)


def crawl(roots: DataFrame, options: dict) -> tuple[DataFrame, DataFrame]:
    """(refs, found): all objects that roots (REF) lead to by the child pages and databases among their blocks, each asked for once, and
    their FOUND rows. One round of requests for each level, until a level names nothing new; each is written before the next."""
    front = cut(roots.groupBy("id").agg(F.min("object_type").alias("object_type"), F.min("title").alias("title")))
    refs, found = front, None
    while not front.isEmpty():
        got = cut(fetched(front, options))
        found = got if found is None else found.unionByName(got)
        children = C.child_refs(got.where("kind is not null")).groupBy("id").agg(F.min("object_type").alias("object_type"), F.min("title").alias("title"))
        front = cut(children.join(refs.select("id"), "id", "left_anti"))
        refs = refs.unionByName(front)
    return refs, found if found is not None else roots.sparkSession.createDataFrame([], FOUND)


def contents(found: DataFrame) -> DataFrame:
    """(id, http_status, error, content, sha256) of each object that was asked for; no text where it could not be had."""
    blocks = found.where("kind is not null")
    nested = blocks.where("parent is not null").select("parent", F.col("id").alias("child"))
    levels = C.reached(blocks.where("parent is null").select("id"), nested)
    texts = C.page_texts(blocks.select("object", "id", "pos", "kind", "payload"), levels)
    asked = found.groupBy(F.col("object").alias("id")).agg(F.max("http_status").alias("http_status"), F.max("error").alias("error"))
    out = asked.join(texts.withColumnRenamed("object", "id"), "id", "left")
    content = F.when(F.col("http_status") == 200, F.coalesce("content", F.lit("")))
    return out.select("id", "http_status", "error", content.alias("content"), F.sha2(content, 256).alias("sha256"))


@dataclass
class Synced:
    """documents: the state after the sync; actions (id, action); counts, an account's row and its sync state, of one row each."""

    documents: DataFrame
    actions: DataFrame
    counts: DataFrame
    account: DataFrame
    state: DataFrame


def sync(spark: SparkSession, options: dict, account: dict, stored: DataFrame, now: int) -> Synced:
    """One sync of an account (provider, account_id, display_name) against its stored documents (STATE).

    Roots are the objects that the service lists and those known from before that aren't deleted; where both name one, what is listed
    counts. 403 and 404 mark a known object as deleted, with its text kept; other failures leave it as it was; objects of other accounts
    are passed through. An object that was deleted and is found again is active again.
    """
    spark.dataSource.register(paged.PagedSource)
    listed = spark.read.format("paged").options(**options).load()
    found = listed.select("id", *[F.coalesce(F.get_json_object("body", f"$.{k}"), F.lit(other) if isinstance(other, str) else other).alias(k) for k, other in (("object_type", "page"), ("title", F.col("id")))])
    ours = (F.col("provider") == account["provider"]) & (F.col("account_id") == account["account_id"])
    held = stored.where(ours)
    known = C.known_objects(stored, account["provider"], account["account_id"], ["page", "database"]).select("id", "object_type", "title")
    found = cut(found.dropDuplicates(["id"]))
    roots = found.unionByName(known.join(found.select("id"), "id", "left_anti"))
    refs, blocks = crawl(roots, options)
    crawled = cut(contents(blocks))
    actions = cut(C.sync_actions(held.where("status <> 'deleted'").select("id", "sha256"), crawled))
    rows = crawled.join(refs, "id").join(actions, "id").withColumnsRenamed({"object_type": "type_", "title": "title_", "content": "content_", "sha256": "sha_", "error": "error_"})
    both = held.join(rows, "id", "full_outer")
    fresh, gone = F.col("action").isin("inserted", "updated", "unchanged"), F.col("action") == "deleted"
    pick = lambda new, old: F.when(fresh, F.col(new)).otherwise(F.col(old)).alias(old)
    merged = both.where(F.col("provider").isNotNull() | fresh).select(
        F.lit(account["provider"]).alias("provider"), F.lit(account["account_id"]).alias("account_id"), "id", pick("type_", "object_type"), pick("title_", "title"), pick("content_", "content"), pick("sha_", "sha256"),
        F.when(fresh, "active").when(gone, "deleted").otherwise(F.col("status")).alias("status"),
        F.when(gone | (F.col("action") == "failed"), F.col("error_")).when(~fresh | F.col("action").isNull(), F.col("error")).alias("error"),
        F.when(fresh, F.lit(now)).otherwise(F.col("last_seen")).cast("long").alias("last_seen"),
    )
    documents = cut(merged.unionByName(stored.where(~ours | ours.isNull()).select(*merged.columns)))
    of = lambda *names: F.count_if(F.col("action").isin(*names))
    # A deletion is a failed request too, and counts as one.
    counts = actions.agg(of("inserted", "updated", "unchanged").alias("fetched"), of("inserted", "updated").alias("updated"), of("unchanged").alias("unchanged"), of("deleted", "failed").alias("failed"))
    counts = cut(counts.crossJoin(F.broadcast(found.agg(F.count("*").alias("discovered")))))
    who = spark.createDataFrame([(account["provider"], account["account_id"], account.get("display_name"), now)], "provider string, account_id string, display_name string, updated_at long")
    state = counts.select(F.lit(account["provider"]).alias("provider"), F.lit(account["account_id"]).alias("account_id"), F.lit(now).cast("long").alias("last_sync"), F.when(F.col("failed") > 0, "partial").otherwise("ok").alias("status"))
    return Synced(documents, actions, counts, who, state)


def upsert_accounts(accounts: DataFrame, account: DataFrame) -> DataFrame:
    """accounts with this account's row in the place of an older one."""
    return accounts.join(account, ["provider", "account_id"], "left_anti").unionByName(account)
