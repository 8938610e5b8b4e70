"""Text of files by suffix, from Spark's binaryFile source. What is in a format that nothing here
can read (pdf, doc, ppt, rtf, xls) has a null text, which an empty file hasn't."""

from __future__ import annotations

import csv
import io
import json
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T

UNREAD = ["pdf", "doc", "ppt", "rtf", "xls"]


def decoded(raw: bytes) -> str:
    return raw.decode("utf-8", "ignore")


def rows_text(raw: bytes, delimiter: str = ",") -> str:
    """Cells that aren't blank joined by tabs, rows by line feeds, empty rows left out."""
    rows = ["\t".join(c.strip() for c in r if c.strip()) for r in csv.reader(io.StringIO(decoded(raw)), delimiter=delimiter)]
    return "\n".join(r for r in rows if r)


def zipped_text(raw: bytes, prefix: str, tag: str) -> str:
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        parts = sorted(n for n in z.namelist() if n.startswith(prefix) and n.endswith(".xml"))
        return "\n".join(" ".join(e.text for e in ElementTree.fromstring(z.read(n)).iter() if e.tag.endswith(tag) and e.text) for n in parts)


def tagged(element: ElementTree.Element, tag: str) -> list[ElementTree.Element]:
    return [e for e in element.iter() if e.tag.endswith("}" + tag)]


def cell_text(cell: ElementTree.Element, shared: list[str]) -> str:
    if cell.get("t") == "inlineStr":
        return "".join(e.text or "" for e in tagged(cell, "t"))
    value = next((e.text or "" for e in tagged(cell, "v")), "")
    if cell.get("t") == "b":
        return "True" if value == "1" else "False"
    return shared[int(value)] if cell.get("t") == "s" and value else value


def workbook_text(raw: bytes) -> str:
    """Each sheet's name, then its rows, cells that aren't blank joined by tabs; a formula by its stored value, a date by its number."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(e.text or "" for e in tagged(item, "t")) for item in tagged(ElementTree.fromstring(z.read("xl/sharedStrings.xml")), "si")]
        target = {e.get("Id"): e.get("Target", "") for e in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        out = []
        for sheet in tagged(ElementTree.fromstring(z.read("xl/workbook.xml")), "sheet"):
            out.append(f"# Sheet: {sheet.get('name')}")
            part = target[next(v for k, v in sheet.attrib.items() if k.endswith("}id"))]
            rows = tagged(ElementTree.fromstring(z.read(part.lstrip("/") if part.startswith("/") else f"xl/{part}")), "row")
            cells = [[t for t in (cell_text(c, shared) for c in tagged(r, "c")) if t.strip()] for r in rows]
            out += ["\t".join(c) for c in cells if c]
        return "\n".join(out).strip()


def extract(path: str, raw: bytes) -> str | None:
    """The text of one file: empty for an unknown suffix or a file that is broken, null for a format that can't be read."""
    suffix = path.rsplit(".", 1)[-1].lower()
    if suffix in UNREAD:
        return None
    try:
        if suffix == "csv":
            return rows_text(raw)
        if suffix == "tsv":
            return rows_text(raw, "\t")
        if suffix == "json":
            try:
                return json.dumps(json.loads(decoded(raw)), indent=2, ensure_ascii=False)
            except ValueError:
                return decoded(raw)
        if suffix == "pptx":
            return zipped_text(raw, "ppt/slides/slide", "}t")
        if suffix == "docx":
            return zipped_text(raw, "word/document", "}t")
        if suffix == "ods":
            return zipped_text(raw, "content", "}p")
        if suffix == "xlsx":
            return workbook_text(raw)
        return decoded(raw) if suffix in T.MODALITY_SUFFIXES["text"] or suffix in T.LANGUAGES else ""
    except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, IndexError, ValueError, StopIteration, csv.Error):
        return ""


def list_files(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """(path, filename, category, mtime, size) of a folder's files, below it at any depth; none is opened."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)
    return found.select("path", F.element_at(F.split("path", "/"), -1).alias("filename"), T.modality(F.col("path")).alias("category"), F.col("modificationTime").cast("double").alias("mtime"), F.col("length").alias("size"))


def with_contents(files: DataFrame) -> DataFrame:
    """files (path, ...) with content, each file's text, and error where it could not be read: by tasks that open these files alone."""
    from tessera.sources.paged import opened

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(len(b)):  # one at a time: a file may be large
                row = b.iloc[i : i + 1]
                text, error = None, None
                try:
                    system, place = opened(row["path"].iloc[0])
                    with system.open_input_stream(place, compression=None) as f:
                        text = extract(place, f.read())
                except OSError as e:
                    error = str(e)
                yield row.assign(content=pd.Series([text], row.index, dtype=object), error=pd.Series([error], row.index, dtype=object))

    tasks = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema.fields)
    return files.repartition(tasks, "path").mapInPandas(run, f"{fields}, content string, error string")


def read_files(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """(path, filename, category, mtime, content) of a folder's files, below it at any depth."""
    return with_contents(list_files(spark, folder, glob)).select("path", "filename", "category", "mtime", "content")


def ir_collection(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """corpus (id, content), queries (qid, query), qrels (qid, id, rel) of a test collection; rows without id or text are left out."""
    c = spark.read.schema("_id string, title string, text string").json(f"{folder}/corpus.jsonl")
    corpus = c.select(F.col("_id").alias("id"), T.strip(F.concat_ws("\n", "title", "text")).alias("content")).where("id <> '' and content <> ''")
    q = spark.read.schema("_id string, text string").json(f"{folder}/queries.jsonl")
    r = spark.read.option("sep", "\t").option("header", "true").schema("qid string, id string, rel int").csv(f"{folder}/qrels/test.tsv")
    return corpus, q.select(F.col("_id").alias("qid"), F.col("text").alias("query")).where("qid <> '' and query <> ''"), r


def html_text(html) -> F.Column:
    """A page without scripts, styles and tags, white space collapsed."""
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", " "), r"(?s)<!--.*?-->|<[^>]*>", " ")
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(bare, r"(?U)\s+", " "))
