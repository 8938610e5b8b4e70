"""Catalogue operators: media rows, known objects, flags and labels of files, project scores, uploads, routing, detail reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators.lineage import numbered

# Fixed values of the data model.
ENTRY_NAMES = ["main.py", "app.py", "server.py", "manage.py", "cli.py", "index.js", "index.ts", "main.rs", "main.go", "program.cs"]
CONFIG_SUFFIXES = ["json", "yaml", "yml", "toml", "ini", "cfg", "conf", "env", "xml"]
SIGNALS = {
    "vcs_marker": 40, "language_manifest": 30, "framework_config": 20, "test_files": 15, "inter_file_imports": 15, "readme_or_changelog": 10,
    "consistent_naming": 10, "generated_or_dependency_dirs": 10,
}


def filename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def ignored(path: Column, thumbnails: str) -> Column:
    """Files below the folder of thumbnails, thumbnails by name, and dot files."""
    name = filename(path)
    return path.startswith(thumbnails + "/") | F.regexp_replace(name, r"(?<=.)\.[^.]*$", "").endswith("_thumbnail") | name.startswith(".")


def not_blank(column: Column) -> Column:
    return column.isNotNull() & (F.length(F.trim(column)) > 0)


def file_flags(path: Column) -> list[Column]:
    """entry_point, test and config."""
    low, name = F.lower(path), F.lower(filename(path))
    entry = name.isin(ENTRY_NAMES) | low.rlike(r"(^|/)(cmd|bin)/")
    test = name.startswith("test_") | name.endswith("_test.py") | name.contains(".test.") | name.contains(".spec.")
    return [entry.alias("entry_point"), test.alias("test"), (name.startswith(".") | T.suffix(path).isin(CONFIG_SUFFIXES)).alias("config")]


def brief(text: Column, most: int = 100) -> Column:
    """The first line of a text, stripped, up to ``most`` characters; null if there is none."""
    first = F.substring(T.strip(F.get(F.split(T.strip(text), r"\r\n|[\n\r]"), F.lit(0))), 1, most)
    return F.when(first != "", first)


def seconds_label(ts: Column) -> Column:
    return F.when(ts > 0, F.format_string("%.1fs", ts)).otherwise("unknown")


def bar(value: Column, most: Column, width: int = 12) -> Column:
    """A bar of hash signs and dashes; a share of one half of a sign goes to the even number."""
    share = F.least(F.greatest(value / F.when(most > 0, most).otherwise(1), F.lit(0.0)), F.lit(1.0))
    full = F.bround(share * width, 0).cast("int")
    return F.concat(F.repeat(F.lit("#"), full), F.repeat(F.lit("-"), F.lit(width) - full))


def plain_match(query: Column) -> Column:
    """A match string without its operators: words joined by spaces."""
    return F.array_join(F.filter(F.split(T.strip(query), r"(?U)\s+"), lambda t: ~F.upper(t).isin("AND", "OR", "NOT") & (t != "")), " ")


def project_score(signals: DataFrame, threshold: int = 40) -> DataFrame:
    """signals with score, band and is_code: the sum of the weights of the signals that are true, null counting as false."""
    score = sum([F.when(F.coalesce(F.col(k), F.lit(False)), w).otherwise(0) for k, w in SIGNALS.items()], F.lit(0))
    out = signals.withColumn("score", score.cast("int"))
    band = F.when(F.col("score") >= 40, "high").when(F.col("score") >= 20, "medium").otherwise("low")
    return out.withColumn("band", band).withColumn("is_code", F.col("score") >= max(0, min(threshold, 100)))


def upsert_images(stored: DataFrame, new: DataFrame) -> DataFrame:
    """(path, mtime, id, embedded): a newer file replaces the stored one, keeps its id and loses its embedding; an older or equal one is
    skipped; an unknown one gets the next id, in the order of paths, which are numbered over many tasks."""
    old = stored.select("path", F.col("mtime").alias("old_mtime"), F.col("id").alias("old_id"), F.col("embedded").alias("old_embedded"))
    both = old.join(new.select("path", F.col("mtime").alias("new_mtime")), "path", "full")
    newer = F.col("old_id").isNull() | (F.col("new_mtime") > F.col("old_mtime"))
    kept = both.where("old_id is not null").select("path", F.when(newer, F.col("new_mtime")).otherwise(F.col("old_mtime")).alias("mtime"), F.col("old_id").alias("id"), F.when(newer, False).otherwise(F.col("old_embedded")).alias("embedded"))
    fresh = numbered(both.where("old_id is null").select("path", F.col("new_mtime").alias("mtime")), "place", "path")
    last = stored.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last"))
    added = fresh.crossJoin(F.broadcast(last)).select("path", "mtime", (F.col("last") + F.col("place")).alias("id"), F.lit(False).alias("embedded"))
    return kept.unionByName(added)


def merge_lanes(rows: DataFrame, keys: list[str], lexical: float, semantic: float) -> DataFrame:
    """One row a key: the best of either score, their weighted sum, and all tokens and sources in order; only where the sum is above 0."""
    ok = rows.where(F.col("lexical") * lexical + F.col("semantic") * semantic > 0)
    out = ok.groupBy(*keys).agg(F.max("lexical").alias("lexical"), F.max("semantic").alias("semantic"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("tokens")))).alias("tokens"), F.array_sort(F.collect_set("source")).alias("sources"))
    return out.withColumn("score", F.col("lexical") * lexical + F.col("semantic") * semantic)


def known_and_found(known: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """All rows by key: those found override those known."""
    return found.unionByName(known.join(found.select(key), key, "left_anti"))


def preflight(uploads: DataFrame, stored: DataFrame) -> DataFrame:
    """(folder, filename, sha256, action, target): accept a new name, reject equal content under the same name, else rename to name[i] with the
    least free i. stored: (folder, filename, sha256)."""
    stem, ending = F.regexp_replace("filename", r"(?<=.)\.[^.]*$", ""), F.regexp_extract("filename", r"(?<=.)(\.[^.]*)$", 1)
    u = uploads.withColumn("stem", stem).withColumn("ending", ending)
    s = stored.withColumnRenamed("sha256", "held")
    numbered = stored.select("folder", F.regexp_extract("filename", r"^(.*)\[([1-9][0-9]*)\](\.[^.]*)?$", 1).alias("stem"), F.regexp_extract("filename", r"^(.*)\[([1-9][0-9]*)\](\.[^.]*)?$", 3).alias("ending"), F.regexp_extract("filename", r"^(.*)\[([1-9][0-9]*)\](\.[^.]*)?$", 2).alias("i"))
    taken = numbered.where("i <> ''").withColumn("i", F.col("i").cast("long")).distinct()
    # The least free number is that of the first gap: the first place in order that isn't its own number.
    run = taken.withColumn("place", F.row_number().over(Window.partitionBy("folder", "stem", "ending").orderBy("i")))
    free = run.groupBy("folder", "stem", "ending").agg((F.coalesce(F.max(F.when(F.col("i") == F.col("place"), F.col("i"))), F.lit(0)) + 1).alias("free"))
    out = u.join(s, ["folder", "filename"], "left").join(free, ["folder", "stem", "ending"], "left")
    action = F.when(F.col("held").isNull(), "accept").when(F.col("held") == F.col("sha256"), "reject").otherwise("rename")
    out = out.withColumn("action", action)
    renamed = F.concat("stem", F.lit("["), F.coalesce("free", F.lit(1)).cast("string"), F.lit("]"), "ending")
    return out.select("folder", "filename", "sha256", "action", F.when(F.col("action") == "rename", renamed).when(F.col("action") == "accept", F.col("filename")).alias("target"))


def routed(events: DataFrame, enabled: list[str], thumbnails: str) -> DataFrame:
    """File events (path, change) with the modality whose index they go to: those of enabled modalities that aren't ignored."""
    out = events.withColumn("modality", T.modality(F.col("path")))
    return out.where(F.col("modality").isin(enabled) & ~ignored(F.col("path"), thumbnails))


def without_modality(tables: dict[str, tuple[DataFrame, str]], gone: DataFrame) -> dict[str, DataFrame]:
    """Each table, given with the name of its path column, without the rows of paths that are gone: a cascade of anti joins."""
    return {name: t.join(gone.select(F.col("path").alias(column)).distinct(), column, "left_anti") for name, (t, column) in tables.items()}


def without_path(files: DataFrame, path: str, category: str | None = None) -> DataFrame:
    """files without the one at this path, or only if it is of this category."""
    hit = F.col("path").eqNullSafe(F.lit(path))
    return files.where(~(hit if category is None else hit & F.col("category").eqNullSafe(F.lit(category))))


def content(files: DataFrame, wanted: DataFrame, most: int = 5000) -> DataFrame:
    """(path, found, text, cut): the start of each wanted file's text, and whether more follows; files that aren't there are said so."""
    out = wanted.select("path").join(files.select("path", "content", F.lit(True).alias("there")), "path", "left")
    return out.select("path", F.coalesce("there", F.lit(False)).alias("found"), F.substring("content", 1, most).alias("text"), (F.coalesce(F.length("content"), F.lit(0)) > most).alias("cut"))
