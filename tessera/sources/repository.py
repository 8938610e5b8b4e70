"""Version-control sources: commit lists and ignore files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import glob_regex


def commits(lines: DataFrame, since: int | None = None) -> DataFrame:
    """(commit, timestamp, message) of lines ``hash|epoch|subject`` in column value; a subject may hold bars; other lines go."""
    x = lines.select(F.split("value", r"\|", 3).alias("x")).where(F.size("x") == 3)
    out = x.select(F.col("x")[0].alias("commit"), F.expr("try_cast(x[1] as bigint)").alias("timestamp"), F.col("x")[2].alias("message")).where("timestamp is not null")
    return out.where(F.col("timestamp") >= since) if since is not None else out


def ignore_patterns(text: str) -> list[str]:
    """Rules of an ignore file: neither comments nor negations; a leading slash goes."""
    rules = [s.strip() for s in text.splitlines()]
    return [s.removeprefix("/") for s in rules if s and s[0] not in "#!"]


def ignored(path: Column, patterns: list[str]) -> Column:
    """Whether a relative path is ignored: by a folder (rule with a final slash), a path, or a name anywhere."""
    name, hit = F.element_at(F.split(path, "/"), -1), F.lit(False)
    for p in patterns:
        if p.endswith("/"):
            folder = p.rstrip("/")
            hit = hit | (path == folder) | path.startswith(folder + "/")
        elif "/" in p:
            hit = hit | path.rlike("^" + glob_regex(p))
        else:
            hit = hit | name.rlike("^" + glob_regex(p)) | path.rlike("^" + glob_regex("*/" + p))
    return hit
