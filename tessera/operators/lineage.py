"""Cutting lineage in loops, in the shared folder that the session names."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def checkpoints(spark: SparkSession) -> str:
    """The context's checkpoint folder, set to spark.checkpoint.dir where it isn't yet; only a local session without that setting uses a
    folder of its own (a master named local-cluster has several machines' worth of executors)."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = context.getConf().get("spark.checkpoint.dir")
        if not shared and not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir is not set")
        context.setCheckpointDir(shared or tempfile.mkdtemp())
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df checkpointed below the shared folder."""
    checkpoints(df.sparkSession)
    return df.checkpoint()


def unused(df: DataFrame, *names: str) -> list[str]:
    """These names, each made longer until no column of df has it, in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def numbered(rows: DataFrame, name: str, *order) -> DataFrame:
    """rows with their place from 1 in an order that leaves no ties, without a task that has them all: a range sort cuts them into parts
    by what the data holds, and a part's places begin after the rows of the parts before. Sorted rows are written first, so that parts stay
    as they were counted."""
    (at,) = unused(rows, "at")
    rows = cut(rows.sort(*order).withColumn(at, F.monotonically_increasing_id()))
    part = F.shiftright(F.col(at), 33)
    counts = rows.groupBy(part.alias("part")).agg(F.min(at).alias("first"), F.count("*").alias("n"))  # a row for each part
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("part", (F.col("first") - before).alias("base"))
    joined = rows.join(F.broadcast(counts), part == counts["part"])
    return joined.withColumn(name, F.col(at) - F.col("base") + 1).drop(at, "base", "part")
