import time

from pyspark.sql import functions as F

from tessera.operators import lanes as L


def rows(spark, *items):
    return spark.createDataFrame([(0, i, s) for i, s in items], "qid long, item string, score double")


def slow(spark):
    @F.udf("double")
    def wait(x):
        time.sleep(60)
        return x

    return spark.range(4).select(F.lit(0).cast("long").alias("qid"), F.lit("late").alias("item"), wait(F.col("id").cast("double")).alias("score"))


def test_late_and_broken_lanes_are_left_out(spark):
    began = time.monotonic()
    lanes = {"text": lambda: rows(spark, ("a", 0.5), ("b", 0.2)), "video": lambda: slow(spark), "image": lambda: rows(spark, ("c", 1.0)).select("qid", "none"), "cloud": lambda: rows(spark, ("d", 0.3)).repartition(3)}
    out, errors = L.unified(spark, lanes, 10, {"video": 3.0, "text": 30, "cloud": 30, "image": 30})
    assert time.monotonic() - began < 40
    assert [(r.modality, r.item) for r in out.orderBy("place").collect()] == [("text", "a"), ("cloud", "d"), ("text", "b")]
    said = {r.modality: r.error for r in errors.collect()}
    assert said["video"] == "timeout" and said["image"].startswith("AnalysisException") and len(said) == 2
    assert spark.range(5).count() == 5  # no tag is left behind


def test_all_lanes_late(spark):
    out, errors = L.unified(spark, {"video": lambda: slow(spark)}, 10, {"video": 1.0})
    assert out is None and errors.first().error == "timeout"
