"""Tables whose rows belong to documents, kept in hash buckets: a document's rows are replaced as one, by rewriting its bucket alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as P

from tessera.functions import text as T
from tessera.operators.lineage import cut
from tessera.streaming.stateful import exists

#: Characters and overlap of a cloud document's chunks, lines and overlap of a code file's.
CLOUD, CODE = (900, 120), (80, 20)


class Table:
    """Rows of a schema in a folder, by a key column. buckets stays as it was when the table was made.

    replace() reads the touched buckets, writes what they hold then to the shared folder and puts that in their place by dynamic partition
    overwrite; the batch's number goes into the log last. A batch that broke off is run again and gives the same; one that is in the log
    changes nothing. One writer at a time; a reader may see some of a batch's buckets before the others.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str, key: str, buckets: int = 32):
        self.spark, self.folder, self.key, self.buckets = spark, folder, key, buckets
        self.schema = P.StructType.fromDDL(schema)

    def _stored(self) -> DataFrame:
        full = P.StructType([*self.schema.fields, P.StructField("_bucket", P.IntegerType())])
        place = f"{self.folder}/rows"
        return self.spark.read.schema(full).parquet(place) if exists(self.spark, place) else self.spark.createDataFrame([], full)

    def rows(self) -> DataFrame:
        return self._stored().where(F.col(self.key).isNotNull()).drop("_bucket")

    def batches(self) -> DataFrame:
        """(batch, touched): what was applied, and how many buckets it rewrote."""
        place = f"{self.folder}/log"
        return self.spark.read.schema("batch long, touched long").parquet(place) if exists(self.spark, place) else self.spark.createDataFrame([], "batch long, touched long")

    def _bucket(self):
        return F.pmod(F.hash(self.key), F.lit(self.buckets)).cast("int").alias("_bucket")

    def replace(self, rows: DataFrame, batch: int, documents: DataFrame | None = None) -> bool:
        """Give documents the rows (of the schema) that have their key, and no others; whether that was still to be done.

        documents: (key) of all that are replaced, those without rows now among them; by default those that rows have. Rows with a null
        key are left out."""
        if not self.batches().where(F.col("batch") == batch).isEmpty():
            return False
        rows = rows.select(*self.schema.names).where(F.col(self.key).isNotNull())
        keys = rows.select(self.key) if documents is None else documents.select(self.key).unionByName(rows.select(self.key))
        keys = cut(keys.where(F.col(self.key).isNotNull()).distinct().select(self.key, self._bucket()))
        touched = [r[0] for r in keys.select("_bucket").distinct().collect()]  # numbers below buckets
        if touched:
            old = self._stored().where(F.col("_bucket").isin(touched) & F.col(self.key).isNotNull())
            kept = old.join(keys.select(self.key), self.key, "left_anti").select(*self.schema.names, "_bucket")
            # An empty row keeps a bucket that has lost all others from being left as it was.
            marks = keys.select("_bucket").distinct().select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema.fields], "_bucket")
            new = cut(kept.unionByName(rows.select("*", self._bucket())).unionByName(marks))
            new = new.repartition(len(touched), "_bucket").sortWithinPartitions("_bucket", F.col(self.key))
            new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(f"{self.folder}/rows")
        self.spark.createDataFrame([(batch, len(touched))], "batch long, touched long").coalesce(1).write.mode("append").parquet(f"{self.folder}/log")
        return True


CHUNK = "document long, chunk_index int, start_offset int, end_offset int, chunk_text string"


def cloud_chunks(files: DataFrame) -> DataFrame:
    """CHUNK rows of files (id, content): windows of characters, blank ones left out."""
    size, overlap = (F.lit(n) for n in CLOUD)
    rows = files.select(F.col("id").alias("document"), F.explode(T.char_chunks(F.col("content"), size, overlap)).alias("c"))
    return rows.select("document", F.col("c.index").alias("chunk_index"), F.col("c.start").alias("start_offset"), F.col("c.end").alias("end_offset"), F.col("c.text").alias("chunk_text"))


CODE_CHUNK = "path string, chunk_index int, start_line int, end_line int, chunk_text string"


def code_chunks(files: DataFrame) -> DataFrame:
    """CODE_CHUNK rows of files (path, content): windows of lines, blank ones left out."""
    rows = files.select("path", F.explode(T.line_chunks(F.col("content"), *CODE)).alias("c"))
    return rows.select("path", F.col("c.index").alias("chunk_index"), F.col("c.start_line").alias("start_line"), F.col("c.end_line").alias("end_line"), F.col("c.text").alias("chunk_text"))


FRAME = "video string, frame int, timestamp double, description string, ocr_text string, embedding array<float>"
