"""File streams with checkpoints: resumable ingest whose result is that of the batch job over the same files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def stream_files(spark: SparkSession, path: str, schema: T.StructType, kind: str = "json", files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(kind).load(path)


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def ingest_stream(rows: DataFrame, reason: Column, out: str, checkpoint: str, keys: list[str] | None = None, time: str | None = None, late: str = "1 day") -> StreamingQuery:
    """Appends good rows to OUT/good and dead ones with their reason to OUT/dead, a folder for each batch; what is done isn't done again after a restart.

    With ``keys``, only the first row of each key is kept. With a ``time`` column besides, rows of a key count as repeated within ``late`` of each other, and the
    state holds no more than that. Without, the keys that earlier batches have written are read again (those columns alone) and joined, so that
    the stream holds no state at all.
    """
    if keys and time:
        rows = rows.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if keys and not time:
            batch = batch.dropDuplicates(keys)
            for part, read in (("good", spark.read.schema(f"{batch.select(*keys)._jdf.schema().toDDL()}, batch bigint").parquet), ("dead", spark.read.schema(f"{batch.select(*keys)._jdf.schema().toDDL()}, batch bigint").json)):
                if _exists(spark, f"{out}/{part}"):
                    batch = batch.join(read(f"{out}/{part}").where(F.col("batch") < number).select(*keys), keys, "left_anti")
        # the batch's number in the path makes a repeated batch overwrite itself
        tagged = batch.withColumn("reason", reason).persist()
        tagged.where("reason is null").drop("reason").write.mode("overwrite").parquet(f"{out}/good/batch={number}")
        tagged.where("reason is not null").write.mode("overwrite").json(f"{out}/dead/batch={number}")
        tagged.unpersist()

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str, by: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by window and key; rows later than ``late`` are dropped in a stream."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), by, "n")
