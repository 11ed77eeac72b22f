"""Incremental ingestion: a stream of events kept in a table, each source_id once."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


#: Hash parts of the key in the folder of a batch.
PARTS = 64


def watch(spark: SparkSession, folder: str, schema, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def distinct_events(stream: DataFrame, time: str = "ts", delay: str = "1 day", key: str = "event_id") -> DataFrame:
    """Each key once among events that are at most delay late."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def counts(stream: DataFrame, time: str = "ts", width: str = "1 hour", delay: str = "1 day") -> DataFrame:
    """Events by type and tumbling window, final once the watermark has passed."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, width), "event_type").agg(F.count("*").alias("n"))


def ingest(stream: DataFrame, target: str, checkpoint: str, key: str = "event_id") -> StreamingQuery:
    """Appends to the Parquet table target the rows whose key it lacks, one folder per batch; a batch that is run again replaces its own.

    Within a batch the table is laid out by ``PARTS`` hash parts of the key, and only the key column of the parts that the batch has is read.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch = batch.withColumn("key_part", F.pmod(F.xxhash64(key), F.lit(PARTS)).cast("int")).persist()
        try:
            parts = [r.key_part for r in batch.select("key_part").distinct().collect()]
            known = spark.read.parquet(target).where((F.col("batch") != number) & F.col("key_part").isin(parts)).select(key)
            new = batch.join(known, key, "left_anti")
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            new = batch
        new.dropDuplicates([key]).write.mode("overwrite").partitionBy("key_part").parquet(f"{target}/batch={number}")
        batch.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
