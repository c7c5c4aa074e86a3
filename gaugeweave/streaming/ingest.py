"""The incremental load of record lines as a stream: files that arrive are cleaned and matched against the known table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def line_stream(spark: SparkSession, folder: str, pattern: str, name: str = "order1") -> DataFrame:
    """Record lines of arriving text files, with a key from the path."""
    lines = spark.readStream.text(folder).select(F.regexp_extract("_metadata.file_path", pattern, 1).alias(name), F.col("value").alias("line"))
    return lines.where(F.col("line").rlike(r"^\{.*\}$"))


def load_new(stream: DataFrame, known: str, checkpoint: str) -> StreamingQuery:
    """Append each batch's lines that the Parquet table ``known`` does not hold yet, then stop."""
    spark = stream.sparkSession

    def append(batch: DataFrame, _: int) -> None:
        there = spark.read.schema(batch.schema).parquet(known).select("line")
        batch.join(there, "line", "left_anti").write.mode("append").parquet(known)

    return stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
