"""Helpers that several operators share: cutting lineage, bounded broadcasts, ranks without one big window."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import lineage

shared_dir, forget = lineage.shared_dir, lineage.forget

#: White space of the word contracts: \x20 and \x09-\x0D.
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes of rows that go to a Python worker at a time where rows hold whole texts; a longer row goes alone.
TEXT_BATCH = 4 << 20


@contextlib.contextmanager
def text_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs inside send batches of about TEXT_BATCH bytes to Python: executors hold each several times while it is sent."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(TEXT_BATCH))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def cut(df: DataFrame, name: str, texts: bool = False) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back (see ``lineage.cut``).

    ``texts``: Python steps of ``df`` get whole texts, and so smaller batches.
    """
    with text_batches(df.sparkSession) if texts else contextlib.nullcontext():
        return lineage.cut(df, name)


def small(df: DataFrame, most: int) -> DataFrame:
    """``df``, whose rows hold a few numbers, marked for broadcast if at most ``most`` rows were counted; else as it is, so that Spark shuffles."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def words_of(text: str | Column) -> Column:
    """Number of maximal runs of characters other than \\x20 and \\x09-\\x0D; null counts as empty."""
    return F.regexp_count(F.coalesce(text if isinstance(text, Column) else F.col(text), F.lit("")), F.lit(WORD)).cast("long")


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def rank_within(df: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """Add ``_rank`` (from 1), the place of each row among those of its ``key`` in the given order.

    One key may hold most rows, so no window spans a key: rows are range-partitioned by (key, order), numbered
    inside (key, partition), and moved on by the count of the earlier partitions, of which there is one row per
    (key, partition).  ``df`` must be a table (see ``cut``), ``key`` must not be null.
    """
    placed = cut(df.repartitionByRange(partitions(df), key, *order).withColumn("_pid", F.spark_partition_id()), name)
    before = Window.partitionBy(key).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy(key, "_pid").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    within = Window.partitionBy(key, "_pid").orderBy(*order)
    return placed.withColumn("_in", F.row_number().over(within)).join(counts, [key, "_pid"]).withColumn("_rank", F.col("_in") + F.col("_before")).drop("_in", "_before", "_pid")
