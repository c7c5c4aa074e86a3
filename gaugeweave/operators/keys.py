"""Incremental loads and keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut

#: The steps that are added one after another to a repeated reference id.
LADDER = ["a", "b", "c", "d", "e", "f", "g", "a1", "a2", "a3", "a4", "a5"]


def new_lines(batch: DataFrame, known: DataFrame, line: str) -> DataFrame:
    """Record lines of the batch that the table does not hold; repeats inside the batch stay."""
    return batch.where(F.col(line).rlike(r"^\{.*\}$")).join(known.select(line), line, "left_anti")


def numbered(df: DataFrame, order: list[str], start: DataFrame, id_col: str, name: str) -> DataFrame:
    """Add ``name``: start's largest id plus 1, 2, ... in the given order.

    Ranks come from range partitions and their counts, so no window holds all rows.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Written once: evaluated again, the sampled bounds of the ranges might differ.
    placed = cut(df.repartitionByRange(parts, *order).withColumn("_pid", F.spark_partition_id()), "numbered")
    placed = placed.withColumn("_i", F.row_number().over(Window.partitionBy("_pid").orderBy(*order)))
    counts = placed.groupBy("_pid").agg(F.count("*").alias("_n"))
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    top = start.agg(F.coalesce(F.max(F.col(id_col).cast("long")), F.lit(0)).alias("_top"))
    return placed.join(F.broadcast(offsets), "_pid").crossJoin(F.broadcast(top)).withColumn(name, F.col("_top") + F.col("_before") + F.col("_i")).drop("_pid", "_i", "_before", "_top")  # one row a partition, one row


def unique_references(new: DataFrame, used: DataFrame, id_col: str, order: str, name: str = "unique_id") -> DataFrame:
    """Make ids differ from those in use and from each other by cumulative suffixes (x, xa, xab, ...); null at the ladder's end.

    The first row of an id (by ``order``) that is not in use keeps it; every other row climbs one step a round, and of
    rows that reach the same free step the first one takes it.  Rows x, x, xa become x, xab, xa: those that bring an id
    themselves come before those that climb to it; of rows equal in order and id any one comes first.  A round is a join and an aggregate over the rows that still climb.
    """
    steps = ["", *("".join(LADDER[: k + 1]) for k in range(len(LADDER)))]
    taken = used.select(F.col(id_col).alias(name)).where(F.col(name).isNotNull()).distinct()
    left, done = cut(new.withColumn("_tie", F.monotonically_increasing_id()), "references"), []
    for k, step in enumerate(steps):
        here = left.withColumn(name, F.concat(F.col(id_col), F.lit(step)))
        first = here.join(taken, name, "left_anti").groupBy(name).agg(F.min(F.struct(order, id_col, "_tie")).alias("_first"))
        first = first.select(name, F.col("_first._tie").alias("_winner"))
        marked = cut(here.join(first, name, "left").withColumn("_won", F.coalesce(F.col("_tie") == F.col("_winner"), F.lit(False))).drop("_winner"), f"references-{k}")
        won = marked.where("_won").drop("_won")
        done.append(won.select(*new.columns, name))
        taken = taken.unionByName(won.select(name))
        left = marked.where("not _won").select(*new.columns, "_tie")
    out = left.drop("_tie").withColumn(name, F.lit(None).cast("string"))
    for rows in done:
        out = out.unionByName(rows)
    return out


def with_references(entries: DataFrame, references: DataFrame, keys: list[str], attached: str, overwrite: bool = False) -> tuple[DataFrame, DataFrame]:
    """Entries with their reference's ``attached`` column, and those without a reference; attached ones pass through."""
    done = entries.where(F.col(attached).isNotNull()) if not overwrite else entries.limit(0)
    todo = (entries.where(F.col(attached).isNull()) if not overwrite else entries).drop(attached)
    refs = references.select(*keys, attached)
    return todo.join(refs, keys).select(*entries.columns).unionByName(done), todo.join(refs, keys, "left_anti")


def repeated_tags(df: DataFrame, tag: list[str]) -> DataFrame:
    """All rows whose tag occurs more than once."""
    again = df.groupBy(*tag).agg(F.count("*").alias("_n")).where("_n > 1").select(*tag)
    return df.join(again, tag, "left_semi")
