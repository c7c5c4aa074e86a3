"""Exact order statistics of many groups at once, however large a group: ranks from range partitions and their counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    same = F.lit(True)
    for k in keys:
        same = same & left[k].eqNullSafe(right[f"_of_{k}"])
    return same


def _beside(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on ``keys``, null being a value of its own."""
    right = right.select(*[F.col(k).alias(f"_of_{k}") if k in keys else F.col(k) for k in right.columns])
    return left.join(right, _same(left, right, keys)).drop(*[f"_of_{k}" for k in keys])


def at_ranks(df: DataFrame, keys: list[str], column: str, ranks: Callable[[Column], dict[str, Column]]) -> DataFrame:
    """(keys, n, a column per name): the values at given places of each group's sorted values, nulls left out.

    ``ranks`` maps the group's size ``n`` to places from 0, by name; a place outside the group gives null.  Equal values are
    counted before they move.  Distinct values are range-partitioned by (keys, value), so a group spreads over as many
    tasks as it has values for, and a place is looked up in the one partition that holds it.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = df.select(*keys, F.col(column).alias("_v")).where("_v is not null").groupBy(*keys, "_v").agg(F.count("*").alias("_c"))
    placed = cut(counted.repartitionByRange(parts, *keys, "_v").withColumn("_pid", F.spark_partition_id()), "ranks")
    before = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    pieces = placed.groupBy(*keys, "_pid").agg(F.sum("_c").alias("_m")).withColumn("_from", F.coalesce(F.sum("_m").over(before), F.lit(0)))
    sizes = placed.groupBy(*keys).agg(F.sum("_c").alias("n"))
    names = list(ranks(F.lit(0)))
    wanted = sizes.select(*keys, "n", F.inline(F.array(*[F.struct(F.lit(name).alias("_name"), c.cast("long").alias("_rank")) for name, c in ranks(F.col("n")).items()])))
    where = _beside(wanted, pieces, keys).where("_rank >= _from and _rank < _from + _m").select(*keys, "_pid", "_from", "_name", "_rank")
    inside = Window.partitionBy(*keys, "_pid").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    ranked = placed.withColumn("_low", F.coalesce(F.sum("_c").over(inside), F.lit(0)))
    found = _beside(ranked, where, [*keys, "_pid"]).where("_rank - _from >= _low and _rank - _from < _low + _c")
    values = found.groupBy(*keys).agg(*[F.max(F.when(F.col("_name") == x, F.col("_v"))).alias(x) for x in names])
    right = values.select(*[F.col(k).alias(f"_of_{k}") if k in keys else F.col(k) for k in values.columns])
    return sizes.join(right, _same(sizes, right, keys), "left").drop(*[f"_of_{k}" for k in keys])


def quantiles(df: DataFrame, keys: list[str], column: str, shares: dict[str, float]) -> DataFrame:
    """(keys, n, a column per name): quantiles with linear interpolation; null for a group without a value.

    NaN sorts above all numbers.  Without keys there is one row, of nulls where no value is.
    """
    def places(n: Column) -> dict[str, Column]:
        at = {k: (n - 1) * F.lit(q) for k, q in shares.items()}
        return {f"_{end}_{k}": f(a) for k, a in at.items() for end, f in (("low", F.floor), ("high", F.ceil))}

    found = at_ranks(df, keys, column, places)
    out = []
    for k, q in shares.items():
        at, low, high = (F.col("n") - 1) * F.lit(q), F.col(f"_low_{k}"), F.col(f"_high_{k}")
        out.append(F.when(F.floor(at) == F.ceil(at), low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high).alias(k))
    return found.select(*keys, "n", *out)
