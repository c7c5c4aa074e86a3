"""Connected components by large-star / small-star rounds (Kiveris et al. 2014), links never leaving Spark."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, forget
from .textbytes import tidy


#: Nodes whose trees a task holds at a time.
HELD = 300_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's links, as many at a time as HELD nodes have, as stars around the smallest node reached: no more links than before."""
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    def stars() -> pa.RecordBatch:
        own = [(x, y) for x in list(parent) if (y := top(x)) != x]
        parent.clear()
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in own], pa.int64()), pa.array([y for _, y in own], pa.int64())], names=["u", "v"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = top(a), top(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) > HELD:
            yield stars()
    yield stars()


def components(links: DataFrame, a: str, b: str, most_rounds: int = 40) -> DataFrame:
    """``node``, ``component`` (its smallest node) for every node of the links; loops and repeats don't matter.

    Links are kept as (larger, smaller).  A round points every link to the smallest neighbour of its smaller end, then joins
    all smaller neighbours of a node to the smallest one.  As tasks write forests, a node has at most one smaller
    neighbour from each HELD nodes of a task, so windows stay small; the join on the smaller end, where one
    node may hold most links, can be split by Spark.  It ends when a round changes nothing, which only stars do.
    """
    edges = links.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).where("u <> v")
    edges = cut(edges.mapInArrow(tidy(_forest), "u long, v long"), "links")
    seen = None
    for _ in range(most_rounds):
        mark = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if mark["n"] == 0 or mark == seen:
            break
        seen = mark
        low = edges.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("m"))
        large = edges.join(low, "v", "left").select("u", F.coalesce("m", "v").alias("v"))
        large = large.withColumn("m", F.min("v").over(Window.partitionBy("u")))
        ends = F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        both = large.select(F.inline(ends)).where("u <> v").distinct()
        old, edges = edges, cut(both.mapInArrow(tidy(_forest), "u long, v long"), "links")
        forget(old)
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
