"""Convex hulls of two measures per group, in stages: batches, then salted parts of a group, then the group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull, counter-clockwise from the leftmost lowest point; points on an edge are no corners."""
    points = np.unique(points, axis=0)
    if len(points) < 3:
        return points
    sides = []
    for run in (points.tolist(), points[::-1].tolist()):
        side: list[list[float]] = []
        for p in run:
            while len(side) > 1 and (side[-1][0] - side[-2][0]) * (p[1] - side[-2][1]) <= (side[-1][1] - side[-2][1]) * (p[0] - side[-2][0]):
                side.pop()
            side.append(p)
        sides.append(side[:-1])
    return np.array(sides[0] + sides[1])


def convex_hulls(df: DataFrame, keys: list[str], x: str, y: str, salts: int = 32) -> DataFrame:
    """(keys, place, x, y): the corners of each group's hull in counter-clockwise order.

    A group may hold most rows: every batch is cut to the hulls of its groups before the first shuffle, and each of the
    ``salts`` parts of a group to its own before the last.  Rows where a measure is null or not finite have no point.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    finite = [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")) for c in ("_x", "_y")]
    points = df.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).where(finite[0] & finite[1])
    points = points.withColumn("_salt", F.pmod(F.xxhash64("_x", "_y"), F.lit(salts)))
    schema = points.schema

    def cut_down(part: pd.DataFrame) -> pd.DataFrame:
        corners = pd.DataFrame(hull(part[["_x", "_y"]].to_numpy(float)), columns=["_x", "_y"])
        return corners.assign(**{c: part[c].iloc[0] for c in [*names, "_salt"]})[list(part.columns)]

    def of_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, part in batch.groupby([*names, "_salt"], dropna=False, sort=False):
                yield cut_down(part)

    def whole(part: pd.DataFrame) -> pd.DataFrame:
        return cut_down(part).drop(columns="_salt").assign(place=lambda d: np.arange(len(d)))

    few = points.mapInPandas(of_batches, schema).groupBy(*names, "_salt").applyInPandas(cut_down, schema)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.fields if f.name != "_salt")
    out = few.groupBy(*names).applyInPandas(whole, f"{fields}, place int")
    return out.select(*[F.col(n).alias(k) for k, n in zip(keys, names, strict=True)], "place", F.col("_x").alias(x), F.col("_y").alias(y))
