"""Regressions of two traits over many trees, comparisons and groups in one job."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.lineage import cut
from ..functions.nulls import finite
from .treefold import fold


def plain(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Ordinary regression per key: slope, intercept, r2, n, and the slope's t value."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    sums = both.groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.count("*").alias("n"), F.regr_sxx(y, x).alias("_xx"), F.regr_syy(y, x).alias("_yy"), F.regr_sxy(y, x).alias("_xy"))
    rest = F.col("_yy") - F.col("slope") * F.col("_xy")
    error = F.sqrt(F.try_divide(F.greatest(rest, F.lit(0.0)), F.col("n") - 2) / F.col("_xx"))
    return sums.select(*keys, "slope", "intercept", "r2", "n", F.try_divide("slope", error).alias("t"))


def with_whole(df: DataFrame, group: str, label: str = "ALL") -> DataFrame:
    """Every row once in its group and once in the whole."""
    return df.withColumn(group, F.explode(F.array(F.col(group), F.lit(label))))


def comparisons(traits: DataFrame, keys: list[str], catalogue: list[tuple[str, str, str]]) -> DataFrame:
    """(keys, comparison, x, y) for a list of (comparison, x column, y column)."""
    rows = F.array(*[F.struct(F.lit(c).alias("comparison"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")) for c, x, y in catalogue])
    return traits.select(*keys, F.explode(rows).alias("_r")).select(*keys, "_r.*")


def along_tree(edges: DataFrame, tips: DataFrame) -> DataFrame:
    """Slope, intercept, t value, p value, log-likelihood (maximum likelihood) and n of every (tree_id, fit)."""
    f = fold(edges, tips)
    rest = F.greatest(F.col("syy") - F.coalesce(F.col("slope") * F.col("sxy"), F.lit(0.0)), F.lit(0.0))
    error = F.sqrt(F.try_divide(F.try_divide(rest, F.col("n") - 2), F.col("sxx")))
    loglik = -0.5 * (F.col("n") * (F.log(F.lit(2 * np.pi)) + F.log(F.try_divide(rest, F.col("n"))) + 1) + F.col("logdet"))
    t = F.try_divide(F.col("slope"), error)
    return f.select("tree_id", "fit", "slope", "intercept", t.alias("t"), p_value(t, F.col("n") - 2).alias("p"), loglik.alias("loglik"), "n")


def residuals(edges: DataFrame, tips: DataFrame) -> DataFrame:
    """(tree_id, fit, node, residual) of y on x along the tree."""
    f = fold(edges, tips).select("tree_id", "fit", "slope", "intercept")
    return tips.join(f, ["tree_id", "fit"]).select("tree_id", "fit", "node", (F.col("y") - F.col("intercept") - F.col("slope") * F.col("x")).alias("residual"))


def sweep(trees: DataFrame, traits: DataFrame, catalogue: list[tuple[str, str, str, str | None]], group: str, least: int = 3, label: str = "ALL") -> DataFrame:
    """Every comparison for the whole and each group along every tree: (tree_id, comparison, group, slope, intercept, t, p, loglik, n).

    ``traits`` has (node, the group column, traits).  ``catalogue`` lists (comparison, x, y, given): with ``given``, x and y
    are first replaced by their residuals on that trait along the same tree, for the same rows.  Each fit takes the nodes
    that are in its tree and complete in its traits, and sees the tree pruned to them; fits of fewer than ``least`` nodes
    are left out.  Rows without a group count for the whole only.

    All fits of all trees go through one fold (and one before it, for residuals), whatever their number.
    """
    cells = []
    for comparison, x, y, given in catalogue:
        values = [F.col(c).cast("double") if c else F.lit(None).cast("double") for c in (x, y, given)]
        cells.append(F.struct(F.lit(comparison).alias("comparison"), *[v.alias(k) for k, v in zip("xyz", values, strict=True)], F.lit(given is not None).alias("given")))
    groups = F.array_compact(F.array(F.lit(label), F.col(group).cast("string")))
    rows = traits.withColumn("_group", F.explode(groups)).select("node", "_group", F.inline(F.array(*cells)))
    rows = rows.withColumns({c: finite(c) for c in "xyz"}).where("x is not null and y is not null and (z is not null or not given)")
    names = F.struct("comparison", "_group", "given")
    tips = trees.select("tree_id", F.col("child").alias("node")).distinct()
    rows = cut(rows.join(tips, "node").select("tree_id", names.alias("_name"), "node", "x", "y", "z"), "sweep-rows")
    sizes = rows.groupBy("tree_id", "_name").agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select("tree_id", "_name")
    rows = rows.join(F.broadcast(sizes) if sizes.limit(100_001).count() <= 100_000 else sizes, ["tree_id", "_name"], "left_semi")
    key = F.to_json(F.struct(F.col("_name.comparison").alias("c"), F.col("_name._group").alias("g")))
    plain = rows.where("not _name.given").select("tree_id", key.alias("fit"), "node", "x", "y")
    given = rows.where("_name.given")
    if any(g for *_, g in catalogue):
        onto = given.select("tree_id", "_name", "node", F.inline(F.array(F.struct(F.lit("x").alias("which"), F.col("x").alias("y"), F.col("z").alias("x")), F.struct(F.lit("y").alias("which"), F.col("y").alias("y"), F.col("z").alias("x")))))
        left = residuals(trees, onto.select("tree_id", F.concat(key, F.col("which")).alias("fit"), "node", "x", "y"))
        left = left.withColumns({"which": F.right("fit", F.lit(1)), "fit": F.expr("substring(fit, 1, length(fit) - 1)")})
        both = left.groupBy("tree_id", "fit", "node").agg(*[F.max(F.when(F.col("which") == c, F.col("residual"))).alias(c) for c in "xy"])
        plain = plain.unionByName(both)
    out = along_tree(trees, plain)
    parts = F.from_json("fit", "c string, g string")
    return out.withColumn("_f", parts).select("tree_id", F.col("_f.c").alias("comparison"), F.col("_f.g").alias("group"), "slope", "intercept", "t", "p", "loglik", "n")


def beta_fraction(a: np.ndarray, b: float, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    c, d = np.ones_like(x), 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < 1e-300, 1e-300, d)
    h = d.copy()
    for m in range(1, 300):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / np.where(np.abs(d) < 1e-300, 1e-300, d)
            c = 1 + top / c
            c = np.where(np.abs(c) < 1e-300, 1e-300, c)
            h = h * d * c
    return h


def student_tail(t: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Two-sided tail probability of Student's t with n degrees of freedom."""
    from math import lgamma

    a, b = n / 2, 0.5
    x = n / (n + t * t)
    front = np.exp(np.array([lgamma(v + b) - lgamma(v) - lgamma(b) for v in a]) + a * np.log(x) + b * np.log1p(-np.minimum(x, 1 - 1e-16)))
    low = x < (a + 1) / (a + b + 2)  # where the fraction converges fast; else by symmetry
    return np.where(low, front * beta_fraction(a, b, x) / a, 1 - front * _swapped(a, x) / b)


def _swapped(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.array([beta_fraction(np.array([0.5]), float(v), np.array([1 - w]))[0] for v, w in zip(a, x, strict=True)])


@F.pandas_udf(T.DoubleType())
def p_value(t, n):
    """Vectorised over Arrow batches; null t or no degree of freedom gives null."""
    import pandas as pd

    ok = (t.notna() & (n > 0)).to_numpy()
    out = np.full(len(t), np.nan)
    if ok.any():
        out[ok] = student_tail(t.to_numpy(float)[ok], n.to_numpy(float)[ok])
    return pd.Series(out).where(ok, None)
