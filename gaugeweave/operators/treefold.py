"""The fold over trees that regressions need: sums of every fit along every tree, from the tips to their last common ancestor.

One meaning at every size: trees that fit a task are folded there, larger ones in a round of joins per level, and both
start from the same checked rows (``sound``, ``sound_tips``).
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut, forget
from ..functions.nulls import finite
from .hierarchy import heights, sound

#: Stands for an edge of length 0, whose weight would be infinite.
FLOOR = 1e-9

SUMS = "slope double, intercept double, sxx double, sxy double, syy double, logdet double, n int"
NAMES = [c.split()[0] for c in SUMS.split(", ")]


def sound_tips(tips: DataFrame) -> DataFrame:
    """(tree_id, fit, node, x, y) with finite values only; several rows of a node in a fit raise when the job runs."""
    rows = tips.select("tree_id", "fit", "node", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    rows = rows.withColumns({"x": finite("x"), "y": finite("y")}).dropna(subset=["tree_id", "node", "x", "y"])
    one = rows.groupBy("tree_id", "fit", "node").agg(F.count("*").alias("_n"), F.first("x").alias("x"), F.first("y").alias("y"))
    wrong = F.raise_error(F.concat(F.lit("a fit has several rows of node "), F.col("node").cast("string")))
    return one.select("tree_id", "fit", "node", F.when(F.col("_n") == 1, F.col("x")).otherwise(wrong).alias("x"), "y")


def fold(edges: DataFrame, tips: DataFrame, most: int = 500_000, per_task: int = 200_000) -> DataFrame:
    """Regression sums of every fit (tree_id, fit): (slope, intercept, sxx, sxy, syy, logdet, n) along the tree.

    ``tips`` has (tree_id, fit, node, x, y).  A node's children i weigh 1 / v_i; their weighted means go up with the
    node's own edge plus 1 / (sum of weights); the squares around the means add up (independent contrasts, Felsenstein
    1985).  Each fit sees the tree pruned to its own nodes, whose root is their last common ancestor.

    Data on an inner node are a tip below it at length 0 (FLOOR).  Values that are null, NaN or infinite are missing; nodes
    that the tree lacks are left out; a fit without data has no row.  Edges that repeat are one; two parents of a node, two
    rows of a node in a fit, a cycle, and a fit whose nodes have no common ancestor raise.

    Trees of more than ``most`` edges take a round of joins per level, all of them together.  The others go to tasks by
    their measured size: small ones share a task of about ``per_task`` rows, and the fits of a tree with many rows are
    spread over tasks, each with the tree's edges.
    """
    return fold_each(sound(edges), tips, [F.col("length")], most, per_task).drop("variant")


def fold_each(edges: DataFrame, tips: DataFrame, lengths: list[Column], most: int = 500_000, per_task: int = 200_000) -> DataFrame:
    """``fold`` along the same trees for several lengths of every edge: (tree_id, fit, variant, sums), variants from 0.

    ``edges`` are sound and hold what ``lengths`` are made from; a length that is null, NaN or below 0 counts as 0.
    """
    edges, tips = cut(edges, "edges"), cut(sound_tips(tips), "tips")
    lengths = [F.greatest(F.coalesce(F.when(~F.isnan(c), c), F.lit(0.0)), F.lit(FLOOR)) for c in lengths]
    sizes = edges.groupBy("tree_id").agg(F.count("*").alias("_e")).join(tips.groupBy("tree_id").agg(F.count("*").alias("_t")), "tree_id")
    sizes = cut(sizes, "tree-sizes")
    small = F.col("_e") + F.col("_t") < per_task
    bundles = sizes.where(small).agg(F.coalesce(F.sum(F.col("_e") + F.col("_t")), F.lit(0))).first()[0] // per_task + 1
    parts = F.when(small, 1).otherwise(F.greatest(F.lit(1), F.ceil(F.col("_t") / F.greatest(4 * F.col("_e"), F.lit(per_task))))).cast("int")
    deal = sizes.where(F.col("_e") <= most).select("tree_id", small.alias("_small"), parts.alias("_parts"))
    task = F.when(F.col("_small"), F.pmod(F.xxhash64("tree_id"), F.lit(bundles))).otherwise(F.xxhash64("tree_id", "_part"))
    near_edges = edges.join(deal, "tree_id").withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).select("tree_id", "parent", "child", *[c.alias(f"_v{i}") for i, c in enumerate(lengths)], task.alias("_task"))
    near_tips = tips.join(deal, "tree_id").withColumn("_part", F.pmod(F.xxhash64("fit"), F.col("_parts")).cast("int")).select("tree_id", "fit", "node", "x", "y", task.alias("_task"))
    kind = dict(tips.dtypes)
    schema = f"tree_id {kind['tree_id']}, fit {kind['fit']}, variant int, {SUMS}"
    out = near_edges.groupBy("_task").cogroup(near_tips.groupBy("_task")).applyInPandas(_folded, schema)
    large = sizes.where(F.col("_e") > most).select("tree_id")
    if large.isEmpty():
        return out
    return out.unionByName(_by_levels(edges.join(large, "tree_id", "left_semi"), tips.join(large, "tree_id", "left_semi"), lengths))


def _folded(edges: pd.DataFrame, tips: pd.DataFrame) -> pd.DataFrame:
    """The fits of the trees of a task."""
    of_tree = dict(list(tips.groupby("tree_id", sort=False)))
    rows = [row for tree, own in edges.groupby("tree_id", sort=False) if tree in of_tree for row in _of_tree(tree, own, of_tree[tree])]
    return pd.DataFrame(rows, columns=["tree_id", "fit", "variant", *NAMES])


def _of_tree(tree, edges: pd.DataFrame, tips: pd.DataFrame) -> Iterator[tuple]:
    """The fits of one tree, level by level from the tips."""
    names = pd.unique(pd.concat([edges["parent"], edges["child"]], ignore_index=True))
    place = pd.Series(np.arange(len(names)), index=names)
    tips = tips[tips["node"].isin(place.index)]
    parent, child = place[edges["parent"]].to_numpy(), place[edges["child"]].to_numpy()
    at = place[tips["node"]].to_numpy()
    inner = np.intersect1d(at, parent)  # data there hang below, on a tip of their own
    hung = pd.Series(len(names) + np.arange(len(inner)), index=inner)
    at = np.where(np.isin(at, inner), hung.reindex(at).fillna(-1).to_numpy(int), at)
    n = len(names) + len(inner)
    up = np.full(n, -1)
    up[child] = parent
    up[len(names) :] = inner
    levels, kids = _levels(up)
    codes, fits = pd.factorize(tips["fit"], use_na_sentinel=False)
    by_fit = np.split(np.argsort(codes, kind="stable"), np.cumsum(np.bincount(codes, minlength=len(fits)))[:-1])
    variants = [c for c in edges.columns if c.startswith("_v")]
    for (fit, k), (variant, column) in itertools.product(zip(fits, by_fit, strict=len(fits) > 0), enumerate(variants)):
        here, total, own = at[k], len(k), np.full(n, FLOOR)
        own[child] = edges[column].to_numpy(float)
        x, y, v = np.zeros(n), np.zeros(n), own.copy()
        sxx, sxy, syy, logs, count = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n, int)
        x[here], y[here], count[here] = tips["x"].to_numpy()[k], tips["y"].to_numpy()[k], 1
        for nodes, below in zip(levels, kids, strict=True):
            below = below[count[below] > 0]
            if not len(below):
                continue
            to, z = np.searchsorted(nodes, up[below]), 1 / v[below]
            add = lambda values, to=to, nodes=nodes: np.bincount(to, values, len(nodes))
            w = add(z)
            there = w > 0
            nodes, at_node = nodes[there], np.cumsum(there) - 1
            to, w = at_node[to], w[there]
            add = lambda values, to=to, nodes=nodes: np.bincount(to, values, len(nodes))
            x[nodes], y[nodes] = add(z * x[below]) / w, add(z * y[below]) / w
            dx, dy = x[below] - x[nodes][to], y[below] - y[nodes][to]
            sxx[nodes], sxy[nodes], syy[nodes] = add(sxx[below] + z * dx * dx), add(sxy[below] + z * dx * dy), add(syy[below] + z * dy * dy)
            logs[nodes] = add(logs[below] + np.log(v[below])) + np.log(w)
            count[nodes] = add(count[below])
            v[nodes] = own[nodes] + 1 / w
            top = np.flatnonzero(count[nodes] == total)
            if len(top):
                r = nodes[top[0]]
                slope = sxy[r] / sxx[r] if sxx[r] else None
                yield tree, None if fit != fit else fit, variant, slope, None if slope is None else y[r] - slope * x[r], sxx[r], sxy[r], syy[r], logs[r] - np.log(w[top[0]]), total
                break
        else:
            raise ValueError(f"the nodes of a fit of tree {tree} have no common ancestor")


def _levels(up: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Inner nodes by height from 1, sorted, and the children of each height's nodes; raises on a cycle."""
    open_children = np.bincount(up[up >= 0], minlength=len(up))
    height = np.full(len(up), -1)
    level = np.flatnonzero(open_children == 0)
    done, h = 0, 0
    while len(level):
        height[level] = h
        done, h = done + len(level), h + 1
        above, gone = np.unique(up[level][up[level] >= 0], return_counts=True)
        open_children[above] -= gone
        level = above[open_children[above] == 0]
    if done < len(up):
        raise ValueError(f"{len(up) - done} nodes are on or above a cycle")
    by_height = np.argsort(height, kind="stable")
    first = np.searchsorted(height[by_height], np.arange(1, h + 1))
    child = np.flatnonzero(up >= 0)
    child = child[np.argsort(height[up[child]], kind="stable")]
    begin = np.searchsorted(height[up[child]], np.arange(1, h + 1))
    return [by_height[a:b] for a, b in zip(first[:-1], first[1:], strict=True)], [child[a:b] for a, b in zip(begin[:-1], begin[1:], strict=True)]


#: What a round of ``_by_levels`` carries for every variant.
STATE = ["x", "y", "v", "sxx", "sxy", "syy", "logdet"]


def _merged(rows: DataFrame, keys: list[str], variants: int) -> DataFrame:
    """Rows of a key as one: weighted means, squares around them, and weight (``v``) of every variant; ``n`` adds up.

    ``rows`` hold arrays of STATE by variant.  The result stands for a child at length 0: it weighs as much as its rows.
    Means first, then squares around them, as sums of squares less the mean's would cancel.
    """
    at = lambda c, i: F.col(c)[i]
    w = lambda i: 1 / at("v", i)
    each = range(variants)
    mean = rows.groupBy(*keys).agg(F.sum("n").alias("_n"), *[s for i in each for s in (F.sum(w(i)).alias(f"_w{i}"), F.sum(w(i) * at("x", i)).alias(f"_x{i}"), F.sum(w(i) * at("y", i)).alias(f"_y{i}"))])
    mean = mean.select(*keys, "_n", *[s for i in each for s in (f"_w{i}", (F.col(f"_x{i}") / F.col(f"_w{i}")).alias(f"_x{i}"), (F.col(f"_y{i}") / F.col(f"_w{i}")).alias(f"_y{i}"))])
    dx, dy = (lambda i: at("x", i) - F.col(f"_x{i}")), (lambda i: at("y", i) - F.col(f"_y{i}"))
    squares = [s for i in each for s in (
        F.sum(at("sxx", i) + w(i) * dx(i) * dx(i)).alias(f"_xx{i}"), F.sum(at("sxy", i) + w(i) * dx(i) * dy(i)).alias(f"_xy{i}"),
        F.sum(at("syy", i) + w(i) * dy(i) * dy(i)).alias(f"_yy{i}"), F.sum(at("logdet", i) + F.log(at("v", i))).alias(f"_log{i}"))]
    means = [F.first(f"_{c}{i}").alias(f"_{c}{i}") for i in each for c in "wxy"]
    sums = rows.join(mean, keys).groupBy(*keys).agg(F.first("_n").cast("int").alias("n"), *means, *squares)
    array = lambda make: F.array(*[make(i) for i in each])
    of = lambda name: lambda i: F.col(f"_{name}{i}")
    made = {"x": of("x"), "y": of("y"), "v": lambda i: 1 / F.col(f"_w{i}"), "sxx": of("xx"), "sxy": of("xy"), "syy": of("yy"), "logdet": lambda i: F.col(f"_log{i}") + F.log(f"_w{i}")}
    return sums.select(*keys, "n", *[array(make).alias(c) for c, make in made.items()])


def _by_levels(edges: DataFrame, tips: DataFrame, lengths: list[Column]) -> DataFrame:
    """``fold_each`` over trees of any size: tips merge at the node they hang on, then a round per level over the merged rows alone.

    Families of bounded size meet in a task as they are; larger ones are added up before they are moved.
    """
    variants, keys = len(lengths), ["tree_id", "_fit", "node"]
    edges = cut(edges, "edges")
    high = cut(heights(edges), "heights")
    inner = cut(high.where("height > 0").withColumnRenamed("height", "to"), "inner")
    nodes = edges.withColumnRenamed("child", "node").unionByName(inner.join(edges.select("tree_id", F.col("child").alias("node")), ["tree_id", "node"], "left_anti").select("tree_id", "node"), allowMissingColumns=True)
    nodes = nodes.join(inner.select("tree_id", "node", F.lit(True).alias("_inner")), ["tree_id", "node"], "left")
    known = tips.join(nodes, ["tree_id", "node"]).withColumn("node", F.when(F.col("_inner"), F.col("node")).otherwise(F.col("parent")))
    known = known.withColumn("_fit", F.struct("fit")).drop("fit", "parent")  # a struct is never null, so keys are plain
    widest = edges.groupBy("tree_id", "parent").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if widest < 100_000:
        known = known.repartition(*keys)
    all_of = lambda c: F.array(*[c] * variants)
    zero = [all_of(F.lit(0.0)).alias(c) for c in ("sxx", "sxy", "syy", "logdet")]
    v = F.array(*[F.when(F.col("_inner"), F.lit(FLOOR)).otherwise(c) for c in lengths])
    start = cut(_merged(known.select(*keys, all_of(F.col("x")).alias("x"), all_of(F.col("y")).alias("y"), v.alias("v"), *zero, F.lit(1).alias("n")), keys, variants).join(inner, ["tree_id", "node"]), "fold")
    total = cut(start.groupBy("tree_id", "_fit").agg(F.sum("n").cast("int").alias("total")), "fold-totals")
    above = edges.select("tree_id", F.col("child").alias("node"), "parent", F.array(*lengths).alias("_own")).join(inner.select("tree_id", "node"), ["tree_id", "node"], "left_semi")
    above = cut(above.join(inner.withColumnRenamed("node", "parent"), ["tree_id", "parent"]), "above")
    state = ["tree_id", "_fit", "node", "to", "n", *STATE]
    waiting, done = [start.select(*state)], []
    for h in range(1, (inner.agg(F.max("to")).first()[0] or 0) + 1):
        now = functools.reduce(DataFrame.unionByName, [w.where(F.col("to") == h) for w in waiting])
        joined = cut(_merged(now, keys, variants).join(total, ["tree_id", "_fit"]).join(above, ["tree_id", "node"], "left"), "fold")
        whole = F.col("n") == F.col("total")
        done.append(joined.where(whole | F.col("parent").isNull()).drop("_own", "to", "parent"))
        onward = joined.where(~whole & F.col("parent").isNotNull()).drop("node", "total").withColumnRenamed("parent", "node")
        waiting.append(onward.withColumn("v", F.zip_with("v", "_own", lambda a, b: a + b)).select(*state))
        if len(waiting) > 16:  # rows that still wait, and fits that are done, as one table each
            left = cut(functools.reduce(DataFrame.unionByName, waiting).where(F.col("to") > h), "fold")
            forget(waiting[0])
            waiting, done = [left], [cut(functools.reduce(DataFrame.unionByName, done), "folded")]
    apart = F.raise_error(F.concat(F.lit("no common ancestor of the nodes of a fit of tree "), F.col("tree_id").cast("string")))
    out = functools.reduce(DataFrame.unionByName, done).withColumn("n", F.when(F.col("n") == F.col("total"), F.col("n")).otherwise(apart))
    out = out.select("tree_id", "_fit.fit", "n", F.posexplode(F.arrays_zip(*STATE)).alias("variant", "_s")).select("tree_id", "fit", "n", "variant", "_s.*")
    slope = F.try_divide(F.col("sxy"), F.col("sxx"))
    return out.select("tree_id", "fit", "variant", slope.alias("slope"), (F.col("y") - slope * F.col("x")).alias("intercept"), "sxx", "sxy", "syy", (F.col("logdet") + F.log("v")).alias("logdet"), "n")
