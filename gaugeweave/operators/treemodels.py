"""Models of change along trees as transformed edge lengths, and the choice among them by likelihood."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut
from .hierarchy import climbed, sound, tips_of
from .treefold import fold_each


def depths(edges: DataFrame) -> DataFrame:
    """``edges`` with ``top`` and ``bottom``, the distances of parent and child from the root, and ``deepest``, the tree's largest."""
    edges = cut(sound(edges), "edges")
    far = cut(climbed(edges).select("tree_id", F.col("node").alias("child"), F.col("distance").alias("bottom")), "depths")
    most = far.groupBy("tree_id").agg(F.max("bottom").alias("deepest"))
    return edges.join(far, ["tree_id", "child"]).withColumn("top", F.col("bottom") - F.col("length")).join(most, "tree_id")


def accelerated(edges: DataFrame, rate: float = 1.3) -> DataFrame:
    """Accelerating (rate < 1) or slowing change: distances d from the root become d ** (1 / rate)."""
    end = lambda c: F.pow(F.greatest(F.col(c), F.lit(0.0)), F.lit(1 / rate))
    return depths(edges).select("tree_id", "parent", "child", (end("bottom") - end("top")).alias("length"))


def _length(model: Column, value: Column) -> Column:
    """An edge's length under a model and its parameter.

    ``lambda`` scales all but the tips' own share; ``early`` lets the rate change as exp(value * distance); ``pull`` draws
    to one optimum with strength value, for trees whose tips lie equally deep.
    """
    top, bottom, deepest, length = (F.col(c) for c in ("top", "bottom", "deepest", "length"))
    scaled = F.when(F.col("_tip"), bottom - value * top).otherwise(value * length)
    early = F.when(value == 0, length).otherwise((F.exp(value * bottom) - F.exp(value * top)) / value)
    pull = F.when(value == 0, length).otherwise((F.exp(-2 * value * (deepest - bottom)) - F.exp(-2 * value * (deepest - top))) / (2 * value))
    return F.when(model == "lambda", scaled).when(model == "early", early).when(model == "pull", pull).otherwise(length)


def model_fits(edges: DataFrame, traits: DataFrame, grids: dict[str, list[float]]) -> DataFrame:
    """(tree_id, trait, model, value, loglik, aicc, n) of ``traits`` (tree_id, trait, node, y).

    ``brownian`` and ``white`` (no tree) are always fitted; ``grids`` lists the values tried for ``lambda``, ``early`` and
    ``pull``.  Every (model, value) is a variant of the edges' lengths, and one fold serves all of them.  Mean and variance
    are at their maximum likelihood; the variance and a grid's value count as parameters.
    """
    tried = [("brownian", 0.0), *[(m, float(v)) for m, values in grids.items() for v in values]]
    tips = tips_of(edges).select("tree_id", F.col("node").alias("child"), F.lit(True).alias("_tip"))
    long = depths(edges).join(tips, ["tree_id", "child"], "left").withColumn("_tip", F.coalesce("_tip", F.lit(False)))
    known = traits.where("y is not null")
    rows = known.select("tree_id", F.col("trait").alias("fit"), "node", F.lit(0.0).alias("x"), F.col("y").cast("double").alias("y"))
    named = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(v).alias("value")) for m, v in tried])[F.col("variant")]
    sums = fold_each(long, rows, [_length(F.lit(m), F.lit(v)) for m, v in tried]).withColumn("_m", named).select("tree_id", F.col("fit").alias("trait"), "_m.model", "_m.value", "syy", "logdet", "n")
    white = known.groupBy("tree_id", "trait").agg((F.var_pop("y") * F.count("*")).alias("syy"), F.count("*").alias("n"))
    white = white.select("tree_id", "trait", F.lit("white").alias("model"), F.lit(0.0).alias("value"), "syy", F.lit(0.0).alias("logdet"), "n")
    both = sums.select("tree_id", "trait", "model", "value", "syy", "logdet", "n").unionByName(white)
    n = F.col("n")
    loglik = -0.5 * (n * (math.log(2 * math.pi) + F.log(F.try_divide("syy", n)) + 1) + F.col("logdet"))
    k = F.when(F.col("model").isin("brownian", "white"), 2).otherwise(3)
    aicc = 2 * k - 2 * F.col("loglik") + F.try_divide(2 * k * (k + 1), n - k - 1)
    return both.withColumn("loglik", loglik).select("tree_id", "trait", "model", "value", "loglik", aicc.alias("aicc"), "n")


def best_models(fits: DataFrame) -> DataFrame:
    """Of each (tree_id, trait) the fit with the smallest criterion; fits without one don't count."""
    rank = F.struct("aicc", "model", "value")
    return fits.where("aicc is not null").groupBy("tree_id", "trait").agg(F.min(F.struct(rank.alias("r"), "loglik")).alias("b")).select("tree_id", "trait", F.col("b.r.model").alias("model"), F.col("b.r.value").alias("value"), F.col("b.loglik").alias("loglik"), F.col("b.r.aicc").alias("aicc"))
