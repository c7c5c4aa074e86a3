"""Mixing sources to target weights by systematic sampling.

Within each source, documents lie in order of size; each expects target / source size copies.  These expectations are
summed along the order, one offset is added, and a document is emitted once per integer boundary that its stretch
crosses.  As neighbours are alike in size, a source's taken words miss its target by about one document.

Defined results: null and empty texts have size 0 and share the same expectation; a null source is a source of its own,
last in order; repeated rows are documents of their own; a source without words has target 0 and emits nothing; an empty
table gives an empty table; further columns are untouched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, rank_within, words_of


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), factor: float = 1.5, most: int = 2) -> DataFrame:
    """Targets of each ``_key`` from ``source_size``: ``factor`` times all sizes, shared by the weights, repeating in key order.

    No target is above ``most`` times its source's size; what that frees is shared among the others by weight until
    none is above.  The level of this filling is where, in order of cap / weight, the rest would stay below its caps.
    One row per source goes through these windows, none per document.
    """
    by_key = Window.orderBy("_key")
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_key) - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("_w", weight.cast("long")).withColumn("_cap", F.lit(most) * F.col("source_size"))
    w = Window.orderBy(F.col("_cap") / F.col("_w"), "_key")
    whole = Window.partitionBy()
    s = s.withColumns({
        "_caps": F.coalesce(F.sum("_cap").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "_rest": F.sum("_w").over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
        "_all": F.lit(float(factor)) * F.sum("source_size").over(whole),
    })
    s = s.withColumn("_level", (F.col("_all") - F.col("_caps")) / F.col("_rest"))
    fits = F.col("_level") * F.col("_w") <= F.col("_cap")
    s = s.withColumn("_level", F.min_by(F.when(fits, F.col("_level")), F.when(fits, F.col("_caps"))).over(whole))
    target = F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.col("_level") * F.col("_w")).otherwise(F.col("_cap").cast("double"))
    return s.select("_key", "source_size", target.alias("target"))


def offset_of(key, seed: int):
    """The source's one random offset in [0, 1), the same on every run."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}/"), key)), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def mix_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7, **shares) -> DataFrame:
    """One row per document: its id, size, source_size, target, copies, taken (copies * size)."""
    key = F.when(F.col(source_col).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(source_col)))  # code points, null last
    narrow = cut(docs.select(F.col(id_col), words_of(text_col).alias("size"), key.alias("_key")), "mix-sizes")
    targets = source_targets(narrow.groupBy("_key").agg(F.sum("size").alias("source_size")), **shares)
    ranked = rank_within(narrow, "_key", ["size", id_col], "mix-order").join(targets, "_key")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    ranked = ranked.withColumns({"_rate": rate, "_u": offset_of(F.col("_key"), seed)})
    at = lambda rank: F.floor(rank * F.col("_rate") + F.col("_u"))
    ranked = ranked.withColumn("copies", (at(F.col("_rank").cast("double")) - at((F.col("_rank") - 1).cast("double"))).cast("long"))
    return ranked.select(id_col, "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken.  Rows that repeat an id each get the largest of its counts."""
    counts = mix_counts(docs, id_col, text_col, **options).where("copies > 0").groupBy(F.col(id_col).alias("_gw_id")).agg(F.max("copies").cast("int").alias("_gw_copies"))
    taken = docs.join(counts, F.col(id_col).eqNullSafe(F.col("_gw_id")))
    return taken.withColumn("_gw_copy", F.explode(F.sequence(F.lit(1), F.col("_gw_copies")))).select(*docs.columns)
