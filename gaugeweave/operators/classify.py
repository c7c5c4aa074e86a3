"""Dictionary lookups and coarse-to-fine rule tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dedup import draw


def lookup(df: DataFrame, table: DataFrame, key: str, source: str, value: str, name: str) -> DataFrame:
    """``name``: the table's value for ``key`` (the smallest, if it has several), or the key itself."""
    one = table.groupBy(F.col(source).alias("_k")).agg(F.min(value).alias("_v"))
    return df.join(one, F.col(key) == F.col("_k"), "left").withColumn(name, F.coalesce("_v", key)).drop("_k", "_v")


def cascade(df: DataFrame, rules: DataFrame, ranks: list[str], states: dict[str, str], default: str, name: str) -> DataFrame:
    """Classify by rules (rank, name, state), ranks from coarse to fine; the finest rule that fits wins.

    ``states`` maps a rule's state to a class, in order of rising precedence inside a rank.  Rules are few per name: one
    row per (rank, name) is left before the joins, so rows never multiply.
    """
    order = list(states)
    known = rules.where(F.col("state").isin(order)).withColumn("_p", F.array_position(F.array(*map(F.lit, order)), F.col("state")))
    best = known.groupBy("rank", "name").agg(F.max("_p").alias("_p"))
    found: list[Column] = []
    for i, rank in enumerate(ranks):
        own = best.where(F.col("rank") == rank).select(F.col("name").alias(f"_n{i}"), F.col("_p").alias(f"_p{i}"))
        df = df.join(own, F.col(rank) == F.col(f"_n{i}"), "left").drop(f"_n{i}")
        own_class = F.lit(None).cast("string")
        for k, state in enumerate(order, 1):
            own_class = F.when(F.col(f"_p{i}") == k, states[state]).otherwise(own_class)
        found.insert(0, own_class)
    return df.withColumn(name, F.coalesce(*found, F.lit(default))).drop(*[f"_p{i}" for i in range(len(ranks))])


def overlay(df: DataFrame, marks: DataFrame, key: str, name: str, value: str, otherwise: str) -> DataFrame:
    """``name`` is ``value`` where the key is among ``marks``."""
    one = marks.select(F.col(key).alias("_k")).distinct()
    return df.join(one, F.col(key) == F.col("_k"), "left").withColumn(name, F.when(F.col("_k").isNotNull(), value).otherwise(otherwise)).drop("_k")


def finest_match(df: DataFrame, fine: DataFrame, coarse: DataFrame, fine_key: str, coarse_key: str, name: str) -> DataFrame:
    """``fine``, ``coarse`` or ``none``: which list holds the row's key."""
    a, b = fine.select(F.col(fine_key).alias("_a")).distinct(), coarse.select(F.col(coarse_key).alias("_b")).distinct()
    out = df.join(a, F.col(fine_key) == F.col("_a"), "left").join(b, F.col(coarse_key) == F.col("_b"), "left")
    return out.withColumn(name, F.when(F.col("_a").isNotNull(), "fine").when(F.col("_b").isNotNull(), "coarse").otherwise("none")).drop("_a", "_b")


def paired(left: DataFrame, right: DataFrame, key: str, id_col: str, left_values: list[str], right_values: list[str], seed: int) -> DataFrame:
    """Best-effort pairs of two data sets by a shared key: rows complete in their values, one of each key and side, joined.

    The row of a key is drawn by a hash of seed and id; blank keys don't pair.  One row per key is left by an aggregate
    before the join, so that rows never multiply.
    """
    def one(df: DataFrame, values: list[str]) -> DataFrame:
        whole = df.where(F.coalesce(F.col(key), F.lit("")) != "").dropna(subset=values)
        return whole.groupBy(key).agg(F.min_by(F.struct(*values), draw(id_col, seed)).alias("_v")).select(key, "_v.*")

    return one(left, left_values).join(one(right, right_values), key)


def counts_by_rank(df: DataFrame, ranks: list[str], totals: DataFrame) -> DataFrame:
    """(rank, taxon, n) over all rank columns at once, with the external totals (rank, taxon, total) where known."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(r).alias("rank"), F.col(r).cast("string").alias("taxon")) for r in ranks])).alias("x")).select("x.*")
    counted = long.where(F.coalesce("taxon", F.lit("")) != "").groupBy("rank", "taxon").agg(F.count("*").alias("n"))
    return counted.join(totals.select("rank", "taxon", "total"), ["rank", "taxon"], "left")


def lineage_counts(df: DataFrame, ranks: list[str], tip: str, totals: DataFrame) -> DataFrame:
    """(rank, taxon, parent_rank, parent, parents, n, tips, total) of every taxon in the rank columns, coarse to fine.

    ``n`` counts records, ``tips`` different values of ``tip`` below the taxon.  A record's parent of a taxon is its nearest
    filled coarser rank; blank and null ranks are gaps.  ``parents`` counts the different ones: above 1 is a conflict, of
    which the parent of most records is taken (of equal ones the smallest).  ``totals`` has (rank, taxon, total).
    """
    filled = [F.when(F.trim(F.col(r).cast("string")) != "", F.col(r).cast("string")) for r in ranks]
    rows = []
    for i, rank in enumerate(ranks):
        above = F.coalesce(*[F.when(filled[k].isNotNull(), F.struct(F.lit(ranks[k]).alias("rank"), filled[k].alias("taxon"))) for k in reversed(range(i))]) if i else F.lit(None).cast("struct<rank:string,taxon:string>")
        rows.append(F.struct(F.lit(rank).alias("rank"), filled[i].alias("taxon"), above.alias("up")))
    long = df.select(F.col(tip).alias("_tip"), F.inline(F.array(*rows))).where("taxon is not null")
    # By parent and tip first, so that a taxon may hold most records.
    by_tip = long.groupBy("rank", "taxon", "up", "_tip").agg(F.count("*").alias("_n"))
    by_parent = by_tip.groupBy("rank", "taxon", "up").agg(F.sum("_n").alias("_n"))
    order = F.struct(F.col("up").isNotNull(), F.col("_n"))
    most = by_parent.groupBy("rank", "taxon").agg(F.max(order).alias("_most"), F.count("up").alias("parents"), F.sum("_n").alias("n"))
    chosen = by_parent.withColumn("_o", order).join(most, ["rank", "taxon"]).where("_o = _most").groupBy("rank", "taxon", "parents", "n").agg(F.min("up").alias("up"))
    tips = by_tip.groupBy("rank", "taxon").agg(F.count_distinct("_tip").alias("tips"))
    out = chosen.join(tips, ["rank", "taxon"]).join(totals.select("rank", "taxon", "total"), ["rank", "taxon"], "left")
    return out.select("rank", "taxon", F.col("up.rank").alias("parent_rank"), F.col("up.taxon").alias("parent"), "parents", "n", "tips", "total")


def sorted_taxa(df: DataFrame, ranks: list[str]) -> DataFrame:
    """(taxon): the different names of all rank columns, sorted."""
    return df.select(F.explode(F.array(*[F.col(r).cast("string") for r in ranks])).alias("taxon")).where("trim(taxon) <> ''").distinct().orderBy("taxon")
