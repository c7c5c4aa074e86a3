"""Reports over several tables, and the joins that set tables side by side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def progress(references: DataFrame, examined: DataFrame, entries: DataFrame, key: str, status: str, genus: str, species: str, total: str = "total") -> DataFrame:
    """One row of text counts per ``key``, and one of totals.

    References, examined ones, those without access (``#NO`` in the status), those kept for later (``#KP``), the good rest,
    entries, distinct genera and distinct full names (joined without a space).  Totals add up the keys' own counts, so a
    genus under two keys counts twice.  A key that one table lacks has ``-`` there.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    a = references.groupBy(key).agg(F.count("*").alias("refs"))
    b = examined.groupBy(key).agg(F.count("*").alias("examined"), F.count_if(text(status).contains("#NO")).alias("no_access"), F.count_if(text(status).contains("#KP")).alias("kept"))
    b = b.withColumn("good", F.col("examined") - F.col("no_access") - F.col("kept"))
    c = entries.groupBy(key).agg(F.count("*").alias("entries"), F.count_distinct(text(genus)).alias("genera"), F.count_distinct(F.concat(text(genus), text(species))).alias("species"))
    wide = a.join(b, key, "full_outer").join(c, key, "full_outer")
    counts = [x for x in wide.columns if x != key]
    sums = wide.agg(*[F.sum(x).alias(x) for x in counts]).select(F.lit(total).alias(key), *counts)
    return wide.unionByName(sums).select(key, *[F.coalesce(F.col(x).cast("string"), F.lit("-")).alias(x) for x in counts])


def distinct_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """(what, n): distinct values of every column; null and blank count as one."""
    one = df.agg(*[F.count_distinct(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) for c in columns])
    return one.unpivot([], columns, "what", "n")


def side_by_side(left: DataFrame, right: DataFrame, keys: list[str], values: list[str], names: tuple[str, str], how: str = "left") -> DataFrame:
    """The same values of two results next to each other, each with its result's name in front."""
    sides = [t.select(*keys, *[F.col(v).alias(f"{n}_{v}") for v in values]) for t, n in zip((left, right), names, strict=True)]
    return sides[0].join(sides[1], keys, how)


def three_states(first: DataFrame, second: DataFrame, key: str, state: str, derived: int = 2, fan_out: bool = False) -> DataFrame:
    """``first`` with ``second``'s state: derived in the first gives ``derived``, else derived in the second one more, else 1.

    A key that repeats in ``second`` counts once, as derived if any of its rows is; with ``fan_out``, rows multiply.
    """
    other = second.select(key, F.col(state).alias("_second"))
    if not fan_out:
        other = other.groupBy(key).agg(F.max("_second").alias("_second"))
    own = F.col(state) == derived
    joined = first.join(other, key, "left")
    whole: Column = F.when(own, derived).when(F.col("_second") == derived, derived + 1).otherwise(1)
    return joined.withColumn(state, whole).drop("_second")


def with_groups(df: DataFrame, groups: DataFrame, key: str, fan_out: bool = False) -> DataFrame:
    """Rows with the columns of ``groups``, one row per key taken (the smallest); with ``fan_out``, every row of it."""
    if not fan_out:
        rest = [c for c in groups.columns if c != key]
        groups = groups.groupBy(key).agg(F.min(F.struct(*rest)).alias("_g")).select(key, "_g.*")
    return df.join(groups, key, "left")


def nodes_with_tips(nodes: DataFrame, tips: DataFrame, label: str) -> DataFrame:
    """All nodes and all tip data by label; what one side lacks is null."""
    return nodes.join(tips, label, "full_outer")
