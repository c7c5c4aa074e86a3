"""Repeated observations, ranks and reproducible samples: a hash of seed and id stands for the random draw."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..functions.nulls import poisoned
from .keys import numbered
from .select import at_ranks


def draw(id_col: str, seed: int) -> Column:
    """A fixed pseudo-random order; md5, so that other engines can repeat it."""
    return F.md5(F.concat(F.lit(f"{seed}/"), F.col(id_col).cast("string")))


def first_per(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """One row per key.  Groups are names or ranks; ties are settled by the order given."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_r = 1").drop("_r")


def random_per(df: DataFrame, key: str, id_col: str, seed: int) -> DataFrame:
    """One row per key, by an aggregate: a key may hold most rows.  Equal draws are settled by the other columns."""
    rest = [c for c in df.columns if c != key]
    drawn = df.groupBy(key).agg(F.min(F.struct(draw(id_col, seed).alias("_d"), *rest)).alias("_r"))
    return drawn.select(*[F.col(c) if c == key else F.col(f"_r.{c}").alias(c) for c in df.columns])


def sample_fraction(df: DataFrame, key: str, id_col: str, share: float, seed: int) -> DataFrame:
    """The rounded share of each key's rows: those whose draw is at most the key's k-th smallest; rows of one id go together."""
    drawn = df.withColumn("_d", draw(id_col, seed))
    least = at_ranks(drawn, [key], "_d", lambda n: {"_limit": F.round(n * share) - 1}).select(F.col(key).alias("_k"), "_limit")
    rows = drawn.join(least, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_d") <= F.col("_limit")), "left_semi")
    return rows.drop("_d")


def repeats(df: DataFrame, name: str, value: str, tolerance: float = 1e-6) -> DataFrame:
    """Names with several rows whose values spread less than the tolerance; a null value leaves the name alone."""
    spread = poisoned(F.max(value) - F.min(value), value)
    return df.groupBy(name).agg(spread.alias("_s"), F.count("*").alias("_n")).where((F.col("_n") > 1) & (F.col("_s") < tolerance)).select(name)


def newest_of_repeats(df: DataFrame, name: str, value: str, year: str, id_col: str) -> DataFrame:
    """Of repeats keep the newest row (no year last, then smallest id); all other rows stay.

    By aggregates and joins, as a name may have most rows; of rows equal in year and id the least by their other columns.
    """
    again = df.join(repeats(df, name, value), name, "left_semi")
    last = again.groupBy(F.col(name).alias("_name")).agg(F.max(year).alias("_year"))
    newest = again.join(last, (F.col(name) == F.col("_name")) & F.col(year).eqNullSafe(F.col("_year"))).select(*df.columns)
    rest = [c for c in df.columns if c not in (name, id_col)]
    kept = newest.groupBy(name).agg(F.min(F.struct(id_col, *rest)).alias("_r")).select(*[F.col(c) if c == name else F.col(f"_r.{c}").alias(c) for c in df.columns])
    return df.join(again.select(name).distinct(), name, "left_anti").select(*df.columns).unionByName(kept)


def repeat_split(df: DataFrame, name: str, value: str, tolerance: float = 1e-6) -> DataFrame:
    """How many names with several rows repeat one value, and how many hold independent ones."""
    spread = df.groupBy(name).agg((F.max(value) - F.min(value)).alias("_s"), F.count("*").alias("_n")).where("_n > 1")
    return spread.agg(F.count_if(F.col("_s") < tolerance).alias("repeated"), F.count_if(F.col("_s") > tolerance).alias("independent"))


def level_codes(df: DataFrame, column: str, name: str) -> DataFrame:
    """1, 2, ... in the order of the sorted distinct values; numbered by ranges, so there may be any number of them."""
    levels = cut(df.select(column).where(F.col(column).isNotNull()).distinct(), "levels")
    none = levels.limit(0).select(F.lit(0).alias("_id"))
    return df.join(numbered(levels, [column], none, "_id", name), column, "left")
