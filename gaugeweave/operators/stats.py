"""Grouped statistics and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.nulls import log10, present
from .select import quantiles


def grouped_means(df: DataFrame, key: str | list[str], columns: list[str]) -> DataFrame:
    """Means per key, or per several factors at once."""
    return df.groupBy(*([key] if isinstance(key, str) else key)).agg(*[F.avg(present(c)).alias(c) for c in columns])


def distinct_per(df: DataFrame, key: str, column: str) -> DataFrame:
    """Rows and distinct values per key; null and blank count as one value each."""
    return df.groupBy(key).agg(F.count("*").alias("n"), F.count_distinct(F.coalesce(F.col(column), F.lit("\0null"))).alias("n_distinct"))


def distinct_overall(df: DataFrame, key: str, column: str, whole: str = "all") -> DataFrame:
    """``distinct_per`` each key, and one row over all keys; null and blank keys are one key."""
    rows = df.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias(key), column)
    return distinct_per(rows, key, column).unionByName(distinct_per(rows.withColumn(key, F.lit(whole)), key, column))


def frequencies(df: DataFrame, columns: list[str]) -> DataFrame:
    """(columns, n, share): how often each combination of values occurs, nulls as a value; the most frequent first."""
    counted = df.groupBy(*columns).agg(F.count("*").alias("n"))
    whole = counted.agg(F.sum("n").alias("_all"))
    return counted.crossJoin(F.broadcast(whole)).select(*columns, "n", (F.col("n") / F.col("_all")).alias("share")).orderBy(F.desc("n"), *columns)  # one row


def with_group_size(df: DataFrame, key: str, value: str) -> DataFrame:
    """Rows with their group's size and ends: by an aggregate and a join, so that a key may hold most rows."""
    groups = df.groupBy(key).agg(F.count("*").alias("group_n"), F.min(value).alias("group_min"), F.max(value).alias("group_max"))
    return df.join(groups.withColumnRenamed(key, "_k"), F.col(key).eqNullSafe(F.col("_k"))).drop("_k")


def members(df: DataFrame, keys: list[str], member: str) -> DataFrame:
    """(keys, member, n_members): which members each fit used, a row each, and how many; a list of them would be unbounded."""
    each = df.where(F.col(member).isNotNull()).select(*keys, member).distinct()
    return each.join(each.groupBy(*keys).agg(F.count("*").alias("n_members")), keys)


def report(df: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """(what, n): rows that meet each condition, in one pass."""
    one = df.agg(*[F.count_if(c).alias(k) for k, c in conditions.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("what"), F.col(k).alias("n")) for k in conditions])).alias("x")).select("x.*")


def envelope(df: DataFrame, keys: list[str], columns: list[str], n: str, places: int = 4) -> DataFrame:
    """Smallest and largest of each column, and the smallest n."""
    ends = [f(c).alias(f"{k}_{c}") for c in columns for k, f in (("min", F.min), ("max", F.max))]
    out = df.groupBy(*keys).agg(*ends, F.min(n).alias(f"min_{n}"))
    return out.select(*keys, *[F.round(F.col(f"{k}_{c}"), places).alias(f"{k}_{c}") for c in columns for k in ("min", "max")], f"min_{n}")


def five_numbers(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """(keys, low, q1, mid, q3, high) of each group with a value."""
    return quantiles(df, keys, column, {"low": 0.0, "q1": 0.25, "mid": 0.5, "q3": 0.75, "high": 1.0}).drop("n")


def medians(df: DataFrame, keys: list[str], column: str, name: str = "median") -> DataFrame:
    """(keys, n, name): how many values and their median, of each group with a value."""
    return quantiles(df, keys, column, {name: 0.5})


def interval(df: DataFrame, columns: list[str], low: float = 0.025, high: float = 0.975) -> DataFrame:
    """(what, low, high): percentile interval of every column over the replicates; columns without a value have none."""
    return quantiles(wide_to_long(df, [], columns), ["what"], "value", {"low": low, "high": high}).drop("n")


def histogram(df: DataFrame, column: str, low: float, width: float, bins: int, keys: tuple[str, ...] = (), logs: bool = True) -> DataFrame:
    """(keys, bin, n) with empty bins as 0; values outside the bins are left out."""
    value = log10(column) if logs else F.col(column)
    placed = df.withColumn("bin", F.floor((value - low) / width).cast("int")).where(f"bin >= 0 and bin < {bins}")
    counted = placed.groupBy(*keys, "bin").agg(F.count("*").alias("n"))
    grid = df.select(*keys).distinct() if keys else df.sparkSession.range(1).select()
    grid = grid.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return grid.join(counted, [*keys, "bin"], "left").select(*keys, "bin", F.coalesce("n", F.lit(0)).alias("n"))


def model_choice(df: DataFrame, keys: list[str], model: str, value: str, models: list[str], gap: float = 2.0) -> DataFrame:
    """Pivot the criterion by model; the best model if it leads the next by more than ``gap``, else ``none``."""
    wide = df.groupBy(*keys).pivot(model, models).agg(F.first(value))
    best = F.least(*models)
    second = F.sort_array(F.array(*models))[1]
    choice = F.lit("none")
    for m in reversed(models):
        choice = F.when((F.col(m) == best) & (second - best > gap), m).otherwise(choice)
    return wide.withColumns({"choice": choice, "lead": second - best})


def model_wins(choices: DataFrame, keys: list[str], models: list[str]) -> DataFrame:
    """(keys, model, wins, share, mean_gap) over the replicates of ``model_choice``: how often each model leads clearly, and
    how far it is from the row's best one on average.  Rows that lack a model count for none."""
    best = F.least(*models)
    each = [F.struct(F.lit(m).alias("model"), (F.col("choice") == m).alias("won"), (F.col(m) - best).alias("gap")) for m in models]
    long = choices.dropna(subset=models).select(*keys, F.inline(F.array(*each)))
    return long.groupBy(*keys, "model").agg(F.count_if("won").alias("wins"), F.avg(F.col("won").cast("double")).alias("share"), F.avg("gap").alias("mean_gap"))


def tail_share(simulated: DataFrame, observed: DataFrame, key: str, value: str) -> DataFrame:
    """Per key: share of simulated values above the smallest observed one."""
    least = observed.groupBy(key).agg(F.min(value).alias("_t"))
    return simulated.join(least, key).groupBy(key).agg(F.avg((F.col(value) > F.col("_t")).cast("double")).alias("share"))


def joint_tail_share(simulated: DataFrame, observed: DataFrame, replicate: str, key: str, value: str) -> DataFrame:
    """(n, share): of the replicates, those whose simulated values are above the smallest observed one for every key."""
    least = observed.groupBy(key).agg(F.min(value).alias("_t"))
    each = simulated.join(least, key).groupBy(replicate).agg(F.min((F.col(value) > F.col("_t")).cast("double")).alias("_all"))
    return each.agg(F.count("*").alias("n"), F.avg("_all").alias("share"))


def long_to_wide(df: DataFrame, keys: list[str], name: str, value: str, names: list[str]) -> DataFrame:
    return df.groupBy(*keys).pivot(name, names).agg(F.first(value))


def wide_to_long(df: DataFrame, keys: list[str], columns: list[str], name: str = "what", value: str = "value") -> DataFrame:
    return df.unpivot(keys, columns, name, value)


def parsed_long(df: DataFrame, keys: list[str], columns: list[str], pattern: str, parts: list[str], value: str = "value") -> DataFrame:
    """``wide_to_long``, with the groups of ``pattern`` in the columns' names as columns ``parts``; blank where it doesn't fit."""
    long = wide_to_long(df, keys, columns, "_name", value)
    return long.select(*keys, *[F.regexp_extract("_name", pattern, k).alias(p) for k, p in enumerate(parts, 1)], value)


def melted(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """(keys, place, value): a row per element of a vector, places from 0; null and empty vectors have none."""
    return df.select(*keys, F.posexplode(vector).alias("place", "value"))


def grid(df: DataFrame, columns: list[str], most: int = 10_000) -> DataFrame:
    """Every combination of the columns' distinct values that are there, nulls left out.  Raises beyond ``most`` combinations.

    Levels are few, so each column's are counted first; rows don't multiply.
    """
    levels = [df.select(c).where(F.col(c).isNotNull()).distinct() for c in columns]
    size = 1
    for level in levels:
        size *= level.limit(most + 1).count()
    if size > most:
        raise ValueError(f"more than {most} combinations")
    out = levels[0]
    for level in levels[1:]:
        out = out.crossJoin(F.broadcast(level))  # at most ``most`` rows
    return out
