"""Derived measures and the filters around them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.nulls import all_present, col, finite, log10, present, ratio, root
from .select import quantiles


def estimate(mean, low, high, point) -> Column:
    """The mean; else the midpoint where a minimum is there (null without a maximum); else the single value."""
    mean, low, high, point = map(col, (mean, low, high, point))
    return F.when(mean.isNotNull(), mean).when(low.isNotNull(), high - (high - low) / 2).otherwise(point)


def axes(width, breadth) -> tuple[Column, Column]:
    """The larger of width and breadth, and the smaller one if breadth was measured."""
    width, breadth = col(width), col(breadth)
    return F.greatest(width, breadth), F.when(breadth.isNotNull(), F.least(width, breadth))


def widest(width, first, middle, third) -> Column:
    """The largest of three sections if the first is there (null if another is missing), else the width."""
    first = col(first)
    return F.when(first.isNotNull(), F.when(all_present(first, middle, third), F.greatest(first, col(middle), col(third)))).otherwise(col(width))


def ellipsoid_volume(reported, length, width, third) -> Column:
    """The reported volume; else of an ellipsoid of three axes; else of one turned around its length."""
    length, width, third = map(col, (length, width, third))
    unit = F.lit(4 / 3 * math.pi)
    rotated = unit * (length / 2) * F.pow(width / 2, F.lit(2.0))
    return F.when(col(reported).isNotNull(), col(reported)).when(third.isNotNull(), unit * (length / 2) * (width / 2) * (third / 2)).otherwise(rotated)


def ellipticity(length, width) -> Column:
    return ratio(length, width) - 1


def image_aspect(length, width, length_px, width_px) -> Column:
    """Aspect ratio in mm where a length in mm is there, else in pixels."""
    return F.when(col(length).isNotNull(), ratio(length, width)).otherwise(ratio(length_px, width_px))


def void_unless(value, condition: Column) -> Column:
    """Null unless the condition is true; an unknown condition voids too."""
    return F.when(condition, col(value))


def first_source(*values) -> Column:
    """The first value that is there, NaN counting as missing."""
    return F.coalesce(*[present(v) for v in values])


def log_family(names: dict[str, str]) -> dict[str, Column]:
    return {new: log10(old) for new, old in names.items()}


def relative_spread(a, b) -> Column:
    """|a - b| over the mean of a and b."""
    a, b = col(a), col(b)
    return ratio(F.abs(a - b), (a + b) / 2)


def error_of(measured, truth) -> tuple[Column, Column]:
    """Difference, and its fraction of the truth."""
    return col(measured) - col(truth), ratio(col(measured) - col(truth), truth)


def shape_gap(width, breadth, length) -> tuple[Column, Column]:
    """Per cent by which the sections differ, and by which the volume of three axes differs from the turned one."""
    wide, narrow = axes(width, breadth)
    full = ellipsoid_volume(F.lit(None).cast("double"), length, wide, narrow)
    turned = ellipsoid_volume(F.lit(None).cast("double"), length, wide, F.lit(None).cast("double"))
    return 100 * ratio(wide - narrow, wide), 100 * ratio(turned - full, turned)


def digits(text) -> dict[str, Column]:
    """Of a number kept as text: significant figures, unit of its last place, relative precision, first and last digit.

    Figures are the characters without the point, one less above 10; the unit is 10^-(figures-1), a tenth of that above 10.
    """
    text = col(text)
    value = text.try_cast("double")
    plain = F.regexp_replace(text, r"\.", "")
    figures = F.length(plain) - F.when(value > 10, 1).otherwise(0)
    unit = F.pow(F.lit(10.0), -(figures - 1).cast("double")) * F.when(value > 10, 0.1).otherwise(1.0)
    lead = F.regexp_replace(plain, "^0+", "")
    return {"figures": figures, "unit": unit, "precision": ratio(unit, value), "first_digit": F.substring(lead, 1, 1), "last_digit": F.right(plain, F.lit(1))}


def body_measures(low, high) -> dict[str, Column]:
    """Logs of both ends, mean, mean of logs, and the cube of the mean size."""
    a, b = log10(low), log10(high)
    mean_log = (a + b) / 2
    return {"log_low": a, "log_high": b, "mean": (col(low) + col(high)) / 2, "mean_log": mean_log, "cube": F.pow(F.lit(10.0), 3 * mean_log), "cube_root_log": log10(root(high, 3.0))}


def temperature_normalised(time, kelvin, reference: float = 293.15, energy: float = 8000.0) -> Column:
    """Duration as it would be at the reference temperature."""
    return ratio(time, F.exp(-energy * (1 / F.lit(reference) - ratio(F.lit(1.0), kelvin))))


def quartile_ratio(x) -> Column:
    """Ratio of the widths at the quartiles from a fitted lambda x: with r = (1 - x) / (1 + x), 0.5^r * 1.5^-r."""
    r = ratio(1 - col(x), 1 + col(x))
    return F.pow(F.lit(0.5), r) * F.pow(F.lit(1.5), -r)


def converted(length_cm, ellipt, asym) -> dict[str, Column]:
    """Another data set's parameters in our units: mm, length / width ratio, width, volume, asymmetry as quartile ratio less 1."""
    length = 10 * col(length_cm)
    aspect = col(ellipt) + 1
    width = ratio(length, aspect)
    none = F.lit(None).cast("double")
    return {"length_mm": length, "aspect": aspect, "width_mm": width, "volume": ellipsoid_volume(none, length, width, none), "asymmetry": quartile_ratio(col(asym) + 1) - 1}


def relabelled(value: str, groups: dict[str, list[str]]) -> Column:
    """The label of the first list that holds the value; null without one."""
    out = F.lit(None).cast("string")
    for label, members in reversed(groups.items()):
        out = F.when(F.col(value).isin(members), label).otherwise(out)
    return out


def span_text(low, high, places: int = 2) -> Column:
    """``low - high``, rounded half to even."""
    return F.concat_ws(" - ", F.bround(col(low), places).cast("string"), F.bround(col(high), places).cast("string"))


def without_codes(df: DataFrame, column: str, codes: list[str]) -> DataFrame:
    """Drop the listed codes; rows without a code stay."""
    return df.where(~F.coalesce(F.col(column), F.lit("")).isin(codes))


def trim_above(df: DataFrame, column: str, share: float) -> DataFrame:
    """Keep rows below the column's quantile (linear interpolation) and rows without a value."""
    limit = quantiles(df, [], column, {"_limit": share}).select("_limit")
    rows = df.join(F.broadcast(limit), F.col(column) < F.col("_limit"), "left")  # at most one row
    return rows.where(F.col(column).isNull() | F.col("_limit").isNotNull()).drop("_limit")


def complete(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with finite values in all columns."""
    return df.withColumns({c: finite(c) for c in columns}).dropna(subset=columns)


def in_keys(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return df.join(keys.select(key), key, "left_semi")


def not_in_keys(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return df.join(keys.select(key), key, "left_anti")


def large_groups(df: DataFrame, key: str, more_than: int) -> DataFrame:
    """Rows of keys with more rows than the limit."""
    return df.join(df.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > more_than).select(key), key, "left_semi")


def without_pairs(df: DataFrame, first: str, second: str, pairs: list[tuple[str, str]]) -> DataFrame:
    """Drop the rows whose two levels are one of the pairs; rows without a level stay."""
    hit = F.lit(False)
    for a, b in pairs:
        hit = hit | (F.col(first).eqNullSafe(F.lit(a)) & F.col(second).eqNullSafe(F.lit(b)))
    return df.where(~hit)


def by_levels(df: DataFrame, column: str, levels: list[str], *then: Column, name: str = "level") -> DataFrame:
    """Rows in the order of given levels, then by ``then``; ``name`` is the level's place from 1, values not listed come last without one."""
    place = F.nullif(F.array_position(F.array(*map(F.lit, levels)), F.col(column)), F.lit(0))
    return df.withColumn(name, place).orderBy(F.col(name).asc_nulls_last(), *then)


def selected(df: DataFrame, names: dict[str, str], joined_name: str | None = None) -> DataFrame:
    """The columns of ``names`` under their new names; ``joined_name`` is written with ``_`` for spaces."""
    out = df.select(*[F.col(old).alias(new) for old, new in names.items()])
    return out.withColumn(joined_name, F.translate(joined_name, " ", "_")) if joined_name else out


def stacked(*tables: DataFrame) -> DataFrame:
    """All rows of all tables by column name; a column that a table lacks is null there."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def key_differences(left: DataFrame, right: DataFrame, key: str, names: tuple[str, str]) -> DataFrame:
    """(key, only_in): the distinct keys that one side lacks."""
    a, b = (t.select(key).where(F.col(key).isNotNull()).distinct() for t in (left, right))
    return a.join(b, key, "left_anti").withColumn("only_in", F.lit(names[0])).unionByName(b.join(a, key, "left_anti").withColumn("only_in", F.lit(names[1])))


def unique_to_one(df: DataFrame, family: str, group: str) -> DataFrame:
    """Distinct (family, group) of the families that occur in one group only."""
    pairs = df.select(family, group).dropna().distinct()
    return pairs.groupBy(family).agg(F.count("*").alias("_n"), F.first(group).alias(group)).where("_n = 1").select(family, group)


def direction(x, y) -> tuple[Column, Column]:
    """Angle of (x, y) in radians and in degrees."""
    angle = F.atan2(col(y), col(x))
    return angle, F.degrees(angle)
