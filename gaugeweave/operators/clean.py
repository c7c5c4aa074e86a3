"""Cleaning of schema-less records (maps of text): flags, suggested repairs, quarantine, corrections."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..functions.nulls import col

#: Two-letter keys of kind (mean, deviation, least, most, point) and dimension (length, width, breadth, volume).
KINDS, SIDES = "admxp", "lwbv"
NUMERIC = [k + d for d in SIDES for k in KINDS]
EXPECTED = [*NUMERIC, "s", "g", "b", "cg", "cs", "order1", "cln", "i", "ID", "!", "W", "pd"]
#: How further keys that may occur begin.
PREFIXES = ("tax_", "bib_", "im_", "problem", "dbl")


def rinsed(entry) -> Column:
    """Trimmed values, empty ones dropped."""
    return F.map_filter(F.transform_values(col(entry), lambda k, v: F.regexp_replace(v, r"^\s+|\s+$", "")), lambda k, v: v != "")


def bare_name(text) -> Column:
    """Without non-word characters at either end."""
    return F.regexp_replace(F.regexp_replace(col(text), r"^\W+", ""), r"\W+$", "")


def number(entry: Column, key: str) -> Column:
    return F.element_at(entry, key).try_cast("double")


def has(entry: Column, key: str) -> Column:
    return F.coalesce(F.map_contains_key(entry, F.lit(key)), F.lit(False))


def not_numbers(entry) -> Column:
    """Numeric keys whose value is no number."""
    return F.map_keys(F.map_filter(col(entry), lambda k, v: k.isin(NUMERIC) & v.try_cast("double").isNull()))


def lone_halves(entry) -> Column:
    """Keys of half pairs: a mean without deviation, a least without most, and the other way round."""
    e = col(entry)
    out = [F.when(has(e, x + d) & ~has(e, y + d), F.lit(x + d)) for d in SIDES[:3] for x, y in ("ad", "da", "mx", "xm")]
    return F.array_compact(F.array(*out))


def conflicting(entry) -> Column:
    """Dimensions with more than one of mean, most, point."""
    e = col(entry)
    return F.array_compact(F.array(*[F.when(sum(has(e, k + d).cast("int") for k in "axp") > 1, F.lit(d)) for d in SIDES]))


def missing_keys(entry, required: tuple[str, ...] = ("b", "g")) -> Column:
    return F.array_compact(F.array(*[F.when(~has(col(entry), k), F.lit(k)) for k in required]))


def measured(entry) -> Column:
    """Any measurement or an image."""
    return F.exists(F.map_keys(col(entry)), lambda k: k.isin([*NUMERIC, "i"]))


def unexpected(entry) -> Column:
    legal = lambda k: k.isin(EXPECTED) | k.rlike("^(" + "|".join(PREFIXES) + ")")
    return F.filter(F.map_keys(col(entry)), lambda k: ~legal(k))


def suggestion(entry) -> Column:
    """(key, value): one unexpected key with a number, and one missing half of a pair, belong together."""
    e = col(entry)
    stray = F.map_entries(F.map_filter(e, lambda k, v: F.array_contains(unexpected(e), k) & v.try_cast("double").isNotNull()))
    half = lone_halves(e)
    other = F.translate(F.substring(half[0], 1, 1), "admx", "daxm")
    return F.when((F.size(stray) == 1) & (F.size(half) == 1), F.struct(F.concat(other, F.substring(half[0], 2, 1)).alias("key"), stray[0]["value"].alias("value")))


def as_point(entry) -> Column:
    """A lone half of a pair as the single value of its dimension, where that is free."""
    e, half = col(entry), lone_halves(entry)
    point = F.concat(F.lit("p"), F.substring(half[0], 2, 1))
    free = (F.size(half) == 1) & ~F.coalesce(F.map_contains_key(e, point), F.lit(False))
    return F.when(free, F.map_concat(F.map_filter(e, lambda k, v: k != half[0]), F.create_map(point, F.element_at(e, half[0])))).otherwise(e)


def out_of_range(entry, most: float = 30.0) -> Column:
    return F.map_keys(F.map_filter(col(entry), lambda k, v: k.isin(NUMERIC) & (v.try_cast("double") > most)))


def disordered(entry) -> Column:
    """Dimensions whose deviation reaches the mean or whose least reaches the most."""
    e = col(entry)
    return F.array_compact(F.array(*[F.when((number(e, "d" + s) >= number(e, "a" + s)) | (number(e, "m" + s) >= number(e, "x" + s)), F.lit(s)) for s in SIDES]))


def in_order(entry) -> Column:
    """The repair of ``disordered``: deviation and mean, least and most change places where they are in the wrong order."""
    e = col(entry)
    pairs = [(low + s, high + s) for s in SIDES for low, high in (("d", "a"), ("m", "x"))]

    def value(key: Column, own: Column) -> Column:
        out = own
        for low, high in pairs:
            wrong = number(e, low) >= number(e, high)
            out = F.when(wrong & (key == low), F.element_at(e, high)).when(wrong & (key == high), F.element_at(e, low)).otherwise(out)
        return out

    return F.transform_values(e, value)


def checked(df: DataFrame, entry: str) -> DataFrame:
    """Add ``status``: the last stage that a record passes ('' none, rnsd, comp, cols, sqky); finished ones stay."""
    df = df.withColumn(entry, rinsed(entry))
    e = F.col(entry)
    complete = (F.size(lone_halves(e)) == 0) & (F.size(conflicting(e)) == 0) & (F.size(missing_keys(e)) == 0) & measured(e)
    columns = F.size(unexpected(e)) == 0
    good = (F.size(not_numbers(e)) == 0) & (F.size(out_of_range(e)) == 0) & (F.size(disordered(e)) == 0)
    stage = F.when(complete & columns & good, "sqky").when(complete & columns, "cols").when(complete, "comp").otherwise("rnsd")
    done = F.element_at(e, "cln")
    return df.withColumn("status", F.when(done == "sqky", done).otherwise(stage))


def _fixed(joined: DataFrame, entry: str) -> DataFrame:
    """Apply the map ``_fix`` to the entry and mark it as double-checked; entries without one stay."""
    kept = F.map_filter(entry, lambda k, v: ~F.map_contains_key("_fix", k) & (k != "dbl_chk"))
    whole = F.map_concat(kept, F.map_filter("_fix", lambda k, v: k != "dbl_chk"), F.create_map(F.lit("dbl_chk"), F.lit("y")))
    return joined.withColumn(entry, F.when(F.col("_fix").isNotNull(), whole).otherwise(F.col(entry)))


def _fixes(corrections: DataFrame, keys: list[str]) -> DataFrame:
    """One map per keys; of several new values of one key the largest holds."""
    one = corrections.groupBy(*keys, "key").agg(F.max("new_value").alias("new_value"))
    return one.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("key", "new_value"))).alias("_fix"))


def corrected(df: DataFrame, entry: str, corrections: DataFrame) -> DataFrame:
    """Apply (ID, key, new_value) rows to the records with that ID and mark them as double-checked."""
    fix = _fixes(corrections, ["ID"]).withColumnRenamed("ID", "_id")
    return _fixed(df.join(fix, F.element_at(entry, "ID") == F.col("_id"), "left"), entry).drop("_id", "_fix")


def corrected_by_taxon(df: DataFrame, entry: str, corrections: DataFrame) -> DataFrame:
    """Apply (b, taxon, key, new_value) rows to the records of that reference whose matched name, or genus and species, is the taxon.

    Underscores of the taxon are spaces; a matched name comes before genus and species.
    """
    name = F.translate("taxon", "_", " ")
    fix = _fixes(corrections.withColumn("taxon", name), ["b", "taxon"]).select(F.col("b").alias("_b"), F.col("taxon").alias("_t"), "_fix")
    part = lambda k: F.coalesce(F.element_at(entry, k), F.lit(""))
    full = F.concat(part("g"), F.lit(" "), part("s"))
    by_match = fix.select("_b", "_t", F.col("_fix").alias("_one"))
    joined = df.join(by_match, (F.element_at(entry, "b") == F.col("_b")) & (F.element_at(entry, "tax_matched") == F.col("_t")), "left").drop("_b", "_t")
    joined = joined.join(fix.withColumnRenamed("_fix", "_two"), (F.element_at(entry, "b") == F.col("_b")) & (full == F.col("_t")), "left").drop("_b", "_t")
    return _fixed(joined.withColumn("_fix", F.coalesce("_one", "_two")), entry).drop("_one", "_two", "_fix")


#: What the checks of a record are called, in the order of their stages.
CHECKS = {"lone half": lone_halves, "conflict": conflicting, "required key": missing_keys, "unexpected key": unexpected, "no number": not_numbers, "out of range": out_of_range, "out of order": disordered}


def failing(entry) -> Column:
    """The names of the checks that a record fails, in the order of CHECKS; a record without a measurement or image fails ``nothing measured``."""
    bad = [F.when(F.size(check(entry)) > 0, F.lit(name)) for name, check in CHECKS.items()]
    return F.array_compact(F.array(*bad, F.when(~measured(entry), F.lit("nothing measured"))))


def moved(entry, move) -> Column:
    """The record with a stray number where ``move`` (see ``suggestion``) puts it; as it is without a move."""
    e, move = col(entry), col(move)
    stray = lambda k, v: (v == move["value"]) & ~k.isin(EXPECTED) & ~k.rlike("^(" + "|".join(PREFIXES) + ")")
    whole = F.map_concat(F.map_filter(e, lambda k, v: ~stray(k, v)), F.create_map(move["key"], move["value"]))
    return F.when(move.isNotNull(), whole).otherwise(e)


def cleaning_loop(df: DataFrame, entry: str, corrections: DataFrame) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """Check, correct and repair, check again: (good records, quarantined ones with ``failing``, counts by stage).

    Corrections (ID, key, new_value) come first, then the suggested moves of stray numbers, then halves of pairs in their
    order; repairs are done to records that are not finished yet.  Both results have ``before`` and ``status``.  The result is written once; ``counts`` are observed in that pass:
    records, good before, corrected, good after, quarantined.
    """
    # Tables between the steps keep the expressions over maps from being built into each other.
    first = cut(checked(df, entry).withColumnRenamed("status", "before"), "checked")
    fixed = cut(corrected(first, entry, corrections), "corrected")
    todo, e = F.col("before") != "sqky", F.col(entry)
    told = cut(fixed.withColumns({"_fixed": has(e, "dbl_chk"), "_move": F.when(todo, suggestion(entry))}), "suggested")
    full = cut(told.withColumn(entry, moved(entry, "_move")).drop("_move"), "moved")
    swapped = cut(full.withColumn(entry, F.when(todo, in_order(entry)).otherwise(e)), "ordered")
    again = checked(swapped, entry).withColumn("failing", failing(entry))
    good = F.col("status") == "sqky"
    seen = Observation(f"cleaning-{uuid.uuid4().hex}")
    whole = cut(again.observe(seen, F.count("*").alias("records"), F.count_if(~todo).alias("good before"), F.count_if("_fixed").alias("corrected"), F.count_if(good).alias("good after"), F.count_if(~good).alias("quarantined")).drop("_fixed"), "cleaned")
    return whole.where(good).drop("failing"), whole.where(~good), {k: int(v) for k, v in seen.get.items()}


def dimension_is_good(entry, side: str) -> Column:
    """A point alone, a mean with deviation, or a least with most."""
    e = col(entry)
    there = [has(e, k + side) for k in "admxp"]
    one = lambda *on: [t if k in on else ~t for k, t in zip("admxp", there, strict=True)]
    every = lambda cs: cs[0] & cs[1] & cs[2] & cs[3] & cs[4]
    return every(one("p")) | every(one("a", "d")) | every(one("m", "x"))
