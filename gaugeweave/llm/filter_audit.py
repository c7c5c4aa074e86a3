"""Filter interaction audit: what each filter removes, in every order of the filters.

Each filter leaves a table of the ids that fail it, written once to the shared folder.  Left-semi and left-anti joins
with these tables, one filter after another, part the documents into classes that fail the same filters; documents of a
class fare alike in every order, so a class and a part of the corpus become one row of counts.  The prefixes of all
orders are then followed over classes by the same joins: the survivors of a prefix are those left by anti joins with the
failures of its filters, a filter's removals a semi join of the survivors with its failures, its redundancies a semi
join of what was removed before.  So documents move once per filter, however many orders there are.

Defined results: null texts are empty; a null part is the empty string; a null id is an id of its own; rows that repeat
an id are counted each, and a filter that one of them fails is failed by all of them; of repeated labels the larger
counts, no label is none; ties don't occur (orders come by their letters); an empty table has no part and so no row;
further columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import functools
import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import WORD, cut, forget

#: Orders grow with the factorial of the filters.
MOST_FILTERS = 6


def standard_filters() -> dict[str, Column]:
    """The failure conditions A to D, over a column ``text`` that is never null."""
    text = F.col("text")
    words = F.regexp_extract_all(text, F.lit(WORD), 0)
    return {
        "A": F.regexp_count(text, F.lit(WORD)) < 100,
        "B": 100 * F.size(F.array_distinct(words)) < 80 * F.size(words),
        "C": 100 * (F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))) > 10 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def later_copies(rows: DataFrame) -> DataFrame:
    """(id): of ``rows`` (id, digest) those with a smaller id of the same digest.

    First ids come from an aggregate, and all other rows are those without a match in (digest, id), so that the copies of one
    text spread over tasks.
    """
    first = rows.groupBy("digest").agg(F.min("id").alias("id"))
    return rows.where("id is not null").join(first, ["digest", "id"], "left_anti").select("id")


def failing_ids(docs: DataFrame, filters: dict[str, Column], copies: str | None) -> tuple[DataFrame, dict[str, DataFrame]]:
    """The rows (id, part) of ``docs`` (id, part, text), and the id table of each filter.

    Conditions are evaluated in one pass over the texts; ``copies`` names the filter that fails the later ones of equal
    texts (by SHA-256).
    """
    whole = [c.alias(f"_{name}") for name, c in filters.items()]
    digest = [F.unhex(F.sha2("text", 256)).alias("digest")] if copies else []
    rows = cut(docs.select("id", "part", *digest, *whole), "audit-rows")
    tables = {name: cut(rows.where(F.col(f"_{name}")).select("id").distinct(), f"audit-{name}") for name in filters}
    if copies:
        tables[copies] = cut(later_copies(rows.select("id", "digest")).distinct(), f"audit-{copies}")
    return rows.select("id", "part"), tables


def classes(rows: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """``rows`` with ``mask``: the sum of 2 ** k over the places k of the filters whose id table holds the row's id."""
    rows = rows.withColumn("mask", F.lit(0))
    for k, ids in enumerate(tables.values()):
        ids = ids.withColumnRenamed("id", "_failing")
        same = F.col("id").eqNullSafe(F.col("_failing"))
        hit = rows.join(ids, same, "left_semi").withColumn("mask", F.col("mask") + (1 << k))
        before, rows = rows, cut(hit.unionByName(rows.join(ids, same, "left_anti")), "audit-classes")
        if k:
            forget(before)
    return rows


def audit(docs: DataFrame, labels: DataFrame, filters: dict[str, Column] | None = None, copies: str | None = "E", id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row per part, filter_order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    ``filters`` maps one letter each to a condition over ``text``; ``copies`` is the letter of the copy filter, None for none.
    ``labels`` has (doc_id, quality, toxic).  ``shapley`` is the removals of the step's filter, summed over all orders.
    """
    filters = standard_filters() if filters is None else filters
    names = [*filters, *([copies] if copies else [])]
    if len(names) > MOST_FILTERS or len(set(names)) < len(names) or any(len(x) != 1 for x in names):
        raise ValueError(f"at most {MOST_FILTERS} filters, named by one letter each")
    spark = docs.sparkSession
    plain = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows, tables = failing_ids(plain, filters, copies)
    marks = labels.groupBy(F.col("doc_id").alias("_labelled")).agg(F.max((F.col("quality") == 1).cast("int")).alias("_good"), F.max((F.col("toxic") == 1).cast("int")).alias("_toxic"))
    marked = classes(rows, tables).join(marks, F.col("id") == F.col("_labelled"), "left")
    counts = marked.groupBy("part", "mask").agg(F.count("*").alias("n"), F.coalesce(F.sum("_good"), F.lit(0)).alias("good"), F.coalesce(F.sum("_toxic"), F.lit(0)).alias("toxic"))
    counts = cut(counts, "audit-counts")  # at most 2 ** filters rows a part

    # Everything below is over classes and orders: tables of a size that MOST_FILTERS bounds, whatever the input.
    fixed = lambda rows, schema: F.broadcast(spark.createDataFrame(rows, schema))
    masks = range(1 << len(names))
    orders = ["".join(p) for p in itertools.permutations(sorted(names))]
    fails = fixed([(x, m) for m in masks for k, x in enumerate(names) if m >> k & 1], "letter string, mask int")
    alone = fixed([(1 << k,) for k in range(len(names))], "mask int")
    steps = fixed([(o, k + 1, x) for o in orders for k, x in enumerate(o)], "filter_order string, step int, letter string")
    earlier = spark.createDataFrame([(o, k + 1, x) for o in orders for k in range(len(o)) for x in o[:k]], "filter_order string, step int, letter string")
    every = spark.createDataFrame([(m,) for m in masks], "mask int").crossJoin(steps)
    at, failing = ["filter_order", "step", "mask"], ["letter", "mask"]
    gone = F.broadcast(earlier.join(fails, "letter").select(*at).distinct())
    entering, failed = every.join(gone, at, "left_anti"), every.join(fails, failing, "left_semi")
    what = {
        "kept": entering.join(fails, failing, "left_anti"),
        "removed": entering.join(fails, failing, "left_semi"),
        "redundant": failed.join(gone, at, "left_semi"),
        "unique_fails": failed.join(alone, "mask", "left_semi"),
    }
    told = functools.reduce(DataFrame.unionByName, [t.select("filter_order", "step", "letter", "mask", F.lit(k).alias("what")) for k, t in what.items()])
    told = cut(told.coalesce(8), "audit-told")
    of = lambda kind, c: F.coalesce(F.sum(F.when(F.col("what") == kind, F.col(c))), F.lit(0)).cast("long")
    sums = counts.join(F.broadcast(told), "mask").groupBy("part", "filter_order", "step", "letter").agg(
        *[of(k, "n").alias(k) for k in what], of("removed", "good").alias("good_lost"), of("removed", "toxic").alias("toxic_lost"))
    sums = cut(sums, "audit-sums")
    shapley = sums.groupBy("part", "letter").agg(F.sum("removed").alias("shapley"))
    grid = counts.select("part").distinct().crossJoin(steps)
    out = grid.join(sums, ["part", "filter_order", "step", "letter"], "left").join(shapley, ["part", "letter"], "left")
    numbers = [*what, "good_lost", "toxic_lost", "shapley"]
    return out.select("part", "filter_order", "step", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers])
