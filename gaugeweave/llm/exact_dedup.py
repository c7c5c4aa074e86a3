"""Exact duplicates by progressive refinement: length, then a hash of the start, then a hash of the whole.

Native: DataFrame functions only.  Only texts whose normalised length and start are shared with another text are
hashed in full to find copies.

Defined results: null text counts as empty, so null and empty texts are one group; white space runs
(\\x20, \\x09-\\x0D) compare as one space; of equal texts the row with the smallest id stays, and rows that repeat this
very id all stay (they cannot be told apart); a null id is larger than any other; an empty table gives an empty table;
further columns are untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut, small


def normalised(text: str) -> Column:
    """Each white-space run as one space.  The pattern skips runs that are one space already."""
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def digest(text: str) -> Column:
    """Lowercase hex SHA-256 of the normalised text in UTF-8."""
    return F.sha2(normalised(text), 256)


def suspects(docs: DataFrame, id_col: str, text_col: str, prefix: int, most_ids: int) -> tuple[DataFrame, DataFrame]:
    """(id, digest) of the texts whose length and start are shared, and (id) of all rows.

    Length and start of every text are written once.  Starts are hashed where the length is shared, whole texts where the
    hash of the start is shared too; the texts of those are picked by id.  Up to ``most_ids`` lengths, starts or ids are
    broadcast; beyond it Spark shuffles.
    """
    whole = normalised(text_col)
    first = cut(docs.select(F.col(id_col).alias("_id"), F.octet_length(whole).alias("_len"), F.substring(whole, 1, prefix).alias("_start")), "lengths")
    lengths = cut(first.groupBy("_len").agg(F.count("*").alias("_n")).where("_n > 1").select("_len"), "shared-lengths")
    heads = cut(first.join(small(lengths, most_ids), "_len", "left_semi").select("_id", "_len", F.xxhash64("_start").alias("_head")), "heads")
    shared = cut(heads.groupBy("_len", "_head").agg(F.count("*").alias("_n")).where("_n > 1").select("_len", "_head"), "shared-heads")
    ids = cut(heads.join(small(shared, most_ids), ["_len", "_head"], "left_semi").select(F.col("_id").alias("_suspect")).distinct(), "suspects")
    picked = docs.join(small(ids, most_ids), F.col(id_col).eqNullSafe(F.col("_suspect")), "left_semi")
    return cut(picked.select(F.col(id_col).alias("_id"), digest(text_col).alias("text_sha256")), "digests"), first.select("_id")


def groups_of(digests: DataFrame) -> DataFrame:
    """Groups of two or more equal texts: ``text_sha256``, ``keep_id``, ``group_size``."""
    return cut(digests.groupBy("text_sha256").agg(F.min("_id").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1"), "copies")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = 64, most_ids: int = 1_000_000) -> DataFrame:
    """One row per document: its id, keep_id, group_size, kept, text_sha256 (which is asked for every row, so each text is hashed here)."""
    rows = docs.select(F.col(id_col), digest(text_col).alias("text_sha256"))
    # A group may hold a third of all rows; the join's own exchanges let Spark split it.
    placed = rows.join(groups_of(suspects(docs, id_col, text_col, prefix, most_ids)[0]), "text_sha256", "left")
    alone = F.col("group_size").isNull()
    return placed.select(
        id_col,
        F.when(alone, F.col(id_col)).otherwise(F.col("keep_id")).alias("keep_id"),
        F.when(alone, F.lit(1)).otherwise(F.col("group_size")).cast("long").alias("group_size"),
        F.coalesce(F.col(id_col) == F.when(alone, F.col(id_col)).otherwise(F.col("keep_id")), alone).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = 64, most_ids: int = 1_000_000) -> DataFrame:
    """The rows of ``docs`` that stay, all columns as they were.  Only texts with a shared length and start are hashed in full.

    Rows that repeat an id are told apart by no column, so they go only if all of them are copies of rows with smaller ids.
    Rows without an id can't be picked by it and stay.
    """
    digests, rows = suspects(docs, id_col, text_col, prefix, most_ids)
    losing = digests.join(groups_of(digests), "text_sha256").where("_id > keep_id").groupBy("_id").agg(F.count("*").alias("_lost"))
    losing = cut(losing, "losing")
    times = rows.join(small(losing.select("_id"), most_ids), "_id", "left_semi").groupBy("_id").agg(F.count("*").alias("_times"))
    losers = cut(losing.join(times, "_id").where("_lost = _times").select(F.col("_id").alias("_gw_id")), "copies-to-drop")
    return docs.join(small(losers, most_ids), F.col(id_col) == F.col("_gw_id"), "left_anti")
