"""Chat formatting with typed content parts.

A conversation's turns hold parts of the types text, image, audio and document; a turn of plain text is one text part.
Parts are flattened to rows, and the visitor below maps each by its type: text is escaped and kept, other parts become a
numbered placeholder, an attachment reference and a number of tokens that the placeholder expands to.  Numbers and
offsets are running sums over a conversation's parts, so work grows with their number.  Native: DataFrame functions only.

Template: ``<|turn|>role<|text|>content<|end|>`` per turn.  Inside roles and texts, ``\\`` is written ``\\\\`` and ``|``
is written ``\\|``, so no control string can come from texts, even side by side, and ``unescape`` gives the text back.

Defined results: null texts and roles are empty; turns are ordered by turn (null first), then role, then text; rows
that repeat stay; parts of unknown type become placeholders of that type and expand to no token; a null conversation id
is a conversation of its own; an empty table gives an empty table.
A conversation is one output row, so it must fit one row; conversations are spread over tasks by id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"

#: Tokens that one unit of an attachment expands to: image tiles, seconds of audio, document pages.
UNIT_TOKENS = {"image": 256, "audio": 25, "document": 700}

PART = "struct<type:string,text:string,ref:string,units:bigint>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))


def unescape(text: Column) -> Column:
    """One pass from the left: a backslash stands for the character after it."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def text_part(text: Column) -> Column:
    """A turn of plain text as its one part."""
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(0).cast("bigint").alias("units")))


def _kind(part: Column) -> Column:
    return F.coalesce(part["type"], F.lit("text"))


def _content(part: Column, nth: Column) -> Column:
    """The visitor: what a part leaves in the formatted text."""
    kind = _kind(part)
    return F.when(kind == "text", escape(part["text"])).otherwise(F.concat(F.lit("<|"), F.regexp_replace(kind, r"[^0-9A-Za-z_]", "_"), F.lit(":"), nth.cast("string"), F.lit("|>")))


def _expansion(part: Column) -> Column:
    each = F.lit(0)
    for kind, tokens in UNIT_TOKENS.items():
        each = F.when(_kind(part) == kind, F.lit(tokens)).otherwise(each)
    return (each * F.coalesce(part["units"], F.lit(0))).cast("bigint")


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", parts_col: str | None = None, loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: ``formatted``, ``loss_spans`` (start, length in code points of each ``loss_role`` content, and its turn from 0), ``attachments`` and ``expanded_tokens``.

    ``parts_col`` names an array of PART; without it, ``text_col`` is each turn's one text part.  ``attachments`` lists, in
    order, type, ref, placeholder number and expanded tokens of every part that is not text.
    """
    parts = F.col(parts_col).cast(f"array<{PART}>") if parts_col else text_part(F.col(text_col))
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("_turn"), F.coalesce(F.col(role_col), F.lit("")).alias("_role"), F.coalesce(parts, F.array().cast(f"array<{PART}>")).alias("_parts"))
    rows = rows.withColumn("_row", F.row_number().over(Window.partitionBy("conv_id").orderBy("_turn", "_role", "_parts")))
    rows = rows.select("conv_id", "_row", "_role", F.size("_parts").alias("_k"), F.posexplode_outer("_parts").alias("_pos", "_part"))
    part, first, last = F.col("_part"), F.coalesce(F.col("_pos"), F.lit(0)) == 0, F.coalesce(F.col("_pos"), F.lit(0)) == F.greatest(F.col("_k"), F.lit(1)) - 1
    before = Window.partitionBy("conv_id").orderBy("_row", "_pos").rowsBetween(Window.unboundedPreceding, -1)
    whole_turn = Window.partitionBy("conv_id", "_row")
    rows = rows.withColumn("_other", (_kind(part) != "text").cast("int"))
    rows = rows.withColumn("_number", F.coalesce(F.sum("_other").over(before), F.lit(0)).cast("int"))
    rows = rows.withColumns({"_body": _content(part, F.col("_number")), "_head": F.when(first, F.concat(F.lit(TURN), escape(F.col("_role")), F.lit(TEXT))).otherwise("")})
    rows = rows.withColumn("_piece", F.concat("_head", "_body", F.when(last, END).otherwise("")))
    rows = rows.withColumns({"_at": F.coalesce(F.sum(F.length("_piece")).over(before), F.lit(0)), "_size": F.sum(F.length("_body")).over(whole_turn)})
    span = F.when(first & (F.col("_role") == loss_role), F.struct("_row", (F.col("_at") + F.length("_head")).alias("start"), F.col("_size").alias("length")))
    found = F.when(F.col("_other") == 1, F.struct(F.col("_number").alias("number"), _kind(part).alias("type"), F.col("_part.ref").alias("ref"), _expansion(part).alias("tokens")))
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("_row", "_pos", "_piece"))).alias("_pieces"), F.sort_array(F.collect_list(span)).alias("_spans"), F.sort_array(F.collect_list(found)).alias("_found"))
    return chats.select(
        "conv_id",
        F.array_join(F.transform("_pieces", lambda p: p["_piece"]), "").alias("formatted"),
        F.transform("_spans", lambda s: F.struct(s["start"], s["length"], (s["_row"] - 1).alias("turn"))).alias("loss_spans"),
        F.transform("_found", lambda a: F.struct(a["type"], a["ref"], a["number"], a["tokens"])).alias("attachments"),
        F.aggregate("_found", F.lit(0).cast("bigint"), lambda n, a: n + a["tokens"]).alias("expanded_tokens"),
    )


def read_back(chats: DataFrame) -> DataFrame:
    """From ``formatted`` and ``loss_spans`` alone: ``turns`` (role, text) and ``loss_text``, unescaped.

    The text is cut at its turns once, and each span is taken from the content of its own turn, so work grows with the length.
    """
    pieces = F.filter(F.split("formatted", r"<\|end\|>"), lambda p: p != "")
    turn = lambda p: F.struct(unescape(F.substring_index(F.substring(p, len(TURN) + 1, 2**31 - 1), TEXT, 1)).alias("role"), unescape(F.substring_index(p, TEXT, -1)).alias("text"))
    spoken = lambda s: unescape(F.substring(F.substring_index(F.get("_pieces", s["turn"]), TEXT, -1), F.lit(1), s["length"].cast("int")))
    # Named twice, so that the optimiser keeps the pieces as a column instead of cutting again for each span.
    loss = F.when(F.size("_pieces") > 0, F.array_join(F.transform("loss_spans", spoken), "")).otherwise("")
    return chats.withColumn("_pieces", pieces).withColumns({"turns": F.transform("_pieces", turn), "loss_text": loss}).drop("_pieces")
