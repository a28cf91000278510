"""Chat formatting with typed content parts, in DataFrame functions only.

A message holds an ordered list of parts. Text parts are escaped and written out; image, audio
and document parts become numbered placeholders, with the reference and the number of model
tokens each one expands to kept beside the text. The template is

    [TURN role]part part ...</s>

and the four characters it is made of are escaped in roles and texts, so no text can
open or close a turn and everything can be read back.

Defined results: a null role or text is empty; a message without parts gives a turn without a
body; messages of one conversation are ordered by turn (nulls first), then role, then parts, so
repeated rows give repeated turns; a null conversation id is a conversation of its own; other columns are
ignored; no messages give no conversations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PART = "struct<kind:string,text:string,ref:string,units:bigint>"

#: Placeholder word, tokens per unit and fixed tokens of each kind that is not text.
KINDS = {"image": ("IMAGE", 256, 2), "audio": ("AUDIO", 25, 2), "document": ("DOCUMENT", 512, 1)}

_ESCAPES = (("\\", "\\b"), ("<", "\\l"), ("[", "\\i"), ("]", "\\e"))
_OPEN, _SHUT, _END = "[TURN ", "]", "</s>"


def escape(text: Column) -> Column:
    """Null becomes empty; the result holds none of ``<``, ``[`` and ``]``."""
    out = F.coalesce(text, F.lit(""))
    for raw, safe in _ESCAPES:
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def unescape(text: Column) -> Column:
    for raw, safe in reversed(_ESCAPES):
        text = F.replace(text, F.lit(safe), F.lit(raw))
    return text


def text_part(text: Column) -> Column:
    return F.struct(
        F.lit("text").alias("kind"),
        text.alias("text"),
        F.lit(None).cast("string").alias("ref"),
        F.lit(None).cast("bigint").alias("units"),
    ).cast(PART)


def _by_kind(kind: Column, at: int, other: Column) -> Column:
    out = other
    for name, values in KINDS.items():
        out = F.when(kind == name, F.lit(values[at])).otherwise(out)
    return out


def format_chats(messages: DataFrame, trained: str = "assistant") -> DataFrame:
    """One row per conversation from (conv_id, turn, role, parts: array of PART).

    Returns conv_id, formatted, mask (array of struct(start, stop), code points of
    ``formatted`` that the loss counts, in order), attachments (array of struct(slot, kind, ref,
    n_tokens)) and n_expanded (tokens all attachments expand to). A part of
    an unknown kind counts as text.

    One shuffle, by conversation; offsets and slots are running sums over its parts, so the
    work grows with the conversation's length and not with its square.
    """
    conversation = Window.partitionBy("conv_id")
    turns = messages.select("conv_id", "turn", "role", "parts").withColumn(
        "turn_no",
        F.row_number().over(conversation.orderBy("turn", "role", "parts")),
    )
    parts = turns.select("conv_id", "turn_no", "role", F.posexplode_outer("parts").alias("at", "part"))
    in_turn = Window.partitionBy("conv_id").orderBy("turn_no", "at")
    kind = F.col("part.kind")
    attached = F.coalesce(kind.isin(*KINDS), F.lit(False))
    until_here = in_turn.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = parts.select(
        "conv_id",
        "turn_no",
        "at",
        "role",
        "part",
        attached.alias("attached"),
        F.coalesce(F.lag("turn_no").over(in_turn) != F.col("turn_no"), F.lit(True)).alias("first"),
        F.coalesce(F.lead("turn_no").over(in_turn) != F.col("turn_no"), F.lit(True)).alias("last"),
        (F.sum(attached.cast("int")).over(until_here) - 1).alias("slot"),
    )
    head = F.when(F.col("first"), F.concat(F.lit(_OPEN), escape(F.col("role")), F.lit(_SHUT)))
    placeholder = F.concat(
        F.lit("["), _by_kind(kind, 0, F.lit("")), F.lit(" "), F.col("slot").cast("string"), F.lit("]")
    )
    body = F.when(F.col("attached"), placeholder).otherwise(escape(F.col("part.text")))
    tail = F.when(F.col("last"), F.lit(_END))
    parts = parts.select(
        "*",
        F.coalesce(head, F.lit("")).alias("head"),
        body.alias("body"),
        F.coalesce(tail, F.lit("")).alias("tail"),
        (F.coalesce(F.col("part.units"), F.lit(0)) * _by_kind(kind, 1, F.lit(0)) + _by_kind(kind, 2, F.lit(0)))
        .cast("long")
        .alias("n_tokens"),
    )
    piece = F.concat("head", "body", "tail")
    parts = parts.select("*", F.sum(F.length(piece)).over(until_here).alias("stop"))
    start = F.col("stop") - F.length("tail") - F.length("body")
    span = F.struct(start.alias("start"), (F.col("stop") - F.length("tail")).alias("stop"))
    reference = F.struct("slot", kind.alias("kind"), F.col("part.ref").alias("ref"), "n_tokens")
    trains = (F.col("role") == trained) & ~F.col("attached")
    rows = F.struct(
        "turn_no",
        "at",
        piece.alias("piece"),
        F.when(trains, span).alias("span"),
        F.when(F.col("attached"), reference).alias("reference"),
    )
    whole = parts.groupBy("conv_id").agg(F.array_sort(F.collect_list(rows)).alias("rows"))
    return whole.select(
        "conv_id",
        F.array_join("rows.piece", "").alias("formatted"),
        F.filter("rows.span", lambda s: s.isNotNull()).alias("mask"),
        F.filter("rows.reference", lambda r: r.isNotNull()).alias("attachments"),
        F.aggregate("rows.reference", F.lit(0).cast("long"), lambda n, r: n + F.coalesce(r["n_tokens"], F.lit(0))).alias(
            "n_expanded"
        ),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of struct(role, text); placeholders stay in the text."""
    turns = F.filter(F.split(formatted, _END, -1), lambda t: t != "")
    return F.transform(
        turns,
        lambda t: F.struct(
            unescape(F.substring_index(F.substr(t, F.lit(len(_OPEN) + 1)), _SHUT, 1)).alias("role"),
            unescape(F.substr(t, F.locate(_SHUT, t) + 1)).alias("text"),
        ),
    )


def read_masked(formatted: Column, mask: Column) -> Column:
    """All text under the mask, unescaped, nothing between the spans."""
    spans = F.transform(
        mask, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), (s["stop"] - s["start"]).cast("int")))
    )
    return F.array_join(spans, "")
