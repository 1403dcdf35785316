"""Chat formatting of conversations with typed content parts.

A message is a list of parts, struct(type, text, ref, tokens).  A visitor
flattens the parts in order: text is escaped, an image, audio or document part
becomes its placeholder, and its reference and expanded token count are
recorded as an attachment.  A turn is written as

    <s>ROLE[INST]CONTENT[/INST]</s>

Control strings inside roles and texts are escaped by a backslash after their
first character, one more where backslashes stand there already; taking one
away restores the text, so a formatted conversation can be read back exactly.

Everything is a Column expression: one shuffle brings the turns of a
conversation together (its formatted text is one value, so one row must hold
it), all else happens inside rows.

Defined results: a null text or role counts as empty; turns are ordered by
turn, ties by role and content (null turns first), repeated rows are repeated
turns; unknown part types count as text; null parts are skipped; a null
conversation id is a conversation like any other; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# part type -> (placeholder, expanded tokens where the part names none)
ATTACHMENTS = {"image": ("<image>", 576), "audio": ("<audio>", 750), "document": ("<document>", 1024)}
OPEN, BODY, END, CLOSE = "<s>", "[INST]", "[/INST]", "</s>"
_NAMES = "|".join(["s", *ATTACHMENTS])
CONTROL = rf"([<\[])(\\*)(/?(?:{_NAMES})>|/?INST\])"
_ESCAPED = rf"([<\[])\\(\\*)(/?(?:{_NAMES})>|/?INST\])"
PART_TYPE = "struct<type:string,text:string,ref:string,tokens:bigint>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1$2\\$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def text_part(text: str | Column) -> Column:
    """A message of one text part."""
    text = F.col(text) if isinstance(text, str) else text
    return F.array(F.struct(F.lit("text").alias("type"), text.cast("string").alias("text"),
                            F.lit(None).cast("string").alias("ref"), F.lit(None).cast("long").alias("tokens")))


def _by_kind(kind: Column, of: dict, otherwise: Column) -> Column:
    out = F
    for name, value in of.items():
        out = out.when(kind == name, value)
    return out.otherwise(otherwise)


def _render(part: Column) -> Column:
    return _by_kind(part["type"], {k: F.lit(mark) for k, (mark, _) in ATTACHMENTS.items()},
                    escape(F.coalesce(part["text"], F.lit(""))))


def _words(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")).cast("long")


def _tokens(part: Column) -> Column:
    own = {k: F.coalesce(part["tokens"], F.lit(n).cast("long")) for k, (_, n) in ATTACHMENTS.items()}
    return _by_kind(part["type"], own, _words(part["text"]))


def _attachments(turns: Column) -> Column:
    def of_turn(turn: Column, t: Column) -> Column:
        marked = F.transform(turn["parts"], lambda p, i: F.struct(
            t.cast("long").alias("turn_index"), i.cast("long").alias("part_index"), p["type"].alias("kind"),
            p["ref"].alias("ref"), _tokens(p).alias("tokens")))
        return F.filter(marked, lambda a: a["kind"].isin(*ATTACHMENTS))

    return F.flatten(F.transform(turns, of_turn))


def format_conversations(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
                         role_col: str = "role", parts_col: str = "parts",
                         loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: (conv_id, formatted, segments, attachments,
    expanded_tokens).

    ``segments`` array<struct<text, loss>> joined together are ``formatted``;
    the loss mask covers the segments with ``loss`` true (the contents of the
    turns of ``loss_roles``).  ``attachments`` are array<struct<turn_index,
    part_index, kind, ref, tokens>> in the order of the placeholders.
    """
    parts = F.coalesce(F.col(f"`{parts_col}`").cast(f"array<{PART_TYPE}>"), F.array().cast(f"array<{PART_TYPE}>"))
    turn = F.struct(F.col(f"`{turn_col}`").alias("turn"), F.coalesce(F.col(f"`{role_col}`"), F.lit("")).alias("role"),
                    F.filter(parts, lambda p: p.isNotNull()).alias("parts"))
    turns = messages.select(F.col(f"`{conv_col}`").alias("conv"), turn.alias("t")).groupBy("conv").agg(
        F.sort_array(F.collect_list("t")).alias("turns"))

    def segments(t: Column) -> Column:
        piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        body = F.array_join(F.transform(t["parts"], _render), "")
        return F.array(piece(F.concat(F.lit(OPEN), escape(t["role"]), F.lit(BODY)), F.lit(False)),
                       piece(body, t["role"].isin(*loss_roles)), piece(F.lit(END + CLOSE), F.lit(False)))

    tokens = F.aggregate(F.flatten(F.transform("turns", lambda t: F.transform(t["parts"], _tokens))),
                         F.lit(0).cast("long"), lambda a, n: a + n)
    out = turns.select("conv", F.flatten(F.transform("turns", segments)).alias("segments"),
                       _attachments(F.col("turns")).alias("attachments"), tokens.alias("expanded_tokens"))
    return out.select(F.col("conv").alias(conv_col),
                      F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments",
                      "attachments", "expanded_tokens")


def read_turns(formatted: str | Column) -> Column:
    """A formatted conversation as array<struct<role, text>>; placeholders stay in the text."""
    formatted = F.col(formatted) if isinstance(formatted, str) else formatted
    pieces = F.split(formatted, CLOSE)
    whole = F.slice(pieces, 1, F.size(pieces) - 1)

    def parse(piece: Column) -> Column:
        halves = F.split(F.substring(piece, len(OPEN) + 1, 1 << 30), r"\[INST\]")
        return F.struct(unescape(halves[0]).alias("role"),
                        unescape(F.regexp_replace(halves[1], r"\[/INST\]$", "")).alias("text"))

    return F.transform(whole, parse)


def loss_text(segments: str | Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    segments = F.col(segments) if isinstance(segments, str) else segments
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
