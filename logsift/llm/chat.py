"""Chat formatting with typed content parts, in DataFrame functions only.

A message is an array of typed parts. A visitor, one ``CASE`` over the part's type inside
``aggregate``, turns them into text: runs of text parts are escaped, image, audio and document parts
become placeholders in their place. Attachments are listed in order with their reference and the number of
tokens that their placeholder stands for.

    <|im_start|>role
    content<|im_end|>
    <|im_start|>...

Control strings inside roles and texts are escaped: a backslash is doubled and ``<|`` becomes
``<\\|``, so ``<|`` only ever starts a real mark and the original can be read back. A line break in a
role becomes ``<\\/``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END, MARK = "<|im_start|>", "<|im_end|>\n", "<|"
PART = "struct<type:string,text:string,ref:string,units:bigint>"
#: Tokens per unit: image tiles, audio seconds, document pages.
PART_TOKENS = {"image": 256, "audio": 25, "document": 512}


def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(doubled, F.lit(MARK), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    single = F.replace(text, F.lit("<\\|"), F.lit(MARK))
    return F.replace(single, F.lit("\\\\"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("<\\/"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<\\/"), F.lit("\n")))


def text_part(text: Column) -> Column:
    """A message of one text part."""
    none = F.lit(None)
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), none.alias("ref"), none.alias("units")).cast(PART))


def _is_attachment(part: Column) -> Column:
    return F.coalesce(part["type"].isin(*PART_TOKENS), F.lit(False))


def _content(parts: Column) -> Column:
    """The text of a message; a part of unknown or null type counts as text, a null text is empty.

    Neighbouring texts are joined before they are escaped, so no control string can be put together from
    pieces that are harmless one by one.
    """
    empty = F.struct(F.lit("").alias("out"), F.lit("").alias("run"))

    def visit(state: Column, part: Column) -> Column:
        mark = F.concat(F.lit(MARK), part["type"], F.lit("|>"))
        attached = F.struct(F.concat(state["out"], escape(state["run"]), mark).alias("out"), F.lit("").alias("run"))
        text = F.concat(state["run"], F.coalesce(part["text"], F.lit("")))
        return F.when(_is_attachment(part), attached).otherwise(F.struct(state["out"].alias("out"), text.alias("run")))

    return F.aggregate(parts, empty, visit, lambda state: F.concat(state["out"], escape(state["run"])))


def _attachment(part: Column) -> Column:
    tokens = F.lit(1).cast("bigint")
    for kind, per_unit in PART_TOKENS.items():
        units = F.greatest(F.coalesce(part["units"], F.lit(1)), F.lit(1))
        tokens = F.when(part["type"] == kind, units * per_unit).otherwise(tokens)
    return F.struct(part["type"].alias("type"), part["ref"].alias("ref"), tokens.alias("tokens"))


def format_conversations(messages: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_spans, attachments, attachment_tokens) of messages.

    ``messages`` has conv_id, turn, role and parts (an array of ``PART``). Turns are ordered by turn
    number, null first, then role, then content; repeated rows are separate turns. Null roles and
    parts are empty. ``loss_spans`` are the 0-based half-open code point ranges of the contents of
    assistant turns, the only text under the loss mask. A null conv_id is one conversation. No rows,
    no conversations. One conversation is one row, so it must fit into one task.
    """
    parts = F.coalesce("parts", F.array().cast(f"array<{PART}>"))
    turn = F.struct(
        F.col("turn").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        _content(parts).alias("content"),
        F.transform(F.filter(parts, _is_attachment), _attachment).alias("attachments"),
    )
    grouped = messages.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    head = lambda t: F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n"))
    whole = lambda t: F.concat(head(t), t["content"], F.lit(END))
    empty = F.array().cast("array<struct<start:int,end:int>>")

    def span(state: Column, t: Column) -> Column:
        start = state["at"] + F.length(head(t))
        end = start + F.length(t["content"])
        own = F.array(F.struct(start.alias("start"), end.alias("end")))
        spans = F.when(t["role"] == "assistant", F.concat(state["spans"], own)).otherwise(state["spans"])
        return F.struct((end + len(END)).alias("at"), spans.alias("spans"))

    return grouped.select(
        "conv_id",
        F.array_join(F.transform("turns", whole), "").alias("formatted"),
        F.aggregate("turns", F.struct(F.lit(0).alias("at"), empty.alias("spans")), span)["spans"].alias("loss_spans"),
        F.flatten("turns.attachments").alias("attachments"),
    ).withColumn(
        "attachment_tokens",
        F.aggregate("attachments", F.lit(0).cast("bigint"), lambda n, a: n + a["tokens"]),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation as an array of (role, text), read by its marks.

    Attachment placeholders stay in the text as they are.
    """
    pieces = F.slice(F.split(formatted, r"<\|im_start\|>"), 2, 2_000_000_000)

    def turn(piece: Column) -> Column:
        body = F.substring(piece, F.lit(1), F.length(piece) - len(END))
        at = F.instr(body, "\n")
        role = F.substring(body, F.lit(1), at - 1)
        text = F.substring(body, at + 1, F.length(body))
        return F.struct(unescape_role(role).alias("role"), unescape(text).alias("text"))

    return F.transform(pieces, turn)


def loss_text(formatted: Column, spans: Column) -> Column:
    """The text under the loss mask, unescaped."""
    piece = lambda s: unescape(F.substring(formatted, s["start"] + 1, s["end"] - s["start"]))
    return F.array_join(F.transform(spans, piece), "")
