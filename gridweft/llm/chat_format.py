"""Chat formatting with typed content parts, with DataFrame operations only.

A turn has a role and content parts in order.  A visitor turns each part into text: text parts are escaped, the others become a
placeholder such as ``<|image:0|>``, numbered through the conversation's turn, with their reference and the number of tokens that
they expand to recorded beside it.  The template puts marks around a turn::

    <|im_start|>role\\ncontent<|im_end|>\\n

In roles and texts a backslash is doubled and ``<|`` is written with a backslash between its characters, so that no text can form
a mark or a placeholder, and reading back restores it exactly.  The loss mask covers the content of assistant turns.

``format_turns`` has one row per turn, so a conversation of any length stays spread; ``assemble`` joins a conversation to one string
for those who need it as such.  Turns follow ``turn``, then role and content on a tie; repeated rows are repeated turns; a null turn
comes first.  Null roles and texts are empty, a turn without parts has empty content, and parts of an unknown kind are an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

START, END = "<|im_start|>", "<|im_end|>"
ATTACHMENTS = ("image", "audio", "document")
# tokens of a placeholder: an image costs its patches, audio its frames, a document its pages
PATCH_SIDE, FRAMES_PER_SECOND, TOKENS_PER_PAGE = 14, 50, 1024
PART = "struct<kind: string, text: string, ref: string, width: int, height: int, seconds: double, pages: int>"


def escaped(text: Column) -> Column:
    text = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    return F.replace(text, F.lit("<|"), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    """One pass: a backslash gives way to what follows it."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def escaped_role(role: Column) -> Column:
    """As ``escaped``, with line ends written as ``\\n``: a role ends at the first line end."""
    return F.replace(escaped(role), F.lit("\n"), F.lit("\\n"))


def unescaped_role(role: Column) -> Column:
    return unescaped(F.regexp_replace(role, r"(?<!\\)((?:\\\\)*)\\n", "$1\n"))


def expanded_tokens(part: Column) -> Column:
    """Tokens that an attachment takes in place of its placeholder."""
    patches = F.ceil(F.coalesce(part["width"], F.lit(0)) / PATCH_SIDE) * F.ceil(F.coalesce(part["height"], F.lit(0)) / PATCH_SIDE)
    return (
        F.when(part["kind"] == "image", patches)
        .when(part["kind"] == "audio", F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * FRAMES_PER_SECOND))
        .when(part["kind"] == "document", F.coalesce(part["pages"], F.lit(0)) * TOKENS_PER_PAGE)
        .cast("bigint")
    )


def _text_part(text: Column) -> Column:
    values = {"kind": F.lit("text"), "text": text}
    fields = (f.split(": ") for f in PART[len("struct<") : -1].split(", "))
    return F.struct(*(values.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in fields))


def visit_parts(parts: Column) -> tuple[Column, Column]:
    """Content of a turn, and its attachments: placeholder, kind, reference and expanded tokens, in order.

    Texts that follow one another are escaped as if they were one: a bar at the start of a text after a text gets a backslash, so that
    no mark can form where they meet.
    """
    parts = F.coalesce(parts, F.array().cast(f"array<{PART}>"))
    placed = F.transform(parts, lambda p, i: F.struct(i.alias("at"), p.alias("part"), F.get(parts, i - 1)["kind"].alias("before")))
    texts = F.filter(placed, lambda x: x["part"]["kind"] == "text")
    attached = F.filter(placed, lambda x: ~F.coalesce(x["part"]["kind"] == "text", F.lit(False)))

    def written(x: Column) -> Column:
        text = escaped(x["part"]["text"])
        return F.when((x["before"] == "text") & F.startswith(text, F.lit("|")), F.concat(F.lit("\\"), text)).otherwise(text)

    def mark(x: Column, n: Column) -> Column:
        kind = x["part"]["kind"]
        unknown = F.raise_error(F.concat(F.lit("unknown kind of part: "), F.coalesce(kind, F.lit("null")))).cast("string")
        return F.when(kind.isin(*ATTACHMENTS), F.concat(F.lit("<|"), kind, F.lit(":"), n.cast("string"), F.lit("|>"))).otherwise(unknown)

    attachments = F.transform(
        attached,
        lambda x, n: F.struct(
            mark(x, n).alias("placeholder"),
            x["part"]["kind"].alias("kind"),
            x["part"]["ref"].alias("ref"),
            expanded_tokens(x["part"]).alias("tokens"),
        ),
    )
    marks = F.transform(attached, lambda x, n: F.struct(x["at"].alias("at"), mark(x, n).alias("written")))
    pieces = F.concat(F.transform(texts, lambda x: F.struct(x["at"].alias("at"), written(x).alias("written"))), marks)
    return F.array_join(F.transform(F.array_sort(pieces), lambda x: x["written"]), ""), attachments


def format_turns(turns: DataFrame) -> DataFrame:
    """One row per turn of ``conv_id``, ``turn``, ``role`` and ``parts`` (a list of ``PART``), or ``text``, which then is the only part.

    ``piece`` is the turn's share of the output, ``loss_start`` and ``loss_length`` its masked stretch in code points from the start
    of the piece (length 0 outside assistant turns), ``attachments`` its attachments.
    """
    if "parts" not in turns.columns:
        turns = turns.withColumn("parts", F.array(_text_part(F.col("text"))))
    content, attachments = visit_parts(F.col("parts"))
    head = F.concat(F.lit(START), escaped_role(F.col("role")), F.lit("\n"))
    loss = F.coalesce(F.col("role") == "assistant", F.lit(False))
    return turns.select(
        "conv_id", "turn", "role", content.alias("content"), attachments.alias("attachments"), head.alias("head"), loss.alias("loss")
    ).select(
        "conv_id",
        "turn",
        "role",
        F.concat("head", "content", F.lit(END + "\n")).alias("piece"),
        F.length("head").cast("bigint").alias("loss_start"),
        F.when(F.col("loss"), F.length("content")).otherwise(0).cast("bigint").alias("loss_length"),
        "attachments",
    )


def place_turns(formatted: DataFrame) -> DataFrame:
    """``format_turns`` with ``offset``: where the piece starts in its conversation, in code points."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "piece").rowsBetween(Window.unboundedPreceding, -1)
    return formatted.withColumn("offset", F.coalesce(F.sum(F.length("piece").cast("bigint")).over(order), F.lit(0)))


def read_turn(piece: Column) -> tuple[Column, Column]:
    """Role and content of a turn, read back from its piece; placeholders stay as they are."""
    body = F.substr(piece, F.lit(len(START) + 1), F.length(piece) - (len(START) + len(END) + 1))
    cut = F.locate("\n", body)
    return unescaped_role(F.substr(body, F.lit(1), cut - 1)), unescaped(F.substr(body, cut + 1))


def assemble(formatted: DataFrame) -> DataFrame:
    """One row per conversation: ``pieces`` in order, ``formatted``, the loss ``mask`` in code points, and ``attachments``.

    A conversation becomes one row here, as its string must; rows of ``place_turns`` have the same content spread out.
    """
    fields = ("turn", "role", "piece", "offset", "loss_start", "loss_length", "attachments")
    listed = place_turns(formatted).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("pieces"))
    starts = F.transform(
        "pieces", lambda p: F.struct((p["offset"] + p["loss_start"]).alias("start"), p["loss_length"].alias("length"))
    )
    return listed.select(
        "conv_id",
        "pieces",
        F.array_join("pieces.piece", "").alias("formatted"),
        F.filter(starts, lambda m: m["length"] > 0).alias("mask"),
        F.flatten("pieces.attachments").alias("attachments"),
    )
