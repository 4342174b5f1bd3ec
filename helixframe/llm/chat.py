"""Chat formatting with typed content parts, in DataFrame functions only.

A conversation is rows of (conversation, turn, role, parts); ``parts`` is an
array of {kind, text, ref, amount}: text, image, audio or document. The visitor
flattens each turn's parts in order: text is escaped, an attachment becomes a
placeholder and is recorded with its reference and expanded token count. A turn
is rendered ``<s>[INST]role[/INST]body</s>``; the control strings ``<s>``,
``</s>``, ``[INST]``, ``[/INST]`` and the placeholders can only come from the
template, because one backslash is put after the first character of every
control string inside a role or text, and of every string that already is an
escaped one. Removing one backslash there restores the text exactly.

The loss mask is a list of spans (byte offset and length in the UTF-8 output),
one per trained turn: its body.

Defined cases: null role, text and kind count as empty (an empty kind is text);
null or empty ``parts`` give an empty body; unknown kinds become a document
placeholder; rows of one conversation are ordered by turn (null first), then
role, then body, so ties and repeated rows have one order and all stay; a null
conversation id is a conversation of its own. One conversation is one output
row, so it must fit in a row (2 GB).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The template's control strings, each without its first character.
CONTROL = ("s>", "/s>", "INST]", "/INST]", "image>", "audio>", "document>")
ESCAPE = r"([<\[])(\\*)(" + "|".join(c.replace("]", r"\]") for c in CONTROL) + ")"
UNESCAPE = r"([<\[])\\(\\*)(" + "|".join(c.replace("]", r"\]") for c in CONTROL) + ")"

#: Expanded tokens per unit of ``amount``: an image's patches, an audio's seconds, a document's pages.
TOKENS_PER_UNIT = {"image": 1.0, "audio": 12.5, "document": 600.0}

PART = T.StructType([T.StructField("kind", T.StringType()), T.StructField("text", T.StringType()),
                     T.StructField("ref", T.StringType()), T.StructField("amount", T.DoubleType())])


def escape(c: Column) -> Column:
    return F.regexp_replace(c, ESCAPE, r"$1\\$2$3")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, UNESCAPE, "$1$2$3")


def text_part(text: Column) -> Column:
    """A single text part, for tables whose turns are plain text."""
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), F.lit(None).cast("string").alias("ref"),
                            F.lit(None).cast("double").alias("amount")))


def _kind(part: Column) -> Column:
    kind = F.coalesce(part["kind"], F.lit(""))
    return (F.when(kind.isin("", "text"), F.lit("text")).when(kind.isin("image", "audio"), kind)
            .otherwise(F.lit("document")))


def _render(part: Column) -> Column:
    kind = _kind(part)
    return (F.when(kind == "text", escape(F.coalesce(part["text"], F.lit(""))))
            .otherwise(F.concat(F.lit("<"), kind, F.lit(">"))))


def _expanded(part: Column) -> Column:
    rate = F.lit(0.0)
    for kind, per_unit in TOKENS_PER_UNIT.items():
        rate = F.when(_kind(part) == kind, F.lit(per_unit)).otherwise(rate)
    return F.ceil(rate * F.coalesce(part["amount"], F.lit(0.0))).cast("long")


def visit(parts: Column) -> tuple[Column, Column]:
    """Flatten ordered parts: the body text, and the attachments {part, kind, ref, n_tokens} in order."""
    parts = F.coalesce(parts, F.array().cast(T.ArrayType(PART)))
    body = F.array_join(F.transform(parts, _render), "")
    found = F.transform(parts, lambda p, i: F.struct(i.alias("part"), _kind(p).alias("kind"), p["ref"].alias("ref"),
                                                     _expanded(p).alias("n_tokens")))
    return body, F.filter(found, lambda a: a["kind"] != "text")


def format_chat(df: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role",
                parts: str = "parts", trained: Sequence[str] = ("assistant",)) -> DataFrame:
    """One row per conversation: ``formatted``, ``loss_spans`` (start, n: bytes), ``attachments``, ``expanded_tokens``.

    Only the four named columns are read, so other columns cannot clash. The
    shuffle carries rendered turns; a conversation is gathered because its
    output is one text.
    """
    body, found = visit(F.col(parts))
    rows = df.select(F.col(conversation).alias("conv"), F.struct(
        F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), body.alias("body"),
        found.alias("attachments")).alias("row"))
    turns = rows.groupBy("conv").agg(F.sort_array(F.collect_list("row")).alias("turns"))
    pieces = F.transform("turns", lambda t: F.struct(
        F.concat(F.lit("<s>[INST]"), escape(t["role"]), F.lit("[/INST]")).alias("head"), t["body"].alias("body"),
        t["role"].isin(list(trained)).alias("trained"), t["attachments"].alias("attachments")))
    # byte sizes of heads, bodies and the closing marker, summed once from left to right
    start = F.struct(F.lit(0).cast("long").alias("at"),
                     F.array().cast("array<struct<start:bigint,n:bigint>>").alias("spans"))

    def step(acc, t):
        body_at = acc["at"] + F.octet_length(t["head"])
        span = F.struct(body_at.alias("start"), F.octet_length(t["body"]).cast("long").alias("n"))
        return F.struct((body_at + F.octet_length(t["body"]) + F.lit(4)).alias("at"),
                        F.when(t["trained"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
                        .alias("spans"))

    gathered = turns.select("conv", pieces.alias("p"))
    out = gathered.select(
        F.col("conv").alias(conversation), F.size("p").cast("long").alias("n_turns"),
        F.array_join(F.transform("p", lambda t: F.concat(t["head"], t["body"], F.lit("</s>"))), "").alias("formatted"),
        F.aggregate("p", start, step, lambda acc: acc["spans"]).alias("loss_spans"),
        F.flatten(F.transform("p", lambda t, i: F.transform(t["attachments"], lambda a: F.struct(
            i.alias("turn_index"), a["part"].alias("part"), a["kind"].alias("kind"), a["ref"].alias("ref"),
            a["n_tokens"].alias("n_tokens"))))).alias("attachments"))
    return out.withColumn("expanded_tokens", F.aggregate(
        "attachments", F.lit(0).cast("long"), lambda s, a: s + a["n_tokens"]))


def parse_turns(formatted: Column) -> Column:
    """Read turns {role, body} back from formatted text; texts are unescaped, placeholders stay as rendered."""
    segments = F.split(formatted, "</s>", -1)
    segments = F.slice(segments, F.lit(1), F.size(segments) - 1)

    def turn(seg):
        close = F.instr(seg, "[/INST]")
        return F.struct(unescape(seg.substr(F.lit(10), close - 10)).alias("role"),
                        unescape(seg.substr(close + 7, F.length(seg))).alias("body"))

    return F.transform(segments, turn)


def masked_texts(formatted_utf8: Column, loss_spans: Column) -> Column:
    """The unescaped texts under the loss mask, in order; ``formatted_utf8`` is the encoded output (binary)."""
    return F.transform(loss_spans, lambda s: unescape(F.decode(
        F.substring(formatted_utf8, s["start"].cast("int") + 1, s["n"].cast("int")), "UTF-8")))
