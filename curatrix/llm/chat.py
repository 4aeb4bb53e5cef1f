"""Chat formatting with typed content parts, in DataFrame functions only.

A message holds parts: array<struct<type, text, ref, width, height, seconds, pages>>. A visitor maps each part to
its place in the output: text is escaped, an attachment becomes a placeholder, and its reference and the number of
tokens that a model spends on it are recorded in order. The template is

    <|im_start|>ROLE \\n BODY <|im_end|> \\n

Texts can't forge a control string: between "<" and "|" one backslash is added to however many stand there, so no
"<|" is left, and taking one away restores the text exactly."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
START, END, NEWLINE = "<|im_start|>", "<|im_end|>", "<|nl|>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


@dataclass(frozen=True)
class PartVisitor:
    """What becomes of each kind of part; another kind counts as a document without pages."""

    patch: int = 28
    audio_tokens_per_second: float = 25.0
    page_tokens: int = 256

    def text(self, part: Column) -> Column:
        return escape(F.coalesce(part["text"], F.lit("")))

    def placeholder(self, kind: str) -> Column:
        return F.lit(f"<|{kind}|>")

    def image_tokens(self, part: Column) -> Column:
        across, down = (F.ceil(F.coalesce(part[x], F.lit(0)) / self.patch) for x in ("width", "height"))
        return across * down

    def audio_tokens(self, part: Column) -> Column:
        return F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * self.audio_tokens_per_second)

    def document_tokens(self, part: Column) -> Column:
        return F.coalesce(part["pages"], F.lit(0)).cast("long") * self.page_tokens

    def visit(self, part: Column) -> Column:
        """The part's output text."""
        kind = part["type"]
        return F.when(kind.isNull() | (kind == "text"), self.text(part)).when(kind == "image", self.placeholder("image")).when(kind == "audio", self.placeholder("audio")).otherwise(self.placeholder("document"))

    def attachment(self, part: Column) -> Column:
        """The part's reference and expanded token count."""
        kind = part["type"]
        tokens = F.when(kind == "image", self.image_tokens(part)).when(kind == "audio", self.audio_tokens(part)).otherwise(self.document_tokens(part))
        return F.struct(kind.alias("type"), part["ref"].alias("ref"), tokens.cast("long").alias("tokens"))

    def is_attachment(self, part: Column) -> Column:
        return part["type"].isNotNull() & (part["type"] != "text")


def _filled(part: Column) -> Column:
    """A part whose missing text is empty, so that it is ordered like one."""
    return part.withField("text", F.when(part["type"].isNull() | (part["type"] == "text"), F.coalesce(part["text"], F.lit(""))).otherwise(part["text"]))


def format_chats(messages: DataFrame, visitor: PartVisitor | None = None, train_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(conv_id, formatted, segments, attachments, expanded_tokens) from messages (conv_id, turn, role, parts).

    segments: array<struct<text, loss>>, whose texts joined are `formatted`; loss marks the bodies of train_roles.
    Turns are ordered by turn (null first), then role and parts as they came, so equal turns give the same output on every run.
    Null roles, texts and part lists count as empty; rows with a null conv_id form one conversation. Repeated rows
    are repeated turns. Other columns are not read."""
    visitor = visitor or PartVisitor()
    none = F.array().cast(f"array<{PART}>")
    given = F.struct(F.col("turn").alias("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.transform(F.coalesce(F.col("parts"), none), _filled).alias("parts"))
    grouped = messages.select("conv_id", given.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("given"))

    def visited(t: Column) -> Column:
        return F.struct(
            F.replace(escape(t["role"]), F.lit("\n"), F.lit(NEWLINE)).alias("role"),
            F.array_join(F.transform(t["parts"], visitor.visit), "").alias("body"),
            t["role"].isin(*train_roles).alias("loss"),
            F.transform(F.filter(t["parts"], visitor.is_attachment), visitor.attachment).alias("attachments"),
        )

    grouped = grouped.select("conv_id", F.transform("given", visited).alias("turns"))

    def pieces(t: Column) -> Column:
        piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        return F.array(piece(F.concat(F.lit(START), t["role"], F.lit("\n")), F.lit(False)), piece(t["body"], t["loss"]), piece(F.lit(END + "\n"), F.lit(False)))

    out = grouped.select("conv_id", F.flatten(F.transform("turns", pieces)).alias("segments"), F.flatten(F.transform("turns", lambda t: t["attachments"])).alias("attachments"))
    formatted = F.array_join(F.transform("segments", lambda s: s["text"]), "")
    expanded = F.aggregate("attachments", F.lit(0).cast("long"), lambda total, x: total + F.coalesce(x["tokens"], F.lit(0)))
    return out.select("conv_id", formatted.alias("formatted"), "segments", "attachments", expanded.alias("expanded_tokens"))


def parse(formatted: Column) -> Column:
    """The turns that a formatted conversation holds: array<struct<role, text>>, unescaped."""
    pieces = F.split(formatted, r"<\|im_end\|>\n")

    def turn(piece: Column) -> Column:
        inner = F.substr(piece, F.lit(len(START) + 1))
        role = F.substring_index(inner, "\n", 1)
        body = F.substr(inner, F.length(role) + 2)
        return F.struct(unescape(F.replace(role, F.lit(NEWLINE), F.lit("\n"))).alias("role"), unescape(body).alias("text"))

    return F.transform(F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0))), turn)


def loss_text(segments: Column) -> Column:
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
