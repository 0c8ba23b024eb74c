"""Chat formatting of messages with typed content parts.

A message's content is an array of parts: text, image, audio or document. A visitor
turns each part into text of the output: a text part into its text, in which control
strings of the template are escaped, any other part into the placeholder of its kind.
For the others it records an attachment: its place in the conversation, its reference
and the number of tokens that its placeholder expands to. Turns stand between the
marks of their role; the loss mask is a list of byte spans that hold the learned texts
alone, without marks.

Escaping puts a backslash behind the first character of a control string, and one more
where there are backslashes already; so no control string is left inside a text, and
``read_back`` takes exactly one away.

Edge cases: rows go by turn (null first), then role, then text; repeated rows are
turns of their own; a null role or text is empty; a null part is skipped and a message
without parts is an empty one; a part of an unknown kind is a document of one page;
missing or negative sizes count as 0; conversations of a null id are one conversation;
an empty table gives an empty result; columns that are not named here are left out, so
they cannot clash. A formatted conversation is one value: 2 GB at most, as is any
string in Spark.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A content part: ``text`` of text parts; of the others a reference, and what their size is counted by.
PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"


@dataclass(frozen=True)
class Template:
    """Marks of turns, placeholders of attachments, and what they expand to. Marks of all roles differ, and open with a control string or ``said``."""

    begin: str = "<s>"
    #: role -> control strings before and behind its text, with a space between
    marked: dict[str, tuple[str, str]] = field(default_factory=lambda: {"user": ("[INST]", "[/INST]"), "system": ("[SYS]", "[/SYS]")})
    #: the role whose text stands bare before a closing control string
    said: tuple[str, str] = ("assistant", "</s>")
    #: control strings around the name and the text of any other role
    other: tuple[str, str, str] = ("[ROLE]", "[TEXT]", "[/ROLE]")
    learned: tuple[str, ...] = ("assistant",)
    placeholders: dict[str, str] = field(default_factory=lambda: {"image": "<image>", "audio": "<audio>", "document": "<document>"})
    image_patch: int = 28
    audio_per_second: float = 12.5
    page_tokens: int = 512

    @property
    def controls(self) -> list[str]:
        return [self.begin, *(m for pair in self.marked.values() for m in pair), self.said[1], *self.other, *self.placeholders.values()]

    def _inside(self, slashes: str) -> str:
        """A place, or one backslash, behind the first character of a control string."""
        heads: dict[str, list[str]] = {}
        for c in self.controls:
            heads.setdefault(c[0], []).append(re.escape(c[1:]))
        return "|".join(rf"(?<={re.escape(h)}){slashes}(?=\\*+(?:{'|'.join(rest)}))" for h, rest in heads.items())

    def escape(self, text: Column) -> Column:
        return F.regexp_replace(text, self._inside(""), r"\\")

    def unescape(self, text: Column) -> Column:
        return F.regexp_replace(text, self._inside(r"\\"), "")

    def marks(self, role: Column) -> tuple[Column, Column]:
        """What stands before and behind the text of a role."""
        first, second, last = self.other
        before, behind = F.concat(F.lit(f"{first} "), self.escape(role), F.lit(f" {second} ")), F.lit(f" {last}")
        for name, (a, b) in self.marked.items():
            before, behind = F.when(role == name, F.lit(f"{a} ")).otherwise(before), F.when(role == name, F.lit(f" {b}")).otherwise(behind)
        return F.when(role == self.said[0], F.lit(" ")).otherwise(before), F.when(role == self.said[0], F.lit(self.said[1])).otherwise(behind)

    def expanded(self, part: Column) -> Column:
        """Tokens that a placeholder stands for."""
        side = lambda n: F.ceil(F.greatest(F.coalesce(part[n], F.lit(0)), F.lit(0)) / self.image_patch)
        seconds, pages = F.greatest(F.coalesce(part["seconds"], F.lit(0.0)), F.lit(0.0)), F.greatest(F.coalesce(part["pages"], F.lit(0)), F.lit(0))
        by_kind = F.when(part["kind"] == "image", side("width") * side("height")).when(part["kind"] == "audio", F.ceil(seconds * self.audio_per_second))
        return by_kind.when(part["kind"] == "document", pages * self.page_tokens).otherwise(self.page_tokens).cast("long")


TEMPLATE = Template()


def text_part(text: Column) -> Column:
    """A content of one text part."""
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), *(F.lit(None).cast(t).alias(n) for n, t in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))))).cast(f"array<{PART}>")


def visited(parts: Column, t: Template) -> tuple[Column, Column]:
    """The text of a message, and its attachments in order."""
    known = F.filter(F.coalesce(parts, F.array().cast(f"array<{PART}>")), lambda p: p.isNotNull())

    def shown(p: Column) -> Column:
        other = F.lit(t.placeholders["document"])
        for kind, mark in t.placeholders.items():
            other = F.when(p["kind"] == kind, F.lit(mark)).otherwise(other)
        return F.when(F.coalesce(p["kind"], F.lit("text")) == "text", t.escape(F.coalesce(p["text"], F.lit("")))).otherwise(other)

    attached = F.transform(F.filter(known, lambda p: F.coalesce(p["kind"], F.lit("text")) != "text"), lambda p: F.struct(p["kind"].alias("kind"), p["ref"].alias("ref"), t.expanded(p).alias("tokens")))
    return F.concat_ws("", F.transform(known, shown)), attached


def format_chats(messages: DataFrame, template: Template = TEMPLATE, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", parts_col: str = "parts") -> DataFrame:
    """One row a conversation: conv_id, ``formatted``, ``mask`` (byte spans of the learned texts) and ``attachments`` (turn, place, kind, ref, tokens)."""
    role = F.coalesce(F.col(role_col), F.lit(""))
    text, attached = visited(F.col(parts_col), template)
    rows = messages.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("_turn"), role.alias("_role"), text.alias("_text"), attached.alias("_attached"))
    before, behind = template.marks(F.col("_role"))
    rows = rows.withColumns({"_before": before, "_behind": behind})
    rows = rows.withColumns({"_bytes": F.octet_length(F.concat("_before", "_text", "_behind")).cast("long"), "_places": F.size("_attached").cast("long")})
    order = Window.partitionBy("conv_id").orderBy(F.col("_turn").asc_nulls_first(), "_role", "_text")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({
        "_k": F.row_number().over(order),
        "_at": F.coalesce(F.sum("_bytes").over(earlier), F.lit(0)) + len(template.begin.encode()) + F.octet_length("_before"),
        "_place": F.coalesce(F.sum("_places").over(earlier), F.lit(0)),
    })
    span = F.when(F.col("_role").isin(*template.learned), F.struct(F.col("_at").alias("start"), F.octet_length("_text").cast("long").alias("length")))
    placed = F.transform("_attached", lambda a, i: F.struct((F.col("_k") - 1).cast("long").alias("turn"), (F.col("_place") + i).alias("place"), a["kind"].alias("kind"), a["ref"].alias("ref"), a["tokens"].alias("tokens")))
    turns = F.sort_array(F.collect_list(F.struct("_k", F.concat("_before", "_text", "_behind").alias("shown"), span.alias("span"), placed.alias("attached"))))
    whole = rows.groupBy("conv_id").agg(turns.alias("_turns"))
    return whole.select(
        "conv_id",
        F.concat(F.lit(template.begin), F.concat_ws("", F.transform("_turns", lambda x: x["shown"]))).alias("formatted"),
        F.filter(F.transform("_turns", lambda x: x["span"]), lambda x: x.isNotNull()).alias("mask"),
        F.flatten(F.transform("_turns", lambda x: x["attached"])).alias("attachments"),
    )


def read_back(chats: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """``turns`` (role and the unescaped ``runs`` of its text, between which the attachments stand) and ``learned`` (the unescaped texts under the mask), read from ``formatted`` and ``mask`` alone."""
    said, end = template.said
    first, second, last = map(re.escape, template.other)
    body = "(?s:.*?)"
    forms = [rf"{re.escape(a)} {body} {re.escape(b)}" for a, b in template.marked.values()] + [rf"{first} {body} {second} {body} {last}", rf" {body}{re.escape(end)}"]
    turns = F.regexp_extract_all(F.substring("formatted", len(template.begin) + 1, 2**31 - 1), F.lit("|".join(forms)), F.lit(0))
    runs = lambda text: F.transform(F.split(text, "|".join(map(re.escape, template.placeholders.values()))), template.unescape)

    def cut_off(turn: Column, before: int, behind: int) -> Column:
        return F.substring(turn, before + 1, F.length(turn) - before - behind)

    def of(turn: Column) -> Column:
        halves = F.split(cut_off(turn, len(template.other[0]) + 1, len(template.other[2]) + 1), re.escape(f" {template.other[1]} "), 2)
        found = F.struct(template.unescape(halves[0]).alias("role"), runs(halves[1]).alias("runs"))
        for name, (a, b) in template.marked.items():
            found = F.when(turn.startswith(a), F.struct(F.lit(name).alias("role"), runs(cut_off(turn, len(a) + 1, len(b) + 1)).alias("runs"))).otherwise(found)
        return F.when(turn.startswith(" "), F.struct(F.lit(said).alias("role"), runs(cut_off(turn, 1, len(end))).alias("runs"))).otherwise(found)

    # bytes are cut out in time of their length, characters of a string would be counted from its start
    raw = F.col("formatted").cast("binary")
    learned = F.transform("mask", lambda s: template.unescape(F.substring(raw, s["start"].cast("int") + 1, s["length"].cast("int")).cast("string")))
    return chats.withColumns({"turns": F.transform(turns, of), "learned": learned})
