"""Chat formatting with typed content parts.

A message is a list of parts of type text, image, audio or document. A visitor, written as one expression
for each type, turns the parts into ordered text and placeholders and records, for every attachment, its
ordinal, type, reference and the tokens its placeholder expands to. Turns are joined under a template whose
control strings can't stand inside a text: `&`, `<` and `[` are written as entities, so `<|` only ever
opens a mark of the template, and reading back is exact.

One conversation becomes one string, so it must fit a row, as the format asks; nothing else is gathered
by key. Null roles and texts count as empty, null conversations are one conversation, null turns stand
first, and rows that tie on the turn are ordered by role, then by their text as it is before it is escaped, with
placeholders where attachments stand, each by code point. Rows that repeat are turns of their own; long texts stay
whole. An empty table gives an empty result.
Other columns are ignored. No Python runs on executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick

OPEN, BREAK, CLOSE = "<|turn|>", "\n", "<|end|>\n"
TYPES = ("text", "image", "audio", "document")
#: Tokens that a placeholder stands for where its part doesn't say.
EXPANDS = {"image": 576, "audio": 250, "document": 1024}
PART = "struct<type:string,text:string,ref:string,tokens:int>"

#: What is escaped, and how, in the order of escaping.
ENTITIES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&lsqb;"))


def escape(text: Column) -> Column:
    for plain, entity in ENTITIES:
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def unescape(text: Column) -> Column:
    for plain, entity in reversed(ENTITIES):
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return text


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("&NewLine;"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("&NewLine;"), F.lit("\n")))


def visit(part: Column) -> Column:
    """The text of one part under the template: escaped text, or a placeholder. Types that aren't known, and null, are text."""
    shown = escape(F.coalesce(part["text"], F.lit("")))
    for kind in TYPES[1:]:
        shown = F.when(part["type"] == kind, F.lit(f"<|{kind}|>")).otherwise(shown)
    return shown


def tokens(part: Column) -> Column:
    n = F.lit(0)
    for kind, most in EXPANDS.items():
        n = F.when(part["type"] == kind, F.coalesce(part["tokens"], F.lit(most))).otherwise(n)
    return n


def text_part(text: Column) -> Column:
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("tokens")))


def in_order(a: Column, b: Column) -> Column:
    """How two turns compare. Texts are unescaped only where turn and role are equal."""
    less = lambda x, y: F.when(x < y, -1).when(x > y, 1).otherwise(0)
    turn = F.when(a["turn"].isNull() | b["turn"].isNull(), b["turn"].isNull().cast("int") - a["turn"].isNull().cast("int")).otherwise(less(a["turn"], b["turn"]))
    return F.when(turn != 0, turn).when(a["role"] != b["role"], less(a["role"], b["role"])).otherwise(less(unescape(a["body"]), unescape(b["body"])))


def format_chats(messages: DataFrame, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """messages: conv_id, turn, role, parts (array<{PART}>). A row per conversation: conv_id, n_turns,
    formatted, loss_spans (start, chars; code points from 0 within formatted, over the texts of trained
    roles), attachments (ordinal, type, ref, tokens) and attachment_tokens."""
    body = F.array_join(F.transform(F.coalesce("parts", F.array().cast(f"array<{PART}>")), visit), "")
    role = F.coalesce("role", F.lit(""))
    turns = pick(messages, "conv_id", "turn", "role", "parts").select("conv_id", "turn", role.alias("role"), body.alias("body"), F.coalesce("parts", F.array().cast(f"array<{PART}>")).alias("parts"))
    head = F.concat(F.lit(OPEN), escape_role(F.col("role")), F.lit(BREAK))
    turn = F.struct(
        "turn", "role", "body",
        head.alias("head"),
        F.char_length(head).cast("long").alias("head_chars"),
        F.char_length("body").cast("long").alias("body_chars"),
        F.col("role").isin(*trained).alias("learn"),
        F.filter("parts", lambda p: p["type"].isin(*EXPANDS)).alias("files"),
    )
    per = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn), in_order).alias("t"))
    nothing = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,chars:bigint>>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        at = acc["at"] + t["head_chars"]
        span = F.array(F.struct(at.alias("start"), t["body_chars"].alias("chars")))
        return F.struct((at + t["body_chars"] + len(CLOSE)).alias("at"), F.when(t["learn"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    files = F.flatten(F.transform("t", lambda t: t["files"]))
    listed = F.transform(files, lambda p, i: F.struct(i.alias("ordinal"), p["type"].alias("type"), p["ref"].alias("ref"), tokens(p).alias("tokens")))
    return per.select(
        "conv_id",
        F.size("t").cast("long").alias("n_turns"),
        F.array_join(F.transform("t", lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE))), "").alias("formatted"),
        F.aggregate("t", nothing, step, lambda a: a["spans"]).alias("loss_spans"),
        listed.alias("attachments"),
    ).withColumn("attachment_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda s, a: s + a["tokens"]))


def read_turns(formatted: Column) -> Column:
    """array<struct<role,text>> out of a formatted conversation; placeholders stay as they are."""
    pieces = F.split(formatted, r"<\|end\|>\n")
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)

    def one(p: Column) -> Column:
        rest = F.substr(p, F.lit(len(OPEN) + 1))
        at = F.instr(rest, BREAK)
        return F.struct(unescape_role(F.substr(rest, F.lit(1), at - 1)).alias("role"), unescape(F.substr(rest, at + 1)).alias("text"))

    return F.transform(pieces, one)


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), s["chars"].cast("int")))), "")
