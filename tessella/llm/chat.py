"""Chat formatting with DataFrame expressions only.

Turns of a conversation are collected as structs, sorted by turn, cut into runs of one role, and concatenated:
`<s>role<text>text<sep>text</s>` for each run. Only the template writes `<` and `[`; inside roles and texts they are escaped, so a text can't
forge a mark and the output can be read back. The loss mask lists the characters of each assistant text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RUN, TEXT, NEXT, END = "<s>", "<text>", "<sep>", "</s>"
#: Replaced in this order when text is escaped, in the opposite order when it is read back.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&lsqb;"))


def escaped(c: Column) -> Column:
    for raw, safe in ESCAPES:
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def unescaped(c: Column) -> Column:
    for raw, safe in reversed(ESCAPES):
        c = F.replace(c, F.lit(safe), F.lit(raw))
    return c


def format_chats(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learn: str = "assistant") -> DataFrame:
    """One row per conversation: (conv_id, formatted string, loss_mask array<struct<start int, chars int>>).

    start is 0-based in characters of formatted. A null role or text is empty; turns that tie sort by role, then text, and repeated rows
    all stay; a null turn sorts first; rows with a null conversation id form one conversation. Other columns are ignored, and an empty table gives no row.
    """
    turns = rows.select(F.col(conv).alias("conv_id"), F.struct(F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text")).alias("t"))
    chats = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    begins = F.filter(F.sequence(F.lit(0), F.size("t") - 1), lambda i: (i == 0) | (F.get("t", i)["role"] != F.get("t", i - 1)["role"]))
    chats = chats.withColumn("begins", begins)

    def run(i: Column, k: Column) -> Column:
        past = F.coalesce(F.get("begins", k + 1), F.size("t"))
        return F.struct(F.get("t", i)["role"].alias("role"), F.transform(F.slice("t", i + 1, past - i), lambda x: escaped(x["text"])).alias("texts"))

    chats = chats.withColumn("runs", F.transform("begins", run))
    head = lambda r: F.concat(F.lit(RUN), escaped(r["role"]), F.lit(TEXT))
    body = lambda r: F.concat(head(r), F.array_join(r["texts"], NEXT), F.lit(END))
    chats = chats.withColumn("formatted", F.array_join(F.transform("runs", body), ""))
    # Lengths of what precedes each text and of the text itself, run after run; a running sum makes them positions.
    pieces = F.flatten(F.transform("runs", lambda r: F.transform(r["texts"], lambda x, j: F.struct(
        F.when(j == 0, F.length(head(r))).otherwise(len(NEXT)).alias("before"), F.length(x).alias("chars"),
        F.when(j == F.size(r["texts"]) - 1, len(END)).otherwise(0).alias("after"), (r["role"] == learn).alias("loss")))))
    none = F.expr("cast(array() as array<struct<start:int,chars:int>>)")
    state = F.struct(F.lit(0).alias("at"), none.alias("mask"))

    def place(s: Column, p: Column) -> Column:
        at = s["at"] + p["before"]
        mask = F.when(p["loss"], F.concat(s["mask"], F.array(F.struct(at.alias("start"), p["chars"].alias("chars"))))).otherwise(s["mask"])
        return F.struct((at + p["chars"] + p["after"]).alias("at"), mask.alias("mask"))

    return chats.select("conv_id", "formatted", F.aggregate(pieces, state, place)["mask"].alias("loss_mask"))


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> of the turns in a formatted string."""
    runs = F.filter(F.split(formatted, END), lambda r: r != "")
    parsed = F.transform(runs, lambda r: F.struct(unescaped(F.split_part(F.substring(r, F.lit(len(RUN) + 1), F.length(r)), F.lit(TEXT), F.lit(1))).alias("role"), F.split(F.split_part(r, F.lit(TEXT), F.lit(2)), NEXT).alias("texts")))
    return F.flatten(F.transform(parsed, lambda r: F.transform(r["texts"], lambda x: F.struct(r["role"].alias("role"), unescaped(x).alias("text")))))


def read_loss(formatted: Column, mask: Column) -> Column:
    """The unescaped text under the loss mask."""
    return F.array_join(F.transform(mask, lambda m: unescaped(F.substring(formatted, m["start"] + 1, m["chars"]))), "")
