"""Chat formatting from event logs, in DataFrame functions alone.

A log row is an event: ``conv_id``, ``seq`` (its place in the conversation),
``role``, ``text`` and, where messages arrive in parts, ``message_id`` and
``kind``. Events of one message fold in order of ``seq``:

    message         a message begins with this text (a second one of the same
                    ``message_id`` begins another message)
    edit            the text so far is replaced by this text
    regenerate      the text so far is discarded, and this text begins anew
    delta           this text is appended (so is that of any other or no kind)

A message stands where its first event stood and has the role of its first
event with one. A row without ``message_id`` is a whole message, and so is every
row of a log without such columns. The log is dealt out by conversation once;
folding and rendering both happen there. Messages of a
conversation, by sequence, render as

    <turn:ROLE>\\n TEXT </turn>\\n

(without the spaces) with ``\\`` written ``\\b``, ``<`` written ``\\l`` and, in
roles, ``>`` written ``\\g``; so no text can hold a mark, and parsing gives
back every role and text.

Defined cases: null role or text counts as empty; events of a message with equal
seq go by kind, then role, then text, and messages with equal seq by role, then
text; repeated messages are messages of their own; rows with null seq
come first; rows with null conv_id form one conversation; an empty table gives
an empty table; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN_END = "</turn>\n"
_OPEN = "<turn:"
_HEAD_END = ">\n"
ASSISTANT = "assistant"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def unescaped(text: Column) -> Column:
    """Every backslash is followed by its letter, so the order of these replacements is safe."""
    return F.replace(F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\g"), F.lit(">")), F.lit("\\b"), F.lit("\\"))


def fold_events(events: DataFrame) -> DataFrame:
    """Messages (conv_id, seq, role, text) of a log; its order within a conversation is that of ``seq``."""
    known = set(events.columns)
    message = F.col("message_id").cast("string") if "message_id" in known else F.lit(None).cast("string")
    kind = F.coalesce(F.col("kind"), F.lit("delta")) if "kind" in known else F.lit("delta")
    log = events.select("conv_id", "seq", "role", "text", message.alias("message_id"), F.when(message.isNull(), "message").otherwise(kind).alias("kind")).repartition("conv_id")
    row = F.struct(F.col("seq"), F.col("kind"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    begins = F.array_union(F.array(F.lit(0)), F.filter(F.transform("parts", lambda p, i: F.when(p["kind"] == "message", i)), lambda i: i.isNotNull()))
    until = lambda i: F.coalesce(F.get("begins", i + 1), F.size("parts"))
    # The last reset and all that follow it.
    last = F.array_max(F.transform("said", lambda p, i: F.when(p["kind"].isin("message", "edit", "regenerate"), i).otherwise(F.lit(0))))
    return (
        log.groupBy("conv_id", "message_id")
        .agg(F.sort_array(F.collect_list(row)).alias("parts"))
        .withColumn("begins", begins)
        .select("conv_id", F.explode(F.transform("begins", lambda b, i: F.slice("parts", b + 1, until(i) - b))).alias("said"))
        .select(
            "conv_id",
            F.col("said")[0]["seq"].alias("seq"),
            F.coalesce(F.get(F.filter("said", lambda p: p["role"] != ""), F.lit(0))["role"], F.lit("")).alias("role"),
            F.array_join(F.transform(F.slice("said", last + 1, F.size("said")), lambda p: p["text"]), "").alias("text"),
        )
    )


def format_chats(events: DataFrame) -> DataFrame:
    """One row per conversation: ``formatted`` and ``loss_spans``.

    A loss span (turn, start, end) is an assistant text's place in code points
    within its rendered turn; turns end with the mark, which no text can hold.
    """
    messages = fold_events(events)
    turn = F.struct(F.col("seq"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    head = lambda t: F.concat(F.lit(_OPEN), F.replace(escaped(t["role"]), F.lit(">"), F.lit("\\g")), F.lit(_HEAD_END))
    return (
        messages.groupBy("conv_id")
        .agg(F.sort_array(F.collect_list(turn)).alias("turns"))
        .select("conv_id", F.transform("turns", lambda t: F.struct(head(t).alias("head"), escaped(t["text"]).alias("body"), (t["role"] == ASSISTANT).alias("learn"))).alias("turns"))
        .select(
            "conv_id",
            F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(TURN_END))), "").alias("formatted"),
            F.filter(
                F.transform("turns", lambda t, i: F.when(t["learn"], F.struct(i.alias("turn"), F.length(t["head"]).alias("start"), (F.length(t["head"]) + F.length(t["body"])).alias("end")))),
                lambda s: s.isNotNull(),
            ).alias("loss_spans"),
        )
    )


def parse_chats(formatted: DataFrame) -> DataFrame:
    """Read back: ``turns`` array of (role, text) and ``loss_texts`` under the mask, unescaped."""
    turns = F.slice(F.split("formatted", TURN_END), 1, F.greatest(F.size(F.split("formatted", TURN_END)) - 1, F.lit(0)))
    locate = lambda t: F.call_function("locate", F.lit(_HEAD_END), t)
    return formatted.withColumn("rendered", turns).select(
        *formatted.columns,
        F.transform(
            "rendered",
            lambda t: F.struct(
                unescaped(F.substring(t, F.lit(len(_OPEN) + 1), locate(t) - 1 - len(_OPEN))).alias("role"),
                unescaped(F.substring(t, locate(t) + len(_HEAD_END), F.length(t))).alias("text"),
            ),
        ).alias("turns"),
        F.transform("loss_spans", lambda s: unescaped(F.substring(F.get("rendered", s["turn"]), s["start"] + 1, s["end"] - s["start"]))).alias("loss_texts"),
    )
