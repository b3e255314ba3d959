"""Chat formatting from an event log, with DataFrame functions only.

A log has conv_id, seq, kind, message_id, role and text. Per conversation, events apply in the order of seq (ties: kind
``message`` first, then role, then text; nulls first):

``message``     opens a message with this text; it is a new one even where message_id was seen before
``delta``       appends text to the message
``edit``        replaces the text that the message has
``regenerate``  drops the text that the message has; deltas that follow build it anew

The last three go to the latest message of their message_id; where none was opened, they open one. Messages stand in the
order of their first event. Events fold per (conversation, message), so that only finished messages of a conversation
meet in one row.

Template: ``<turn>### role: text</turn>\\n``. Inside texts and roles, backslash, ``<`` and ``#`` become ``\\b``, ``\\l`` and
``\\h`` (in roles also ``:`` becomes ``\\c``), so that no control string can occur in them and reading back is exact. The
loss mask covers the texts of assistant turns.

Defined results: a null text or role is empty; an unknown kind counts as ``message``; a null conv_id is a conversation of
its own; repeated rows are turns of their own; an empty log gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, HEAD, MID, CLOSE = "<turn>", "### ", ": ", "</turn>\n"


def escaped(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\b"))
    return F.replace(F.replace(out, F.lit("<"), F.lit("\\l")), F.lit("#"), F.lit("\\h"))


def unescaped(text: Column) -> Column:
    out = F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\h"), F.lit("#"))
    return F.replace(out, F.lit("\\b"), F.lit("\\"))


def events_of_rows(rows: DataFrame) -> DataFrame:
    """Plain (conv_id, turn, role, text) rows as a log in which each row is a message."""
    return rows.select("conv_id", F.col("turn").alias("seq"), F.lit("message").alias("kind"), F.col("turn").alias("message_id"), "role", "text")


def streamed(rows: DataFrame) -> DataFrame:
    """The same turns as a log of how they may have come about; folding it gives them back.

    A user's text is first sent with a slip and then edited. An assistant's is opened empty, a first answer is streamed and
    dropped by a regeneration, and the final text is streamed in two deltas. Rows of one turn keep apart by their number.
    """
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    numbered = rows.select("conv_id", n.cast("long").alias("message_id"), "role", F.coalesce("text", F.lit("")).alias("text"))
    half = (F.length("text") / 2).cast("int")
    kind = lambda name, text: F.struct(F.lit(name).alias("kind"), text.alias("text"))
    answer = F.array(kind("message", F.lit("")), kind("delta", F.concat(F.lit("draft: "), F.col("text"))), kind("regenerate", F.lit("")), kind("delta", F.substring(F.col("text"), F.lit(1), half)), kind("delta", F.substring(F.col("text"), half + 1, F.length("text"))))
    said = F.array(kind("message", F.concat(F.lit("slip: "), F.col("text"))), kind("edit", F.col("text")))
    steps = F.posexplode(F.when(F.col("role") == "assistant", answer).otherwise(said)).alias("step", "e")
    return numbered.select("conv_id", "message_id", "role", steps).select("conv_id", (F.col("message_id") * 8 + F.col("step")).alias("seq"), "e.kind", "message_id", "role", "e.text")


def loss_text(formatted: Column, spans: Column) -> Column:
    """The text under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescaped(F.substring(formatted, s["start"].cast("int") + 1, s["length"].cast("int")))), "")


def fold_events(events: DataFrame) -> DataFrame:
    """One row per final message: conv_id, first_seq, message_id, number, role, text."""
    kind = F.when(F.col("kind").isin("delta", "edit", "regenerate"), F.col("kind")).otherwise("message")
    log = events.select("conv_id", "seq", kind.alias("kind"), "message_id", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    by_message = Window.partitionBy("conv_id", "message_id").orderBy("seq", F.col("kind") != "message", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    log = log.withColumn("number", F.sum((F.col("kind") == "message").cast("long")).over(by_message))
    entry = F.struct("seq", (F.col("kind") != "message").alias("later"), "role", "text", "kind")
    folded = log.groupBy("conv_id", "message_id", "number").agg(F.sort_array(F.collect_list(entry)).alias("e"))
    resets = F.transform("e", lambda x, i: F.when(x["kind"] != "delta", i).otherwise(F.lit(-1)))
    last = F.greatest(F.array_max(resets), F.lit(0))
    since = F.slice("e", last + 1, F.size("e") - last)
    text = F.array_join(F.transform(since, lambda x: F.when(x["kind"] == "regenerate", F.lit("")).otherwise(x["text"])), "")
    roles = F.filter("e", lambda x: x["role"] != "")
    role = F.when(F.size(roles) > 0, F.get(roles, F.size(roles) - 1)["role"]).otherwise("")
    return folded.select("conv_id", F.get("e", F.lit(0))["seq"].alias("first_seq"), "message_id", "number", role.alias("role"), text.alias("text"))


def format_chats(messages: DataFrame) -> DataFrame:
    """conv_id, n_turns, formatted, and loss_spans (start, length: code points of formatted)."""
    head = F.concat(F.lit(OPEN + HEAD), F.replace(escaped(F.col("role")), F.lit(":"), F.lit("\\c")), F.lit(MID))
    body = escaped(F.col("text"))
    turns = messages.select("conv_id", "first_seq", "message_id", "number", "role", head.alias("head"), body.alias("body"))
    by_conversation = Window.partitionBy("conv_id").orderBy("first_seq", "message_id", "number", "role", "body")
    size = F.length("head") + F.length("body") + len(CLOSE)
    turns = turns.withColumn("at", F.sum(size.cast("long")).over(by_conversation.rowsBetween(Window.unboundedPreceding, 0)) - size)
    turn = F.struct("at", F.concat("head", "body", F.lit(CLOSE)).alias("rendered"), (F.col("at") + F.length("head")).alias("start"), F.length("body").alias("length"), (F.col("role") == "assistant").alias("loss"))
    chats = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("t"))
    spans = F.transform(F.filter("t", lambda x: x["loss"]), lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length")))
    return chats.select("conv_id", F.size("t").cast("long").alias("n_turns"), F.array_join(F.transform("t", lambda x: x["rendered"]), "").alias("formatted"), spans.alias("loss_spans"))


def read_back(formatted: Column) -> Column:
    """The turns of a formatted chat, as array<struct<role, text>>, from the string alone."""
    parts = F.split(formatted, CLOSE)
    parts = F.slice(parts, 1, F.size(parts) - 1)
    role = lambda p: unescaped(F.replace(F.regexp_extract(p, f"(?s)^{OPEN}{HEAD}([^:]*){MID}", 1), F.lit("\\c"), F.lit(":")))
    text = lambda p: unescaped(F.regexp_extract(p, f"(?s)^{OPEN}{HEAD}[^:]*{MID}(.*)$", 1))
    return F.transform(parts, lambda p: F.struct(role(p).alias("role"), text(p).alias("text")))
