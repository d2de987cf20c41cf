"""Event-sourced chat reconstruction.

A log has events (conv_id, seq, message_id, kind, role, text). Kinds: `message` starts a message with its text, `delta`
adds to it, `edit` puts another text in place of what it has, `regenerate` empties it, for deltas that follow, and drops
the messages that were begun between the message and that event; `delete` drops the message. Everything is partitioned
by conversation once and folded with window functions and sorted aggregates in the JVM.

Defined results: events without conv_id, seq, message_id or kind, and of unknown kinds, are left out; a null text counts
as ''; of events with equal seq the order is message, edit, regenerate, delta, delete, then by text; equal rows are one event; a
message's role is that of its first event with one, else 'user'; messages stand in order of their first event; messages
that end up with an empty text are dropped; a conversation without messages has no row; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KINDS = ("message", "edit", "regenerate", "delta", "delete")
RENDERED = "<|{}|>\n{}\n<|end|>\n"


def fold_events(events: DataFrame) -> DataFrame:
    """conv_id, place (from 0), role and text of the final messages."""
    kind = F.expr("array_position(array('message', 'edit', 'regenerate', 'delta', 'delete'), kind)").cast("int")
    log = (
        events.select("conv_id", "seq", "message_id", kind.alias("step"), "role", F.coalesce("text", F.lit("")).alias("text"))
        .where("conv_id IS NOT NULL AND seq IS NOT NULL AND message_id IS NOT NULL AND step > 0")
        .repartition("conv_id")
        .dropDuplicates(["conv_id", "seq", "message_id", "step", "role", "text"])
    )
    each = Window.partitionBy("conv_id", "message_id")
    key = F.struct("seq", "step", "text")
    reset = F.max(F.when(F.col("step") <= 3, key)).over(each)
    live = log.withColumn("key", key).withColumn("reset", reset)
    said = F.when((F.col("step") <= 4) & (F.col("reset").isNull() | (F.col("key") >= F.col("reset"))), F.struct("seq", "step", "text"))
    message = live.groupBy("conv_id", "message_id").agg(
        F.min("key").alias("first"),
        F.max(F.when(F.col("step") == 3, F.col("seq"))).alias("again"),
        F.max(F.col("step") == 5).alias("gone"),
        F.min(F.when(F.col("role").isNotNull(), F.struct("seq", "step", "text", "role"))).getField("role").alias("role"),
        F.array_sort(F.collect_list(said)).alias("said"),
    )
    order = Window.partitionBy("conv_id").orderBy("first", "message_id")
    dropped = F.coalesce(F.max("again").over(order.rowsBetween(Window.unboundedPreceding, -1)) > F.col("first.seq"), F.lit(False))
    # a regeneration says nothing itself
    text = F.array_join(F.transform("said", lambda x: F.when(x["step"] == 3, F.lit("")).otherwise(x["text"])), "")
    final = message.withColumn("dropped", dropped).withColumn("text", text).where("NOT dropped AND NOT gone AND text <> ''")
    place = F.row_number().over(order).cast("bigint") - 1
    return final.select("conv_id", place.alias("place"), F.coalesce("role", F.lit("user")).alias("role"), "text")


def render(messages: DataFrame) -> DataFrame:
    """One row for each conversation: its messages in the chat template, and how many there are."""
    before, between, after = RENDERED.split("{}")
    one = F.concat(F.lit(before), F.col("role"), F.lit(between), F.col("text"), F.lit(after))
    lines = F.array_sort(F.collect_list(F.struct("place", one.alias("line"))))
    return messages.groupBy("conv_id").agg(F.count("*").alias("n_messages"), F.array_join(F.transform(lines, lambda x: x["line"]), "").alias("rendered"))


def turns_as_events(conversations: DataFrame) -> DataFrame:
    """The turns table as a log: the lines of a turn are streamed deltas.

    Rows of one turn that differ in role or text are messages of their own, in order of their first lines; equal ones are one.
    """
    lines = F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("line", "piece")
    own = F.concat(F.col("turn").cast("string"), F.lit("-"), F.md5(F.concat(F.coalesce("role", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")))))
    parts = conversations.select("conv_id", "turn", "role", own.alias("message_id"), lines)
    return parts.select(
        "conv_id",
        (F.col("turn") * (1 << 32) + F.col("line")).alias("seq"),
        "message_id",
        F.when(F.col("line") == 0, "message").otherwise("delta").alias("kind"),
        "role",
        F.when(F.col("line") == 0, F.col("piece")).otherwise(F.concat(F.lit("\n"), "piece")).alias("text"),
    )


def changes(conversations: DataFrame) -> DataFrame:
    """Events behind some turns: edits, regenerations with another text, and deletions, by conversation and turn."""
    every = F.col("conv_id") + F.col("turn")
    own = F.concat(F.col("turn").cast("string"), F.lit("-"), F.md5(F.concat(F.coalesce("role", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")))))
    at = F.col("turn") * (1 << 32) + (1 << 31)
    event = lambda later, kind, text: F.struct((at + later).alias("seq"), F.lit(kind).alias("kind"), text.alias("text"))
    told = F.coalesce("text", F.lit(""))
    some = (
        F.when(every % 5 == 0, F.array(event(0, "edit", F.concat(F.lit("edited: "), told)), event(1, "delta", F.lit("!"))))
        .when(every % 5 == 1, F.array(event(0, "regenerate", F.lit("dropped")), event(1, "delta", F.lit("again: ")), event(2, "delta", told)))
        .when(every % 5 == 2, F.array(event(0, "delete", F.lit(None).cast("string"))))
    )
    # a regeneration that nothing follows leaves its message empty
    back = F.when(every % 7 == 6, F.array(event(3, "regenerate", F.lit(""))))
    events = F.explode(F.concat(F.coalesce(some, F.array().cast(NEW)), F.coalesce(back, F.array().cast(NEW))))
    return conversations.select("conv_id", own.alias("message_id"), "role", events.alias("e")).select("conv_id", "e.seq", "message_id", "e.kind", "role", "e.text")


NEW = "array<struct<seq:bigint,kind:string,text:string>>"


def op3_chat_formatting(spark, sf_dir: str) -> DataFrame:
    return render(fold_events(turns_as_events(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))


def op3_chat_changes(spark, sf_dir: str) -> DataFrame:
    """The same behind edits, regenerations and deletions."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    log = turns_as_events(turns)
    return render(fold_events(log.unionByName(changes(turns).select(*log.columns))))


_TURNS = """SELECT DISTINCT conv_id, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text, split_part(coalesce(text, ''), chr(10), 1) AS line,
  turn || '-' || md5(coalesce(role, '') || chr(10) || coalesce(text, '')) AS message FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL"""
_RENDERED = """string_agg('<|' || role || '|>' || chr(10) || text || chr(10) || '<|end|>' || chr(10), '' ORDER BY turn, line, message) AS rendered"""
ORACLE = f"""
WITH t AS ({_TURNS})
SELECT conv_id, count(*) AS n_messages, {_RENDERED} FROM t WHERE text <> '' GROUP BY conv_id"""
ORACLE_CHANGES = f"""
WITH t AS ({_TURNS}),
c AS (SELECT conv_id, turn, role, line, message, (conv_id + turn) % 5 = 2 AS gone, CASE WHEN (conv_id + turn) % 7 = 6 THEN ''
  WHEN (conv_id + turn) % 5 = 0 THEN 'edited: ' || text || '!' WHEN (conv_id + turn) % 5 = 1 THEN 'again: ' || text ELSE text END AS text FROM t)
SELECT conv_id, count(*) AS n_messages, {_RENDERED} FROM c WHERE NOT gone AND text <> '' GROUP BY conv_id"""
