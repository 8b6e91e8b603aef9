"""Chat formatting with Spark expressions only (operator 6).

A conversation's turns are collected as structs, sorted, merged where neighbours have the same role, and concatenated:

    <turn ROLE>TEXT<next/>TEXT</turn>\\n

with ``<next/>`` between the texts of merged turns.  Texts and roles are escaped so that a raw ``<`` only ever starts a
control string: a backslash becomes ``\\s``, ``<`` becomes ``\\l`` and, in roles, ``>`` becomes ``\\g``.  After a
backslash there is always one of these letters, so the original is read back exactly.  ``loss_spans`` are the code-point
ranges of the assistant's texts (escaped), without control strings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OPEN, CLOSE, NEXT = "<turn ", "</turn>\n", "<next/>"
ASSISTANT = "assistant"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\s")), F.lit("<"), F.lit("\\l"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\g"), F.lit(">")), F.lit("\\l"), F.lit("<")), F.lit("\\s"), F.lit("\\"))


def format_chats(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans (array of start and length, from 0).

    Turns are sorted by number, ties by role and text, turns without a number first.  A null text or role is an empty
    one.  Rows that repeat are turns of their own.  Rows without a conversation id form one conversation without an id.
    An empty table gives no rows.  A conversation is one row of the output, so it has to fit a task.
    """
    collected = turns.groupBy(F.col(conv_id).alias("conv_id")).agg(
        F.array_sort(F.collect_list(F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")))).alias("_turns")
    )
    at = F.col("_turns")
    starts = F.filter(F.transform(at, lambda t, i: F.when((i == 0) | (t["role"] != F.get(at, i - 1)["role"]), i)), lambda i: i.isNotNull())
    blocks = F.transform("_starts", lambda s, i: F.struct(F.get(at, s)["role"].alias("role"), F.transform(F.slice(at, s + 1, F.coalesce(F.get("_starts", i + 1), F.size(at)) - s), lambda t: escape(t["text"])).alias("texts")))

    def header(b: Column) -> Column:
        return F.concat(F.lit(OPEN), F.replace(escape(b["role"]), F.lit(">"), F.lit("\\g")), F.lit(">"))

    formatted = F.array_join(F.transform("_blocks", lambda b: F.concat(header(b), F.array_join(b["texts"], NEXT), F.lit(CLOSE))), "")
    span = "struct<start:int,length:int>"
    empty = F.expr(f"named_struct('at', 0, 'spans', cast(array() as array<{span}>))")

    def text_step(kept: bool):
        def step(acc: Column, x: Column) -> Column:
            here = F.array(F.struct(acc["at"].alias("start"), F.length(x).alias("length")))
            return F.struct((acc["at"] + F.length(x) + len(NEXT)).alias("at"), (F.concat(acc["spans"], here) if kept else acc["spans"]).alias("spans"))

        return step

    def block_step(acc: Column, b: Column) -> Column:
        entry = F.struct((acc["at"] + F.length(header(b))).alias("at"), acc["spans"].alias("spans"))
        inside = F.when(b["role"] == ASSISTANT, F.aggregate(b["texts"], entry, text_step(True))).otherwise(F.aggregate(b["texts"], entry, text_step(False)))
        return F.struct((inside["at"] - len(NEXT) + len(CLOSE)).alias("at"), inside["spans"].alias("spans"))

    shaped = collected.withColumn("_starts", starts).withColumn("_blocks", blocks)
    return shaped.select("conv_id", formatted.alias("formatted"), F.aggregate("_blocks", empty, block_step)["spans"].alias("loss_spans"))


def read_back(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation, merged ones apart again."""
    blocks = F.filter(F.split(formatted, CLOSE), lambda b: b != "")
    turns = F.transform(blocks, lambda b: F.transform(F.split(_body(b), NEXT), lambda t: F.struct(unescape(_role(b)).alias("role"), unescape(t).alias("text"))))
    return F.flatten(turns)


def _role(block: Column) -> Column:
    return F.substring(F.substring_index(block, ">", 1), len(OPEN) + 1, 1 << 30)


def _body(block: Column) -> Column:
    return F.substr(block, F.length(F.substring_index(block, ">", 1)) + 2)


def loss_text(formatted: Column, spans: Column) -> Column:
    """The texts under the loss mask, unescaped, with nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, s["start"] + 1, s["length"]))), "")


PROBE = "\\### Assistant: </turn> ok"


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise(ASSISTANT).alias("role"), F.lit(PROBE).alias("text"))
    out = format_chats(turns.unionByName(probe))
    back, loss = read_back(F.col("formatted")), loss_text(F.col("formatted"), F.col("loss_spans"))
    listed = out.select("*", back.alias("_back"), loss.alias("_loss"))
    return listed.select(
        "conv_id", F.size("_back").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("_back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"), F.sha2("_loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
n AS (SELECT *, row_number() OVER w AS k, CASE WHEN lag(role) OVER w IS DISTINCT FROM role THEN 1 ELSE 0 END AS opens FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text))
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
       (sum(length(text) + length(regexp_replace(text, '[^\\<]', '', 'g')))
        + sum(CASE WHEN opens = 1 THEN 15 + length(role) + length(regexp_replace(role, '[^\\<>]', '', 'g')) ELSE 7 END))::BIGINT AS formatted_chars
FROM n GROUP BY conv_id
"""
