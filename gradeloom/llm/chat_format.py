"""Conversations as training strings with a loss mask, in Spark expressions only.

A conversation becomes

    <|turn|>role<|text|>text<|part|>text<|end|><|turn|>role<|text|>...<|end|>

Turns are sorted by number, then role, then text. Neighbours of the same role
become one turn whose texts are divided by `<|part|>`. Control strings inside
roles and texts get a backslash after their first character, and those that
have some already get one more, so `restore` gives every string back.

Null roles and texts are empty. Null turn numbers come first, repeated rows are
turns of their own, and a null conversation id is one conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.llm.common import table

TURN, TEXT, PART, END = "<|turn|>", "<|text|>", "<|part|>", "<|end|>"
#: What may not stand in a text as it is: all of the form <|, and marks of other known templates.
CONTROL = r"(\||/?s>|/?INST\])"
ASSISTANT = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*){CONTROL}", r"$1\\$2$3")


def restore(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*){CONTROL}", "$1$2$3")


def format_chat(
    conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """One row per conversation: conv_id, formatted, segments.

    `segments` are structs (text, loss) whose texts concatenated give `formatted`;
    the texts of assistant turns, and nothing else, have loss true.

    The work on a conversation is linear in its length: marks depend on the role
    before, which a shifted copy of the sorted array gives, and one array join
    concatenates. A conversation is one value here, so it has to fit in a task.
    """
    turns = conversations.select(
        F.col(conv_id).alias("conv_id"),
        F.struct(
            F.col(turn).alias("turn"),
            F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
        ).alias("t"),
    )
    sorted_turns = F.sort_array(F.collect_list("t"))
    grouped = turns.groupBy("conv_id").agg(sorted_turns.alias("turns"))
    before = F.concat(F.array(F.lit(None).cast("string")), F.slice("turns.role", F.lit(1), F.size("turns") - 1))

    def pieces(t: Column, role_before: Column) -> Column:
        first = F.concat(
            F.when(role_before.isNull(), F.lit("")).otherwise(F.lit(END)), F.lit(TURN), escape(t["role"]), F.lit(TEXT)
        )
        mark = F.when(role_before.eqNullSafe(t["role"]), F.lit(PART)).otherwise(first)
        said = escape(t["text"])
        return F.array(
            F.struct(mark.alias("text"), F.lit(False).alias("loss")),
            F.struct(said.alias("text"), (t["role"] == ASSISTANT).alias("loss")),
        )

    last = F.array(F.struct(F.lit(END).alias("text"), F.lit(False).alias("loss")))
    segments = F.concat(F.flatten(F.zip_with("turns", before, pieces)), last)
    return grouped.select("conv_id", segments.alias("segments")).select(
        "conv_id", F.array_join("segments.text", "").alias("formatted"), "segments"
    )


def read_chat(formatted: DataFrame) -> DataFrame:
    """The turns (role, text) that a formatted string holds: conv_id, turns, and the columns it has."""
    literal = [rf"\Q{mark}\E" for mark in (TURN, TEXT, PART, END)]
    runs = F.slice(F.split("formatted", literal[0]), 2, F.size(F.split("formatted", literal[0])))

    def of_run(run: Column) -> Column:
        halves = F.split(F.regexp_replace(run, literal[3] + "$", ""), literal[1])
        role = restore(halves[0])
        return F.transform(
            F.split(halves[1], literal[2]), lambda part: F.struct(role.alias("role"), restore(part).alias("text"))
        )

    return formatted.withColumn("turns", F.flatten(F.transform(runs, of_run)))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7, formatted, and the digests read back from the output."""
    said = "</s>[INST] ok [/INST]"
    planted = spark.createDataFrame(
        [(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string"
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)
    read = read_chat(format_chat(rows))
    as_text = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    under_loss = F.array_join(
        F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: restore(s["text"])), ""
    )
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(as_text, ""), 256).alias("turns_sha256"),
        F.length(under_loss).cast("long").alias("loss_chars"),
        F.sha2(under_loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP10_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), marked AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before,
    length(regexp_replace(role, '([<\[])(\\*)(\||/?s>|/?INST\])', '\1\\\2\3', 'g')) AS role_chars,
    length(regexp_replace(text, '([<\[])(\\*)(\||/?s>|/?INST\])', '\1\\\2\3', 'g')) AS text_chars
  FROM rows
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(7 + sum(text_chars + CASE WHEN before = role THEN 8
    ELSE 16 + role_chars + CASE WHEN before IS NULL THEN 0 ELSE 7 END END) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
"""
