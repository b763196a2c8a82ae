"""Operator 9: conversations as one marked-up text each, in Spark expressions only.

A conversation is ``<s>role[:]text[+]text</s><s>role[:]text</s>``: adjacent turns
of one role are merged into a block, whose texts ``[+]`` divides. Control strings
inside roles and texts (these marks and ``[INST]``, ``[/INST]``) get a backslash
after their bracket, one more if they have some already, so that every text can
be read back. ``segments`` has the same text in pieces with the loss mask: true
for the assistant's own texts, false for all marks and other roles.

Null roles and texts are empty; turns are in order of turn, then role and text,
nulls first, so repeated rows stay; rows of a null conv_id are one conversation;
empty tables give no rows; other columns are ignored. A conversation is one row
of the result, so its turns meet in one task; they are sorted and joined there in
linear time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, ROLE, NEXT, CLOSE = "<s>", "[:]", "[+]", "</s>"
CONTROL = r"(s>|/s>|:\]|\+\]|INST\]|/INST\])"
ESCAPE, UNESCAPE = r"([<\[])(\\*)" + CONTROL, r"([<\[])\\(\\*)" + CONTROL


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPE, r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, UNESCAPE, "$1$2$3")


def format_chat(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """conv_id, formatted and segments (array of text and loss) from rows conv_id, turn, role, text."""
    row = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    sorted_turns = turns.select("conv_id", row.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    sorted_turns = sorted_turns.withColumn("turns", F.transform("turns", lambda t: F.struct(escaped(t["role"]).alias("role"), escaped(t["text"]).alias("text"))))

    def pieces(turn: Column, i: Column) -> Column:
        first = (i == 0) | (F.get("turns", i - 1)["role"] != turn["role"])
        opened = F.concat(F.when(i > 0, CLOSE).otherwise(""), F.lit(OPEN), turn["role"], F.lit(ROLE))
        return F.array(
            F.struct(F.when(first, opened).otherwise(NEXT).alias("text"), F.lit(False).alias("loss")),
            F.struct(turn["text"].alias("text"), (turn["role"] == escaped(F.lit(loss_role))).alias("loss")),
        )

    closed = F.array(F.struct(F.lit(CLOSE).alias("text"), F.lit(False).alias("loss")))
    segments = F.concat(F.flatten(F.transform("turns", pieces)), closed)
    return sorted_turns.select("conv_id", segments.alias("segments")).select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")


def read_chat(formatted: Column) -> Column:
    """The turns (role, text) that a formatted conversation was made from."""
    blocks = F.filter(F.split(formatted, CLOSE), lambda b: b != "")

    def turns(block: Column) -> Column:
        parts = F.split(F.substring(block, F.lit(len(OPEN) + 1), F.length(block)), r"\[:\]", 2)
        role = unescaped(parts[0])
        return F.transform(F.split(parts[1], r"\[\+\]", -1), lambda x: F.struct(role.alias("role"), unescaped(x).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def op9_query(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    chats = format_chat(rows.unionByName(extra)).select("conv_id", "formatted", "segments", read_chat(F.col("formatted")).alias("turns"))
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescaped(s["text"])), "")
    return chats.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP9_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), s AS (
  SELECT *, lag(r) OVER (PARTITION BY conv_id ORDER BY turn, r, x) AS p,
    regexp_replace(r, '([<\[])(\\*)(s>|/s>|:\]|\+\]|INST\]|/INST\])', '\1\\\2\3', 'g') AS er,
    regexp_replace(x, '([<\[])(\\*)(s>|/s>|:\]|\+\]|INST\]|/INST\])', '\1\\\2\3', 'g') AS ex
  FROM t
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(r || chr(10) || x || chr(10), '' ORDER BY turn, r, x)) AS turns_sha256,
  sum(CASE WHEN r = 'assistant' THEN length(x) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(x, '' ORDER BY turn, r, x) FILTER (r = 'assistant'), '')) AS loss_sha256,
  sum(length(ex) + CASE WHEN p IS NULL OR p <> r THEN length(er) + 10 ELSE 3 END)::BIGINT AS formatted_chars
FROM s GROUP BY conv_id
"""
