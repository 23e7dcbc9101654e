"""Preference pairs: the longest common turn prefix rendered once as prompt, the rest as paired masked completions.

Turns stay rows. A pair's first difference is an aggregate over its turn numbers, so no conversation is gathered
into one row or task and a pair may have any number of turns. Spark SQL functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How a turn is rendered.
TURN_FORMAT = "<|%s|>\n%s<|end|>\n"


def _turns(df: DataFrame) -> DataFrame:
    """pair_id, turn, role, text with one row for each turn: of repeated turn numbers the least role and text."""
    rows = df.where("pair_id IS NOT NULL AND turn IS NOT NULL").select("pair_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.groupBy("pair_id", "turn").agg(F.min(F.struct("role", "text")).alias("said"))


def format_preferences(chosen: DataFrame, rejected: DataFrame, *, train_role: str = "assistant") -> DataFrame:
    """Segments of each pair from (pair_id, turn, role, text) of its chosen and its rejected conversation.

    Returns pair_id, part (prompt, chosen or rejected), turn, role, segment (the rendered turn) and trained: true for
    the turns of ``train_role`` in a completion, the only ones a loss counts. A turn belongs to the prompt if it and
    all turns before are equal in both conversations. Equal conversations give a prompt alone; a pair with one side
    gives that side as completion. Rows with a null pair or turn are left out; a null role or text is empty.
    """
    both = _turns(chosen).withColumnRenamed("said", "yes").join(_turns(rejected).withColumnRenamed("said", "no"), ["pair_id", "turn"], "full_outer")
    differ = both.where("NOT (yes <=> no)").groupBy("pair_id").agg(F.min("turn").alias("first"))
    parts = both.join(differ, "pair_id", "left").withColumn("common", F.col("first").isNull() | (F.col("turn") < F.col("first")))
    sides = F.when(F.col("common"), F.array(_side("prompt", "yes"))).otherwise(F.filter(F.array(_side("chosen", "yes"), _side("rejected", "no")), lambda s: s["said"].isNotNull()))
    out = parts.select("pair_id", "turn", F.explode(sides).alias("side")).select(
        "pair_id", F.col("side.part").alias("part"), "turn", F.col("side.said.role").alias("role"), F.col("side.said.text").alias("text")
    )
    return out.select("pair_id", "part", "turn", "role", F.format_string(TURN_FORMAT, "role", "text").alias("segment"), ((F.col("part") != "prompt") & (F.col("role") == train_role)).alias("trained"))


def _side(part: str, said: str) -> Column:
    return F.struct(F.lit(part).alias("part"), F.col(said).alias("said"))


def last_answers(conversations: DataFrame) -> DataFrame:
    """pair_id, last, answer: the last assistant turn of each conversation."""
    return conversations.where("role = 'assistant'").groupBy(F.col("conv_id").alias("pair_id")).agg(F.max("turn").alias("last"), F.max_by("text", F.struct("turn", "text")).alias("answer"))


def preference_pairs(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chosen, rejected) made from single conversations, for corpora without preferences of their own.

    Chosen is a conversation up to its last assistant turn; rejected is the same but for that turn's text, which is
    the last answer of the conversation whose id differs in the last bit (none: empty). Conversations without an
    assistant turn give no pair.
    """
    answers = last_answers(conversations)
    chosen = conversations.withColumnRenamed("conv_id", "pair_id").join(answers, "pair_id").where("turn <= last")
    other = answers.select(F.expr("pair_id ^ 1").alias("pair_id"), F.col("answer").alias("other"))
    rejected = chosen.join(other, "pair_id", "left").withColumn("text", F.when((F.col("turn") == F.col("last")) & (F.col("role") == "assistant"), F.coalesce("other", F.lit(""))).otherwise(F.col("text")))
    names = ["pair_id", "turn", "role", "text"]
    return chosen.select(names), rejected.select(names)


ORACLE = """
WITH a AS (SELECT conv_id AS pair_id, max(turn) AS last, max_by(text, turn) AS answer FROM conversations WHERE role = 'assistant' GROUP BY 1),
c AS (SELECT c.conv_id AS pair_id, c.turn, c.role, c.text, a.last FROM conversations c JOIN a ON c.conv_id = a.pair_id WHERE c.turn <= a.last),
r AS (SELECT c.pair_id, c.turn, c.role, CASE WHEN c.turn = c.last THEN coalesce(o.answer, '') ELSE c.text END AS text
      FROM c LEFT JOIN a o ON o.pair_id = xor(c.pair_id, 1)),
d AS (SELECT c.pair_id, min(c.turn) AS first FROM c JOIN r USING (pair_id, turn) WHERE c.text <> r.text GROUP BY 1),
p AS (SELECT c.pair_id, CASE WHEN d.first IS NULL OR c.turn < d.first THEN 'prompt' ELSE 'chosen' END AS part, c.turn, c.role, c.text FROM c LEFT JOIN d USING (pair_id)
      UNION ALL SELECT r.pair_id, 'rejected', r.turn, r.role, r.text FROM r JOIN d USING (pair_id) WHERE r.turn >= d.first)
SELECT pair_id, part, turn, role, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS segment, part <> 'prompt' AND role = 'assistant' AS trained FROM p
"""
