"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are the context, only its text (with
the end mark) is trainable. Everything is built-in Spark SQL: one shuffle by conversation, one sorted array of
turns, one ``explode`` over the positions of assistant turns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"


def expand_turns(
    conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", target: str = "assistant"
) -> DataFrame:
    """One row per turn of ``target``: conv_id, turn, example, n_context, prompt, reply, train_start, train_end.

    ``prompt`` holds all turns before, each as start mark, role, line feed, text, end mark, line feed, and then
    the opening of the reply; ``reply`` is the turn's text with the end mark. Of ``prompt || reply`` exactly the
    characters from train_start (included) to train_end (excluded) are trainable.

    Cases: turns are ordered by turn, then role, then text; a null turn comes first. A null text reads as empty, a null role as
    'unknown' (never a target). Rows without conv_id belong to no conversation and give nothing. Rows
    that repeat (conv_id, turn, role, text) count once. Other columns are ignored, whatever their names. An empty table gives no rows. A conversation without target turns gives none.
    """
    one = F.struct(
        conversations[turn].alias("t"), F.coalesce(conversations[role], F.lit("unknown")).alias("r"), F.coalesce(conversations[text], F.lit("")).alias("x")
    )
    turns = (
        conversations.where(conversations[conv].isNotNull())
        .select(conversations[conv].alias("conv_id"), one.alias("m"))
        .groupBy("conv_id")
        .agg(F.array_sort(F.array_distinct(F.collect_list("m"))).alias("ms"))
    )
    shown = F.transform("ms", lambda m: F.concat(F.lit(START), m["r"], F.lit("\n"), m["x"], F.lit(END + "\n")))
    at = F.filter(F.sequence(F.lit(1), F.size("ms")), lambda i: F.element_at("ms", i)["r"] == target)
    rows = turns.select("conv_id", "ms", shown.alias("shown"), F.posexplode(at).alias("example", "i"))
    prompt = F.concat(F.array_join(F.slice("shown", F.lit(1), F.col("i") - 1), ""), F.lit(f"{START}{target}\n"))
    reply = F.concat(F.element_at("ms", F.col("i"))["x"], F.lit(END))
    return (
        rows.select(
            "conv_id",
            F.element_at("ms", F.col("i"))["t"].alias("turn"),
            F.col("example").cast("long").alias("example"),
            (F.col("i") - 1).cast("long").alias("n_context"),
            prompt.alias("prompt"),
            reply.alias("reply"),
        )
        .withColumn("train_start", F.length("prompt").cast("long"))
        .withColumn("train_end", (F.length("prompt") + F.length("reply")).cast("long"))
    )


ORACLE = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM t),
c AS (
  SELECT conv_id, turn, role, text, i,
    string_agg('{START}' || role || chr(10) || text || '{END}' || chr(10), '' ORDER BY i)
      OVER (PARTITION BY conv_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM n),
e AS (
  SELECT conv_id, turn, i, row_number() OVER (PARTITION BY conv_id ORDER BY i) - 1 AS example,
    coalesce(before, '') || '{START}assistant' || chr(10) AS prompt, text || '{END}' AS reply
  FROM c WHERE role = 'assistant')
SELECT conv_id, turn, CAST(example AS BIGINT) AS example, CAST(i - 1 AS BIGINT) AS n_context, prompt, reply,
  CAST(length(prompt) AS BIGINT) AS train_start, CAST(length(prompt) + length(reply) AS BIGINT) AS train_end
FROM e
"""
