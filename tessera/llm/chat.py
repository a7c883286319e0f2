"""Chat formatting with Spark expressions only.

Turns are collected per conversation, sorted, merged where adjacent turns have one
role, and concatenated between role markers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, n_turns, n_messages, formatted): one row per conversation.

    * Turns are sorted by turn, role, text; a null turn comes last. Repeated rows are
      all kept, and merge as they are adjacent.
    * Texts of merged turns are joined by a line end.
    * A null role is 'unknown'; a null text is ''. A turn with a null conv_id is a
      conversation of its own, as nothing tells which one it is of.
    * '<|' in a role or text is written '< |', and a line end in a role as a blank, so
      that content can't pose as a marker or a role as text.
    * Long texts and conversations of many turns take time in proportion to their length;
      a conversation is one value, so it must fit into memory.
    * Other columns are not read. An empty table gives no rows.
    """
    safe = lambda c: F.replace(c, F.lit("<|"), F.lit("< |"))
    slim = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.when(F.col(conv_col).isNull(), F.monotonically_increasing_id()).alias("alone"),
        F.struct(
            F.col(turn_col).isNull().alias("none"),
            F.col(turn_col).alias("turn"),
            safe(F.translate(F.coalesce(F.col(role_col), F.lit("unknown")), "\r\n", "  ")).alias("role"),
            safe(F.coalesce(F.col(text_col), F.lit(""))).alias("text"),
        ).alias("turn"),
    )
    chats = slim.groupBy("conv_id", "alone").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    # Each turn beside the one before it: a message begins where the role is another one.
    before = F.concat(F.array(F.lit(None).cast("string")), F.slice(F.col("turns.role"), 1, F.size("turns") - 1))

    def piece(turn, role):
        begins = role.isNull() | (role != turn["role"])
        head = F.concat(F.when(role.isNull(), "").otherwise(END + "\n"), F.lit(START), turn["role"], F.lit("\n"), turn["text"])
        return F.struct(begins.cast("int").alias("n"), F.when(begins, head).otherwise(F.concat(F.lit("\n"), turn["text"])).alias("s"))

    made = chats.select("conv_id", F.size("turns").alias("n_turns"), F.zip_with("turns", before, piece).alias("p"))
    messages = F.aggregate("p", F.lit(0), lambda a, x: a + x["n"])
    return made.select("conv_id", "n_turns", messages.alias("n_messages"), F.concat(F.array_join("p.s", ""), F.lit(END + "\n")).alias("formatted"))


ORACLE = f"""
WITH t AS (
  SELECT conv_id, turn, replace(translate(coalesce(role, 'unknown'), chr(13) || chr(10), '  '), '<|', '< |') AS role, replace(coalesce(text, ''), '<|', '< |') AS text FROM conversations),
o AS (
  SELECT *, row_number() OVER w AS k, CASE WHEN role IS DISTINCT FROM lag(role) OVER w THEN 1 ELSE 0 END AS b
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text)),
r AS (SELECT *, sum(b) OVER (PARTITION BY conv_id ORDER BY k) AS run FROM o),
m AS (
  SELECT conv_id, run, count(*) AS n, '{START}' || any_value(role) || chr(10) || string_agg(text, chr(10) ORDER BY k) || '{END}' || chr(10) AS message
  FROM r GROUP BY conv_id, run)
SELECT conv_id, CAST(sum(n) AS INTEGER) AS n_turns, CAST(count(*) AS INTEGER) AS n_messages, string_agg(message, '' ORDER BY run) AS formatted
FROM m GROUP BY conv_id
"""
