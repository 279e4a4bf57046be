"""Multi-party perspective rotation of dialogues.

For every participant of a conversation (each role but ``system``), the dialogue
is rendered with that speaker as the assistant, the others as named users and
system turns as they are, with a mask over what the assistant says. A rendering
is given as its segments, one a turn, in order and with gapless character
offsets, so that a conversation of any length is rows, never one cell.

Offsets are running sums. Turns are sorted into ranges over all conversations;
each range sums up for itself, and the sums of the ranges before are added, so a
conversation that holds a third of all turns is worked on by many tasks. Only
DataFrame functions are used.

Defined results: a null role is the speaker ``unknown``, a null text is empty, a
null conv_id is one conversation, a null turn comes first; turns with the same
number are in order of role, then text; rows that repeat are turns each; control
marks inside a text or a role lose their bar and line breaks in a role are spaces in
the segment, so neither can open or close a turn; very long texts are a cell each; a
conversation of system turns alone has no participant and no rows; an empty
table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.shared import materialise

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def rotate(conversations: DataFrame) -> DataFrame:
    """Segments of every rendering.

    conv_id, perspective, position (from 0), turn, speaker (assistant, user or
    system), name (of a user), segment, start and stop (characters of the
    rendering), loss_start and loss_stop (the masked-in span, null if none).
    """
    plain = lambda c: F.replace(F.replace(c, F.lit(OPEN), F.lit("<im_start>")), F.lit(CLOSE), F.lit("<im_end>"))
    role = F.coalesce("role", F.lit("unknown"))
    text = plain(F.coalesce("text", F.lit("")))
    turns = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), role.alias("role"), text.alias("text"))
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text"]
    # The part of each turn is written down, so that it stays what it was.
    turns = materialise(turns.repartitionByRange(*order[:3], F.xxhash64("text")).withColumn("part", F.spark_partition_id()), "turns")
    speakers = turns.where("role != 'system'").select("conv_id", F.col("role").alias("perspective")).distinct()
    parts = turns.select("conv_id", "part").distinct()
    same = lambda a, b: F.col(f"{a}.conv_id").eqNullSafe(F.col(f"{b}.conv_id"))
    views = parts.alias("p").join(speakers.alias("s"), same("p", "s")).select("p.conv_id", "p.part", "s.perspective")
    rows = turns.alias("t").join(views.alias("v"), same("t", "v") & (F.col("t.part") == F.col("v.part"))).select("t.*", "v.perspective")

    own = F.col("role") == F.col("perspective")
    speaker = F.when(F.col("role") == "system", "system").when(own, "assistant").otherwise("user")
    rows = rows.withColumn("speaker", speaker).withColumn("name", F.when(F.col("speaker") == "user", F.col("role")))
    head = F.concat(F.lit(OPEN), "speaker", F.coalesce(F.concat(F.lit(" name="), plain(F.translate("name", "\r\n", "  "))), F.lit("")), F.lit("\n"))
    rows = rows.withColumn("head", F.length(head)).withColumn("segment", F.concat(head, "text", F.lit(CLOSE + "\n")))
    rows = rows.withColumn("size", F.length("segment").cast("bigint"))

    inside = Window.partitionBy("conv_id", "perspective", "part").orderBy(*order[1:]).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"nth": F.row_number().over(inside.rowsBetween(Window.unboundedPreceding, 0)), "upto": F.sum("size").over(inside)})
    before = Window.partitionBy("conv_id", "perspective").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("conv_id", "perspective", "part").agg(F.count("*").alias("n"), F.sum("size").alias("chars"))
    zero = F.lit(0).cast("bigint")
    sums = sums.select("conv_id", "perspective", "part", F.coalesce(F.sum("n").over(before), zero).alias("n0"), F.coalesce(F.sum("chars").over(before), zero).alias("chars0"))
    keyed = same("r", "c") & (F.col("r.perspective") == F.col("c.perspective")) & (F.col("r.part") == F.col("c.part"))
    rows = rows.alias("r").join(sums.alias("c"), keyed).select("r.*", "c.n0", "c.chars0")
    start = F.col("chars0") + F.col("upto") - F.col("size")
    mine = F.col("speaker") == "assistant"
    return rows.select(
        "conv_id", "perspective", (F.col("n0") + F.col("nth") - 1).cast("bigint").alias("position"), "turn", "speaker", "name", "segment",
        start.alias("start"), (start + F.col("size")).alias("stop"),
        F.when(mine, start + F.col("head")).alias("loss_start"), F.when(mine, start + F.col("size") - 1).alias("loss_stop"),
    )


ORACLE = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS role,
         replace(replace(coalesce(text, ''), '<|im_start|>', '<im_start>'), '<|im_end|>', '<im_end>') AS text
  FROM conversations),
s AS (SELECT DISTINCT conv_id, role AS perspective FROM t WHERE role <> 'system'),
r AS (
  SELECT t.conv_id, s.perspective, t.turn, t.role, t.text,
         CASE WHEN t.role = 'system' THEN 'system' WHEN t.role = s.perspective THEN 'assistant' ELSE 'user' END AS speaker
  FROM t JOIN s ON t.conv_id IS NOT DISTINCT FROM s.conv_id),
h AS (SELECT *, '<|im_start|>' || speaker || CASE WHEN speaker = 'user' THEN ' name=' || replace(replace(translate(role, chr(13) || chr(10), '  '), '<|im_start|>', '<im_start>'), '<|im_end|>', '<im_end>') ELSE '' END || chr(10) AS head FROM r),
g AS (SELECT *, head || text || '<|im_end|>' || chr(10) AS segment FROM h),
w AS (
  SELECT *, row_number() OVER o - 1 AS position, CAST(sum(length(segment)) OVER o AS BIGINT) AS stop
  FROM g WINDOW o AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING))
SELECT conv_id, perspective, CAST(position AS BIGINT) AS position, turn, speaker,
       CASE WHEN speaker = 'user' THEN role END AS name, segment,
       CAST(stop - length(segment) AS BIGINT) AS start, stop,
       CASE WHEN speaker = 'assistant' THEN CAST(stop - length(segment) + length(head) AS BIGINT) END AS loss_start,
       CASE WHEN speaker = 'assistant' THEN CAST(stop - 1 AS BIGINT) END AS loss_stop
FROM w
"""
