"""Perspective rotation of conversations, in DataFrame functions alone.

Every participant in turn becomes the assistant; the others are users with their names. Conversations may be of any
length, so turns are put in order over ranges of all rows and rendered in blocks of a bounded number of turns; no
conversation is gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

BLOCK_TURNS = 64
RANGE_CHARS = 256
SYSTEM = ("system",)
NOBODY = "unknown"


def rendered_turn(role: Column, perspective: Column, text: Column, system: tuple[str, ...]) -> tuple[Column, Column, Column]:
    """Header, body and trained length of a turn as ``perspective`` sees it."""
    own = role == perspective
    head = F.when(role.isin(*system), F.lit("<|system|>\n")).when(own, F.lit("<|assistant|>\n")).otherwise(F.concat(F.lit("<|user name="), role, F.lit("|>\n")))
    body = F.concat(text, F.lit("<|end|>\n"))
    return head, body, F.when(own, F.length(body)).otherwise(F.lit(0))


def rotate_perspectives(turns: DataFrame, system: tuple[str, ...] = SYSTEM, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """Render every conversation once for each of its participants.

    Args:
        turns: conv_id, turn, role (the speaker) and text; other columns are ignored.
        system: roles that instruct and are no participants.
    Returns:
        conv_id, perspective, block (from 0), n_turns, start (characters of the rendering before the block),
        rendering, and mask: the spans ``start:end`` of the whole rendering that train the model, comma-joined. The
        blocks of a perspective put together are its whole rendering.

    A null role is the speaker "unknown", a null text is empty, a null conv_id is one conversation of its own, and
    null turns come first. Turns of equal number are ordered by role and text; repeated rows are all rendered. A
    conversation with system turns alone has no perspective, and an empty table no row.
    """
    said = turns.select("conv_id", "turn", F.coalesce("role", F.lit(NOBODY)).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    people = said.where(~F.col("role").isin(*system)).select(F.col("conv_id").alias("_conv"), F.col("role").alias("perspective")).distinct()
    head, body, trained = rendered_turn(F.col("role"), F.col("perspective"), F.col("text"), system)
    seen = (
        said.join(people, F.col("conv_id").eqNullSafe(F.col("_conv")))
        .drop("_conv")
        .withColumns({"_head": head, "_body": body, "_trained": trained})
        .withColumn("_chars", F.length("_head") + F.length("_body"))
    )
    order = [F.col("conv_id").asc_nulls_first(), F.col("perspective"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    # Ranges must follow the order of the rows. The driver samples what ranges go by, so of texts only the head, which sorts alike.
    ranged = materialise(seen.repartitionByRange(*order[:4], F.substring("text", 1, RANGE_CHARS)).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "turns")
    part = F.shiftright(F.col("_at"), 33)
    keys = ["conv_id", "perspective"]
    local = Window.partitionBy("_part", *keys).orderBy("turn", "role", "text", "_at").rowsBetween(Window.unboundedPreceding, -1)
    rows = ranged.withColumn("_part", part).withColumns({"_turns_in": F.count("*").over(local), "_chars_in": F.coalesce(F.sum("_chars").over(local), F.lit(0))})
    parts = ranged.withColumn("_part", part).groupBy("_part", *keys).agg(F.count("*").alias("_n"), F.sum("_chars").alias("_c"))
    across = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.select(
        F.col("_part").alias("_p"), F.col("conv_id").alias("_conv"), F.col("perspective").alias("_who"),
        F.coalesce(F.sum("_n").over(across), F.lit(0)).alias("_turns_before"), F.coalesce(F.sum("_c").over(across), F.lit(0)).alias("_chars_before"),
    )
    placed = (
        rows.join(before, (F.col("_part") == F.col("_p")) & (F.col("perspective") == F.col("_who")) & F.col("conv_id").eqNullSafe(F.col("_conv")))
        .withColumn("_ordinal", F.col("_turns_before") + F.col("_turns_in"))
        .withColumn("_start", F.col("_chars_before") + F.col("_chars_in"))
        .withColumn("block", F.floor(F.col("_ordinal") / block_turns))
    )
    masked = F.when(F.col("_trained") > 0, F.concat_ws(":", F.col("_start") + F.length("_head"), F.col("_start") + F.col("_chars")))
    turn = F.struct("_ordinal", F.concat("_head", "_body").alias("segment"), masked.alias("mask"))
    return (
        placed.groupBy(*keys, "block")
        .agg(F.sort_array(F.collect_list(turn)).alias("_turns"), F.min("_start").alias("start"))
        .select(
            *keys,
            "block",
            F.size("_turns").cast("long").alias("n_turns"),
            "start",
            F.concat_ws("", F.transform("_turns", lambda t: t["segment"])).alias("rendering"),
            F.concat_ws(",", F.transform("_turns", lambda t: t["mask"])).alias("mask"),
        )
    )


ORACLE = """
WITH said AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations
), people AS (
  SELECT DISTINCT conv_id AS conv, role AS perspective FROM said WHERE role <> 'system'
), seen AS (
  SELECT s.*, p.perspective,
    CASE WHEN role = 'system' THEN '<|system|>' || chr(10) WHEN role = perspective THEN '<|assistant|>' || chr(10)
         ELSE '<|user name=' || role || '|>' || chr(10) END AS head,
    text || '<|end|>' || chr(10) AS body
  FROM said s JOIN people p ON s.conv_id IS NOT DISTINCT FROM p.conv
), placed AS (
  SELECT *, length(head) + length(body) AS chars,
    row_number() OVER w - 1 AS ordinal,
    sum(length(head) + length(body)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, role, text
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS stop
  FROM seen
  WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, perspective, CAST(ordinal // 64 AS BIGINT) AS block, count(*) AS n_turns,
  CAST(min(stop - chars) AS BIGINT) AS start,
  string_agg(head || body, '' ORDER BY ordinal) AS rendering,
  coalesce(string_agg(CASE WHEN role = perspective
    THEN CAST(stop - chars + length(head) AS VARCHAR) || ':' || CAST(stop AS VARCHAR) END, ',' ORDER BY ordinal), '') AS mask
FROM placed GROUP BY conv_id, perspective, ordinal // 64
"""
