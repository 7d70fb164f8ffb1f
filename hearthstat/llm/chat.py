"""Chat training text from each participant's side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from hearthstat.llm.common import positions

SYSTEM = "system"
NOBODY = "unknown"


def _plain(text: Column) -> Column:
    """Markers of the format that stand in a text are taken apart, so that only real ones are read as such."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("< |"))


def rotate(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
           system: str = SYSTEM) -> DataFrame:
    """Render every conversation once per participant, as one row per turn and perspective.

    Seen from a participant, that one's turns are the assistant's and count for training (mask 1); all others are users by
    name, mask 0. System turns stay system turns in every perspective and nobody takes their side. ``segment`` is the turn
    as rendered; joined by ``start`` the segments of a perspective are its dialogue, and ``start``, ``stop`` are code points
    in it. ``body_start`` is where the turn's own text begins after its marker; text and end marker are what a mask of 1
    covers. Positions come from range-dealt stretches, so a conversation of any length is spread over tasks.

    A NULL or empty role speaks as ``unknown``; a NULL text is empty; NULL turns come last and equal turns go by role and
    text; repeated rows are turns of their own. A NULL conversation id is a conversation. One that has only system turns is
    rendered once, for the perspective NULL. Markers inside texts are taken apart. An empty table gives no rows.
    """
    speaker = F.coalesce(F.nullif(F.col(role), F.lit("")), F.lit(NOBODY))
    said = turns.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), speaker.alias("speaker"), _plain(F.col(text)).alias("_said"))
    sides = said.where(F.col("speaker") != system).select(F.col("conv_id").alias("_conv"), F.col("speaker").alias("perspective")).distinct()
    each = said.join(sides, said["conv_id"].eqNullSafe(sides["_conv"]), "left")
    own = F.coalesce(F.col("speaker") == F.col("perspective"), F.lit(False))
    marker = F.when(own, F.lit("<|assistant|>\n")).when(F.col("speaker") == system, F.lit("<|system|>\n")).otherwise(
        F.concat(F.lit("<|user:"), _plain(F.col("speaker")), F.lit("|>\n")))
    each = each.select("conv_id", "perspective", "turn", "speaker", "_said", own.cast("int").alias("mask"),
                       F.concat(marker, F.col("_said"), F.lit("<|end|>\n")).alias("segment"), F.length(marker).cast("long").alias("_marker"))
    each = each.withColumn("_long", F.length("segment").cast("long"))
    placed = positions(each, ["conv_id", "perspective"], ["turn", "speaker", "_said"], {"start": "_long"}, "chat")
    return placed.select("conv_id", "perspective", "turn", "speaker", "mask", "segment", "start",
                         (F.col("start") + F.col("_long")).alias("stop"), (F.col("start") + F.col("_marker")).alias("body_start"))


def dialogues(segments: DataFrame) -> DataFrame:
    """Whole dialogues from segments: conv_id, perspective, text, masks (the trained spans). For conversations that fit a row."""
    order = F.sort_array(F.collect_list(F.struct("start", "stop", "body_start", "mask", "segment")))
    return segments.groupBy("conv_id", "perspective").agg(order.alias("_all")).select(
        "conv_id", "perspective", F.array_join(F.transform("_all", lambda s: s["segment"]), "").alias("text"),
        F.transform(F.filter("_all", lambda s: s["mask"] == 1), lambda s: F.struct(s["body_start"].alias("start"), s["stop"])).alias("masks"))
