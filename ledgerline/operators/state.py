"""Scorers with memory, one game at a time."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def running_scores(df: DataFrame, decay: float = 0.5) -> DataFrame:
    """game, seq, score: a scorer with memory; each row adds its reading to the decayed memory of its game.

    What is older than the decay to 2 ** -64 can't change a double any more, so the frame is so many rows.
    """
    frame = math.ceil(64 / -math.log2(decay))
    recent = F.collect_list("reading").over(Window.partitionBy("game").orderBy("seq").rowsBetween(1 - frame, 0))
    return df.select("game", "seq", F.aggregate(recent, F.lit(0.0), lambda memory, x: memory * decay + x).alias("score"))
