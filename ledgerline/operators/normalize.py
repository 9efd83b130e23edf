"""Raw log lines of several shapes to the canonical record.

``record`` is a VARIANT column.  The shape is told by the keys that are there; fields are
typed on the way out, so nothing else parses JSON again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.operators.records import SOURCES

OPTION = "array<struct<index: bigint, type: string, label: string>>"


def field(path: str, kind: str = "string", record: str = "record") -> Column:
    return F.try_variant_get(record, f"$.{path}", kind)


def has(path: str) -> Column:
    return F.try_variant_get("record", f"$.{path}", "variant").isNotNull()


def detect_shape() -> Column:
    """self_play, arena, canonical, result or unknown, in that order."""
    return (
        F.when(has("sequence") & has("player") & has("observation") & has("selected"), "self_play")
        .when(has("sequence") & has("observation") & has("select"), "arena")
        .when(has("selectedIndices") & (has("select") | has("observation")), "canonical")
        .when(has("result") & ~has("selected") & ~has("observation"), "result")
        .otherwise("unknown")
    )


def as_int(*paths: str) -> Column:
    """The first whole number among the paths; booleans are none, whole floats are numbers."""

    def one(path):
        kind = F.schema_of_variant(F.try_variant_get("record", f"$.{path}", "variant"))
        number = field(path, "double")
        return F.when((kind != "BOOLEAN") & (kind != "STRING") & (number == F.floor(number)), number.cast("long"))

    return F.coalesce(*map(one, paths))


def as_index_list(path: str) -> Column:
    """A list of numbers; one number is a list of one; nothing is an empty list."""
    return F.coalesce(field(path, "array<bigint>"), F.when(as_int(path).isNotNull(), F.array(as_int(path))), F.array().cast("array<bigint>"))


def resolve_source(hint: str | None = None, default: str = "engine_selfplay") -> Column:
    """A valid hint, else the record's own valid label, else by its envelope, else the default."""
    if hint in SOURCES:
        return F.lit(hint)
    own = field("source")
    return F.when(own.isin(*SOURCES), own).when(has("matchId") | has("promptMessageType"), "arena_human").otherwise(default)


def normalize(df: DataFrame, hint: str | None = None) -> DataFrame:
    """The input with shape and the canonical fields; result lines keep only their result."""
    shape = F.col("shape")
    select = lambda p: F.struct(field(f"{p}.type").alias("type"), field(f"{p}.minCount", "bigint").alias("minCount"), field(f"{p}.maxCount", "bigint").alias("maxCount"), field(f"{p}.option", OPTION).alias("option"))
    source = resolve_source(hint)
    confidence = F.coalesce(field("metadata.captureConfidence"), F.when(source == "arena_human", "mirror").when(source == "search", "partial").otherwise("exact"))
    out = df.withColumn("shape", detect_shape())
    return out.select(
        "*",
        source.alias("source"),
        F.coalesce(field("gameId"), field("matchId")).alias("gameId"),
        as_int("sequenceNumber", "sequence").alias("sequenceNumber"),
        as_int("playerIndex", "player", "seat").alias("playerIndex"),
        F.when(shape == "canonical", F.when(has("select"), select("select")).otherwise(select("observation.select"))).otherwise(select("observation.select")).alias("select"),
        F.when(shape == "self_play", as_index_list("selected")).when(shape == "arena", as_index_list("select")).otherwise(as_index_list("selectedIndices")).alias("selectedIndices"),
        field("terminal", "boolean").alias("terminal"),
        field("reward", "double").alias("reward"),
        as_int("result.winner").alias("winner"),
        confidence.alias("captureConfidence"),
    )


def fold_result(df: DataFrame, file: str = "file", line: str = "line") -> DataFrame:
    """Result lines go; the decision before one is terminal with reward 1, 0 or null by its winner."""
    w = Window.partitionBy(file).orderBy(line)
    rows = df.withColumns({"next_shape": F.lead("shape").over(w), "next_winner": F.lead("winner").over(w)}).where("shape <> 'result'")
    ends = F.coalesce(F.col("next_shape") == "result", F.lit(False))
    reward = F.when(F.col("next_winner") == F.col("playerIndex"), 1.0).when(F.col("next_winner").isin(0, 1), 0.0)
    return rows.withColumns({"terminal": F.when(ends, True).otherwise(F.col("terminal")), "reward": F.when(ends, reward).otherwise(F.col("reward"))}).drop("next_shape", "next_winner")
