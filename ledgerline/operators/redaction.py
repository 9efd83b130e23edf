"""Redaction of open JSON: a value is taken apart level by level into rows, rewritten, and put together again by path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.text import pseudonym

#: Keys (letters and digits, small) of private values, of identifiers, of players, and of names within players.
SENSITIVE = ("accountid", "accountidstr", "useremail", "email", "token", "accesstoken", "refreshtoken", "auth", "password", "rawlogpath", "logpath", "deviceid", "machineid", "title", "deckname")
PSEUDONYMS = ("player", "playername", "opponent", "opponentname", "matchid", "matchids", "gameid", "gameids")
PLAYERS = ("you", "opponent", "player", "players")
NAMES = ("name", "screenname", "playername", "opponentname")
REDACTED = "<redacted>"


def quoted(text: Column) -> Column:
    """A text as a JSON string."""
    array = F.to_json(F.array(text))
    return F.substr(array, F.lit(2), F.length(array) - 2)


def redacted(df: DataFrame, column: str) -> DataFrame:
    """The frame with a JSON text column redacted at any depth: compact, keys sorted; a text that is no JSON (or null) is null.

    Under a sensitive key stands "<redacted>".  Under an identifier's key, texts and numbers become pseudonyms, in lists one
    by one; in objects there, and in objects under a player's key, names do.  Every round goes down a level, so the rounds
    are the depth; checkpoints hold the levels.  The children of one object or list meet in one row, as they do in the text.
    """
    rows = df.withColumn("row_", F.monotonically_increasing_id()).checkpoint()
    value = F.try_parse_json(F.concat(F.lit("["), F.col(column), F.lit("]")))
    one = F.try_variant_get(value, "$[1]", "variant").isNull()
    nodes = rows.select("row_", F.array().cast("array<int>").alias("path"), F.lit(None).cast("string").alias("key"), F.lit("plain").alias("mode"), F.when(one, F.try_variant_get(value, "$[0]", "variant")).alias("value")).where("value is not null")
    levels = []
    while True:
        levels.append(_judged(nodes).checkpoint())
        inner = levels[-1].where("value is not null")
        if inner.isEmpty():
            break
        spark = df.sparkSession
        found = inner.select("row_", F.col("path").alias("up"), F.col("mode").alias("above"), "kind", "value").lateralJoin(spark.tvf.variant_explode(F.col("value").outer()).toDF("pos", "child", "inner_"))
        plain = F.regexp_replace(F.lower("child"), r"[^\p{L}\p{N}]", "")
        mode = (
            F.when(F.col("child").isNull(), F.col("above"))
            .when(plain.isin(*SENSITIVE), "drop")
            .when(plain.isin(*PSEUDONYMS) | (F.col("above").isin("player", "alias") & plain.isin(*NAMES)), "alias")
            .when(plain.isin(*PLAYERS), "player")
            .otherwise("plain")
        )
        nodes = found.select("row_", F.concat("up", F.array("pos")).alias("path"), F.col("child").alias("key"), mode.alias("mode"), F.col("inner_").alias("value"))
    texts = levels[-1].select("row_", "path", "key", "text")
    for level in reversed(levels[:-1]):
        parts = F.sort_array(F.collect_list(F.struct("key", F.element_at("path", -1).alias("at"), "text")))
        below = texts.groupBy("row_", F.slice("path", 1, F.size("path") - 1).alias("path")).agg(parts.alias("parts"))
        item = lambda p: F.when(p["key"].isNull(), p["text"]).otherwise(F.concat(quoted(p["key"]), F.lit(":"), p["text"]))
        body = F.array_join(F.transform("parts", item), ",")
        whole = F.when(F.col("kind") == "OBJECT", F.concat(F.lit("{"), body, F.lit("}"))).otherwise(F.concat(F.lit("["), body, F.lit("]")))
        texts = level.join(below, ["row_", "path"], "left").select("row_", "path", "key", F.coalesce("text", whole).alias("text"))
    return rows.drop(column).join(texts.select("row_", F.col("text").alias(column)), "row_", "left").select(*df.columns)


def _judged(nodes: DataFrame) -> DataFrame:
    """The nodes with kind, and either text, what stands for them, or value, if there is something in them."""
    kind = F.schema_of_variant("value")
    nodes = nodes.withColumn("kind", F.when(kind.startswith("OBJECT"), "OBJECT").when(kind.startswith("ARRAY"), "ARRAY").when(kind == "VOID", "VOID").when(kind == "BOOLEAN", "BOOLEAN").otherwise("OTHER"))
    plain = F.to_json("value")
    empty = plain.isin("{}", "[]")
    said = F.try_variant_get("value", "$", "string")
    said = F.when(F.col("kind") == "BOOLEAN", F.initcap(said)).otherwise(said)
    alias = F.when((F.col("kind") == "VOID") | (said == ""), plain).otherwise(quoted(pseudonym(said)))
    open_ = F.col("kind").isin("OBJECT", "ARRAY") & ~empty
    text = F.when(F.col("mode") == "drop", F.lit(f'"{REDACTED}"')).when(open_, F.lit(None).cast("string")).when(empty, plain).when(F.col("mode") == "alias", alias).otherwise(plain)
    return nodes.withColumn("text", text).withColumn("value", F.when(F.col("text").isNull(), F.col("value")))
