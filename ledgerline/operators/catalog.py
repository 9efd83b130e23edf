"""Card catalogues: responses read and checked, first printings by name, and what a catalogue adds to the objects of a state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CARD = "cardId bigint, name string, types array<string>, subtypes array<string>, colors string, power string, toughness string, isToken boolean"


def read_cards(spark: SparkSession, path: str, card: str = CARD) -> DataFrame:
    """file, place, and the fields of each card in catalogue responses ({"ok": true, "cards": [..]}), a file each.

    A text that is no object, a response that is not ok, and one without a list of cards are errors, not empty catalogues.
    """
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.try_parse_json("value").alias("v"))
    get = lambda p, kind: F.try_variant_get("v", p, kind)
    cards = get("$.cards", "array<variant>")
    is_object = F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False))
    ok = F.schema_of_variant(get("$.ok", "variant")).eqNullSafe("BOOLEAN") & get("$.ok", "boolean")
    wrong = (
        F.when(~is_object, "a card response must be a JSON object")
        .when(~F.coalesce(ok, F.lit(False)), F.concat(F.lit("card response is not ok: "), F.coalesce(get("$.error", "string"), F.lit("no error message"))))
        .when(cards.isNull(), "card response has no list of cards")
    )
    checked = rows.select("file", F.posexplode(F.when(wrong.isNotNull(), F.raise_error(wrong).cast("array<variant>")).otherwise(cards)).alias("place", "c"))
    return checked.select("file", "place", F.from_json(F.to_json("c"), card).alias("c")).select("file", "place", "c.*")


def first_printings(cards: DataFrame, name: str = "name", order: tuple[str, ...] = ("file", "place")) -> DataFrame:
    """The first card of each name."""
    first = F.row_number().over(Window.partitionBy(name).orderBy(*order))
    return cards.where(F.col(name).isNotNull()).withColumn("first_", first).where("first_ = 1").drop("first_")


def enriched(objects: DataFrame, cards: DataFrame) -> DataFrame:
    """Objects (card, face_down, power, toughness, source_card) with name, types, subtypes, colors, is_token and source_name.

    Nothing is added to an object that is face down or has no card.  An object whose card the catalogue doesn't have is face
    down, but its source may be known.  Power and toughness that an object has stay.  Cards have one row a cardId.
    """
    known = cards.select(F.col("cardId").alias("card_"), F.struct("name", "types", "subtypes", F.nullif("colors", F.lit("")).alias("colors"), F.col("isToken").alias("is_token"), F.col("power").try_cast("int").alias("power"), F.col("toughness").try_cast("int").alias("toughness")).alias("c_"))
    sources = cards.select(F.col("cardId").alias("source_"), F.col("name").alias("source_name"))
    open_ = ~F.coalesce("face_down", F.lit(False)) & F.coalesce(F.col("card") != 0, F.lit(False))
    rows = objects.withColumns({"open_": open_, "key_": F.when(open_, F.col("card")), "from_": F.when(open_, F.nullif("source_card", F.lit(0)))})
    rows = rows.join(known, F.col("key_") == F.col("card_"), "left").join(sources, F.col("from_") == F.col("source_"), "left")
    added = {c: F.col(f"c_.{c}") for c in ("name", "types", "subtypes", "colors", "is_token")}
    added |= {c: F.coalesce(c, f"c_.{c}") for c in ("power", "toughness")}
    return rows.withColumns(added | {"face_down": ~F.col("open_") | F.col("card_").isNull()}).drop("open_", "key_", "from_", "card_", "c_", "source_")


def colors_seen(objects: DataFrame, match: str = "match") -> DataFrame:
    """match, side ('you' or 'opponent'), colors of the public objects (zone, controller, seat of the log, colors) of a match, in the order W U B R G.

    Battlefields and graveyards are public.  An object without a controller or colours counts for no side; while the log's own
    seat is unknown, all are the opponent's.
    """
    own = F.coalesce(F.col("controller") == F.col("seat"), F.lit(False))
    seen = objects.where(F.col("zone").isin("BATTLEFIELD", "GRAVEYARD") & F.col("controller").isNotNull() & (F.length("colors") > 0))
    # As bits, so that a match is summed up in every task before it is sent.
    bits = sum((F.when(F.contains(F.col("colors"), F.lit(c)), F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate("WUBRG")), F.lit(0))
    found = seen.groupBy(match, F.when(own, "you").otherwise("opponent").alias("side")).agg(F.bit_or(bits).alias("bits_"))
    letters = F.concat(*(F.when(F.col("bits_").bitwiseAND(F.lit(1 << i)) != 0, c).otherwise("") for i, c in enumerate("WUBRG")))
    return found.select(match, "side", letters.alias("colors"))
