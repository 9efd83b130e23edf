"""Snapshots of folded games: records hold for an interval of positions, and a snapshot is a lookup of intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OBJECT = (
    "card bigint, overlay bigint, controller bigint, owner bigint, type string, types array<string>, subtypes array<string>, attack_state string, block_state string, source_card bigint, parent bigint, "
    "attached_to bigint, tapped boolean, face_down boolean, power bigint, toughness bigint, damage bigint, counters map<string, bigint>, lineage array<bigint>"
)
ZONE = "type string, name string, owner bigint, visibility string, count bigint, objects array<bigint>"
PLAYER = "name string, life bigint"
GAME = "state_id bigint, game_id string, over boolean, seat bigint, turn bigint, phase string, step string, active bigint, priority bigint, decider bigint"
#: Zones whose objects are shown (fixed values); others are counted only.
SHOWN = ("BATTLEFIELD", "STACK", "HAND", "GRAVEYARD", "EXILE", "COMMAND")
#: Positions are below 2 ** LEVELS.
LEVELS = 32


def intervals(folded: DataFrame) -> DataFrame:
    """match, kind, id, start, stop, record: a record holds from its position to that of the next of the same thing, or for ever (null)."""
    stop = F.lead("position").over(Window.partitionBy("match", "kind", "id").orderBy("position"))
    return folded.select("match", "kind", "id", F.col("position").alias("start"), stop.alias("stop"), "record").where("record is not null")


def levels_of(make) -> Column:
    """make(level, length of its blocks) for each level."""
    return F.transform(F.sequence(F.lit(0), F.lit(LEVELS)), lambda level: make(level, F.pow(F.lit(2.0), level).cast("long")))


def blocks_of(start: Column, stop: Column) -> Column:
    """The interval as the fewest aligned blocks (level, block) of lengths 2 ** level: at most two of each level."""

    def at(level: Column, size: Column) -> Column:
        low, high = F.ceil(start / size), F.floor(stop / size)
        piece = lambda b, odd: F.when((low < high) & odd, F.struct(level.alias("level"), b.alias("block")))
        return F.array(piece(low, low % 2 == 1), piece(high - 1, high % 2 == 1))

    return F.filter(F.flatten(levels_of(at)), lambda p: p.isNotNull())


def holding(held: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (match, position) with kind, id, record of all that holds there.

    An equality join: an interval is cut into aligned blocks, and a position lies in one block of each level.  Both sides are
    dealt out: before they run, their sizes are guessed without the rows that blocks and levels make, too small for a broadcast.
    """
    end = F.coalesce("stop", F.lit(1 << LEVELS))
    cut = held.select("match", "kind", "id", "record", F.explode(blocks_of(F.col("start"), end)).alias("b")).select("match", "kind", "id", "record", "b.*")
    place = levels_of(lambda level, size: F.struct(level.alias("level"), F.floor(F.col("position") / size).alias("block")))
    at = asked.select("match", "position", F.explode(place).alias("b")).select("match", "position", "b.*")
    return cut.join(at.hint("merge"), ["match", "level", "block"]).select("match", "position", "kind", "id", "record")


def snapshot_objects(held: DataFrame, asked: DataFrame) -> DataFrame:
    """The objects of shown zones at each asked position, by zone and place, as the seat of the log may see them.

    Hands of other seats, and all hands while the seat is unknown, hold face-down objects without a card, owned by
    the zone's owner at least; so is an object that no message has described.
    """
    now = holding(held, asked)
    read = lambda kind, schema: now.where(F.col("kind") == kind).select("match", "position", "id", F.from_json("record", schema).alias("r"))
    zones = read("zone", ZONE).where(F.col("r.name").isin(*SHOWN)).select("match", "position", F.col("id").alias("zone_id"), F.col("r.name").alias("zone"), F.col("r.owner").alias("zone_owner"), F.posexplode("r.objects").alias("place", "id"))
    seats = read("game", GAME).select("match", "position", F.col("r.seat").alias("seat"))
    rows = zones.join(read("object", OBJECT), ["match", "position", "id"], "left").join(seats, ["match", "position"], "left")
    hidden = F.col("r").isNull() | ((F.col("zone") == "HAND") & ~F.coalesce(F.col("zone_owner") == F.col("seat"), F.lit(False)))
    o = lambda name: F.when(~hidden, F.col(f"r.{name}"))
    card = F.coalesce(o("card"), o("overlay"))
    return rows.select(
        "match", "position", "zone_id", "zone", "zone_owner", "place", F.col("id").alias("object"), card.alias("card"),
        (hidden | F.coalesce(F.col("r.face_down"), F.lit(False)) | card.isNull()).alias("face_down"),
        F.when(hidden, F.coalesce(F.col("r.owner"), F.col("zone_owner"))).otherwise(F.col("r.owner")).alias("owner"),
        F.when(hidden, F.coalesce(F.col("r.owner"), F.col("zone_owner"))).otherwise(F.coalesce("r.controller", "r.owner")).alias("controller"),
        o("type").alias("type"), o("types").alias("types"), o("subtypes").alias("subtypes"), o("tapped").alias("tapped"),
        F.when(~hidden, F.coalesce(F.col("r.attack_state") == "AttackState_Attacking", F.lit(False))).alias("attacking"),
        F.when(~hidden, F.coalesce(F.col("r.block_state") == "BlockState_Blocking", F.lit(False))).alias("blocking"),
        *(o(c).alias(c) for c in ("power", "toughness", "damage", "counters", "attached_to", "parent", "source_card", "lineage")),
    )


def snapshot_players(held: DataFrame, asked: DataFrame) -> DataFrame:
    """match, position, seat, name, life, library and hand (counts) of each player, and the game's turn and seats at each asked position."""
    now = holding(held, asked)
    read = lambda kind, schema: now.where(F.col("kind") == kind).select("match", "position", "id", F.from_json("record", schema).alias("r"))
    count = F.when(F.size("r.objects") > 0, F.size("r.objects")).otherwise(F.coalesce("r.count", F.lit(0)))
    of = lambda name: F.min(F.when(F.col("r.name") == name, F.struct("id", count.alias("n"))))["n"].alias(name.lower())
    counts = read("zone", ZONE).groupBy("match", "position", F.col("r.owner").alias("seat")).agg(of("LIBRARY"), of("HAND"))
    players = read("player", PLAYER).select("match", "position", F.col("id").alias("seat"), F.coalesce("r.name", F.concat(F.lit("Seat "), "id")).alias("name"), F.col("r.life").alias("life"))
    game = read("game", GAME).select("match", "position", *(F.col(f"r.{c}").alias(c) for c in ("state_id", "over", "turn", "phase", "active")))
    return players.join(counts, ["match", "position", "seat"], "left").join(game, ["match", "position"], "left")
