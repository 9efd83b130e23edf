"""Queries of folded games: state messages are written as JSON from events, folded in several runs of one stream, and looked up again."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerline.operators import snapshots as Z
from ledgerline.plans.registry import query
from ledgerline.plans.scratch import shared_folder
from ledgerline.plans.stream_queries import as_json
from ledgerline.plans.views import STATES_SQL, read, states
from ledgerline.streaming import boards, keyed
from ledgerline.streaming.streams import LATENESS, run_to_table

EPOCH = 40
#: Zone of an event type: its number (owners' zones lie side by side), name and whether it has an owner.
ZONES = {"click": (10, "ZoneType_Battlefield"), "view": (20, "ZoneType_Hand"), "purchase": (30, "ZoneType_Graveyard"), "error": (40, "ZoneType_Library"), "signup": (50, "ZoneType_Stack")}


def game_messages(spark, sf_dir):
    """match, position, kind, text, at: an event is a message; every fortieth state is full.

    An error deletes its object, a signup renumbers it, other events describe it; a large reading taps it, and every tenth object has no card.
    """
    rows = states(spark, sf_dir).withColumn("last", F.lag("object").over(Window.partitionBy("game").orderBy("seq")))
    k, zone, owner = F.col("object"), F.col("zone"), F.col("object") % 2 + 1
    number, name = F, F
    for kind, (n, z) in ZONES.items():
        number, name = number.when(zone == kind, n), name.when(zone == kind, z)
    described = F.array(F.struct(k.alias("instanceId"), F.when(k % 10 != 0, k + 1).alias("grpId"), owner.alias("ownerSeatId"), F.struct(F.floor("reading").alias("value")).alias("power"), F.when(F.col("reading") > 30, True).alias("isTapped")))
    detail = lambda key, value: F.struct(F.lit(key).alias("key"), F.array(value).alias("valueInt32"))
    renumbered = F.array(F.struct(F.array(F.lit(boards.ID_CHANGED)).alias("type"), F.array(detail("orig_id", k), detail("new_id", k + 1000)).alias("details")))
    held = F.array_compact(F.array(F.col("last"), F.when(zone == "signup", k + 1000).otherwise(k)))
    text = as_json(
        type=F.when(F.col("seq") % EPOCH == 0, boards.FULL).otherwise("GameStateType_Diff"),
        gameStateId=F.col("seq") + 1,
        diffDeletedInstanceIds=F.when(zone == "error", F.array(k)),
        annotations=F.when(zone == "signup", renumbered),
        gameObjects=F.when(~zone.isin("error", "signup"), described),
        zones=F.array(F.struct((number + owner).alias("zoneId"), name.alias("type"), owner.alias("ownerSeatId"), held.alias("objectInstanceIds"))),
        players=F.array(F.struct((F.col("seq") % 2 + 1).alias("systemSeatNumber"), (20 - F.col("seq") % 7).alias("lifeTotal"))),
        turnInfo=F.struct(F.floor(F.col("seq") / 4).alias("turnNumber"), zone.alias("phase")),
        systemSeatIds=F.when(F.col("game") % 2 == 0, F.array(F.lit(1))),
    )
    return rows.select(F.col("game").cast("string").alias("match"), F.col("seq").alias("position"), F.lit("state").alias("kind"), text.alias("text"), F.col("ts").cast("timestamp").alias("at"))


def in_runs(spark, rows, make, idle=keyed.IDLE, runs=3):
    """The fold of rows that arrive in several runs of one stream, by time, each of which starts from what the one before left."""
    folder = shared_folder(spark, "fold")
    first, last = rows.agg(F.min(F.unix_micros("at")), F.max(F.unix_micros("at"))).first()
    share = (F.unix_micros("at") - F.lit(first)) / F.lit(max(1, (last or 0) - (first or 0)) if first is not None else 1)
    rows.withColumn("run", F.least(F.floor(share * runs), F.lit(runs - 1))).write.partitionBy("run").parquet(f"{folder}/all")
    for run in range(runs):
        spark.read.parquet(f"{folder}/all").where(F.col("run") == run).drop("run").write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/in").withWatermark("at", LATENESS)
        with keyed.state_on_disk(spark):
            table = run_to_table(keyed.folded(stream, make, idle), folder)
    return table


#: Object records after each message that names or ends them: native ones (k) live in runs between deletes and renumberings of an epoch, renumbered ones (k + 1000) from the first that carries a card.
OBJECTS_SQL = f"""
ev AS (SELECT game, seq, object AS k, zone, reading, seq // {EPOCH} AS epoch, zone NOT IN ('error', 'signup') AS up FROM st),
gr AS (SELECT *, coalesce(sum((NOT up)::INT) OVER (PARTITION BY game, epoch, k ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM ev),
up AS (SELECT *, bool_or(up AND reading > 30) OVER w AS tapped, last_value(CASE WHEN up THEN floor(reading)::BIGINT END IGNORE NULLS) OVER w AS power, count(*) FILTER (up) OVER w > 0 AS known
  FROM gr WINDOW w AS (PARTITION BY game, epoch, k, g ORDER BY seq)),
mv AS (SELECT *, row_number() OVER (PARTITION BY game, epoch, k ORDER BY seq) AS nth FROM up WHERE zone = 'signup' AND known),
born AS (
  SELECT game, seq, epoch, k AS id, true AS alive, CASE WHEN k % 10 <> 0 THEN k + 1 END AS card, tapped, power, 0 AS moves FROM up WHERE up
  UNION ALL SELECT game, seq, epoch, k, false, NULL, NULL, NULL, NULL FROM up WHERE NOT up AND known
  UNION ALL SELECT game, seq, epoch, k + 1000, true, CASE WHEN k % 10 <> 0 THEN k + 1 END, tapped, power, 2 FROM mv WHERE nth = 1 OR k % 10 = 0
),
ends AS (SELECT game, epoch, id, bool_or(alive) AS lives FROM (SELECT game, epoch, id, alive AND seq = max(seq) OVER (PARTITION BY game, epoch, id) AS alive FROM born) GROUP BY ALL),
ver AS (
  SELECT * EXCLUDE (epoch) FROM born
  UNION ALL SELECT e.game, (e.epoch + 1) * {EPOCH}, e.id, false, NULL, NULL, NULL, NULL FROM ends e JOIN ev f ON f.game = e.game AND f.seq = (e.epoch + 1) * {EPOCH}
    WHERE lives AND NOT EXISTS (SELECT 1 FROM born b WHERE b.game = e.game AND b.id = e.id AND b.seq = f.seq)
)"""


@query(f"WITH {STATES_SQL}, {OBJECTS_SQL} SELECT game::VARCHAR AS match, seq AS position, id, alive, card, tapped, power, moves FROM ver")
def fold_state(spark, sf_dir):
    """Object records after each message that changes them, folded in three runs of a stream.  A game's events lie far apart, so its state waits a year."""
    rows = in_runs(spark, game_messages(spark, sf_dir), boards.Board, 400 * 86_400_000).where("kind = 'object'").withColumn("r", F.from_json("record", Z.OBJECT))
    moves = F.when(F.col("r").isNotNull(), F.coalesce(F.size("r.lineage"), F.lit(0)))
    return rows.select("match", "position", "id", F.col("r").isNotNull().alias("alive"), "r.card", "r.tapped", "r.power", moves.alias("moves"))


@query(
    f"""WITH {STATES_SQL}, {OBJECTS_SQL},
zn AS (SELECT game, seq, seq // {EPOCH} AS epoch, CASE zone WHEN 'click' THEN 10 WHEN 'view' THEN 20 WHEN 'purchase' THEN 30 WHEN 'error' THEN 40 ELSE 50 END + object % 2 + 1 AS zone_id, object % 2 + 1 AS owner, zone,
  list_filter([lag(object) OVER (PARTITION BY game ORDER BY seq), CASE WHEN zone = 'signup' THEN object + 1000 ELSE object END], lambda x: x IS NOT NULL) AS objects FROM st),
ask AS (SELECT game, seq AS position FROM st WHERE seq % 25 = 24),
zl AS (SELECT ask.game, position, zone_id, owner, zone, objects FROM ask JOIN zn ON zn.game = ask.game AND zn.seq <= position AND zn.epoch = position // {EPOCH} AND zone <> 'error'
  QUALIFY row_number() OVER (PARTITION BY ask.game, position, zone_id ORDER BY seq DESC) = 1),
zo AS (SELECT game, position, zone_id, owner, zone, unnest(objects) AS object, unnest(range(len(objects))) AS place FROM zl),
ob AS (SELECT ask.game, position, id, alive, card, tapped, power FROM ask JOIN ver ON ver.game = ask.game AND ver.seq <= position QUALIFY row_number() OVER (PARTITION BY ask.game, position, id ORDER BY seq DESC) = 1),
al AS (SELECT zo.*, ob.card, ob.tapped, ob.power, coalesce(ob.alive, false) AND (zone <> 'view' OR (owner = 1 AND zo.game % 2 = 0)) AS seen FROM zo LEFT JOIN ob ON ob.game = zo.game AND ob.position = zo.position AND ob.id = zo.object)
SELECT game::VARCHAR AS match, position, zone_id, place::INTEGER AS place, object, CASE WHEN seen THEN card END AS card, NOT seen OR card IS NULL AS face_down, CASE WHEN seen THEN tapped END AS tapped, CASE WHEN seen THEN power END AS power FROM al"""
)
def snapshot_view(spark, sf_dir):
    """The shown zones at every 25th position of each game."""
    messages = game_messages(spark, sf_dir)
    held = Z.intervals(keyed.folded(messages, boards.Board))
    asked = messages.where("position % 25 = 24")
    return Z.snapshot_objects(held, asked).select("match", "position", "zone_id", "place", "object", "card", "face_down", "tapped", "power")


@query(
    """WITH RECURSIVE r AS (SELECT conv_id, turn, role, turn // 5 AS game, CASE WHEN role = 'assistant' THEN turn - 1 - 2 * (turn % 3) END AS number,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations WHERE role IN ('user', 'assistant')),
s AS (
  SELECT conv_id, 0::BIGINT AS i, NULL::BIGINT AS game, []::BIGINT[] AS waiting, NULL::BIGINT AS prompt, NULL::BIGINT AS response FROM (SELECT DISTINCT conv_id FROM r)
  UNION ALL
  SELECT r.conv_id, r.i, r.game, CASE WHEN r.role = 'user' THEN list_append(w, r.turn)[-8:] ELSE list_filter(w, lambda x: x <> r.number) END,
    CASE WHEN list_contains(w, r.number) THEN r.number END, r.turn
  FROM (SELECT s.conv_id, s.i, CASE WHEN n.game IS DISTINCT FROM s.game THEN []::BIGINT[] ELSE s.waiting END AS w FROM s JOIN r n ON n.conv_id = s.conv_id AND n.i = s.i + 1) q JOIN r ON r.conv_id = q.conv_id AND r.i = q.i + 1
)
SELECT conv_id::VARCHAR AS match, prompt, response FROM s WHERE prompt IS NOT NULL"""
)
def pending_prompts(spark, sf_dir):
    """Turns are prompts and answers that name an earlier turn; every five turns a new game begins, and a conversation's end ends its last one."""
    rows = read(spark, sf_dir, "conversations").where("role in ('user', 'assistant')").select("conv_id", F.col("turn").cast("long").alias("turn"), "role")
    order = Window.partitionBy("conv_id").orderBy("turn")
    number = F.when(F.col("role") == "user", F.col("turn")).otherwise(F.col("turn") - 1 - 2 * (F.col("turn") % 3))
    rows = rows.withColumns({"new": ~F.floor(F.col("turn") / 5).eqNullSafe(F.lag(F.floor(F.col("turn") / 5)).over(order)), "last": F.lead("turn").over(order).isNull()})
    message = lambda add, kind, text: F.struct((F.col("turn") * 3 + add).alias("position"), F.lit(kind).alias("kind") if isinstance(kind, str) else kind.alias("kind"), text.alias("text"))
    said = message(1, F.when(F.col("role") == "user", "prompt").otherwise("answer"), as_json(id=number))
    every = F.array_compact(F.array(F.when(F.col("new"), message(0, "game", F.lit("{}"))), said, F.when(F.col("last"), message(2, "over", F.lit("{}")))))
    flat = rows.select(F.col("conv_id").cast("string").alias("match"), F.explode(every).alias("m")).select("match", "m.*").withColumn("at", F.timestamp_seconds("position"))
    return in_runs(spark, flat, boards.Pending).select("match", F.floor(F.col("id") / 3).alias("prompt"), F.floor(F.col("position") / 3).alias("response"))
