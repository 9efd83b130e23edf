"""Queries of the log front end: entries and prompts are written as JSON from the driver's tables, then routed, numbered and matched."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.functions.event_tables import log_events
from ledgerline.operators import log_events as L
from ledgerline.operators import prompts as P
from ledgerline.plans.registry import query
from ledgerline.plans.scratch import shared_folder
from ledgerline.plans.views import OPTIONS_SQL, decisions, read
from ledgerline.sources import files
from ledgerline.sources.tail import LogTail, write_logs
from ledgerline.streaming.streams import run_to_table

WITH = f"WITH {OPTIONS_SQL}"


def as_json(**fields):
    return F.to_json(F.struct(*(v.alias(k) for k, v in fields.items())))


def entries(spark, sf_dir):
    """file, entry, text: a conversation is a log, a turn an entry of one of six shapes."""
    rows = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("file"), F.col("turn").alias("entry"))
    k, entry = F.pmod(F.col("file") + F.col("entry"), F.lit(6)), F.col("entry")
    run = F.floor(entry / 12)
    message = lambda *messages: as_json(greToClientEvent=F.struct(F.array(*messages).alias("greToClientMessages")))
    match = as_json(matchGameRoomStateChangedEvent=F.struct(F.struct(F.struct(F.concat(F.lit("m"), F.col("file"), F.lit("-"), run).alias("matchId")).alias("gameRoomConfig")).alias("gameRoomInfo")))
    state = F.struct(F.lit(L.STATE).alias("type"), F.lit(None).cast("long").alias("msgId"), F.struct(F.struct(entry.alias("gameNumber")).alias("gameInfo")).alias("gameStateMessage"))
    prompt = F.struct(F.lit("GREMessageType_SelectNReq").alias("type"), entry.alias("msgId"), F.lit(None).cast("struct<gameInfo: struct<gameNumber: bigint>>").alias("gameStateMessage"))
    answer = as_json(clientToMatchServiceMessageType=F.lit(L.ENVELOPES[0]), payload=as_json(type=F.lit("ClientMessageType_SelectNResp"), respId=entry))
    pack = as_json(payload=as_json(draftId=F.lit("d"), PackNumber=F.lit(1), PickNumber=run, PackCards=F.lit("11, 12,x")))
    other = message(F.struct(F.lit("GREMessageType_UIMessage").alias("type")))
    text = F.when(k == 0, match).when(k == 1, message(state, prompt)).when(k == 2, answer).when(k == 3, pack).when(k == 4, F.concat(other, F.lit(" and more"))).otherwise("[Manifest] no value here")
    return rows.select("file", "entry", F.concat(F.lit("==> "), text).alias("text"))


ENTRIES_SQL = """
e AS (SELECT conv_id AS file, turn AS entry, (conv_id + turn) % 6 AS k, turn // 12 AS run FROM conversations),
v AS (
  SELECT *, 0 AS part FROM e WHERE k < 5
  UNION ALL SELECT *, 1 AS part FROM e WHERE k = 1
),
r AS (
  SELECT file, entry, part, k, run,
    CASE k WHEN 0 THEN 'ARENA_MATCH_STATE_CHANGED' WHEN 1 THEN CASE part WHEN 0 THEN 'ARENA_GAME_STATE' ELSE 'ARENA_DECISION_PROMPT' END
      WHEN 2 THEN 'ARENA_CLIENT_DECISION' WHEN 3 THEN 'ARENA_DRAFT_PACK' ELSE 'ARENA_GRE_MESSAGE' END AS type,
    CASE k WHEN 1 THEN CASE part WHEN 0 THEN 'GREMessageType_GameStateMessage' ELSE 'GREMessageType_SelectNReq' END
      WHEN 2 THEN 'ClientMessageType_SelectNResp' WHEN 4 THEN 'GREMessageType_UIMessage' END AS message_type,
    CASE WHEN k = 0 THEN 'm' || file || '-' || run END AS named, CASE WHEN k = 1 AND part = 0 THEN entry END AS number
  FROM v
)"""


@query(f"WITH {ENTRIES_SQL} SELECT type, message_type, count(*) AS n FROM r GROUP BY 1, 2")
def event_routes(spark, sf_dir):
    return L.routed(entries(spark, sf_dir)).groupBy("type", "message_type").agg(F.count("*").alias("n"))


@query(f"WITH {ENTRIES_SQL} SELECT file, entry, part, type, message_type FROM r")
def events_udtf(spark, sf_dir):
    return log_events(entries(spark, sf_dir)).select("file", "entry", "part", "type", "message_type")


@query(
    f"""WITH {ENTRIES_SQL},
m AS (SELECT *, last_value(named IGNORE NULLS) OVER o AS match_id FROM r WINDOW o AS (PARTITION BY file ORDER BY entry, part)),
c AS (SELECT *, (match_id IS DISTINCT FROM lag(match_id) OVER (PARTITION BY file ORDER BY entry, part))::INT AS changed FROM m),
g AS (SELECT *, sum(changed) OVER (PARTITION BY file ORDER BY entry, part) AS grp FROM c),
n AS (SELECT *, last_value(number IGNORE NULLS) OVER (PARTITION BY file, grp ORDER BY entry, part) AS game_number,
        row_number() OVER (PARTITION BY file, k, run ORDER BY entry, part) AS seen FROM g),
d AS (SELECT *, 'arena-' || lpad((row_number() OVER (PARTITION BY file ORDER BY entry, part))::VARCHAR, 6, '0') AS event_id FROM n WHERE k <> 3 OR seen = 1)
SELECT file, entry, event_id, type, match_id, game_number, type <> 'ARENA_GRE_MESSAGE' AS history,
  last_value(CASE WHEN k = 1 AND part = 0 THEN event_id END IGNORE NULLS) OVER (PARTITION BY file ORDER BY entry, part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS preceding_state
FROM d"""
)
def normalize_stream(spark, sf_dir):
    return L.normalize_stream(entries(spark, sf_dir)).select("file", "entry", "event_id", "type", "match_id", "game_number", "history", "preceding_state")


@query("SELECT conv_id AS file, turn AS entry, text FROM conversations")
def read_log_text(spark, sf_dir):
    """Every turn is written as an entry with a header line; the raw bytes are read back and cut into entries again."""
    path = shared_folder(spark, "logs")
    rows = read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("log"), F.col("turn").alias("entry"), F.concat(F.lit("[Log]"), F.col("turn"), F.lit("\n"), F.col("text")).alias("value"))
    rows.repartition("log").sortWithinPartitions("log", "entry").select("log", "value").write.partitionBy("log").text(path)
    return files.read_log(spark, path, r"^\[Log\](\d+)$").select(F.regexp_extract("file", r"log=(\d+)", 1).cast("long").alias("file"), F.regexp_extract("header", r"(\d+)", 1).cast("long").alias("entry"), "text")


@query("SELECT conv_id AS file, turn AS entry, text FROM conversations")
def stream_log(spark, sf_dir):
    """Every turn is written as an entry, the first half of a log before the second; the folder is followed from where it was left."""
    path, run = shared_folder(spark, "tail"), shared_folder(spark, "run")
    rows = read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("log"), F.col("turn").alias("entry"), F.concat(F.lit("[Log]"), F.col("turn"), F.lit("\n"), F.col("text")).alias("value"))
    spark.dataSource.register(LogTail)
    for half in (0, 1):
        write_logs(rows.where(F.pmod("entry", F.lit(2)) == half), path, "log", "entry", "value", f"half-{half}.txt")
        stream = spark.readStream.format("log_tail").options(path=path, header=r"\[Log\]\d+\r?$", suffix=".txt", idle="0", memory=f"{run}/memory").load()
        table = run_to_table(stream, run)
    return table.select(F.regexp_extract("file", r"log=(\d+)", 1).cast("long").alias("file"), F.regexp_extract("header", r"(\d+)", 1).cast("long").alias("entry"), "text")


def prompt_messages(spark, sf_dir):
    """game, seq, decision, and the prompt and its answer as messages of the kind that the decision's number gives."""
    df = decisions(spark, sf_dir)
    options, pick, k = F.col("select.option"), F.col("selectedIndices")[0], F.pmod("decision", F.lit(15))
    index = F.transform(options, lambda o: o["index"])
    every = lambda make: F.transform(options, make)
    nothing = F.struct(F.lit(1).alias("x"))
    seat = F.struct(F.lit("DamageRecType_Player").alias("type"), F.lit(2).alias("playerSystemSeatId"))
    asked = {
        "ActionsAvailableReq": {"actionsAvailableReq": F.struct(every(lambda o: F.struct(F.lit("ActionType_Cast").alias("actionType"), o["part"].alias("grpId"), o["index"].alias("instanceId"))).alias("actions"))},
        "ChooseStartingPlayerReq": {"chooseStartingPlayerReq": F.struct(F.array(F.lit(1), F.lit(2)).alias("systemSeatIds"))},
        "MulliganReq": {"mulliganReq": nothing},
        "SelectTargetsReq": {"selectTargetsReq": F.struct(F.array(F.struct(F.lit(1).alias("targetIdx"), F.lit(1).alias("minTargets"), F.lit(1).alias("maxTargets"), every(lambda o: F.struct(o["index"].alias("targetInstanceId"))).alias("targets"))).alias("targets"))},
        "DeclareAttackersReq": {"declareAttackersReq": F.struct(every(lambda o: F.struct(o["index"].alias("attackerInstanceId"), F.array(seat).alias("legalDamageRecipients"))).alias("qualifiedAttackers"))},
        "DeclareBlockersReq": {"declareBlockersReq": F.struct(every(lambda o: F.struct(o["index"].alias("blockerInstanceId"), F.array(F.lit(99)).alias("attackerInstanceIds"))).alias("blockers"))},
        "CastingTimeOptionsReq": {"castingTimeOptionsReq": F.struct(F.array(F.struct(F.lit(1).alias("ctoId"), F.struct(F.lit(1).alias("minSel"), F.lit(2).alias("maxSel"), every(lambda o: F.struct(o["index"].alias("grpId"))).alias("modalOptions")).alias("modalReq"))).alias("castingTimeOptionReq"))},
        "PayCostsReq": {"payCostsReq": F.struct(F.struct(every(lambda o: F.struct(F.lit("ActionType_Pay").alias("actionType"), o["index"].alias("instanceId"))).alias("actions")).alias("paymentActions"), nothing.alias("autoTapActionsReq"))},
        "SearchReq": {"searchReq": F.struct(index.alias("itemsSought"), F.lit("AllowFail_Any").alias("allowFailToFind"), F.lit(2).alias("maxFind"))},
        "SelectNReq": {"selectNReq": F.struct(index.alias("ids"), F.lit(1).alias("minSel"), F.lit(1).alias("maxSel"))},
        "GroupReq": {"groupReq": F.struct(index.alias("instanceIds"), F.array(F.struct(F.lit("Hand").alias("zoneType"), F.lit("Top").alias("subZoneType"))).alias("groupSpecs"))},
        "NumericInputReq": {"numericInputReq": nothing},
        "OptionalActionMessage": {"optionalActionMessage": nothing},
        "OrderReq": {"orderReq": F.struct(index.alias("ids"))},
        "AssignDamageReq": {"assignDamageReq": F.struct(F.array(F.struct(F.lit(7).alias("instanceId"), every(lambda o: F.struct(o["index"].alias("instanceId"), F.lit(0).alias("minDamage"))).alias("assignments"))).alias("damageAssigners"))},
    }
    one = F.array(pick)
    said = {
        "PerformActionResp": {"performActionResp": F.struct(F.array(F.struct(F.lit("ActionType_Cast").alias("actionType"), pick.alias("instanceId"))).alias("actions"))},  # without the card
        "ChooseStartingPlayerResp": {"chooseStartingPlayerResp": F.struct(F.lit(2).alias("systemSeatId"))},
        "MulliganResp": {"mulliganResp": F.struct(F.lit(P.NEW_HAND).alias("decision"))},
        "SelectTargetsResp": {"selectTargetsResp": F.struct(F.struct(F.lit(1).alias("targetIdx"), F.array(F.struct(pick.alias("targetInstanceId"))).alias("targets")).alias("target"))},
        "DeclareAttackersResp": {"declareAttackersResp": F.struct(F.lit(True).alias("autoDeclare"), seat.alias("autoDeclareDamageRecipient"))},
        "DeclareBlockersResp": {"declareBlockersResp": F.struct(F.array(F.struct(pick.alias("blockerInstanceId"), F.array(F.lit(99)).alias("selectedAttackerInstanceIds"))).alias("selectedBlockers"))},
        "CastingTimeOptionsResp": {"castingTimeOptionsResp": F.struct(F.struct(F.struct(one.alias("grpIds")).alias("chooseModalResp")).alias("castingTimeOptionResp"))},
        "PerformAutoTapActionsResp": {"performAutoTapActionsResp": nothing},
        "SearchResp": {"searchResp": F.struct(one.alias("itemsFound"))},
        "SelectNResp": {"selectNResp": F.struct(one.alias("ids"))},
        "GroupResp": {"groupResp": F.struct(F.array(F.struct(F.array().cast("array<bigint>").alias("ids")), F.struct(one.alias("ids"))).alias("groups"))},
        "NumericInputResp": {"numericInputResp": nothing},
        "OptionalActionResp": {"optionalResp": F.struct(F.lit("OptionResponse_Allow_No").alias("response"))},
        "OrderResp": {"orderResp": F.struct(F.reverse(index).alias("ids"))},
        "AssignDamageResp": {"assignDamageResp": F.struct(F.array(F.struct(F.lit(7).alias("instanceId"), F.transform(options, lambda o: F.struct(o["index"].alias("instanceId"), F.when(o["index"] == pick, 3).otherwise(0).alias("assignedDamage"))).alias("assignments"))).alias("assigners"))},
    }
    ask, tell, asked_type, said_type = F, F, F, F
    for n, ((prompt, body), (answer, reply)) in enumerate(zip(asked.items(), said.items(), strict=True)):
        prompt_type = prompt if prompt.startswith("GRE") else f"GREMessageType_{prompt}"
        ask, asked_type = ask.when(k == n, as_json(type=F.lit(prompt_type), msgId=F.col("decision"), **body)), asked_type.when(k == n, prompt_type)
        tell, said_type = tell.when(k == n, as_json(type=F.lit(f"ClientMessageType_{answer}"), respId=F.col("decision"), **reply)), said_type.when(k == n, f"ClientMessageType_{answer}")
    return df.select(F.col("gameId").alias("game"), (F.col("sequenceNumber") * 2).alias("seq"), "decision", ask.alias("asked"), asked_type.alias("asked_type"), tell.alias("said"), said_type.alias("said_type"))


def prompts(spark, sf_dir):
    rows = prompt_messages(spark, sf_dir).select("game", "seq", "decision", F.col("asked_type").alias("message_type"), F.parse_json("asked").alias("body"))
    return P.build_prompts(rows)


KINDS = "['ActionsAvailableReq', 'ChooseStartingPlayerReq', 'MulliganReq', 'SelectTargetsReq', 'DeclareAttackersReq', 'DeclareBlockersReq', 'CastingTimeOptionsReq', 'PayCostsReq', 'SearchReq', 'SelectNReq', 'GroupReq', 'NumericInputReq', 'OptionalActionMessage', 'OrderReq', 'AssignDamageReq'][k + 1]"


@query(
    f"""{WITH}, d AS (SELECT decision, n, decision % 15 AS k FROM dec)
SELECT decision, {KINDS} AS kind, CASE WHEN k IN (1, 2, 12) THEN 2 WHEN k = 11 THEN 1 WHEN k IN (7, 8) THEN n + 1 ELSE n END AS options,
  CASE WHEN k IN (4, 5, 7, 8, 10, 14) THEN 0 WHEN k = 13 THEN n ELSE 1 END AS least,
  CASE WHEN k IN (4, 5, 10, 13, 14) THEN n WHEN k IN (6, 8) THEN 2 WHEN k = 7 THEN n + 1 ELSE 1 END AS most,
  CASE k WHEN 0 THEN 'CAST' WHEN 1 THEN 'SEAT' WHEN 2 THEN 'KEEP' WHEN 3 THEN 'TARGET' WHEN 4 THEN 'ATTACK' WHEN 5 THEN 'BLOCK' WHEN 6 THEN 'MODE' WHEN 7 THEN 'PAY' WHEN 8 THEN 'FIND'
    WHEN 9 THEN 'SELECT' WHEN 10 THEN 'GROUP_ITEM' WHEN 11 THEN 'NUMBER' WHEN 12 THEN 'YES' WHEN 13 THEN 'ORDER_ITEM' ELSE 'ASSIGN_DAMAGE' END AS first_type
FROM d"""
)
def build_prompt(spark, sf_dir):
    return prompts(spark, sf_dir).select("decision", "kind", F.size("select.option").cast("long").alias("options"), F.col("select.minCount").alias("least"), F.col("select.maxCount").alias("most"), F.col("select.option")[0]["type"].alias("first_type"))


@query(
    f"""{WITH}, d AS (SELECT decision, n, pick, decision % 15 AS k FROM dec)
SELECT decision, CASE WHEN k IN (1, 2, 12) THEN '1' WHEN k = 4 THEN array_to_string(range(n), ',') WHEN k = 7 THEN n::VARCHAR WHEN k = 11 THEN NULL
  WHEN k = 13 THEN array_to_string(list_reverse(range(n)), ',') ELSE pick::VARCHAR END AS selected, k <> 11 AS matched
FROM d"""
)
def match_response(spark, sf_dir):
    answers = prompt_messages(spark, sf_dir).select("game", (F.col("seq") + 1).alias("seq"), F.col("decision"), F.col("said_type").alias("message_type"), F.parse_json("said").alias("body"))
    return P.match_responses(prompts(spark, sf_dir), answers, ["game"]).select("decision", F.array_join(F.col("selected").cast("array<string>"), ",").alias("selected"), "matched")
