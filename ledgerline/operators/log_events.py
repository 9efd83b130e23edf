"""Client log entries to typed events: unwrapping, routing by shape, and the carry of match and state.

An entry is one JSON value behind a log header.  Routing is stateless: every entry gives an array of
events.  What an event takes from earlier ones (the running match and game, the last state) is
one ordered pass over each file; repeated packs, requests and endings are dropped there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Messages that ask for a decision.
PROMPTS = (
    "GREMessageType_ActionsAvailableReq",
    "GREMessageType_AssignDamageReq",
    "GREMessageType_CastingTimeOptionsReq",
    "GREMessageType_ChooseStartingPlayerReq",
    "GREMessageType_DeclareAttackersReq",
    "GREMessageType_DeclareBlockersReq",
    "GREMessageType_GroupReq",
    "GREMessageType_MulliganReq",
    "GREMessageType_NumericInputReq",
    "GREMessageType_OptionalActionMessage",
    "GREMessageType_OrderReq",
    "GREMessageType_PayCostsReq",
    "GREMessageType_SearchReq",
    "GREMessageType_SelectNReq",
    "GREMessageType_SelectTargetsReq",
)
#: Messages that answer one.
ANSWERS = (
    "ClientMessageType_AssignDamageResp",
    "ClientMessageType_CastingTimeOptionsResp",
    "ClientMessageType_ChooseStartingPlayerResp",
    "ClientMessageType_ConcedeReq",
    "ClientMessageType_DeclareAttackersResp",
    "ClientMessageType_DeclareBlockersResp",
    "ClientMessageType_EffectCostResp",
    "ClientMessageType_GroupResp",
    "ClientMessageType_MulliganResp",
    "ClientMessageType_NumericInputResp",
    "ClientMessageType_OptionalActionResp",
    "ClientMessageType_OrderResp",
    "ClientMessageType_PerformActionResp",
    "ClientMessageType_PerformAutoTapActionsResp",
    "ClientMessageType_SearchResp",
    "ClientMessageType_SelectNResp",
    "ClientMessageType_SelectTargetsResp",
    "ClientMessageType_SubmitAttackersReq",
    "ClientMessageType_SubmitBlockersReq",
    "ClientMessageType_SubmitTargetsReq",
)
#: Other message types with a route of their own, and client envelopes.
CONNECT, DECK_REQUEST, DECK_ANSWER = "GREMessageType_ConnectResp", "GREMessageType_SubmitDeckReq", "ClientMessageType_SubmitDeckResp"
STATE, QUEUED_STATE = "GREMessageType_GameStateMessage", "GREMessageType_QueuedGameStateMessage"
ENVELOPES = ("ClientToMatchServiceMessageType_ClientToGREMessage", "ClientToMatchServiceMessageType_ClientToGREUIMessage")
#: Events that stay out of a game's history.
NO_HISTORY = ("ARENA_GRE_MESSAGE", "ARENA_CLIENT_TO_GRE_MESSAGE")
OVER = ("GameStage_GameOver", "GameOver")


def at(value: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(value, f"$.{path}", kind)


def first_at(value: Column, paths: tuple[str, ...], kind: str = "string") -> Column:
    """The value at the first path that is there."""
    return F.coalesce(*(at(value, p, kind) for p in paths))


def is_kind(value: Column, kind: str) -> Column:
    """Whether a VARIANT is of a kind.  Lists and objects are told by their outer shape: a schema would look at all that is in them."""
    outer = {"ARRAY": "array<variant>", "OBJECT": "map<string, variant>"}.get(kind)
    return F.try_variant_get(value, "$", outer).isNotNull() if outer else F.coalesce(F.schema_of_variant(value).startswith(kind), F.lit(False))


def let(value: Column, make) -> Column:
    """make(value), with the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), make), F.lit(0))


def decoded(value: Column) -> Column:
    """A JSON text inside a variant as what it says; other values as they are."""
    return F.when(is_kind(value, "STRING"), F.coalesce(F.try_parse_json(F.try_variant_get(value, "$", "string")), value)).otherwise(value)


def unwrapped(value: Column, depth: int = 4) -> Column:
    """The innermost value of payload, Payload or request wrappers; a client envelope is not opened."""
    def opened(v: Column, inner: Column) -> Column:
        return F.when(inner.isNull() | at(v, "clientToMatchServiceMessageType", "variant").isNotNull(), v).otherwise(decoded(inner))

    for _ in range(depth):
        value = let(value, lambda v: let(first_at(v, ("payload", "Payload", "request"), "variant"), lambda inner: opened(v, inner)))  # noqa: B023
    return value


def entry_json(text: Column) -> Column:
    """The JSON value at the first '{', else at the first '['; what follows it is passed over."""
    brace = F.instr(text, "{")
    start = F.when(brace > 0, brace).otherwise(F.instr(text, "["))
    return F.when(start > 0, F.try_parse_json(F.substr(text, start)))


def card_numbers(value: Column) -> Column:
    """Card ids of a comma text, a list of numbers or a list of objects."""
    spellings = ("grpId", "GrpId", "cardId", "CardId", "id")
    one = lambda x: F.coalesce(F.try_variant_get(x, "$", "bigint"), first_at(x, spellings, "bigint"))
    listed = F.transform(F.try_variant_get(value, "$", "array<variant>"), one)
    text = F.transform(F.split(F.try_variant_get(value, "$", "string"), ","), lambda x: F.when(F.trim(x).rlike(r"^\d+$"), F.trim(x).cast("bigint")))
    found = F.when(is_kind(value, "STRING"), text).otherwise(listed)
    return F.coalesce(F.filter(found, lambda x: x.isNotNull()), F.array().cast("array<bigint>"))


def state_of(message: Column) -> Column:
    """The state in a state message, queued or not."""
    return F.when(at(message, "type") == QUEUED_STATE, F.coalesce(at(message, "queuedGameStateMessage", "variant"), at(message, "gameStateMessage", "variant"))).otherwise(at(message, "gameStateMessage", "variant"))


def is_over(state: Column) -> Column:
    """A state at the end of its game."""
    return F.coalesce(F.greatest(*(F.coalesce(at(state, p).isin(*OVER), F.lit(False)) for p in ("gameStage", "stage", "gameInfo.gameStage", "gameInfo.stage"))), F.lit(False))


def _event(kind: Column, message_type: Column, body: Column) -> Column:
    return F.struct(kind.alias("type"), message_type.alias("message_type"), body.alias("body"))


def events_of(payload: Column) -> Column:
    """The events (type, message_type, body) of an unwrapped entry, in order."""
    none = F.lit(None).cast("string")
    room = at(payload, "matchGameRoomStateChangedEvent", "variant")
    final = at(room, "gameRoomInfo.finalMatchResult", "variant")
    limited = (
        F.when(at(payload, "PackCards", "variant").isNotNull(), "ARENA_DRAFT_PACK")
        .when(at(payload, "GrpIds", "variant").isNotNull() & first_at(payload, ("DraftId", "draftId"), "variant").isNotNull(), "ARENA_DRAFT_PICK")
        .when(is_kind(at(payload, "Deck", "variant"), "OBJECT") & at(payload, "EventName", "variant").isNotNull(), "ARENA_DECK_SUBMIT")
    )
    own = F.array(
        _event(F.when(is_kind(room, "OBJECT"), "ARENA_MATCH_STATE_CHANGED"), none, room),
        _event(F.when(is_kind(room, "OBJECT") & final.isNotNull(), "ARENA_GAME_OVER"), none, room),
        _event(limited, none, payload),
    )

    def served(message: Column) -> Column:
        return let(at(message, "type"), lambda kind: by_kind(message, kind))

    def by_kind(message: Column, kind: Column) -> Column:
        route = (
            F.when(kind == CONNECT, "ARENA_CONNECT_RESP")
            .when(kind == DECK_REQUEST, "ARENA_SIDEBOARD_PROMPT")
            .when(kind == STATE, "ARENA_GAME_STATE")
            .when(kind == QUEUED_STATE, "ARENA_QUEUED_GAME_STATE")
            .when(kind.isin(*PROMPTS), "ARENA_DECISION_PROMPT")
            .otherwise("ARENA_GRE_MESSAGE")
        )
        ends = kind.isin(STATE, QUEUED_STATE) & is_over(state_of(message))
        return F.array(_event(F.when(is_kind(message, "OBJECT"), route), kind, message), _event(F.when(ends, "ARENA_GAME_OVER"), kind, message))

    messages = F.flatten(F.transform(at(payload, "greToClientEvent.greToClientMessages", "array<variant>"), served))

    def sent(message: Column) -> Column:
        answer = at(message, "type")
        route = F.when(answer == DECK_ANSWER, "ARENA_SIDEBOARD_SUBMIT").when(answer.isin(*ANSWERS), "ARENA_CLIENT_DECISION").otherwise("ARENA_CLIENT_TO_GRE_MESSAGE")
        return _event(F.when(at(payload, "clientToMatchServiceMessageType").isin(*ENVELOPES) & is_kind(message, "OBJECT"), route), answer, message)

    client = let(unwrapped(decoded(at(payload, "payload", "variant"))), sent)
    every = F.concat(own, F.coalesce(messages, F.slice(own, 1, 0)), F.array(client))
    return F.filter(every, lambda e: e["type"].isNotNull())


def routed(entries: DataFrame) -> DataFrame:
    """file, entry, raw_id, part, type, message_type, body of all events of (file, entry, text)."""
    rows = entries.select("file", "entry", let(entry_json(F.col("text")), lambda v: unwrapped(v)).alias("payload")).where("payload is not null")
    number = F.row_number().over(Window.partitionBy("file").orderBy("entry"))
    rows = rows.withColumn("raw_id", F.format_string("arena-raw-%06d", number))
    return rows.select("file", "entry", "raw_id", F.posexplode(events_of(F.col("payload"))).alias("part", "e")).select("file", "entry", "raw_id", "part", "e.*")


def normalize_stream(entries: DataFrame) -> DataFrame:
    """The events of (file, entry, text) with event_id, match_id, game_number, preceding_state and history.

    A repeated pack, deck request of a match or ending of a game goes.  A match holds from the event that names it
    to the next name; the game number starts anew with it.  One sort a file serves all carries.
    """
    rows = routed(entries)
    body, kind = F.col("body"), F.col("type")
    state = F.when(F.col("message_type").isin(STATE, QUEUED_STATE), state_of(body))
    named = F.when(kind == "ARENA_MATCH_STATE_CHANGED", at(body, "gameRoomInfo.gameRoomConfig.matchId")).otherwise(first_at(state, ("gameInfo.matchID", "gameInfo.matchId")))
    order = Window.partitionBy("file").orderBy("entry", "part")
    rows = rows.withColumns({"named_": named, "number_": at(state, "gameInfo.gameNumber", "bigint")})
    rows = rows.withColumn("match_id", F.last("named_", True).over(order))
    changed = F.when(~F.col("match_id").eqNullSafe(F.lag("match_id").over(order)), 1).otherwise(0)
    rows = rows.withColumn("changed_", changed).withColumn("run_", F.sum("changed_").over(order))
    rows = rows.withColumn("game_number", F.last("number_", True).over(Window.partitionBy("file", "run_").orderBy("entry", "part")))
    text = lambda *parts: F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("?")) for p in parts))
    pack = text(F.lit("pack"), first_at(body, ("draftId", "DraftId")), first_at(body, ("SelfPack", "PackNumber", "Pack")), first_at(body, ("SelfPick", "PickNumber", "Pick")), F.array_join(card_numbers(at(body, "PackCards", "variant")), ","))
    over = F.when(F.col("message_type").isNull(), text(F.lit("final"), F.col("match_id"))).otherwise(text(F.lit("state"), F.col("match_id"), F.col("game_number")))
    once = F.when(kind == "ARENA_DRAFT_PACK", pack).when(kind == "ARENA_SIDEBOARD_PROMPT", text(F.lit("deck"), F.col("match_id"), at(body, "msgId"))).when(kind == "ARENA_GAME_OVER", over)
    rows = rows.withColumn("once_", once)
    rows = rows.withColumn("seen_", F.row_number().over(Window.partitionBy("file", "once_").orderBy("entry", "part"))).where("once_ is null or seen_ = 1")
    rows = rows.withColumn("event_id", F.format_string("arena-%06d", F.row_number().over(order)))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("preceding_state", F.last(F.when(kind.isin("ARENA_GAME_STATE", "ARENA_QUEUED_GAME_STATE"), F.col("event_id")), True).over(before))
    return rows.withColumn("history", ~kind.isin(*NO_HISTORY)).drop("named_", "number_", "changed_", "run_", "once_", "seen_")
