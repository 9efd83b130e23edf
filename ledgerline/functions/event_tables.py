"""A table function over log entries: one entry gives a row for each of its events, by the routes of ``operators.log_events``."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.operators.log_events import ANSWERS, CONNECT, DECK_ANSWER, DECK_REQUEST, ENVELOPES, OVER, PROMPTS, QUEUED_STATE, STATE
from ledgerline.workers import carried

carried(__name__)

EVENT = "part int, type string, message_type string, body string"
SERVED = {CONNECT: "ARENA_CONNECT_RESP", DECK_REQUEST: "ARENA_SIDEBOARD_PROMPT", STATE: "ARENA_GAME_STATE", QUEUED_STATE: "ARENA_QUEUED_GAME_STATE"} | dict.fromkeys(PROMPTS, "ARENA_DECISION_PROMPT")
SENT = {DECK_ANSWER: "ARENA_SIDEBOARD_SUBMIT"} | dict.fromkeys(ANSWERS, "ARENA_CLIENT_DECISION")
WRAPPERS, DEPTH = ("payload", "Payload", "request"), 4
END_PLACES = (("gameStage",), ("stage",), ("gameInfo", "gameStage"), ("gameInfo", "stage"))
ENVELOPE_KINDS, END_KINDS, STATE_KINDS, QUEUED = ENVELOPES, OVER, (STATE, QUEUED_STATE), QUEUED_STATE


def decoded(value):
    """A JSON text as what it says."""
    if isinstance(value, str):
        try:
            return json.loads(value)
        except ValueError:
            return value
    return value


def unwrapped(value):
    for _ in range(DEPTH):
        inner = next((value[w] for w in WRAPPERS if value.get(w) is not None), None) if isinstance(value, dict) and "clientToMatchServiceMessageType" not in value else None
        if inner is None:
            break
        value = decoded(inner)
    return value


def inside(value, *keys):
    for key in keys:
        value = value.get(key) if isinstance(value, dict) else None
    return value


class LogEvents:
    """eval(text) -> EVENT rows of an entry, in order; a text without JSON gives none."""

    def eval(self, text: str):
        brace = (text or "").find("{")
        start = brace if brace >= 0 else (text or "").find("[")
        try:
            payload = unwrapped(json.JSONDecoder().raw_decode(text, start)[0]) if start >= 0 else None
        except ValueError:
            payload = None
        if isinstance(payload, dict):
            for part, (kind, message_type, body) in enumerate(self.events(payload)):
                yield part, kind, message_type, json.dumps(body, sort_keys=True, separators=(",", ":"))

    def events(self, payload: dict):
        room = payload.get("matchGameRoomStateChangedEvent")
        if isinstance(room, dict):
            yield "ARENA_MATCH_STATE_CHANGED", None, room
            if inside(room, "gameRoomInfo", "finalMatchResult") is not None:
                yield "ARENA_GAME_OVER", None, room
        if payload.get("PackCards") is not None:
            yield "ARENA_DRAFT_PACK", None, payload
        elif payload.get("GrpIds") is not None and (payload.get("DraftId") is not None or payload.get("draftId") is not None):
            yield "ARENA_DRAFT_PICK", None, payload
        elif isinstance(payload.get("Deck"), dict) and payload.get("EventName") is not None:
            yield "ARENA_DECK_SUBMIT", None, payload
        messages = inside(payload, "greToClientEvent", "greToClientMessages")
        for message in messages if isinstance(messages, list) else []:
            if isinstance(message, dict):
                kind = message.get("type")
                yield SERVED.get(kind, "ARENA_GRE_MESSAGE"), kind, message
                if kind in STATE_KINDS and self.ends(message, kind):
                    yield "ARENA_GAME_OVER", kind, message
        if payload.get("clientToMatchServiceMessageType") in ENVELOPE_KINDS:
            sent = unwrapped(decoded(payload.get("payload")))
            if isinstance(sent, dict):
                yield SENT.get(sent.get("type"), "ARENA_CLIENT_TO_GRE_MESSAGE"), sent.get("type"), sent

    def ends(self, message: dict, kind: str) -> bool:
        state = (message.get("queuedGameStateMessage") if kind == QUEUED else None) or message.get("gameStateMessage")
        return any(inside(state, *p) in END_KINDS for p in END_PLACES)


def log_events(entries: DataFrame, text: str = "text") -> DataFrame:
    """The entries with the EVENT columns of each of their events, by a lateral join; entries without events go."""
    table = F.udtf(LogEvents, returnType=EVENT, useArrow=True)
    return entries.lateralJoin(table(F.col(text).outer()))
