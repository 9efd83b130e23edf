"""The state of running games from full and partial state messages, and prompts that wait for their answers."""

from __future__ import annotations

import json

from ledgerline.workers import carried

carried(__name__)

#: Fixed values of the wire format: fields of an object that are taken as they come, and what they are called here.
OBJECT_FIELDS = {
    "grpId": "card",
    "overlayGrpId": "overlay",
    "controllerSeatId": "controller",
    "ownerSeatId": "owner",
    "type": "type",
    "cardTypes": "types",
    "subtypes": "subtypes",
    "attackState": "attack_state",
    "blockState": "block_state",
    "objectSourceGrpId": "source_card",
    "parentId": "parent",
    "attachedTo": "attached_to",
}
FULL, ID_CHANGED, OVER = "GameStateType_Full", "AnnotationType_ObjectIdChanged", "GameStage_GameOver"
ATTACKING, BLOCKING = "AttackState_Attacking", "BlockState_Blocking"
DETAIL_VALUES = ("valueInt32", "valueString", "valueInt64", "valueUint32", "valueUint64", "valueBool")
TURN = {"turnNumber": "turn", "phase": "phase", "step": "step", "activePlayer": "active", "priorityPlayer": "priority", "decisionPlayer": "decider"}
#: Prompts that may wait in a match.
WAITING = 8


def whole(value) -> int | None:
    """A number, or a number in {"value": ...}, as an integer."""
    if isinstance(value, dict):
        value = value.get("value")
    try:
        return None if value is None or isinstance(value, bool) else int(value)
    except (TypeError, ValueError):
        return None


def details(annotation: dict) -> dict:
    """Key to first value of an annotation's details."""
    out = {}
    for d in annotation.get("details") or []:
        values = next((d[v] for v in DETAIL_VALUES if isinstance(d.get(v), list) and d[v]), None)
        if d.get("key") is not None and values:
            out[d["key"]] = values[0]
    return out


class Records:
    """(kind, id) to record, with what has changed; records of a stored state are read when they are needed."""

    over = False

    def __init__(self, stored: dict[tuple[str, int], str]):
        self.stored, self.now, self.dirty = dict(stored), {}, {}

    def get(self, kind: str, key: int) -> dict | None:
        if (kind, key) not in self.now:
            text = self.stored.get((kind, key))
            self.now[kind, key] = None if text is None else json.loads(text)
        return self.now[kind, key]

    def put(self, kind: str, key: int, record: dict | None) -> None:
        self.now[kind, key] = record
        self.dirty[kind, key] = True

    def of(self, *kinds: str) -> list[tuple[str, int]]:
        return [k for k in {**self.stored, **self.now} if k[0] in kinds and self.get(*k) is not None]

    def keeps(self) -> bool:
        return bool(self.of(*{k for k, _ in {**self.stored, **self.now}}))

    def changes(self) -> dict[tuple[str, int], str | None]:
        return {k: None if self.now[k] is None else text(self.now[k]) for k in self.dirty if self.now[k] is not None or k in self.stored}


def text(record: dict) -> str:
    return json.dumps(record, sort_keys=True, separators=(",", ":"))


class Board(Records):
    """Objects, zones, players and the game (id 0): a full message starts anew, others change what they name; null fields change nothing.

    Seats and names are told by messages of kind "seat" ({"seat": n}) and "names" ({"players": [{"seat", "name"}]}) and stay through full messages.
    ``step`` gives a row for each record that a message names or ends; the record of one that is gone is null.
    """

    def step(self, position: int, kind: str, message: str) -> list[tuple[str, int, str | None]]:
        before, self.dirty = self.dirty, {}
        found = json.loads(message)
        if kind == "seat":
            self.put("game", 0, (self.get("game", 0) or {}) | {"seat": whole(found.get("seat"))})
        elif kind == "names":
            for p in found.get("players") or []:
                if p.get("name"):
                    self.put("player", p["seat"], (self.get("player", p["seat"]) or {}) | {"name": p["name"].split("#")[0]})
        else:
            self.apply(found)
        rows = [(*k, None if self.now[k] is None else text(self.now[k])) for k in self.dirty]
        self.dirty = before | self.dirty
        return rows

    def apply(self, m: dict) -> None:
        game = dict(self.get("game", 0) or {})
        if m.get("type") == FULL:
            for k in self.of("object", "zone"):
                self.put(*k, None)
            for k in self.of("player"):
                name = self.get(*k).get("name")
                self.put(*k, {"name": name} if name else None)
            game = {"seat": game.get("seat")}
        info = m.get("gameInfo") or {}
        game["state_id"] = m.get("gameStateId") or m.get("msgId") or (game.get("state_id") or 0) + 1
        game["game_id"] = info.get("gameId") or game.get("game_id")
        game["over"] = game.get("over", False) or (info.get("stage") or m.get("gameStage")) == OVER
        for key in m.get("diffDeletedInstanceIds") or []:
            if self.get("object", key) is not None:
                self.put("object", key, None)
        for annotation in m.get("annotations") or []:
            if ID_CHANGED in (annotation.get("type") or []):
                told = details(annotation)
                self.renumber(told.get("orig_id"), told.get("new_id"))
        for entry in m.get("gameObjects") or []:
            self.object(entry)
        for entry in m.get("zones") or []:
            self.zone(entry)
        for entry in m.get("players") or []:
            self.player(entry)
        game |= {to: m["turnInfo"][key] for key, to in TURN.items() if (m.get("turnInfo") or {}).get(key) is not None}
        seats = m.get("systemSeatIds") or []
        if seats and isinstance(seats[0], int):
            game["seat"] = seats[0]
        self.over = game["over"]
        self.put("game", 0, game)

    def renumber(self, old: int | None, new: int | None) -> None:
        """An object goes on under another id, with the ids it had; a known card that is there already stays."""
        own = None if not isinstance(old, int) or not isinstance(new, int) or old == new else self.get("object", old)
        if own is None:
            return
        self.put("object", old, None)
        held = self.get("object", new)
        if held is None or not held.get("card"):
            past = own.get("lineage") or [old]
            self.put("object", new, own | {"lineage": past if new in past else [*past, new]})

    def object(self, entry: dict) -> None:
        key = entry.get("instanceId")
        if not isinstance(key, int):
            return
        own = dict(self.get("object", key) or {"tapped": False})
        own |= {to: entry[name] for name, to in OBJECT_FIELDS.items() if entry.get(name) is not None}
        own |= {to: bool(entry[name]) for name, to in (("isTapped", "tapped"), ("isFaceDown", "face_down")) if entry.get(name) is not None}
        own |= {name: whole(entry[name]) for name in ("power", "toughness", "damage") if entry.get(name) is not None}
        if entry.get("counters") is not None:
            own["counters"] = {}
            for c in entry["counters"]:
                kind = c.get("type") or c.get("counterType")
                if kind is not None:
                    own["counters"][str(kind)] = own["counters"].get(str(kind), 0) + (whole(c.get("count")) or 0)
        self.put("object", key, own)

    def zone(self, entry: dict) -> None:
        key = entry.get("zoneId")
        if not isinstance(key, int):
            return
        own = dict(self.get("zone", key) or {"objects": []})
        own |= {to: entry[name] for name, to in (("type", "type"), ("ownerSeatId", "owner"), ("visibility", "visibility"), ("objectCount", "count")) if entry.get(name) is not None}
        if entry.get("objectInstanceIds") is not None:
            own["objects"] = [i for i in entry["objectInstanceIds"] if isinstance(i, int)]
        own["name"] = (own.get("type") or "UNKNOWN").removeprefix("ZoneType_").upper()
        self.put("zone", key, own)

    def player(self, entry: dict) -> None:
        key = entry.get("systemSeatNumber") or entry.get("systemSeatId")
        if not isinstance(key, int):
            return
        own = dict(self.get("player", key) or {})
        life, first = whole(entry.get("lifeTotal")), whole(entry.get("startingLifeTotal"))
        if life is not None:
            own["life"] = life
        elif first is not None:
            own.setdefault("life", first)
        self.put("player", key, own)


class Pending(Records):
    """Prompts that wait: at most WAITING, the oldest goes; an answer takes the oldest of its number; a new game clears all.

    Messages: kind "prompt" or "answer" with {"id": n}, "game" (a new game or connection), "over" (its end).  ``step`` gives
    a row for each answer that finds its prompt: id is the prompt's position.  Nothing is kept after an end.
    """

    def step(self, position: int, kind: str, message: str) -> list[tuple[str, int, str | None]]:
        waiting = sorted(self.of("prompt"))
        if kind in ("game", "over"):
            for k in waiting:
                self.put(*k, None)
        elif kind == "prompt":
            self.put("prompt", int(position), {"id": json.loads(message).get("id")})
            for k in waiting[: max(0, len(waiting) + 1 - WAITING)]:
                self.put(*k, None)
        elif kind == "answer":
            number = json.loads(message).get("id")
            found = next((k for k in waiting if number is not None and self.get(*k)["id"] == number), None)
            if found:
                self.put(*found, None)
                return [("answer", found[1], text({"id": number}))]
        return []
