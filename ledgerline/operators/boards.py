"""Board states: one typed form of heterogeneous JSON states, views of it, factors and feature rows.

A raw state is a VARIANT.  ``canonical`` gives struct(match_id, game_id, sequence, perspective, turn_number,
active_seat, priority_seat, phase, step, players, objects); seats are texts.  All that follows
works on that struct with higher-order functions; nothing is exploded unless rows are the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions import open_json as J
from ledgerline.functions import text as T
from ledgerline.operators.features import hash_embedding
from ledgerline.operators.log_events import at, first_at, is_kind, let

#: Other names of zones.
ZONES = {"hands": "hand", "libraries": "library", "graveyards": "graveyard", "sideboards": "sideboard"}
#: Fixed order of the zones of a feature row.
ROW_ZONES = ("global", "player", "battlefield", "stack", "hand", "graveyard", "exile", "library", "command", "sideboard", "history", "other")
#: Fixed order of strategic factors.
FACTORS = (
    "life_total",
    "life_diff",
    "hand_count",
    "hand_diff",
    "library_count",
    "library_diff",
    "graveyard_count",
    "graveyard_diff",
    "battlefield_count",
    "battlefield_diff",
    "creature_count",
    "creature_diff",
    "land_count",
    "land_diff",
    "stack_count",
    "turn_number",
    "is_active_player",
    "has_priority",
)
#: Fields of a player and of an object, with their types.
PLAYER = {"seat": "string", "name": "string", "life": "bigint", "poison": "bigint", "energy": "bigint", "hand_count": "bigint", "library_count": "bigint", "graveyard_count": "bigint"}
OBJECT = {
    "object_key": "string",
    "name": "string",
    "controller": "string",
    "owner": "string",
    "zone": "string",
    "tapped": "boolean",
    "power": "bigint",
    "toughness": "bigint",
    "damage": "bigint",
    "counters": "map<string, bigint>",
    "types": "array<string>",
    "face_down": "boolean",
    "revealed": "boolean",
    "token": "boolean",
    "attached_to": "string",
    "attacking": "boolean",
    "blocking": "boolean",
    "summoning_sick": "boolean",
    "damage_marked": "bigint",
    "mana_value": "bigint",
    "loyalty": "bigint",
    "placeholder": "boolean",
}
#: Fields of a state besides its players and objects.
SCALARS = {"match_id": "string", "game_id": "string", "sequence": "bigint", "perspective": "string", "turn_number": "bigint", "active_seat": "string", "priority_seat": "string", "phase": "string", "step": "string"}
OBJECTS, PLAYERS = (f"array<struct<{', '.join(f'{k}: {v}' for k, v in x.items())}>>" for x in (OBJECT, PLAYER))


def flag(value: Column) -> Column:
    """true, false or null of a boolean, a number or a word."""

    def of(v: Column) -> Column:
        text = F.lower(F.trim(F.try_variant_get(v, "$", "string")))
        number = F.try_variant_get(v, "$", "double")
        said = F.when(is_kind(v, "BOOLEAN"), F.try_variant_get(v, "$", "boolean")).when(text.isin("true", "yes", "1", "tapped"), True).when(text.isin("false", "no", "0", "untapped"), False)
        return F.when(v.isNotNull(), said.when(~is_kind(v, "STRING") & number.isNotNull(), number != 0))

    return let(value, of)


def whole(value: Column, *paths: str) -> Column:
    """The first whole number at the paths; booleans are none."""
    return F.coalesce(*(_number(at(value, p, "variant")) for p in paths))


def _number(value: Column) -> Column:
    return F.when(value.isNotNull() & ~is_kind(value, "BOOLEAN"), F.try_variant_get(value, "$", "bigint"))


def _list(value: Column, path: str | None = None) -> Column:
    return F.coalesce(F.try_variant_get(value, f"$.{path}" if path else "$", "array<variant>"), F.array().cast("array<variant>"))


def _object(value: Column, zone: Column, seat: Column, revealed: bool = False) -> Column:
    """An object by its fields, which are taken apart once, since most of the names asked for are not there."""
    return let(F.try_variant_get(value, "$", "map<string, variant>"), lambda held: _described(value, held, zone, seat, revealed))


def _described(value: Column, held: Column, zone: Column, seat: Column, revealed: bool) -> Column:
    get = lambda k: F.try_element_at(held, F.lit(k))
    own = lambda k, kind="string": F.try_variant_get(get(k), "$", kind)
    first = lambda *keys: F.coalesce(*map(own, keys))
    down = F.coalesce(flag(get("faceDown")), flag(get("face_down")), flag(get("hidden")), F.lit(False))
    shown = F.coalesce(flag(get("revealed")), F.lit(False))
    name = F.when(held.isNotNull(), F.coalesce(own("name"), at(get("ref"), "name"), own("cardName"))).otherwise(F.try_variant_get(value, "$", "string"))
    listed = F.filter(F.transform(_list(get("counters")), lambda c: F.struct(first_at(c, ("name", "type")).alias("key"), whole(c, "count").alias("value"))), lambda c: c["key"].isNotNull() & c["value"].isNotNull())
    counters = F.coalesce(F.when(is_kind(get("counters"), "ARRAY"), F.map_from_entries(listed)).otherwise(own("counters", "map<string, bigint>")), F.create_map().cast("map<string, bigint>"))
    types = F.coalesce(own("types", "array<string>"), own("cardTypeNames", "array<string>"), F.array().cast("array<string>"))
    fields = {
        "object_key": first("objectKey", "object_key", "instanceId", "objectId", "id"),
        "name": F.when(~down | shown, name),
        "controller": F.coalesce(first("controller", "controllerId", "controllerSeat"), seat),
        "owner": F.coalesce(first("owner", "ownerId", "ownerSeat"), seat),
        "zone": zone,
        "tapped": flag(get("tapped")),
        "power": _number(get("power")),
        "toughness": _number(get("toughness")),
        "damage": _number(get("damage")),
        "counters": counters,
        "types": types,
        "face_down": down,
        "revealed": F.lit(revealed) | shown | F.coalesce(flag(get("known")), F.lit(False)),
        "token": F.coalesce(flag(get("token")), flag(get("isToken"))),
        "attached_to": first("attachedTo", "attached_to"),
        "attacking": flag(get("attacking")),
        "blocking": flag(get("blocking")),
        "summoning_sick": flag(get("summoningSick")),
        "damage_marked": _number(get("damageMarked")),
        "mana_value": _number(get("manaValue")),
        "loyalty": _number(get("loyalty")),
        "placeholder": F.lit(False),
    }
    return F.struct(*(v.alias(k) for k, v in fields.items()))


def _placeholder(zone: Column, seat: Column, i: Column) -> Column:
    key = F.concat(F.lit("count:"), zone, F.lit(":"), seat, F.lit(":"), i)
    fields = {"object_key": key, "controller": seat, "owner": seat, "zone": zone, "face_down": F.lit(True), "revealed": F.lit(False), "counters": F.create_map().cast("map<string, bigint>"), "types": F.array().cast("array<string>"), "placeholder": F.lit(True)}
    return F.struct(*(fields.get(k, F.lit(None)).cast(kind).alias(k) for k, kind in OBJECT.items()))


def _zone_objects(zone: Column, payload: Column) -> Column:
    """Objects of a zone: a list, or lists and counts by seat; a count stands for so many face-down objects."""
    by_seat = F.map_entries(F.coalesce(F.try_variant_get(payload, "$", "map<string, variant>"), F.create_map().cast("map<string, variant>")))
    none = F.array().cast(OBJECTS)

    def of_seat(e: Column) -> Column:
        n = F.when(~is_kind(e["value"], "ARRAY") & ~is_kind(e["value"], "BOOLEAN"), F.try_variant_get(e["value"], "$", "bigint"))
        made = F.when(n > 0, F.transform(F.sequence(F.lit(0).cast("bigint"), n - 1), lambda i: _placeholder(zone, e["key"], i))).otherwise(none)
        return F.when(is_kind(e["value"], "ARRAY"), F.transform(_list(e["value"]), lambda o: _object(o, zone, e["key"])).cast(OBJECTS)).otherwise(made.cast(OBJECTS))

    listed = F.transform(_list(payload), lambda o: _object(o, zone, F.lit(None).cast("string"))).cast(OBJECTS)
    return F.when(is_kind(payload, "ARRAY"), listed).otherwise(F.flatten(F.transform(by_seat, of_seat)))


def inner_state(wrapped: Column) -> Column:
    """The state inside a record or a wrapper, else the value itself."""
    return F.coalesce(*(F.when(is_kind(at(wrapped, p, "variant"), "OBJECT"), at(wrapped, p, "variant")) for p in ("observation.current", "current", "state", "gameState")), wrapped)


def canonical(raw: Column) -> Column:
    """The typed state of a raw one."""

    def of(wrapped: Column, state: Column) -> Column:
        players = F.transform(
            _list(state, "players"),
            lambda p, i: F.struct(
                F.coalesce(first_at(p, ("seat", "playerIndex", "playerId")), i.cast("string")).alias("seat"),
                at(p, "name").alias("name"),
                *(whole(p, k).alias(k) for k in ("life", "poison", "energy")),
                *(F.coalesce(whole(p, f"{k}Count"), F.when(is_kind(at(p, k, "variant"), "ARRAY"), F.size(_list(p, k)).cast("bigint"))).alias(f"{k}_count") for k in ("hand", "library", "graveyard")),
            ),
        ).cast(PLAYERS)
        alias = F.create_map(*(F.lit(x) for pair in ZONES.items() for x in pair))
        named = F.map_entries(F.coalesce(at(state, "zones", "map<string, variant>"), F.create_map().cast("map<string, variant>")))
        zoned = F.flatten(F.transform(named, lambda e: let(F.coalesce(F.try_element_at(alias, e["key"]), F.lower(e["key"])), lambda zone: _zone_objects(zone, e["value"]))))
        direct = [F.coalesce(_zone_objects(F.lit(z), at(state, z, "variant")), F.array().cast(OBJECTS)) for z in ("battlefield", "stack", "exile", "command", "sideboard")]
        held = F.flatten(
            F.transform(
                _list(state, "players"),
                lambda p, i: let(
                    F.coalesce(first_at(p, ("seat", "playerIndex", "playerId")), i.cast("string")),
                    lambda seat: F.concat(*(F.transform(_list(p, k), lambda o: _object(o, F.lit("hand" if k == "revealedHand" else k), seat, k == "revealedHand")).cast(OBJECTS) for k in ("hand", "library", "graveyard", "exile", "revealedHand"))),  # noqa: B023
                ),
            )
        )
        either = lambda *paths: F.coalesce(first_at(wrapped, paths), first_at(state, paths))
        fields = {
            "match_id": either("matchId"),
            "game_id": F.coalesce(either("gameId"), at(state, "gameInstance")),
            "sequence": F.coalesce(whole(wrapped, "sequenceNumber", "sequence"), whole(state, "seq", "sequence")),
            "perspective": F.coalesce(at(wrapped, "perspectiveSeat"), first_at(state, ("localSeat", "perspectiveSeat"))),
            "turn_number": whole(state, "turnNumber", "turn"),
            "active_seat": first_at(state, ("activeSeat", "activePlayerId", "activePlayer")),
            "priority_seat": first_at(state, ("prioritySeat", "priorityPlayerId", "priorityPlayer")),
            "phase": at(state, "phase"),
            "step": at(state, "step"),
            "players": players,
            "objects": F.concat(zoned, *direct, held),
        }
        return F.struct(*(v.alias(k) for k, v in fields.items()))

    return let(raw, lambda w: let(inner_state(w), lambda s: of(w, s)))


def model_view(state: Column) -> Column:
    """A canonical state as the observation text that models read: objects by zone, of private zones by seat; fields that are null are left out."""
    of = lambda *zones: F.filter(state["objects"], lambda o: o["zone"].isin(*zones))

    def by_seat(zone: str) -> Column:
        own = of(zone)
        seats = F.array_sort(F.array_distinct(F.transform(own, lambda o: F.coalesce(o["controller"], o["owner"], F.lit("unknown")))))
        return F.map_from_entries(F.transform(seats, lambda s: F.struct(s.alias("key"), F.filter(own, lambda o: F.coalesce(o["controller"], o["owner"], F.lit("unknown")) == s).alias("value"))))

    zones = F.struct(*(of(z).alias(z) for z in ("battlefield", "stack", "exile", "command")), by_seat("hand").alias("hands"), by_seat("library").alias("libraries"), by_seat("graveyard").alias("graveyards"), by_seat("sideboard").alias("sideboards"))
    current = F.struct(
        state["match_id"].alias("matchId"), state["game_id"].alias("gameInstance"), state["sequence"].alias("seq"), state["turn_number"].alias("turnNumber"), state["phase"].alias("phase"), state["step"].alias("step"),
        state["active_seat"].alias("activeSeat"), state["priority_seat"].alias("prioritySeat"), state["perspective"].alias("localSeat"), state["players"].alias("players"), zones.alias("zones"),
    )
    return F.to_json(F.struct(F.struct(current.alias("current")).alias("observation")))


def _player(state: Column, seat: Column, same: bool = True) -> Column:
    return F.get(F.filter(state["players"], lambda p: (p["seat"] == seat) if same else ~p["seat"].eqNullSafe(seat)), F.lit(0))


def _controlled(state: Column, seat: Column, kind: str | None = None) -> Column:
    """Objects of the battlefield that a seat controls; null without a seat."""
    typed = lambda o: F.exists(o["types"], lambda t: F.upper(t) == kind) if kind else F.lit(True)
    own = F.filter(state["objects"], lambda o: (o["zone"] == "battlefield") & (o["controller"] == seat) & typed(o))
    return F.when(seat.isNotNull(), F.size(own).cast("bigint"))


def factors(state: Column, seat: Column) -> Column:
    """The strategic factors of a seat, null where something is not known."""

    def of(me: Column, other: Column) -> Column:
        graves = lambda p: F.coalesce(F.nullif(F.size(F.filter(state["objects"], lambda o: (o["zone"] == "graveyard") & (o["owner"] == p["seat"]))).cast("bigint"), F.lit(0).cast("bigint")), p["graveyard_count"])
        pairs = {"life": (me["life"], other["life"]), "hand": (me["hand_count"], other["hand_count"]), "library": (me["library_count"], other["library_count"]), "graveyard": (graves(me), graves(other))}
        for name, kind in (("battlefield", None), ("creature", "CREATURE"), ("land", "LAND")):
            pairs[name] = (_controlled(state, me["seat"], kind), _controlled(state, other["seat"], kind))
        out = {}
        for name, (mine, theirs) in pairs.items():
            out["life_total" if name == "life" else f"{name}_count"] = mine
            out[f"{name}_diff"] = mine - theirs
        out["stack_count"] = F.size(F.filter(state["objects"], lambda o: o["zone"] == "stack")).cast("bigint")
        out["turn_number"] = state["turn_number"]
        out["is_active_player"] = F.coalesce((me["seat"] == state["active_seat"]).cast("bigint"), F.lit(0).cast("bigint"))
        out["has_priority"] = F.coalesce((me["seat"] == state["priority_seat"]).cast("bigint"), F.lit(0).cast("bigint"))
        return F.struct(*(out[k].alias(k) for k in FACTORS))

    return let(_player(state, seat), lambda me: let(_player(state, seat, same=False), lambda other: of(me, other)))


def causal_parts(state: Column) -> Column:
    """What ``causal_deltas`` reads of a state, small enough to be moved."""
    return F.struct(state["players"].alias("players"), F.transform(state["objects"], lambda o: F.struct(*(o[k].alias(k) for k in ("zone", "power", "toughness", "tapped")))).alias("objects"), state["turn_number"].alias("turn_number"))


def causal_deltas(before: Column, after: Column, seat: Column, terminal: Column) -> Column:
    """Eighteen squashed changes: own player, opponents, zones, turn, end, power, toughness, tapped."""
    zero = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    mine = lambda field, scale: T.delta(zero(_player(before, seat)[field]), zero(_player(after, seat)[field]), scale)
    others = F.filter(before["players"], lambda p: p["seat"] != seat)
    total = lambda state, field: F.aggregate(others, F.lit(0.0), lambda a, p: a + zero(_player(state, p["seat"])[field]))
    theirs = lambda field, scale: F.when(F.size(others) > 0, F.tanh((total(after, field) - total(before, field)) / (scale * F.size(others)))).otherwise(0.0)
    scales = (("life", 20), ("hand_count", 7), ("library_count", 10), ("graveyard_count", 10))
    zone = lambda state, z: F.size(F.filter(state["objects"], lambda o: o["zone"] == z)).cast("double")
    field = lambda state: F.filter(state["objects"], lambda o: o["zone"] == "battlefield")
    summed = lambda state, of: F.aggregate(field(state), F.lit(0.0), lambda a, o: a + zero(of(o)))
    parts = [mine(*x) for x in scales] + [theirs(*x) for x in scales]
    parts += [T.delta(zone(before, z), zone(after, z), 10) for z in ("battlefield", "stack", "graveyard", "exile")]
    parts += [T.delta(zero(before["turn_number"]), zero(after["turn_number"]), 3), F.coalesce(terminal, F.lit(False)).cast("double")]
    parts += [T.delta(summed(before, of), summed(after, of), 20) for of in (lambda o: o["power"], lambda o: o["toughness"], lambda o: o["tapped"].cast("int"))]
    return F.array(*parts, F.lit(0.0))


def numeric_row(zone: Column, seat: Column, view: Column, flags: list[Column], values: list[Column]) -> Column:
    """A row's numbers: there, global, player, zone, relation of seat and view, flags, squashed values."""
    one = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    known = F.when(zone.isin(*ROW_ZONES), zone).otherwise("other")
    relation = F.when(seat.isNull() | view.isNull(), 2).when(seat == view, 0).otherwise(1)
    return F.array(F.lit(1.0), one(zone == "global"), one(zone == "player"), *(one(known == z) for z in ROW_ZONES), *(one(relation == k) for k in range(3)), *map(one, flags), *values)


#: Flags of a row, and its values with their scales, in order (fixed values).
ROW_FLAGS = ("tapped", "attacking", "blocking", "token", "face_down", "summoning_sick")
ROW_SCALES = {"power": 20, "toughness": 20, "damage": 20, "damage_marked": 20, "mana_value": 12, "life": 40, "hand_count": 10, "library_count": 60, "graveyard_count": 30, "poison": 10, "energy": 20, "loyalty": 12}
COUNTS = ("life", "hand_count", "library_count", "graveyard_count", "poison", "energy")
#: Events of a state's history that are shown, the last ones.
RECENT = 32


def object_numbers(zone: Column, seat: Column, view: Column, has: dict[str, Column]) -> Column:
    """The numbers of a row from its flags and values by name; what is not there is 0."""
    flags = [F.coalesce(has.get(k, F.lit(False)), F.lit(False)) for k in ROW_FLAGS]
    values = [T.norm(F.coalesce(has[k].cast("double"), F.lit(0.0)), scale) if k in has else F.lit(0.0) for k, scale in ROW_SCALES.items()]
    return numeric_row(zone, seat, view, flags, values)


def state_rows(states: DataFrame, keys: list[str], state: str = "state", history: str | None = None, most: int = 128) -> DataFrame:
    """keys, row, zone, text, numbers: a state's rows, global first, then players, objects and the last events of its history; at most ``most`` of them (the feature's own size).

    An object in another seat's hand, and one in a library that is not revealed, is 'unknown hidden card'.  History (an array of
    JSON texts) is told as its flattened events; the last has recency 0, the one before it -1.
    """
    s = F.col(state)
    view = s["perspective"]
    said = lambda head, parts: F.concat_ws(" | ", F.lit(head), *(F.when(c.isNotNull(), F.concat(F.lit(f"{n}="), c.cast("string"))) for n, c in parts.items()))
    none, event = F.lit(None).cast("string"), F.lit(None).cast("string")
    make = lambda zone, text, numbers, event=event: F.struct(zone.alias("zone"), text.alias("text"), numbers.alias("numbers"), event.alias("event"))
    top = make(F.lit("global"), said("global", {"activeSeat": s["active_seat"], "phase": s["phase"], "prioritySeat": s["priority_seat"], "step": s["step"], "turnNumber": s["turn_number"]}), object_numbers(F.lit("global"), none, view, {}))
    players = F.transform(s["players"], lambda p: make(F.lit("player"), said("player", {k: p[k] for k in sorted(("name", "seat", *COUNTS))}), object_numbers(F.lit("player"), p["seat"], view, {k: p[k] for k in COUNTS})))

    def of(o: Column) -> Column:
        seat = F.coalesce(o["controller"], o["owner"])
        hidden = ((o["zone"] == "hand") & (seat != view)) | ((o["zone"] == "library") & ~o["revealed"])
        card = said("card", {"name": o["name"], "power": o["power"], "toughness": o["toughness"], "types": F.when(F.size(o["types"]) > 0, F.array_join(o["types"], " "))})
        has = {k: o[k] for k in (*ROW_FLAGS, *ROW_SCALES) if k in OBJECT}
        return make(o["zone"], F.when(F.coalesce(hidden, F.lit(False)), "unknown hidden card").otherwise(card), object_numbers(o["zone"], seat, view, has))

    shown = F.filter(s["objects"], lambda o: ~o["placeholder"])
    parts = [F.array(top), players, F.transform(shown, of)]
    if history:
        events = F.coalesce(F.col(history), F.array().cast("array<string>"))
        recent = F.slice(events, F.greatest(F.lit(1), F.size(events) - RECENT + 1), RECENT)
        recency = lambda e, i: F.regexp_replace(e, r"\}\s*$", F.concat(F.when(e.rlike(r"^\s*\{\s*\}\s*$"), "").otherwise(","), F.lit('"historyRecency":'), (i - F.size(recent) + 1).cast("string"), F.lit("}")))
        parts.append(F.transform(recent, lambda e, i: make(F.lit("history"), none, object_numbers(F.lit("history"), none, view, {}), F.when(e.rlike(r"^\s*\{"), recency(e, i)).otherwise(F.concat(F.lit('{"event":'), e, F.lit(',"historyRecency":'), (i - F.size(recent) + 1).cast("string"), F.lit("}"))))))
    rows = states.select(*keys, F.posexplode(F.slice(F.concat(*parts), 1, most)).alias("row", "r")).select(*keys, "row", "r.*")
    if history:
        rows = rows.withColumn("text", F.when(F.col("event").isNotNull(), F.concat(F.lit("public history | "), J.flatten_text(F.col("event")))).otherwise(F.col("text")))
    return rows.drop("event")


#: Amounts of an option's payload, in order (fixed values).
AMOUNTS = ("amount", "x", "value", "manaValue", "power", "toughness")


def option_vectors(options: DataFrame, prompt: str, index: str, option: str, card: str | None = None) -> DataFrame:
    """The frame with text ('prompt=.. | ..', the flattened option, and its card's) and numbers (there, squashed index and amounts of its payload).

    Option and card are JSON texts; a card that is not known is null.
    """
    amount = lambda k: T.norm(F.coalesce(F.try_variant_get(F.try_parse_json(option), f"$.payload.{k}", "double"), F.lit(0.0)), 20.0)
    said = F.concat(F.lit("prompt="), F.coalesce(F.nullif(F.col(prompt), F.lit("")), F.lit("unknown")), F.lit(" | "), J.flatten_text(F.coalesce(option, F.lit("{}"))))
    if card:
        said = F.concat(said, F.coalesce(F.concat(F.lit(" | card semantics="), J.flatten_text(F.col(card))), F.lit("")))
    place = T.norm(F.coalesce(F.col(index).cast("double"), F.lit(0.0)), 32.0)
    return options.withColumns({"text": said, "numbers": F.array(F.lit(1.0), place, *map(amount, AMOUNTS))})


def with_text_vectors(rows: DataFrame, dim: int = 384) -> DataFrame:
    """Rows with text and numbers and their vector: the text's embedding (each text's once) before the numbers."""
    return hash_embedding(rows, "text", dim).withColumn("vector", F.concat("vector", "numbers"))


def padded(df: DataFrame, rows: str, size: int, width: int) -> DataFrame:
    """``rows`` (array of number arrays) brought to ``size`` rows of zeros at the end, and mask (true for rows that were there)."""
    zero = F.array_repeat(F.lit(0.0), width)
    held = df.withColumn("held_", F.least(F.size(rows), F.lit(size)))
    out = held.withColumn("mask", F.transform(F.sequence(F.lit(1), F.lit(size)), lambda i: i <= F.col("held_")))
    return out.withColumn(rows, F.concat(F.slice(rows, 1, size), F.array_repeat(zero, F.lit(size) - F.col("held_")))).drop("held_")


#: Fixed order of selection modes and of colours.
MODES, COLORS = ("draftPick", "deckBuild", "sideboard"), ("W", "U", "B", "R", "G")


def card_numbers(role: Column, mode: Column, pack: Column, pick: Column, context: Column, candidates: Column, copies: Column, card: dict[str, Column]) -> Column:
    """Numbers of a candidate or context card: role, mode, place in the draft, copies, colours, types, mana value, power and toughness (24)."""
    one = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    squash = lambda c, scale: F.tanh(F.coalesce(c.cast("double"), F.lit(0.0)) / scale)
    is_card = role != "status"
    own = lambda c: F.when(is_card, c).otherwise(0.0)
    colors = F.upper(F.coalesce(card["colors"], F.lit("")))
    held = [F.contains(colors, F.lit(x)) for x in COLORS]
    several = sum((h.cast("int") for h in held[1:]), held[0].cast("int")) > 1
    has = lambda t: F.exists(card["types"], lambda x: F.lower(x) == t)
    return F.array(
        F.lit(1.0), *(one(role == r) for r in ("status", "context", "candidate")), *(one(mode == m) for m in MODES), squash(pack, 3.0), squash(pick, 15.0), squash(context, 45.0), squash(candidates, 15.0), own(squash(copies, 4.0)),
        *(own(one(h)) for h in held), own(one(has("creature"))), own(one(has("land"))), own(squash(card["mana_value"], 10.0)), own(squash(card["power"], 10.0)), own(squash(card["toughness"], 10.0)), own(one(several)), F.lit(0.0),
    )


def selection_rows(examples: DataFrame, cards: DataFrame, keys: list[str], most: int = 80) -> DataFrame:
    """keys, role, place, card, numbers: a status row, at most ``most`` context cards (the feature's own size) and every candidate of each example.

    Examples have mode, pack, pick, context and candidates (arrays of card ids); cards have card, colors, types, mana_value, power, toughness.
    An example without candidates, or of another mode, is an error.
    """
    bad = (F.size("candidates") == 0) | ~F.col("mode").isin(*MODES)
    checked = examples.withColumn("mode", F.when(bad, F.raise_error(F.lit("no selection example"))).otherwise(F.col("mode")))
    item = lambda role, place, card: F.struct(F.lit(role).alias("role"), place.alias("place"), card.cast("bigint").alias("card"))
    rows = F.concat(F.array(item("status", F.lit(0), F.lit(None))), F.transform(F.slice("context", 1, most), lambda c, i: item("context", i, c)), F.transform("candidates", lambda c, i: item("candidate", i, c)))
    flat = checked.select(*keys, "mode", "pack", "pick", F.size("context").alias("n_context"), F.size("candidates").alias("n_candidates"), "context", F.explode(rows).alias("r")).select("*", "r.*")
    flat = flat.withColumn("copies", F.size(F.filter("context", lambda c: c == F.col("card"))))
    known = flat.join(cards, "card", "left")
    card = {k: F.col(k) for k in ("colors", "types", "mana_value", "power", "toughness")}
    return known.select(*keys, "role", "place", "card", card_numbers(F.col("role"), F.col("mode"), F.col("pack"), F.col("pick"), F.col("n_context"), F.col("n_candidates"), F.col("copies"), card).alias("numbers"))


def lineage(changes: DataFrame, keys: list[str], order: str, objects: DataFrame | None = None, attributes: tuple[str, ...] = ()) -> DataFrame:
    """keys, order, object, root, lineage and attributes of what each change (keys, order, old, new) renumbers: its first id, its ids in order (each once), and what was said of it.

    A change follows the last one before it that gave its old id, unless another has taken that id away since.  Pointers
    lead back in time only, so ids that go round end like any others.  They double every round, so the rounds are the
    logarithm of the longest chain.  Of changes at one time those of smaller ids come first; old = new changes nothing.
    An attribute is its last non-null value in the descriptions (keys, order, object, attributes) of the ids in turn; what
    is said of an id at the time of a change is said of what has the id then.
    """
    at = F.struct(F.col(order).alias("at"), F.col("old").alias("old"), F.col("new").alias("new"))
    moves = changes.where("old <> new").select(*keys, at.alias("me")).distinct()
    ends = F.array(F.struct(F.col("me.old").alias("object"), F.lit(False).alias("comes")), F.struct(F.col("me.new").alias("object"), F.lit(True).alias("comes")))
    stream = moves.select(*keys, F.col("me.at").alias("time"), "me", F.explode(ends).alias("t")).select(*keys, "time", "me", "t.*")
    if objects is not None:
        stream = stream.unionByName(objects.select(*keys, F.col(order).alias("time"), "object", *attributes), allowMissingColumns=True)
    w = Window.partitionBy(*keys, "object").orderBy("time", F.col("me").isNull(), "me")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    spans = stream.withColumns({"span": F.count("me").over(before), "last": F.last(F.when(F.col("me").isNotNull(), F.struct("me", "comes")), True).over(before)})
    said = Window.partitionBy(*keys, "object", "span").orderBy("time", F.col("me").isNull(), "me")
    spans = spans.withColumns({c: F.last(c, True).over(said) for c in attributes}).where("not comes")
    up = F.when(F.col("last.comes"), F.col("last.me"))
    path = F.when(up.isNull(), F.array("me.old", "me.new")).otherwise(F.array("me.new"))
    chains = spans.select(*keys, "me", up.alias("up"), path.alias("path"), *attributes).checkpoint()
    while not chains.where("up is not null").isEmpty():
        above = chains.select(*keys, F.col("me").alias("up"), F.col("up").alias("further"), F.col("path").alias("ahead"), *(F.col(c).alias(f"{c}_up") for c in attributes))
        far = chains.where("up is not null").join(above, [*keys, "up"])
        far = far.select(*keys, "me", F.col("further").alias("up"), F.concat("ahead", "path").alias("path"), *(F.coalesce(c, f"{c}_up").alias(c) for c in attributes))
        chains = chains.where("up is null").unionByName(far).checkpoint()
    return chains.select(*keys, F.col("me.at").alias(order), F.col("me.new").alias("object"), F.col("path")[0].alias("root"), F.array_distinct("path").alias("lineage"), *attributes)


def stamped_targets(options: DataFrame, objects: DataFrame, keys: list[str]) -> DataFrame:
    """Options (keys, target) with canonical_key of the object (keys, object, card, controller, tapped, power, toughness, face_down, attached_to) that they target.

    Objects of one key are alike to every effect: same card, controller, numbers and attachments.  A face-down or unknown object has none.
    """
    worn = objects.where("attached_to is not null").groupBy(*keys, F.col("attached_to").alias("object")).agg(F.array_sort(F.collect_list(F.coalesce(F.col("card").cast("string"), F.lit("?")))).alias("attachments"))
    fields = ["card", "controller", "tapped", "power", "toughness"]
    key = F.to_json(F.struct(*fields, F.coalesce("attachments", F.array().cast("array<string>")).alias("attachments")), {"ignoreNullFields": "false"})
    known = objects.where("card is not null and not coalesce(face_down, false)").join(worn, [*keys, "object"], "left").select(*keys, F.col("object").alias("target"), key.alias("canonical_key"))
    return options.join(known, [*keys, "target"], "left")


def new_lines(windows: DataFrame, keys: list[str], order: str, lines: str = "lines") -> DataFrame:
    """The frame with fresh: what a scrolled window shows after the longest end of the window before that it begins with; case and spaces don't count."""
    plain = F.transform(lines, lambda x: F.lower(F.trim(F.regexp_replace(x, r"\s+", " "))))
    rows = windows.withColumn("plain_", plain)
    rows = rows.withColumn("before_", F.coalesce(F.lag("plain_").over(Window.partitionBy(*keys).orderBy(order)), F.array().cast("array<string>")))
    least = F.least(F.size("before_"), F.size("plain_"))
    sizes = F.filter(F.sequence(least, F.lit(0), F.lit(-1)), lambda k: (k == 0) | (F.slice("before_", F.size("before_") - k + 1, k) == F.slice("plain_", 1, k)))
    return rows.withColumn("fresh", F.slice(lines, sizes[0] + 1, F.greatest(F.size(lines), F.lit(1)))).drop("plain_", "before_")


def lines_of_spans(spans: DataFrame, keys: list[str]) -> DataFrame:
    """keys, line, text, confidence of word boxes (text, confidence, x, y, height): words within max(8, 0.6 heights) of a line's running baseline belong to it.

    The baseline moves with every word (the mean of itself and the word's top), so a frame's words are folded in order.
    """
    words = F.sort_array(F.collect_list(F.struct("y", "x", "text", "confidence", "height")))
    start = F.struct(F.lit(None).cast("double").alias("base"), F.lit(-1).alias("line"), F.array().cast("array<int>").alias("lines"))

    def step(acc: Column, w: Column) -> Column:
        same = F.coalesce(F.abs(w["y"] - acc["base"]) <= F.greatest(F.lit(8.0), w["height"] * 0.6), F.lit(False))
        line = F.when(same, acc["line"]).otherwise(acc["line"] + 1)
        return F.struct(F.when(same, (acc["base"] + w["y"]) / 2).otherwise(w["y"].cast("double")).alias("base"), line.alias("line"), F.concat(acc["lines"], F.array(line)).alias("lines"))

    framed = spans.groupBy(*keys).agg(words.alias("w")).withColumn("n", F.aggregate("w", start, step)["lines"])
    flat = framed.select(*keys, F.explode(F.arrays_zip("w", "n")).alias("z")).select(*keys, F.col("z.n").alias("line"), "z.w.*")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x", "y", "text"))), lambda r: r["text"]), " ")
    return flat.groupBy(*keys, "line").agg(F.trim(text).alias("text"), F.avg("confidence").alias("confidence"))


def title_candidates(spans: Column) -> Column:
    """Distinct cleaned titles (text, confidence) of spans (text, confidence), and last of all of them joined with their mean confidence."""
    cleaned = F.filter(F.transform(spans, lambda s: F.struct(T.clean_title(s["text"]).alias("text"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), s["confidence"])).alias("confidence"))), lambda s: s["text"] != "")
    mean = F.aggregate(cleaned, F.lit(0.0), lambda a, s: a + s["confidence"]) / F.size(cleaned)
    whole_ = F.struct(T.clean_title(F.array_join(F.transform(cleaned, lambda s: s["text"]), " ")).alias("text"), mean.alias("confidence"))
    every = F.when(F.size(cleaned) > 0, F.concat(cleaned, F.array(whole_))).otherwise(cleaned)

    def distinct(rows: Column) -> Column:
        names = F.transform(rows, lambda s: F.lower(s["text"]))
        return F.filter(rows, lambda s, i: (s["text"] != "") & (F.array_position(names, F.lower(s["text"])) == i + 1))

    return let(every, lambda rows: distinct(rows))
