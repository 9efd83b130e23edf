"""Matches as a whole: who played whom, with what colours, in which event, and who won; checks of what moved; timelines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.names import event_name, guild_name
from ledgerline.operators.sequences import broken_chains

MATCH = ["session", "match"]


def _letters(bits: Column) -> Column:
    return F.concat(*(F.when(bits.bitwiseAND(F.lit(1 << i)) != 0, c).otherwise("") for i, c in enumerate("WUBRG")))


def _bits(colors: Column) -> Column:
    return sum((F.when(F.contains(colors, F.lit(c)), F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate("WUBRG")), F.lit(0))


def deck_facts(decks: DataFrame, cards: DataFrame) -> DataFrame:
    """session, deck_seq, deck_size, deck_colors, deck_set of decks (session, seq, deck): the colours of all its cards, and the set of most of them.

    Cards (card, identity, expansion, basic) have one row a card; those that are unknown, or basic, or of no set speak for no
    set; of sets as frequent the one that the deck names first.
    """
    each = decks.select("session", F.col("seq").alias("deck_seq"), F.posexplode("deck").alias("place", "card")).join(cards, "card", "left")
    of_set = F.when(~F.coalesce("basic", F.lit(False)), F.nullif("expansion", F.lit("")))
    sets = each.groupBy("session", "deck_seq", of_set.alias("set_")).agg(F.count("*").alias("n"), F.min("place").alias("first_"), F.bit_or(_bits(F.coalesce("identity", F.lit("")))).alias("bits_"))
    most = F.max_by("set_", F.when(F.col("set_").isNotNull(), F.struct("n", -F.col("first_"))))
    return sets.groupBy("session", "deck_seq").agg(F.sum("n").alias("deck_size"), _letters(F.bit_or("bits_")).alias("deck_colors"), most.alias("deck_set"))


def match_summary(events: DataFrame, objects: DataFrame, cards: DataFrame) -> DataFrame:
    """One row for each match of each session (a log): names, colours, event, times, result, record and title.

    events: session, seq, match, type (CONNECT, STATE, OVER, SNAPSHOT or any other), ts (text, sortable), seat, deck (cards),
    players (seat, name, team, event), event, results (scope, winner).  objects: session, match, zone, controller, seat, colors.
    A match begins with its first STATE, or OVER with results; what was before does not count.  Names of a STATE replace
    earlier ones (up to '#'), those of a SNAPSHOT only fill in; the first event named stays; the last results count.  The deck
    is the last one at a match's begin, else the first to come; the seat is that of the match's last SNAPSHOT, else the last
    known at its begin, else the session's last.
    """
    own = Window.partitionBy(*MATCH)
    begins = F.col("match").isNotNull() & ((F.col("type") == "STATE") | ((F.col("type") == "OVER") & F.col("results").isNotNull()))
    rows = events.withColumn("begin", F.min(F.when(begins, F.col("seq"))).over(own))
    inside = F.col("match").isNotNull() & (F.col("seq") >= F.col("begin"))
    rows = rows.withColumn("inside", F.coalesce(inside, F.lit(False)))

    # What a session knows so far: numbers only, decks are joined by theirs.
    so_far = Window.partitionBy("session").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    has_deck = (F.col("type") == "CONNECT") & (F.size("deck") > 0)
    seat = F.when((F.col("type") == "CONNECT") | ((F.col("type") == "SNAPSHOT") & F.col("inside")), F.col("seat"))
    rows = rows.withColumns({"deck_now": F.last(F.when(has_deck, F.col("seq")), True).over(so_far), "seat_now": F.last(seat, True).over(so_far)})
    session = rows.groupBy("session").agg(F.min(F.when(has_deck, F.col("seq"))).alias("first_deck"), F.max_by("seat_now", F.when(F.col("seat_now").isNotNull(), F.col("seq"))).alias("last_seat"))

    live = rows.where("inside")
    of_scope = lambda s: F.filter("results", lambda r: r["scope"] == s)
    games = F.transform(of_scope("game"), lambda r: r["winner"])
    winner = F.try_element_at(of_scope("match"), F.lit(-1))["winner"]
    named = F.coalesce(F.get(F.filter(F.transform("players", lambda p: p["event"]), lambda e: e != ""), F.lit(0)), F.nullif("event", F.lit("")))
    is_state, scored = F.col("type") == "STATE", F.col("type").isin("STATE", "OVER")
    last_of = lambda x, when: F.max_by(x, F.when(when, F.col("seq")))
    facts = live.groupBy(*MATCH).agg(
        F.min("begin").alias("begin"),
        F.min(F.nullif("ts", F.lit(""))).alias("start_time"),
        F.max(F.nullif("ts", F.lit(""))).alias("end_time"),
        F.min_by(named, F.when(is_state & named.isNotNull(), F.col("seq"))).alias("event_id"),
        last_of(games, scored & (F.size(games) > 0)).alias("winners"),
        last_of(winner, scored & winner.isNotNull()).alias("winner"),
        last_of("seat", (F.col("type") == "SNAPSHOT") & F.col("seat").isNotNull()).alias("seat_seen"),
        F.min_by("deck_now", "seq").alias("deck_now"),
        F.min_by("seat_now", "seq").alias("seat_now"),
    )
    facts = facts.join(session, "session").withColumns({"deck_seq": F.coalesce("deck_now", "first_deck"), "seat": F.coalesce("seat_seen", "seat_now", "last_seat")})

    each = live.where(F.col("type").isin("STATE", "SNAPSHOT")).select(*MATCH, "seq", "type", F.posexplode("players").alias("place", "p"))
    order, name = F.struct("seq", "place"), F.nullif(F.col("p.name"), F.lit(""))
    seats = each.groupBy(*MATCH, F.col("p.seat").alias("seat")).agg(
        F.max_by(F.split_part(name, F.lit("#"), F.lit(1)), F.when(is_state & name.isNotNull(), order)).alias("said"),
        F.min_by(name, F.when(~is_state & name.isNotNull() & ~name.startswith("Seat "), order)).alias("seen"),
        F.max_by("p.team", F.when(is_state & F.col("p.team").isNotNull(), order)).alias("team"),
    )
    seats = seats.where("seat is not null").groupBy(*MATCH).agg(F.sort_array(F.collect_list(F.struct("seat", F.coalesce("said", "seen").alias("name"), "team"))).alias("seats"))

    local = F.coalesce(F.col("controller") == F.col("seat"), F.lit(False))
    shown = objects.where(F.col("zone").isin("BATTLEFIELD", "GRAVEYARD") & F.col("controller").isNotNull() & (F.length("colors") > 0))
    colors = shown.groupBy(*MATCH).agg(_letters(F.coalesce(F.bit_or(F.when(local, _bits(F.col("colors")))), F.lit(0))).alias("own_seen"), _letters(F.coalesce(F.bit_or(F.when(~local, _bits(F.col("colors")))), F.lit(0))).alias("foe_seen"))
    decks = deck_facts(rows.where(has_deck).select("session", "seq", "deck"), cards)

    whole = facts.join(seats, MATCH, "left").join(colors, MATCH, "left").join(decks, ["session", "deck_seq"], "left")
    at = lambda s, k: F.get(F.filter("seats", lambda p: p["seat"] == s), F.lit(0))[k]
    foe = F.get(F.filter("seats", lambda p: p["name"].isNotNull() & (F.col("seat").isNull() | (p["seat"] != F.col("seat")))), F.lit(0))
    team = F.coalesce(at(F.col("seat"), "team"), F.col("seat"))
    count = lambda kept: F.size(F.filter("winners", kept))
    whole = whole.withColumns({"team": team, "opponent_seat": foe["seat"], "opponent": F.when(foe["seat"] != 0, foe["name"]), "you": F.when(F.col("seat") != 0, at(F.col("seat"), "name"))})
    whole = whole.withColumns({
        "wins": count(lambda x: F.coalesce(x == F.col("team"), F.lit(False))),
        "losses": count(lambda x: x.isNotNull() & ~x.eqNullSafe(F.col("team"))),
        "you_colors": F.coalesce(F.nullif("deck_colors", F.lit("")), "own_seen", F.lit("")),
        "opponent_colors": F.coalesce("foe_seen", F.lit("")),
        "event_name": event_name(F.col("event_id"), F.col("deck_set")),
    })
    by_games = F.when(F.col("wins") > F.col("losses"), "win").when(F.col("losses") > F.col("wins"), "loss").otherwise("draw")
    judged = F.when(F.col("winner").isNotNull() & F.col("team").isNotNull(), F.when(F.col("winner") == F.col("team"), "win").otherwise("loss")).when(F.col("winners").isNotNull(), by_games)
    kind = lambda c: F.when(F.col(c) != "", guild_name(F.col(c)))
    whole = whole.withColumns({"result": judged, "record": F.when(F.col("winners").isNotNull(), F.concat_ws("-", "wins", "losses")), "you_archetype": kind("you_colors"), "opponent_archetype": kind("opponent_colors")})
    versus = F.concat(F.coalesce("you_archetype", "you", F.lit("You")), F.lit(" vs "), F.coalesce("opponent_archetype", "opponent", F.lit("Opponent")))
    outcome = F.concat(F.initcap("result"), F.coalesce(F.concat(F.lit(" ("), "record", F.lit(")")), F.lit("")))
    day = F.date_format(F.try_to_timestamp("start_time"), "MMM dd, yyyy")
    return whole.select(
        *MATCH, "event_id", "event_name", "start_time", "end_time", "seat", "you", "you_colors", "you_archetype", "deck_size", "opponent_seat", "opponent", "opponent_colors", "opponent_archetype",
        "result", "record", F.size("winners").alias("games"), F.concat_ws(" — ", versus, outcome, "event_name", day).alias("title"),
    )


def move_checks(runs: DataFrame, chosen: DataFrame, moves: DataFrame, tapped: DataFrame, final: DataFrame, selections: dict[str, tuple[str, str, str]]) -> DataFrame:
    """run, check, passed, sequence, object: each check once a run, with what proves it, or breaks it, first.

    chosen: run, seq, prompt, kind, object; moves: run, seq, place, object, from_zone, to_zone; tapped: run, seq, object, was,
    now; final: run, object (of the last battlefield, once each).  selections names checks that a chosen option of a kind
    moved its own object from a zone to another in its own step.  mana_tapped: a chosen mana source became tapped;
    spell_resolved: a move from STACK to BATTLEFIELD; moves_chain: each move starts where the object's last ended (UNKNOWN fits
    anything); final_agrees: an object is on the final battlefield exactly if its last move went there.
    """
    evidence = lambda df, check: df.select("run", F.lit(check).alias("check"), F.struct("seq", "place", "object").alias("e"))
    own = ["run", "seq", "object"]
    found = []
    for check, (kind, start, end) in selections.items():
        picked = chosen.where(F.col("kind") == kind).select(*own)
        found.append(evidence(moves.where((F.col("from_zone") == start) & (F.col("to_zone") == end)).join(picked, own, "left_semi"), check))
    sources = chosen.where("prompt = 'PAY_MANA' and kind = 'PROMPT_MANA_SOURCE'").select(*own)
    found.append(evidence(tapped.where("not was and now").join(sources, own, "left_semi").withColumn("place", F.lit(0).cast("long")), "mana_tapped"))
    found.append(evidence(moves.where("from_zone = 'STACK' and to_zone = 'BATTLEFIELD'"), "spell_resolved"))
    found.append(evidence(broken_chains(moves, "run", "object", ["seq", "place"]), "moves_chain"))
    order = F.struct("seq", "place")
    ends = moves.groupBy("run", "object").agg(F.max_by("to_zone", order).alias("zone"), F.max("seq").alias("seq"), F.min(order).alias("first_"))
    ends = ends.join(final.select("run", "object", F.lit(True).alias("there")), ["run", "object"], "left")
    wrong = ends.where((F.col("zone") == "BATTLEFIELD") != F.coalesce("there", F.lit(False)))
    # The first by when the object first moved; the sequence shown is that of its last move.
    at_end = wrong.groupBy("run").agg(F.min_by(F.struct("seq", F.lit(0).cast("long").alias("place"), "object"), "first_").alias("e")).select("run", F.lit("final_agrees").alias("check"), "e")
    all_found = reduce(DataFrame.unionByName, [*found, at_end])
    breaks = ["moves_chain", "final_agrees"]
    names = [*selections, "mana_tapped", "spell_resolved", *breaks]
    asked = runs.select("run").distinct().select("run", F.explode(F.array(*map(F.lit, names))).alias("check"))
    first = all_found.groupBy("run", "check").agg(F.min("e").alias("e"))
    return asked.join(first, ["run", "check"], "left").select("run", "check", (F.col("e").isNull() == F.col("check").isin(*breaks)).alias("passed"), F.col("e.seq").alias("sequence"), F.col("e.object").alias("object"))


def timeline(states: DataFrame) -> DataFrame:
    """Compact rows of states (run, ts_ms, turn, phase, players (seat, life, hand), objects (zone, controller, name), history (texts), confidence (path to number)).

    Seconds, both seats' life and hand, the size of their battlefields and the names on them, the last line of the log, and how
    sure life and phase are.  What a state doesn't say is null, a missing time or confidence 0, a missing list empty.
    """
    player = lambda seat, key: F.get(F.filter("players", lambda p: p["seat"] == seat), F.lit(0))[key]
    board = lambda seat: F.filter("objects", lambda o: (o["zone"] == "battlefield") & (o["controller"] == seat))
    number = lambda seat: F.coalesce(F.size(board(seat)), F.lit(0))
    names = lambda seat: F.coalesce(F.array_sort(F.array_distinct(F.filter(F.transform(board(seat), lambda o: o["name"]), lambda n: n != ""))), F.array().cast("array<string>"))
    sure = lambda path: F.round(F.coalesce(F.try_element_at("confidence", F.lit(path)), F.lit(0.0)), 2)
    per_seat = [f(s).alias(f"{n}{s}") for n, f in (("life", lambda s: player(s, "life")), ("hand", lambda s: player(s, "hand")), ("board", number), ("names", names)) for s in (1, 2)]
    return states.select("run", F.round(F.coalesce("ts_ms", F.lit(0)) / 1000, 2).alias("t"), "turn", "phase", *per_seat, F.coalesce(F.try_element_at("history", F.lit(-1)), F.lit("")).alias("log"), sure("/players/1/life").alias("sure_life"), sure("/phase").alias("sure_phase"))
