"""Summaries of matches, checks of moves and timelines on small logs."""

from ledgerline.operators import matches as M

EVENTS = "session int, seq long, match string, type string, ts string, seat int, deck array<long>, players array<struct<seat:int,name:string,team:int,event:string>>, event string, results array<struct<scope:string,winner:int>>"
OBJECTS = "session int, match string, zone string, controller int, seat int, colors string"
CARDS = "card long, identity string, expansion string, basic boolean"


def summary(spark, events, objects=(), cards=()):
    rows = [(*e, *[None] * (10 - len(e))) for e in events]
    out = M.match_summary(spark.createDataFrame(rows, EVENTS), spark.createDataFrame(list(objects), OBJECTS), spark.createDataFrame(list(cards), CARDS))
    return {(r["session"], r["match"]): r for r in out.collect()}


def test_a_match_with_its_deck_names_colours_and_result(spark):
    events = [
        (1, 0, "m", "OTHER", "2024-01-01T00:00:00"),  # before the match begins: no time of it
        (1, 1, None, "CONNECT", None, 2, [10, 10, 11, 12, 99]),
        (1, 2, "m", "STATE", "2024-05-01T10:00:00", None, None, [(1, "Foe#44", 7, ""), (2, "Me#1", 9, "QuickDraft")], "Ladder"),
        (1, 3, "m", "SNAPSHOT", "2024-05-01T10:30:00", 2, None, [(1, "Other", None, None), (3, "Seat 3", None, None)]),
        (1, 4, "m", "OVER", "2024-05-01T11:00:00", None, None, None, None, [("game", 9), ("game", None), ("game", 7), ("game", 9), ("match", 9)]),
        (1, 5, "later", "STATE", "", None, None, []),
        (1, 6, "none", "SNAPSHOT", "x", 1),  # a match that never begins
    ]
    objects = [(1, "m", "BATTLEFIELD", 1, 2, "GB"), (1, "m", "HAND", 1, 2, "W"), (1, "m", "GRAVEYARD", 2, 2, "R"), (1, "m", "BATTLEFIELD", None, 2, "U")]
    cards = [(10, "U", "BLB", True), (11, "B", "DSK", False), (12, "", "FDN", False)]
    got = summary(spark, events, objects, cards)
    assert set(got) == {(1, "m"), (1, "later")}
    m = got[1, "m"]
    assert (m["you"], m["opponent"], m["seat"], m["opponent_seat"]) == ("Me", "Foe", 2, 1)
    assert (m["you_colors"], m["deck_size"], m["opponent_colors"], m["opponent_archetype"]) == ("UB", 5, "BG", "Golgari")
    assert (m["event_id"], m["event_name"]) == ("QuickDraft", "Duskmourn: House of Horror Quick Draft")
    assert (m["result"], m["record"], m["games"], m["start_time"], m["end_time"]) == ("win", "2-1", 4, "2024-05-01T10:00:00", "2024-05-01T11:00:00")
    assert m["title"] == "Dimir vs Golgari — Win (2-1) — Duskmourn: House of Horror Quick Draft — May 01, 2024"
    later = got[1, "later"]
    assert (later["seat"], later["you"], later["opponent"], later["result"], later["record"], later["games"]) == (2, None, None, None, None, None)
    assert later["title"] == "Dimir vs Opponent — Duskmourn: House of Horror" and later["deck_size"] == 5 and later["start_time"] is None


def test_decks_and_seats_that_come_late_and_sessions_apart(spark):
    over = [("game", 1), ("game", 2)]
    got = summary(spark, [
        (1, 1, "a", "OVER", "t", None, None, None, None, over),
        (1, 2, None, "CONNECT", None, 1, [5]),
        (1, 3, None, "CONNECT", None, 2, [6, 6]),
        (1, 4, "b", "STATE", "t"),
        (2, 1, "a", "STATE", "t", None, None, [(0, "Zero", 1, None)]),
        (2, 2, "a", "OVER", "t"),
    ], cards=[(5, "R", None, None), (6, "G", None, None)])
    assert (got[1, "a"]["you_colors"], got[1, "a"]["seat"], got[1, "a"]["result"], got[1, "a"]["record"]) == ("R", 2, "draw", "1-1")
    assert (got[1, "b"]["you_colors"], got[1, "b"]["deck_size"], got[1, "b"]["seat"]) == ("G", 2, 2)
    zero = got[2, "a"]
    assert (zero["seat"], zero["you"], zero["opponent"], zero["opponent_seat"], zero["you_colors"], zero["title"]) == (None, None, None, 0, "", "You vs Opponent")
    assert summary(spark, []) == {}


def test_moves_prove_or_break_each_check_of_a_run(spark):
    make = spark.createDataFrame
    runs = make([(1,), (2,), (3,)], "run int")
    chosen = make([(1, 1, "PRIORITY", "CAST", "a"), (1, 2, "PAY_MANA", "PROMPT_MANA_SOURCE", "m"), (2, 1, "PRIORITY", "CAST", "b"), (2, 2, "PRIORITY", "PROMPT_MANA_SOURCE", "m")], "run int, seq long, prompt string, kind string, object string")
    moves = make([
        (1, 1, 0, "a", "HAND", "STACK"), (1, 2, 0, "a", "STACK", "BATTLEFIELD"), (1, 3, 0, "h", "UNKNOWN", "HAND"), (1, 3, 1, "h", "LIBRARY", "UNKNOWN"), (1, 4, 0, "h", "EXILE", "HAND"),
        (2, 2, 0, "b", "HAND", "STACK"), (2, 3, 0, "b", "GRAVEYARD", "EXILE"), (2, 3, 1, "c", "HAND", "BATTLEFIELD"),
    ], "run int, seq long, place long, object string, from_zone string, to_zone string")
    tapped = make([(1, 2, "m", False, True), (2, 2, "m", False, True)], "run int, seq long, object string, was boolean, now boolean")
    final = make([(1, "a"), (2, "z")], "run int, object string")
    got = {(r["run"], r["check"]): (r["passed"], r["sequence"], r["object"]) for r in M.move_checks(runs, chosen, moves, tapped, final, {"cast": ("CAST", "HAND", "STACK")}).collect()}
    assert len(got) == 15
    assert got[1, "cast"] == (True, 1, "a") and got[2, "cast"] == (False, None, None)
    assert got[1, "mana_tapped"] == (True, 2, "m") and not got[2, "mana_tapped"][0]
    assert got[1, "spell_resolved"] == (True, 2, "a") and not got[2, "spell_resolved"][0]
    # LIBRARY does not follow HAND: what is known must fit.
    assert got[1, "moves_chain"] == (False, 3, "h") and got[2, "moves_chain"] == (False, 3, "b")
    assert got[1, "final_agrees"][0] and got[2, "final_agrees"] == (False, 3, "c")
    assert [got[3, c][0] for c in ("cast", "mana_tapped", "spell_resolved", "moves_chain", "final_agrees")] == [False, False, False, True, True]


def test_a_timeline_row_says_what_the_state_says(spark):
    schema = "run int, ts_ms long, turn int, phase string, players array<struct<seat:int,life:int,hand:int>>, objects array<struct<zone:string,controller:int,name:string>>, history array<string>, confidence map<string,double>"
    rows = [
        (1, 12345, 3, "Main", [(2, 18, 5)], [("battlefield", 1, "b"), ("battlefield", 1, "a"), ("battlefield", 1, "b"), ("battlefield", 2, None), ("hand", 2, "x")], ["one", "two"], {"/phase": 0.456}),
        (2, None, None, None, None, None, None, None),
    ]
    a, b = M.timeline(spark.createDataFrame(rows, schema)).orderBy("run").collect()
    assert (a["t"], a["life1"], a["life2"], a["hand2"], a["board1"], a["board2"], a["names1"], a["names2"], a["log"], a["sure_life"], a["sure_phase"]) == (12.35, None, 18, 5, 3, 1, ["a", "b"], [], "two", 0.0, 0.46)
    assert (b["t"], b["life1"], b["board1"], b["names1"], b["log"], b["sure_phase"]) == (0.0, None, 0, [], "", 0.0)
