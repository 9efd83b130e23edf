"""Native logs, scorers, analyses, comparisons, sideboards, zones and preferences on small inputs."""

import hashlib

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import reports as R


def test_a_native_log_carries_turns_and_names_players_by_first_mention(spark):
    lines = ["Bob joined the game", "ALICE  Smith joined the game", "Game #812345678 and game 812345678, game id: 899999999", "bob casts Bolt targeting Alice Smith.", "Turn 3: Alice smith's turn", "alice smith plays Forest", "nothing at all", "some damage note", "Bob wins the game"]
    rows = [("a", i, x) for i, x in enumerate(lines)] + [("b", 0, "X gains 3 life."), ("b", 1, None), ("b", 2, "")]
    events = R.native_log(spark.createDataFrame(rows, "doc string, place long, line string"))
    got = {(r["doc"], r["place"]): r for r in events.collect()}
    assert len(got) == len(rows)
    assert [got["a", i]["action_type"] for i in range(9)] == [None, None, None, "CAST_SPELL", "TURN_START", "PLAY_LAND", None, None, "GAME_WIN"]
    assert [got["a", i]["turn"] for i in range(9)] == [None] * 4 + [3] * 5
    assert [got["a", i]["actor"] for i in (3, 4, 5, 8)] == ["player:1", "player:2", "player:2", "player:1"] and got["b", 0]["actor"] == "player:1"
    assert [got["a", i]["unparsed"] for i in (6, 7)] == [False, True] and not got["b", 1]["unparsed"]
    a, b = R.native_summary(events).orderBy("doc").collect()
    assert tuple(a) == ("a", 9, 2, 1, ["player:1", "player:2"], ["812345678", "899999999"])
    assert tuple(b) == ("b", 3, 1, 0, [], [])


def test_plain_scores(spark):
    rows = [("CAST_SPELL", "x", -0.5), ("pass", "Concede", 0.0), ("PASS_PRIORITY", None, 0.0), (None, "PASS", 0.0), ("activate_block", "", 0.0), (None, None, 0.0), ("MULLIGAN", "", 0.0)]
    df = spark.createDataFrame(rows, "kind string, label string, x double")
    assert [r[0] for r in df.select(R.shape_score(F.col("kind"), F.col("label"))).collect()] == [3.0, -100.0, -1.0, -1.0, 2.0, 0.5, 0.0]
    got = spark.range(5).select(R.seeded_score(F.lit("fp"), 7, F.col("id"))).collect()
    assert [r[0] for r in got] == [int.from_bytes(hashlib.sha256(f"fp|7|{i}".encode()).digest()[:8], "big") / 2**64 for i in range(5)]


def test_an_analysis_as_text(spark):
    schema = "model string, raw boolean, top array<struct<label:string,probability:double,score:double>>, rank int"
    df = spark.createDataFrame([("m", True, [("a", 0.5, 1.0), ("b", None, 0.25), ("c", None, None)], 2), (None, None, [], 1), ("", False, None, 3), ("m", False, [(None, 0.125, 0.0)], None)], schema)
    got = [r[0] for r in df.select(R.analysis_text(F.col("model"), F.col("raw"), F.col("top"), F.col("rank"))).collect()]
    assert got[0] == "Model analysis · m (untrained)\n1. a  50.0%\n2. b  0.2500\n3. c  0.0000\n✗ Played rank: 2 — model preferred a"
    assert got[1] == "Model analysis · model\n✓ Played rank: 1 — the model's top pick"
    assert got[2] == "Model analysis · model\n✗ Played rank: 3"
    assert got[3].startswith("Model analysis · m\n1. None  12.")
    assert df.select(R.analysis_text(F.col("model"), F.col("raw"), F.col("top"), F.col("rank"), 1)).first()[0].count("\n") == 2


def test_models_compared_by_their_latest_analyses(spark):
    decisions = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z"), (4, None)], "fingerprint int, human string")
    analyses = spark.createDataFrame([
        (1, "a", "1", 0, ["q"], 5), (1, "a", "2", 0, ["w", "w", "x"], 3), (1, "b", None, 0, ["w"], 4), (1, "b", None, 1, ["x"], 1),
        (2, "a", "1", 0, ["y"], 1), (2, "c", "1", 0, ["other"], 1), (4, "a", "1", 0, ["k"], None), (4, "b", "1", 0, ["k"], 2),
    ], "fingerprint int, model string, created string, place int, top array<string>, chosen_rank int")
    rows = R.comparison(decisions, analyses, ["a", "b"])
    got = {r["fingerprint"]: r for r in rows.collect()}
    assert [tuple(c) for c in got[1]["cells"]] == [("a", True, "w", 2), ("b", True, "x", 1)]
    assert [got[i]["agreement"] for i in (1, 2, 3, 4)] == ["disagree", "partial-agree", "unscored", "all-agree"]
    metrics = {r["model"]: tuple(r)[1:] for r in R.comparison_metrics(rows).collect()}
    assert metrics["a"] == (3, 0.75, 1 / 3, (0.5 + 1) / 3) and metrics["b"] == (2, 0.5, 0.5, (1 + 0.5) / 2)


def test_sideboards_answer_the_last_prompt(spark):
    schema = "match string, resp int, place int, game long, deck array<long>, side array<long>"
    prompts = spark.createDataFrame([("m", 1, 0, 1, [9], None), ("m", 1, 5, 2, [1, 2, 2], [3]), (None, 2, 1, 4, None, None)], schema)
    submits = spark.createDataFrame([("m", 1, 6, None, [2, 1, 2], [3]), ("m", 1, 7, None, [1, 2], []), (None, 2, 8, None, None, None), ("m", 3, 9, None, [1], [])], schema).drop("game")
    got = {r["place"]: (r["game"], r["offered_deck"], r["changed"], r["reason"]) for r in R.sideboards(prompts, submits).collect()}
    assert got[6] == (2, [1, 2, 2], False, "sideboards_compiled") and got[7][2] is True
    assert got[8] == (4, [], False, "sideboards_compiled") and got[9] == (None, None, None, "sideboards_missing_prompt")


def test_zones_of_both_layouts(spark):
    texts = [
        '{"zones": {"Libraries": {"1": 53}, "hands": {"2": [{"n": 1}], "1": 4}, "exile": [{"n": 2, "ownerSeat": 2}, 5, null], "Moon": [{"n": 3}]}, "hand": [{"n": 9}]}',
        '{"hand": [{"n": 4, "seat": 1}], "graveyards": {"1": [{"n": 5}]}, "library": 30, "zones": [1]}',
        "[]", '{"zones": {}, "hand": [1]}', None,
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string").select("id", F.parse_json("t").alias("state"))
    got = sorted(((r["id"], r["zone"], r["seat"], r["place"], r["n"]) for r in R.zone_objects(df).withColumn("n", F.try_variant_get("object", "$.n", "int")).drop("object").collect()), key=str)
    assert got == sorted([(0, "hand", "2", 0, 1), (0, "exile", "2", 0, 2), (0, "exile", None, 1, None), (0, "exile", None, 2, None), (0, "other", None, 0, 3), (1, "hand", "1", 0, 4), (1, "graveyard", "1", 0, 5)], key=str)


def test_raw_history_is_stamped(spark):
    df = spark.createDataFrame([("RAW", 1, "p"), ("OTHER", 2, "q"), (None, 3, "r")], "kind string, id int, payload string")
    assert [tuple(r) for r in R.redacted_history(df, "kind", ("RAW",), ("payload", "absent")).orderBy("id").collect()] == [("RAW", 1, None, True), ("OTHER", 2, "q", None), (None, 3, "r", None)]


def test_preferences_are_typed_and_faults_name_their_line(spark, tmp_path):
    good = '{"id": "c", "left": {"id": "l", "factors": {"f": 1}}, "right": {"id": "r", "factors": {}}, "preferred": "RIGHT", "weight": 2}'
    (tmp_path / "good.jsonl").write_text(good + "\n\n" + good.replace('"RIGHT", "weight": 2', "-1") + "\n")
    rows = R.read_preferences(spark, str(tmp_path / "good.jsonl"), ["f"]).orderBy("line").collect()
    assert [(r["line"], r["context"], r["preferred"], r["confidence"], r["weight"], r["left"], r["right"]) for r in rows] == [(1, "c", "right", 1.0, 2.0, {"f": 1.0}, {}), (3, "c", "right", 1.0, 1.0, {"f": 1.0}, {})]
    (tmp_path / "bad.jsonl").write_text(good + "\n" + good.replace('"f"', '"g"') + "\n")
    with pytest.raises(Exception, match=r"bad.jsonl:2: left: unknown factors g"):
        R.read_preferences(spark, str(tmp_path / "bad.jsonl"), ["f"]).collect()
    (tmp_path / "none.jsonl").write_text("\n")
    with pytest.raises(ValueError, match="no examples"):
        R.read_preferences(spark, str(tmp_path / "none.jsonl"), ["f"])


def test_a_service_log_by_agent_and_prompt(spark):
    requests = spark.createDataFrame([("a", "p", 2, 10), ("a", "p", 4, 30), (None, None, 1, 5)], "agent string, prompt string, options int, latency int")
    errors = spark.createDataFrame([("a", "p", "E"), ("a", "p", "D"), ("b", "p", "E")], "agent string, prompt string, error string")
    got = {(r["agent"], r["prompt"]): r for r in R.service_report(requests, errors).collect()}
    assert tuple(got["a", "p"])[2:] == (2, 3.0, 20.0, 29.0, 30, 2, "D")
    assert tuple(got["random", "UNKNOWN"])[2:] == (1, 1.0, 5.0, 5.0, 5, 0, None) and tuple(got["b", "p"])[2:] == (0, None, None, None, None, 1, "E")


def test_picks_know_their_pool_and_counters_what_was_dropped(spark):
    schema = "source string, draft string, pack int, pick int, place int, cards array<long>"
    packs = spark.createDataFrame([("s", "d", 1, 1, 0, [1, 2]), ("s", "d", 1, 1, 5, [7]), ("s", "d", 1, 3, 0, [3, 3]), ("t", None, None, None, 0, [4])], schema)
    picks = spark.createDataFrame([("s", "d", 1, 1, 0, [2]), ("s", "d", 1, 1, 1, [1]), ("s", "d", 1, 2, 0, [9]), ("s", "d", 1, 3, 0, [3]), ("t", None, None, None, 0, None)], schema)
    rows = R.draft_picks(packs, picks)
    got = {(r["source"], r["pick"]): (r["offered"], r["picked"], r["pool"], r["reason"]) for r in rows.collect()}
    assert got == {("s", 1): ([1, 2], [1], [], "picks_compiled"), ("s", 2): (None, [9], [1], "picks_missing_pack"), ("s", 3): ([3, 3], [3], [1, 9], "picks_compiled"), ("t", None): ([4], [], [], "picks_compiled")}
    bad = spark.createDataFrame([("s", "d", 1, 1, 0, [8])], schema)
    with pytest.raises(Exception, match="picked cards 8 not offered in draft d pack 1 pick 1 of s"):
        R.draft_picks(packs, bad).collect()
    builds = spark.createDataFrame([("s", "d", False, [1]), ("t", "d", None, [1]), ("s", None, None, [2]), ("s", "e", True, [3])], "source string, draft string, recovered boolean, deck array<long>")
    boards = spark.createDataFrame([("m", "sideboards_missing_prompt")] * 2, "match string, reason string")
    assert {r["counter"]: r["n"] for r in R.draft_stats(rows, builds, boards).collect()} == {"picks_compiled": 3, "picks_missing_pack": 1, "deck_builds_compiled": 4, "deck_builds_without_pool": 2, "deck_builds_pool_recovered": 1, "duplicates_dropped": 1, "sideboards_missing_prompt": 2}


def test_bundles_are_read_as_written(spark, tmp_path):
    from ledgerline.sources import files

    names = ["a b", "x/y=1", "100%+é", "1"]
    states = spark.createDataFrame([(n, i, "two\nlines") for i, n in enumerate(names)] + [(None, 9, None)], "bundle string, id int, text string")
    files.write_bundle({"decisions": states.where("id < 2"), "mirror_states": states}, str(tmp_path / "runs"))
    parts, summary = files.read_bundle(spark, str(tmp_path / "runs"), ("mirror_states", "decisions", "absent"))
    got = parts["mirror_states"].select("bundle", F.variant_get("record", "$.id", "int").alias("id"), F.try_variant_get("record", "$.text", "string").alias("text")).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(n, i, "two\nlines") for i, n in enumerate(names)] + [(None, 9, None)], key=str)
    assert parts["absent"].count() == 0 and parts["decisions"].count() == 2
    assert sorted(((r["part"], r["bundle"], r["rows"]) for r in summary.collect()), key=str) == sorted([("mirror_states", n, 1) for n in [*names, None]] + [("decisions", n, 1) for n in names[:2]], key=str)
    parts, summary = files.read_bundle(spark, str(tmp_path / "none"))
    assert summary.count() == 0 and parts["decisions"].count() == 0


def test_the_best_attempt_is_accepted_above_the_gate(spark):
    rows = [(1, "a", 0.7, 2), (1, "b", 0.7, 1), (1, "c", None, 0), (2, "a", 0.59, 0), (3, None, 0.9, 0), (3, "x", 0.8, 1), (4, "n", 0.6, 0)] + [(5, "n", i / 20, i) for i in range(12)]
    df = spark.createDataFrame(rows, "item int, name string, score double, place int")
    got = {r["item"]: r for r in R.best_attempts(df, ["item"], "score", "name", ["place"]).collect()}
    assert [(got[i]["status"], got[i]["accepted"]) for i in (1, 2, 3, 4)] == [("accepted", "b"), ("below-threshold", None), ("below-threshold", None), ("accepted", "n")]
    assert [e["name"] for e in got[1]["evidence"]] == ["b", "a", "c"] and [e["place"] for e in got[5]["evidence"]] == [11, 10, 9, 8, 7, 6, 5, 4]
