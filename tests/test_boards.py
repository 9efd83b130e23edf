"""Log events, prompts, board states and open JSON on small cases written out by hand."""

import hashlib
import json
import math
import re

from pathlib import Path

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_events_carry_match_and_game(spark):
    from ledgerline.operators.log_events import normalize_stream

    served = lambda *m: json.dumps({"greToClientEvent": {"greToClientMessages": list(m)}})
    state = lambda **info: {"type": "GREMessageType_GameStateMessage", "gameStateMessage": {"gameInfo": info}}
    room = lambda **more: json.dumps({"matchGameRoomStateChangedEvent": {"gameRoomInfo": {"gameRoomConfig": {"matchId": "m"}, **more}}})
    texts = [
        "x " + room(),
        "noise [Manifest] none",
        "{broken",
        served(state(gameNumber=1)),
        served({"type": "GREMessageType_SubmitDeckReq", "msgId": 4}, {"type": "GREMessageType_SubmitDeckReq", "msgId": 4}),
        served(state(stage="GameStage_GameOver"), state(stage="GameStage_GameOver")),
        json.dumps({"payload": json.dumps({"request": {"DraftId": "d", "GrpIds": [3]}})}),
        json.dumps({"Deck": {"MainDeck": []}, "EventName": "e"}),
        room(finalMatchResult={"w": 1}) + " tail",
        served(state(matchID="n")),
        json.dumps({"clientToMatchServiceMessageType": "ClientToMatchServiceMessageType_ClientToGREUIMessage", "payload": {"type": "ClientMessageType_SubmitDeckResp"}}),
    ]
    rows = normalize_stream(spark.createDataFrame([("f", k, t) for k, t in enumerate(texts)], "file string, entry long, text string")).orderBy("event_id").collect()
    assert [r["type"].removeprefix("ARENA_") for r in rows] == [
        "MATCH_STATE_CHANGED", "GAME_STATE", "SIDEBOARD_PROMPT", "GAME_STATE", "GAME_OVER", "GAME_STATE", "DRAFT_PICK", "DECK_SUBMIT", "MATCH_STATE_CHANGED", "GAME_OVER", "GAME_STATE", "SIDEBOARD_SUBMIT",
    ]
    assert [r["event_id"] for r in rows] == [f"arena-{k:06d}" for k in range(1, 13)]
    assert [(r["match_id"], r["game_number"]) for r in rows] == [("m", None)] + [("m", 1)] * 9 + [("n", None)] * 2
    assert rows[2]["preceding_state"] == "arena-000002" and rows[1]["preceding_state"] is None and rows[-1]["preceding_state"] == "arena-000011"
    assert rows[-1]["raw_id"] == "arena-raw-000009"


def test_prompts_and_answers_beyond_the_plain_ones(spark):
    from ledgerline.operators.prompts import build_prompts, match_responses

    asked = [
        ("GREMessageType_DeclareAttackersReq", {"msgId": 1, "declareAttackersReq": {"attackers": [{"attackerInstanceId": 5}, {"attackerInstanceId": 6, "legalDamageRecipients": [{"targetInstanceId": 9}]}]}}),
        ("GREMessageType_SelectNReq", {"msgId": 2, "selectNReq": {"ids": [7, 8]}}),
        ("GREMessageType_CastingTimeOptionsReq", {"msgId": 3, "castingTimeOptionsReq": {"castingTimeOptionReq": [{"ctoId": 4, "castingTimeOptionType": "Kicker"}, {"ctoId": 5, "castingTimeOptionType": "Done"}]}}),
        ("GREMessageType_PayCostsReq", {"msgId": 4, "payCostsReq": {"effectCostReq": {"costSelection": {"ids": [3], "minSel": 1}}}}),
        ("GREMessageType_SearchReq", {"msgId": 5, "searchReq": {"itemsToSearch": [2], "allowFailToFind": "x_Yes"}}),
        ("GREMessageType_Unknown", {"msgId": 6}),
        ("GREMessageType_ActionsAvailableReq", {"msgId": 7, "actionsAvailableReq": {"actions": [{"actionType": "ActionType_Pass"}, {}]}}),
    ]
    said = [
        ("ClientMessageType_DeclareAttackersResp", {"respId": 1, "declareAttackersResp": {"selectedAttackers": [{"attackerInstanceId": 6, "selectedDamageRecipient": {"targetInstanceId": 9}}, {"attackerInstanceId": 5}]}}),
        ("ClientMessageType_SelectNResp", {"respId": 2, "selectNResp": {"ids": [0], "useArbitrary": "yes"}}),
        ("ClientMessageType_CastingTimeOptionsResp", {"respId": 3, "castingTimeOptionsResp": {"castingTimeOptionResp": {"ctoId": 5, "castingTimeOptionType": "Done"}}}),
        ("ClientMessageType_EffectCostResp", {"respId": 4, "effectCostResp": {"costSelection": {"ids": [3]}}}),
        ("ClientMessageType_SearchResp", {"respId": 5, "searchResp": {}}),
        ("ClientMessageType_OrderResp", {"respId": 6, "orderResp": {"ids": [1]}}),
        ("ClientMessageType_PerformActionResp", {"respId": 7, "performActionResp": {"actions": [{"actionType": "ActionType_Pass"}]}}),
        ("ClientMessageType_ConcedeReq", {}),
        ("ClientMessageType_SubmitTargetsReq", {"respId": 99}),
    ]
    frame = lambda rows, start: spark.createDataFrame([(1, start + k, t, json.dumps(b)) for k, (t, b) in enumerate(rows)], "game long, seq long, message_type string, text string").select("game", "seq", "message_type", F.parse_json("text").alias("body"))
    prompts = build_prompts(frame(asked, 0))
    by = {r["msg_id"]: r["select"] for r in prompts.collect()}
    assert [o["label"] for o in by["1"]["option"]] == ["attack with instance=5 -> target", "attack with instance=6 -> instance 9"]
    assert (by["2"]["minCount"], by["2"]["maxCount"], by["3"]["maxCount"], by["4"]["minCount"], by["5"]["maxCount"], len(by["6"]["option"])) == (0, 2, 1, 1, 1, 0)
    assert [o["type"] for o in by["7"]["option"]] == ["PASS", "ACTION"]
    got = {r["answer_kind"]: (r["selected"], r["matched"]) for r in match_responses(prompts, frame(said, 10), ["game"]).collect()}
    assert got == {
        "DeclareAttackersResp": ([1, 0], True),
        "SelectNResp": ([0, 1], True),
        "CastingTimeOptionsResp": ([1], True),
        "EffectCostResp": ([0], True),
        "SearchResp": ([1], True),
        "OrderResp": (None, False),
        "PerformActionResp": ([0], True),
        "ConcedeReq": ([0], True),
    }


def test_states_of_other_spellings(spark):
    from ledgerline.operators import boards as B

    raw = {
        "state": {"turn": 3, "localSeat": 1, "activePlayer": 1, "players": [{"seat": 1, "life": True, "hand": ["Ace", {"name": "Deuce", "faceDown": "yes"}], "revealedHand": [{"name": "Tray", "hidden": 1, "revealed": 1}]}, {"seat": 2, "life": "7"}],
                  "zones": {"Battlefield": [{"ref": {"name": "Wall"}, "controllerSeat": 2, "counters": {"age": 2}, "tapped": "tapped", "power": "2"}], "libraries": {"2": 2, "1": False}}, "exile": "nothing"},
        "confidence": 1,
    }
    df = spark.createDataFrame([(json.dumps(raw),), ("{}",)], "raw string").withColumn("state", B.canonical(F.parse_json("raw")))
    full, empty = (r["state"] for r in df.orderBy(F.desc(F.length("raw"))).collect())
    assert [(o["zone"], o["name"], o["face_down"], o["revealed"], o["placeholder"]) for o in full["objects"]] == [
        ("battlefield", "Wall", False, False, False), ("library", None, True, False, True), ("library", None, True, False, True), ("hand", "Ace", False, False, False), ("hand", None, True, False, False), ("hand", "Tray", True, True, False),
    ]
    wall = full["objects"][0]
    assert (wall["counters"], wall["tapped"], wall["power"], wall["controller"]) == ({"age": 2}, True, 2, "2")
    assert [(p["life"], p["hand_count"]) for p in full["players"]] == [(None, 2), (7, None)] and full["turn_number"] == 3
    assert empty["objects"] == [] and empty["players"] == []
    one = df.where("raw <> '{}'").select(B.factors(F.col("state"), F.lit("1")).alias("f")).first()["f"]
    assert (one["battlefield_count"], one["battlefield_diff"], one["is_active_player"], one["has_priority"], one["life_total"], one["stack_count"]) == (0, -1, 1, 0, None, 0)
    rows = B.state_rows(df.where("raw <> '{}'").withColumn("k", F.lit(1)), ["k"]).orderBy("row").collect()
    assert [r["zone"] for r in rows] == ["global", "player", "player", "battlefield", "hand", "hand", "hand"] and rows[3]["text"] == "card | name=Wall | power=2"


def test_open_json_is_stable(spark):
    from ledgerline.functions import open_json as J

    one = {"b": [{"id": 1, "x": "a 01234567-89ab-cdef-0123-456789abcdef"}], "a": {"timestamp": 5, "y": None, "deep": {"deep": {"deep": {"deep": 1}}}}, "raw": "secret"}
    two = {"a": {"timestamp": 6, "deep": {"deep": {"deep": {"deep": 1}}}, "y": None}, "b": [{"x": "a ", "id": 2}]}
    rows = spark.createDataFrame([(json.dumps(one),), (json.dumps(two),), (None,)], "t string").select(J.fingerprint(F.col("t")).alias("f"), J.flatten_text(F.col("t")).alias("x")).collect()
    assert rows[0]["f"] == rows[1]["f"] and rows[2]["f"] is None and rows[0]["x"] == "b.x=a"
    want = '{"a":{"deep":{"deep":{"deep":{"deep":1}}},"y":null},"b":[{"x":"a "}]}'
    assert rows[0]["f"] == "sha256:" + hashlib.sha256(want.encode()).hexdigest()


def test_embeddings_equal_their_rule(spark):
    from ledgerline.operators.features import RULES_WORDS, hash_embedding

    texts = ["Draw two cards: {U}{U}, +1/+1", "", "a bb ccc dddd eeeee", None]
    got = {r["t"]: r["vector"] for r in hash_embedding(spark.createDataFrame([(t,) for t in texts], "t string"), "t", 32).collect()}
    assert len(got) == 4
    for t in texts:
        v = [0.0] * 32
        for word in re.findall(RULES_WORDS, (t or "").lower()):
            marked = f"^{word}$"
            own = ["w:" + word] + [f"c3:{marked[i : i + 3]}" for i in range(len(marked) - 2) if len(word) >= 3] + [f"c4:{marked[i : i + 4]}" for i in range(len(marked) - 3) if len(word) >= 5]
            for f in own:
                h = int.from_bytes(hashlib.blake2b(f.encode(), digest_size=8).digest(), "little")
                v[h % 32] += -1.0 if h >> 63 else 1.0
        n = math.sqrt(sum(x * x for x in v)) or 1
        assert got[t] == pytest.approx([x / n for x in v])


def test_every_selected_option_counts(spark):
    from ledgerline.operators.records import action_entropy, full_bucket

    select = "named_struct('type', 'T', 'option', array(named_struct('index', 0L, 'type', 'A', 'label', 'a'), named_struct('index', 1L, 'type', 'B', 'label', 'b')))"
    df = spark.range(2).selectExpr(f"{select} as select", "array(0L, 1L) as selectedIndices")
    row = action_entropy(df, lambda kind, _: kind).where("prompt = '*'").first()
    assert (row["decisions"], row["bits"], row["modal"], row["modal_rate"]) == (4, 1.0, "A", 0.5)
    bucket = lambda t, p, **payload: spark.range(1).select(full_bucket(F.lit(t), F.lit(p), F.create_map(*(F.lit(x) for kv in payload.items() for x in kv)) if payload else F.lit(None).cast("map<string, string>"), F.lit(0))).first()[0]
    assert bucket("x", "TARGET", name="your land") == "PROMPT_TARGET_SELF" and bucket("x", "TARGET", ownerIndex="1") == "PROMPT_TARGET_OPPONENT_OBJECT"
    assert bucket("CAST_SPELL", None, rule="an Enchantment") == "CAST_NONCREATURE_PERMANENT" and bucket("prompt_keep", "TARGET") == "PROMPT_KEEP" and bucket("PROMPT_CARD", "x") == "OTHER"


def test_lines_lineage_and_windows(spark, tmp_path):
    from ledgerline.operators import boards as B
    from ledgerline.sources.files import read_lines

    spark.sparkContext.setCheckpointDir(f"file://{tmp_path}/c")
    chain = spark.createDataFrame([(1, k, k, k + 1) for k in range(20)] + [(2, 3, 5, 6), (2, 4, 7, 7)], "g long, t long, old long, new long")
    got = {(r["g"], r["object"]): (r["root"], r["lineage"]) for r in B.lineage(chain, ["g"], "t").collect()}
    assert got == {(1, k): (0, list(range(k + 1))) for k in range(1, 21)} | {(2, 6): (5, [5, 6])}
    # Ids that go round end; an id that was taken away and comes up again is another object; nulls say nothing.
    moves = spark.createDataFrame([(1, 1, 1, 2), (1, 2, 2, 1), (1, 5, 1, 3), (1, 7, 1, 4), (1, 9, 3, 2), (None, 1, 1, 2), (2, 1, 1, 2), (2, 1, 2, 3)], "g long, t long, old long, new long")
    said = spark.createDataFrame([(1, 0, 1, "a", 1), (1, 1, 2, None, 2), (1, 2, 2, "lost", 9), (1, 6, 1, "new", None), (1, 6, 3, None, 5), (1, 9, 3, "late", 9), (2, 0, 1, "z", None)], "g long, t long, object long, name string, n long")
    got = {(r["g"], r["t"], r["object"]): (r["root"], r["lineage"], r["name"], r["n"]) for r in B.lineage(moves.union(moves.limit(1)), ["g"], "t", said, ("name", "n")).collect()}
    assert {k: v for k, v in got.items() if k[0] == 1} == {(1, 1, 2): (1, [1, 2], "a", 1), (1, 2, 1): (1, [1, 2], "a", 2), (1, 5, 3): (1, [1, 2, 3], "a", 2), (1, 7, 4): (1, [1, 4], "new", None), (1, 9, 2): (1, [1, 2, 3], "a", 5)}
    assert got[2, 1, 3] == (1, [1, 2, 3], "z", None)
    assert B.lineage(moves.limit(0), ["g"], "t").collect() == []
    windows = spark.createDataFrame([(1, 0, ["a", "b"]), (1, 1, ["B", "c"]), (1, 2, ["B", "c"]), (1, 3, ["x"]), (1, 4, [])], "k long, t long, lines array<string>")
    assert [r["fresh"] for r in B.new_lines(windows, ["k"], "t").orderBy("t").collect()] == [["a", "b"], ["c"], [], ["x"], []]
    (tmp_path / "t.txt").write_text("".join(f"line {k}\n" for k in range(2000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        rows = read_lines(spark, f"file://{tmp_path}/t.txt")
        assert rows.where("value <> concat('line ', line - 1)").count() == 0 and rows.count() == 2000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_ontologies_are_checked(spark, tmp_path):
    from ledgerline.sources.files import ONTOLOGY_KIND, read_ontology

    cases = {"good": {"schemaVersion": 1, "kind": ONTOLOGY_KIND, "factors": [{"name": "a", "scale": 2}]}, "list": [{"name": "a"}, {"name": "b", "sign": -1}], "old": {"schemaVersion": 2, "factors": [{"name": "a"}]}, "twice": [{"name": "a"}, {"name": "a"}], "none": {"factors": []}}
    for name, value in cases.items():
        (tmp_path / name).write_text(json.dumps(value))
    read = lambda name: sorted(map(tuple, read_ontology(spark, f"file://{tmp_path}/{name}").collect()))
    assert read("good") == [("a", "identity", 2.0, 1)] and read("list") == [("a", "identity", 1.0, 1), ("b", "identity", 1.0, -1)]
    for name in ("old", "twice", "none"):
        with pytest.raises(Exception, match="ontology|factors"):
            read(name)


def moved(df):
    """Columns that enter each exchange of a plan."""
    import re

    text = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    return [re.findall(r"(\w+)#", x) for x in re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*?)\]\n", text)]


@pytest.mark.skipif(not Path(SF).exists(), reason="the driver's tables are not here")
def test_options_of_decisions_move_once(spark):
    from ledgerline.plans.views import decisions

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        columns = moved(decisions(spark, SF))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert columns and not [c for c in columns if {"l_tax", "score_b", "option"} & set(c)]
    rows = {r["decision"]: r for r in decisions(spark, SF).collect()}
    assert all([o["index"] for o in r["select"]["option"]] == list(range(len(r["select"]["option"]))) for r in rows.values())
    last = [r for r in rows.values() if r["terminal"]]
    assert len(last) == len({r["gameId"] for r in rows.values()}) and all(r["sequenceNumber"] == max(x["sequenceNumber"] for x in rows.values() if x["gameId"] == r["gameId"]) for r in last)


@pytest.mark.skipif(not Path(SF).exists(), reason="the driver's tables are not here")
def test_causal_deltas_move_what_they_read(spark):
    from ledgerline.operators import boards as B
    from ledgerline.plans.board_queries import boards

    own = F.col("state")
    rows = boards(spark, SF).limit(50).select(B.causal_deltas(own, own.withField("turn_number", F.lit(9)), F.lit("0"), F.lit(True)).alias("whole"), B.causal_parts(own).alias("p"))
    rows = rows.select("whole", B.causal_deltas(F.col("p"), F.col("p").withField("turn_number", F.lit(9)), F.lit("0"), F.lit(True)).alias("parts")).collect()
    assert rows and all(r["whole"] == r["parts"] for r in rows) and len(B.causal_parts.__doc__) > 0
    assert set(boards(spark, SF).select(B.causal_parts(own)["objects"][0].alias("o")).schema["o"].dataType.names) == {"zone", "power", "toughness", "tapped"}


@pytest.mark.skipif(not Path(SF).exists(), reason="the driver's tables are not here")
def test_state_rows_move_no_states(spark):
    from ledgerline.plans.board_queries import state_rows

    assert not [c for c in moved(state_rows(spark, SF)) if {"state", "raw", "option"} & set(c)]


@pytest.mark.skipif(not Path(SF).exists(), reason="the driver's tables are not here")
def test_states_are_written_compressed(spark):
    from ledgerline.plans.board_queries import read_canonical_states

    written = read_canonical_states(spark, SF).inputFiles()
    assert written and all(f.endswith(".gz") for f in written)
