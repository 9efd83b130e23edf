"""Folded games: state messages, snapshots by intervals, waiting prompts, and the same over several runs of a stream."""

import json
import random

from pyspark.sql import functions as F

ROWS = "match string, position long, kind string, text string, at timestamp"


def state(**m):
    return "state", json.dumps(m)


def obj(key, **m):
    return {"instanceId": key, **m}


def held(rows, match="m"):
    """The records after the last message, by (kind, id)."""
    out = {}
    for r in sorted(rows, key=lambda r: r["position"]):
        if r["match"] == match:
            out[r["kind"], r["id"]] = None if r["record"] is None else json.loads(r["record"])
    return {k: v for k, v in out.items() if v is not None}


def test_board_follows_full_and_partial_messages(spark):
    from ledgerline.streaming.boards import Board
    from ledgerline.streaming.keyed import folded

    told = [
        ("seat", json.dumps({"seat": 2})),
        ("names", json.dumps({"players": [{"seat": 1, "name": "Ann#12"}, {"seat": 2, "name": ""}]})),
        state(type="GameStateType_Full", gameStateId=5, gameObjects=[obj(1, grpId=70, ownerSeatId=1, power={"value": "3"}, attackState="AttackState_Attacking"), obj(2)], players=[{"systemSeatNumber": 1, "startingLifeTotal": 20}], turnInfo={"turnNumber": 1, "phase": "a"}),
        state(gameObjects=[obj(1, isTapped=True, counters=[{"type": "x", "count": 2}, {"type": "x", "count": "1"}, {}])], zones=[{"zoneId": 9, "type": "ZoneType_Hand", "ownerSeatId": 1, "objectInstanceIds": [1, "no", 2]}, {"zoneId": 8, "objectCount": 3}, {"type": "none"}], players=[{"systemSeatNumber": 1, "lifeTotal": 17}, {"systemSeatNumber": 1}]),
        state(annotations=[{"type": ["AnnotationType_ObjectIdChanged"], "details": [{"key": "orig_id", "valueInt32": [1]}, {"key": "new_id", "valueInt32": [31]}]}, {"type": None}], turnInfo={"turnNumber": 2}),
        state(annotations=[{"type": ["AnnotationType_ObjectIdChanged"], "details": [{"key": "orig_id", "valueInt32": [31]}, {"key": "new_id", "valueInt32": [41]}]}], diffDeletedInstanceIds=[2, 99], gameInfo={"gameId": "g", "stage": "GameStage_GameOver"}),
    ]
    rows = [("m", i, k, t, None) for i, (k, t) in enumerate(told)] + [("empty", 0, "state", "{}", None), (None, 1, "state", "{}", None)]
    got = folded(spark.createDataFrame(rows, ROWS).repartition(3), Board).collect()
    now = held(got)
    assert now["object", 41] == {"card": 70, "owner": 1, "power": 3, "attack_state": "AttackState_Attacking", "tapped": True, "counters": {"x": 3}, "lineage": [1, 31, 41]}
    assert set(now) == {("object", 41), ("zone", 9), ("zone", 8), ("player", 1), ("game", 0)}
    assert now["zone", 9]["objects"] == [1, 2] and now["zone", 9]["name"] == "HAND" and now["zone", 8] == {"objects": [], "count": 3, "name": "UNKNOWN"}
    assert now["player", 1] == {"name": "Ann", "life": 17}
    assert now["game", 0] == {"seat": 2, "state_id": 8, "game_id": "g", "over": True, "turn": 2, "phase": "a"}
    assert held(got, "empty") == {("game", 0): {"state_id": 1, "game_id": None, "over": False}} and not held(got, None)
    again = [*rows[:6], ("m", 6, *state(type="GameStateType_Full", gameStateId=1), None)]
    assert held(folded(spark.createDataFrame(again, ROWS), Board).collect()) == {("player", 1): {"name": "Ann"}, ("game", 0): {"seat": 2, "state_id": 1, "game_id": None, "over": False}}
    # A known card that is there already stays; an unknown object is replaced.
    for card, kept in ((5, 5), (None, 4)):
        both = [state(gameObjects=[obj(1, grpId=4), obj(2, grpId=card)]), state(annotations=[{"type": ["AnnotationType_ObjectIdChanged"], "details": [{"key": "orig_id", "valueInt32": [1]}, {"key": "new_id", "valueInt32": [2]}]}])]
        now = held(folded(spark.createDataFrame([("m", i, k, t, None) for i, (k, t) in enumerate(both)], ROWS), Board).collect())
        assert now["object", 2]["card"] == kept and ("object", 1) not in now


def random_messages(games=5, length=30):
    random.seed(4)
    rows = []
    for i in range(length):
        for g in range(games):
            k = random.randrange(6)
            m = {"type": "GameStateType_Full" if random.random() < 0.1 else "GameStateType_Diff"}
            m |= random.choice([{"gameObjects": [obj(k, grpId=k or None, isTapped=random.choice([True, None]))]}, {"diffDeletedInstanceIds": [k]}, {"zones": [{"zoneId": k, "type": "ZoneType_Stack", "objectInstanceIds": [k, k + 1]}]}, {"annotations": [{"type": ["AnnotationType_ObjectIdChanged"], "details": [{"key": "orig_id", "valueInt32": [k]}, {"key": "new_id", "valueInt32": [k + 3]}]}]}])
            rows.append((f"g{g}", i, "state", json.dumps(m), 1000 + i * 60))
    return rows


def run_stream(spark, folder, df, make):
    """One run over what has arrived; the number of state rows after it."""
    from ledgerline.streaming import keyed

    df.write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(ROWS).parquet(f"{folder}/in").withWatermark("at", "1 minute")
    with keyed.state_on_disk(spark):
        query = keyed.folded(stream, make).writeStream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).format("parquet").option("path", f"{folder}/out").start()
        query.awaitTermination()
    return query.lastProgress["stateOperators"][0]["numRowsTotal"]


def test_runs_of_a_stream_equal_the_plain_fold(spark, tmp_path):
    from ledgerline.streaming.boards import Board
    from ledgerline.streaming.keyed import folded

    df = spark.createDataFrame(random_messages(), "match string, position long, kind string, text string, at long").withColumn("at", F.timestamp_seconds(F.col("at") + 1000))
    folder = f"file://{tmp_path}"
    for low, high in ((0, 10), (10, 11), (11, 30)):
        assert run_stream(spark, folder, df.where(f"position >= {low} and position < {high}"), Board) > 0
    want = folded(df, Board)
    assert sorted(map(tuple, spark.read.parquet(f"{folder}/out").collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    # Long after the last message of all games but one, their state is gone.
    late = spark.createDataFrame([("late", 0, "state", "{}", 90_000), ("late", 1, "state", "{}", 90_060)], "match string, position long, kind string, text string, at long").withColumn("at", F.timestamp_seconds(F.col("at") + 1000))
    run_stream(spark, folder, late.where("position = 0"), Board)
    assert run_stream(spark, folder, late.where("position = 1"), Board) <= 3  # one game's record, its timer and the timer's place


def test_snapshots_look_up_intervals(spark):
    from ledgerline.operators import snapshots as Z
    from ledgerline.streaming.boards import Board
    from ledgerline.streaming.keyed import folded

    df = spark.createDataFrame([r[:4] for r in random_messages()], "match string, position long, kind string, text string")
    rows = folded(df, Board)
    asked = df.select("match", "position")
    got = {}
    for r in Z.holding(Z.intervals(rows), asked).collect():
        got.setdefault((r["match"], r["position"]), {})[r["kind"], r["id"]] = json.loads(r["record"])
    every = rows.collect()
    for (match, position), now in got.items():
        assert now == held([r for r in every if r["position"] <= position], match)
    assert len(got) == df.count()
    # Hands of others are hidden, and all of them while the seat is unknown.
    m = {"gameObjects": [obj(1, grpId=7, ownerSeatId=1), obj(2, grpId=8, ownerSeatId=2), obj(3, ownerSeatId=2)], "zones": [{"zoneId": s, "type": "ZoneType_Hand", "ownerSeatId": s, "objectInstanceIds": [s]} for s in (1, 2)] + [{"zoneId": 4, "type": "ZoneType_Battlefield", "objectInstanceIds": [2, 3, 77]}, {"zoneId": 5, "type": "ZoneType_Library", "ownerSeatId": 1, "objectCount": 33}], "players": [{"systemSeatNumber": 1, "lifeTotal": 9}]}
    two = spark.createDataFrame([("a", 0, *state(**m)), ("b", 0, *state(**m, systemSeatIds=[1]))], "match string, position long, kind string, text string")
    held_ = Z.intervals(folded(two, Board))
    view = {(r["match"], r["zone_id"], r["place"]): (r["card"], r["face_down"], r["owner"]) for r in Z.snapshot_objects(held_, two).collect()}
    assert view["b", 1, 0] == (7, False, 1) and view["b", 2, 0] == view["a", 2, 0] == (None, True, 2) and view["a", 1, 0] == (None, True, 1)
    assert view["a", 4, 0] == (8, False, 2) and view["a", 4, 1] == (None, True, 2) and view["a", 4, 2] == (None, True, None)
    player = Z.snapshot_players(held_, two).where("match = 'b'").first()
    assert (player["name"], player["life"], player["library"], player["hand"]) == ("Seat 1", 9, 33, 1)


def plain_pending(rows):
    out, waiting = [], {}
    for match, position, kind, text, _ in sorted(rows, key=lambda r: (r[0], r[1])):
        w = waiting.setdefault(match, [])
        if kind in ("game", "over"):
            w.clear()
        elif kind == "prompt":
            w.append((position, json.loads(text)["id"]))
            del w[:-8]
        else:
            found = next((p for p in w if p[1] == json.loads(text)["id"]), None)
            if found:
                w.remove(found)
                out.append((match, position, found[0]))
    return sorted(out)


def test_waiting_prompts_are_bounded_and_leave_no_state(spark, tmp_path):
    from ledgerline.streaming.boards import Pending
    from ledgerline.streaming.keyed import folded

    random.seed(9)
    rows = [("full", i, "prompt", json.dumps({"id": i}), i) for i in range(12)] + [("full", 12 + i, "answer", json.dumps({"id": i}), 12 + i) for i in range(12)]
    for m in ("x", "y", "z"):
        rows += [(m, i, *random.choice([("prompt", json.dumps({"id": random.randrange(20)}))] * 6 + [("answer", json.dumps({"id": random.randrange(20)}))] * 3 + [("game", "{}")]), i) for i in range(300)]
    df = spark.createDataFrame(rows, "match string, position long, kind string, text string, at long").withColumn("at", F.timestamp_seconds(F.col("at") + 1000))
    want = plain_pending(rows)
    found = lambda d: sorted((r["match"], r["position"], r["id"]) for r in d.collect())
    assert found(folded(df, Pending)) == want and len([w for w in want if w[0] == "full"]) == 8
    folder = f"file://{tmp_path}"
    for low, high in ((0, 100), (100, 180), (180, 300)):
        run_stream(spark, folder, df.where(f"position >= {low} and position < {high}"), Pending)
    ends = spark.createDataFrame([(m, 400, "over", "{}", 400) for m in ("full", "x", "y", "z")], "match string, position long, kind string, text string, at long").withColumn("at", F.timestamp_seconds(F.col("at") + 1000))
    left = run_stream(spark, folder, ends, Pending)
    assert found(spark.read.parquet(f"{folder}/out")) == want
    assert left == 0


def test_consensus_takes_equal_sums_as_equal(spark):
    from pyspark.sql import functions as F

    from ledgerline.operators.sequences import consensus

    # 10.1 + 20.2 is 30.299999999999997: as great as 30.3, and of two rows.
    rows = spark.createDataFrame([("g", 0, 1, 10.1), ("g", 1, 1, 20.2), ("g", 2, 0, 30.3)], "game string, seq long, v long, s double")
    last = consensus(rows, ["game"], ["seq"], "v", "s").orderBy(F.desc("seq")).first()
    assert last["agreed"] == 1 and abs(last["confidence"] - (0.55 * 30.3 / 2 + 0.45 * 2 / 3)) < 1e-9


def test_positions_at_every_level_are_not_broadcast(spark):
    from ledgerline.operators.snapshots import holding

    held = spark.createDataFrame([("m", "zone", 1, 0, 4, "a"), ("m", "zone", 1, 4, None, "b")], "match string, kind string, id long, start long, stop long, record string")
    asked = spark.createDataFrame([("m", 3), ("m", 9)], "match string, position long")
    now = holding(held, asked)
    assert "Broadcast" not in now._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["position"], r["record"]) for r in now.collect()) == [(3, "a"), (9, "b")]
    assert "Broadcast" not in now._jdf.queryExecution().executedPlan().toString()
