"""Examples, uploads, catalogues and labels by their rules, on small rows with what can be wrong in them."""

import json
import random

import pytest
from pyspark.sql import functions as F

RECORD = "gameId string, sequenceNumber long, playerIndex long, select struct<type: string, minCount: long, maxCount: long, option: array<struct<index: long, type: string, label: string, key: long>>>, selectedIndices array<long>, source string, state string"


def record(options, selected, least=1, most=1, state="a id=3  b"):
    return ("g", 1, 0, ("P", least, most, options), selected, None, state)


def test_examples_tell_why_there_is_none(spark):
    from ledgerline.operators import examples as E

    two = [(0, "CAST", "Bolt", 7), (1, "PASS", None, None), (2, "CAST", "Bolt", 7)]
    rows = [record(two, [2]), record([], [0]), record(None, [0]), record(two, []), record(two, [3]), record(two, [-1]), record(two, [0, 1]), record(two, None), record(two, [1], 0, 2)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"n long, {RECORD}")
    reason = lambda d: [r["reason"].removeprefix("discarded_").removeprefix("skipped_") for r in d.orderBy("n").collect()]
    multi, none, bad = "multi_select", "no_options", "invalid"
    assert reason(E.compiled(df, F.col("state"))) == ["compiled", none, none, multi, bad, bad, multi, multi, multi]
    assert reason(E.compiled(df, F.col("state"), only_single=False)) == ["compiled", none, none, bad, bad, bad, "compiled", bad, "compiled"]
    e = E.compiled(df, F.col("state")).orderBy("n").first()["example"]
    assert (e["promptType"], e["optionTypes"], e["stateText"], e["chosenIndex"]) == ("P", ["CAST", "PASS", "CAST"], "a b", 2) and e["optionTexts"][1] == "type=PASS"
    ranked = E.ranked(df, F.col("state"))
    assert reason(ranked) == ["kept", none, none, "multi_or_no_select", "bad_index", "bad_index", "multi_or_no_select", "multi_or_no_select", "kept"]
    assert ranked.orderBy("n").first()["example"]["groups"] == [[0, 2], [1]] and ranked.orderBy("n").first()["example"]["chosenGroup"] == 0
    bench = E.benchmark_rows(df, F.lit("{}"), F.lit(None).cast("string"), F.col("n"), F.lit(None)).orderBy("index").collect()
    assert [r["eligible"] for r in bench] == [True] + [False] * 7 + [True] and bench[0]["chosen_group"] == "CAST|7" and bench[1]["bucket"] == "0-1"
    assert bench[3]["cluster"] == "decision-3" and bench[3]["source"] == "unknown" and bench[3]["occurrence"].endswith("#3")


def align(candidates, chosen):
    used = []
    for card in chosen:
        found = next((i for i, c in enumerate(candidates) if c == card and i not in used), None)
        if found is None:
            return None
        used.append(found)
    return used


def unrolled(pool, deck):
    """By the rule, card by card."""
    left, rest, built, steps = list(pool), list(deck), [], []
    for card in deck:
        if card in left:
            found = align(left, [c for c in rest if c in left])
            if found is None:
                return None
            steps.append((list(built), list(left), found))
            left.remove(card)
        built.append(card)
        rest.remove(card)
    return steps


def test_decks_are_unrolled_card_by_card(spark):
    from ledgerline.operators.examples import selections

    random.seed(11)
    schema = "n long, kind string, source string, draft string, match string, pack long, pick long, cards array<long>, picked array<long>, pool array<long>, deck array<long>, offered array<long>, side array<long>, chosen array<long>, step string, context string"
    some = lambda n: [random.randrange(5) for _ in range(random.randint(0, n))]
    rows, want = [], []
    for n in range(60):
        pool, deck = some(8), some(7)
        rows.append((n, "deckBuild", "s", "d", None, 1, 2, None, None, pool or None, deck, None, None, None, "x", "y"))
        steps = unrolled(pool, deck) if pool else None
        why = "skipped_build_without_pool" if not pool else "skipped_unaligned_build" if steps is None else "examples_deckBuild"
        want += [(n, why, *s) for s in steps] if steps else [(n, why, None, None, None)]
    blank = [None] * 7
    rows += [(100, "draftPick", "s", "d", None, 1, 2, [5, 6, 5], [5, 5], [9], *blank[:4], "x", "y"), (101, "draftPick", "s", "d", None, 1, 2, [5], [6], [], *blank[:4], "x", "y"), (102, "draftPick", "s", "d", None, 1, 2, None, None, None, *blank[:4], "x", "y"), (103, "draftPick", "s", "d", None, 1, 2, [5], [], None, *blank[:4], "x", "y")]
    rows += [(104, "sideboard", "s", None, "m", 1, 2, *blank[:4], [1, 2], [2, 3], [2, 2, 3], "x", "y"), (105, "sideboard", "s", None, "m", 1, 2, *blank[:4], None, None, [1], "x", "y"), (106, None, *[None] * 12, "x", "y")]
    want += [(100, "examples_draftPick", [9], [5, 6, 5], [0, 2]), (101, "skipped_unaligned_pick", None, None, None), (102, "skipped_unaligned_pick", None, None, None), (103, "skipped_unaligned_pick", None, None, None)]
    want += [(104, "examples_sideboard", [1, 2], [1, 2, 2, 3], [1, 2, 3]), (105, "skipped_unaligned_sideboard", None, None, None), (106, "skipped_unknown_kind", None, None, None)]
    got = [(r["n"], r["reason"], r["context"], r["candidates"], r["positives"]) for r in selections(spark.createDataFrame(rows, schema), ["n"]).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_envelopes_fail_at_their_first_fault(spark):
    from ledgerline.operators.uploads import envelope_error

    good = {"kind": "k", "consent": {"allowTraining": True}, "decisions": [{"observation": {"a": 1}, "selected": [1]}], "manifest": {}, "redactionReport": {"rawPlayerLogUploaded": False}}
    cases = [
        ("null", "BAD_ENVELOPE", None), ("0", "BAD_ENVELOPE", None), ("[]", "BAD_KIND", None), (good | {"kind": 3}, "BAD_KIND", None), (good | {"consent": None}, "NO_TRAINING_CONSENT", None),
        (good | {"consent": {"allowTraining": "true"}}, "NO_TRAINING_CONSENT", None), (good | {"consent": {"allowTraining": True, "allowPublicAggregateStats": None}}, "BAD_CONSENT", None), (good | {"decisions": {}}, "NO_DECISIONS", None),
        (good | {"decisions": []}, "BAD_RECORD_COUNT", None), (good | {"decisions": good["decisions"] * 4}, "BAD_RECORD_COUNT", None), (good | {"manifest": ""}, "NO_MANIFEST", None), (good | {"manifest": []}, None, None), (good | {"redactionReport": {}}, "RAW_LOG_UPLOAD_REJECTED", None),
        (good | {"decisions": [good["decisions"][0], None, 5]}, "BAD_DECISION", 1), (good | {"decisions": [{"observation": 0, "select": ""}]}, "DECISION_NO_PROMPT", 0), (good | {"decisions": [{"select": [], "selectedIndices": 0, "selected": []}]}, None, None),
        (good | {"decisions": [{"select": [], "selectedIndices": {}, "selected": []}]}, "DECISION_NO_SELECTION", 0), (good, None, None),
    ]
    df = spark.createDataFrame([(i, t if isinstance(t, str) else json.dumps(t)) for i, (t, _, _) in enumerate(cases)], "n long, t string")
    rows = df.select("n", envelope_error(F.try_parse_json("t"), "k", 3).alias("e")).select("n", "e.error", "e.index").orderBy("n").collect()
    assert [(r["error"], r["index"]) for r in rows] == [c[1:] for c in cases]


def test_envelopes_are_redacted_and_bounded(spark, tmp_path):
    from ledgerline.operators.uploads import envelope_error, envelopes, new_uploads

    spark.sparkContext.setCheckpointDir(f"file://{tmp_path}/c")
    decisions = spark.createDataFrame([("a", i, json.dumps({"select": {"name": "x"}, "selected": [0], "email": "e"})) for i in range(4)] + [("c", 0, "{}")], "bundle string, at long, record string")
    bundles = spark.createDataFrame([("a", 'q"', 5, True, None, '{"title":"t","x":1}', '{"gameIds":["g"]}'), ("b", None, None, True, True, None, None), ("c", None, 1, None, None, "{}", None)], "bundle string, contributor string, created long, consent boolean, stats boolean, summary string, manifest string")
    got = {r["bundle"]: r for r in envelopes(decisions, bundles, "bundle", "at", "record", "k", 3).collect()}
    assert (got["b"]["error"], got["c"]["error"], got["b"]["envelope"]) == ("NO_DECISIONS", "NO_CONSENT", None)
    e = json.loads(got["a"]["envelope"])
    assert e["contributorId"] == 'q"' and e["summary"] == {"title": "<redacted>", "x": 1} and e["manifest"]["gameIds"][0].startswith("id_") and len(e["decisions"]) == 3 and e["source"]["truncated"] is True
    assert e["decisions"][0] == {"select": {"name": "x"}, "selected": [0], "email": "<redacted>"} and e["consent"]["allowPublicAggregateStats"] is False
    assert spark.createDataFrame([(got["a"]["envelope"],)], "t string").select(envelope_error(F.parse_json("t"), "k", 3).alias("e")).first()["e"] is None
    ups = spark.createDataFrame([("x", 1), ("x", 2), ("y", 3), ("z", 4)], "id string, n long")
    assert sorted(r["n"] for r in new_uploads(ups, spark.createDataFrame([("y",), ("y",)], "id string"), "id", "n").collect()) == [1, 4]


def test_catalogues_are_checked_and_enrich_no_hidden_card(spark, tmp_path):
    from ledgerline.operators import catalog as C

    (tmp_path / "a").write_text(json.dumps({"ok": True, "cards": [{"cardId": 1, "name": "Bear", "types": ["Creature"], "power": "2", "colors": "G"}, {"cardId": 2, "name": "Bear"}, {"cardId": 3}]}))
    cards = C.read_cards(spark, f"file://{tmp_path}/a")
    assert {r["name"]: r["cardId"] for r in C.first_printings(cards).collect()} == {"Bear": 1}
    objects = spark.createDataFrame([(1, 1, None, None, 2), (2, 1, True, None, 2), (3, None, None, 1, 2), (4, 9, False, 1, 2), (5, 1, False, 5, None), (6, 0, False, None, 1)], "n long, card long, face_down boolean, power int, source_card long").withColumn("toughness", F.lit(None).cast("int"))
    got = {r["n"]: (r["name"], r["face_down"], r["power"], r["source_name"], r["colors"]) for r in C.enriched(objects, cards).collect()}
    assert got == {1: ("Bear", False, 2, "Bear", "G"), 2: (None, True, None, None, None), 3: (None, True, 1, None, None), 4: (None, True, 1, "Bear", None), 5: ("Bear", False, 5, None, "G"), 6: (None, True, None, None, None)}
    seen = spark.createDataFrame([("m", "BATTLEFIELD", 1, 1, "GW"), ("m", "HAND", 1, 1, "R"), ("m", "GRAVEYARD", 2, 1, "U"), ("m", "GRAVEYARD", None, 1, "B"), ("n", "BATTLEFIELD", 1, None, "R"), ("n", "BATTLEFIELD", 1, None, None)], "match string, zone string, controller long, seat long, colors string")
    assert {(r["match"], r["side"]): r["colors"] for r in C.colors_seen(seen).collect()} == {("m", "you"): "WG", ("m", "opponent"): "U", ("n", "opponent"): "R"}
    for text, why in (("[1]", "JSON object"), ('{"ok": 1, "cards": []}', "not ok"), ('{"ok": false, "error": "late"}', "late"), ('{"ok": true, "cards": {}}', "no list")):
        (tmp_path / "bad").write_text(text)
        with pytest.raises(Exception, match=why):
            C.read_cards(spark, f"file://{tmp_path}/bad").collect()


def test_labels_are_masked_and_checked(spark):
    from ledgerline.operators import labels as L

    decisions = spark.createDataFrame([(i,) for i in range(4)], "n long")
    said = lambda b, **m: json.dumps({"visibility": "oracle-label-only", "source": "s", "belief": b} | m)
    labels = spark.createDataFrame([(0, said({"a": 1, "b c": False})), (1, said({"a": None})), (2, said(None, visibility="x"))], "n long, t string").select("n", F.parse_json("t").alias("payload"))
    rows = L.belief_labels(decisions, labels, ["n"], ["a", "b c"]).orderBy("n").collect()
    assert [(r["target"], r["mask"], r["label_source"]) for r in rows] == [([1.0, 0.0], [True, True], "s"), ([0.0, 0.0], [False, False], "s"), ([0.0, 0.0], [False, False], "s"), ([0.0, 0.0], [False, False], "unlabeled")]
    for bad, why in ((said({"a": 2}), "binary"), (said({"a": "1"}), "binary"), (said({"a": 1}, source=""), "source"), (said({"a": 1}, visibility="all"), "only"), (said([1]), "object")):
        with pytest.raises(Exception, match=why):
            L.belief_labels(decisions, spark.createDataFrame([(0, bad)], "n long, t string").select("n", F.parse_json("t").alias("payload")), ["n"], ["a"]).collect()
    good = {"id": 7, "left": {"id": "x", "factors": {"life": 1}}, "right": {"label": "y", "factors": {}}, "preferred": "L"}
    cases = [(good, [], "left"), (good | {"preferred": -3}, [], "right"), (good | {"preferred": True}, ["preferred must be left, right or tie"], None), (good | {"weight": None, "confidence": 0}, [], "left"), (good | {"confidence": "1", "weight": -1, "left": None}, ["left: no candidate", "confidence must be in [0, 1]", "weight must be finite and positive"], "left")]
    df = spark.createDataFrame([(i, json.dumps(c[0])) for i, c in enumerate(cases)], "n long, t string").withColumn("v", F.parse_json("t"))
    rows = df.select("n", L.preference_errors(F.col("v"), ["life"]).alias("e"), L.preferred_side(F.try_variant_get("v", "$.preferred", "variant")).alias("p")).orderBy("n").collect()
    assert [(r["e"], r["p"]) for r in rows] == [c[1:] for c in cases]


def test_long_decks_are_unrolled_in_time(spark):
    import time

    from ledgerline.operators.examples import selections

    random.seed(5)
    pool = [random.randrange(45) for _ in range(90)]
    deck = [99, *random.sample(pool, 60), 99]
    nothing = {k: None for k in ("cards", "picked", "offered", "side", "chosen")}
    schema = "n long, kind string, source string, draft string, match string, pack long, pick long, cards array<long>, picked array<long>, pool array<long>, deck array<long>, offered array<long>, side array<long>, chosen array<long>"
    rows = spark.createDataFrame([{"n": n, "kind": "deckBuild", "source": "s", "draft": "d", "match": None, "pack": 1, "pick": 2, "pool": pool, "deck": deck, **nothing} for n in range(4)], schema)
    began = time.time()
    got = selections(rows, ["n"]).orderBy("n", "step").collect()
    assert time.time() - began < 30
    assert [(r["context"], r["candidates"], r["positives"]) for r in got] == unrolled(pool, deck) * 4


def test_preferences_are_parsed_once(spark):
    from ledgerline.plans.example_queries import check_preferences

    plan = check_preferences(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.count("parsejson") + plan.count("parse_json") == 1
