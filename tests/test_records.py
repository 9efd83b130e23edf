"""Decision records, sequences, joins and statistics on small fixtures."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

OPTION = "array<struct<index: bigint, type: string, label: string>>"
RECORD = f"source string, gameId string, sequenceNumber long, select struct<type: string, minCount: bigint, maxCount: bigint, option: {OPTION}>, selectedIndices array<bigint>"


def options(*types):
    return [(i, t, f"label {t}") for i, t in enumerate(types)]


@pytest.fixture(scope="module")
def records(spark):
    rows = [
        ("search", "g1", 0, ("PRIORITY", 1, 1, options("PASS", "CAST_SPELL")), [1]),
        ("search", "g1", 1, ("PRIORITY", 1, 1, options("PASS", "PLAY_LAND")), [0]),
        ("search", "g1", 2, ("PRIORITY", 0, 2, options("PROMPT_MANA_POOL", "PROMPT_X")), []),
        ("elsewhere", "g2", 0, ("DECLARE_BLOCKERS", 1, 2, options("A", "B", "C")), [2, 2, 9]),
        (None, "g2", 1, None, None),
    ]
    return spark.createDataFrame(rows, RECORD)


def test_selected_options_and_passes(records):
    from ledgerline.operators import records as R

    out = {(r["gameId"], r["sequenceNumber"]): r for r in records.select("*", R.selected_options(records).alias("s"), R.is_pass(records).alias("p"), R.describe(records).alias("d")).collect()}
    assert [o["type"] for o in out["g2", 0]["s"]] == ["C", "C"]
    assert [out["g1", k]["p"] for k in range(3)] == [False, True, True]
    assert out["g1", 0]["d"] == "decision #0 PRIORITY -> label CAST_SPELL"


def test_validation_messages(records):
    from ledgerline.operators import records as R

    df = records.withColumn("schemaVersion", F.lit(1))
    out = {(r["gameId"], r["sequenceNumber"]): r["m"] for r in df.select("gameId", "sequenceNumber", R.validate(df).alias("m")).collect()}
    assert out["g1", 0] == [] and out["g1", 2] == []
    assert out["g2", 0] == ["source is not a canonical label", "index out of range", "duplicate index", "too many selected"]
    assert "missing select block" in out["g2", 1] and "selectedIndices is missing" in out["g2", 1]


@pytest.mark.parametrize(("selected", "n", "least", "most", "want"), [([5, 1, 1, -2], 3, 1, 1, [1]), ([], 3, 2, 2, [0, 1]), ([2], 3, 2, 0, [2, 0]), ([0, 1, 2], 3, 1, 2, [0, 1]), ([], 0, 1, 1, [])])
def test_clamped_selections_are_legal(spark, selected, n, least, most, want):
    from ledgerline.operators import records as R

    df = spark.createDataFrame([(selected, n, least, most)], "s array<bigint>, n bigint, a bigint, b bigint")
    got = df.select(R.clamp(F.col("s"), F.col("n"), F.col("a"), F.col("b")).alias("c"), "n", "a", "b")
    assert got.first()["c"] == want
    if n >= least:
        assert got.select(R.is_legal(F.col("c"), F.col("n"), F.col("a"), F.col("b"))).first()[0]


def test_small_buckets(spark):
    from ledgerline.operators import records as R

    cases = {("PASS", "X"): "PASS", ("PROMPT_ATTACKER", None): "ATTACK", ("YES", "DECLARE_BLOCKERS"): "BLOCK", ("PROMPT_MANA_POOL", "X"): "MANA_PAYMENT", ("PROMPT_KEEP", "X"): "MULLIGAN", ("PROMPT_CARD", "X"): "TARGET_OR_CHOICE", (None, None): "OTHER"}
    df = spark.createDataFrame([(*k, v) for k, v in cases.items()], "t string, p string, want string")
    assert df.where(R.small_bucket(F.col("t"), F.col("p")) != F.col("want")).count() == 0


def test_entropy_of_distributions(records):
    from ledgerline.operators import records as R

    out = {r["prompt"]: r for r in R.action_entropy(records).collect()}
    assert out["PRIORITY"]["decisions"] == 2 and out["PRIORITY"]["bits"] == 1.0 and out["PRIORITY"]["modal"] == "CAST_SPELL"
    assert out["*"]["decisions"] == 4 and out["*"]["modal_rate"] == 0.5  # the decision of two picks counts twice


def test_sequences(spark):
    from ledgerline.operators import sequences as S

    df = spark.createDataFrame([("g", 0, "a", 1.0), ("g", 1, "a", 2.0), ("g", 2, "b", None), ("g", 3, "a", 5.0), ("h", 0, "b", 9.0)], "game string, seq long, zone string, x double")
    assert [(r["seq"], r["next"]["seq"]) for r in S.transitions(df, ["game"], ["seq"], ["seq"]).orderBy("seq").collect()] == [(0, 1), (1, 2), (2, 3)]
    assert S.horizons(df, ["game"], ["seq"], ["seq"], (1, 3)).count() == 4
    assert sorted(r["seq"] for r in S.run_starts(df.where("game = 'g'"), ["game"], ["seq"], "zone").collect()) == [0, 2, 3]
    assert [r["c"] for r in S.carried(df, ["game"], ["seq"], F.col("x"), "c").orderBy("game", "seq").collect()] == [1.0, 2.0, 2.0, 5.0, 9.0]
    assert [r["i"] for r in S.instances(df, ["game"], ["seq"], "zone", "i").orderBy("game", "seq").collect()] == [1, 1, 2, 3, 1]
    assert [r["pool"] for r in S.pool(df, ["game"], ["seq"], "zone").orderBy("game", "seq").collect()] == [[], ["a"], ["a", "a"], ["a", "a", "b"], []]


def test_asof_prefers_after_then_nearest_before(spark):
    from ledgerline.operators.matching import asof

    times = lambda *xs: ", ".join(f"timestamp_seconds({x})" for x in xs)  # noqa: E731, F841
    left = spark.range(4).selectExpr("'k' as key", "id", "timestamp_seconds(element_at(array(100, 200, 300, 1000), cast(id + 1 as int))) as t")
    right = spark.range(3).selectExpr("'k' as key", "id as v", "timestamp_seconds(element_at(array(95, 200, 308), cast(id + 1 as int))) as t")
    got = {r["id"]: r["matched"] for r in asof(left, right, "key", "t", "v", 10).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: None}


def test_holm_is_step_down(spark):
    from ledgerline.operators.statistics import holm

    df = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", 0.9)], "name string, p double")
    got = {r["name"]: round(r["adjusted"], 6) for r in holm(df, "p", ["name"]).collect()}
    assert got == {"a": 0.04, "c": 0.09, "b": 0.09, "d": 0.9}


def test_whole_groups_are_held_out(spark):
    from ledgerline.operators.statistics import sample_n, split_groups

    df = spark.range(100).selectExpr("id", "id % 10 as g")
    out = split_groups(df, "g", 0.3)
    assert out.count() == 100 and out.where("held_out").select("g").distinct().count() == 3
    assert out.groupBy("g").agg(F.countDistinct("held_out").alias("n")).where("n > 1").count() == 0
    assert split_groups(df.where("g = 1"), "g", 0.3).where("held_out").count() == 0
    assert sample_n(df, 7, "id", 1).collect() == sample_n(df.repartition(5), 7, "id", 1).collect()


def test_preferences_are_learned(spark):
    from ledgerline.operators.statistics import fit_preferences

    df = spark.createDataFrame([(1.0, -0.2, 1.0), (0.5, 0.1, 2.0), (1.5, 0.3, 1.0)], "x double, y double, w double")
    x, y = fit_preferences(df, ["x", "y"], "w")
    assert x > 0.5 and x > y >= 0


def test_names(spark):
    from ledgerline.operators.matching import fuzzy, resolve_names

    cards = spark.createDataFrame([("Fire Bolt",), ("O'Neil's Gate",)], "card string")
    asked = spark.createDataFrame([("Fire Bolt",), ("fire  bolt",), ("O’Neil’s Gate",), ("Fire Bold",), ("zzz",)], "name string")
    out = {r["name"]: (r["resolved"], r["strategy"]) for r in resolve_names(asked, cards, "name", "card").collect()}
    assert out == {"Fire Bolt": ("Fire Bolt", "exact"), "fire  bolt": ("Fire Bolt", "normalized"), "O’Neil’s Gate": ("O'Neil's Gate", "normalized"), "Fire Bold": (None, "unresolved"), "zzz": (None, "unresolved")}
    assert {r["name"]: r["card"] for r in fuzzy(asked, cards, "name", "card").collect()}["Fire Bold"] == "Fire Bolt"


def test_greedy_match_equals_brute_force(spark, tmp_path):
    import random

    from ledgerline.operators.matching import greedy_match

    spark.sparkContext.setCheckpointDir(f"file://{tmp_path}/c")

    random.seed(4)
    big = 1 << 60  # ids and objects that a double cannot hold
    weights = {"zone": 0.5, "object": 0.4, "parity": 0.1}
    sides = [[(g, random.choice("ab"), big + i, random.choice([None, big, big + 1, big + 2]), random.choice([None, 0, 1])) for i, g in enumerate(random.choices([1, 2, 3], [60, 30, 1], k=n))] for n in (90, 70)]
    want = []
    for game in (1, 2, 3):
        left, right = ([r for r in side if r[0] == game] for side in sides)
        score = lambda a, b: sum(w for f, w in enumerate(weights.values()) if (x := (a[1], *a[3:])[f]) is not None and x == (b[1], *b[3:])[f])
        used_a, used_b = set(), set()
        for s, a, b in sorted((-score(a, b), a[2], b[2]) for a in left for b in right):
            if -s >= 0.25 and a not in used_a and b not in used_b:
                used_a.add(a)
                used_b.add(b)
                want.append((game, a, b, round(-s, 6)))
    expected, observed = (spark.createDataFrame(side, "game long, zone string, id long, object long, parity long") for side in sides)
    got = [(r["game"], r["expected_id"], r["observed_id"], round(r["score"], 6)) for r in greedy_match(expected, observed, ["game"], weights).collect()]
    assert sorted(got) == sorted(want)


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="the driver's tables are not here")
def test_object_match_takes_every_state(spark):
    from ledgerline.plans.registry import QUERIES

    import __spark_entry__  # noqa: F401

    pairs = QUERIES["object_match"](spark, "/root/testdata/sf0.001").collect()
    ids = sorted(r["event_id"] for r in spark.read.parquet("/root/testdata/sf0.001/events.parquet").collect())
    assert sorted(r["expected_id"] for r in pairs) == sorted(r["observed_id"] for r in pairs) == ids


@pytest.mark.parametrize("least", [0.5, 0.6, 0.72, 0.9])
def test_fuzzy_equals_brute_force(spark, least):
    import random

    from ledgerline.operators.matching import fuzzy

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, before = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
        return row[-1]

    random.seed(5)
    cards = ["Lightning", "Fire Bolt", "Fire Bolts", "Ow", "Ox", "X", "Hot Bolt", *{"".join(random.choices("abc ", k=random.randint(1, 14))).strip() or "q" for _ in range(60)}]
    asked = ["Lightnng", "Fir Bollt", "Ow", "Oz", "x", "", "zzzzzzzz", *{"".join(random.choices("abc ", k=random.randint(1, 14))).strip() or "q" for _ in range(60)}]
    plain = lambda t: " ".join(t.split()).lower()
    want = {}
    for n in asked:
        scores = sorted((-round(1 - edits(plain(n), plain(c)) / max(len(plain(n)), len(plain(c)), 1), 6), c) for c in cards)
        if -scores[0][0] >= least:
            want[n] = (scores[0][1], -scores[0][0])
    names, catalogue = (spark.createDataFrame([(x,) for x in rows], f"{c} string") for c, rows in (("name", asked), ("card", cards)))
    got = {r["name"]: (r["card"], r["score"]) for r in fuzzy(names, catalogue, "name", "card", least).collect()}
    assert got == want
    assert least > 0.72 or (got["Lightnng"][0], got["Fir Bollt"][0]) == ("Lightning", "Fire Bolt")


def test_fuzzy_compares_few_names_and_loses_none(spark):
    import random

    from ledgerline.operators.matching import fuzzy, fuzzy_candidates, normalised

    random.seed(6)
    words = ["".join(random.choices("etaoinshrdlu", k=random.randint(3, 8))) for _ in range(300)]
    cards = sorted({" ".join(["the", *random.choices(words, k=random.randint(1, 3))]) for _ in range(1500)})  # all share bigrams

    def misspelt(name):
        for _ in range(random.randint(0, 4)):
            i = random.randrange(len(name))
            name = name[:i] + random.choice(["", "x", "e", name[i] * 2]) + name[i + 1 :]
        return name

    asked = sorted({misspelt(random.choice(cards)) for _ in range(5200)})[:5000]
    names, catalogue = (spark.createDataFrame([(x,) for x in rows], f"{c} string") for c, rows in (("name", asked), ("card", cards)))
    a, b = names.select("name", normalised(F.col("name")).alias("a")), catalogue.select("card", normalised(F.col("card")).alias("b"))
    score = F.round(1 - F.levenshtein("a", "b") / F.greatest(F.length("a"), F.length("b")), 6)
    every = a.join(F.broadcast(b), F.lit(True)).withColumn("score", score).where("score >= 0.8")
    want = every.groupBy("name").agg(F.min_by("card", F.struct(-F.col("score"), "card")).alias("card"), F.max("score").alias("score"))
    assert sorted(map(tuple, fuzzy(names, catalogue, "name", "card", 0.8).collect())) == sorted(map(tuple, want.collect()))
    pairs = fuzzy_candidates(names, catalogue, "name", "card", 0.8).distinct().count()
    print(f"candidates a name: {pairs / len(asked):.1f} of {len(cards)}")
    assert pairs / len(asked) < len(cards) / 20


def test_pools_equal_brute_force(spark):
    import random

    from ledgerline.operators.matching import pool_overlap

    random.seed(8)
    pools = [(p, p // 3, c) for p in range(60) for c in {0, *random.sample(range(80), random.randint(1, 12))}]  # all hold card 0
    decks = [(d, c) for d in range(200) for c in random.choices([0, *range(90)], k=random.randint(1, 9))] + [(500, 0)] * 30 + [(501, 999)]
    ids = {c for _, _, c in pools}
    want = []
    for d in {d for d, _ in decks}:
        own = {c for x, c in decks if x == d} & ids
        shared = sorted((-len(own & {c for p, _, c in pools if p == pool}), pool // 3, pool) for pool in range(60))
        if -shared[0][0] * 2 >= len(own) > 0:
            want.append((d, shared[0][2], -shared[0][0]))
    got = pool_overlap(spark.createDataFrame(decks, "deck long, card long"), spark.createDataFrame(pools, "pool long, at long, card long"), "deck", "pool", "card", "at")
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 50


def test_redaction_equals_the_recursive_rule(spark, tmp_path):
    import json
    import random

    from ledgerline.operators import redaction as D

    spark.sparkContext.setCheckpointDir(f"file://{tmp_path}/c")
    plain = lambda key: "".join(c for c in key.lower() if c.isalnum())

    def alias(v):
        if isinstance(v, dict):
            return rule(v, True)
        if isinstance(v, list):
            return [alias(x) for x in v]
        h = 2166136261
        for c in str(v):
            h = (h ^ ord(c)) * 16777619 % 2**32
        return v if v is None or v == "" else f"id_{h:08x}"

    def rule(v, player=False):
        if isinstance(v, list):
            return [rule(x, player) for x in v]
        if not isinstance(v, dict):
            return v
        out = {}
        for k, x in v.items():
            n = plain(k)
            out[k] = D.REDACTED if n in D.SENSITIVE else alias(x) if n in D.PSEUDONYMS or (player and n in D.NAMES) else rule(x, n in D.PLAYERS)
        return out

    random.seed(2)
    keys = ["e-Mail", "Title", "player", "matchIds", "you", "players", "Screen_Name", "name", "x", "é", 'q"\\', "deck"]

    def value(depth):
        if depth and random.random() < 0.75:
            return {k: value(depth - 1) for k in random.sample(keys, random.randint(0, 4))} if random.random() < 0.6 else [value(depth - 1) for _ in range(random.randint(0, 3))]
        return random.choice([None, True, False, 0, -12, 2.5, "", "a \\ \"b\" é\n", "x", 10**15])

    values = [value(7) for _ in range(150)]
    texts = [json.dumps(v) for v in values] + [None, "", "{", '{"a": 1} 2', "null", '"name"', "[]", "{}"]
    df = spark.createDataFrame(list(enumerate(texts)), "key long, record string").select("key", "record", F.lit("p").alias("path"), F.lit("m").alias("mode"))
    got = {r["key"]: r["record"] for r in D.redacted(df, "record").collect()}
    dumps = lambda v: json.dumps(v, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    for i, v in enumerate(values):
        assert got[i] == dumps(rule(v)), (v, got[i])
    assert [got[150 + i] for i in range(8)] == [None, None, None, None, "null", '"name"', "[]", "{}"]
    assert max(map(lambda t: t.count("["), texts[:150])) > 3


def test_slugs_keep_all_digits(spark):
    from ledgerline.functions.text import run_slug

    rows = spark.createDataFrame([(7,), (9999,), (10000,), (1234567,)], "i long").orderBy("i")
    assert [r[0] for r in rows.select(run_slug(F.col("i"), F.lit("run"), F.lit("A b"))).collect()] == ["0007-run-a-b", "9999-run-a-b", "10000-run-a-b", "1234567-run-a-b"]


def test_pools_of_chance_cards_are_rejected(spark):
    from ledgerline.operators.matching import pool_overlap

    decks = spark.createDataFrame([(d, c) for d, cards in ((1, "abcz"), (2, "adg"), (3, "ad"), (4, "xyz")) for c in cards + cards[:1]], "deck long, card string")
    pools = spark.createDataFrame([(p, p, c) for p, cards in ((7, "abc"), (8, "def"), (9, "ghi"), (10, "abc")) for c in cards], "pool long, at long, card string")
    assert sorted(tuple(r) for r in pool_overlap(decks, pools, "deck", "pool", "card", "at").select("deck", "pool", "shared").collect()) == [(1, 7, 3), (3, 7, 1)]


def test_several_checkpoints_need_a_choice(spark):
    from ledgerline.operators.matching import join_analysis

    decisions = spark.createDataFrame([(1,), (2,)], "decision long")
    analyses = spark.createDataFrame([(1, 3, "a"), (1, 4, "b"), (2, 4, "c")], "decision long, checkpoint long, top string")
    with pytest.raises(ValueError, match="several"):
        join_analysis(decisions, analyses, ["decision"], "checkpoint")
    top = lambda **k: sorted(r["top"] for r in join_analysis(decisions, analyses, ["decision"], "checkpoint", **k).collect())
    assert top(chosen=4) == ["b", "c"] and top(several=True) == ["a", "b", "c"]
    assert join_analysis(decisions, analyses.where("checkpoint = 3"), ["decision"], "checkpoint").count() == 1
