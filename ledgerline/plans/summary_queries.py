"""Queries of checks, redactions and summaries, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.functions import names as N
from ledgerline.operators import log_events as L
from ledgerline.operators import summaries as S
from ledgerline.plans.board_queries import BOARDS_SQL, boards
from ledgerline.plans.registry import query
from ledgerline.plans.sequence_queries import picks
from ledgerline.plans.views import OPTIONS_SQL, STATES_SQL, decisions, option_rows, read, states

WITH = f"WITH {OPTIONS_SQL}"
STATES = f"WITH {STATES_SQL}"


def me():
    return F.col("playerIndex").cast("string")


@query(f"WITH {BOARDS_SQL}, h AS (SELECT decision, count(*) FILTER (zone = 'hand' AND seat <> me AND NOT hidden) AS leaks FROM o JOIN (SELECT decision, me FROM s) USING (decision) GROUP BY 1) SELECT decision, leaks, leaks = 0 AS passed FROM h")
def hidden_leak_check(spark, sf_dir):
    leaks = S.hidden_leaks(F.col("state"), me())
    return boards(spark, sf_dir).select("decision", leaks.alias("leaks"), (leaks == 0).alias("passed"))


@query(f"WITH {BOARDS_SQL}, h AS (SELECT decision, count(*) FILTER (NOT hidden AND NOT (zone = 'hand' AND seat <> me)) + 2 AS named, coalesce(sum(power) FILTER (NOT (zone = 'hand' AND seat <> me)), 0)::BIGINT AS power FROM o JOIN (SELECT decision, me FROM s) USING (decision) GROUP BY 1) SELECT decision, named, power, 0 AS leaks FROM h")
def redact_snapshot(spark, sf_dir):
    rows = boards(spark, sf_dir).select("decision", S.redacted(F.col("state"), me()).alias("state"), "playerIndex")
    o = F.col("state.objects")
    power = F.aggregate(o, F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x["power"], F.lit(0).cast("long")))
    return rows.select("decision", F.size(F.filter(o, lambda x: x["name"].isNotNull())).cast("long").alias("named"), power.alias("power"), S.hidden_leaks(F.col("state"), me()).alias("leaks"))


@query(f"WITH {BOARDS_SQL} SELECT decision, coalesce(nullif(hand, 0), n) AS hand0, 3 AS hand1, 2 AS library1 FROM s")
def zone_counts(spark, sf_dir):
    rows = boards(spark, sf_dir).select("decision", S.zone_counts(F.col("state"), "hand").alias("h"), S.zone_counts(F.col("state"), "library").alias("l"))
    return rows.select("decision", F.col("h")["0"].alias("hand0"), F.col("h")["1"].alias("hand1"), F.col("l")["1"].alias("library1"))


@query(f"WITH {BOARDS_SQL} SELECT decision, power::BIGINT AS power, 0 AS toughness, tapped FROM s")
def board_totals(spark, sf_dir):
    return boards(spark, sf_dir).select("decision", S.board_totals(F.col("state")).alias("t")).select("decision", "t.*")


@query("SELECT event_id, event_id % 5 IN (1, 2, 3, 4) AS \"over\" FROM events")
def is_game_over(spark, sf_dir):
    """The end stage stands in one of four places, or a game is going on."""
    k = F.col("event_id") % 5
    end = F.lit("GameStage_GameOver")
    state = F.when(k == 1, F.to_json(F.struct(end.alias("gameStage")))).when(k == 2, F.to_json(F.struct(F.lit("GameOver").alias("stage")))).when(k == 3, F.to_json(F.struct(F.struct(end.alias("gameStage")).alias("gameInfo")))).when(k == 4, F.to_json(F.struct(F.struct(end.alias("stage")).alias("gameInfo")))).otherwise(F.lit('{"stage": "GameStage_Play"}'))
    return read(spark, sf_dir, "events").select("event_id", L.is_over(F.parse_json(state)).alias("over"))


@query(f"{STATES} SELECT id, object::VARCHAR AS k, CASE WHEN id % 2 = 0 THEN '[\"a\",\"b\"]' ELSE zone END AS z, CASE WHEN object IS NULL THEN 1 ELSE 2 END AS n FROM st")
def annotation_map(spark, sf_dir):
    """A state's object and zone as annotation details: one number, one text or two, and an empty list."""
    some = F.when(F.col("id") % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array("zone"))
    number = F.when(F.col("object").isNotNull(), F.array("object")).otherwise(F.array().cast("array<bigint>"))
    none = F.lit(None)
    details = F.array(F.struct(F.lit("k").alias("key"), number.alias("valueInt32"), none.cast("array<string>").alias("valueString")), F.struct(F.lit("z").alias("key"), F.array().cast("array<bigint>").alias("valueInt32"), some.alias("valueString")))
    rows = states(spark, sf_dir).select("id", S.annotation_map(F.parse_json(F.to_json(details))).alias("m"))
    return rows.select("id", F.try_element_at("m", F.lit("k")).alias("k"), F.col("m")["z"].alias("z"), F.size("m").alias("n"))


@query(f"{WITH} SELECT decision, count(*) FILTER (kind = 'NO' OR idx = 1) AS implicit FROM opt GROUP BY 1")
def is_implicit(spark, sf_dir):
    """The second option of a decision skips, and those of one kind decline."""
    label = F.when(F.col("idx") == 1, "Skip the rest").otherwise(F.lit("a card"))
    key = F.when(F.col("kind") == "NO", "decline_optional")
    said = S.is_implicit(F.lit("cast_spell"), label, key, F.lit(None).cast("string"))
    return option_rows(spark, sf_dir).groupBy("decision").agg(F.count(F.when(said, 1)).alias("implicit"))


@query("SELECT p_partkey, CASE WHEN p_size % 10 = 0 THEN 'unknown direction' WHEN p_size % 10 = 1 THEN 'unknown transform' WHEN p_size % 10 = 2 THEN 'scale not positive' WHEN p_size % 10 = 3 THEN 'minimum exceeds maximum' WHEN n > 1 THEN 'name twice' END AS error FROM (SELECT *, count(*) OVER (PARTITION BY p_name) AS n FROM part)")
def check_specs(spark, sf_dir):
    k = F.col("p_size") % 10
    specs = read(spark, sf_dir, "part").select(
        "p_partkey", F.col("p_name").alias("name"), F.when(k == 0, "sideways").otherwise("lower_better").alias("direction"), F.when(k == 1, "cube").otherwise("log1p").alias("transform"),
        F.when(k == 2, 0.0).otherwise(2.0).alias("scale"), F.when(k == 3, 5.0).alias("minimum"), F.lit(4.0).alias("maximum"),
    )
    return S.spec_errors(specs).select("p_partkey", "error")


@query("SELECT o_custkey AS bundle, count(*) FILTER (o_orderstatus = 'F') > 0 AND count(*) FILTER (o_orderstatus = 'O') > 0 AS valid, (count(*) FILTER (o_orderstatus = 'P') > 0)::INT AS optional, (count(*) FILTER (o_orderstatus = 'F') = 0)::INT + (count(*) FILTER (o_orderstatus = 'O') = 0)::INT AS missing FROM orders GROUP BY 1")
def validate_bundle(spark, sf_dir):
    name = F.when(F.col("o_orderstatus") == "F", S.REQUIRED_FILES[0]).when(F.col("o_orderstatus") == "O", S.REQUIRED_FILES[1]).otherwise(S.OPTIONAL_FILES[0])
    files = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("bundle"), name.alias("name"))
    return S.bundle_checks(files).select("bundle", "valid", F.size("optional").alias("optional"), F.size("missing").alias("missing"))


@query(f"{WITH} SELECT decision, CASE WHEN decision % 3 = 0 THEN 'wrong number of scores' WHEN decision % 3 = 1 THEN 'score not finite' END AS error FROM dec")
def check_analysis_scores(spark, sf_dir):
    scores = F.transform("select.option", lambda o: o["score_a"].cast("double"))
    dressed = F.when(F.col("decision") % 3 == 0, F.concat(scores, F.array(F.lit(0.0)))).when(F.col("decision") % 3 == 1, F.transform(scores, lambda _, i: F.when(i == 0, float("nan")).otherwise(0.0))).otherwise(scores)
    return decisions(spark, sf_dir).select("decision", S.score_error(dressed, F.size("select.option")).alias("error"))


@query("SELECT count(*) AS labels, count(DISTINCT p_name) AS distinct_labels, CASE WHEN count(*) <> count(DISTINCT p_name) THEN 'label twice' END AS error FROM part")
def check_vocabulary(spark, sf_dir):
    return S.vocabulary_error(read(spark, sf_dir, "part"), "p_name")


@query(f"{STATES}, r AS (SELECT *, seq % 4 = 0 OR coalesce(reading / 100, 0) < 0.3 AS asked FROM st), a AS (SELECT *, sum(asked::INT) OVER (PARTITION BY game ORDER BY seq) AS k FROM r) SELECT id, asked AND k <= 5 AS review FROM a")
def need_second_pass(spark, sf_dir):
    rows = states(spark, sf_dir).withColumn("confidence", F.array(F.coalesce(F.col("reading") / 100, F.lit(0.0))))
    return S.needs_review(rows, ["game"], "seq", "confidence", 4, 0.3, 5).select("id", "review")


@query(f"{STATES} SELECT id, round(greatest(0, least(1, 0.78 * (reading / 100 + 0.5) / 2 + 0.22 * CASE WHEN coalesce(object, 0) = 0 THEN 1 ELSE least(object, 2) / object::DOUBLE END)), 6) AS score, (zone = 'error' OR reading / 100 < 0.55)::INT + 1 AS critical FROM st")
def state_quality(spark, sf_dir):
    confidence = F.create_map(F.lit("/life"), F.col("reading") / 100, F.lit("/phase"), F.lit(0.5))
    unknown = F.when(F.col("zone") == "error", F.array(F.lit("/life"))).otherwise(F.array().cast("array<string>"))
    n = F.coalesce("object", F.lit(0).cast("long"))
    q = S.state_quality(confidence, unknown, F.array(F.lit("/life"), F.lit("/phase")), F.least(n, F.lit(2)), n)
    return states(spark, sf_dir).select("id", q.alias("q")).select("id", F.round("q.score", 6).alias("score"), F.size("q.critical").alias("critical"))


@query(f"{WITH} SELECT decision, CASE decision % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 1 END AS winner FROM dec")
def winner_seat(spark, sf_dir):
    k = F.col("decision") % 4
    said = F.when(k == 0, "Player P0 is the winner").when(k == 1, "P1 wins").when(k == 2, " 1 ").otherwise("P0 and P1 draw")
    return picks(spark, sf_dir).select("decision", S.winner_seat(said).alias("winner"))


@query(f"{WITH} SELECT decision, CASE WHEN terminal THEN (CASE WHEN total <= 150000 THEN 0.0 WHEN (total > 250000) = (decision % 2 = 1) THEN 1.0 ELSE -1.0 END)::DOUBLE END AS reward FROM dec")
def terminal_reward(spark, sf_dir):
    winner = F.when(F.col("total") > 250000, 1).when(F.col("total") > 150000, 0)
    return picks(spark, sf_dir).select("decision", S.terminal_reward(winner, F.col("decision") % 2, F.col("terminal")).alias("reward"))


@query(f"{WITH}, g AS (SELECT game, count(*) AS decisions, first(total ORDER BY seq DESC) AS last, count(*) FILTER (n = 1)::BIGINT AS invalid FROM dec GROUP BY 1) SELECT game % 4 AS pairing, count(*) AS attempted, count(*) FILTER (game % 7 > 0) AS completed, count(*) FILTER (game % 7 = 0) AS crashes, count(*) FILTER (game % 7 > 0 AND last > 250000) AS wins, count(*) FILTER (game % 7 > 0 AND last <= 150000) AS losses, count(*) FILTER (game % 7 > 0 AND last <= 250000 AND last > 150000) AS draws, round(avg(CASE WHEN game % 7 > 0 THEN decisions END), 6) AS mean_decisions, sum(invalid)::BIGINT AS invalid FROM g GROUP BY 1")
def tournament_summary(spark, sf_dir):
    games = picks(spark, sf_dir).groupBy("gameId").agg(F.count("*").alias("decisions"), F.max_by("total", "sequenceNumber").alias("last"), F.count(F.when(F.col("n") == 1, 1)).alias("invalid"))
    rows = games.select((F.col("gameId") % 4).alias("pairing"), (F.col("gameId") % 7 == 0).alias("crashed"), F.when(F.col("last") > 250000, 0).when(F.col("last") <= 150000, 1).alias("winner"), "decisions", "invalid")
    return S.tournament(rows, ["pairing"])


@query(f"{STATES}, m AS (SELECT game, zone, min(seq) AS seen FROM st GROUP BY 1, 2), l AS (SELECT game, string_agg(zone, ',' ORDER BY seen) AS matches FROM m GROUP BY 1) SELECT game, count(*) AS events, count(*) FILTER (zone = 'click') AS decisions, count(*) FILTER (zone = 'view') AS states, count(*) FILTER (zone = 'click' AND object % 2 = 0) AS matched, any_value(matches) AS matches FROM st JOIN l USING (game) GROUP BY 1")
def capture_summary(spark, sf_dir):
    kind = F.when(F.col("zone") == "click", "decision").when(F.col("zone") == "view", "state").otherwise("event")
    rows = states(spark, sf_dir).withColumns({"kind": kind, "matched": F.coalesce(F.col("object") % 2 == 0, F.lit(False))})
    return S.captured(rows, "game", "kind", ["seq"], "zone").select("game", "events", "decisions", "states", "matched", F.array_join("match_ids", ",").alias("matches"))


@query("SELECT p_name, max(p_partkey) AS p_partkey, max_by(p_retailprice, p_partkey) AS p_retailprice, max_by(p_brand, p_partkey) AS p_brand FROM part GROUP BY 1")
def merge_card_sources(spark, sf_dir):
    part = read(spark, sf_dir, "part").select("p_name", F.col("p_partkey").alias("turn"), "p_partkey", "p_retailprice", "p_brand")
    return S.merged_cards(part, "p_name", ["turn"])


def decks(spark, sf_dir):
    rows = option_rows(spark, sf_dir).where("chosen")
    k = F.col("psize")
    colors = F.when(k % 3 == 0, "gu").when(k % 3 == 1, "W")
    return S.deck_summary(rows.select("game", colors.alias("colors"), F.col("brand").alias("set"), k.alias("cost"), (k % 5 == 0).alias("basic"), (k % 4 == 0).alias("land")), "game")


@query(f"{WITH} SELECT game, CASE WHEN bool_or(psize % 3 = 1) THEN 'W' ELSE '' END || CASE WHEN bool_or(psize % 3 = 0) THEN 'UG' ELSE '' END AS colors FROM opt WHERE chosen GROUP BY 1")
def deck_colors(spark, sf_dir):
    return decks(spark, sf_dir).select("game", "colors")


@query(f"{WITH}, c AS (SELECT game, brand, count(*) AS n FROM opt WHERE chosen AND psize % 5 <> 0 GROUP BY 1, 2), m AS (SELECT game, first(brand ORDER BY n DESC, brand) AS set_mode FROM c GROUP BY game) SELECT game, set_mode FROM (SELECT DISTINCT game FROM opt) LEFT JOIN m USING (game)")
def deck_set_mode(spark, sf_dir):
    return decks(spark, sf_dir).select("game", "set_mode")


@query(f"{WITH} SELECT game, least(psize, 7) AS cost, count(*) AS n FROM opt WHERE chosen AND psize % 4 <> 0 GROUP BY 1, 2")
def deck_curve(spark, sf_dir):
    return decks(spark, sf_dir).select("game", F.explode("curve").alias("cost", "n"))


@query("SELECT o_custkey AS run, count(*) AS steps, bool_and(o_totalprice > 20000 AND o_orderstatus <> 'P') AS verified FROM orders GROUP BY 1")
def verification_summary(spark, sf_dir):
    steps = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run"), F.when(F.col("o_orderstatus") != "P", True).alias("compared"), (F.col("o_totalprice") > 20000).alias("passed"))
    return S.verified_runs(steps, "run", "compared", "passed")


@query(f"{WITH} SELECT decision, CASE WHEN decision % 5 > 0 THEN '[\"' || source || '\",' || CASE WHEN game % 2 = 0 THEN game::VARCHAR ELSE 'null' END || ',null]' END AS game_key FROM dec")
def game_key(spark, sf_dir):
    d, none = F.col("decision") % 5 > 0, F.lit(None).cast("string")
    return picks(spark, sf_dir).select("decision", S.game_key(F.when(d, F.col("source")), F.when(d & (F.col("gameId") % 2 == 0), F.col("gameId")), none).alias("game_key"))


@query(f"{WITH} SELECT decision, coalesce(CASE WHEN decision % 2 = 0 THEN 'pair-' || decision END, prompt || '|' || CASE WHEN game % 3 > 0 THEN game::VARCHAR ELSE '' END || '|1') AS pair_key FROM dec")
def pair_key(spark, sf_dir):
    explicit = F.when(F.col("decision") % 2 == 0, F.concat(F.lit("pair-"), "decision"))
    return picks(spark, sf_dir).select("decision", S.pair_key(explicit, F.col("prompt"), F.when(F.col("gameId") % 3 > 0, F.col("gameId")), F.lit(1)).alias("pair_key"))


@query(f"{STATES}, c AS (SELECT game, zone, count(*) AS n, min(seq) AS first FROM st GROUP BY 1, 2) SELECT game, first(zone ORDER BY n DESC, first) AS consensus FROM c GROUP BY 1")
def custom_udaf(spark, sf_dir):
    counts = states(spark, sf_dir).groupBy("game", "zone").agg(F.count("*").alias("times"), F.min("seq").alias("first"))
    return counts.groupBy("game").agg(S.consensus()("zone", "times", "first").alias("consensus"))


@query("SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'Kaldheim' WHEN 1 THEN 'Cube' WHEN 2 THEN 'q7' END AS label FROM part")
def set_name(spark, sf_dir):
    k = F.col("p_size") % 4
    code = F.when(k == 0, "khm").when(k == 1, "Cube").when(k == 2, "q7")
    return read(spark, sf_dir, "part").select("p_partkey", N.set_name(code).alias("label"))
