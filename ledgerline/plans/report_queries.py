"""Queries of native logs, scorers, analyses, sideboards, zones, history and preferences, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.operators import ranking as K
from ledgerline.operators import reports as R
from ledgerline.plans.registry import query
from ledgerline.plans.scratch import shared_folder
from ledgerline.plans.sequence_queries import picks
from ledgerline.plans.views import OPTIONS_SQL, STATES_SQL, option_rows, read
from ledgerline.sources import files

WITH = f"WITH {OPTIONS_SQL}"
STATES = f"WITH {STATES_SQL}"


@query(
    """WITH l AS (SELECT o_custkey AS doc, o_orderkey AS place, o_orderkey % 8 AS k, o_orderpriority AS card FROM orders),
e AS (SELECT *, CASE k WHEN 0 THEN 'p1' WHEN 1 THEN 'p' || (place % 3) WHEN 2 THEN 'p' || (place % 3) WHEN 3 THEN 'p2' WHEN 7 THEN 'p1' END AS who, CASE k WHEN 4 THEN 'p' || (place % 5) END AS came FROM l),
f AS (SELECT doc, who AS name, min(place) AS first FROM (SELECT doc, place, who FROM e UNION ALL SELECT doc, place, came FROM e) WHERE who IS NOT NULL GROUP BY 1, 2),
a AS (SELECT doc, name, 'player:' || row_number() OVER (PARTITION BY doc ORDER BY first) AS alias FROM f)
SELECT e.doc, e.place, aw.alias AS actor, ac.alias AS joined, CASE k WHEN 0 THEN 'CAST_SPELL' WHEN 1 THEN 'ATTACK' WHEN 2 THEN 'TURN_START' WHEN 3 THEN 'GAME_WIN' WHEN 7 THEN 'GAIN_LIFE' END AS action_type,
  CASE k WHEN 0 THEN 'Big ' || card WHEN 1 THEN 'Wall' END AS card, CASE WHEN k = 0 THEN 'Gate.' END AS target,
  last_value(CASE WHEN k = 2 THEN place % 40 END IGNORE NULLS) OVER (PARTITION BY e.doc ORDER BY e.place) AS turn, k = 6 AS unparsed
FROM e LEFT JOIN a aw ON aw.doc = e.doc AND aw.name = who LEFT JOIN a ac ON ac.doc = e.doc AND ac.name = came"""
)
def parse_native_log(spark, sf_dir):
    """An order is a line of its customer's log, of eight kinds."""
    k, place = F.col("o_orderkey") % 8, F.col("o_orderkey")
    line = (
        F.when(k == 0, F.concat(F.lit("P1 casts Big "), "o_orderpriority", F.lit(" targeting Gate."))).when(k == 1, F.concat(F.lit("p"), place % 3, F.lit(" attacks with Wall"))).when(k == 2, F.concat(F.lit("Turn "), place % 40, F.lit(": P"), place % 3, F.lit("'s turn")))
        .when(k == 3, "p2 wins the game").when(k == 4, F.concat(F.lit("P"), place % 5, F.lit(" joined the game"))).when(k == 5, F.concat(F.lit("Game #8"), F.lpad((place % 99).cast("string"), 8, "0"))).when(k == 6, "a note of damage").otherwise("P1  gains 3 life.")
    )
    return R.native_log(read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), place.alias("place"), line.alias("line"))).drop("line")


@query(f"{WITH} SELECT decision, idx, (idx = 0)::DOUBLE AS first_legal, round(('0x' || substr(sha256(decision || '|5|' || idx), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0, 9) AS seeded, CASE WHEN idx = 6 THEN -100.0 WHEN kind = 'NO' THEN -1.0 WHEN kind = 'RF' THEN 3.0 WHEN kind = 'AF' THEN 2.5 ELSE 0.5 END::DOUBLE AS shape FROM opt")
def baseline_scores(spark, sf_dir):
    kind = F.when(F.col("kind") == "NO", "pass_priority").when(F.col("kind") == "RF", "Cast_Spell").when(F.col("kind") == "AF", "PLAY_LAND").otherwise("OTHER")
    label = F.when(F.col("idx") == 6, "Concede the game").otherwise(F.col("label"))
    seeded = R.seeded_score(F.col("decision").cast("string"), 5, F.col("idx"))
    return option_rows(spark, sf_dir).select("decision", "idx", F.when(F.col("idx") == 0, 1.0).otherwise(0.0).alias("first_legal"), F.round(seeded, 9).alias("seeded"), R.shape_score(kind, label).alias("shape"))


@query(
    f"""{WITH}, r AS (SELECT *, row_number() OVER (PARTITION BY decision ORDER BY score_a DESC, idx) AS r, exp(score_a) / sum(exp(score_a)) OVER (PARTITION BY decision) AS p FROM opt),
t AS (SELECT decision, string_agg(r || '. ' || label || '  ' || CASE WHEN decision % 5 = 0 THEN printf('%.4f', score_a) ELSE printf('%.1f%%', 100 * p) END, chr(10) ORDER BY r) FILTER (r <= 3) AS body, max(CASE WHEN r = 1 THEN label END) AS best, max(CASE WHEN chosen THEN r END) AS played FROM r GROUP BY 1)
SELECT decision, 'Model analysis · m' || CASE WHEN decision % 2 = 0 THEN ' (untrained)' ELSE '' END || chr(10) || body || CASE WHEN decision % 7 = 0 THEN '' WHEN played = 1 THEN chr(10) || '✓ Played rank: 1 — the model''s top pick' ELSE chr(10) || '✗ Played rank: ' || played || ' — model preferred ' || best END AS text FROM t"""
)
def format_analysis(spark, sf_dir):
    rows = K.ranked(option_rows(spark, sf_dir), ["decision"], "score_a")
    given = F.when(F.col("decision") % 5 != 0, F.col("probability"))
    top = F.sort_array(F.collect_list(F.when(F.col("rank") <= 5, F.struct("rank", "label", given.alias("probability"), F.col("score_a").alias("score")))))
    found = rows.groupBy("decision").agg(top.alias("top"), F.max(F.when(F.col("chosen"), F.col("rank"))).alias("played"))
    played = F.when(F.col("decision") % 7 != 0, F.col("played"))
    return found.select("decision", R.analysis_text(F.lit("m"), F.col("decision") % 2 == 0, F.col("top"), played, 3).alias("text"))


@query(
    f"""{WITH}, s AS (SELECT decision, 'a' AS model, list(kind ORDER BY score_a DESC, idx)[:3] AS top FROM opt GROUP BY 1 UNION ALL SELECT decision, 'b', list(kind ORDER BY score_b DESC, idx)[:3] FROM opt WHERE decision % 5 <> 0 GROUP BY 1),
d AS (SELECT decision, model, top[1] AS best, list_position(list_filter(top, lambda x, i: list_position(top, x) = i), pick_kind) AS pos FROM s JOIN dec USING (decision)),
p AS (SELECT decision, max(CASE WHEN model = 'a' THEN best END) AS top_a, max(CASE WHEN model = 'b' THEN best END) AS top_b, max(CASE WHEN model = 'a' THEN coalesce(nullif(pos, 0), 9) END) AS rank_a, max(CASE WHEN model = 'b' THEN coalesce(nullif(pos, 0), 9) END) AS rank_b FROM d GROUP BY 1)
SELECT decision, top_a, top_b, rank_a, rank_b, CASE WHEN top_b IS NULL THEN 'partial-agree' WHEN top_a = top_b THEN 'all-agree' ELSE 'disagree' END AS agreement FROM p"""
)
def comparison_rows(spark, sf_dir):
    """Two models' three best kinds of every decision; an older analysis of each says the opposite, every fifth decision has none of the second."""
    def tops(model, score, created, sign):
        order = F.sort_array(F.collect_list(F.struct((sign * F.col(score)).alias("s"), "idx", "kind")))
        found = option_rows(spark, sf_dir).groupBy(F.col("decision").alias("fingerprint")).agg(F.slice(F.transform(order, lambda o: o["kind"]), 1, 3).alias("top"))
        return found.select("fingerprint", F.lit(model).alias("model"), F.lit(created).alias("created"), F.lit(0).alias("place"), "top", F.lit(9).alias("chosen_rank"))

    second = tops("b", "score_b", "2", -1).where("fingerprint % 5 <> 0")
    analyses = tops("a", "score_a", "2", -1).unionByName(second).unionByName(tops("a", "score_a", "1", 1))
    rows = R.comparison(picks(spark, sf_dir).select(F.col("decision").alias("fingerprint"), F.col("pick_kind").alias("human")), analyses, ["a", "b"])
    cell = lambda i: F.col("cells")[i]
    return rows.select(F.col("fingerprint").alias("decision"), cell(0)["top"].alias("top_a"), cell(1)["top"].alias("top_b"), cell(0)["played_rank"].alias("rank_a"), cell(1)["played_rank"].alias("rank_b"), "agreement")


@query(
    f"""{WITH}, d AS (SELECT decision, game, list(part ORDER BY idx) AS deck, list(part ORDER BY idx DESC) AS back FROM opt GROUP BY 1, 2)
SELECT decision AS resp, CASE WHEN decision % 7 <> 0 THEN decision % 3 + 1 END AS game, len(deck)::BIGINT AS cards, CASE WHEN decision % 7 <> 0 THEN decision % 2 = 0 AND len(deck) > 1 END AS changed, CASE WHEN decision % 7 = 0 THEN 'sideboards_missing_prompt' ELSE 'sideboards_compiled' END AS reason FROM d"""
)
def join_sideboard(spark, sf_dir):
    """Every order's parts are offered, twice, and submitted in another order, some with the last one left out."""
    option = F.struct("idx", "part")
    decks = option_rows(spark, sf_dir).groupBy(F.col("game").cast("string").alias("match"), F.col("decision").alias("resp")).agg(F.transform(F.sort_array(F.collect_list(option)), lambda o: o["part"]).alias("deck"))
    whole = decks.withColumns({"game": F.col("resp") % 3 + 1, "place": F.lit(2), "side": F.array().cast("array<long>")}).where("resp % 7 <> 0")
    older = whole.withColumns({"place": F.lit(1), "game": F.lit(99).cast("long"), "deck": F.col("side")})
    sent = F.when((F.col("resp") % 2 == 0) & (F.size("deck") > 1), F.slice("deck", F.lit(2), F.size("deck"))).otherwise(F.reverse("deck"))
    submits = decks.withColumns({"place": F.lit(3), "cards": F.size("deck").cast("long"), "deck": sent, "side": F.array().cast("array<long>")})
    return R.sideboards(whole.unionByName(older), submits).select("resp", "game", "cards", "changed", "reason")


@query(
    f"""{WITH} SELECT decision, CASE WHEN decision % 2 = 0 THEN ['hand', 'battlefield', 'other'][1 + idx % 3] ELSE ['hand', 'graveyard', 'exile'][1 + idx % 3] END AS zone,
  CASE WHEN decision % 2 = 0 THEN CASE idx % 3 WHEN 0 THEN '1' ELSE (part % 2)::VARCHAR END ELSE CASE idx % 3 WHEN 2 THEN (part % 2)::VARCHAR ELSE '2' END END AS seat, idx // 3 AS place, part FROM opt"""
)
def explode_zone_objects(spark, sf_dir):
    """States of all orders' parts in both layouts, with bare counts between."""
    item = F.struct("idx", F.to_json(F.struct("part", (F.col("part") % 2).alias("controllerSeat"))).alias("j"))
    rows = option_rows(spark, sf_dir).groupBy("decision").agg(F.sort_array(F.collect_list(item)).alias("o"))
    part = lambda r: F.concat(F.lit("["), F.array_join(F.transform(F.filter("o", lambda o: o["idx"] % 3 == r), lambda o: o["j"]), ","), F.lit("]"))
    zones = F.concat(F.lit('{"hand": [{"part": -1}], "zones": {"Hands": {"1": '), part(0), F.lit(', "2": 7}, "libraries": {"1": 53}, "BATTLEFIELD": '), part(1), F.lit(', "ante": '), part(2), F.lit("}}"))
    fields = F.concat(F.lit('{"library": 40, "hands": {"1": 3, "2": '), part(0), F.lit('}, "graveyards": {"2": '), part(1), F.lit('}, "exile": '), part(2), F.lit(', "zones": null}'))
    state = F.parse_json(F.when(F.col("decision") % 2 == 0, zones).otherwise(fields))
    out = R.zone_objects(rows.select("decision", state.alias("state")))
    return out.select("decision", "zone", "seat", F.col("place").cast("long").alias("place"), F.try_variant_get("object", "$.part", "long").alias("part"))


@query(f"{STATES} SELECT id, zone, CASE WHEN zone <> 'error' THEN reading END AS reading, CASE WHEN zone <> 'error' THEN object END AS object, CASE WHEN zone = 'error' THEN true END AS redacted FROM st")
def redact_history(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("zone"), F.col("value").alias("reading"), F.get_json_object("props", "$.k").cast("long").alias("object"))
    return R.redacted_history(rows, "zone", ("error",), ("reading", "object", "payload"))


@query("SELECT l_suppkey::VARCHAR AS expert, CASE l_linenumber % 3 WHEN 0 THEN 'left' WHEN 1 THEN 'right' ELSE 'tie' END AS preferred, count(*) AS n, round(sum(l_quantity), 4) AS quantity, round(sum(CASE WHEN l_linenumber % 2 = 0 THEN 0.5 ELSE 1 END)::DOUBLE, 4) AS weight FROM lineitem GROUP BY 1, 2")
def read_preferences(spark, sf_dir):
    """Every line as a preference of its supplier: written as JSONL, read back typed and checked."""
    path, k = shared_folder(spark, "preferences"), F.col("l_linenumber") % 3
    side = lambda name, f: F.struct(F.lit(name).alias("id"), F.create_map(F.lit("quantity"), f).alias("factors"))
    lines = read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("contextId"), F.col("l_suppkey").alias("expert"), F.when(k == 0, "Left").when(k == 1, "right").otherwise("tie").alias("preferred"),
        side("a", F.col("l_quantity")).alias("left"), side("b", F.col("l_tax")).alias("right"), F.when(F.col("l_linenumber") % 2 == 0, 0.5).otherwise(1.0).alias("weight"),
    )
    files.write_jsonl(lines, path)
    rows = R.read_preferences(spark, path, ["quantity"])
    return rows.groupBy("expert", "preferred").agg(F.count("*").alias("n"), F.round(F.sum(F.col("left")["quantity"]), 4).alias("quantity"), F.round(F.sum("weight"), 4).alias("weight"))


@query(
    f"""{STATES}, q AS (SELECT zone AS agent, 'p' || (id % 3) AS prompt, id % 9 AS options, round(reading)::BIGINT AS latency, id % 10 AS k FROM st),
g AS (SELECT agent, prompt, count(*) AS requests, round(avg(options), 6) AS options, round(quantile_cont(latency, 0.5), 6) AS median, round(quantile_cont(latency, 0.95), 6) AS p95, max(latency) AS most FROM q WHERE k < 8 GROUP BY 1, 2),
b AS (SELECT agent, prompt, count(*) AS failed, CASE WHEN count(*) FILTER (k = 8) >= count(*) FILTER (k = 9) THEN 'KeyError' ELSE 'ValueError' END AS error FROM q WHERE k >= 8 GROUP BY 1, 2)
SELECT agent, prompt, coalesce(requests, 0) AS requests, options, median, p95, most, coalesce(failed, 0) AS failed, error FROM g FULL JOIN b USING (agent, prompt)"""
)
def score_service_log(spark, sf_dir):
    """Every event as a request, a fifth of which fail."""
    e = read(spark, sf_dir, "events")
    own = [F.col("event_type").alias("agent"), F.concat(F.lit("p"), F.col("event_id") % 3).alias("prompt")]
    good = e.where("event_id % 10 < 8").select(*own, (F.col("event_id") % 9).alias("options"), F.round("value").cast("long").alias("latency"))
    bad = e.where("event_id % 10 >= 8").select(*own, F.when(F.col("event_id") % 10 == 8, "KeyError").otherwise("ValueError").alias("error"))
    return R.service_report(good, bad).withColumns({c: F.round(c, 6) for c in ("options", "median", "p95")})


@query("SELECT o_orderstatus AS bundle, count(*) AS decisions, sum(o_orderkey)::BIGINT AS keys, (SELECT count(*) FROM events WHERE user_id % 2 = 0) AS states, count(*) AS stated FROM orders GROUP BY 1")
def read_bundle(spark, sf_dir):
    """Runs of decisions, and of states for one of them, are written as bundles and read back with their summary."""
    path = shared_folder(spark, "bundle")
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("bundle"), "o_orderkey", "o_orderdate")
    events = read(spark, sf_dir, "events").where("user_id % 2 = 0").select(F.lit("a run=é/1").alias("bundle"), "event_id", "props")
    files.write_bundle({"decisions": orders, "mirror_states": events}, path)
    parts, summary = files.read_bundle(spark, path)
    rows = parts["decisions"].groupBy("bundle").agg(F.count("*").alias("decisions"), F.sum(F.variant_get("record", "$.o_orderkey", "long")).alias("keys"))
    states = parts["mirror_states"].where("bundle = 'a run=é/1' and record is not null").agg(F.count("*").alias("states"))
    stated = summary.where("part = 'decisions'").select("bundle", F.col("rows").alias("stated"))
    return rows.join(stated, "bundle").crossJoin(F.broadcast(states))  # states is one row


@query("SELECT p_brand AS bundle, p_partkey % 2 = 0 AS even, count(*) AS rows, sum(p_size)::BIGINT AS size FROM part GROUP BY 1, 2")
def write_bundle(spark, sf_dir):
    """Parts split to raw and normalised files by brand, and read back."""
    path = shared_folder(spark, "bundle")
    part = read(spark, sf_dir, "part").select(F.col("p_brand").alias("bundle"), "p_partkey", "p_size", "p_name")
    files.write_bundle({"raw_events": part.where("p_partkey % 2 = 0"), "normalized_events": part.where("p_partkey % 2 = 1")}, path)
    found, _ = files.read_bundle(spark, path, ("raw_events", "normalized_events"))
    rows = found["raw_events"].withColumn("even", F.lit(True)).unionByName(found["normalized_events"].withColumn("even", F.lit(False)))
    return rows.groupBy("bundle", "even").agg(F.count("*").alias("rows"), F.sum(F.variant_get("record", "$.p_size", "long")).alias("size"))


@query(
    f"""{WITH}, p AS (SELECT decision, game, list(part ORDER BY idx) AS deck FROM opt GROUP BY 1, 2)
SELECT counter, n::BIGINT AS n FROM (SELECT 'picks_compiled' AS counter, count(*) FILTER (decision % 9 <> 0) AS n FROM p UNION ALL SELECT 'picks_missing_pack', count(*) FILTER (decision % 9 = 0) FROM p
 UNION ALL SELECT 'deck_builds_compiled', 2 * count(*) FROM p UNION ALL SELECT 'deck_builds_without_pool', 2 * count(*) FILTER (decision % 4 = 0 OR decision % 4 = 1) FROM p
 UNION ALL SELECT 'deck_builds_pool_recovered', 2 * count(*) FILTER (decision % 4 = 1) FROM p UNION ALL SELECT 'duplicates_dropped', count(*) FROM p
 UNION ALL SELECT 'sideboards_compiled', count(*) FILTER (decision % 7 <> 0) FROM p UNION ALL SELECT 'sideboards_missing_prompt', count(*) FILTER (decision % 7 = 0) FROM p) WHERE n > 0"""
)
def draft_stats(spark, sf_dir):
    """An order is a pick out of its parts and two equal builds of two sources; a customer is a draft."""
    option = F.struct("idx", "part")
    decks = option_rows(spark, sf_dir).groupBy("game", "decision").agg(F.transform(F.sort_array(F.collect_list(option)), lambda o: o["part"]).alias("cards"))
    offered = decks.select(F.lit("s").alias("source"), F.col("game").alias("draft"), F.lit(1).alias("pack"), F.col("decision").alias("pick"), F.lit(0).alias("place"), "cards")
    picks = R.draft_picks(offered.where("pick % 9 <> 0"), offered.withColumn("cards", F.slice("cards", 1, 1)))
    k = F.col("decision") % 4
    build = decks.select(F.when(k != 0, F.col("game")).alias("draft"), (k == 1).alias("recovered"), F.col("decision").alias("event"), F.col("cards").alias("deck"))
    builds = build.withColumn("source", F.explode(F.array(F.lit("s"), F.lit("t"))))
    prompt = decks.select(F.col("game").cast("string").alias("match"), F.col("decision").alias("resp"), F.lit(0).alias("place"), F.lit(1).alias("game"), F.col("cards").alias("deck"), F.array().cast("array<long>").alias("side"))
    boards = R.sideboards(prompt.where("resp % 7 <> 0"), prompt.drop("game"))
    return R.draft_stats(picks, builds, boards)


@query(
    f"""{WITH}, r AS (SELECT decision, idx, CASE WHEN part % 6 <> 0 THEN label END AS name, price / 100000 AS score, row_number() OVER (PARTITION BY decision ORDER BY price DESC, idx) AS r FROM opt),
b AS (SELECT decision, max(CASE WHEN r = 1 AND score >= 0.6 THEN name END) AS accepted, max(CASE WHEN r = 1 THEN idx END) AS best, string_agg(idx, ',' ORDER BY r) FILTER (r <= 8) AS evidence FROM r GROUP BY 1)
SELECT decision, CASE WHEN accepted IS NULL THEN 'below-threshold' ELSE 'accepted' END AS status, accepted, best, evidence FROM b"""
)
def best_attempt(spark, sf_dir):
    """Options as attempts at a name, every sixth part unresolved; their price is the score."""
    name = F.when(F.col("part") % 6 != 0, F.col("label"))
    rows = option_rows(spark, sf_dir).select("decision", "idx", name.alias("name"), (F.col("price") / 100000).alias("score"))
    out = R.best_attempts(rows, ["decision"], "score", "name", ["idx"])
    return out.select("decision", "status", "accepted", F.col("best.idx").alias("best"), F.array_join(F.transform("evidence", lambda e: e["idx"].cast("string")), ",").alias("evidence"))
