"""Queries of ordered operators and joins, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.operators import matching as M
from ledgerline.operators import sequences as S
from ledgerline.plans.registry import query
from ledgerline.plans.views import OPTIONS_SQL, STATES_SQL, decisions, option_rows, read, states

WITH = f"WITH {OPTIONS_SQL}"
STATES = f"WITH {STATES_SQL}"
GAME, SEQ = ["gameId"], ["sequenceNumber"]


def picks(spark, sf_dir):
    """Flat decisions: gameId, decision, sequenceNumber, total, pick, pick_kind, pick_part."""
    df = decisions(spark, sf_dir)
    chosen = F.element_at("select.option", (F.col("selectedIndices")[0] + 1).cast("int"))
    return df.select("gameId", "decision", "sequenceNumber", "source", "ts", "total", F.col("select.type").alias("prompt"), "terminal", chosen["index"].alias("pick"), chosen["type"].alias("pick_kind"), chosen["part"].alias("pick_part"), F.size("select.option").cast("long").alias("n"))


@query(f"{WITH} SELECT decision, lead(decision) OVER w AS next_decision, pick, round(lead(total) OVER w - total, 6) AS delta FROM dec QUALIFY next_decision IS NOT NULL WINDOW w AS (PARTITION BY game ORDER BY seq)".replace("QUALIFY next_decision IS NOT NULL WINDOW w AS (PARTITION BY game ORDER BY seq)", "WINDOW w AS (PARTITION BY game ORDER BY seq) QUALIFY next_decision IS NOT NULL"))
def transitions(spark, sf_dir):
    rows = S.transitions(picks(spark, sf_dir), GAME, SEQ, ["decision", "total"])
    return rows.select("decision", F.col("next.decision").alias("next_decision"), "pick", F.round(F.col("next.total") - F.col("prev.total"), 6).alias("delta"))


@query(
    f"{WITH} SELECT h AS horizon, a.decision, b.decision AS next_decision FROM dec a, (VALUES (1::BIGINT), (4), (16)) v(h), dec b WHERE b.game = a.game AND b.seq = a.seq + h"
)
def horizon_transitions(spark, sf_dir):
    rows = S.horizons(picks(spark, sf_dir), GAME, SEQ, ["decision"])
    return rows.select("horizon", "decision", F.col("next.decision").alias("next_decision"))


@query(f"{STATES} SELECT game, id, round(lead(reading) OVER w - reading, 6) AS delta, lead(zone) OVER w = 'error' AS game_over FROM st WINDOW w AS (PARTITION BY game ORDER BY seq) QUALIFY lead(id) OVER w IS NOT NULL")
def transition_deltas(spark, sf_dir):
    rows = S.transitions(states(spark, sf_dir), ["game"], ["seq"], ["reading", "zone"])
    return rows.select("game", "id", F.round(F.col("next.reading") - F.col("prev.reading"), 6).alias("delta"), (F.col("next.zone") == "error").alias("game_over"))


@query(f"{WITH} SELECT decision, seq AS position FROM dec")
def sequence_index(spark, sf_dir):
    return S.sequence_index(picks(spark, sf_dir), GAME, ["ts", "decision"]).select("decision", "position")


@query(f"{WITH} SELECT decision, seq // 8 AS chunk, seq % 8 AS place, lag(pick) OVER (PARTITION BY game ORDER BY seq) AS previous FROM dec")
def chunk_windows(spark, sf_dir):
    return S.chunk_windows(picks(spark, sf_dir), GAME, SEQ, 8, "pick").select("decision", "chunk", "place", "previous")


@query(f"{WITH}, g AS (SELECT game, count(*) AS n FROM dec GROUP BY game) SELECT * FROM (SELECT game, n, (sum(n) OVER (ORDER BY game) - n)::BIGINT AS start FROM g) WHERE start < 5000")
def whole_game_limit(spark, sf_dir):
    counts = picks(spark, sf_dir).groupBy(F.col("gameId").alias("game")).agg(F.count("*").alias("n"))
    return S.whole_game_limit(counts, "game", "n", 5000).select("game", "n", "start")


@query(f"{STATES} SELECT game, id, zone FROM st QUALIFY zone IS DISTINCT FROM lag(zone) OVER (PARTITION BY game ORDER BY seq)")
def turn_marks(spark, sf_dir):
    return S.run_starts(states(spark, sf_dir), ["game"], ["seq"], "zone").select("game", "id", "zone")


@query(f"{STATES}, g AS (SELECT id, (epoch_us(lead(ts) OVER (PARTITION BY game ORDER BY seq)) - epoch_us(ts)) / 1e6 AS gap FROM st) SELECT id, round(CASE WHEN gap > 0 THEN least(gap / 600.0, 4.0) ELSE 1.0 END, 6) AS delay FROM g")
def frame_delay(spark, sf_dir):
    return S.frame_gaps(states(spark, sf_dir), ["game"], ["seq"], "ts", speed=600.0).select("id", F.round("delay", 6).alias("delay"))


@query(f"{STATES} SELECT game, zone, count(*) AS kept FROM (SELECT * FROM st QUALIFY zone IS DISTINCT FROM lag(zone) OVER (PARTITION BY game ORDER BY seq)) GROUP BY 1, 2")
def dedupe_consecutive(spark, sf_dir):
    return S.run_starts(states(spark, sf_dir), ["game"], ["seq"], "zone").groupBy("game", "zone").agg(F.count("*").alias("kept"))


@query(f"{STATES} SELECT id, last_value(CASE WHEN zone = 'signup' THEN object END IGNORE NULLS) OVER (PARTITION BY game ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS match FROM st")
def carry_forward(spark, sf_dir):
    return S.carried(states(spark, sf_dir), ["game"], ["seq"], F.when(F.col("zone") == "signup", F.col("object")), "match").select("id", "match")


@query(f"{STATES} SELECT id, last_value(CASE WHEN zone = 'view' THEN id END IGNORE NULLS) OVER (PARTITION BY game ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS state FROM st")
def preceding_state(spark, sf_dir):
    return S.preceding(states(spark, sf_dir), ["game"], ["seq"], F.when(F.col("zone") == "view", F.col("id")), "state").select("id", "state")


@query(f"{STATES}, c AS (SELECT *, CASE WHEN zone IS DISTINCT FROM lag(zone) OVER (PARTITION BY game ORDER BY seq) THEN 1 ELSE 0 END AS new FROM st) SELECT id, (sum(new) OVER (PARTITION BY game ORDER BY seq))::BIGINT AS instance FROM c")
def game_instance(spark, sf_dir):
    return S.instances(states(spark, sf_dir), ["game"], ["seq"], "zone").select("id", F.col("instance").cast("long").alias("instance"))


@query(f"{STATES} SELECT id, 'event-' || lpad((seq + 1)::VARCHAR, 6, '0') AS event FROM st")
def event_ids(spark, sf_dir):
    return S.assign_ids(states(spark, sf_dir), ["game"], ["seq"], "event").select("id", "event")


@query(f"{STATES} SELECT game, zone, min(seq) AS seq FROM st GROUP BY 1, 2")
def once_per_key(spark, sf_dir):
    return S.first_per_key(states(spark, sf_dir), ["game", "zone"], ["seq"]).select("game", "zone", "seq")


@query(f"{STATES} SELECT id, coalesce(max(CASE WHEN zone = 'click' THEN seq END) OVER (PARTITION BY game ORDER BY seq), -1) AS turn FROM st")
def turn_carry(spark, sf_dir):
    return S.carried(states(spark, sf_dir), ["game"], ["seq"], F.when(F.col("zone") == "click", F.col("seq")), "turn").select("id", F.coalesce("turn", F.lit(-1)).alias("turn"))


@query(f"{WITH} SELECT decision, first_value(CASE WHEN pick_kind <> 'NO' THEN decision END IGNORE NULLS) OVER (PARTITION BY game ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS meaningful FROM dec")
def next_meaningful(spark, sf_dir):
    return S.next_where(picks(spark, sf_dir), GAME, SEQ, F.when(F.col("pick_kind") != "NO", F.col("decision")), "meaningful").select("decision", "meaningful")


@query(f"{STATES}, m AS (SELECT game, object, id, seq, zone AS to_zone, lag(zone) OVER (PARTITION BY game, object ORDER BY seq) AS from_zone FROM st WHERE object IS NOT NULL) SELECT game, object, id, from_zone, to_zone FROM m WHERE from_zone <> to_zone")
def zone_moves(spark, sf_dir):
    return S.zone_moves(states(spark, sf_dir), "game", "object", ["seq"], "zone").select("game", "object", "id", "from_zone", "to_zone")


@query(
    f"""{STATES}, m AS (SELECT game, object, id, seq, zone AS to_zone, lag(zone) OVER (PARTITION BY game, object ORDER BY seq) AS from_zone FROM st WHERE object IS NOT NULL),
k AS (SELECT *, lag(to_zone) OVER (PARTITION BY game, object ORDER BY seq) AS was FROM m WHERE from_zone <> to_zone AND to_zone <> 'error')
SELECT id, was, from_zone FROM k WHERE was <> from_zone"""
)
def move_chain_check(spark, sf_dir):
    moves = S.zone_moves(states(spark, sf_dir), "game", "object", ["seq"], "zone").where("to_zone <> 'error'")
    return S.broken_chains(moves, "game", "object", ["seq"]).select("id", "was", "from_zone")


@query(f"{WITH} SELECT decision, coalesce(string_agg(pick_part::VARCHAR, ',') OVER (PARTITION BY game ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS pool FROM dec")
def pool_accumulate(spark, sf_dir):
    return S.pool(picks(spark, sf_dir), GAME, SEQ, "pick_part").select("decision", F.array_join(F.col("pool").cast("array<string>"), ",").alias("pool"))


@query(
    f"""{STATES}, p AS (SELECT a.id, b.object % 4 AS v, b.reading AS s FROM st a JOIN st b ON b.game = a.game AND b.seq BETWEEN a.seq - 4 AND a.seq),
g AS (SELECT id, v, sum(s) AS total, count(*) AS n FROM p GROUP BY 1, 2), t AS (SELECT id, count(*) AS m FROM p GROUP BY 1)
SELECT id, first(v ORDER BY round(total, 6) DESC, n DESC, v) AS agreed, round(first(0.55 * total / n + 0.45 * n / m ORDER BY round(total, 6) DESC, n DESC, v) + 1e-9, 4) AS confidence FROM g JOIN t USING (id) GROUP BY id"""
)
def rolling_consensus(spark, sf_dir):
    df = states(spark, sf_dir).withColumn("v", F.col("object") % 4)
    return S.consensus(df, ["game"], ["seq"], "v", "reading").select("id", "agreed", F.round(F.col("confidence") + 1e-9, 4).alias("confidence"))


@query(f"{STATES} SELECT game, zone, round(sum(d), 6) AS delta FROM (SELECT game, zone, reading - lag(reading) OVER (PARTITION BY game ORDER BY seq) AS d FROM st) GROUP BY 1, 2")
def factor_deltas(spark, sf_dir):
    df = S.preceding(states(spark, sf_dir), ["game"], ["seq"], F.col("reading"), "before")
    return df.groupBy("game", "zone").agg(F.round(F.sum(F.col("reading") - F.col("before")), 6).alias("delta"))


@query(
    f"""{STATES}, a AS (SELECT * FROM st WHERE zone = 'purchase'), v AS (SELECT * FROM st WHERE zone = 'view'),
c AS (SELECT a.id, v.id AS vid, epoch_us(v.ts) - epoch_us(a.ts) AS gap FROM a JOIN v USING (game) WHERE abs(epoch_us(v.ts) - epoch_us(a.ts)) <= 36000000000)
SELECT a.id, coalesce((SELECT first(vid ORDER BY gap) FROM c WHERE c.id = a.id AND gap >= 0), (SELECT first(vid ORDER BY gap DESC) FROM c WHERE c.id = a.id AND gap < 0)) AS matched FROM a"""
)
def asof_state(spark, sf_dir):
    df = states(spark, sf_dir).select("game", "id", "ts", "zone")
    return M.asof(df.where("zone = 'purchase'"), df.where("zone = 'view'"), "game", "ts", "id", 36_000.0).select("id", "matched")


@query("SELECT conv_id, turn, CASE WHEN nr = 'assistant' THEN nt END AS response FROM (SELECT *, lead(role) OVER w AS nr, lead(turn) OVER w AS nt FROM conversations WHERE role IN ('user', 'assistant') WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user'")
def join_prompt_response(spark, sf_dir):
    return M.pair_responses(read(spark, sf_dir, "conversations"), "conv_id", "turn", "role").select("conv_id", "turn", "response")


@query(f"{WITH}, k AS (SELECT decision, list(DISTINCT part) AS pack FROM opt WHERE brand <> 'Brand#2' GROUP BY 1) SELECT d.decision, CASE WHEN pack IS NULL THEN 'no_pack' WHEN list_contains(pack, pick_part) THEN 'ok' ELSE 'not_in_pack' END AS status FROM dec d LEFT JOIN k USING (decision)")
def join_pack_pick(spark, sf_dir):
    packs = option_rows(spark, sf_dir).where("brand <> 'Brand#2'").groupBy("decision").agg(F.collect_set("part").alias("pack"))
    return M.draft_picks(packs, picks(spark, sf_dir).select("decision", F.col("pick_part").alias("picked")), ["decision"]).select("decision", "status")


@query("SELECT l_orderkey, l_suppkey, l_partkey, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY l_shipdate DESC, l_extendedprice DESC, l_partkey DESC) = 1")
def latest_analysis(spark, sf_dir):
    return M.latest(read(spark, sf_dir, "lineitem"), ["l_orderkey", "l_suppkey"], [F.desc("l_shipdate"), F.desc("l_extendedprice"), F.desc("l_partkey")]).select("l_orderkey", "l_suppkey", "l_partkey", "l_extendedprice")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def anti_cache(spark, sf_dir):
    orders, lines = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return M.unscored(orders, lines, ["o_orderkey"]).select("o_orderkey", "o_orderstatus")


@query(f"{WITH}, a AS (SELECT decision, supp AS checkpoint, first(part ORDER BY ts, idx DESC) AS top FROM opt GROUP BY 1, 2) SELECT d.decision, checkpoint, top = pick_part AS agrees FROM dec d JOIN a USING (decision)")
def join_decision_analysis(spark, sf_dir):
    """The analyses of every checkpoint."""
    analyses = M.latest(option_rows(spark, sf_dir), ["decision", "supp"], [F.desc("idx")]).select("decision", F.col("supp").alias("checkpoint"), F.col("part").alias("top"))
    return M.join_analysis(picks(spark, sf_dir), analyses, ["decision"], "checkpoint", several=True).select("decision", "checkpoint", (F.col("top") == F.col("pick_part")).alias("agrees"))


NAMES = "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN '  ' || upper(p_name) || ' ' ELSE p_name || ' xyz' END AS requested FROM part"


def requested_names(spark, sf_dir):
    name = F.col("p_name")
    return read(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, name).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("  "), F.upper(name), F.lit(" "))).otherwise(F.concat(name, F.lit(" xyz"))).alias("requested"))


@query(f"WITH n AS ({NAMES}), k AS (SELECT lower(p_name) AS l, min(p_name) AS f FROM part GROUP BY 1), e AS (SELECT DISTINCT p_name FROM part) SELECT p_partkey, coalesce(p_name, f) AS resolved, CASE WHEN p_name IS NOT NULL THEN 'exact' WHEN f IS NOT NULL THEN 'normalized' ELSE 'unresolved' END AS strategy FROM n LEFT JOIN e ON p_name = requested LEFT JOIN k ON l = lower(trim(requested))")
def resolve_name(spark, sf_dir):
    return M.resolve_names(requested_names(spark, sf_dir), read(spark, sf_dir, "part"), "requested", "p_name").select("p_partkey", "resolved", "strategy")


@query(
    f"""WITH n AS (SELECT DISTINCT requested, lower(trim(requested)) AS a FROM ({NAMES})), c AS (SELECT DISTINCT p_name, lower(p_name) AS b FROM part),
s AS (SELECT requested, p_name, round(1 - levenshtein(a, b) / greatest(length(a), length(b), 1)::DOUBLE, 6) AS score FROM n JOIN c ON list_has_any(string_split(a, ' '), string_split(b, ' ')))
SELECT requested, first(p_name ORDER BY score DESC, p_name) AS p_name, max(score) AS score FROM s WHERE score >= 0.6 GROUP BY requested"""
)
def resolve_fuzzy(spark, sf_dir):
    return M.fuzzy(requested_names(spark, sf_dir), read(spark, sf_dir, "part"), "requested", "p_name", 0.6)


@query(
    f"""{STATES}, e AS (SELECT game, zone, first(object ORDER BY seq) AS expected FROM st GROUP BY 1, 2), o AS (SELECT game, zone, first(object ORDER BY seq DESC) AS observed FROM st WHERE object % 2 = 0 GROUP BY 1, 2)
SELECT game, zone, CASE WHEN expected IS NULL OR observed IS NULL THEN 'UNKNOWN' WHEN expected = observed THEN 'MATCH' ELSE 'MISMATCH' END AS status FROM e FULL JOIN o USING (game, zone)"""
)
def compare_states(spark, sf_dir):
    df = states(spark, sf_dir)
    first = df.groupBy("game", "zone").agg(F.min_by("object", "seq").alias("object"))
    last = df.where("object % 2 = 0").groupBy("game", "zone").agg(F.max_by("object", "seq").alias("object"))
    return M.compared(first, last, ["game", "zone"], "object").select("game", "zone", "status")


@query(
    f"""{STATES}, e AS (SELECT game, zone, first(object ORDER BY seq) AS expected FROM st GROUP BY 1, 2), o AS (SELECT game, zone, first(object ORDER BY seq DESC) AS observed FROM st WHERE object % 2 = 0 GROUP BY 1, 2)
SELECT game, count(*) FILTER (expected = observed) AS matches, count(*) FILTER (expected <> observed) AS mismatches, count(*) FILTER (expected IS NULL OR observed IS NULL) AS unknowns, count(*) FILTER (expected <> observed) = 0 AS passed FROM e FULL JOIN o USING (game, zone) GROUP BY game"""
)
def comparison_summary(spark, sf_dir):
    rows = compare_states(spark, sf_dir)
    n = lambda s: F.count(F.when(F.col("status") == s, 1))
    return rows.groupBy("game").agg(n("MATCH").alias("matches"), n("MISMATCH").alias("mismatches"), n("UNKNOWN").alias("unknowns"), (n("MISMATCH") == 0).alias("passed"))


MATCHES = "WITH m AS (SELECT l_returnflag AS agent, l_partkey AS pair, avg(l_discount * 10) AS score FROM lineitem GROUP BY 1, 2)"


def match_table(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("agent"), F.col("l_partkey").alias("pair")).agg(F.avg(F.col("l_discount") * 10).alias("score"))


@query(f"{MATCHES} SELECT a.agent AS \"left\", b.agent AS \"right\", count(*) AS pairs, round(avg(a.score - b.score), 6) AS mean_delta FROM m a JOIN m b USING (pair) WHERE a.agent < b.agent GROUP BY 1, 2")
def paired_common(spark, sf_dir):
    return M.paired(match_table(spark, sf_dir), "agent", "pair", "score").groupBy("left", "right").agg(F.count("*").alias("pairs"), F.round(F.avg("delta"), 6).alias("mean_delta"))


@query(f"{MATCHES} SELECT a.agent AS \"left\", b.agent AS \"right\", count(*) FILTER (round(a.score - b.score, 9) > 0) AS left_better, count(*) FILTER (round(a.score - b.score, 9) < 0) AS right_better, count(*) FILTER (round(a.score - b.score, 9) = 0) AS ties FROM m a JOIN m b USING (pair) WHERE a.agent < b.agent GROUP BY 1, 2")
def pair_outcomes(spark, sf_dir):
    d = F.round("delta", 9)
    n = lambda c: F.count(F.when(c, 1))
    return M.paired(match_table(spark, sf_dir), "agent", "pair", "score").groupBy("left", "right").agg(n(d > 0).alias("left_better"), n(d < 0).alias("right_better"), n(d == 0).alias("ties"))


@query("SELECT DISTINCT l_partkey AS key FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R'")
def common_keys(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem")
    of = lambda f: lines.where(F.col("l_returnflag") == f).select(F.col("l_partkey").alias("key"))
    return of("A").intersect(of("R"))


@query("SELECT o_custkey AS key FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING'")
def unknown_keys(spark, sf_dir):
    return read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key")).subtract(read(spark, sf_dir, "customer").where("c_mktsegment <> 'BUILDING'").select("c_custkey"))


@query("SELECT l_partkey, l_suppkey FROM lineitem WHERE l_linestatus = 'F' EXCEPT ALL SELECT l_partkey, l_suppkey FROM lineitem WHERE l_linestatus = 'O'")
def multiset_diff(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem")
    return lines.where("l_linestatus = 'F'").select("l_partkey", "l_suppkey").exceptAll(lines.where("l_linestatus = 'O'").select("l_partkey", "l_suppkey"))


@query("SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity >= 45")
def distinct_ids(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").where("l_quantity >= 45").select("l_partkey").distinct()


@query("SELECT p_partkey, p_name FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity >= 49)")
def filter_to_cards(spark, sf_dir):
    seen = read(spark, sf_dir, "lineitem").where("l_quantity >= 49").select(F.col("l_partkey").alias("p_partkey"))
    return read(spark, sf_dir, "part").join(seen, "p_partkey", "left_semi").select("p_partkey", "p_name")


@query("SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem")
def dedupe_across_sources(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity").distinct()


@query("SELECT 'customer' AS source, c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier UNION ALL SELECT 'part', p_partkey, p_name FROM part")
def union_sources(spark, sf_dir):
    rows = [read(spark, sf_dir, t).select(F.lit(t).alias("source"), F.col(k).alias("id"), F.col(n).alias("name")) for t, k, n in (("customer", "c_custkey", "c_name"), ("supplier", "s_suppkey", "s_name"), ("part", "p_partkey", "p_name"))]
    return rows[0].unionByName(rows[1], allowMissingColumns=True).unionByName(rows[2], allowMissingColumns=True)


@query(f"{WITH}, g AS (SELECT game, count(*) AS n FROM dec GROUP BY 1) SELECT decision, CASE WHEN g.n = 1 THEN CASE WHEN total > 200000 THEN 1 ELSE -1 END END AS label FROM dec JOIN g USING (game)")
def outcome_join(spark, sf_dir):
    df = picks(spark, sf_dir)
    games = df.groupBy("gameId").agg(F.count("*").alias("games"))
    return df.join(games, "gameId").select("decision", F.when(F.col("games") == 1, F.when(F.col("total") > 200000, 1).otherwise(-1)).alias("label"))


@query(
    f"""{WITH}, p AS (SELECT DISTINCT game AS pool, pick_part AS card FROM dec), k AS (SELECT DISTINCT decision, part AS card FROM opt WHERE part IN (SELECT card FROM p)),
n AS (SELECT decision, count(*) AS known FROM k GROUP BY 1), s AS (SELECT decision, pool, count(*) AS shared FROM k JOIN p USING (card) GROUP BY 1, 2),
b AS (SELECT decision, first(pool ORDER BY shared DESC, pool) AS pool, max(shared) AS shared FROM s GROUP BY 1)
SELECT decision, pool, shared FROM b JOIN n USING (decision) WHERE shared * 2 >= known"""
)
def pool_match(spark, sf_dir):
    pools = picks(spark, sf_dir).select(F.col("gameId").alias("pool"), F.lit(0).alias("first"), F.col("pick_part").alias("card"))
    return M.pool_overlap(option_rows(spark, sf_dir).select("decision", F.col("part").alias("card")), pools, "decision", "pool", "card", "first")
