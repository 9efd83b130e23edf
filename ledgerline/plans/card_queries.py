"""Queries of smaller record operators, state folds and Python-side operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerline.functions import text as T
from ledgerline.operators import cards as C
from ledgerline.operators import features as X
from ledgerline.operators import matching as M
from ledgerline.operators import redaction as D
from ledgerline.operators import state as G
from ledgerline.operators import statistics as S
from ledgerline.plans.log_queries import records
from ledgerline.plans.registry import query
from ledgerline.plans.scratch import shared_folder
from ledgerline.plans.sequence_queries import picks
from ledgerline.plans.views import OPTIONS_SQL, STATES_SQL, option_rows, read, states

WITH = f"WITH {OPTIONS_SQL}"
STATES = f"WITH {STATES_SQL}"


@query(f"{WITH} SELECT game AS file, seq, decision % 2 AS player FROM dec")
def as_int(spark, sf_dir):
    return records(spark, sf_dir).where("shape <> 'result'").select("file", F.col("sequenceNumber").alias("seq"), F.col("playerIndex").alias("player"))


@query(f"{WITH} SELECT game AS file, seq, 1 AS n, pick FROM dec")
def as_index_list(spark, sf_dir):
    return records(spark, sf_dir).where("shape <> 'result'").select("file", F.col("sequenceNumber").alias("seq"), F.size("selectedIndices").cast("long").alias("n"), F.col("selectedIndices")[0].alias("pick"))


@query(f"{WITH} SELECT prompt, sum(n)::BIGINT AS options FROM dec GROUP BY 1")
def select_block(spark, sf_dir):
    return records(spark, sf_dir).where("shape <> 'result'").groupBy(F.col("select.type").alias("prompt")).agg(F.sum(F.size("select.option")).alias("options"))


@query(f"{WITH} SELECT source = 'P' AS canonical, count(*) AS n FROM dec GROUP BY 1")
def is_canonical(spark, sf_dir):
    return records(spark, sf_dir).where("shape <> 'result'").groupBy((F.col("shape") == "canonical").alias("canonical")).agg(F.count("*").alias("n"))


@query("SELECT p_partkey, p_name AS name FROM part")
def json_unwrap(spark, sf_dir):
    inner = F.to_json(F.struct(F.to_json(F.struct(F.col("p_name").alias("name"))).alias("request")))
    raw = F.to_json(F.struct(inner.alias("payload")))
    return read(spark, sf_dir, "part").select("p_partkey", F.get_json_object(C.unwrap_payload(raw), "$.name").alias("name"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def extract_json(spark, sf_dir):
    raw = F.concat(F.lit("[log] "), F.col("event_type"), F.lit(" => "), F.col("props"))
    at = F.instr(raw, "{")
    return read(spark, sf_dir, "events").select("event_id", F.get_json_object(C.extract_json(F.substr(raw, at - 1)), "$.k").cast("long").alias("k"))


@query("SELECT l_orderkey, l_partkey, sum(greatest(1, l_quantity::INT))::BIGINT AS copies FROM lineitem GROUP BY 1, 2")
def expand_deck_entries(spark, sf_dir):
    return C.expand_deck(read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity"), "l_partkey", "l_quantity").groupBy("l_orderkey", "l_partkey").agg(F.count("*").alias("copies"))


@query("SELECT p_partkey, p_partkey + p_size AS total FROM part")
def card_ids_from_cards(spark, sf_dir):
    ids = C.card_ids(F.concat_ws(", ", "p_partkey", F.lit("x"), "p_size"))
    return read(spark, sf_dir, "part").select("p_partkey", F.aggregate(ids, F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


def alias_sql(x: str) -> str:
    """A pseudonym in DuckDB."""
    return f"'id_' || format('{{:08x}}', list_reduce(list_prepend(2166136261, list_transform(string_split({x}, ''), lambda c: unicode(c)::BIGINT)), lambda a, c: xor(a, c) * 16777619 % 4294967296))"


@query(
    f"""SELECT c_custkey, '{{"life":' || c_custkey || ',"matchIds":["' || {alias_sql("c_custkey::VARCHAR")} || '","' || {alias_sql("'m-' || c_custkey")} || '",null,"",["' || {alias_sql("'True'")} || '"]],"ok":true,'
  || '"opponent":{{"colors":["W",{{}}],"deep":{{"players":[{{"deck":{{"list":[[{{"gameId":"' || {alias_sql("c_custkey::VARCHAR")} || '"}}]],"title":"<redacted>"}},"screenName":"' || {alias_sql("c_name")} || '"}}]}},"name":"' || {alias_sql("c_name")} || '"}},'
  || '"token":"<redacted>","you":{{"e-mail":"<redacted>","hand":[{{"name":"a \\"card\\" é"}}],"name":"' || {alias_sql("c_name")} || '","playerName":"' || {alias_sql("c_name")} || '"}}}}' AS record FROM customer"""
)
def redact_json(spark, sf_dir):
    """A record of every customer, seven levels deep."""
    key, name = F.col("c_custkey").cast("string"), F.to_json(F.array("c_name"))
    name = F.substr(name, F.lit(2), F.length(name) - 2)
    record = F.concat(
        F.lit('{"you": {"playerName": '), name, F.lit(', "e-mail": "x", "name": '), name, F.lit(', "hand": [{"name": "a \\"card\\" é"}]}, "ok": true, "token": {"a": [1]}, "life": '), key,
        F.lit(', "matchIds": ['), key, F.lit(', "m-'), key, F.lit('", null, "", [true]], "opponent": {"name": '), name, F.lit(', "colors": ["W", {}], "deep": {"players": [{"screenName": '), name,
        F.lit(', "deck": {"title": "t", "list": [[{"gameId": '), key, F.lit("}]]}}]}}}"),
    )
    shared_folder(spark, "redact")  # a folder for checkpoints
    return D.redacted(read(spark, sf_dir, "customer").select("c_custkey", record.alias("record")), "record")


@query(f"{STATES}, f AS (SELECT game, zone, min(seq) AS first FROM st GROUP BY 1, 2), a AS (SELECT game, zone, 'player:' || row_number() OVER (PARTITION BY game ORDER BY first, zone) AS alias FROM f) SELECT id, alias FROM st JOIN a USING (game, zone)")
def actor_alias(spark, sf_dir):
    return C.actor_alias(states(spark, sf_dir), "game", "zone", "seq").select("id", "alias")


@query(f"{STATES} SELECT game, zone AS kind, sum(object)::BIGINT AS n FROM st GROUP BY 1, 2")
def counter_map(spark, sf_dir):
    return C.counter_map(states(spark, sf_dir), ["game"], "zone", "object").select("game", F.explode("counters").alias("kind", "n"))


@query("SELECT l_orderkey AS deck, count(DISTINCT CASE WHEN p_brand = 'Brand#2' THEN p_name END) = 0 AS valid FROM lineitem JOIN (SELECT p_partkey, p_name || ' ' || p_partkey AS p_name, p_brand FROM part) ON p_partkey = l_partkey GROUP BY 1")
def validate_deck(spark, sf_dir):
    part = read(spark, sf_dir, "part").withColumn("name", F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")))
    entries = read(spark, sf_dir, "lineitem").join(part, F.col("p_partkey") == F.col("l_partkey")).select(F.col("l_orderkey").alias("deck"), "name")
    return C.validate_decks(entries, part.where("p_brand <> 'Brand#2'"), "deck", "name", "name").select("deck", "valid")


@query("SELECT event_id, event_id % 3 = 0 AS forbidden FROM events")
def forbidden_key_scan(spark, sf_dir):
    raw = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"a": {"E-Mail": 1}, "b": '), "props", F.lit("}"))).otherwise(F.concat(F.lit('{"text": "email", "b": '), "props", F.lit("}")))
    return read(spark, sf_dir, "events").select("event_id", C.forbidden_keys(raw, D.SENSITIVE).alias("forbidden"))


@query("SELECT conv_id, turn, regexp_matches(lower(text), 'draw|cast|play|attack|block|damage|counter|target|trigger|mulligan|keep|concede|wins|loses') AS worth FROM conversations")
def worth_preserving(spark, sf_dir):
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", C.worth_keeping(F.col("text")).alias("worth"))


def sentences(spark, sf_dir):
    k = F.col("o_orderkey") % 4
    line = F.when(k == 0, F.concat(F.lit("P1 casts Big "), "o_orderpriority", F.lit(" targeting Gate."))).when(k == 1, "P2 attacks with Wall").when(k == 2, "P1 gains 3 life.").otherwise("noise here")
    return read(spark, sf_dir, "orders").select("o_orderkey", line.alias("line"))


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'CAST_SPELL' WHEN 1 THEN 'ATTACK' WHEN 2 THEN 'GAIN_LIFE' END AS action_type, CASE o_orderkey % 4 WHEN 0 THEN 'P1' WHEN 1 THEN 'P2' WHEN 2 THEN 'P1' END AS actor, CASE o_orderkey % 4 WHEN 0 THEN 'Big ' || o_orderpriority WHEN 1 THEN 'Wall' END AS card, CASE WHEN o_orderkey % 4 = 0 THEN 'Gate.' END AS target, CASE WHEN o_orderkey % 4 = 2 THEN '3' END AS amount FROM orders")
def parse_game_text(spark, sf_dir):
    return sentences(spark, sf_dir).select("o_orderkey", C.parse_sentence(F.col("line")).alias("s")).select("o_orderkey", "s.action_type", "s.actor", "s.card", "s.target", "s.amount")


@query(f"{STATES}, d AS (SELECT game, seq, min(id) AS state FROM st WHERE zone <> 'error' GROUP BY 1, 2), l AS (SELECT game, max_by(id, seq) AS last FROM st WHERE zone <> 'error' GROUP BY 1) SELECT st.id, coalesce(state, last) AS state FROM st LEFT JOIN d USING (game, seq) LEFT JOIN l USING (game)")
def index_decisions_by_state(spark, sf_dir):
    rows = states(spark, sf_dir)
    boards = rows.where("zone <> 'error'")
    at = boards.groupBy("game", "seq").agg(F.min("id").alias("state"))
    last = boards.groupBy("game").agg(F.max_by("id", "seq").alias("last"))
    return rows.join(at, ["game", "seq"], "left").join(last, "game", "left").select("id", F.coalesce("state", "last").alias("state"))


@query(
    f"""{STATES}, a AS (SELECT *, object % 2 AS parity, row_number() OVER (PARTITION BY game, zone, object ORDER BY id) AS p FROM st),
b AS (SELECT game, zone, id, o AS object, o % 2 AS parity, row_number() OVER (PARTITION BY game, zone, o ORDER BY id) AS p FROM (SELECT *, lag(object) OVER (PARTITION BY game, zone ORDER BY seq) AS o FROM st)),
m1 AS (SELECT a.game, a.id AS e, b.id AS o, 1.0 AS score FROM a JOIN b USING (game, zone, object, p)),
a2 AS (SELECT *, row_number() OVER (PARTITION BY game, zone, parity ORDER BY id) AS q FROM a WHERE id NOT IN (SELECT e FROM m1)),
b2 AS (SELECT *, row_number() OVER (PARTITION BY game, zone, parity ORDER BY id) AS q FROM b WHERE id NOT IN (SELECT o FROM m1)),
m2 AS (SELECT a2.game, a2.id AS e, b2.id AS o, 0.6 AS score FROM a2 JOIN b2 USING (game, zone, parity, q)),
a3 AS (SELECT *, row_number() OVER (PARTITION BY game, zone ORDER BY id) AS r FROM a2 WHERE id NOT IN (SELECT e FROM m2)),
b3 AS (SELECT *, row_number() OVER (PARTITION BY game, zone ORDER BY id) AS r FROM b2 WHERE id NOT IN (SELECT o FROM m2)),
m3 AS (SELECT a3.game, a3.id AS e, b3.id AS o, 0.5 AS score FROM a3 JOIN b3 USING (game, zone, r))
SELECT game, e AS expected_id, o AS observed_id, score::DOUBLE AS score FROM (SELECT * FROM m1 UNION ALL SELECT * FROM m2 UNION ALL SELECT * FROM m3)"""
)
def object_match(spark, sf_dir):
    """All states of a game's zone, against the same states seen late: each with the object of the one before in its zone."""
    rows = states(spark, sf_dir)
    late = rows.withColumn("object", F.lag("object").over(Window.partitionBy("game", "zone").orderBy("seq")))
    expected, observed = (d.withColumn("parity", F.col("object") % 2) for d in (rows, late))
    shared_folder(spark, "match")  # a folder for checkpoints
    return M.greedy_match(expected, observed, ["game", "zone"], {"zone": 0.5, "object": 0.4, "parity": 0.1}).drop("zone")


@query(f"{WITH}, s AS (SELECT o.decision, idx, round(CASE WHEN kind = pick_kind THEN 0.45 WHEN left(kind, 1) = left(pick_kind, 1) THEN 0.28 ELSE 0 END + CASE WHEN part = pick_part THEN 0.38 ELSE 0 END + CASE WHEN akey IS NOT NULL THEN 0.12 ELSE 0 END, 6) AS score FROM opt o JOIN dec d ON d.decision = o.decision) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY decision ORDER BY score DESC, idx) AS rank FROM s) WHERE rank = 1")
def option_action_match(spark, sf_dir):
    rows = option_rows(spark, sf_dir).join(picks(spark, sf_dir).select("decision", "pick_kind", "pick_part"), "decision")
    same = F.col("kind") == F.col("pick_kind")
    out = C.option_match(rows, ["decision"], same, F.substring("kind", 1, 1) == F.substring("pick_kind", 1, 1), F.col("part") == F.col("pick_part"), F.col("akey").isNotNull(), F.lit(False))
    return out.where("rank = 1").select("decision", "idx", F.col("score").cast("double").alias("score"), "rank")


@query(f"{WITH}, r AS (SELECT *, price > 40000 AS pos, row_number() OVER (PARTITION BY decision ORDER BY score_a DESC, idx) AS r, sum((price > 40000)::INT) OVER (PARTITION BY decision) AS k FROM opt), p AS (SELECT decision, max((pos AND r = 1)::INT) AS top1, sum((pos AND r <= k)::INT) / any_value(k)::DOUBLE AS recall, 1.0 / min(CASE WHEN pos THEN r END) AS rr FROM r WHERE k > 0 GROUP BY 1) SELECT count(*) AS decisions, round(avg(top1), 6) AS top1, round(avg(recall), 6) AS recall, round(avg(rr), 6) AS mrr FROM p")
def selection_metrics(spark, sf_dir):
    return C.selection_metrics(option_rows(spark, sf_dir).withColumn("pos", F.col("price") > 40000), ["decision"], "score_a", "pos")


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20".replace("o_orderkey, o_orderdate FROM", "o_orderkey FROM"))
def recent_bundles(spark, sf_dir):
    return read(spark, sf_dir, "orders").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(20).select("o_orderkey")


@query(f"{STATES}, c AS (SELECT game, zone, count(*) AS n FROM st GROUP BY 1, 2) SELECT game, string_agg(zone || '=' || n, ';' ORDER BY zone) AS map FROM c GROUP BY 1".replace("AS map", 'AS "map"'))
def sort_stable_keys(spark, sf_dir):
    counts = states(spark, sf_dir).groupBy("game", "zone").agg(F.count("*").alias("n"))
    return counts.groupBy("game").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("zone", "n"))), lambda r: F.concat(r["zone"], F.lit("="), r["n"])), ";").alias("map"))


@query(f"{STATES}, c AS (SELECT game, zone, object % 4 AS o, count(*) AS n FROM st GROUP BY 1, 2, 3) SELECT game, zone, string_agg(o || CASE WHEN n > 1 THEN ' x' || n ELSE '' END, ', ' ORDER BY o) || ' (' || sum(n) || ')' AS summary FROM c GROUP BY 1, 2")
def zone_summary(spark, sf_dir):
    return C.zone_summary(states(spark, sf_dir).withColumn("o", F.col("object") % 4), ["game", "zone"], "o")


@query(f"{WITH} SELECT decision, sha256('m|' || game || '|' || seq) AS context FROM dec")
def sequence_context(spark, sf_dir):
    return picks(spark, sf_dir).select("decision", T.sha_key(F.lit("m"), F.col("gameId"), F.col("sequenceNumber"), sep="|").alias("context"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(0.7 * ln(1 + l_quantity) - 2 * l_discount, 6) AS utility, round(-(0.7 * ln(1 + l_quantity) - 2 * l_discount), 6) AS cost, round(1 / (1 + exp(-(0.7 * ln(1 + l_quantity) - 2 * l_discount))), 6) AS preference, round(0.9 * l_tax - l_discount, 6) AS shaped FROM lineitem")
def utility(spark, sf_dir):
    u = C.utility({"q": 0.7, "d": -2.0}, {"q": S.oriented(F.col("l_quantity"), "log1p"), "d": F.col("l_discount")})
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(u, 6).alias("utility"), F.round(-u, 6).alias("cost"), F.round(S.sigmoid(u), 6).alias("preference"), F.round(C.shaping(F.col("l_discount"), F.col("l_tax"), 0.9), 6).alias("shaped"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_tax > l_discount THEN l_returnflag ELSE l_linestatus END AS value, round(l_discount * (0.35 + 0.65 * l_tax), 6) AS combined FROM lineitem")
def merge_readings(spark, sf_dir):
    value = C.merged_reading(F.col("l_linestatus"), F.col("l_discount"), F.col("l_returnflag"), F.col("l_tax"))
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", value.alias("value"), F.round(T.combined_score(F.col("l_tax"), F.col("l_discount")), 6).alias("combined"))


@query("SELECT a.p_partkey, lower(a.p_name) = lower(b.p_name) AS same FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1")
def semantic_equal(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    other = part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.upper("p_name").alias("other"))
    return part.join(other, "p_partkey").select("p_partkey", M.semantic_equal(F.col("p_name"), F.col("other")).alias("same"))


@query(f"{WITH} SELECT decision, idx, coalesce(akey::VARCHAR, 'index:' || idx) AS group_key, kind || ' ' || label AS identity FROM opt")
def option_identity(spark, sf_dir):
    return option_rows(spark, sf_dir).select("decision", "idx", F.coalesce(F.col("akey").cast("string"), F.concat(F.lit("index:"), "idx")).alias("group_key"), F.concat_ws(" ", "kind", "label").alias("identity"))


@query(f"{STATES} SELECT id, upper(left(zone, 1)) || substr(zone, 2) || ' / ' || (object % 5) AS label FROM st")
def phase_label(spark, sf_dir):
    return states(spark, sf_dir).select("id", T.phase_label(F.concat(F.lit("Phase_"), F.initcap("zone")), F.concat(F.lit("Step_"), F.col("object") % 5)).alias("label"))


@query(f"{WITH}, g AS (SELECT decision, seq, game, prompt, n, pick FROM dec) SELECT decision, n, CASE WHEN decision % 5 = 0 THEN -1 ELSE least(decision % 7, n - 1) END AS selection FROM g")
def action_to_selection(spark, sf_dir):
    n = F.col("n")
    action = F.when(F.col("decision") % 5 == 0, n).otherwise(F.least(F.col("decision") % 7, n - 1))
    return picks(spark, sf_dir).select("decision", "n", F.when(action == n, F.lit(-1).cast("long")).otherwise(action).alias("selection"))


@query(f"{STATES}, e AS (SELECT *, sum((zone = 'click')::INT) OVER (PARTITION BY game ORDER BY seq) AS entry FROM st) SELECT game AS file, entry::BIGINT AS entry, count(*) AS lines, string_agg(zone, chr(10) ORDER BY seq) AS text FROM e WHERE entry > 0 GROUP BY 1, 2")
def assemble_entries(spark, sf_dir):
    rows = C.assemble_entries(states(spark, sf_dir).withColumnRenamed("game", "file"), "file", "seq", "zone", "^click$")
    return rows.select("file", F.col("entry").cast("long").alias("entry"), "lines", "text")


@query(f"{STATES}, w AS (SELECT a.game, a.seq, sum(b.reading * power(0.5, a.seq - b.seq)) AS score FROM st a JOIN st b ON b.game = a.game AND b.seq <= a.seq GROUP BY 1, 2) SELECT game, seq, round(score + 1e-9, 3) AS score FROM w")
def stateful_scorer(spark, sf_dir):
    return G.running_scores(states(spark, sf_dir)).select("game", "seq", F.round(F.col("score") + 1e-9, 3).alias("score"))


@query()
def card_embed_udf(spark, sf_dir):
    return X.hash_embedding(read(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name")
