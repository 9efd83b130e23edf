"""Queries of features, scorers and example rows, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.operators import features as X
from ledgerline.operators import normalize as N
from ledgerline.operators import records as R
from ledgerline.operators import statistics as S
from ledgerline.plans.log_queries import raw_log
from ledgerline.plans.record_queries import CHOSEN, as_actions
from ledgerline.plans.registry import query
from ledgerline.plans.scratch import shared_folder
from ledgerline.plans.sequence_queries import picks
from ledgerline.plans.views import OPTIONS_SQL, STATES_SQL, decisions, option_rows, read, states
from ledgerline.sources import files
from ledgerline.streaming import streams

WITH = f"WITH {OPTIONS_SQL}"
STATES = f"WITH {STATES_SQL}"


@query(f"{WITH} SELECT decision, idx, rank FROM (SELECT decision, idx, row_number() OVER (PARTITION BY decision ORDER BY round(score_a - 0.01 * idx, 9) DESC, idx) AS rank FROM opt) WHERE rank = 1")
def scorer_udf(spark, sf_dir):
    from ledgerline.operators.ranking import ranked

    rows = option_rows(spark, sf_dir).withColumn("s", F.round(X.scorer("blend", F.col("idx"), F.col("score_a")), 9))
    return ranked(rows, ["decision"], "s").where("rank = 1").select("decision", "idx", "rank")


@query(f"{STATES} SELECT id, 'turn=' || seq || ' | phase=' || zone || CASE WHEN object % 2 = 0 THEN ' | active=' || object ELSE '' END AS text FROM st")
def state_text(spark, sf_dir):
    parts = {"turn": F.col("seq"), "phase": F.col("zone"), "active": F.when(F.col("object") % 2 == 0, F.col("object"))}
    return states(spark, sf_dir).select("id", X.state_text(parts).alias("text"))


@query(f"{WITH} SELECT prompt, kind AS option_type, count(*) AS n FROM opt GROUP BY 1, 2")
def option_type(spark, sf_dir):
    rows = decisions(spark, sf_dir).select(R.prompt_type().alias("prompt"), F.explode("select.option").alias("o"))
    return rows.groupBy("prompt", F.coalesce("o.type", F.lit(R.UNKNOWN)).alias("option_type")).agg(F.count("*").alias("n"))


@query(f"{WITH} SELECT decision, idx, {CHOSEN} AS bucket FROM opt")
def abstract_option(spark, sf_dir):
    rows = decisions(spark, sf_dir)
    return rows.select("decision", "select.type", F.explode("select.option").alias("o")).select("decision", F.col("o.index").alias("idx"), as_actions(F.col("o.type"), F.col("type")).alias("bucket"))


@query(f"{STATES} SELECT game, zone, string_agg(DISTINCT (object % 10)::VARCHAR, ',' ORDER BY (object % 10)::VARCHAR) AS names, zone || '|' || string_agg(DISTINCT (object % 10)::VARCHAR, ',' ORDER BY (object % 10)::VARCHAR) AS akey FROM st GROUP BY 1, 2")
def canonical_key(spark, sf_dir):
    rows = states(spark, sf_dir).groupBy("game", "zone").agg(F.collect_set((F.col("object") % 10).cast("string")).alias("o"))
    key = X.canonical_key(F.col("zone"), F.lit(None).cast("string"), F.col("o"))
    return rows.select("game", "zone", F.array_join(F.array_sort("o"), ",").alias("names"), key.alias("akey"))


@query(f"{STATES} SELECT id, CASE WHEN zone = 'error' THEN 0.0 WHEN zone = 'view' THEN round(least(1, reading / 20), 6) ELSE 1.0 END::DOUBLE AS confidence FROM st".replace("END::DOUBLE", "END").replace("THEN 0.0", "THEN 0.0::DOUBLE"))
def confidence_at(spark, sf_dir):
    confidence = F.create_map(F.lit("view"), F.col("reading") / 20)
    return states(spark, sf_dir).select("id", F.round(X.confidence_at(F.col("zone"), confidence, F.array(F.lit("error"))), 6).alias("confidence"))


@query("SELECT o_orderkey, coalesce(CASE WHEN o_orderstatus = 'P' THEN 1 END, CASE WHEN o_orderkey % 2 = 0 THEN 2 END, 3) AS seat FROM orders")
def seat_of(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", X.seat_of(F.when(F.col("o_orderstatus") == "P", 1), F.when(F.col("o_orderkey") % 2 == 0, 2), F.lit(3)).alias("seat"))


@query(f"{WITH} SELECT decision, round(max(score_a) + ln(sum(exp(score_a - m))), 6) AS logsumexp FROM (SELECT *, max(score_a) OVER (PARTITION BY decision) AS m FROM opt) GROUP BY decision")
def logsumexp(spark, sf_dir):
    return X.logsumexp(option_rows(spark, sf_dir), ["decision"], "score_a").select("decision", F.round("logsumexp", 6).alias("logsumexp"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, factor, round(contribution, 6) AS contribution FROM (SELECT *, unnest(['l_quantity', 'l_discount']) AS factor, unnest([l_quantity * 0.1, l_discount * -2]) AS contribution FROM lineitem)")
def explain(spark, sf_dir):
    rows = X.explain(read(spark, sf_dir, "lineitem"), {"l_quantity": 0.1, "l_discount": -2.0})
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "factor", F.round("contribution", 6).alias("contribution"))


@query(f"{WITH} SELECT decision, least(decision % 4, n) AS chosen FROM dec")
def baseline_select(spark, sf_dir):
    rows = picks(spark, sf_dir)
    return rows.select("decision", F.size(X.baseline_select(rows, F.col("decision") % 4, F.col("n"))).cast("long").alias("chosen"))


@query(f"{STATES} SELECT id, reading AS before, coalesce(lead(reading) OVER (PARTITION BY game ORDER BY seq), -1) AS after FROM st".replace("AS before", 'AS "before"').replace("AS after", 'AS "after"'))
def run_transitions(spark, sf_dir):
    return X.steps(states(spark, sf_dir), "game", "seq", "reading", F.lit(-1.0)).select("id", "before", "after")


@query(f"{WITH}, r AS (SELECT *, sum((prompt = '1-URGENT')::INT) OVER (PARTITION BY game ORDER BY seq) AS run FROM dec) SELECT decision, count(pick_part) OVER (PARTITION BY game, run ORDER BY seq) AS picked FROM r")
def draft_state(spark, sf_dir):
    return X.running_pack(picks(spark, sf_dir), "gameId", "sequenceNumber", "pick_part", F.col("prompt") == "1-URGENT").select("decision", "picked")


@query(f"{WITH} SELECT source = 'P' AS canonical, count(*) AS n, count(*) FILTER (terminal) AS terminal FROM dec GROUP BY 1")
def read_decisions(spark, sf_dir):
    """Raw lines are written as text files, one folder, then scanned, normalised and folded."""
    path = shared_folder(spark, "decisions")
    log = raw_log(spark, sf_dir)
    log.repartition("file").sortWithinPartitions("file", "line").select("value").write.text(path)
    lines, _ = files.read_jsonl(spark, path, mode="quarantine")
    rows = N.fold_result(N.normalize(lines.select("file", "line", "record")))
    return rows.groupBy((F.col("shape") == "canonical").alias("canonical")).agg(F.count("*").alias("n"), F.count(F.when(F.col("terminal"), 1)).alias("terminal"))


@query("SELECT p_partkey, 'card | name=' || p_name || ' | type=' || p_type || CASE WHEN p_size > 25 THEN ' | size=' || p_size ELSE '' END AS text FROM part")
def card_text(spark, sf_dir):
    parts = {"name": F.col("p_name"), "type": F.col("p_type"), "size": F.when(F.col("p_size") > 25, F.col("p_size"))}
    return read(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" | ", F.lit("card"), X.state_text(parts)).alias("text"))
