"""Queries of remaining scans, checks and scalar functions, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerline.functions import text as T
from ledgerline.operators import cards as C
from ledgerline.operators import normalize as N
from ledgerline.operators import records as R
from ledgerline.operators import statistics as S
from ledgerline.plans.log_queries import raw_log
from ledgerline.plans.registry import query
from ledgerline.plans.scratch import shared_folder
from ledgerline.plans.views import OPTIONS_SQL, STATES_SQL, decisions, option_rows, read, states
from ledgerline.sources import files

WITH = f"WITH {OPTIONS_SQL}"
STATES = f"WITH {STATES_SQL}"
LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
KEYS = ", ".join(LINE)


@query("SELECT c_custkey, c_name, c_nationkey FROM customer")
def write_jsonl(spark, sf_dir):
    path = shared_folder(spark, "jsonl")
    files.write_jsonl(read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey"), path)
    rows, _ = files.read_jsonl(spark, path)
    return rows.select(N.field("c_custkey", "bigint").alias("c_custkey"), N.field("c_name").alias("c_name"), N.field("c_nationkey", "bigint").alias("c_nationkey"))


@query("SELECT p_partkey, p_name AS name FROM part")
def decode_text(spark, sf_dir):
    k = F.col("p_partkey") % 3
    raw = F.when(k == 0, F.encode("p_name", "UTF-8")).when(k == 1, F.concat(F.lit(bytearray(b"\xef\xbb\xbf")), F.encode("p_name", "UTF-8"))).otherwise(F.encode("p_name", "UTF-16"))
    return read(spark, sf_dir, "part").select("p_partkey", files.decode_bytes(raw).alias("name"))


@query(f"{WITH} SELECT game AS file, seq, prompt FROM dec")
def current_state(spark, sf_dir):
    rows = raw_log(spark, sf_dir).withColumn("record", files.parsed(F.col("value"))).where(~N.has("result"))
    return rows.select("file", N.as_int("sequenceNumber", "sequence").alias("seq"), F.coalesce(N.field("observation.select.type"), N.field("select.type")).alias("prompt"))


@query(f"{STATES} SELECT id, coalesce(CASE WHEN object % 3 = 0 THEN 'name ' || object END, 'p' || (object % 2), '?') AS label FROM st")
def player_label(spark, sf_dir):
    o = F.col("object")
    return states(spark, sf_dir).select("id", F.coalesce(F.when(o % 3 == 0, F.concat(F.lit("name "), o)), F.concat(F.lit("p"), o % 2), F.lit("?")).alias("label"))


@query(f"{WITH} SELECT prompt, count(*) AS n FROM dec GROUP BY 1")
def prompt_type(spark, sf_dir):
    return decisions(spark, sf_dir).groupBy(R.prompt_type().alias("prompt")).agg(F.count("*").alias("n"))


@query(f"SELECT {KEYS}, round(tanh(l_quantity / 20), 6) AS x FROM lineitem")
def norm(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").select(*LINE, F.round(T.norm(F.col("l_quantity"), 20), 6).alias("x"))


@query(f"SELECT {KEYS}, round(tanh((l_tax - l_discount) / 0.05), 6) AS d FROM lineitem")
def delta(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").select(*LINE, F.round(T.delta(F.col("l_discount"), F.col("l_tax"), 0.05), 6).alias("d"))


@query(f"SELECT {KEYS}, round(1 / (1 + exp(-(l_tax - l_discount) * 10)), 6) AS p FROM lineitem")
def pref_prob(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").select(*LINE, F.round(S.sigmoid((F.col("l_tax") - F.col("l_discount")) * 10), 6).alias("p"))


@query("SELECT event_id, round(1 / (1 + exp(-(value - 50) / 10)), 6) AS p FROM events")
def sigmoid(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", F.round(S.sigmoid((F.col("value") - 50) / 10), 6).alias("p"))


@query(f"SELECT {KEYS}, round(-(0.7 * l_quantity - 2 * l_discount), 6) AS cost FROM lineitem")
def cost(spark, sf_dir):
    u = C.utility({"q": 0.7, "d": -2.0}, {"q": F.col("l_quantity"), "d": F.col("l_discount")})
    return read(spark, sf_dir, "lineitem").select(*LINE, F.round(-u, 6).alias("cost"))


@query(f"{STATES} SELECT id, round(0.95 * lead(reading) OVER (PARTITION BY game ORDER BY seq) - reading, 6) AS reward FROM st")
def shaping(spark, sf_dir):
    after = F.lead("reading").over(Window.partitionBy("game").orderBy("seq"))
    return states(spark, sf_dir).select("id", F.round(C.shaping(F.col("reading"), after, 0.95), 6).alias("reward"))


@query(f"SELECT {KEYS}, round(l_discount * (0.35 + 0.65 * l_tax), 8) AS score FROM lineitem")
def combine_scores(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").select(*LINE, F.round(T.combined_score(F.col("l_tax"), F.col("l_discount")), 8).alias("score"))


@query(f"{WITH} SELECT coalesce(akey::VARCHAR, 'index:' || idx) AS group_key, count(*) AS n FROM opt GROUP BY 1")
def group_key(spark, sf_dir):
    return option_rows(spark, sf_dir).groupBy(F.coalesce(F.col("akey").cast("string"), F.concat(F.lit("index:"), "idx")).alias("group_key")).agg(F.count("*").alias("n"))
