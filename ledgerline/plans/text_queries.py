"""Queries of text and key functions, cards and summaries, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerline.functions import text as T
from ledgerline.operators import matching as M
from ledgerline.plans.card_queries import alias_sql
from ledgerline.plans.registry import query
from ledgerline.plans.sequence_queries import picks
from ledgerline.plans.views import OPTIONS_SQL, STATES_SQL, option_rows, read, states

WITH = f"WITH {OPTIONS_SQL}"
STATES = f"WITH {STATES_SQL}"


@query("SELECT p_partkey, trim(regexp_replace(regexp_replace(p_name || '  instance=' || p_partkey || ' id=x  ' || p_brand, '\\b(instance|id)=\\S+', '', 'g'), '\\s+', ' ', 'g')) AS text FROM part")
def canonical_text(spark, sf_dir):
    raw = F.concat(F.col("p_name"), F.lit("  instance="), F.col("p_partkey"), F.lit(" id=x  "), F.col("p_brand"))
    return read(spark, sf_dir, "part").select("p_partkey", T.canonical_text(raw).alias("text"))


@query(f"{WITH} SELECT decision, idx, 'type=' || kind || ' | label=' || label || coalesce(' | key=' || akey, '') AS text FROM opt")
def option_text(spark, sf_dir):
    return option_rows(spark, sf_dir).select("decision", "idx", T.option_text(F.col("kind"), F.col("label"), F.col("akey")).alias("text"))


@query("WITH t AS (SELECT unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS token FROM benchmark) SELECT token, count(*) AS n FROM t GROUP BY 1")
def tokenize(spark, sf_dir):
    return read(spark, sf_dir, "benchmark").select(F.explode(T.tokenize(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


@query(r"""WITH l AS (SELECT page_id, unnest(regexp_split_to_array(regexp_replace(regexp_replace(replace(html, '@P', chr(10)), '(?i)<br\s*/?>', chr(10), 'g'), '<[^>]+>', ' ', 'g'), '\r\n|\r|\n')) AS x FROM pages),
s AS (SELECT page_id, trim(regexp_replace(x, '\s+', ' ', 'g')) AS x FROM l) SELECT page_id, count(*) FILTER (x <> '') AS lines, coalesce(sum(length(x)), 0)::BIGINT AS characters FROM s GROUP BY 1""")
def text_records(spark, sf_dir):
    rows = read(spark, sf_dir, "pages").select("page_id", T.text_records(F.col("html")).alias("r"))
    return rows.select("page_id", F.size("r").cast("long").alias("lines"), F.aggregate("r", F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("characters"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 THEN 'soon' ELSE strftime(o_orderdate + INTERVAL (o_orderkey % 86400) SECOND, '%Y-%m-%dT%H:%M:%S') END AS iso FROM orders")
def parse_timestamp(spark, sf_dir):
    at = F.timestamp_seconds(F.unix_timestamp(F.col("o_orderdate").cast("timestamp")) + F.col("o_orderkey") % 86400)
    k = F.col("o_orderkey") % 5
    raw = F.when(k == 0, F.date_format(at, "yyyy-MM-dd hh:mm:ss a")).when(k == 1, F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(": more"))).when(k == 2, F.date_format(at, "yyyy/MM/dd HH:mm:ss")).when(k == 3, F.concat(F.date_format(at, "dd.MM.yyyy HH:mm:ss"), F.lit(":"))).otherwise("soon")
    return read(spark, sf_dir, "orders").select("o_orderkey", T.parse_timestamp(raw).alias("iso"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%b %d, %Y') AS day FROM orders")
def short_date(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", T.short_date(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")).alias("day"))


@query("SELECT p_partkey, p_size + CASE WHEN p_partkey % 3 = 0 THEN 2 ELSE 1 END AS value FROM part")
def mana_value(spark, sf_dir):
    cost = F.concat(F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 3 == 0, "UU").otherwise("XG"))
    return read(spark, sf_dir, "part").select("p_partkey", T.mana_value(cost).alias("value"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'UB' WHEN 1 THEN 'WG' ELSE 'R' END AS letters FROM part")
def mana_colors(spark, sf_dir):
    numbers = F.when(F.col("p_partkey") % 3 == 0, "3,2").when(F.col("p_partkey") % 3 == 1, "5, 1").otherwise("4")
    return read(spark, sf_dir, "part").select("p_partkey", T.color_letters(numbers).alias("letters"))


@query("SELECT p_partkey, lpad(p_partkey::VARCHAR, 4, '0') || '-run-' || regexp_replace(lower(p_name || ' / ' || p_type), '[^a-z0-9]+', '-', 'g') AS slug FROM part WHERE p_partkey < 10000")
def run_slug(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", T.run_slug(F.col("p_partkey"), F.lit("run"), F.concat_ws(" / ", "p_name", "p_type")).alias("slug"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'PLAY_LAND' WHEN p_partkey % 4 = 1 THEN 'CAST_SPELL' WHEN p_partkey % 4 = 2 THEN 'ACTIVATE' ELSE 'PASS_PRIORITY' END AS action FROM part")
def action_type_norm(spark, sf_dir):
    k = F.col("p_partkey") % 4
    raw = F.when(k == 0, "playLand").when(k == 1, " cast spell").when(k == 2, "Activate-Ability").otherwise("PASS")
    return read(spark, sf_dir, "part").select("p_partkey", T.action_type(raw, {"ACTIVATE_ABILITY": "ACTIVATE", "PASS": "PASS_PRIORITY"}).alias("action"))


@query("SELECT p_partkey, p_name AS title FROM part")
def clean_title(spark, sf_dir):
    raw = F.concat(F.lit(" .; "), F.col("p_name"), F.lit(" §§ "), F.col("p_size").cast("string"), F.lit("WU "))
    return read(spark, sf_dir, "part").select("p_partkey", T.clean_title(raw).alias("title"))


@query("SELECT p_partkey, 'Mrs. O''Neil - ' || p_name || ' // x' AS name FROM part")
def normalize_card_name(spark, sf_dir):
    raw = F.concat(F.lit(" Mrs. O’Neil  — "), F.col("p_name"), F.lit(" /// x "))
    return read(spark, sf_dir, "part").select("p_partkey", M.plain_name(raw).alias("name"))


@query(f"SELECT c_custkey, {alias_sql('c_name')} AS alias FROM customer")
def pseudonym(spark, sf_dir):
    return read(spark, sf_dir, "customer").select("c_custkey", T.pseudonym(F.col("c_name")).alias("alias"))


@query()
def hash_features(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", T.hash_features(F.col("p_name"), 16).alias("vector"))


@query(f"{WITH} SELECT decision, n + 1 AS legal, 32 AS slots FROM dec")
def action_mask(spark, sf_dir):
    rows = picks(spark, sf_dir).select("decision", T.action_mask(F.col("n"), F.lit(0), 32).alias("m"))
    return rows.select("decision", F.size(F.filter("m", lambda x: x)).cast("long").alias("legal"), F.size("m").cast("long").alias("slots"))


@query(f"{STATES} SELECT zone, round(avg(reading), 6) AS mean, min(reading) AS least, max(reading) AS most, count(object) AS identified, count(*) - count(object) AS unknown FROM st GROUP BY 1")
def quality_summary(spark, sf_dir):
    return states(spark, sf_dir).groupBy("zone").agg(F.round(F.avg("reading"), 6).alias("mean"), F.min("reading").alias("least"), F.max("reading").alias("most"), F.count("object").alias("identified"), (F.count("*") - F.count("object")).alias("unknown"))


@query(f"{WITH} SELECT decision, idx, rank FROM (SELECT decision, idx, row_number() OVER (PARTITION BY decision ORDER BY abs(score_a - score_b) DESC, idx) AS rank FROM opt) WHERE rank <= 2")
def sort_contributions(spark, sf_dir):
    w = Window.partitionBy("decision").orderBy(F.desc(F.abs(F.col("score_a") - F.col("score_b"))), "idx")
    return option_rows(spark, sf_dir).select("decision", "idx", F.row_number().over(w).cast("long").alias("rank")).where("rank <= 2")
