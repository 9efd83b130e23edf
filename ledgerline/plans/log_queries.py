"""Queries of sources, normalisation and streams: logs are written from the driver's tables and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.operators import normalize as N
from ledgerline.plans.registry import query
from ledgerline.plans.scratch import shared_folder
from ledgerline.plans.sequence_queries import picks
from ledgerline.plans.views import OPTIONS_SQL, decisions, read
from ledgerline.sources import files as S
from ledgerline.streaming import streams as X

WITH = f"WITH {OPTIONS_SQL}"


def raw_log(spark, sf_dir):
    """Decisions as JSON lines of three shapes by source, and a result line after each game's last; file is the game."""
    df = decisions(spark, sf_dir)
    select = F.struct(F.col("select.type").alias("type"), F.col("select.minCount").alias("minCount"), F.col("select.maxCount").alias("maxCount"), F.transform("select.option", lambda o: F.struct(o["index"].alias("index"), o["type"].alias("type"), o["label"].alias("label"))).alias("option"))
    seq, game = F.col("sequenceNumber"), F.col("gameId").cast("string")
    replay = F.to_json(F.struct(seq.alias("sequence"), F.col("playerIndex").alias("player"), F.struct(select.alias("select")).alias("observation"), F.col("selectedIndices").alias("selected")))
    mirror = F.to_json(F.struct(seq.alias("sequence"), game.alias("matchId"), F.col("playerIndex").alias("seat"), F.struct(select.alias("select")).alias("observation"), F.col("selectedIndices").alias("select")))
    canonical = F.to_json(F.struct(seq.alias("sequenceNumber"), game.alias("gameId"), F.col("playerIndex"), select.alias("select"), F.col("selectedIndices"), F.lit("search").alias("source")))
    line = F.when(F.col("source") == "F", replay).when(F.col("source") == "O", mirror).otherwise(canonical)
    rows = df.select(F.col("gameId").alias("file"), (seq * 2).alias("line"), line.alias("value"), "terminal")
    ends = rows.where("terminal").select("file", (F.col("line") + 1).alias("line"), F.to_json(F.struct(F.struct((F.col("file") % 3).alias("winner")).alias("result"))).alias("value"))
    return rows.drop("terminal").unionByName(ends)


def records(spark, sf_dir):
    return N.normalize(raw_log(spark, sf_dir).withColumn("record", S.parsed(F.col("value"))))


@query(f"{WITH} SELECT CASE source WHEN 'F' THEN 'self_play' WHEN 'O' THEN 'arena' ELSE 'canonical' END AS shape, count(*) AS n FROM dec GROUP BY 1 UNION ALL SELECT 'result', count(*) FILTER (terminal) FROM dec")
def detect_shape(spark, sf_dir):
    return records(spark, sf_dir).groupBy("shape").agg(F.count("*").alias("n"))


@query(f"{WITH} SELECT CASE source WHEN 'F' THEN 'engine_selfplay' WHEN 'O' THEN 'arena_human' ELSE 'search' END AS source, CASE source WHEN 'F' THEN 'exact' WHEN 'O' THEN 'mirror' ELSE 'partial' END AS confidence, count(*) AS n FROM dec GROUP BY 1, 2")
def resolve_source(spark, sf_dir):
    return records(spark, sf_dir).where("shape <> 'result'").groupBy("source", F.col("captureConfidence").alias("confidence")).agg(F.count("*").alias("n"))


@query(f"{WITH} SELECT game AS file, seq, decision % 2 AS player, prompt, n, pick FROM dec")
def normalize_record(spark, sf_dir):
    return records(spark, sf_dir).where("shape <> 'result'").select("file", F.col("sequenceNumber").alias("seq"), F.col("playerIndex").alias("player"), F.col("select.type").alias("prompt"), F.size("select.option").cast("long").alias("n"), F.col("selectedIndices")[0].alias("pick"))


@query(f"{WITH} SELECT game AS file, seq, terminal, CASE WHEN terminal THEN (CASE WHEN game % 3 = decision % 2 THEN 1.0 WHEN game % 3 IN (0, 1) THEN 0.0 END)::DOUBLE END AS reward FROM dec")
def fold_result_line(spark, sf_dir):
    rows = N.fold_result(records(spark, sf_dir))
    return rows.select("file", F.col("sequenceNumber").alias("seq"), F.coalesce("terminal", F.lit(False)).alias("terminal"), "reward")


@query("SELECT o_orderkey, o_custkey, o_orderpriority FROM orders")
def read_jsonl(spark, sf_dir):
    path = shared_folder(spark, "jsonl")
    S.write_jsonl(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority"), path)
    rows, _ = S.read_jsonl(spark, path)
    return rows.select(N.field("o_orderkey", "bigint").alias("o_orderkey"), N.field("o_custkey", "bigint").alias("o_custkey"), N.field("o_orderpriority").alias("o_orderpriority"))


@query("SELECT count(*) FILTER (o_orderkey % 5 <> 0) AS good, count(*) FILTER (o_orderkey % 5 = 0) AS bad FROM orders")
def quarantine_lines(spark, sf_dir):
    path = shared_folder(spark, "jsonl")
    k = F.col("o_orderkey")
    line = F.when(k % 10 == 0, "[1, 2]").when(k % 10 == 5, F.concat(F.lit('{"a": '), k, F.lit("} x"))).otherwise(F.to_json(F.struct("o_orderkey")))
    read(spark, sf_dir, "orders").select(line.alias("value")).write.text(path)
    good, bad = S.read_jsonl(spark, path, mode="quarantine")
    return good.agg(F.count("*").alias("good")).crossJoin(bad.agg(F.count("*").alias("bad")))  # one row each


@query("SELECT CASE WHEN p_partkey % 2 = 0 THEN p_size ELSE 1 END AS count, p_name AS name FROM part WHERE p_partkey % 7 <> 0")
def read_decklists(spark, sf_dir):
    path = shared_folder(spark, "decks")
    k = F.col("p_partkey")
    line = F.when(k % 7 == 0, "# comment").when(k % 2 == 0, F.concat_ws(" ", "p_size", "p_name", F.lit("# note"))).otherwise(F.col("p_name"))
    read(spark, sf_dir, "part").select(line.alias("value")).write.text(path)
    return S.read_decklists(S.read_lines(spark, path)).select("count", "name")


@query("SELECT count(DISTINCT p_brand) AS files, true AS hashed FROM part")
def file_inventory(spark, sf_dir):
    path = shared_folder(spark, "inventory")
    read(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"), F.col("p_name").alias("value")).repartition("brand").write.partitionBy("brand").text(path)
    files = S.inventory(spark, path)
    return files.agg(F.count("*").alias("files"), F.every(F.length("sha256") == 64).alias("hashed"))


@query("SELECT count(DISTINCT p_brand) AS files FROM part")
def discover_files(spark, sf_dir):
    path = shared_folder(spark, "discover")
    read(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"), F.col("p_name").alias("value")).repartition("brand").write.partitionBy("brand").text(path)
    return S.discover(spark, path, "*.txt").agg(F.count("*").alias("files"))


@query("SELECT o_orderkey FROM orders WHERE o_totalprice >= 200000")
def quarantine_split(spark, sf_dir):
    good, _ = S.quality_split(read(spark, sf_dir, "orders").withColumn("score", F.col("o_totalprice") / 400_000), "score", 0.5)
    return good.select("o_orderkey")


@query("SELECT min(o_orderkey) AS o_orderkey FROM orders WHERE o_orderstatus <> 'P' GROUP BY o_custkey, CASE WHEN o_orderstatus <> 'P' THEN 1 END UNION ALL SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P'")
def source_manifest_dedupe(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").withColumn("url", F.when(F.col("o_orderstatus") != "P", F.col("o_custkey")))
    return S.dedupe_sources(rows, ["url"], ["o_orderkey"]).select("o_orderkey")


@query("SELECT o_orderkey, CASE WHEN l IS NULL THEN 'run' WHEN l > 5 THEN 'retry' ELSE 'skip' END AS plan FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS l FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def resumable_plan(spark, sf_dir):
    done = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.when(F.count("*") > 5, "failed").otherwise("ok").alias("status"))
    return S.plan_run(read(spark, sf_dir, "orders"), done, "o_orderkey").select("o_orderkey", "plan")


@query("SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_windows(spark, sf_dir):
    events = X.stream_table(spark, f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    rows = X.run_to_table(X.windowed_counts(events, "ts", ["event_type"], "1 hour"), shared_folder(spark, "stream"), "complete")
    return rows.select(F.unix_micros("start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM s) SELECT epoch_us(min(ts)) AS start, user_id, count(*) AS n FROM g GROUP BY user_id, k")
def stream_sessions(spark, sf_dir):
    events = X.stream_table(spark, f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    rows = X.run_to_table(X.session_counts(events, "ts", "user_id", "2 hours"), shared_folder(spark, "stream"), "complete")
    return rows.select(F.unix_micros("start").alias("start"), "user_id", "n")


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedupe(spark, sf_dir):
    events = X.stream_table(spark, f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).select("user_id", "event_type", "ts")
    return X.run_to_table(X.dedupe(events, ["user_id", "event_type"], "ts"), shared_folder(spark, "stream")).select("user_id", "event_type")


@query(f"{WITH} SELECT source, count(*) AS n FROM dec GROUP BY 1")
def stream_sinks(spark, sf_dir):
    """Decisions are written as a table, streamed by source to sinks, and counted there."""
    path, out = shared_folder(spark, "decisions"), shared_folder(spark, "sinks")
    picks(spark, sf_dir).select("source", "decision").write.parquet(path)

    def fan_out(df, batch):  # a batch that is run again overwrites itself
        df.write.mode("overwrite").partitionBy("source").parquet(f"{out}/rows/batch={batch}")

    X.stream_table(spark, path).writeStream.option("checkpointLocation", f"{out}/state").trigger(availableNow=True).foreachBatch(fan_out).start().awaitTermination()
    return spark.read.parquet(f"{out}/rows").groupBy("source").agg(F.count("*").alias("n"))
