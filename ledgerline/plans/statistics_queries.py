"""Queries of ranks and statistics, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.operators import ranking as R
from ledgerline.operators import statistics as S
from ledgerline.plans.registry import query
from ledgerline.plans.views import OPTIONS_SQL, decisions, option_rows, read

WITH = f"WITH {OPTIONS_SQL}"
RANKED = f"""{WITH}, rk AS (SELECT *, row_number() OVER (PARTITION BY decision ORDER BY score_a DESC, idx) AS rank, count(*) OVER (PARTITION BY decision) AS n,
  exp(score_a - max(score_a) OVER (PARTITION BY decision)) AS weight FROM opt),
ra AS (SELECT *, weight / sum(weight) OVER (PARTITION BY decision) AS probability FROM rk)"""
KEY = ["decision"]


def chosen_ranks(spark, sf_dir):
    rows = R.ranked(option_rows(spark, sf_dir), KEY, "score_a")
    counts = rows.groupBy("decision", "prompt", "source").agg(F.count("*").alias("n"), F.min(F.when(F.col("chosen"), F.col("rank"))).alias("chosen_rank"))
    return counts


@query(f"{RANKED} SELECT decision, string_agg(CASE WHEN rank <= 5 THEN idx END::VARCHAR, ',' ORDER BY rank) AS top, min(CASE WHEN chosen THEN rank END) AS chosen_rank, max(CASE WHEN chosen THEN score_a END) AS chosen_score, round(max(probability), 6) AS best FROM ra GROUP BY decision")
def rank_scores(spark, sf_dir):
    rows = R.score_analysis(option_rows(spark, sf_dir), KEY, "score_a")
    return rows.select("decision", F.array_join(F.col("top").cast("array<string>"), ",").alias("top"), "chosen_rank", "chosen_score", F.round("best", 6).alias("best"))


@query(f"{RANKED} SELECT decision, idx, rank FROM ra WHERE rank <= 3")
def topk_options(spark, sf_dir):
    return R.top_k(option_rows(spark, sf_dir), KEY, "score_a", 3).select("decision", "idx", "rank")


@query(f"{RANKED} SELECT decision, idx, round(probability, 6) AS probability FROM ra")
def softmax(spark, sf_dir):
    return option_rows(spark, sf_dir).select("decision", "idx", F.round(R.softmax(F.col("score_a"), KEY), 6).alias("probability"))


METRICS = "count(*) AS decisions, round(avg((rank = 1)::INT), 6) AS top1, round(avg(CASE WHEN n >= 3 THEN (rank <= 3)::INT END), 6) AS top3, round(avg(1.0 / rank), 6) AS mrr, round(avg(n), 6) AS mean_options"


@query(f"{RANKED} SELECT prompt, {METRICS} FROM ra WHERE chosen GROUP BY prompt")
def rank_metrics(spark, sf_dir):
    return R.rank_metrics(chosen_ranks(spark, sf_dir), ["prompt"])


@query(
    f"""{RANKED}, k AS (SELECT *, CASE WHEN n <= 1 THEN '0-1' WHEN n <= 4 THEN '2-4' WHEN n <= 8 THEN '5-8' WHEN n <= 16 THEN '9-16' ELSE '17+' END AS options FROM ra WHERE chosen)
SELECT prompt, options, source, {METRICS} FROM k GROUP BY GROUPING SETS ((), (prompt), (options), (source))"""
)
def benchmark_analyses(spark, sf_dir):
    from ledgerline.operators.records import option_bucket

    rows = chosen_ranks(spark, sf_dir).withColumn("options", option_bucket(F.col("n")))
    r = F.col("chosen_rank")
    cols = [F.col(c) for c in ("prompt", "options", "source")]
    return rows.groupingSets([[], [cols[0]], [cols[1]], [cols[2]]], *cols).agg(
        F.count("*").alias("decisions"), F.round(F.avg((r == 1).cast("double")), 6).alias("top1"), F.round(F.avg(F.when(F.col("n") >= 3, (r <= 3).cast("double"))), 6).alias("top3"), F.round(F.avg(1 / r), 6).alias("mrr"), F.round(F.avg("n"), 6).alias("mean_options")
    )


GROUPED = f"{RANKED}, gr AS (SELECT *, CASE WHEN akey IS NULL THEN 'index:' || idx ELSE kind || '|' || akey END AS grp FROM ra)"


def grouped(spark, sf_dir):
    return option_rows(spark, sf_dir).withColumn("grp", F.when(F.col("akey").isNull(), F.concat(F.lit("index:"), F.col("idx"))).otherwise(F.concat_ws("|", "kind", F.col("akey").cast("string"))))


@query(f"{GROUPED}, b AS (SELECT decision, grp, min(rank) AS best, bool_or(chosen) AS chosen FROM gr GROUP BY 1, 2), c AS (SELECT *, row_number() OVER (PARTITION BY decision ORDER BY best) AS canonical_rank FROM b) SELECT decision, canonical_rank FROM c WHERE chosen")
def canonical_rank(spark, sf_dir):
    return R.canonical_rank(grouped(spark, sf_dir), KEY, "score_a", "grp")


MASS = f"{GROUPED}, m AS (SELECT decision, grp, sum(probability) AS mass, bool_or(chosen) AS chosen, min(idx) AS idx FROM gr GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY decision ORDER BY round(mass, 9) DESC, idx) AS group_rank FROM m)"


@query(f"{MASS} SELECT count(*) AS decisions, round(avg((group_rank = 1)::INT), 6) AS top1, round(avg((group_rank <= 3)::INT), 6) AS top3, round(avg(1.0 / group_rank), 6) AS mrr FROM r WHERE chosen")
def group_rank_metrics(spark, sf_dir):
    r = F.col("group_rank")
    rows = R.group_rank(grouped(spark, sf_dir), KEY, "score_a", "grp")
    return rows.agg(F.count("*").alias("decisions"), F.round(F.avg((r == 1).cast("double")), 6).alias("top1"), F.round(F.avg((r <= 3).cast("double")), 6).alias("top3"), F.round(F.avg(1 / r), 6).alias("mrr"))


@query(f"{MASS} SELECT decision, round(-ln(mass), 6) AS nll FROM r WHERE chosen")
def group_nll(spark, sf_dir):
    return R.group_rank(grouped(spark, sf_dir), KEY, "score_a", "grp").select("decision", F.round("nll", 6).alias("nll"))


@query(
    f"""{WITH}, t AS (SELECT decision, 'a' AS model, first(idx ORDER BY score_a DESC, idx) AS top FROM opt GROUP BY 1 UNION ALL SELECT decision, 'b', first(idx ORDER BY score_b DESC, idx) FROM opt GROUP BY 1 UNION ALL SELECT decision, 'c', max(CASE WHEN chosen THEN idx END) FROM opt GROUP BY 1),
v AS (SELECT decision, top, count(*) AS n FROM t GROUP BY 1, 2), g AS (SELECT decision, max(n) AS most FROM v GROUP BY 1)
SELECT CASE WHEN most = 3 THEN 'all_agree' WHEN most > 1 THEN 'partial' ELSE 'disagree' END AS agreement, count(*) AS n FROM g GROUP BY 1"""
)
def agreement(spark, sf_dir):
    rows = option_rows(spark, sf_dir)
    best = lambda s: F.min_by("idx", F.struct(-F.col(s), "idx"))
    tops = rows.groupBy("decision").agg(F.array(best("score_a"), best("score_b"), F.max(F.when(F.col("chosen"), F.col("idx")))).alias("t")).select("decision", F.posexplode("t").alias("model", "top"))
    return R.agreement(tops, KEY, "model", "top", 3).groupBy("agreement").agg(F.count("*").alias("n"))


TOKENS = f"{WITH}, tk AS (SELECT decision, idx, chosen, unnest(list_distinct(regexp_extract_all(lower(label), '[a-z0-9]+'))) AS token FROM opt), bc AS (SELECT token, sum(chosen::INT)::BIGINT AS chosen, count(*) AS every FROM tk GROUP BY 1)"
FIT = f"{TOKENS}, bt AS (SELECT sum(chosen) AS ca, sum(every) AS ea, count(*) AS n FROM bc), bw AS (SELECT token, round(ln((chosen + 1) / (ca + n)::DOUBLE) - ln((every + 1) / (ea + n)::DOUBLE), 6) AS weight FROM bc, bt)"


@query(f"{TOKENS} SELECT * FROM bc")
def bow_counts(spark, sf_dir):
    return R.bow_counts(option_rows(spark, sf_dir), "label")


KINDS = f"""{TOKENS}, cn AS (SELECT 'token' AS kind, token AS key, chosen, every FROM bc UNION ALL SELECT 'option_type', kind, sum(chosen::INT), count(*) FROM opt GROUP BY 2
  UNION ALL SELECT 'prompt_option_type', prompt || '/' || kind, sum(chosen::INT), count(*) FROM opt GROUP BY 2),
tt AS (SELECT *, sum(chosen) OVER w AS ca, sum(every) OVER w AS ea, count(*) OVER w AS n FROM cn WINDOW w AS (PARTITION BY kind))"""


@query(f"{KINDS} SELECT kind, key, round(ln((chosen + 1) / (ca + n)::DOUBLE) - ln((every + 1) / (ea + n)::DOUBLE), 6) AS weight FROM tt WHERE kind <> 'token' OR every >= 3")
def bow_fit(spark, sf_dir):
    return R.bow_weights(option_rows(spark, sf_dir), "label", "kind", "prompt", 3).select("kind", "key", F.round("weight", 6).alias("weight"))


@query(f"{FIT} SELECT decision, idx, round(coalesce(sum(weight), 0) + 1e-9, 4) AS bow_score FROM tk JOIN bw USING (token) GROUP BY 1, 2")
def bow_score(spark, sf_dir):
    rows = option_rows(spark, sf_dir)
    weights = R.bow_fit(R.bow_counts(rows, "label"))
    return R.bow_score(rows, weights, ["decision", "idx"], "label").withColumn("bow_score", F.round(F.col("bow_score") + 1e-9, 4))


MATCHES = "WITH m AS (SELECT l_returnflag AS agent, l_partkey AS pair, p_brand AS cluster, p_type AS suite, l_discount * 10 AS score FROM lineitem JOIN part ON p_partkey = l_partkey)"


def matches(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey"))
    return rows.select(F.col("l_returnflag").alias("agent"), F.col("l_partkey").alias("pair"), F.col("p_brand").alias("cluster"), F.col("p_type").alias("suite"), (F.col("l_discount") * 10).alias("score"))


@query(f"{MATCHES} SELECT agent, suite, pair, round(avg(score), 6) AS score, count(*) AS games, min(cluster) AS cluster, count(DISTINCT cluster) AS clusters FROM m GROUP BY 1, 2, 3")
def match_scores(spark, sf_dir):
    return S.match_scores(matches(spark, sf_dir), ["agent", "suite", "pair"], "score", "cluster").withColumn("score", F.round("score", 6))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_returnflag = 'A' THEN 1.0 WHEN l_returnflag = 'R' THEN 0.5 ELSE l_quantity END AS score FROM lineitem")
def score_value(spark, sf_dir):
    raw = F.when(F.col("l_returnflag") == "A", " Win").when(F.col("l_returnflag") == "R", "draw").otherwise(F.col("l_quantity").cast("string"))
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", S.score_value(raw).alias("score"))


def draw_sql(*parts: str) -> str:
    return f"('0x' || substr(sha256({' || chr(124) || '.join(parts)}), 1, 8))::BIGINT"


@query(
    f"""{MATCHES}, s AS (SELECT agent, cluster, sum(score) AS sum, count(*) AS n, row_number() OVER (PARTITION BY agent ORDER BY cluster) - 1 AS place, count(*) OVER (PARTITION BY agent) AS clusters FROM m GROUP BY 1, 2),
d AS (SELECT agent, r AS replicate, {draw_sql("'0'", "r::VARCHAR", "place::VARCHAR")} % clusters AS pick FROM s, range(1, 101) t(r)),
b AS (SELECT d.agent, replicate, sum(sum) / sum(n) AS mean FROM d JOIN s ON s.agent = d.agent AND s.place = d.pick GROUP BY 1, 2),
i AS (SELECT agent, round(quantile_cont(mean, 0.025), 6) AS low, round(quantile_cont(mean, 0.975), 6) AS high FROM b GROUP BY 1)
SELECT agent, round(sum(sum) / sum(n), 6) AS mean, count(*) AS clusters, any_value(low) AS low, any_value(high) AS high FROM s JOIN i USING (agent) GROUP BY agent"""
)
def cluster_bootstrap(spark, sf_dir):
    return S.cluster_bootstrap(matches(spark, sf_dir), ["agent"], "cluster", "score", samples=100)


DELTAS = f"{MATCHES}, a AS (SELECT agent, pair, min(cluster) AS cluster, avg(score) AS score FROM m GROUP BY 1, 2), dl AS (SELECT x.agent || '-' || y.agent AS versus, x.cluster, x.score - y.score AS delta FROM a x JOIN a y USING (pair) WHERE x.agent < y.agent)"
FLIPS = f"""{DELTAS}, cm AS (SELECT versus, cluster, avg(delta) AS m FROM dl GROUP BY 1, 2), ob AS (SELECT versus, abs(avg(m)) AS observed FROM cm GROUP BY 1),
fl AS (SELECT versus, r, abs(avg(m * CASE WHEN {draw_sql("'0'", "r::VARCHAR", "cluster")} % 2 = 0 THEN 1 ELSE -1 END)) AS value FROM cm, range(1, 201) t(r) GROUP BY 1, 2),
pv AS (SELECT versus, round((count(*) FILTER (value >= observed - 1e-12) + 1) / 201.0, 6) AS p_value FROM fl JOIN ob USING (versus) GROUP BY versus)"""


def flips(spark, sf_dir):
    from ledgerline.operators.matching import paired

    scores = S.match_scores(matches(spark, sf_dir), ["agent", "pair"], "score", "cluster")
    deltas = paired(scores, "agent", "pair", "score").join(scores.select("pair", "cluster").distinct(), "pair").withColumn("versus", F.concat_ws("-", "left", "right"))
    return S.sign_flip(deltas, ["versus"], "cluster", "delta")


@query(f"{FLIPS} SELECT * FROM pv")
def sign_flip_test(spark, sf_dir):
    return flips(spark, sf_dir)


@query(f"{FLIPS}, sc AS (SELECT *, least(1.0, (count(*) OVER () - row_number() OVER (ORDER BY p_value, versus) + 1) * p_value) AS scaled FROM pv) SELECT versus, p_value, round(max(scaled) OVER (ORDER BY p_value, versus), 6) AS adjusted FROM sc")
def holm_adjust(spark, sf_dir):
    return S.holm(flips(spark, sf_dir), "p_value", ["versus"]).withColumn("adjusted", F.round("adjusted", 6))


CALIBRATION = "WITH c AS (SELECT 0.5 + 0.49 * sin(n_chars) AS p, quality, toxic FROM documents JOIN labels USING (doc_id)), l AS (SELECT 'quality' AS label, p, quality AS t FROM c UNION ALL SELECT 'toxic', p, toxic FROM c)"


def calibrated(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id").withColumn("p", 0.5 + 0.49 * F.sin("n_chars"))
    return rows.select("p", F.explode(F.create_map(F.lit("quality"), "quality", F.lit("toxic"), "toxic")).alias("label", "t"))


@query(f"{CALIBRATION}, b AS (SELECT label, least(floor(p * 10), 9) AS bin, count(*) AS n, sum(p) AS p, sum(t) AS t, sum((p - t) ** 2) AS b, sum(-(t * ln(p) + (1 - t) * ln(1 - p))) AS l FROM l GROUP BY 1, 2) SELECT label, sum(n)::BIGINT AS rows, round(sum(b) / sum(n), 6) AS brier, round(sum(l) / sum(n), 6) AS log_loss, round(sum(abs(p - t)) / sum(n), 6) AS ece FROM b GROUP BY label")
def calibration(spark, sf_dir):
    return S.calibration(calibrated(spark, sf_dir), ["label"], "p", "t")


@query(f"{CALIBRATION} SELECT least(floor(p * 10), 9)::BIGINT AS bin, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(t), 6) AS rate FROM l GROUP BY 1")
def calibration_bins(spark, sf_dir):
    return S.reliability(calibrated(spark, sf_dir), "p", "t")


PREFERENCES = """WITH ln AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS k FROM lineitem),
pr AS (SELECT a.l_orderkey AS context, a.l_suppkey AS expert, ln(1 + a.l_quantity) - ln(1 + b.l_quantity) AS d_quantity, (-a.l_discount / 0.1) - (-b.l_discount / 0.1) AS d_discount, a.l_extendedprice > b.l_extendedprice AS left_preferred, 1 + a.l_tax AS weight FROM ln a JOIN ln b ON b.l_orderkey = a.l_orderkey AND b.k = a.k + 1)"""


def preferences(spark, sf_dir):
    from pyspark.sql import Window

    from ledgerline.plans.views import LINE_ORDER

    w = Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER)
    lines = read(spark, sf_dir, "lineitem").withColumn("b", F.lead(F.struct("l_quantity", "l_discount", "l_extendedprice")).over(w)).where("b is not null")
    quantity = lambda c: S.oriented(F.col(c), "log1p")
    discount = lambda c: S.oriented(F.col(c), direction="lower_better", scale=0.1)
    return lines.select(F.col("l_orderkey").alias("context"), F.col("l_suppkey").alias("expert"), (quantity("l_quantity") - quantity("b.l_quantity")).alias("d_quantity"), (discount("l_discount") - discount("b.l_discount")).alias("d_discount"), (F.col("l_extendedprice") > F.col("b.l_extendedprice")).alias("left_preferred"), (1 + F.col("l_tax")).alias("weight"))


SIGMOID = "1 / (1 + exp(-mg))"


@query(
    f"""{PREFERENCES}, mm AS (SELECT *, round(0.8 * d_quantity + 0.1 * d_discount, 9) AS mg FROM pr), oo AS (SELECT *, CASE WHEN left_preferred THEN {SIGMOID} ELSE 1 - {SIGMOID} END AS r, CASE WHEN left_preferred THEN mg ELSE -mg END AS own FROM mm)
SELECT expert, round(sum(CASE WHEN mg <> 0 THEN weight * (own > 0)::INT END) / sum(CASE WHEN mg <> 0 THEN weight END) + 1e-9, 4) AS accuracy, round(sum(weight * -ln(greatest(r, 1e-12))) / sum(weight) + 1e-9, 4) AS log_loss, round(sum(weight * (1 - r) ** 2) / sum(weight) + 1e-9, 4) AS brier, round(sum(weight * own) / sum(weight) + 1e-9, 4) AS mean_margin FROM oo GROUP BY expert"""
)
def preference_metrics(spark, sf_dir):
    rows = preferences(spark, sf_dir).withColumn("margin", F.round(0.8 * F.col("d_quantity") + 0.1 * F.col("d_discount"), 9))
    out = S.preference_metrics(rows, ["expert"], "margin", "left_preferred", "weight")
    return out.select("expert", *(F.round(F.col(c) + 1e-9, 4).alias(c) for c in ("accuracy", "log_loss", "brier", "mean_margin")))


@query("WITH v AS (SELECT l_partkey % 100 AS context, l_suppkey AS expert, l_returnflag AS vote, 1 + l_discount AS w FROM lineitem), s AS (SELECT context, vote, sum(w) AS w FROM v GROUP BY 1, 2), r AS (SELECT context, count(DISTINCT expert) AS raters FROM v GROUP BY 1 HAVING count(DISTINCT expert) >= 2) SELECT context, any_value(raters) AS raters, round(max(w) / sum(w), 6) AS majority FROM s JOIN r USING (context) GROUP BY context")
def expert_agreement(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 100).alias("context"), F.col("l_suppkey").alias("expert"), F.col("l_returnflag").alias("vote"), (1 + F.col("l_discount")).alias("w"))
    return S.expert_agreement(rows, "context", "expert", "vote", "w")


@query()
def fit_preferences(spark, sf_dir):
    rows = preferences(spark, sf_dir)
    sign = F.when(F.col("left_preferred"), 1.0).otherwise(-1.0)
    factors = ["d_quantity", "d_discount"]
    turned = rows.select(*(F.round(F.col(f) * sign, 3).alias(f) for f in factors), "weight")
    weights = S.fit_preferences(turned, factors, "weight", rounds=10)
    return spark.createDataFrame(list(zip(factors, weights, strict=True)), "factor string, weight double")


@query(f"{WITH} SELECT decision FROM dec ORDER BY sha256('7|' || decision), decision LIMIT 500")
def reservoir_sample(spark, sf_dir):
    return S.sample_n(decisions(spark, sf_dir), 500, "decision", 7).select("decision")


@query(f"{WITH}, g AS (SELECT DISTINCT game FROM dec), h AS (SELECT game, row_number() OVER (ORDER BY sha256('3|' || game), game) <= round_even(count(*) OVER () * 0.2, 0) AS held_out FROM g) SELECT decision, held_out FROM dec JOIN h USING (game)")
def split_by_hash(spark, sf_dir):
    return S.split_groups(decisions(spark, sf_dir).select("gameId", "decision"), "gameId", 0.2, 3).select("decision", "held_out")


@query(f"{WITH} SELECT game, decision, count(*) OVER (PARTITION BY game) > 6 AS truncated FROM dec QUALIFY seq < 6")
def bounded_take(spark, sf_dir):
    df = decisions(spark, sf_dir).select(F.col("gameId").alias("game"), "decision", "sequenceNumber")
    return S.take_per_group(df, "game", ["sequenceNumber"], 6).select("game", "decision", "truncated")


@query("WITH e AS (SELECT unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS dimension FROM embeddings) SELECT dimension, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std FROM e GROUP BY 1")
def collapse_diagnostics(spark, sf_dir):
    return S.vector_spread(read(spark, sf_dir, "embeddings"), "embedding")


@query()
def effective_rank(spark, sf_dir):
    return spark.createDataFrame([(round(S.effective_rank(read(spark, sf_dir, "embeddings"), "embedding"), 6),)], "effective_rank double")


@query("SELECT 'quantity' AS factor, count(l_quantity) AS observed, min(l_quantity) AS least, max(l_quantity) AS most FROM lineitem UNION ALL SELECT 'discount', count(l_discount), min(l_discount), max(l_discount) FROM lineitem UNION ALL SELECT 'tax', count(l_tax), min(l_tax), max(l_tax) FROM lineitem")
def aggregate_factor_ranges(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").select(F.explode(F.create_map(F.lit("quantity"), "l_quantity", F.lit("discount"), "l_discount", F.lit("tax"), "l_tax")).alias("factor", "x"))
    return lines.groupBy("factor").agg(F.count("x").alias("observed"), F.min("x").alias("least"), F.max("x").alias("most"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(ln(1 + l_quantity) / 2, 6) AS a, round(-tanh(least(l_tax, 0.05)) / 0.1, 6) AS b, round(sqrt(l_discount), 6) AS c FROM lineitem")
def factor_orient(spark, sf_dir):
    a, b, c = S.oriented(F.col("l_quantity"), "log1p", scale=2.0), S.oriented(F.col("l_tax"), "tanh", "lower_better", 0.1, most=0.05), S.oriented(F.col("l_discount"), "sqrt")
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(a, 6).alias("a"), F.round(b, 6).alias("b"), F.round(c, 6).alias("c"))
