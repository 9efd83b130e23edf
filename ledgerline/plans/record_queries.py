"""Queries of decision records, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.operators import records as R
from ledgerline.plans.registry import query
from ledgerline.plans.views import OPTIONS_SQL, decisions

WITH = f"WITH {OPTIONS_SQL}"


def as_actions(option_type, prompt):
    """The small profile over the derived option types: returned, accepted and open lines stand for actions."""
    named = F.when(option_type == "NO", "PASS").when(option_type == "AF", "CAST_SPELL").when(option_type == "RF", "PROMPT_MANA_SOURCE").otherwise(F.concat(F.lit("PROMPT_"), option_type))
    return R.small_bucket(named, F.when(prompt == "1-URGENT", "MULLIGAN").otherwise(prompt))


BUCKET = "CASE WHEN {k} = 'NO' THEN 'PASS' WHEN {k} = 'AF' THEN 'CAST_SPELL' WHEN {k} = 'RF' THEN 'MANA_PAYMENT' WHEN prompt = '1-URGENT' THEN 'MULLIGAN' ELSE 'TARGET_OR_CHOICE' END"
CHOSEN = BUCKET.format(k="kind")


@query(f"{WITH} SELECT decision, idx, kind, label, chosen AS is_selected FROM opt")
def explode_options(spark, sf_dir):
    rows = R.explode_options(decisions(spark, sf_dir))
    return rows.select("decision", F.col("option.index").alias("idx"), F.col("option.type").alias("kind"), F.col("option.label").alias("label"), "is_selected")


@query(f"{WITH} SELECT decision, 1 AS n_selected, kind, label FROM opt WHERE chosen")
def selected_options(spark, sf_dir):
    df = decisions(spark, sf_dir)
    return df.select("decision", R.selected_options(df).alias("s")).select("decision", F.size("s").cast("long").alias("n_selected"), F.col("s")[0]["type"].alias("kind"), F.col("s")[0]["label"].alias("label"))


@query(f"{WITH} SELECT d.decision, 'decision #' || seq || ' ' || d.prompt || ' -> ' || label AS line FROM dec d JOIN opt o ON o.decision = d.decision AND chosen")
def chosen_labels(spark, sf_dir):
    df = decisions(spark, sf_dir)
    return df.select("decision", R.describe(df).alias("line"))


@query(f"{WITH} SELECT decision, pick_kind = 'NO' AS passes FROM dec")
def is_pass(spark, sf_dir):
    df = decisions(spark, sf_dir)
    return df.select("decision", R.is_pass(df, ("NO",)).alias("passes"))


@query(f"{WITH} SELECT decision, list_aggregate(list_filter([CASE WHEN source NOT IN ('F', 'O') THEN 'source' END, CASE WHEN n > 6 THEN 'out of range' END], lambda x: x IS NOT NULL), 'string_agg', ';') AS messages FROM dec WHERE source NOT IN ('F', 'O') OR n > 6")
def validate_record(spark, sf_dir):
    df = decisions(spark, sf_dir).withColumn("source", F.when(F.col("source").isin("F", "O"), "search").otherwise(F.col("source")))
    df = df.withColumn("selectedIndices", F.when(R.option_count() > 6, F.array(R.option_count() + 1)).otherwise(F.col("selectedIndices")))
    found = df.select("decision", R.validate(df).alias("m")).where(F.size("m") > 0)
    short = F.transform("m", lambda m: F.when(m.contains("source"), "source").when(m.contains("range"), "out of range").otherwise(m))
    return found.select("decision", F.array_join(short, ";").alias("messages"))


@query(f"{WITH} SELECT decision, n >= 3 AS legal FROM dec")
def is_legal_selection(spark, sf_dir):
    df = decisions(spark, sf_dir)
    return df.select("decision", R.is_legal(F.array(F.lit(0).cast("long"), F.lit(2).cast("long")), R.option_count(), F.lit(2), F.lit(0)).alias("legal"))


@query(
    f"{WITH} SELECT decision, CASE WHEN n = 1 THEN '0' WHEN pick = 0 THEN '0,1' ELSE pick || ',0' END AS repaired FROM dec"
)
def clamp_selection(spark, sf_dir):
    df = decisions(spark, sf_dir)
    wild = F.concat(F.array(F.lit(-3).cast("long")), F.col("selectedIndices"), F.col("selectedIndices"), F.array(F.lit(999).cast("long")))
    return df.select("decision", F.array_join(R.clamp(wild, R.option_count(), F.lit(2).cast("long"), F.lit(2).cast("long")).cast("array<string>"), ",").alias("repaired"))


@query(f"{WITH} SELECT decision, pick % 2 = 0 AS single FROM dec")
def is_single_choice(spark, sf_dir):
    df = decisions(spark, sf_dir)
    df = df.withColumn("selectedIndices", F.when(F.col("selectedIndices")[0] % 2 == 0, F.col("selectedIndices")).otherwise(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))))
    return df.select("decision", R.single_choice(df).alias("single"))


@query(f"{WITH} SELECT prompt AS label, count(*) AS n FROM dec GROUP BY 1")
def histogram(spark, sf_dir):
    return R.histogram(decisions(spark, sf_dir), F.col("select.type"))


@query(f"{WITH} SELECT count(*) AS records, count(DISTINCT game) AS games, count(*) AS with_options, min(n) AS min_options, max(n) AS max_options, sum(n)::BIGINT AS options, round(avg(n), 6) AS mean_options, count(*) FILTER (terminal) AS terminal, 0 AS multi_select FROM dec")
def build_manifest(spark, sf_dir):
    return R.manifest(decisions(spark, sf_dir))


@query(f"{WITH} SELECT decision, 'index out of range' AS messages FROM dec WHERE n > 6 ORDER BY decision LIMIT 5")
def first_n_errors(spark, sf_dir):
    df = decisions(spark, sf_dir)
    errors = R.selection_errors(F.when(R.option_count() > 6, F.array(F.lit(77).cast("long"))).otherwise(F.col("selectedIndices")), R.option_count(), F.col("select.minCount"), F.col("select.maxCount"))
    return R.first_errors(df, errors, ["decision"]).select("decision", F.array_join("messages", ";").alias("messages"))


@query(f"{WITH} SELECT CASE WHEN n > 6 THEN 'not_single_choice' ELSE 'kept' END AS reason, count(*) AS n FROM dec GROUP BY 1")
def compile_stats(spark, sf_dir):
    df = decisions(spark, sf_dir)
    two = F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))
    return R.compile_stats(df.withColumn("selectedIndices", F.when(R.option_count() > 6, two).otherwise(F.col("selectedIndices"))))


@query(f"{WITH} SELECT {CHOSEN} AS bucket, count(*) AS n FROM opt WHERE chosen GROUP BY 1")
def action_distribution(spark, sf_dir):
    return R.action_distribution(decisions(spark, sf_dir), as_actions)


@query(
    f"""{WITH}, c AS (SELECT prompt, {CHOSEN} AS bucket, count(*) AS n FROM opt WHERE chosen GROUP BY 1, 2),
u AS (SELECT * FROM c UNION ALL SELECT '*', bucket, sum(n) FROM c GROUP BY bucket),
p AS (SELECT *, n / sum(n) OVER (PARTITION BY prompt) AS p FROM u)
SELECT prompt, sum(n)::BIGINT AS decisions, round(sum(-p * log2(p)), 6) AS bits, first(bucket ORDER BY n DESC, bucket) AS modal, round(max(p), 6) AS modal_rate FROM p GROUP BY prompt"""
)
def action_entropy_report(spark, sf_dir):
    return R.action_entropy(decisions(spark, sf_dir), as_actions)


@query(f"{WITH}, c AS (SELECT source, prompt, count(*) AS n FROM dec GROUP BY 1, 2), p AS (SELECT source, n / sum(n) OVER (PARTITION BY source) AS p FROM c) SELECT source, round(sum(-p * log2(p)), 6) AS bits FROM p GROUP BY source")
def entropy(spark, sf_dir):
    counts = decisions(spark, sf_dir).groupBy("source", F.col("select.type").alias("prompt")).agg(F.count("*").alias("n"))
    return R.entropy(counts, ["source"])


@query(f"{WITH} SELECT decision, string_agg({CHOSEN}, ',' ORDER BY idx) AS buckets, max(CASE WHEN chosen THEN {CHOSEN} END) AS chosen_bucket FROM opt GROUP BY decision")
def abstract_record(spark, sf_dir):
    return R.abstracted(decisions(spark, sf_dir), as_actions).select("decision", F.array_join("option_buckets", ",").alias("buckets"), "chosen_bucket")


@query(f"{WITH} SELECT CASE WHEN n <= 1 THEN '0-1' WHEN n <= 4 THEN '2-4' WHEN n <= 8 THEN '5-8' WHEN n <= 16 THEN '9-16' ELSE '17+' END AS bucket, count(*) AS n FROM dec GROUP BY 1")
def option_bucket(spark, sf_dir):
    return decisions(spark, sf_dir).groupBy(R.option_bucket(R.option_count()).alias("bucket")).agg(F.count("*").alias("n"))


@query(f"{WITH} SELECT decision, CASE WHEN akey IS NULL THEN 'index:' || idx ELSE kind || '|' || akey END AS group_key, min(idx) AS \"group\", count(*) AS size FROM opt GROUP BY 1, 2")
def canonical_groups(spark, sf_dir):
    return R.canonical_groups(decisions(spark, sf_dir))


@query(f"{WITH} SELECT n % 2 = 0 AS legal, count(*) AS n FROM dec GROUP BY 1")
def is_legal_ranking(spark, sf_dir):
    n = R.option_count()
    ranking = F.when(n % 2 == 0, F.array(n - 1, F.lit(0).cast("long"))).otherwise(F.array(n))
    return decisions(spark, sf_dir).groupBy(R.is_legal_ranking(ranking, n).alias("legal")).agg(F.count("*").alias("n"))


@query(f"{WITH} SELECT count(*) AS total, count(*) FILTER (n <= 6) AS valid, count(*) FILTER (n > 6) AS invalid FROM dec")
def validation_summary(spark, sf_dir):
    df = decisions(spark, sf_dir)
    errors = R.selection_errors(F.col("selectedIndices"), F.least(R.option_count(), F.when(R.option_count() > 6, 0).otherwise(R.option_count())), F.col("select.minCount"), F.col("select.maxCount"))
    bad = F.size(errors) > 0
    return df.agg(F.count("*").alias("total"), F.count(F.when(~bad, 1)).alias("valid"), F.count(F.when(bad, 1)).alias("invalid"))
