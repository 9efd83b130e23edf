"""Ranking of options by model scores, and metrics of ranks.

Option frames have one row an option: the decision's key columns, idx, a score and chosen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def softmax(score: Column, group: list[str]) -> Column:
    """Stable softmax within groups."""
    w = Window.partitionBy(*group)
    e = F.exp(score - F.max(score).over(w))
    return e / F.sum(e).over(w)


def ranked(options: DataFrame, keys: list[str], score: str, idx: str = "idx") -> DataFrame:
    """rank (score falling, index rising) and probability of every option."""
    order = Window.partitionBy(*keys).orderBy(F.desc(score), idx)
    weight = F.exp(F.col(score) - F.max(score).over(Window.partitionBy(*keys)))
    rows = options.withColumns({"rank": F.row_number().over(order).cast("long"), "weight_": weight})
    return rows.withColumn("probability", F.col("weight_") / F.sum("weight_").over(Window.partitionBy(*keys))).drop("weight_")


def top_k(options: DataFrame, keys: list[str], score: str, k: int, idx: str = "idx") -> DataFrame:
    """The first k ranked options; all of them for k <= 0."""
    rows = ranked(options, keys, score, idx)
    return rows.where(F.col("rank") <= k) if k > 0 else rows


def score_analysis(options: DataFrame, keys: list[str], score: str, k: int = 5) -> DataFrame:
    """One row a decision: the top k indices, rank and score of the chosen option, and the best probability."""
    rows = ranked(options, keys, score)
    top = F.sort_array(F.collect_list(F.when(F.col("rank") <= k, F.struct("rank", "idx"))))
    return rows.groupBy(*keys).agg(
        F.transform(top, lambda x: x["idx"]).alias("top"),
        F.min(F.when(F.col("chosen"), F.col("rank"))).alias("chosen_rank"),
        F.max(F.when(F.col("chosen"), F.col(score))).alias("chosen_score"),
        F.max("probability").alias("best"),
    )


def rank_metrics(ranks: DataFrame, by: list[str], rank: str = "chosen_rank", n: str = "n") -> DataFrame:
    """top-1, top-3 (of decisions with 3 options or more), mean reciprocal rank and mean option count."""
    r = F.col(rank)
    return ranks.groupBy(*by).agg(
        F.count("*").alias("decisions"),
        F.round(F.avg((r == 1).cast("double")), 6).alias("top1"),
        F.round(F.avg(F.when(F.col(n) >= 3, (r <= 3).cast("double"))), 6).alias("top3"),
        F.round(F.avg(1 / r), 6).alias("mrr"),
        F.round(F.avg(n), 6).alias("mean_options"),
    )


def canonical_rank(options: DataFrame, keys: list[str], score: str, group: str) -> DataFrame:
    """Rank of the chosen option's group when every group counts once, at its best option."""
    best = options.groupBy(*keys, group).agg(F.max(F.struct(F.col(score).alias("s"), (-F.col("idx")).alias("i"))).alias("best"), F.max("chosen").alias("chosen"))
    order = Window.partitionBy(*keys).orderBy(F.desc("best.s"), F.desc("best.i"))
    return best.withColumn("canonical_rank", F.row_number().over(order).cast("long")).where("chosen").select(*keys, "canonical_rank")


def group_mass(options: DataFrame, keys: list[str], score: str, group: str) -> DataFrame:
    """Softmax mass of every group, with chosen."""
    rows = options.withColumn("p_", softmax(F.col(score), keys))
    return rows.groupBy(*keys, group).agg(F.sum("p_").alias("mass"), F.max("chosen").alias("chosen"), F.min("idx").alias("idx"))


def group_rank(options: DataFrame, keys: list[str], score: str, group: str) -> DataFrame:
    """Rank and negative log mass of the chosen group."""
    mass = group_mass(options, keys, score, group)
    order = Window.partitionBy(*keys).orderBy(F.desc(F.round("mass", 9)), "idx")
    rows = mass.withColumn("group_rank", F.row_number().over(order).cast("long"))
    return rows.where("chosen").select(*keys, "group_rank", (-F.log("mass")).alias("nll"))


def agreement(tops: DataFrame, keys: list[str], model: str, top: str, models: int) -> DataFrame:
    """all_agree, partial, disagree or unscored for each decision; a row for each (decision, model), top may be null."""
    count = F.count(top)
    most = F.max("n_")
    votes = tops.groupBy(*keys, top).agg(F.count(top).alias("n_"))
    return votes.groupBy(*keys).agg(F.sum("n_").alias("scored"), most.alias("most")).withColumn(
        "agreement", F.when(F.col("scored") == 0, "unscored").when(F.col("most") == models, "all_agree").when(F.col("most") > 1, "partial").otherwise("disagree")
    )


def bow_counts(options: DataFrame, text: str, chosen: str = "chosen") -> DataFrame:
    """token, in chosen options and in all: distinct tokens of each option."""
    words = F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), 1)))
    return options.select(words.alias("token"), F.col(chosen).cast("long").alias("c_")).groupBy("token").agg(F.sum("c_").alias("chosen"), F.count("*").alias("every"))


def bow_fit(counts: DataFrame, least: int = 1) -> DataFrame:
    """Add-one smoothed log ratio of each token's share among chosen options and among all."""
    total = counts.agg(F.sum("chosen").alias("chosen_all"), F.sum("every").alias("every_all"), F.count("*").alias("tokens"))
    ratio = F.log((F.col("chosen") + 1) / (F.col("chosen_all") + F.col("tokens"))) - F.log((F.col("every") + 1) / (F.col("every_all") + F.col("tokens")))
    return counts.crossJoin(F.broadcast(total)).where(F.col("every") >= least).select("token", F.round(ratio, 6).alias("weight"))  # total is one row


def bow_score(options: DataFrame, weights: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Summed weights of each option's distinct tokens."""
    words = F.explode_outer(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), 1)))
    return options.select(*keys, words.alias("token")).join(weights, "token", "left").groupBy(*keys).agg(F.round(F.coalesce(F.sum("weight"), F.lit(0.0)), 6).alias("bow_score"))


def bow_weights(options: DataFrame, text: str, kind: str, prompt: str, least: int = 1) -> DataFrame:
    """kind (token, option_type, prompt_option_type), key, weight: add-one smoothed log ratios of chosen and all options.

    Tokens that stand in fewer options than ``least`` have no weight, but count in the totals.
    """
    tokens = bow_counts(options, text).select(F.lit("token").alias("kind"), F.col("token").alias("key"), "chosen", "every")
    keys = F.array(F.struct(F.lit("option_type").alias("kind"), F.col(kind).alias("key")), F.struct(F.lit("prompt_option_type").alias("kind"), F.concat_ws("/", prompt, kind).alias("key")))
    types = options.select("chosen", F.explode(keys).alias("k")).groupBy("k.kind", "k.key").agg(F.sum(F.col("chosen").cast("long")).alias("chosen"), F.count("*").alias("every"))
    counts = tokens.unionByName(types)
    totals = counts.groupBy("kind").agg(F.sum("chosen").alias("all_chosen"), F.sum("every").alias("all_every"), F.count("*").alias("keys"))  # three rows
    ratio = lambda n, total: F.log((F.col(n) + 1) / (F.col(total) + F.col("keys")))
    rows = counts.join(F.broadcast(totals), "kind").where((F.col("kind") != "token") | (F.col("every") >= least))
    return rows.select("kind", "key", (ratio("chosen", "all_chosen") - ratio("every", "all_every")).alias("weight"))
