"""Comparison statistics: match scores, cluster bootstrap, sign flips, Holm, calibration, preferences, sampling.

Rows are summed to clusters before anything is drawn, so replicates never touch raw rows.
Random draws are sha256 of (seed, replicate, cluster), the same on every run and engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MODULUS = 1_000_003


def draw(*parts: Column | str) -> Column:
    """A whole number below 16**8 from the sha256 of the joined parts."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 8), 16, 10).cast("long")


def score_value(value: Column) -> Column:
    """win, draw and loss words to 1, 0.5 and 0, else a finite number, else null."""
    word = F.lower(F.trim(value.cast("string")))
    number = value.cast("string").try_cast("double")
    finite = F.when(~F.isnan(number) & (F.abs(number) < float("inf")), number)
    return F.when(word.isin("win", "won", "w"), 1.0).when(word.isin("draw", "tie", "d"), 0.5).when(word.isin("loss", "lost", "l"), 0.0).otherwise(finite)


def match_scores(matches: DataFrame, keys: list[str], score: str, cluster: str) -> DataFrame:
    """Mean score of each key and its cluster; a key in two clusters has clusters > 1."""
    return matches.groupBy(*keys).agg(F.avg(score).alias("score"), F.count("*").alias("games"), F.min(cluster).alias("cluster"), F.countDistinct(cluster).alias("clusters"))


def cluster_sums(df: DataFrame, by: list[str], cluster: str, value: str) -> DataFrame:
    return df.groupBy(*by, cluster).agg(F.sum(value).alias("sum"), F.count(value).alias("n"))


def cluster_bootstrap(df: DataFrame, by: list[str], cluster: str, value: str, samples: int = 200, confidence: float = 0.95, seed: int = 0) -> DataFrame:
    """Percentile interval of a mean, whole clusters drawn with replacement.

    Each replicate draws as many clusters as there are: draw k picks the cluster of place draw mod count.
    """
    sums = cluster_sums(df, by, cluster, value)
    w = Window.partitionBy(*by)
    placed = sums.withColumns({"place": F.row_number().over(w.orderBy(cluster)) - 1, "clusters": F.count("*").over(w)})
    slots = placed.select(*by, F.col("place").alias("slot"), "clusters", F.explode(F.sequence(F.lit(1), F.lit(samples))).alias("replicate"))
    drawn = slots.withColumn("place", (draw(F.lit(str(seed)), F.col("replicate").cast("string"), F.col("slot").cast("string")) % F.col("clusters")).cast("int"))
    means = drawn.join(placed.select(*by, "place", "sum", "n"), [*by, "place"]).groupBy(*by, "replicate").agg((F.sum("sum") / F.sum("n")).alias("mean"))
    edge = (1 - confidence) / 2
    interval = means.groupBy(*by).agg(F.round(F.percentile("mean", F.lit(edge)), 6).alias("low"), F.round(F.percentile("mean", F.lit(1 - edge)), 6).alias("high"))
    whole = sums.groupBy(*by).agg(F.round(F.sum("sum") / F.sum("n"), 6).alias("mean"), F.count("*").alias("clusters"))
    return whole.join(interval, by)


def sign_flip(deltas: DataFrame, by: list[str], cluster: str, delta: str, samples: int = 200, seed: int = 0) -> DataFrame:
    """p of the mean of cluster means under random signs: (extreme + 1) / (samples + 1)."""
    means = deltas.groupBy(*by, cluster).agg(F.avg(delta).alias("m_"))
    seen = means.groupBy(*by).agg(F.abs(F.avg("m_")).alias("observed"))
    flips = means.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(samples))))
    sign = F.when(draw(F.lit(str(seed)), F.col("replicate").cast("string"), F.col(cluster).cast("string")) % 2 == 0, 1).otherwise(-1)
    drawn = flips.groupBy(*by, "replicate").agg(F.abs(F.avg(F.col("m_") * sign)).alias("value"))
    return drawn.join(seen, by).groupBy(*by).agg(F.round((F.count(F.when(F.col("value") >= F.col("observed") - 1e-12, 1)) + 1) / (samples + 1), 6).alias("p_value"))


def holm(df: DataFrame, p: str, order: list[str], by: list[str] | None = None) -> DataFrame:
    """Step-down adjusted p values: sorted by p, ties by the order columns."""
    part = Window.partitionBy(*(by or [F.lit(0)]))
    steps = part.orderBy(p, *order)
    rows = df.withColumn("scaled_", F.least(F.lit(1.0), (F.count("*").over(part) - F.row_number().over(steps) + 1) * F.col(p)))
    return rows.withColumn("adjusted", F.max("scaled_").over(steps.rowsBetween(Window.unboundedPreceding, 0))).drop("scaled_")


def calibration(df: DataFrame, by: list[str], probability: str, target: str, bins: int = 10) -> DataFrame:
    """Brier score, log loss and expected calibration error."""
    p, t = F.col(probability), F.col(target)
    safe = F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), p))
    loss = -(t * F.log(safe) + (1 - t) * F.log(1 - safe))
    binned = df.groupBy(*by, F.least(F.floor(p * bins), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"), F.sum(p).alias("p"), F.sum(t).alias("t"), F.sum((p - t) * (p - t)).alias("b"), F.sum(loss).alias("l"))
    n = F.sum("n")
    return binned.groupBy(*by).agg(n.alias("rows"), F.round(F.sum("b") / n, 6).alias("brier"), F.round(F.sum("l") / n, 6).alias("log_loss"), F.round(F.sum(F.abs(F.col("p") - F.col("t"))) / n, 6).alias("ece"))


def reliability(df: DataFrame, probability: str, target: str, bins: int = 10) -> DataFrame:
    p = F.col(probability)
    return df.groupBy(F.least(F.floor(p * bins), F.lit(bins - 1)).cast("long").alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg(p), 6).alias("mean_p"), F.round(F.avg(target), 6).alias("rate"))


def oriented(value: Column, transform: str = "identity", direction: str = "higher_better", scale: float = 1.0, least: float | None = None, most: float | None = None, default: float = 0.0) -> Column:
    """A factor clamped, transformed, turned so that larger is better, and scaled."""
    x = F.coalesce(value.cast("double"), F.lit(default))
    x = F.greatest(F.lit(float(least)), x) if least is not None else x
    x = F.least(F.lit(float(most)), x) if most is not None else x
    made = {
        "identity": lambda v: v,
        "log1p": F.log1p,
        "signed_log1p": lambda v: F.signum(v) * F.log1p(F.abs(v)),
        "sqrt": F.sqrt,
        "tanh": F.tanh,
        "binary": lambda v: F.when(v > 0, 1.0).otherwise(0.0),
    }[transform](x)
    return (made if direction == "higher_better" else -made) / float(scale)


def sigmoid(x: Column) -> Column:
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def preference_metrics(df: DataFrame, by: list[str], margin: str, left_preferred: str, weight: str) -> DataFrame:
    """Weighted accuracy (margins of 0 left out), log loss, Brier score and mean margin of the preferred side."""
    p = sigmoid(F.col(margin))
    right = F.when(F.col(left_preferred), p).otherwise(1 - p)
    w, own = F.col(weight), F.when(F.col(left_preferred), F.col(margin)).otherwise(-F.col(margin))
    decided = F.when(F.col(margin) != 0, w)
    return df.groupBy(*by).agg(
        (F.sum(decided * (own > 0).cast("double")) / F.sum(decided)).alias("accuracy"),
        (F.sum(w * -F.log(F.greatest(right, F.lit(1e-12)))) / F.sum(w)).alias("log_loss"),
        (F.sum(w * (1 - right) * (1 - right)) / F.sum(w)).alias("brier"),
        (F.sum(w * own) / F.sum(w)).alias("mean_margin"),
    )


def expert_agreement(df: DataFrame, context: str, expert: str, vote: str, weight: str) -> DataFrame:
    """Contexts with two raters or more: the weighted share of the majority."""
    votes = df.groupBy(context, vote).agg(F.sum(weight).alias("w_"))
    raters = df.groupBy(context).agg(F.countDistinct(expert).alias("raters")).where("raters >= 2")
    share = votes.groupBy(context).agg(F.round(F.max("w_") / F.sum("w_"), 6).alias("majority"))
    return raters.join(share, context)


def fit_preferences(examples: DataFrame, factors: list[str], weight: str, rounds: int = 40, rate: float = 0.5, l2: float = 0.01) -> list[float]:
    """Non-negative weights w with sigmoid(w . difference) near 1, by projected gradient steps of a falling rate.

    ``factors`` are differences preferred - other.  Every step is one aggregation of as many numbers as factors.
    """
    rows = examples.groupBy(*factors).agg(F.sum(weight).alias("w_")).cache()
    total = rows.agg(F.sum("w_")).first()[0] or 0.0
    now = [0.0] * len(factors)
    for k in range(rounds if total else 0):
        margin = sum((F.col(f) * c for f, c in zip(factors, now, strict=True)), F.lit(0.0))
        slope = rows.agg(*(F.sum(F.col("w_") * F.col(f) * (1 - sigmoid(margin))).alias(f) for f in factors)).first()
        now = [max(0.0, c + rate / (1 + k) ** 0.5 * (g / total - l2 * c)) for c, g in zip(now, slope, strict=True)]
    rows.unpersist()
    return now


def sample_n(df: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """A uniform sample of at most n rows: those of the smallest sha256 of (seed, key)."""
    return df.orderBy(F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")), 256), key).limit(n)


def split_groups(df: DataFrame, group: str, fraction: float, seed: int = 0) -> DataFrame:
    """held_out for whole groups: the round(n * fraction) of the smallest hash, at least 1 and at most n - 1.

    Counts of 65,536 ranges of the hash tell which ranges are held out whole; only the range at the border is sorted.
    """
    hashed = F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col(group).cast("string")), 256)
    groups = df.select(group).distinct().withColumn("h_", hashed).withColumn("range_", F.substring("h_", 1, 4))
    counts = sorted((r["range_"], r["count"]) for r in groups.groupBy("range_").count().collect())
    n = sum(c for _, c in counts)
    take = min(max(1, round(n * fraction)), n - 1) if n > 1 else 0
    border, left = "", take
    for border, c in counts:
        if left < c:
            break
        left -= c
    rest = groups.where(F.col("range_") == border).orderBy("h_", group).limit(left).select(group, F.lit(True).alias("border_"))
    whole = F.substring(hashed, 1, 4) < border
    return df.join(rest, group, "left").withColumn("held_out", F.lit(take > 0) & F.coalesce(whole | F.coalesce("border_", F.lit(False)), F.lit(False))).drop("border_")


def take_per_group(df: DataFrame, group: str, order: list, n: int) -> DataFrame:
    """The first n rows of each group, with truncated."""
    w = Window.partitionBy(group)
    rows = df.withColumns({"place_": F.row_number().over(w.orderBy(*order)), "size_": F.count("*").over(w)})
    return rows.where(F.col("place_") <= n).withColumn("truncated", F.col("size_") > n).drop("place_", "size_")


def vector_spread(df: DataFrame, vector: str) -> DataFrame:
    """dimension, mean and population standard deviation of a vector column."""
    return df.select(F.posexplode(vector).alias("dimension", "x")).groupBy("dimension").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"), F.round(F.stddev_pop(F.col("x").cast("double")), 6).alias("std"))


def effective_rank(df: DataFrame, vector: str) -> float:
    """exp of the entropy of the covariance's eigenvalue shares.

    Every task sums its own d x d products; Spark sums those, and the driver gets d x d numbers.  Vectors that are null,
    or hold a null, and those of another length than the longest don't count.
    """
    import numpy as np
    import pyarrow as pa

    sound = df.select(F.col(vector).cast("array<double>").alias("v")).where(F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull()))
    d = sound.agg(F.max(F.size("v"))).first()[0] or 0

    def run(batches):
        total = np.zeros((d + 1, d + 1))
        for b in batches:
            x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, d)
            x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange((d + 1) ** 2)), pa.array(total.ravel())], ["place", "total"])

    rows = sound.where(F.size("v") == d).mapInArrow(run, "place long, total double").groupBy("place").agg(F.sum("total").alias("total")).collect() if d else []
    sums = np.zeros((d + 1) ** 2)
    for r in rows:
        sums[r["place"]] = r["total"]
    sums = sums.reshape(d + 1, d + 1)
    if not sums[d, d]:
        return 0.0
    mean = sums[d, :d] / sums[d, d]
    values = np.clip(np.linalg.eigvalsh(sums[:d, :d] / sums[d, d] - np.outer(mean, mean)), 0, None)
    share = values[values > 0] / values.sum() if values.sum() > 0 else np.zeros(0)
    return float(np.exp(-(share * np.log(share)).sum())) if len(share) else 0.0
