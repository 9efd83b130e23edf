"""Features of states, options and cards, scorers by name, and example rows."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCORERS: dict[str, Callable[[pd.Series, pd.Series], pd.Series]] = {
    "first": lambda idx, score: -idx.astype("float64"),
    "score": lambda idx, score: score.astype("float64"),
    "blend": lambda idx, score: score - 0.01 * idx,
}


def scorer(name: str, idx: Column, score: Column) -> Column:
    """A registered scorer over Arrow batches of options."""
    chosen = SCORERS[name]

    @F.pandas_udf("double")
    def run(i: pd.Series, s: pd.Series) -> pd.Series:
        return chosen(i, s)

    return run(idx, score)


def state_text(parts: dict[str, Column]) -> Column:
    """'name=value | ...' of the parts that are there."""
    return F.concat_ws(" | ", *(F.when(c.isNotNull() & (c.cast("string") != ""), F.concat(F.lit(f"{n}="), c.cast("string"))) for n, c in parts.items()))


def canonical_key(name: Column, zone: Column, attachments: Column) -> Column:
    """Identity without the instance: null if unknown, attachments sorted."""
    return F.when(name.isNotNull(), F.concat_ws("|", name.cast("string"), zone, F.array_join(F.array_sort(attachments), ",")))


def confidence_at(path: Column, confidence: Column, unknown: Column, default: float = 1.0) -> Column:
    """0 for unknown paths, else the clamped value of the map, else the default."""
    return F.when(F.array_contains(unknown, path), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.element_at(confidence, path), F.lit(default)))))


def seat_of(*spellings: Column) -> Column:
    return F.coalesce(*spellings)


def logsumexp(df: DataFrame, keys: list[str], score: str) -> DataFrame:
    top = F.max(score).over(Window.partitionBy(*keys))
    rows = df.withColumns({"top_": top, "e_": F.exp(F.col(score) - top)})
    return rows.groupBy(*keys).agg((F.first("top_") + F.log(F.sum("e_"))).alias("logsumexp"))


def explain(df: DataFrame, weights: dict[str, float]) -> DataFrame:
    """One row for each factor: its contribution, by falling size."""
    parts = F.explode(F.array(*(F.struct(F.lit(f).alias("factor"), (F.col(f) * w).alias("contribution")) for f, w in weights.items())))
    return df.select("*", parts.alias("p_")).select("*", "p_.factor", "p_.contribution").drop("p_")


def baseline_select(df: DataFrame, least: Column, n: Column) -> Column:
    """The first legal selection: as many of the lowest indices as must be chosen."""
    k = F.least(least, n)
    return F.when(k > 0, F.sequence(F.lit(0).cast("long"), k - 1)).otherwise(F.array().cast("array<long>"))


#: Fixed pattern: words, numbers with a sign, and marks of a rules text.
RULES_WORDS = r"[a-z0-9]+(?:/[a-z0-9]+)?|[+\-]\d+|[{}():,]"


def hash_features_of(text: Column) -> Column:
    """Features of a text: words ('w:'), 3-grams of words of three letters on and 4-grams of words of five on, between marks."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({RULES_WORDS})"), 1)

    def grams(word: Column, n: int, least: int) -> Column:
        marked = F.concat(F.lit("^"), word, F.lit("$"))
        places = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(marked) - n + 1))
        return F.when(F.length(word) >= least, F.transform(places, lambda i: F.concat(F.lit(f"c{n}:"), F.substr(marked, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))

    return F.flatten(F.transform(words, lambda w: F.concat(F.array(F.concat(F.lit("w:"), w)), grams(w, 3, 3), grams(w, 4, 5))))


def hash_embedding(df: DataFrame, text: str, dim: int = 384) -> DataFrame:
    """The frame with vector: signed hashes of a text's features, of length 1 unless empty; computed once for each distinct text."""
    import hashlib

    import numpy as np

    def one(own) -> list[float]:
        h = np.array([int.from_bytes(hashlib.blake2b(f.encode(), digest_size=8).digest(), "little") for f in own], np.uint64)
        v = np.bincount((h % np.uint64(dim)).astype(np.int64), np.where(h >> np.uint64(63), -1.0, 1.0), dim) if len(h) else np.zeros(dim)
        n = np.linalg.norm(v)
        return (v / n if n else v).tolist()

    def run(frames):
        for frame in frames:
            yield pd.DataFrame({"text_": frame["text_"], "vector": frame["features_"].map(one)})

    distinct = df.select(F.col(text).alias("text_")).distinct().withColumn("features_", hash_features_of(F.col("text_")))
    vectors = distinct.mapInPandas(run, "text_ string, vector array<double>")
    return df.join(vectors, F.col(text).eqNullSafe(F.col("text_")), "left").drop("text_")


def steps(df: DataFrame, run: str, order: str, state: str, final: Column) -> DataFrame:
    """before and after of each step: the next step's state, or the final one."""
    return df.select("*", F.col(state).alias("before"), F.coalesce(F.lead(state).over(Window.partitionBy(run).orderBy(order)), final).alias("after"))


def running_pack(df: DataFrame, draft: str, order: str, pick: str, reset: Column) -> DataFrame:
    """picks so far in the running draft: a reset starts a new one."""
    w = Window.partitionBy(draft).orderBy(order)
    rows = df.withColumn("run_", F.sum(F.when(reset, 1).otherwise(0)).over(w))
    return rows.withColumn("picked", F.count(pick).over(Window.partitionBy(draft, "run_").orderBy(order))).drop("run_")
