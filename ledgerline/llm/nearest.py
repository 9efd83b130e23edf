"""Operator 1: approximate nearest neighbours by cross-polytope hashing.

Unit vectors are turned by pseudo-rotations (three rounds of random signs and a fast
Hadamard transform) and hashed to the nearest signed axis, once for each table.  Every
vector is indexed in every table; queries probe the axes nearest to them, and the
candidates found are reranked by the exact distance of the original vectors.  A query whose
probed axes hold fewer than k vectors is answered from all vectors of its dimension.

Groups of one bucket are dealt in chunks of bounded size, so a bucket that holds much of the
table is many tasks; each task returns only its nearest few for each query, never all pairs.

Vectors that are null, zero or hold null or non-finite components take no part.  Vectors are
compared with those of their own dimension.  Ties go to the smaller id; rows that share an
id count as one, by the nearer vector; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import cut

TABLES, PROBES, CHUNK = 16, 8, 4_096
#: Neighbouring axes that one task takes together.
AXES = 16


def hadamard(rows: np.ndarray) -> np.ndarray:
    """Orthonormal Walsh-Hadamard transform of each row (their length a power of two)."""
    n, half = rows.shape[1], 1
    while half < n:
        pair = rows.reshape(len(rows), -1, 2, half)
        rows = np.stack([pair[:, :, 0] + pair[:, :, 1], pair[:, :, 0] - pair[:, :, 1]], axis=2).reshape(len(rows), n)
        half *= 2
    return rows / np.sqrt(n)


def axes(unit: np.ndarray, table: int, probes: int) -> np.ndarray:
    """The nearest signed axes of each row under the rotation of this table, nearest first; axis a + d is -a."""
    n = 1 << max(0, unit.shape[1] - 1).bit_length()
    turned = np.zeros((len(unit), n))
    turned[:, : unit.shape[1]] = unit
    signs = np.random.default_rng([table, n]).choice([-1.0, 1.0], (3, n))
    for s in signs:
        turned = hadamard(turned * s)
    both = np.concatenate([turned, -turned], axis=1)
    if probes == 1:
        return both.argmax(axis=1)[:, None]
    return np.argsort(-both, axis=1, kind="stable")[:, :probes]


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, vec (doubles) of the vectors that take part."""
    v = F.col("vec")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("vec")).where(F.col("vec_id").isNotNull() & v.isNotNull() & sound)


def hashed(vectors: DataFrame, tables: int, probes: int) -> DataFrame:
    """A row for each vector, table and probe: dim, table, axis, vec_id, vec (bytes of doubles)."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            ids, lists = b.column(0).to_numpy(zero_copy_only=False), b.column(1)
            dims = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], np.cumsum(dims)])
            for dim in np.unique(dims):
                own = np.nonzero(dims == dim)[0]
                x = flat[starts[own][:, None] + np.arange(dim)]
                big = np.abs(x).max(axis=1, keepdims=True)  # first, so that no square overflows
                unit = x / big
                unit /= np.linalg.norm(unit, axis=1, keepdims=True)
                raw = [r.tobytes() for r in x]
                for t in range(tables):
                    found = axes(unit, t, probes)
                    for p in range(found.shape[1]):
                        n = len(own)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(n, dim, np.int32)), pa.array(np.full(n, t, np.int32)), pa.array(found[:, p].astype(np.int32)), pa.array(ids[own]), pa.array(raw, pa.binary())],
                            ["dim", "table", "axis", "vec_id", "vec"],
                        )

    return vectors.mapInArrow(run, "dim int, table int, axis int, vec_id long, vec binary")


def nearest_in_chunk(k: int, block: int = 1 << 22):
    import pandas as pd

    def run(index, queries):
        found = []
        for axis in np.intersect1d(index["axis"], queries["axis"]):
            own, asked = index[index["axis"] == axis], queries[queries["axis"] == axis]
            x, q = (np.frombuffer(b"".join(f["vec"]), np.float64).reshape(len(f), -1) for f in (own, asked))
            ids = own["vec_id"].to_numpy()
            step = max(1, block // max(1, x.size))
            for i in range(0, len(q), step):
                with np.errstate(over="ignore"):
                    gap = np.sqrt(((x[None] - q[i : i + step, None]) ** 2).sum(axis=2))
                for row, query in zip(gap, asked["vec_id"].to_numpy()[i : i + step], strict=True):
                    near = np.nonzero(ids != query)[0]
                    if len(near) > k:
                        near = near[row[near] <= np.partition(row[near], k - 1)[k - 1]]
                    near = near[np.lexsort((ids[near], row[near]))][:k]
                    found.append((np.full(len(near), query), ids[near], row[near]))
        columns = [np.concatenate(c) for c in zip(*found, strict=True)] or [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), columns, strict=True)))

    return run


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, tables: int = TABLES, probes: int = PROBES, chunk: int = CHUNK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score (Euclidean distance) of the k nearest candidates of each query."""
    good = usable(vectors)
    index = hashed(good, tables, 1)
    # At most tables * 2 * dim rows for each dimension; a chunk for each so many vectors of a bucket.
    key = ["dim", "table", "axis"]
    chunks = cut(index.groupBy(key).agg(F.ceil(F.count("*") / chunk).cast("int").alias("chunks")))
    dealt = index.join(chunks, key).select(*key, F.pmod(F.xxhash64("vec_id", "vec"), F.col("chunks")).cast("int").alias("chunk"), "vec_id", "vec")
    asked = hashed(good.where(is_query), tables, probes).join(chunks, key).select(*key, F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "vec_id", "vec")
    group = lambda df: df.toDF("dim", "table", "axis", "chunk", "vec_id", "vec").groupBy("dim", "table", F.floor(F.col("axis") / AXES), "chunk")
    found = group(dealt).cogroup(group(asked)).applyInPandas(nearest_in_chunk(k), "query_id long, vec_id long, score double")
    best = cut(ranked(found, k))
    answers = best.groupBy("query_id").agg(F.count("*").alias("got"))
    queries = good.where(is_query).join(answers, F.col("vec_id") == F.col("query_id"), "left")
    short = cut(queries.where(F.coalesce("got", F.lit(0)) < k).select("vec_id", "vec"))
    if short.isEmpty():
        return best
    few = short.select(F.col("vec_id").alias("query_id")).distinct()
    return best.join(few, "query_id", "left_anti").unionByName(among_all(good, short, k, chunk))


def ranked(found: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of each query."""
    near = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return near.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def among_all(good: DataFrame, short: DataFrame, k: int, chunk: int) -> DataFrame:
    """The answers of these queries from all vectors of their dimension, dealt in chunks.

    They are queries whose probed axes hold fewer than k vectors: few, or there are few vectors at all.
    """
    every, asked = (hashed(d, 1, 1).withColumn("axis", F.lit(0)) for d in (good, short))
    sizes = cut(every.groupBy("dim").agg(F.ceil(F.count("*") / chunk).cast("int").alias("chunks")).join(asked.select("dim").distinct(), "dim"))  # a row for each dimension
    key = ["dim", "table", "axis"]
    dealt = every.join(sizes, "dim").select(*key, F.pmod(F.xxhash64("vec_id", "vec"), F.col("chunks")).cast("int").alias("chunk"), "vec_id", "vec")
    met = asked.join(sizes, "dim").select(*key, F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "vec_id", "vec")
    group = lambda df: df.toDF("dim", "table", "axis", "chunk", "vec_id", "vec").groupBy("dim", "chunk")
    return ranked(group(dealt).cogroup(group(met)).applyInPandas(nearest_in_chunk(k), "query_id long, vec_id long, score double"), k)
