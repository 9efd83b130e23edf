"""Operator 13: centroid clustering with geometric drift tightening.

Every vector keeps its cluster and a lower bound on its distance to each centroid.  When
centroids have moved, a bound is loosened, not by the full drift but by what the drift can
mean inside the sphere of the vector's cluster: for x, an old centroid p and the new one q,
|x - p| - |x - q| is at most |p - q| * cos(angle of x - m to q - p), m their middle, and over
a sphere that angle is least on the cone from m that touches it.  A vector whose exact
distance to its own centroid stays under all bounds keeps its cluster; an ambiguous one is
compared exactly with the centroids whose bounds it passes.  Distances are exact integers
and bounds have a margin for rounding, so the result is that of the plain rule.

Each round writes clusters and bounds in the shared folder and drops the round before; the
driver sees one row for each centroid and component.

Vectors that are null, of another dimension, or hold null or non-finite components or ones
of vectors.LIMIT and beyond, take no part.  Rows are vectors of their own: repeated rows are
clustered each.  Among equal hashes the smaller vector comes first; rows without vec_id come
after all others.  Fewer vectors than centroids give so many centroids; none give no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import remove, scratch
from ledgerline.llm.vectors import by_dimension, matrix, whole_vectors

CENTROIDS, ROUNDS, DIMS = 40, 5, 64
#: Relative margin of the bounds; rounding errs by some 1e-14.
MARGIN = 1e-9
RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def squares(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows to all centroids."""
    if max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0)) < 1 << 20:  # then doubles hold every sum
        a, b = x.astype(np.float64), centroids.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)).astype(np.int64)
    return np.stack([((x - c) ** 2).sum(axis=1) for c in centroids], axis=1)


def loosening(old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """[a, j]: by how much the lower bounds of cluster a's vectors on centroid j fall when all centroids move."""
    old, new = old.astype(np.float64), new.astype(np.float64)
    moved = np.linalg.norm(new - old, axis=1)
    axis = (new - old) / np.maximum(moved, 1e-300)[:, None]
    middle = (old + new) / 2
    out = np.zeros((len(old), len(old)))
    for a, (centre, r) in enumerate(zip(old, radius, strict=True)):
        arm = centre - middle
        length = np.linalg.norm(arm, axis=1)
        outside = length > r * (1 + MARGIN)
        safe = np.where(outside, length, 1)
        angle = np.arccos(np.clip((arm * axis).sum(axis=1) / safe, -1, 1)) - np.arcsin(np.where(outside, r / safe, 0))
        share = np.where(outside, np.cos(np.clip(angle, 0, np.pi / 2)), 1)
        out[a] = np.where(moved > 0, moved * np.minimum(1, share + MARGIN), 0)
    return out


def floats_below(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x.astype(np.float32), np.float32(-np.inf))


def state_batch(ids, vec, cluster, lower, distance, compared):
    import pyarrow as pa

    bounds = pa.array([r.tobytes() for r in lower], pa.binary())
    return pa.RecordBatch.from_arrays([ids, vec, pa.array(cluster.astype(np.int32)), bounds, pa.array(distance), pa.array(compared.astype(np.int32))], ["vec_id", "vec", "cluster", "lower", "distance", "compared"])


def first_state(k: np.ndarray):
    """vec_id, vec (doubles) -> the state after the first assignment to these centroids."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            for own, x in by_dimension(b.column(1)):
                d = squares(x, k)
                cluster = d.argmin(axis=1)
                raw = pa.array([r.tobytes() for r in x.astype(np.int32)], pa.binary())
                yield state_batch(b.column(0).take(pa.array(own)), raw, cluster, floats_below(np.sqrt(d)), d[np.arange(len(x)), cluster], np.full(len(x), len(k)))

    return run


def reassigned(x: np.ndarray, cluster: np.ndarray, lower: np.ndarray, k: np.ndarray, step: int = 1 << 15):
    """Cluster, bounds, squared distance and exact comparisons of each vector; lower holds bounds on the distances to k."""
    own = ((x - k[cluster]) ** 2).sum(axis=1)
    rows, upper = np.arange(len(x)), np.sqrt(own)
    lower[rows, cluster] = np.inf
    at, to = np.nonzero(lower <= (upper * (1 + MARGIN) + MARGIN)[:, None])
    exact = np.full(lower.shape, np.iinfo(np.int64).max)
    for i in range(0, len(at), step):
        exact[at[i : i + step], to[i : i + step]] = ((x[at[i : i + step]] - k[to[i : i + step]]) ** 2).sum(axis=1)
    lower[at, to] = floats_below(np.sqrt(exact[at, to]))
    exact[rows, cluster], lower[rows, cluster] = own, floats_below(upper)
    cluster = exact.argmin(axis=1)  # the smaller of equal ones; centroids left out are farther
    return cluster, lower, exact[rows, cluster], 1 + np.bincount(at, minlength=len(x))


def next_state(k: np.ndarray, loosened: np.ndarray):
    """The state after the centroids have moved to k."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                cluster = b.column("cluster").to_numpy()
                lower = np.frombuffer(b"".join(b.column("lower").to_pylist()), np.float32).reshape(b.num_rows, len(k))
                lower = floats_below(lower - loosened[cluster])
                yield state_batch(b.column("vec_id"), b.column("vec"), *reassigned(matrix(b.column("vec"), k.shape[1]), cluster, lower, k))

    return run


STATE = "vec_id long, vec binary, cluster int, lower binary, distance long, compared int"


def task_sums(clusters: int, dim: int):
    """A row for each cluster and component of a task (part = dim: the count), and the largest squared distance."""
    import pyarrow as pa

    def run(batches):
        sums, far = np.zeros((clusters, dim + 1), np.int64), np.zeros(clusters, np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            cluster = b.column("cluster").to_numpy()
            x = np.concatenate([matrix(b.column("vec"), dim), np.ones((b.num_rows, 1), np.int64)], axis=1)
            order = np.argsort(cluster, kind="stable")
            held, starts = np.unique(cluster[order], return_index=True)
            sums[held] += np.add.reduceat(x[order], starts, axis=0)
            far[held] = np.maximum(far[held], np.maximum.reduceat(b.column("distance").to_numpy()[order], starts))
        held = np.nonzero(sums[:, dim])[0]
        part = np.tile(np.arange(dim + 1, dtype=np.int32), len(held))
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(held, dim + 1).astype(np.int32)), pa.array(part), pa.array(sums[held].ravel()), pa.array(np.repeat(far[held], dim + 1))], ["cluster", "part", "total", "far"])

    return run


def moved_centroids(state: DataFrame, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The centroids after this state, and the radius of each cluster about its old one."""
    rows = state.select("cluster", "vec", "distance").mapInArrow(task_sums(*k.shape), "cluster int, part int, total long, far long")
    found = rows.groupBy("cluster", "part").agg(F.sum("total").alias("total"), F.max("far").alias("far")).toPandas()  # centroids * (dims + 1) rows at most
    new, radius = k.copy(), np.zeros(len(k))
    for cluster, own in found.groupby("cluster"):
        total = own.set_index("part")["total"]
        new[cluster] = [int(total[i]) // int(total[k.shape[1]]) for i in range(k.shape[1])]
        radius[cluster] = np.sqrt(float(own["far"].max())) * (1 + MARGIN)
    return new, radius


def first_centroids(kept: DataFrame, count: int, dim: int, salt: str) -> np.ndarray:
    rank = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256)
    rows = kept.select("vec", rank.alias("rank")).orderBy(F.col("rank").asc_nulls_last(), "vec").limit(count).collect()  # count rows
    return np.array([np.floor(256 * np.array(r["vec"])).astype(np.int64) for r in rows]).reshape(len(rows), dim)


def clustered(vectors: DataFrame, count: int = CENTROIDS, rounds: int = ROUNDS, dim: int = DIMS, salt: str = "2:") -> tuple[DataFrame, np.ndarray] | None:
    """The last state (vec_id, vec, cluster, lower, distance, compared: exact distances taken in the last round) and its centroids; None without vectors."""
    spark = vectors.sparkSession
    kept = whole_vectors(vectors, F.col("vec_id").cast("long")).where(F.size("vec") == dim)
    k = first_centroids(kept, count, dim, salt)
    if not len(k):
        return None
    made, path = kept.mapInArrow(first_state(k), STATE), ""
    for turn in range(rounds + 1):
        past, path = path, scratch(spark, "clusters")
        made.write.option("compression", "zstd").parquet(path)
        if past:
            remove(spark, past)
        state = spark.read.schema(STATE).parquet(path)
        if turn < rounds:
            new, radius = moved_centroids(state, k)
            made = state.mapInArrow(next_state(new, loosening(k, new, radius)), STATE)
            k = new
    return state, k


def centroid_clusters(vectors: DataFrame, count: int = CENTROIDS, rounds: int = ROUNDS, dim: int = DIMS, salt: str = "2:") -> DataFrame:
    """A row for each vector: vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256."""
    spark = vectors.sparkSession
    found = clustered(vectors, count, rounds, dim, salt)
    if found is None:
        return spark.createDataFrame([], RESULT)
    state, k = found
    sums = {r["cluster"]: r["s"] for r in state.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # a row for each centroid
    digest = lambda c: hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()
    facts = spark.createDataFrame([(c, s, sum(sums.values()), digest(k[c])) for c, s in sums.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return state.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
