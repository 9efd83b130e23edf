"""Operator 12: hard negatives by rotated one-bit codes with deterministic intervals.

Every integer vector is turned by a pseudo-rotation (random signs and Hadamard transforms)
and coded by its signs, one bit a component, with its alignment, the inner product of vector
and code.  What the code leaves is turned and coded again, CODES times in all, and its norm
kept.  For an anchor, whose turned components are cut to bit planes, popcounts give each
vector's estimated score, and by Cauchy-Schwarz the score lies within the rest's norm times
that of the anchor, less its part along the code.  After every code, vectors whose interval
shows that they cannot be among the first ones go; what survives is scored in integers.

Vectors are dealt to blocks and anchors to chunks, both of bounded size; every chunk meets
every block in a task of its own, which returns the few best of each anchor.  Anchors first
find their positives, among blocks of their label, then their negatives.

Rows with a null vec_id or label, a null vector, null or non-finite components, or components
of vectors.LIMIT and beyond, take no part.  Vectors are compared with those of their own
dimension.  Rows are apart from each other even with one vec_id, so that a copy of an anchor
is another row, and an anchor that stands twice is answered twice.  An empty table, anchors
without positives and positives without negatives give no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import cut, written
from ledgerline.llm.nearest import hadamard
from ledgerline.llm.vectors import by_dimension, matrix, whole_vectors

CODES, PLANES = 7, 8
#: Most vectors of a block and anchors of a chunk, expected.
BLOCK, CHUNK = 1 << 16, 1 << 14
POSITIVES, NEGATIVES = 5, 10
#: Negatives score from LEAST to MOST hundredths of the positive's score.
LEAST, MOST = 30, 90
MARGIN = 1e-9


def turned(rows: np.ndarray, turn: int) -> np.ndarray:
    """A pseudo-rotation of the rows, whose length is a power of two."""
    for s in np.random.default_rng([77, turn, rows.shape[1]]).choice([-1.0, 1.0], (3, rows.shape[1])):
        rows = hadamard(rows * s)
    return rows


def widened(x: np.ndarray) -> np.ndarray:
    """Doubles, with zeros up to a power of two."""
    out = np.zeros((len(x), 1 << max(0, x.shape[1] - 1).bit_length()))
    out[:, : x.shape[1]] = x
    return out


def words(bits: np.ndarray) -> np.ndarray:
    """Rows of booleans -> rows of 64-bit words."""
    packed = np.packbits(bits, axis=1, bitorder="little")
    return np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8))).view(np.uint64)


def coded(x: np.ndarray, codes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes (rows, codes, words), alignments and norms of the rests (rows, codes)."""
    rest, n = widened(x), 1 << max(0, x.shape[1] - 1).bit_length()
    found, along, left = [], [], []
    for turn in range(codes):
        rest = turned(rest, turn)
        up = rest >= 0
        part = np.abs(rest).sum(axis=1) / np.sqrt(n)
        rest = rest - np.where(up, 1.0, -1.0) * (part / np.sqrt(n))[:, None]
        found.append(words(up))
        along.append(part)
        left.append(np.linalg.norm(rest, axis=1))
    return np.stack(found, axis=1), np.stack(along, axis=1), np.stack(left, axis=1)


class Asked:
    """An anchor's turned components as bit planes, one set for each code."""

    def __init__(self, q: np.ndarray, codes: int, planes: int = PLANES):
        y = widened(q[None])
        self.n, self.norm = y.shape[1], float(np.linalg.norm(y))
        self.steps = []
        for turn in range(codes):
            y = turned(y, turn)
            low, step = y.min(), max(np.ptp(y) / ((1 << planes) - 1), 1e-300)
            level = np.round((y[0] - low) / step).astype(np.int64)
            bits = words(((level >> np.arange(planes)[:, None]) & 1).astype(bool))
            self.steps.append((bits, low, step, level.sum(), np.abs(y[0] - low - step * level).sum()))

    def code_product(self, turn: int, code: np.ndarray) -> tuple[np.ndarray, float]:
        """Inner products of the anchor with unit codes, from popcounts, and by how much they may err."""
        bits, low, step, total, error = self.steps[turn]
        sums = sum((1 << k) * np.bitwise_count(code & plane).sum(axis=1, dtype=np.int64) for k, plane in enumerate(bits))
        ones = np.bitwise_count(code).sum(axis=1, dtype=np.int64)
        root = np.sqrt(self.n)
        return (low * (2 * ones - self.n) + step * (2 * sums - total)) / root, error / root


def kth(values: np.ndarray, k: int) -> float:
    return -np.inf if len(values) < k else float(np.partition(values, len(values) - k)[len(values) - k])


def survivors(asked: Asked, alive: np.ndarray, code, along, left, needed) -> np.ndarray:
    """Places of the vectors that their intervals leave possible; needed(low, high) judges them after each code."""
    at, slack = np.zeros(len(alive)), np.full(len(alive), MARGIN)
    for turn in range(code.shape[1]):
        if not len(alive):
            break
        dot, error = asked.code_product(turn, code[alive, turn])
        part = along[alive, turn]
        at, slack = at + part * dot, slack + part * (error + MARGIN * asked.norm)
        across = np.sqrt(np.maximum(0, asked.norm**2 - np.maximum(0, np.abs(dot) - error) ** 2))
        half = left[alive, turn] * (across + MARGIN * asked.norm) + slack
        keep = needed(at - half, at + half)
        alive, at, slack = alive[keep], at[keep], slack[keep]
    return alive


def first_ones(score, ids, rows, k):
    return np.lexsort((rows, ids, -score))[:k]


def positives_of(asked, k):
    def needed(low, high):
        return high >= kth(low, k)

    return needed


def negatives_of(spans, k):
    def needed(low, high):
        keep = np.zeros(len(low), bool)
        for least, most in spans:
            sure = (low >= least) & (high <= most)
            keep |= (high >= max(least, kth(low[sure], k))) & (low <= most)
        return keep

    return needed


def mined(mode: str, k: int, codes: int, least: int, most: int):
    """Cogroup of a block of vectors and a chunk of anchors: anchor (row), positive_score, row_, vec_id, score."""
    import pyarrow as pa

    names = ["anchor", "positive_score", "row_", "vec_id", "score"]

    def run(block, chunk):
        found = [[] for _ in names]
        if block.num_rows and chunk.num_rows:
            dim = block.column("dim")[0].as_py()
            x, q = matrix(block.column("vec"), dim), matrix(chunk.column("vec"), dim)
            read = lambda name, kind, *shape: np.frombuffer(b"".join(block.column(name).to_pylist()), kind).reshape(len(x), codes, *shape)
            code, along, left = read("code", np.uint64, -1), read("along", np.float64), read("left", np.float64)
            ids, rows, labels = (block.column(c).to_numpy() for c in ("vec_id", "row_", "label"))
            asked_rows, asked_labels = chunk.column("row_").to_numpy(), chunk.column("label").to_numpy()
            for i, anchor in enumerate(asked_rows):
                one = Asked(q[i], codes)
                if mode == "positives":
                    spans = [(0, None, None)]
                    alive = survivors(one, np.nonzero(rows != anchor)[0], code, along, left, positives_of(one, k))
                else:
                    # Scores from ceil(least * p / 100) to floor(most * p / 100), in whole numbers.
                    spans = [(p, -(-least * p // 100), most * p // 100) for p in chunk.column("scores")[i].as_py()]
                    alive = survivors(one, np.nonzero(labels != asked_labels[i])[0], code, along, left, negatives_of([s[1:] for s in spans], k))
                score = x[alive] @ q[i]
                for p, low, high in spans:
                    own = np.arange(len(alive)) if low is None else np.nonzero((score >= low) & (score <= high))[0]
                    own = own[first_ones(score[own], ids[alive[own]], rows[alive[own]], k)]
                    for to, values in zip(found, (np.full(len(own), anchor), np.full(len(own), p), rows[alive[own]], ids[alive[own]], score[own]), strict=True):
                        to.append(values)
        return pa.table({n: pa.array(np.concatenate(v).astype(np.int64) if v else np.zeros(0, np.int64)) for n, v in zip(names, found, strict=True)})

    return run


MINED = "anchor long, positive_score long, row_ long, vec_id long, score long"
CODED = "vec_id long, label long, dim int, vec binary, code binary, along binary, left binary"


def coded_vectors(vectors: DataFrame, codes: int) -> DataFrame:
    """CODED and row_, a number of each row, written once."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            for own, x in by_dimension(b.column(2)):
                raw = lambda m: pa.array([r.tobytes() for r in m], pa.binary())
                code, along, left = coded(x, codes)
                at = pa.array(own)
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(np.full(len(own), x.shape[1], np.int32)), raw(x.astype(np.int32)), raw(code), raw(along), raw(left)], [c.split()[0] for c in CODED.split(", ")])

    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    whole = whole_vectors(vectors, F.col("vec_id").cast("long"), moved.alias("label")).where("vec_id is not null and label is not null")
    return written(whole.mapInArrow(run, CODED).withColumn("row_", F.monotonically_increasing_id()), "coded")


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST, most: int = MOST, codes: int = CODES, block: int = BLOCK, chunk: int = CHUNK
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; is_anchor reads vec_id and label."""
    spark = vectors.sparkSession
    index = coded_vectors(vectors, codes)
    anchors = index.where(is_anchor).select("row_", "vec_id", "label", "dim", "vec")
    many, asked = index.count(), anchors.count()
    blocks = max(-(-many // block), int(spark.conf.get("spark.sql.shuffle.partitions")))
    chunks = max(1, -(-asked // chunk))
    number = lambda n: F.pmod(F.xxhash64("row_"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    held = index.withColumn("block", number(blocks)).withColumn("chunk", every(chunks))
    # Renamed column by column: both sides come from one table.
    met = lambda df: df.withColumn("chunk", number(chunks)).withColumn("block", every(blocks)).toDF(*df.columns, "chunk", "block")

    def search(mode, k, of, *by):
        pair = held.groupBy("dim", *by, "block", "chunk").cogroup(met(of).groupBy("dim", *by, "block", "chunk"))
        found = pair.applyInArrow(mined(mode, k, codes, least, most), MINED)
        place = F.row_number().over(Window.partitionBy("anchor", "positive_score").orderBy(F.desc("score"), "vec_id", "row_"))
        return found.withColumn("place", place).where(F.col("place") <= k)

    near = cut(search("positives", positives, anchors, "label").select("anchor", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), "place"))
    scores = near.groupBy("anchor").agg(F.collect_set("positive_score").alias("scores"))
    hard = search("negatives", negatives, anchors.join(scores, F.col("anchor") == F.col("row_")).drop("anchor"))
    hard = hard.select("anchor", "positive_score", F.col("place").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    name = anchors.select(F.col("row_").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    return near.drop("place").join(hard, ["anchor", "positive_score"]).join(name, "anchor").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
