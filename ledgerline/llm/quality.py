"""Operator 3: supervised subword embeddings as a quality classifier.

A document is the average of learned vectors of its hashed features: each word, the
character 3- to 5-grams of the word between marks, and each pair of neighbouring words (a
word repeated at once counts as one marked pair, whichever the word).  A softmax layer on
the average gives the classes; vectors and layer are learned by stochastic gradient
descent in numpy on a bounded sample of labelled documents.

Scoring reads whole texts.  The score of an average is the average of scores, so workers
keep one number for each bucket (vector times layer) instead of its vector.

Null and empty texts, and texts without words, get the class prior of the layer's bias.
Texts of any length are read whole; rows repeat as they come, and equal texts score alike;
other columns are ignored; without labels the score is 0.5; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import forget, remembered

BUCKETS = 1 << 18
DIM = 12
#: Labelled documents learned from, at most, and distinct features of one that are: its most frequent.
SAMPLE, FEATURES = 1_500, 1 << 14
#: Words that a worker remembers at most; beyond it, it starts anew.
MEMO = 1 << 18
NGRAMS = (3, 4, 5)
SAME = 0  # the bucket of a repeated word


def word_buckets(word: str) -> list[int]:
    marked = f"<{word}>".encode()
    size, crc = len(marked), zlib.crc32
    grams = [crc(marked[i : i + n]) % (BUCKETS - 1) + 1 for n in NGRAMS for i in range(size - n + 1)]
    return [*grams, crc(marked) % (BUCKETS - 1) + 1]


def pair_buckets(hashes: np.ndarray) -> np.ndarray:
    left, right = hashes[:-1], hashes[1:]
    both = (left * np.uint64(0x9E3779B97F4A7C15)) ^ (right * np.uint64(0xC2B2AE3D27D4EB4F))
    both = (both ^ (both >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.where(left == right, SAME, (both >> np.uint64(33)).astype(np.int64) % (BUCKETS - 1) + 1)


class Words(dict):
    """word -> row of the tables of hashes, summed scores and feature counts, within a bounded memo."""

    def __init__(self, scores: np.ndarray, memo: int = MEMO):
        super().__init__()
        self.scores, self.memo = scores, memo
        self._empty()

    def _empty(self) -> None:
        self.clear()
        self.hash, self.sum, self.count = np.zeros(4096, np.uint64), np.zeros(4096), np.zeros(4096, np.int64)

    def __missing__(self, word: str) -> int:
        row = len(self)
        if row == len(self.hash):
            self.hash, self.sum, self.count = (np.concatenate([a, np.zeros_like(a)]) for a in (self.hash, self.sum, self.count))
        own = word_buckets(word)
        data = word.encode()
        self.hash[row] = zlib.crc32(data) << 32 | zlib.crc32(data[::-1])
        self.sum[row], self.count[row] = self.scores[own].sum(), len(own)
        self[word] = row
        return row

    def logit(self, text: str) -> float:
        """Average score of the text's features."""
        words = text.split()
        if not words:
            return 0.0
        if len(self) > self.memo:
            self._empty()
        rows = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        pairs = pair_buckets(self.hash[rows])
        return float(self.sum[rows].sum() + self.scores[pairs].sum()) / float(self.count[rows].sum() + len(pairs))


def text_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, counts) of a whole text."""
    words = text.split()
    if not words:
        return np.zeros(0, np.int64), np.zeros(0)
    known: dict[str, int] = {}
    rows = np.array([known.setdefault(w, len(known)) for w in words])
    times = np.bincount(rows)
    sets = [word_buckets(w) for w in known]
    hashes = np.array([zlib.crc32(d) << 32 | zlib.crc32(d[::-1]) for d in (w.encode() for w in known)], np.uint64)
    buckets = np.concatenate([np.array([b for s in sets for b in s], np.int64), pair_buckets(hashes[rows])])
    weight = np.concatenate([np.repeat(times, [len(s) for s in sets]), np.ones(len(words) - 1, np.int64)])
    own, where = np.unique(buckets, return_inverse=True)
    return own, np.bincount(where, weight)


@dataclass
class Model:
    vectors: np.ndarray  # buckets x dim
    layer: np.ndarray  # dim x classes
    bias: np.ndarray

    def scores(self) -> np.ndarray:
        """Of each bucket, for class 1 against class 0."""
        return (self.vectors @ (self.layer[:, 1] - self.layer[:, 0])).astype(np.float32)

    def offset(self) -> float:
        return float(self.bias[1] - self.bias[0])


#: Vectors of an average move by so many times their share of it.
BACK = 30.0


def train(examples: list[tuple[int, np.ndarray, np.ndarray]], epochs: int = 5, rate: float = 0.4, seed: int = 0) -> Model:
    """Stochastic gradient descent on (class, buckets, counts), the rate falling to 0."""
    rng = np.random.default_rng(seed)
    model = Model(rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)), np.zeros((DIM, 2)), np.zeros(2))
    done, total = 0, max(1, epochs * len(examples))
    for _ in range(epochs):
        for i in rng.permutation(len(examples)):
            label, buckets, counts = examples[i]
            now = rate * (1 - done / total)
            done += 1
            share = counts.astype(np.float64) / max(1.0, float(counts.sum()))
            mean = share @ model.vectors[buckets]
            z = mean @ model.layer + model.bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1
            back = model.layer @ p
            model.layer -= now * np.outer(mean, p)
            model.bias -= 0.1 * now * p
            model.vectors[buckets] -= (now * BACK * share)[:, None] * back
    return model


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from (doc_id, text) and (doc_id, label 0 or 1): the ``sample`` labelled documents of smallest hash.

    A document is one row: of labels that share a doc_id the least counts, of rows that share one the text of smallest hash.
    What comes to the driver is thus ``sample`` rows of at most FEATURES features.
    """
    one = labels.where("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.min("label").cast("int").alias("label"))
    chosen = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")  # at most ``sample`` rows of two numbers

    def run(batches):
        for b in batches:
            made = []
            for x in b.column(1).to_pylist():
                own, counts = text_features(x)
                often = np.sort(np.argsort(-counts, kind="stable")[:FEATURES])
                made.append((own[often].astype("<i4").tobytes(), counts[often].astype("<f4").tobytes()))
            yield pa.RecordBatch.from_arrays([b.column(2), b.column(0), b.column(3), pa.array([x for x, _ in made], pa.binary()), pa.array([y for _, y in made], pa.binary())], ["label", "doc_id", "place", "buckets", "counts"])

    found = texts.select(F.col("doc_id").cast("long"), "text", "label", F.xxhash64("text").alias("place")).mapInArrow(run, "label int, doc_id long, place long, buckets binary, counts binary")
    rows = found.groupBy("doc_id", "label").agg(F.min_by(F.struct("buckets", "counts"), "place").alias("own")).select("doc_id", "label", "own.*").toArrow()
    order = np.argsort(rows["doc_id"].to_numpy())  # the same on every run
    numbers = lambda c, i, kind: np.frombuffer(rows[c][i].as_buffer(), kind)  # noqa: E731  where Arrow holds them
    model = train([(rows["label"][i].as_py(), numbers("buckets", i, "<i4"), numbers("counts", i, "<f4")) for i in order])
    del rows
    forget()  # the driver keeps the model alone
    return model


def score(docs: DataFrame, model: Model, text: Column) -> Column:
    """The probability of class 1 for each whole text."""
    shipped = docs.sparkSession.sparkContext.broadcast(model.scores())  # BUCKETS numbers
    offset, key = model.offset(), zlib.crc32(model.scores().tobytes())

    @F.arrow_udf("double")
    def logit(texts: pa.Array) -> pa.Array:
        words = remembered(("words", key), lambda: Words(shipped.value))
        return pa.array([words.logit(x.as_py() or "") for x in texts], pa.float64())

    return 1 / (1 + F.exp(-(logit(text) + F.lit(offset))))


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def quality_model(docs: DataFrame, labels: DataFrame) -> Model:
    return fit(docs, labels.where(~is_held_out(F.col("doc_id"))).select("doc_id", F.col("quality").alias("label")))


def quality_scores(docs: DataFrame, labels: DataFrame, least: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs."""
    scored = docs.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), score(docs, quality_model(docs, labels), F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= least).cast("int"))
