"""Operator 9: stupid-backoff language-model scores of every document under all the others.

Documents are dealt to buckets.  A bucket explodes its texts to n-grams (orders 1 to 3, and
the empty one, whose count is the number of words) and sums them by hash; those sums go,
packed in blocks, to the count table's partitions (ranges of the hash).  A partition adds up
its blocks and answers each with what stands outside its bucket.  Joined with the bucket's
exploded n-grams again, that gives every count, and scores are summed per document.

A document's own n-grams are taken off the counts, so a text is judged by the rest of the
corpus.  With c the counts left, a word scores c(abw) / c(ab); where that is 0,
BACKOFF * c(bw) / c(b), then BACKOFF**2 * c(w) / N, and an unknown word as half a word.
The first words of a text start at the order that they have.

Words are runs other than white space, A-Z in lower case.  Null texts and texts without words
get n_words 0, log_score 0 and no mean.  Rows that repeat are documents of their own.  An
n-gram has one entry for each bucket, however frequent; hashes have 64 bits.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.llm.common import Rolling, forget, mixed, text_bytes, text_slices

BACKOFF = 0.4
BUCKET_BYTES, PARTITION_BYTES = 12 << 20, 12 << 20
STEP = 0xD6E8FEB86659FD93
#: Bits of a hash that a block stores as they are; those above go as steps.
LOW = 40
#: The empty n-gram; all others are above it, and 0 stands for no n-gram.
EMPTY = 1


def word_hashes(column) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, n + 1 bounds of each text's words) of an Arrow string array without nulls."""
    hashes, bounds = [], [np.zeros(1, np.int64)]
    for _, part in text_slices(column):
        data, offsets = text_bytes(part)
        n = len(data)
        low = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
        ink = ~((data == 32) | ((data >= 9) & (data <= 13)))
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        starts = np.nonzero(ink & (edge[:n] | ~np.concatenate([[False], ink])[:n]))[0]
        ends = np.nonzero(ink & (edge[1:] | ~np.concatenate([ink, [False]])[1:]))[0] + 1
        with np.errstate(over="ignore"):
            hashes.append(mixed(Rolling(low).at(starts, ends)))
        bounds.append(np.searchsorted(starts, offsets)[1:] + bounds[-1][-1])
    return np.concatenate([*hashes, np.zeros(0, np.uint64)]), np.concatenate(bounds)


def grams(words: np.ndarray, bounds: np.ndarray, order: int) -> np.ndarray:
    """The n-gram that ends at each word, 0 where the text has too few words before; each order has hashes of its own."""
    out = np.zeros(len(words), np.uint64)
    n = max(0, len(words) - order + 1)
    with np.errstate(over="ignore"):
        made = np.full(n, order, np.uint64)
        for j in range(order):
            made += words[j : j + n] * np.uint64(pow(STEP, j + 1, 1 << 64))
        out[order - 1 :][:n] = np.maximum(mixed(made), np.uint64(EMPTY + 1))
    for k in range(order - 1):
        first = bounds[:-1] + k
        out[first[first < bounds[1:]]] = 0
    return out


def table_of(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes, counts) of all n-grams of a bucket."""
    every = np.concatenate([g[g != 0] for g in (grams(words, bounds, k) for k in (1, 2, 3))])
    every.sort()
    first = np.nonzero(np.concatenate([[True], every[1:] != every[:-1]]))[0] if len(every) else np.zeros(0, np.int64)
    hashes, counts = every[first], np.diff(np.append(first, len(every)))
    return np.insert(hashes, 0, np.uint64(EMPTY)), np.insert(counts, 0, len(words))


def cuts(hashes: np.ndarray, parts: int) -> list[int]:
    """Where each partition begins in sorted hashes, and where the last one ends."""
    least = np.array([-(-(p << 64) // parts) for p in range(parts)], np.uint64)
    return [*np.searchsorted(hashes, least).tolist(), len(hashes)]


def pack_small(values: np.ndarray) -> bytes:
    """Whole numbers of which most are small: one byte each, compressed; those of 255 and over by place."""
    large = np.nonzero(values >= 255)[0]
    small = zlib.compress(np.minimum(values, 255).astype(np.uint8).tobytes(), 1)
    return np.array([len(small), len(large)], "<u4").tobytes() + small + large.astype("<u4").tobytes() + values[large].astype("<i8").tobytes()


def unpack_small(data: bytes, at: int) -> tuple[np.ndarray, int]:
    """(values, where they end)."""
    size, large = np.frombuffer(data, "<u4", 2, at).tolist()
    at += 8
    values = np.frombuffer(zlib.decompress(data[at : at + size]), np.uint8).astype(np.int64)
    place = np.frombuffer(data, "<u4", large, at + size)
    values[place] = np.frombuffer(data, "<i8", large, at + size + 4 * large)
    return values, at + size + 12 * large


def pack_block(hashes: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted hashes: steps of the high bits and LOW low bits each; then the counts."""
    high = np.diff((hashes >> np.uint64(LOW)).astype(np.int64), prepend=0)
    low = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : LOW // 8]
    return pack_small(high) + pack_small(counts) + low.tobytes()


def unpack_block(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    high, at = unpack_small(data, 0)
    counts, at = unpack_small(data, at)
    low = np.zeros((len(high), 8), np.uint8)
    low[:, : LOW // 8] = np.frombuffer(data, np.uint8, LOW // 8 * len(high), at).reshape(-1, LOW // 8)
    return (np.cumsum(high).astype(np.uint64) << np.uint64(LOW)) | low.view("<u8").ravel().astype(np.uint64), counts


def pack_answer(outside: np.ndarray) -> bytes:
    """Counts in the order of the block that asked: a bit for each that is not 0, then those."""
    hit = outside != 0
    return pack_small(outside[hit]) + np.packbits(hit).tobytes()


def unpack_answer(data: bytes, n: int) -> np.ndarray:
    values, at = unpack_small(data, 0)
    out = np.zeros(n, np.int64)
    out[np.unpackbits(np.frombuffer(data, np.uint8, -1, at), count=n).astype(bool)] = values
    return out


def own_counts(docs: np.ndarray, index: np.ndarray) -> np.ndarray:
    """How often the document of each entry has that n-gram."""
    key = docs.astype(np.int64) << 32 | index
    order = np.argsort(key, kind="stable")
    sorted_ = key[order]
    first = np.nonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))[0] if len(key) else np.zeros(0, np.int64)
    times = np.diff(np.append(first, len(key)))
    out = np.empty(len(key), np.int64)
    out[order] = np.repeat(times, times)
    return out


def document_scores(words: np.ndarray, bounds: np.ndarray, hashes: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Sum of log scores of each text, from the sorted hashes and corpus counts of the bucket's n-grams."""
    n = len(words)
    docs = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    place = np.arange(n) - bounds[:-1][docs]
    left = []  # counts of the n-gram that ends at each word, without the document's own
    for order in (1, 2, 3):
        gram = grams(words, bounds, order)
        has = np.nonzero(gram)[0]
        index = np.searchsorted(hashes, gram[has])
        count = np.zeros(n, np.int64)
        count[has] = totals[index] - own_counts(docs[has], index)
        left.append(count)
    one, two, three = left
    before = lambda x: np.concatenate([[0], x[:-1]])  # noqa: E731  of the n-gram that ends one word earlier
    all_words = totals[np.searchsorted(hashes, np.uint64(EMPTY))] - np.diff(bounds)[docs]
    steps = np.minimum(place, 2)  # orders that the word could back off from
    by_three, by_two = (three > 0) & (place >= 2), (two > 0) & (place >= 1)
    score = np.maximum(one, 0.5) / np.maximum(all_words, 1) * BACKOFF**steps
    score = np.where(by_two, two / np.maximum(before(one), 1) * np.where(place >= 2, BACKOFF, 1.0), score)
    score = np.where(by_three, three / np.maximum(before(two), 1), score)
    return np.bincount(docs, np.log(score), minlength=len(bounds) - 1)


@F.arrow_udf(T.BinaryType())
def squeezed(texts: pa.Array) -> pa.Array:
    """Texts as they are shuffled: about half their bytes."""
    pack = zstandard.ZstdCompressor(level=3).compress
    return pa.array([pack(x.encode()) for x in texts.to_pylist()], pa.binary())


def opened(column) -> pa.Array:
    unpack = zstandard.ZstdDecompressor().decompress
    return pa.array([unpack(x).decode() for x in column.to_pylist()], pa.string())


def lm_scores(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, log_score, mean_log_score of every row of docs (doc_id, text)."""
    text = F.coalesce("text", F.lit(""))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets, parts = max(1, -(-total // BUCKET_BYTES)), max(1, -(-total // PARTITION_BYTES))
    bucket = F.pmod(F.xxhash64(F.col("doc_id").cast("long"), text), F.lit(buckets)).cast("int")
    dealt = docs.select(F.col("doc_id").cast("long"), squeezed(text).alias("text"), bucket.alias("bucket"))

    def count(rows: pa.Table) -> pa.Table:
        forget()
        hashes, counts = table_of(*word_hashes(opened(rows["text"])))
        at = cuts(hashes, parts)
        used = [p for p in range(parts) if at[p] < at[p + 1]]
        blocks = [pack_block(hashes[at[p] : at[p + 1]], counts[at[p] : at[p + 1]]) for p in used]
        bucket = rows["bucket"][0].as_py()
        return pa.table({"bucket": pa.array([bucket] * len(used), pa.int32()), "part": pa.array(used, pa.int32()), "block": pa.array(blocks, pa.binary())})

    def answer(rows: pa.Table) -> pa.Table:
        blocks = [unpack_block(x) for x in rows["block"].to_pylist()]
        hashes, counts = np.concatenate([h for h, _ in blocks]), np.concatenate([c for _, c in blocks])
        order = np.argsort(hashes, kind="stable")
        new = np.concatenate([[True], hashes[order[1:]] != hashes[order[:-1]]])
        first = np.nonzero(new)[0]
        sums = np.add.reduceat(counts[order], first)
        outside = np.empty(len(order), np.int64)
        outside[order] = np.repeat(sums, np.diff(np.append(first, len(order))))
        outside -= counts
        made, at = [], 0
        for h, _ in blocks:
            made.append(pack_answer(outside[at : at + len(h)]))
            at += len(h)
        return pa.table({"bucket": rows["bucket"], "part": rows["part"], "block": pa.array(made, pa.binary())})

    def score(rows: pa.Table, answers: pa.Table) -> pa.Table:
        words, bounds = word_hashes(opened(rows["text"]))
        hashes, totals = table_of(words, bounds)
        at = cuts(hashes, parts)
        for part, block in zip(answers["part"].to_pylist(), answers["block"].to_pylist(), strict=True):
            totals[at[part] : at[part + 1]] += unpack_answer(block, at[part + 1] - at[part])
        n = np.diff(bounds)
        sums = document_scores(words, bounds, hashes, totals)
        with np.errstate(invalid="ignore"):
            mean = pa.array(sums / n, pa.float64(), mask=n == 0)
        return pa.table({"doc_id": rows["doc_id"], "n_words": pa.array(n, pa.int64()), "log_score": pa.array(sums + 0.0, pa.float64()), "mean_log_score": mean})

    blocks = dealt.groupBy("bucket").applyInArrow(count, "bucket int, part int, block binary")
    answers = blocks.groupBy("part").applyInArrow(answer, "bucket int, part int, block binary")
    return dealt.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(score, "doc_id long, n_words long, log_score double, mean_log_score double")
