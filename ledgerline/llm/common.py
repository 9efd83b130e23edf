"""Shared helpers: table access, the cluster's shared folder, and vectorised byte hashing."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])

#: 64-bit odd multipliers of the rolling hash and of its finaliser (fixed values).
BASE = 0x9E3779B97F4A7C15
MIX_1 = 0xBF58476D1CE4E5B9
MIX_2 = 0x94D049BB133111EB


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package when the driver runs from another folder."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(":") if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = ":".join([ROOT, *paths])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.getCheckpointDir():
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write a table in the shared folder and read it again: lineage ends there."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """checkpoint() in the shared folder; Spark's cleaner drops the files with the last reference."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


#: Bits of a key filter (2 MB of masks): its size never depends on the data.
FILTER_BITS = 1 << 24


def key_bits(keys: DataFrame) -> DataFrame:
    """A filter of the 64-bit hashes in column key: at most FILTER_BITS / 64 rows (word_, mask_)."""
    bit = F.pmod("key", F.lit(FILTER_BITS))
    masks = keys.select(F.shiftright(bit, 6).alias("word_"), F.expr(f"shiftleft(1L, cast(pmod(key, {FILTER_BITS}) & 63 as int))").alias("bit_"))
    return cut(masks.groupBy("word_").agg(F.bit_or("bit_").alias("mask_")))


def may_hold(df: DataFrame, bits: DataFrame) -> DataFrame:
    """df with column held_: false only if its key is not among those of the filter.  Nothing is shuffled."""
    word = F.shiftright(F.pmod("key", F.lit(FILTER_BITS)), 6)
    hit = F.expr(f"coalesce(mask_ & shiftleft(1L, cast(pmod(key, {FILTER_BITS}) & 63 as int)), 0L) <> 0")
    return df.join(F.broadcast(bits), word == F.col("word_"), "left").withColumn("held_", hit).drop("word_", "mask_")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch path, on whichever file system it lies."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def whole_text(df: DataFrame) -> DataFrame:
    """(doc_id, text) with null texts as empty ones; other columns, whatever their names, go."""
    return df.select(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


_memo: dict = {}


def remembered(key, make):
    """A worker's one memo, kept between tasks; another key drops it, so that operators in turn don't add up."""
    if key not in _memo:
        forget()
        _memo[key] = make()
    return _memo[key]


def forget() -> None:
    """Drop the worker's memo and give freed memory back to the system: before and after tasks that have no memo, since idle workers keep what they have."""
    import ctypes

    import pyarrow as pa

    _memo.clear()
    Rolling._up = Rolling._down = np.ones(1, np.uint64)
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the C library, where it has one
    if trim:
        trim(0)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes (in place)."""
    h ^= h >> np.uint64(30)
    h *= np.uint64(MIX_1)
    h ^= h >> np.uint64(27)
    h *= np.uint64(MIX_2)
    h ^= h >> np.uint64(31)
    return h


class Rolling:
    """Hashes of any substrings of one byte array, from prefix sums modulo 2**64.

    ``at(start, length)`` is equal for equal strings wherever they stand.
    """

    _up = _down = np.ones(1, np.uint64)

    def __init__(self, data: np.ndarray):
        n = len(data) + 1
        if len(Rolling._up) < n:
            size = max(n, 1 << 20)
            with np.errstate(over="ignore"):
                Rolling._up = np.concatenate([np.ones(1, np.uint64), np.multiply.accumulate(np.full(size, BASE, np.uint64))])
                Rolling._down = np.concatenate([np.ones(1, np.uint64), np.multiply.accumulate(np.full(size, pow(BASE, -1, 1 << 64), np.uint64))])
        self.sums = np.zeros(n, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * Rolling._up[: n - 1], out=self.sums[1:])

    def windows(self, length: int) -> np.ndarray:
        """The hash of every window of this length, not yet mixed."""
        n = len(self.sums) - length
        if n <= 0:
            return np.zeros(0, np.uint64)
        return (self.sums[length:] - self.sums[:n]) * Rolling._down[:n]

    def at(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * Rolling._down[start]


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of an Arrow string array (no nulls) and its n + 1 offsets, without a copy."""
    import pyarrow as pa

    if hasattr(column, "combine_chunks"):
        column = column.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def text_slices(column, most: int = 1 << 20):
    """Arrow string array -> slices (first row, array) of about so many bytes; one long text is a slice of its own."""
    if hasattr(column, "combine_chunks"):
        column = column.combine_chunks()
    _, offsets = text_bytes(column)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1)
        yield first, column.slice(first, last - first)
        first = last
