"""Operator 5: removal of repeated byte strings by depth-limited most-significant-digit passes.

A suffix is ordered through ``threshold`` bytes only; what is equal so far forms the
repeated windows.  Passes refine groups of suffixes by further digits and drop those that
stand alone.  Digits are hashes of many bytes, and the first passes move one row
for a run of neighbouring suffixes in place of one for each:

1. digit one is the least hash of the ``threshold - span + 1``-byte strings inside the
   window.  Neighbouring windows that get it from the same place form a run; equal windows
   have equal digits, so runs whose digit stands alone are done.  Runs of one text that agree
   in digit and context and whose bytes touch are one row, so a line or a byte that a text
   repeats without end is no hot digit.
2. digit two is the run's whole context.  Runs that agree in it are repeated windows, all of
   them.
3. only where contexts of one digit differ, windows are taken one by one, a context once,
   with a hash of the whole window as the last digit.

Every window of every text takes part; matches never cross documents; copies, also in rows
that repeat, remove each other.  Null texts are empty.  Texts shorter than the threshold keep
every byte.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.llm.common import Rolling, cut, forget, mixed, text_bytes, text_slices, written

THRESHOLD, SPAN = 400, 128
SALT = 0xA24BAED4963EE407


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each window of ``width`` values."""
    n = len(values) - width + 1
    rows = -(-len(values) // width)
    padded = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    grid = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def window_runs(column, threshold: int = THRESHOLD, span: int = SPAN):
    """(row, start, windows, digit one, digit two) of all runs of an Arrow string array without nulls; start is in the row's bytes."""
    data, offsets = text_bytes(column)
    if len(data) < threshold:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    with np.errstate(over="ignore"):
        rolling = Rolling(data)
        grams = mixed(rolling.windows(threshold - span + 1))
        least = sliding_least(grams, span)
        n = len(least)
        fits = np.zeros(len(data) + 1, np.int8)  # windows that stay within their text
        long = np.diff(offsets) >= threshold
        np.add.at(fits, offsets[:-1][long], 1)
        np.add.at(fits, offsets[1:][long] - threshold + 1, -1)
        fits = np.cumsum(fits[:n], dtype=np.int8).astype(bool)
        new = np.ones(n, bool)
        new[1:] = (least[1:] != least[:-1]) | (grams[: n - 1] == least[:-1]) | ~fits[:-1]
        new[np.minimum(offsets[:-1], n - 1)] = True
        starts = np.nonzero(new & fits)[0]
        stop = np.ones(n + 1, bool)
        stop[:n] = new | ~fits
        stops = np.nonzero(stop)[0]
        ends = stops[np.searchsorted(stops, starts, side="right")]
        context = mixed(rolling.at(starts, ends - 1 + threshold) + (ends - starts).astype(np.uint64) * np.uint64(SALT))
    rows = np.searchsorted(offsets, starts, side="right") - 1
    return rows, starts - offsets[rows], ends - starts, least[starts], context


def joined_runs(rows: np.ndarray, starts: np.ndarray, windows: np.ndarray, digit: np.ndarray, context: np.ndarray, threshold: int = THRESHOLD) -> tuple[np.ndarray, ...]:
    """(row, start, windows, reach, digit, context): of the runs of a row that agree in digit and context and whose bytes touch the first, with the windows from its start to the last one's end.  Runs come by row and start."""
    order = np.lexsort((context, rows))
    rows, starts, windows, digit, context = (x[order] for x in (rows, starts, windows, digit, context))
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (context[1:] != context[:-1]) | (digit[1:] != digit[:-1]) | (starts[1:] > starts[:-1] + windows[:-1] - 1 + threshold)
    first = np.nonzero(new)[0]
    last = np.append(first[1:], len(rows))[: len(first)] - 1
    return rows[first], starts[first], windows[first], starts[last] + windows[last] - starts[first], digit[first], context[first]


def runs(docs: DataFrame, threshold: int = THRESHOLD, span: int = SPAN) -> DataFrame:
    """key, start, windows, reach, digit, context of all runs of (key, text), those that joined_runs joins as one row; its reach is then over its windows."""

    def run(batches):
        forget()
        for b in batches:
            keys = b.column(0).to_numpy()
            for first, part in text_slices(b.column(1)):
                rows, starts, windows, reach, digit, context = joined_runs(*window_runs(part, threshold, span), threshold)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[first + rows]), pa.array(starts.astype(np.int32)), pa.array(windows.astype(np.int32)), pa.array(reach.astype(np.int32)), pa.array(digit.view(np.int64)), pa.array(context.view(np.int64))],
                    ["key", "start", "windows", "reach", "digit", "context"],
                )
        forget()

    return docs.select("key", "text").mapInArrow(run, "key long, start int, windows int, reach int, digit long, context long")


def single_windows(texts: DataFrame, threshold: int) -> DataFrame:
    """key, start, window, digit of every window of the listed runs of (key, own, text, runs)."""

    def run(batches):
        for b in batches:
            columns = ([], [], [], [])
            for key, text, own in zip(b.column(0).to_pylist(), b.column(2).cast(pa.large_binary()).to_pylist(), b.column(3).to_pylist(), strict=True):
                with np.errstate(over="ignore"):
                    at = np.concatenate([np.arange(x["start"], x["start"] + x["windows"]) for x in own])
                    window = mixed(Rolling(np.frombuffer(text, np.uint8)).at(at, at + threshold))
                digit = np.concatenate([np.full(x["windows"], x["digit"] & 0x7FFFFFFF, np.int32) for x in own])
                for column, x in zip(columns, (np.full(len(at), key), at.astype(np.int32), window.view(np.int64), digit), strict=True):
                    column.append(x)
            if columns[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in columns], ["key", "start", "window", "digit"])

    return texts.mapInArrow(run, "key long, start int, window long, digit int")


def kept_slices(b: pa.RecordBatch, threshold: int):
    """own, n_bytes, n_removed, n_spans, kept_sha256, kept of a batch (key, own, text, runs), in batches of about a megabyte of text: what a task holds doesn't depend on how many rows come together."""
    types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
    for first, part in text_slices(b.column(2)):
        rows = []
        for text, own in zip(part.cast(pa.large_binary()).to_pylist(), b.column(3).slice(first, len(part)).to_pylist(), strict=True):
            n = len(text)
            if not own:
                rows.append((n, 0, 0, hashlib.sha256(text).hexdigest(), text))
                continue
            step = np.zeros(n + 1, np.int64)
            starts = np.array([x["start"] for x in own])
            np.add.at(step, starts, 1)
            np.add.at(step, starts + np.array([x["windows"] for x in own]) - 1 + threshold, -1)
            gone = np.cumsum(step[:n]) > 0
            rest = np.frombuffer(text, np.uint8)[~gone].tobytes()
            spans = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1]))
            rows.append((n, n - len(rest), spans, hashlib.sha256(rest).hexdigest(), rest))
        yield pa.RecordBatch.from_arrays([b.column(1).slice(first, len(part)), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(types))], ["own", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def kept(texts: DataFrame, threshold: int) -> DataFrame:
    """own, n_bytes, n_removed, n_spans, kept_sha256, kept of (key, own, text, runs); runs may be null."""

    def run(batches):
        forget()
        for b in batches:
            yield from kept_slices(b, threshold)
        b = None
        forget()

    schema = T.StructType([texts.schema["own"], *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept_sha256", T.StringType()), T.StructField("kept", T.BinaryType())])
    return texts.mapInArrow(run, schema)


def without_repeats(docs: DataFrame, threshold: int = THRESHOLD, span: int = SPAN, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns to carry, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes) of every row of docs (doc_id, text)."""
    text = F.coalesce("text", F.lit(""))
    docs = docs.select(F.xxhash64("doc_id", text, *carry).alias("key"), F.struct(F.col("doc_id").cast("long").alias("doc_id"), *carry).alias("own"), text.alias("text"))
    every = runs(docs, threshold, span)
    times = F.sum(F.expr("if(reach > windows, 2, 1)")).alias("n")  # joined runs are two at least
    several = every.groupBy("digit").agg(times, F.min("context").alias("least"), F.max("context").alias("most")).where("n > 1").select("digit", (F.col("least") != F.col("most")).alias("differ"))
    found = written(every.join(several, "digit"), "runs")

    alike, differ = found.where("not differ"), found.where("differ")
    one = F.min(F.struct("key", "start", "windows")).alias("one")
    contexts = cut(differ.groupBy("digit", "context").agg(times, one))
    alike = alike.unionByName(differ.join(contexts.where("n > 1").select("digit", "context"), ["digit", "context"])).select("key", "start", F.col("reach").alias("windows"))

    asked = contexts.select("one.*", "digit").groupBy("key").agg(F.collect_list(F.struct("start", "windows", "digit")).alias("runs"))
    single = single_windows(docs.join(asked, "key").select("key", "own", "text", "runs"), threshold)
    often = single.groupBy("window", "digit").count().where("count > 1").select("window", "digit")
    single = single.join(often, ["window", "digit"]).select("key", "start", F.lit(1).alias("windows"))

    gone = alike.unionByName(single).groupBy("key").agg(F.collect_set(F.struct("start", "windows")).alias("runs"))
    return kept(docs.join(gone, "key", "left").select("key", "own", "text", "runs"), threshold).select("own.*", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")
