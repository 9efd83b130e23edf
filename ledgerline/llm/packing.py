"""Operator 6: bounded-space online best-fit packing.

Documents become token pieces of at most ``size``.  Pieces are dealt to batches by a hash of
their row's number, so that rows that repeat spread too, and every batch is packed in one
pass, piece by piece, with at most ``open_bins`` open bins.  Free spaces of open bins are
the bits of one integer: the best fit for a piece is the lowest set bit at or above its
length.  If a new bin would exceed the bound, the fullest closes.  Pieces arrive in hash
order, but within each ``open_bins`` of them the longest come first: so many pieces can't
open more bins than may be open, and the short ones that follow fill them.

Null texts are empty documents (one piece, the end id alone); repeated rows are packed
as often as they come; ties of length keep the arrival order; texts of any length are encoded
in blocks; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.byte_bpe import part_ids
from ledgerline.llm.common import cut

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def cut_lengths(n: int, size: int) -> list[int]:
    """Lengths of the pieces of n tokens: the first may be shorter."""
    first = n % size or size
    return [first] + [size] * ((n - first) // size)


def token_pieces(docs: DataFrame, tokenizer_path: str, size: int = 2048, end: int = 0) -> DataFrame:
    """One row for each piece of each document's ids, the end id included."""
    import pyarrow as pa

    def run(batches):
        ids = part_ids(tokenizer_path)
        for b in batches:
            rows = ([], [], [], [], [])
            for doc_id, own in zip(b.column(0).to_pylist(), ids.of_many((x.as_py() for x in b.column(1)), end), strict=True):
                all_ids, start = own.astype("<u4"), 0
                for k, n in enumerate(cut_lengths(len(all_ids), size)):
                    for column, x in zip(rows, (doc_id, k, start, n, zlib.crc32(all_ids[start : start + n].tobytes())), strict=True):
                        column.append(x)
                    start += n
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)


def best_fit(lengths: Iterable[int], size: int, open_bins: int) -> tuple[list[int], list[int]]:
    """(bin of each piece, offset of each piece)."""
    bins, offsets = [], []
    spaces, by_space, n_open, new = 0, {}, 0, 0
    for n in lengths:
        fits = spaces >> n
        if fits:
            free = n + ((fits & -fits).bit_length() - 1)
            stack = by_space[free]
            chosen = stack.pop()
            if not stack:
                spaces ^= 1 << free
            n_open -= 1
        else:
            free, chosen, new = size, new, new + 1
        bins.append(chosen)
        offsets.append(size - free)
        free -= n
        if free:
            if n_open == open_bins:  # the fullest closes: it has the least space
                least = (spaces & -spaces).bit_length() - 1
                if least < free:
                    by_space[least].pop()
                    if not by_space[least]:
                        spaces ^= 1 << least
                    n_open -= 1
                else:
                    continue  # the bin at hand is the fullest
            by_space.setdefault(free, []).append(chosen)
            spaces |= 1 << free
            n_open += 1
    return bins, offsets


def arrival(hashes: np.ndarray, lengths: np.ndarray, window: int) -> np.ndarray:
    """The order in which pieces come: by hash, and within each ``window`` of them the longest first."""
    by_hash = np.argsort(hashes, kind="stable")
    return by_hash[np.lexsort((-lengths[by_hash], np.arange(len(by_hash)) // window))]


def pack(pieces: DataFrame, size: int = 2048, open_bins: int = 4096, batch_bins: int = 1 << 17, batch_pieces: int = 1 << 20) -> DataFrame:
    """Give every piece a sequence_id and its offset there.

    A batch is to fill ``batch_bins`` sequences, with about ``batch_pieces`` pieces at most.
    """
    pieces = cut(pieces)
    tokens, rows = pieces.agg(F.sum("length"), F.count("*")).first()
    batches = max(1, -(-(tokens or 0) // (size * batch_bins)), -(-rows // batch_pieces))
    number = F.xxhash64(F.monotonically_increasing_id())  # of a row of the checkpoint: the same whenever it is read
    dealt = pieces.withColumn("order", number).withColumn("batch", F.pmod("order", F.lit(batches)))

    def run(pdf):
        pdf = pdf.iloc[arrival(pdf["order"].to_numpy(np.int64), pdf["length"].to_numpy(np.int64), open_bins)]
        bins, offsets = best_fit(pdf["length"].tolist(), size, open_bins)
        first = int(pdf["batch"].iloc[0]) << 32 if len(pdf) else 0
        return pdf.assign(sequence_id=np.array(bins, np.int64) + first, offset=np.array(offsets, np.int64))[[c.split()[0] for c in PACKED.split(", ")]]

    return dealt.groupBy("batch").applyInPandas(run, PACKED)
