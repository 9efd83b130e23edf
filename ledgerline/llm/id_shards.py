"""Operator 7: raw token-id shards with minimal perfect hash indexes.

Documents in ascending key order are range-partitioned; each partition writes one shard:

- ``shard-N.bin``: the ids of its documents one after another, 2 or 4 bytes each;
- ``shard-N.end``: the end of each document in ids, 8 bytes each.

Tables beside them: ``runs`` (one row for each run of equal keys of a shard) and ``shards`` (one
row for each shard).  The index is dealt by a hash of the key to files of bounded size:

- ``index-N.mph``: a JSON line of sizes, then the arrays named there: the bits of a minimal
  perfect hash of the distinct keys and, in each of its slots, a 32-bit fingerprint and
  the place of its entries: shard, first row there, number of rows.

A key's file and slot are found by hashing and its ids by two seeks, so that access takes
constant time whatever is stored; a key that is not there is refused by its fingerprint.
A key of very many rows has one entry for each shard that holds some.

Files are written under a name of the attempt and then renamed, so a repeated task leaves
the same files.  Null texts are empty documents (the end id alone); texts of any length are
encoded in blocks.  Rows that share a key stand one after another, and the index gives all
of them; rows without a key come first and are read in order only.  Other columns
are ignored.  An empty table writes no shard.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.byte_bpe import part_ids
from ledgerline.llm.common import mixed, scratch

RUNS = "shard int, doc_id long, row long, n_rows long, n_tokens long"
#: Bytes of ids that a task reads or writes at once.
BLOCK = 8 << 20
#: Distinct keys of an index file, about.
INDEX_KEYS = 1 << 20
#: Rows of one key that a task reads at once.
SPAN_ROWS = 1 << 16


def hashed(keys: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mixed(keys.astype(np.int64).view(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 1) % (1 << 64)))


class PerfectHash:
    """Distinct 64-bit keys -> 0..n-1 without gaps.

    Level by level, keys that fall alone on a bit of the level own it; the others go on to
    the next level.  A key's slot is the number of set bits before its own.
    """

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels  # of booleans
        self.before = np.cumsum([0] + [int(x.sum()) for x in levels])
        self.ranks = [np.cumsum(x) - 1 for x in levels]

    @staticmethod
    def build(keys: np.ndarray) -> PerfectHash:
        levels, seed = [], 0
        while len(keys):
            size = -(-2 * len(keys) // 8) * 8
            place = (hashed(keys, seed) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(place, minlength=size) == 1
            levels.append(alone)
            keys, seed = keys[~alone[place]], seed + 1
        return PerfectHash(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """-1 for keys that own no bit; a strange key may get any slot."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for seed, bits in enumerate(self.levels):
            place = (hashed(keys[left], seed) % np.uint64(len(bits))).astype(np.int64)
            own = bits[place]
            out[left[own]] = self.before[seed] + self.ranks[seed][place[own]]
            left = left[~own]
        return out


class KeyIndex:
    """Distinct keys -> entries (shard, row, rows) by a minimal perfect hash."""

    FINGER = 1 << 20  # the fingerprint's seed
    KEPT = ("fingers", "first", "shard", "row", "rows")

    def __init__(self, keys: np.ndarray, shard: np.ndarray, row: np.ndarray, rows: np.ndarray):
        """Entries; those of one key stand together."""
        start = np.nonzero(np.diff(keys, prepend=keys[0] - 1 if len(keys) else 0))[0]
        own = keys[start]
        self.hash = PerfectHash.build(own)
        slots = self.hash.slots(own)
        order = np.empty(len(own), np.int64)
        order[slots] = np.arange(len(own))
        counts = np.diff(np.append(start, len(keys)))[order]
        self.fingers = hashed(own[order], self.FINGER).astype("<u4")
        self.first = np.concatenate([[0], np.cumsum(counts)]).astype("<i8")
        entry = np.repeat(start[order] - self.first[:-1], counts) + np.arange(len(keys))
        self.shard, self.row, self.rows = shard[entry].astype("<i4"), row[entry].astype("<i8"), rows[entry].astype("<i8")

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of the keys, entry) of all entries of the keys that are there."""
        slots = self.hash.slots(keys)
        own = np.nonzero(slots >= 0)[0]
        own = own[self.fingers[slots[own]] == hashed(keys[own], self.FINGER).astype(np.uint32)]
        first, counts = self.first[slots[own]], self.first[slots[own] + 1] - self.first[slots[own]]
        ahead = np.cumsum(counts) - counts
        return np.repeat(own, counts), np.repeat(first - ahead, counts) + np.arange(counts.sum())

    def to_bytes(self) -> bytes:
        arrays = [(n, getattr(self, n)) for n in self.KEPT] + [("level", np.packbits(x)) for x in self.hash.levels]
        head = json.dumps([[n, a.dtype.str, len(a)] for n, a in arrays]).encode() + b"\n"
        return head + b"".join(a.tobytes() for _, a in arrays)

    @staticmethod
    def from_bytes(data: bytes) -> KeyIndex:
        at = data.index(b"\n") + 1
        found: dict[str, list[np.ndarray]] = {}
        for name, kind, n in json.loads(data[:at]):
            size = n * np.dtype(kind).itemsize
            found.setdefault(name, []).append(np.frombuffer(data[at : at + size], kind))
            at += size
        index = KeyIndex.__new__(KeyIndex)
        for name in KeyIndex.KEPT:
            setattr(index, name, found[name][0])
        index.hash = PerfectHash([np.unpackbits(x).astype(bool) for x in found.get("level", [])])
        return index


def file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def index_file(key, files: int):
    """The index file of a key column."""
    return F.pmod(F.xxhash64(key), F.lit(files)).cast("int")


def write_ids(docs: DataFrame, tokenizer_path: str, path: str, end: int = 2) -> DataFrame:
    """Encode (doc_id, text), write shards in ascending doc_id order and their index below ``path``; returns the table of shards read back."""
    import pyarrow as pa

    def run(batches):
        ids, store, base = None, None, None
        name, attempt = f"shard-{(shard := TaskContext.get().partitionId()):06d}", f"attempt-{TaskContext.get().taskAttemptId()}"
        outs, buffer, rows, total = {}, bytearray(), 0, 0
        for b in batches:
            if not b.num_rows:
                continue
            if not outs:
                ids, (store, base) = part_ids(tokenizer_path), file_system(path)
                store.create_dir(base, recursive=True)
                outs = {kind: store.open_output_stream(f"{base}/{name}.{kind}.{attempt}") for kind in ("bin", "end")}
            sizes = np.zeros(b.num_rows, np.int64)
            for k, own in enumerate(ids.of_many((x.as_py() for x in b.column(1)), end)):
                sizes[k] = len(own)
                buffer += own.tobytes()
                if len(buffer) >= BLOCK:
                    outs["bin"].write(bytes(buffer))
                    buffer.clear()
            outs["end"].write((total + np.cumsum(sizes)).astype("<i8").tobytes())
            keys, known = b.column(0).fill_null(0).to_numpy(), b.column(0).is_valid().to_numpy(zero_copy_only=False)
            first = np.nonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (known[1:] != known[:-1])]))[0]
            n = len(first)
            columns = [pa.array(np.full(n, shard, np.int32)), pa.array(keys[first], pa.int64(), mask=~known[first]), pa.array(rows + first), pa.array(np.diff(np.append(first, len(keys)))), pa.array(np.add.reduceat(sizes, first))]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in RUNS.split(", ")])
            rows, total = rows + len(keys), total + int(sizes.sum())
        if outs:
            outs["bin"].write(bytes(buffer))
        for kind, out in outs.items():
            out.close()
            store.move(f"{base}/{name}.{kind}.{attempt}", f"{base}/{name}.{kind}")

    def build(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("doc_id", "ascending"), ("shard", "ascending")])
        index = KeyIndex(*(rows[c].to_numpy() for c in ("doc_id", "shard", "row", "n_rows")))
        store, base = file_system(path)
        number, attempt = rows["file"][0].as_py(), f"attempt-{TaskContext.get().taskAttemptId()}"
        with store.open_output_stream(f"{base}/index-{number:06d}.mph.{attempt}") as f:
            f.write(index.to_bytes())
        store.move(f"{base}/index-{number:06d}.mph.{attempt}", f"{base}/index-{number:06d}.mph")
        return pa.table({"file": pa.array([number], pa.int32()), "n_keys": pa.array([len(index.fingers)], pa.int64())})

    # Rows of one key are told apart by their place, so that ranges can divide them.
    order = [F.col("doc_id").asc_nulls_first(), F.monotonically_increasing_id()]
    ordered = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(*order).sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    spark = docs.sparkSession
    ordered.mapInArrow(run, RUNS).write.parquet(f"{path}/runs")
    runs = spark.read.parquet(f"{path}/runs")
    runs.groupBy("shard").agg(F.sum("n_rows").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).write.parquet(f"{path}/shards")
    keyed = runs.where("doc_id is not null")
    files = max(1, -(-keyed.count() // INDEX_KEYS))
    entries = keyed.groupBy("doc_id", "shard").agg(F.min("row").alias("row"), F.sum("n_rows").alias("n_rows")).withColumn("file", index_file("doc_id", files))
    entries.groupBy("file").applyInArrow(build, "file int, n_keys long").withColumn("files", F.lit(files)).write.parquet(f"{path}/index")
    return spark.read.parquet(f"{path}/shards")


def located(keys: DataFrame, path: str) -> DataFrame:
    """doc_id, shard, row, n_rows of what is stored for each distinct key of ``keys`` (doc_id), by the index files; strange keys give no rows."""
    import pyarrow as pa

    asked = keys.select(F.col("doc_id").cast("long")).where("doc_id is not null").distinct()
    one = keys.sparkSession.read.parquet(f"{path}/index").select("files").first()
    if one is None:
        return asked.where("false").selectExpr("doc_id", "0 as shard", "0L as row", "0L as n_rows")

    def run(batches):
        store, base = file_system(path)
        opened: dict[int, KeyIndex | None] = {}
        for b in batches:
            files, own = b.column(1).to_numpy(), b.column(0).to_numpy()
            for file in np.unique(files):
                if file not in opened:
                    name = f"{base}/index-{file:06d}.mph"
                    opened = {file: KeyIndex.from_bytes(store.open_input_file(name).read()) if store.get_file_info(name).is_file else None}
                index, asked = opened[file], own[files == file]
                if index is None:
                    continue
                which, entry = index.find(asked)
                yield pa.RecordBatch.from_arrays([pa.array(asked[which]), pa.array(index.shard[entry]), pa.array(index.row[entry]), pa.array(index.rows[entry])], ["doc_id", "shard", "row", "n_rows"])

    return asked.select("doc_id", index_file("doc_id", one["files"]).alias("file")).repartition("file").sortWithinPartitions("file").mapInArrow(run, "doc_id long, shard int, row long, n_rows long")


def stored(places: DataFrame, path: str, width: int, schema: str, make) -> DataFrame:
    """What ``make(doc_ids, begins, ends, payloads)`` gives (Arrow arrays as in the schema) for the rows at ``places`` (doc_id, shard, row, n_rows).

    ``begins`` and ``ends`` are in ids of the shard; neighbouring rows are read together, in blocks.
    """
    import pyarrow as pa

    names = ["shard", *(c.split()[0] for c in schema.split(", "))]

    def clusters(row, n_rows):
        """(entries from, to) that stand close together."""
        end = np.maximum.accumulate(row + n_rows)
        cut = np.nonzero(row[1:] - end[:-1] > 512)[0] + 1
        return zip([0, *cut.tolist()], [*cut.tolist(), len(row)], strict=True)

    def run(batches):
        store, base = file_system(path)
        for b in batches:
            keys, shards, rows, counts = (b.column(i) for i in range(4))
            shards, rows, counts = (c.to_numpy() for c in (shards, rows, counts))
            for shard in np.unique(shards):
                own = np.nonzero(shards == shard)[0]
                own = own[np.argsort(rows[own], kind="stable")]
                with store.open_input_file(f"{base}/shard-{shard:06d}.end") as marks, store.open_input_file(f"{base}/shard-{shard:06d}.bin") as payload:
                    for a, z in clusters(rows[own], counts[own]):
                        at = own[a:z]
                        low, high = int(rows[at[0]]), int((rows[at] + counts[at]).max())
                        marks.seek(max(0, low - 1) * 8)
                        ends = np.frombuffer(marks.read((high - max(0, low - 1)) * 8), "<i8")
                        ends = ends if low else np.concatenate([[0], ends])
                        which = np.repeat(at, counts[at])
                        row = np.repeat(rows[at] - (np.cumsum(counts[at]) - counts[at]), counts[at]) + np.arange(len(which)) - low
                        begins, ends = ends[row], ends[row + 1]
                        first = 0
                        while first < len(which):
                            last = max(first + 1, int(np.searchsorted(ends, begins[first] + BLOCK // width, side="right")))
                            payload.seek(int(begins[first]) * width)
                            data = np.frombuffer(payload.read(int(ends[last - 1] - begins[first]) * width), f"<u{width}")
                            own_ids = [data[s:e] for s, e in zip((begins[first:last] - begins[first]).tolist(), (ends[first:last] - begins[first]).tolist(), strict=True)]
                            made = make(keys.take(pa.array(which[first:last])), begins[first:last], ends[first:last], own_ids)
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(last - first, shard, np.int32)), *made], names)
                            first = last

    # A key of many rows is read by many tasks.
    step = F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n_rows") / SPAN_ROWS) - 1)).alias("step")
    spans = places.select("doc_id", "shard", "row", "n_rows", step).select("doc_id", "shard", (F.col("row") + F.col("step") * SPAN_ROWS).alias("row"), F.least(F.lit(SPAN_ROWS), F.col("n_rows") - F.col("step") * SPAN_ROWS).alias("n_rows"))
    dealt = spans.repartition("shard", F.floor(F.col("row") / SPAN_ROWS)).sortWithinPartitions("shard", "row")
    return dealt.mapInArrow(run, f"shard int, {schema}")


def read_ids(docs: DataFrame, path: str, width: int = 2) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every row stored for the keys of ``docs`` (doc_id), found through the index, and of rows without a key."""
    import pyarrow as pa

    def digest(keys, begins, ends, ids):
        return keys, pa.array(begins), pa.array(ends - begins), pa.array([zlib.crc32(x.astype("<u4")) for x in ids], pa.int64())

    spark = docs.sparkSession
    unkeyed = spark.read.parquet(f"{path}/runs").where("doc_id is null").select("doc_id", "shard", "row", "n_rows")
    found = stored(located(docs, path).unionByName(unkeyed), path, width, "doc_id long, begin long, n_tokens long, ids_crc32 long", digest)
    ahead = F.sum("n_tokens").over(Window.orderBy("shard")) - F.col("n_tokens")  # one row a shard
    shards = spark.read.parquet(f"{path}/shards").select("shard", ahead.alias("ahead"))
    return found.join(shards, "shard").select("doc_id", (F.col("ahead") + F.col("begin")).alias("start"), "n_tokens", "ids_crc32")


def fetch_ids(keys: DataFrame, path: str, width: int = 2) -> DataFrame:
    """doc_id, ids array<long> of each row stored for each distinct key of ``keys`` (doc_id); strange keys give no rows."""
    import pyarrow as pa

    def lists(keys, begins, ends, ids):
        values = np.concatenate([*ids, np.zeros(0, np.int64)]).astype(np.int64)
        return keys, pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(ends - begins)]), pa.int32()), pa.array(values))

    return stored(located(keys, path), path, width, "doc_id long, ids array<long>", lists).select("doc_id", "ids")


def stored_ids(docs: DataFrame, tokenizer_path: str, end: int = 2) -> DataFrame:
    """Write the shards to the shared folder and return what is read back from them, each key through the index."""
    path = scratch(docs.sparkSession, "ids")
    write_ids(docs, tokenizer_path, path, end)
    return read_ids(docs, path, part_ids(tokenizer_path).kind.itemsize)
