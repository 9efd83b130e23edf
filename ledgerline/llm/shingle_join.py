"""Operator 8: Jaccard join of word n-gram sets, rare-first prefix filtering.

Sets are the distinct 5-word shingles of whole texts, as 64-bit hashes.  Documents of equal
sets are one node.  Shingles are ordered rare first: those found frequent come last, by
their counts; the others stand in hash order.  The order decides the work, never the
result.  Linked sets share a shingle of their prefixes; nodes meet on those shingles only, and on
one of those that the very same nodes share.

Pairs go through length, positional and suffix filters and are verified once, on texts:

1. along chains and hubs of each prefix shingle, each node with its most shared partners;
2. on each shingle, one node of each component that the links of 1 leave, with one of the
   largest component there and one of the next; of those, each component's likeliest;
3. every pair of one shingle whose nodes are still in different components and that the
   filters admit: first the likeliest of each two components, then all that are left.

Links within a component would not change it, so large groups of copies are never expanded
into pairs.  In step 3 the pairs of a shingle are only looked at where its nodes are together;
those that pass go on.  Parities of the numbers of shingles by their low bits are there too: as many as differ, so many
shingles at least are not common.  Of many nodes the high bits of all shingles are there as well, which
bound what two of them share by little more than it is.  Groups of more than GROUP nodes are divided into chunks, two
of which meet in a task.

Null texts and texts without words have an empty set: no links, their own component.  Rows
that repeat are copies.  A row without doc_id takes part, and its component is the
smallest doc_id linked with it (null if there is none).  An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.llm.common import Rolling, forget, key_bits, may_hold, mixed, remove, scratch, text_bytes, text_slices, written

WORDS = 5
#: Shingles ordered last at most (the order only); the count among so many shingles of a task that makes one known as frequent.
FREQUENT, SEEN, SLICE = 1 << 16, 4, 600_000
STEP = 0xD6E8FEB86659FD93
#: Bins of a set's histogram, at least and at most; between them there is about one for each shingle.
BINS, MOST_BINS = 256, 4_096
#: Bits of a set's parities, at least and at most.
SHORTEST, LONGEST = 64, 1 << 16
#: Nodes of a shingle that one task takes together (two chunks of this size), and those beyond which 16 bits of every shingle of a node go along.
GROUP, LARGE = 2_048, 64
#: Shingles of the largest set whose high bits go along, and sets of them that a task keeps.
SKETCHED, HELD = 2_048, 1_024
#: Pairs that a task looks at together, and those whose histograms it compares together.
PAIRS, COMPARED = 1 << 19, 1 << 14
#: Pairs that a component tries in step 2.
TRIES = 2


def shingle_sets(column) -> list[np.ndarray]:
    """Arrow string array (no nulls) -> the sorted distinct shingle hashes of each text."""
    data, offsets = text_bytes(column)
    low = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    ink = ~((data == 32) | ((data >= 9) & (data <= 13)))
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], ink[:-1]]) if n else ink
    after = np.concatenate([ink[1:], [False]]) if n else ink
    starts = np.nonzero(ink & (~before | edge[:n]))[0]
    ends = np.nonzero(ink & (~after | edge[1:]))[0] + 1
    with np.errstate(over="ignore"):
        words = mixed(Rolling(low).at(starts, ends))
        grams = np.zeros(max(0, len(words) - WORDS + 1), np.uint64)
        for j in range(WORDS):
            grams += words[j : j + len(grams)] * np.uint64(pow(STEP, j + 1, 1 << 64))
        mixed(grams)
        bounds = np.searchsorted(starts, offsets)
        sets = []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b - a >= WORDS:
                own = np.sort(grams[a : b - WORDS + 1])
                sets.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
            elif b > a:
                few = (words[a:b] * np.array([pow(STEP, j + 1, 1 << 64) for j in range(b - a)], np.uint64)).sum(dtype=np.uint64)
                sets.append(mixed(np.array([few + np.uint64(b - a)], np.uint64)))
            else:
                sets.append(np.zeros(0, np.uint64))
    return sets


def signature(own: np.ndarray) -> int:
    """One 64-bit number for a set."""
    with np.errstate(over="ignore"):
        return int(mixed(np.array([(mixed(own.copy()) * (own | np.uint64(1))).sum(dtype=np.uint64) + np.uint64(len(own))], np.uint64)).view(np.int64)[0])


def needed(n: int, m: int) -> int:
    """The least intersection of linked sets of n and m: 100 i >= 75 (n + m - i)."""
    return -(-3 * (n + m) // 7)


def prefix_length(n: int) -> int:
    """Of a set that meets smaller or equal ones."""
    return n - -(-3 * n // 4) + 1 if n else 0


def histogram(own: np.ndarray) -> bytes:
    """Numbers of shingles by the highest bits of their hashes, 255 at most."""
    bits = min(MOST_BINS, max(BINS, len(own))).bit_length() - 1
    return np.bincount((own >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits).clip(max=255).astype(np.uint8).tobytes()


def least_sum(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """No more shingles are common than this, by histograms in rows; a full bin (255) may hold any number."""
    bound = np.minimum(x, y).sum(axis=1, dtype=np.int64)
    return np.where((x.max(axis=1, initial=0) == 255) | (y.max(axis=1, initial=0) == 255), np.iinfo(np.int64).max // 8, bound)


def parities(own: np.ndarray) -> bytes:
    """Whether the number of shingles with the same low bits is odd, a bit for each value of them; as many bits as shingles at least, to LONGEST."""
    bits = min(LONGEST, max(SHORTEST, 1 << max(0, len(own) - 1).bit_length()))
    return np.packbits(np.bincount((own & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1, bitorder="little").tobytes()


def least_apart(marks: list[bytes | None], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """No fewer shingles are in just one of the sets i and j than this, by their parities; none are known of None.  The longer of two is folded to the shorter."""
    size = np.array([len(x) if x is not None else 0 for x in marks], np.int64)
    flat, start = np.frombuffer(b"".join(x for x in marks if x is not None), np.uint8), np.cumsum(size) - size
    out = np.zeros(len(i), np.int64)
    both = np.stack([size[i], size[j]], axis=1)
    for pair in np.unique(both, axis=0):
        if not (least := int(pair.min())):
            continue
        every = np.nonzero((both == pair).all(axis=1))[0]
        for at in range(0, len(every), step := max(1, COMPARED * 64 // int(pair.max()))):
            own = every[at : at + step]
            rows = [np.bitwise_xor.reduce(flat[start[k[own], None] + np.arange(n)].reshape(len(own), -1, least), axis=1) for k, n in zip((i, j), pair, strict=True)]
            out[own] = np.bitwise_count(rows[0] ^ rows[1]).sum(axis=1, dtype=np.int64)
    return out


def high_bits(own: np.ndarray) -> np.ndarray:
    """The distinct highest 16 bits of a set's hashes."""
    return np.unique((own >> np.uint64(48)).astype("<u2"))


def survey(docs: DataFrame) -> DataFrame:
    """One row for each text (key, doc_id, n, sig, marks), and rows (hash, seen) of shingles found often in a slice."""

    names = ["key", "doc_id", "n", "sig", "marks", "hash", "seen"]

    def often(sets):
        found, times = np.unique(np.concatenate(sets), return_counts=True)
        found, times = found[times >= SEEN], times[times >= SEEN]
        missing = [pa.nulls(len(found), t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary())]
        return pa.RecordBatch.from_arrays([*missing, pa.array(found.view(np.int64)), pa.array(times.astype(np.int64))], names)

    def run(batches):
        forget()
        waiting, size = [], 0
        for b in batches:
            for first, part in text_slices(b.column(2)):
                sets = shingle_sets(part)
                k = len(sets)
                marks = [parities(s) for s in sets]
                own = [pa.array([len(s) for s in sets], pa.int32()), pa.array([signature(s) for s in sets], pa.int64()), pa.array(marks, pa.binary())]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, k), b.column(1).slice(first, k), *own, pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64())], names)
                waiting += sets
                size += sum(map(len, sets))
                if size >= SLICE:
                    yield often(waiting)
                    waiting, size = [], 0
        if waiting:
            yield often(waiting)
        waiting = sets = marks = own = None
        forget()

    return docs.mapInArrow(run, "key long, doc_id long, n int, sig long, marks binary, hash long, seen long")


def rare_first(own: np.ndarray, frequent: np.ndarray, order: np.ndarray) -> np.ndarray:
    """A sorted set in the global order; frequent: sorted hashes, order: their places."""
    if not len(frequent):
        return own
    at = np.minimum(np.searchsorted(frequent, own), len(frequent) - 1)
    often = frequent[at] == own
    if not often.any():
        return own
    late = own[often]
    return np.concatenate([own[~often], late[np.argsort(order[at[often]], kind="stable")]])


def prefixes(docs: DataFrame, frequent: DataFrame) -> DataFrame:
    """hash, sig, n, pos of the prefix shingles of each distinct set of a slice."""
    rows = frequent.toArrow()  # FREQUENT rows at most
    hashes, counts = rows["hash"].to_numpy().view(np.uint64), rows["seen"].to_numpy()
    by_hash = np.argsort(hashes)
    place = np.empty(len(hashes), np.int64)
    place[np.lexsort((hashes, counts))] = np.arange(len(hashes))
    shipped = docs.sparkSession.sparkContext.broadcast((hashes[by_hash], place[by_hash]))
    rows = hashes = counts = None
    forget()

    def run(batches):
        forget()
        frequent, order = shipped.value
        for b in batches:
            for _, part in text_slices(b.column(0)):
                known = {signature(s): s for s in shingle_sets(part) if len(s)}
                if not known:
                    continue
                parts = [rare_first(s, frequent, order)[: prefix_length(len(s))] for s in known.values()]
                sizes = [len(p) for p in parts]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate(parts).view(np.int64)),
                        pa.array(np.repeat(np.array(list(known), np.int64), sizes)),
                        pa.array(np.repeat(np.array([len(s) for s in known.values()], np.int32), sizes)),
                        pa.array(np.concatenate([np.arange(n, dtype=np.int32) for n in sizes])),
                    ],
                    ["hash", "sig", "n", "pos"],
                )
        known = parts = None
        forget()

    return docs.select("text").mapInArrow(run, "hash long, sig long, n int, pos int")


def length_filter(n, m):
    """Column: sets of n >= m can be linked."""
    return 4 * m >= 3 * n


def meetings(met: DataFrame) -> DataFrame:
    """hash, sig, n, pos, times of the shingles (hash, sig, n, pos) that several nodes have; those of the very same nodes are one.

    A passage gives many shingles of the same nodes, which would meet on each of them.  One of those shingles stands for all,
    each node with its first position among them: pairs meet there, and no filter by position admits less than on
    the first shingle that they share.
    """
    w = Window.partitionBy("hash")
    several = met.withColumns({"least": F.min("sig").over(w), "most": F.max("sig").over(w)}).where("least <> most").select("hash", "sig", "n", "pos").dropDuplicates(["hash", "sig"])
    nodes = several.withColumns({"met": F.count("*").over(w), "one": F.bit_xor(F.xxhash64("sig")).over(w), "other": F.bit_xor(F.xxhash64("sig", F.lit(1))).over(w)})
    alike = nodes.groupBy("one", "other", "met", "sig").agg(F.min("hash").alias("hash"), F.min("n").alias("n"), F.min("pos").alias("pos"), F.count("*").alias("times"))
    return alike.select("hash", "sig", "n", "pos", "times")


def chains_and_hubs(live: DataFrame) -> DataFrame:
    """a, b (a before b in size, then sig): on each shingle a node meets the one before it and the smallest; of those, the one it shares most shingles with, of either kind."""
    w = Window.partitionBy("hash").orderBy("n", "sig")
    met = live.select("sig", "n", "times", F.lag(F.struct("sig", "n")).over(w).alias("chain"), F.first(F.struct("sig", "n")).over(w).alias("hub"))
    kinds = F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("chain").alias("to")), F.struct(F.lit(1).alias("kind"), F.col("hub").alias("to"))))
    pairs = met.where("chain is not null").select("sig", "n", "times", kinds.alias("k")).select(F.col("k.to.sig").alias("a"), F.col("sig").alias("b"), "times", F.col("k.kind").alias("kind"), F.col("k.to.n").alias("na"), F.col("n").alias("nb"))
    pairs = pairs.where((F.col("a") != F.col("b")) & length_filter(F.col("nb"), F.col("na")))
    shared = pairs.groupBy("b", "kind", "a", "na", "nb").agg(F.sum("times").alias("count"))
    best = F.row_number().over(Window.partitionBy("b", "kind").orderBy(F.desc("count"), "a"))
    return shared.withColumn("best", best).where("best = 1").select("a", "b", "na", "nb").distinct()


def apart(live: DataFrame, comps: DataFrame) -> DataFrame:
    """hash, sig, n, pos, comp, met (nodes of the shingle) of the shingles whose nodes are in different components (sig, comp)."""
    w = Window.partitionBy("hash")
    own = live.join(comps, "sig", "left").withColumn("comp", F.coalesce("comp", "sig"))
    return own.withColumns({"least": F.min("comp").over(w), "most": F.max("comp").over(w), "met": F.count("*").over(w)}).where("least <> most").drop("least", "most")


def partnered(own: DataFrame) -> DataFrame:
    """The rows (hash, sig, n, pos, ...) that the length and positional filters admit with the nearest set of their shingle, or that are near enough in size to one that may be the smaller of a pair: no pair is left out."""
    w = Window.partitionBy("hash").orderBy("n", "sig")
    smaller = F.expr("7 * pos <= n")  # the prefix that is enough against sets not smaller
    larger, before = F.lead("n").over(w), F.last(F.when(smaller, F.col("n")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = own.withColumns({"larger": larger, "before": before})
    ahead = smaller & length_filter(F.col("larger"), F.col("n")) & F.expr("7 * (n - pos) >= 3 * (n + larger)")
    return rows.where(F.coalesce(ahead, F.lit(False)) | F.coalesce(length_filter(F.col("n"), F.col("before")), F.lit(False))).drop("larger", "before")


def in_order(pairs: DataFrame) -> DataFrame:
    """a, b, na, nb of the distinct pairs of structs x, y (sig, n) that the length filter admits; a is the smaller set, then the smaller sig."""
    a, b = F.least("x", "y"), F.greatest("x", "y")
    rows = pairs.where("x is not null and y is not null").select(a.alias("a"), b.alias("b"))
    return rows.select(F.col("a.sig").alias("a"), F.col("b.sig").alias("b"), F.col("a.n").alias("na"), F.col("b.n").alias("nb")).where((F.col("a") != F.col("b")) & length_filter(F.col("nb"), F.col("na"))).distinct()


def between_components(own: DataFrame) -> DataFrame:
    """a, b, na, nb: on each shingle a node of each component with one of the largest component and one of the next larger."""
    one = F.min_by(F.struct("n", "sig"), F.xxhash64("sig", "hash")).alias("x")
    some = own.groupBy("hash", "comp").agg(F.count("*").alias("size"), one)
    w = Window.partitionBy("hash").orderBy(F.desc("size"), "comp")
    met = some.select("x", F.first("x").over(w).alias("hub"), F.lag("x").over(w).alias("next"))
    return in_order(met.select("x", F.explode(F.array("hub", "next")).alias("y")))


def met_pairs(hashes, cell, role, sig, n, pos, comp, sketches: list[bytes | None], marks: list[bytes | None]) -> np.ndarray:
    """(a, b, na, nb) rows of the pairs of one (hash, cell) that length, positional and suffix filters admit and whose components differ.

    Rows of one (hash, cell) stand together; role 0: only b, 1: only a, 2: either; sketches, marks: high bits and parities of the sets, where they are known.
    """
    first = np.nonzero(np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (cell[1:] != cell[:-1])]))[0]
    size = np.diff(np.append(first, len(hashes)))
    group = np.repeat(np.arange(len(first)), size)
    known = np.array([x is not None for x in sketches])
    flat = np.frombuffer(b"".join(x for x in sketches if x is not None), "<u2")
    held = np.array([len(x) // 2 if x is not None else 0 for x in sketches])
    bins = np.bincount(np.repeat(np.arange(len(held)), held) * BINS + (flat >> 8), minlength=len(held) * BINS).clip(max=255).reshape(-1, BINS).astype(np.uint8)
    lost = n - held  # shingles whose bits another has too
    sets: dict[int, frozenset] = {}

    def common(i: int, j: int) -> int:
        if len(sets) > HELD:
            sets.clear()
        for k in (i, j):
            if k not in sets:
                sets[k] = frozenset(np.frombuffer(sketches[k], "<u2").tolist())
        return len(sets[i] & sets[j])

    left = np.nonzero((role != 0) & (pos <= n - -(-6 * n // 7)))[0]  # the prefix that is enough against sets not smaller
    times = size[group[left]]
    found, at, ends = [], 0, np.cumsum(times)
    while at < len(left):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, side="right")))
        own, k = left[at:to], times[at:to]
        i = np.repeat(own, k)
        j = np.repeat(first[group[own]] - (np.cumsum(k) - k), k) + np.arange(len(i))
        ok = (comp[i] != comp[j]) & (role[j] != 1) & (4 * n[i] >= 3 * n[j]) & ((n[i] < n[j]) | ((n[i] == n[j]) & (sig[i] < sig[j])))
        ok &= 7 * np.minimum(n[i] - pos[i], n[j] - pos[j]) >= 3 * (n[i] + n[j])
        i, j = i[ok], j[ok]
        ok = 7 * least_apart(marks, i, j) <= n[i] + n[j]
        i, j = i[ok], j[ok]
        sure = ~(known[i] & known[j])
        for c in range(0, len(i), COMPARED):
            x, y = i[c : c + COMPARED], j[c : c + COMPARED]
            spare = np.minimum(lost[x], lost[y])
            near = 7 * (least_sum(bins[x], bins[y]) + spare) >= 3 * (n[x] + n[y])
            for k in np.nonzero(near & ~sure[c : c + COMPARED])[0].tolist():
                sure[c + k] = 7 * (common(int(x[k]), int(y[k])) + spare[k]) >= 3 * (n[x[k]] + n[y[k]])
        found.append(np.stack([sig[i[sure]], sig[j[sure]], n[i[sure]], n[j[sure]]], axis=1))
        at = to
    return np.unique(np.concatenate([*found, np.zeros((0, 4), np.int64)]), axis=0)


@F.arrow_udf(T.BinaryType())
def sketched(texts: pa.Array) -> pa.Array:
    forget()
    return pa.array([high_bits(s).tobytes() if len(s) <= SKETCHED else None for _, part in text_slices(texts) for s in shingle_sets(part)], pa.binary())


def across(own: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """a, b, na, nb of all pairs on a shingle that the filters admit and whose components differ; parities of nodes are used where own has them (marks)."""
    own = written(own if "marks" in own.columns else own.withColumn("marks", F.lit(None).cast("binary")), "apart")
    large = own.where(F.col("met") > LARGE)
    keys = written(nodes.select("sig", "key").join(large.select("sig").distinct(), "sig"), "keys")
    near = may_hold(docs.select("key", "text"), key_bits(keys)).where("held_").select("key", sketched("text").alias("few"))
    few = keys.join(near.dropDuplicates(["key"]), "key").select("sig", "few")
    narrow = large.join(few, "sig").unionByName(own.where(F.col("met") <= LARGE).withColumn("few", F.lit(None).cast("binary")))
    chunks = F.ceil(F.col("met") / GROUP).cast("int")
    mine = F.pmod(F.xxhash64("sig"), F.col("chunks")).cast("int")
    every = F.sequence(F.lit(0), F.col("chunks") - 1)
    place = lambda cell, role: F.struct(cell.alias("cell"), F.lit(role).alias("role"))
    halves = F.concat(F.transform(every, lambda k: place(F.col("mine") * F.col("chunks") + k, 1)), F.transform(every, lambda k: place(k * F.col("chunks") + F.col("mine"), 0)))
    rows = narrow.withColumn("chunks", chunks).withColumn("mine", mine).withColumn("place", F.explode(F.when(F.col("chunks") == 1, F.array(place(F.lit(0), 2))).otherwise(halves)))
    dealt = rows.select("hash", "place.cell", "place.role", "sig", "n", "pos", "comp", "few", "marks").repartition("hash", "cell").sortWithinPartitions("hash", "cell")

    def run(batches):
        forget()
        waiting: list[pa.RecordBatch] = []

        def pairs(rows: pa.Table) -> pa.RecordBatch:
            columns = [rows.column(k).to_numpy().astype(np.int64) for k in range(7)]
            out = met_pairs(*columns, rows.column(7).to_pylist(), rows.column(8).to_pylist())
            return pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1]), pa.array(out[:, 2].astype(np.int32)), pa.array(out[:, 3].astype(np.int32))], ["a", "b", "na", "nb"])

        for b in batches:
            key = np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()])
            new = np.nonzero((key[:, 1:] != key[:, :-1]).any(axis=0))[0]
            last = [(w.column(0)[-1].as_py(), w.column(1)[-1].as_py()) for w in waiting[-1:]]
            if last and b.num_rows and last[0] != (int(key[0, 0]), int(key[1, 0])):
                yield pairs(pa.Table.from_batches(waiting))
                waiting = []
            if len(new):
                yield pairs(pa.Table.from_batches([*waiting, b.slice(0, int(new[-1]) + 1)]))
                waiting = [b.slice(int(new[-1]) + 1)]
            elif b.num_rows:
                waiting.append(b)
        if waiting:
            yield pairs(pa.Table.from_batches(waiting))
        waiting = None
        forget()

    return dealt.mapInArrow(run, "a long, b long, na int, nb int").distinct()


@F.arrow_udf(T.LongType())
def bins_in_common(left: pa.Array, right: pa.Array) -> pa.Array:
    forget()
    sizes = np.stack([pc.binary_length(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (left, right)], axis=1)
    out = np.zeros(len(left), np.int64)
    for pair in np.unique(sizes, axis=0):  # the finer histogram is added up to the bins of the other
        own = np.nonzero((sizes == pair).all(axis=1))[0]
        rows = [np.frombuffer(b"".join(c.take(pa.array(own)).to_pylist()), np.uint8).reshape(len(own), pair.min(), -1).sum(axis=2, dtype=np.int64).clip(max=255) for c in (left, right)]
        out[own] = least_sum(*rows)
    return pa.array(out)


@F.arrow_udf(T.LongType())
def bits_apart(left: pa.Array, right: pa.Array) -> pa.Array:
    forget()
    at = np.arange(len(left))
    return pa.array(least_apart([*left.to_pylist(), *right.to_pylist()], at, at + len(left)))


@F.arrow_udf(T.BooleanType())
def linked(left: pa.Array, right: pa.Array) -> pa.Array:
    forget()
    out = []
    for k in range(len(left)):
        a, b = shingle_sets(pa.array([left[k].as_py(), right[k].as_py()], pa.string()))
        out.append(len(np.intersect1d(a, b, assume_unique=True)) >= needed(len(a), len(b)))
    return pa.array(out, pa.bool_())


def bounded(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b, na, nb) that the suffix filter admits, with the keys of their texts and the bound of what they share."""
    side = lambda s: nodes.select(F.col("sig").alias(s), F.col("marks").alias(f"marks_{s}"), F.col("key").alias(f"key_{s}"))
    rows = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("least", bits_apart("marks_a", "marks_b"))
    return rows.where("7 * least <= na + nb").withColumn("bound", F.expr("(na + nb - least) div 2")).select("a", "b", "na", "nb", "key_a", "key_b", "bound")


def verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b, key_a, key_b) that are links, by both texts; a text is there once, however often its row repeats."""
    pairs = written(pairs.select("a", "b", "key_a", "key_b"), "pairs")
    keys = pairs.select(F.explode(F.array("key_a", "key_b")).alias("key")).distinct()
    near = may_hold(docs.select("key", "text"), key_bits(keys)).where("held_").select("key", "text").dropDuplicates(["key"])
    of = lambda s: near.select(F.col("key").alias(f"key_{s}"), F.col("text").alias(f"text_{s}"))
    return pairs.join(of("a"), "key_a").join(of("b"), "key_b").where(linked("text_a", "text_b")).select("a", "b").distinct()


def still_apart(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    """The pairs whose nodes are in different components: with ca < cb."""
    of = lambda s: comps.select(F.col("sig").alias(s), F.col("comp").alias(f"c{s}"))
    rows = pairs.drop("ca", "cb").join(of("a"), "a", "left").join(of("b"), "b", "left")
    x, y = F.coalesce("ca", "a"), F.coalesce("cb", "b")
    return rows.withColumns({"ca": F.least(x, y), "cb": F.greatest(x, y)}).where("ca <> cb")


def components(edges: DataFrame) -> DataFrame:
    """sig, comp (the smallest sig reachable) of every sig of the edges (a, b), by large and small stars.

    Every round leaves either fewer nodes at a distance from their component's least one or, at the end, the
    same edges; the rounds grow with the logarithm of the longest path.
    """
    spark, state, path = edges.sparkSession, None, scratch(edges.sparkSession, "edges")
    edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct().write.parquet(path)
    least = F.min("v").over(Window.partitionBy("u"))
    while True:
        edges = spark.read.schema("u long, v long").parquet(path)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state, old, path = now, path, scratch(spark, "edges")
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.withColumn("m", F.least("u", least)).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = large.withColumn("m", least).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        small.distinct().write.parquet(path)
        remove(spark, old)
    return edges.select(F.col("u").alias("sig"), F.col("v").alias("comp")).unionByName(edges.select(F.col("v").alias("sig"), F.col("v").alias("comp")).distinct())


def keyed(docs: DataFrame) -> DataFrame:
    """key (of the row's id and text), doc_id, text."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.xxhash64("doc_id", text).alias("key"), F.col("doc_id").cast("long"), text.alias("text"))


def joined_by(pairs: DataFrame, docs: DataFrame, comps: DataFrame) -> DataFrame:
    """Components (sig, comp) with those pairs (a, b, ca, cb, key_a, key_b) that are links; ca, cb: the components that a link joins."""
    found = written(verified(pairs.select(F.col("ca").alias("a"), F.col("cb").alias("b"), "key_a", "key_b"), docs), "links")
    if found.isEmpty():
        return comps
    over = components(found)
    moved = comps.join(over.select(F.col("sig").alias("comp"), F.col("comp").alias("top")), "comp", "left").select("sig", F.coalesce("top", "comp").alias("comp"))
    return written(moved.unionByName(over.join(comps, "sig", "left_anti")), "comps")


def joined(docs: DataFrame) -> DataFrame:
    """key, doc_id, n, comp (null for empty sets) of every row of docs (key, doc_id, text)."""
    found = written(survey(docs), "shingles")
    rows = found.where("sig is not null").select("key", "doc_id", "n", "sig", "marks")
    frequent = found.where("hash is not null").groupBy("hash").agg(F.sum("seen").alias("seen")).orderBy(F.desc("seen"), "hash").limit(FREQUENT)
    nodes = rows.where("n > 0").groupBy("sig").agg(F.min_by("key", "key").alias("key"), F.min_by("marks", "key").alias("marks"))

    live = written(meetings(prefixes(docs, frequent)), "live")

    nodes = written(nodes.join(live.select("sig").distinct(), "sig"), "nodes")

    first = written(chains_and_hubs(live), "pairs")
    comps = components(written(verified(bounded(first, nodes), docs), "links"))

    likeliest = lambda by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(F.col("bound") / (F.col("na") + F.col("nb"))), "a", "b"))
    some = still_apart(bounded(between_components(apart(live, comps)).join(first, ["a", "b"], "left_anti"), nodes), comps)
    some = some.withColumn("comp", F.explode(F.array("ca", "cb"))).withColumn("place", likeliest(["comp"])).where(F.col("place") <= TRIES)
    some = written(some.select("a", "b", "ca", "cb", "key_a", "key_b").distinct(), "pairs")
    tried = first.select("a", "b").unionByName(some.select("a", "b"))
    comps = joined_by(some, docs, comps)

    second = written(still_apart(bounded(across(partnered(apart(live, comps)).join(nodes.select("sig", "marks"), "sig"), nodes, docs).join(tried, ["a", "b"], "left_anti"), nodes), comps), "pairs")
    best = written(second.withColumn("place", likeliest(["ca", "cb"])).where("place = 1"), "pairs")
    comps = joined_by(best, docs, comps)
    comps = joined_by(still_apart(second.join(best.select("a", "b"), ["a", "b"], "left_anti"), comps), docs, comps)

    named = rows.select("key", "doc_id", "n", "sig").join(comps, "sig", "left")
    return named.select("key", "doc_id", "n", F.when(F.col("n") > 0, F.coalesce("comp", "sig")).alias("comp"))


def shingle_join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id: one row for each row of docs (doc_id, text)."""
    rows = joined(keyed(docs))
    least = rows.where("comp is not null").groupBy("comp").agg(F.min("doc_id").alias("component"))
    out = rows.join(least, "comp", "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("comp").isNotNull(), F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs (any columns besides doc_id and text) that stay: of each component the one of the smallest doc_id, once; rows without words all stay.

    Only rows that may be copies are shuffled; a key filter lets the others pass.
    """
    rows = written(joined(keyed(docs)).where("comp is not null"), "rows")
    first = F.min_by("key", F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("first")
    copies = rows.groupBy("comp").agg(first, F.count("*").alias("n")).where("n > 1")
    keys = written(rows.join(copies, "comp").select("key", (F.col("key") == F.col("first")).alias("stays_")).distinct(), "keys")
    marked = may_hold(docs.withColumn("key", F.xxhash64("doc_id", F.coalesce("text", F.lit("")))), key_bits(keys))
    place = F.row_number().over(Window.partitionBy("key").orderBy("doc_id"))
    some = marked.where("held_").join(keys, "key", "left").withColumn("place_", F.when(F.col("stays_"), place))
    some = some.where("stays_ is null or (stays_ and place_ = 1)")
    return marked.where("not held_").select(docs.columns).unionByName(some.select(docs.columns))
