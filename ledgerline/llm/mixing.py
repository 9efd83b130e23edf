"""Operator 11: mixing sources to target weights, with DataFrame functions alone.

A document's size is its number of words.  Sources, in code point order with null last,
weigh 1, 2, 3 and so on in turn and share all words by weight; no target exceeds `most`
times its source's size, and what a source cannot take goes to the others by weight.  Every
document gets a random but fixed key, a hash; each source is sorted by key and its sizes
summed in that order; the mix takes whole epochs of the source while they fit, then the
documents before the exact budget, and of the document on the cut the words before it.

Keys are evenly spread, so ranges of equal width hold about RANGE rows, whatever the source
holds; a range is summed by itself and ranges are added up in blocks of BLOCK.  Rows equal
in source, doc_id and size are counted before they are shuffled and dealt in runs of at most
RUN with keys of their own, so that no key is hot.  Sources are joined by a salted key.

Null and empty texts have size 0 and take 0.  Rows without source are a source of their
own, the last.  Repeated rows are documents of their own.  A source of size 0 has target 0;
an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import cut, written

#: Weights in turn, and how often a document may be taken.
WEIGHTS, MOST = (1, 2, 3), 3
#: Rows of a range of keys, ranges of a block, equal rows with one key, salts of a source.
RANGE, BLOCK, RUN, SALTS = 1 << 10, 1 << 10, 1 << 10, 32

WORD = r"[^\x20\x09-\x0D]+"


def before(sum_of: str, order: list[Column], *by: str) -> Column:
    """The sum over the earlier rows of the window."""
    return F.coalesce(F.sum(sum_of).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def running(df: DataFrame, order: list[Column], **sums: str) -> DataFrame:
    """df with, for each name, the sum of a column over all earlier rows: ranges are dealt out, summed, and their sums added."""
    dealt = cut(df.repartitionByRange(*order).withColumn("range_", F.spark_partition_id()))
    totals = dealt.groupBy("range_").agg(*(F.sum(c).alias(f"{name}_") for name, c in sums.items()))  # a row for each partition
    starts = totals.select("range_", *(before(f"{name}_", [F.col("range_")]).alias(f"{name}_") for name in sums))
    own = dealt.select("*", *(before(c, order, "range_").alias(name) for name, c in sums.items()))
    return own.join(F.broadcast(starts), "range_").select(*df.columns, *((F.col(name) + F.col(f"{name}_")).alias(name) for name in sums))


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, size, no_source, name (of the source), copies: rows that are equal in all of these are counted."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select("doc_id", size.alias("size"), F.col("source").isNull().alias("no_source"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("name"))
    return rows.groupBy("no_source", "name", "doc_id", "size").agg(F.count("*").alias("copies"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """no_source, name, source_size, runs (with a key each), target of each source."""
    runs = F.ceil(F.col("copies") / RUN).cast("long")
    of = sizes.groupBy("no_source", "name").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"), F.sum(runs).alias("runs")).withColumn("one", F.lit(1))
    ranked = running(of, [F.col("no_source"), F.col("name")], place="one")
    at = F.pmod(F.col("place"), F.lit(len(weights))).cast("int")
    capped = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), at + 1).cast("long")).withColumn("cap", most * F.col("source_size"))
    full = F.col("cap") / F.col("weight")
    # In order of the level at which each source is full: it is full if its level gives out less than there is.
    filled = cut(running(capped.withColumn("full", full), [F.col("full"), F.col("no_source"), F.col("name")], caps="cap", weights="weight"))
    words, all_weights = filled.agg(F.sum("source_size"), F.sum("weight")).first()
    is_full = F.col("caps") + F.col("full") * (F.lit(all_weights or 0) - F.col("weights")) < F.lit(words or 0)
    judged = filled.withColumn("is_full", is_full)
    given, served = judged.where("is_full").agg(F.coalesce(F.sum("cap"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    level = F.lit(float((words or 0) - given)) / F.lit(max(1, (all_weights or 0) - served))
    target = F.when(F.col("is_full"), F.col("cap").cast("double")).otherwise(level * F.col("weight"))
    return judged.select("no_source", "name", "source_size", "runs", target.alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """doc_id, source, size, source_size, target (of its source), taken (words, repeats counted)."""
    sizes = written(sized(docs), "sizes")
    targets = cut(source_targets(sizes, weights, most))
    salted = targets.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    run = F.posexplode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / RUN))).alias("run", "run_")
    rows = sizes.select("*", run, F.pmod(F.xxhash64("doc_id", "size"), F.lit(SALTS)).cast("int").alias("salt")).drop("run_")
    rows = rows.withColumn("copies", F.least(F.lit(RUN), F.col("copies") - F.col("run") * RUN)).withColumn("words", F.col("size") * F.col("copies"))
    key = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.col("size"), F.col("run")))
    # The range of a key: its first bits, as many as make ranges of about RANGE rows.
    bits = F.greatest(F.lit(0), F.ceil(F.log2(F.col("runs") / RANGE))).cast("int")
    place = F.expr("shiftright(cast(conv(substring(key, 1, 12), 16, 10) as long), 48 - bits)")
    keyed = rows.withColumn("key", key).join(salted, ["no_source", "name", "salt"]).withColumn("bits", bits).withColumn("range", place)
    source, order = ("no_source", "name"), [F.col("key"), F.col("doc_id"), F.col("size")]
    summed = keyed.withColumn("start_in", before("words", order, *source, "range"))
    ranges = cut(keyed.groupBy(*source, "range").agg(F.sum("words").alias("held"))).withColumn("block", F.floor(F.col("range") / BLOCK))
    blocks = ranges.groupBy(*source, "block").agg(F.sum("held").alias("held"))
    blocks = blocks.select(*source, "block", before("held", [F.col("block")], *source).alias("block_start"))
    starts = ranges.withColumn("range_start", before("held", [F.col("range")], *source, "block")).join(blocks, [*source, "block"])
    starts = starts.select(*source, "range", (F.col("range_start") + F.col("block_start")).alias("start_of"))
    placed = summed.join(starts, [*source, "range"])
    single = placed.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    start = F.col("start_of") + F.col("start_in") + F.col("copy") * F.col("size")
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.expr("cast(round(target) as long) div source_size")).otherwise(F.lit(0))
    rest = budget - epochs * F.col("source_size")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - start))
    return single.select("doc_id", F.when(~F.col("no_source"), F.col("name")).alias("source"), "size", "source_size", "target", taken.cast("long").alias("taken"))
