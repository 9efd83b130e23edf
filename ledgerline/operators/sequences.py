"""Ordered operators within a game: pairs of neighbours, running values, runs and windows of rows.

All of them share one partitioning (the game), so Spark shuffles once for a chain of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def within(keys: list[str], order: list) -> Window:
    return Window.partitionBy(*keys).orderBy(*order)


def transitions(df: DataFrame, keys: list[str], order: list, values: list[str], horizon: int = 1) -> DataFrame:
    """Each row with the row ``horizon`` later in its game: prev and next structs of the values."""
    state = F.struct(*values)
    return df.withColumn("prev", state).withColumn("next", F.lead(state, horizon).over(within(keys, order))).where("next is not null")


def horizons(df: DataFrame, keys: list[str], order: list, values: list[str], steps: tuple[int, ...] = (1, 4, 16)) -> DataFrame:
    """transitions at several horizons at once, with a column horizon."""
    w = within(keys, order)
    state = F.struct(*values)
    after = F.array(*(F.struct(F.lit(h).cast("long").alias("horizon"), F.lead(state, h).over(w).alias("next")) for h in steps))
    rows = df.withColumn("prev", state).withColumn("h", after).withColumn("h", F.explode("h"))
    return rows.select("*", "h.horizon", "h.next").drop("h").where("next is not null")


def sequence_index(df: DataFrame, keys: list[str], order: list, name: str = "position") -> DataFrame:
    return df.withColumn(name, (F.row_number().over(within(keys, order)) - 1).cast("long"))


def chunk_windows(df: DataFrame, keys: list[str], order: list, n: int, action: str) -> DataFrame:
    """Non-overlapping windows of n rows: chunk, place in it, and the action before (null at a game's start)."""
    w = within(keys, order)
    at = F.row_number().over(w) - 1
    return df.withColumns({"chunk": F.floor(at / n), "place": (at % n).cast("long"), "previous": F.lag(action).over(w)})


def whole_game_limit(counts: DataFrame, game: str, n: str, limit: int) -> DataFrame:
    """The games kept, in order, until the soft limit of rows is reached; the first always.  counts: one row a game.

    Prefix sums go by ranges of the key: totals of ranges first, then within each range.
    """
    ranges = counts.withColumn("range_", F.floor(F.col(game) / 1024))
    totals = ranges.groupBy("range_").agg(F.sum(n).alias("sum_"))
    before = totals.select("range_", (F.sum("sum_").over(Window.orderBy("range_")) - F.col("sum_")).alias("before_"))  # a row for 1024 games
    own = F.sum(n).over(Window.partitionBy("range_").orderBy(game)) - F.col(n)
    return ranges.join(before, "range_").withColumn("start", F.col("before_") + own).where((F.col("start") < limit)).drop("range_", "before_")


def run_starts(df: DataFrame, keys: list[str], order: list, value: str) -> DataFrame:
    """Rows whose value differs from the row before (the first row too)."""
    before = F.lag(value).over(within(keys, order))
    first = F.row_number().over(within(keys, order)) == 1
    return df.withColumn("starts_", first | ~F.col(value).eqNullSafe(before)).where("starts_").drop("starts_")


def micros(ts: Column) -> Column:
    """Microseconds of a timestamp of either kind (read in the session's zone, UTC here)."""
    return F.unix_micros(ts.cast("timestamp"))


def frame_gaps(df: DataFrame, keys: list[str], order: list, ts: str, speed: float = 1.0, cap: float = 4.0, default: float = 1.0) -> DataFrame:
    """Seconds to the next row over the speed, at most cap; default where there is none or it is not positive."""
    gap = (micros(F.lead(ts).over(within(keys, order))) - micros(F.col(ts))) / 1_000_000
    return df.withColumn("delay", F.when(gap > 0, F.least(gap / speed, F.lit(cap))).otherwise(default))


def carried(df: DataFrame, keys: list[str], order: list, value: Column, name: str) -> DataFrame:
    """The last non-null value up to each row."""
    return df.withColumn(name, F.last(value, ignorenulls=True).over(within(keys, order).rowsBetween(Window.unboundedPreceding, 0)))


def preceding(df: DataFrame, keys: list[str], order: list, value: Column, name: str) -> DataFrame:
    """The last non-null value before each row."""
    return df.withColumn(name, F.last(value, ignorenulls=True).over(within(keys, order).rowsBetween(Window.unboundedPreceding, -1)))


def next_where(df: DataFrame, keys: list[str], order: list, value: Column, name: str) -> DataFrame:
    """The first non-null value after each row."""
    return df.withColumn(name, F.first(value, ignorenulls=True).over(within(keys, order).rowsBetween(1, Window.unboundedFollowing)))


def instances(df: DataFrame, keys: list[str], order: list, value: str, name: str = "instance") -> DataFrame:
    """Running number of the run of equal values that a row is in, from 1."""
    w = within(keys, order)
    new = F.when(F.row_number().over(w) == 1, 1).when(F.col(value).eqNullSafe(F.lag(value).over(w)), 0).otherwise(1)
    return df.withColumn("new_", new).withColumn(name, F.sum("new_").over(w)).drop("new_")


def assign_ids(df: DataFrame, keys: list[str], order: list, prefix: str, name: str = "event") -> DataFrame:
    return df.withColumn(name, F.format_string(f"{prefix}-%06d", F.row_number().over(within(keys, order))))


def first_per_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    return df.withColumn("place_", F.row_number().over(within(keys, order))).where("place_ = 1").drop("place_")


def zone_moves(df: DataFrame, game: str, obj: str, order: list, zone: str) -> DataFrame:
    """Each change of an object's zone: from_zone, to_zone."""
    before = F.lag(zone).over(within([game, obj], order))
    return df.where(F.col(obj).isNotNull()).withColumn("from_zone", before).where((F.col("from_zone").isNotNull()) & (F.col("from_zone") != F.col(zone))).withColumnRenamed(zone, "to_zone")


def pool(df: DataFrame, keys: list[str], order: list, item: str, name: str = "pool") -> DataFrame:
    """The items of earlier rows in order."""
    return df.withColumn(name, F.collect_list(item).over(within(keys, order).rowsBetween(Window.unboundedPreceding, -1)))


def consensus(df: DataFrame, keys: list[str], order: list, value: str, score: str, n: int = 5) -> DataFrame:
    """Over the last n rows with a value: the value of the greatest summed score (to six places, since the order of a sum leaves more open), then count, then least value; confidence .55 mean score + .45 share."""
    w = within(keys, order).rowsBetween(1 - n, 0)
    rows = df.where(F.col(value).isNotNull()).withColumn("last_", F.collect_list(F.struct(F.col(value).alias("v"), F.col(score).alias("s"))).over(w))

    def judged(v):
        own = F.filter("last_", lambda r: r["v"] == v)
        total = F.aggregate(own, F.lit(0.0), lambda a, r: a + r["s"])
        return F.struct(F.round(total, 6).alias("rounded"), F.size(own).alias("n"), (-v).alias("less"), v.alias("v"), total.alias("total"))

    best = F.array_max(F.transform(F.array_distinct(F.transform("last_", lambda r: r["v"])), judged))
    rows = rows.withColumn("best_", best)
    return rows.withColumn("agreed", F.col("best_.v")).withColumn("confidence", 0.55 * F.col("best_.total") / F.col("best_.n") + 0.45 * F.col("best_.n") / F.size("last_")).drop("last_", "best_")


def broken_chains(moves: DataFrame, game: str, obj: str, order: list) -> DataFrame:
    """Moves that do not start where the object's last move ended; UNKNOWN fits anything."""
    before = F.lag("to_zone").over(within([game, obj], order))
    rows = moves.withColumn("was", before)
    return rows.where(F.col("was").isNotNull() & (F.col("was") != F.col("from_zone")) & (F.col("was") != "UNKNOWN") & (F.col("from_zone") != "UNKNOWN"))
