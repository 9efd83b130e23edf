"""Joins of decision logs: prompts and responses, as-of states, packs and picks, names, pairs."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.operators.sequences import micros


def asof(left: DataFrame, right: DataFrame, key: str, time: str, value: str, tolerance: float) -> DataFrame:
    """Each left row with the first right row at or after it within the tolerance, else the nearest before within it.

    Both sides are laid in one ordered stream by key, so there is one shuffle and no range join.
    """
    both = left.select(key, time, F.struct(*left.columns).alias("l"), F.lit(None).cast(right.schema[value].dataType).alias("r")).unionByName(
        right.select(key, time, F.lit(None).cast(left.select(F.struct(*left.columns).alias("l")).schema["l"].dataType).alias("l"), F.col(value).alias("r"))
    )
    order = Window.partitionBy(key).orderBy(time, F.col("l").isNotNull())  # at one time, right rows first
    found = F.when(F.col("r").isNotNull(), F.struct(F.col(time).alias("t"), F.col("r").alias("v")))
    # Right rows of the same time stand before, so they are found by the last one when their time is equal.
    rows = both.withColumns(
        {
            "before": F.last(found, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)),
            "after": F.first(found, ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing)),
        }
    ).where("l is not null")
    gap = lambda c: F.abs(micros(F.col(c)["t"]) - micros(F.col(time))) / 1_000_000
    same = F.col("before")["t"] == F.col(time)
    pick = F.when(same, F.col("before")["v"]).when(gap("after") <= tolerance, F.col("after")["v"]).when(gap("before") <= tolerance, F.col("before")["v"])
    return rows.select("l.*", pick.alias("matched"))


def pair_responses(df: DataFrame, match: str, order: str, role: str, prompt: str = "user", response: str = "assistant") -> DataFrame:
    """Each prompt with the next response of its match before any other prompt; unmatched prompts stay, with null."""
    w = Window.partitionBy(match).orderBy(order)
    return df.where(F.col(role).isin(prompt, response)).withColumn("next_role", F.lead(role).over(w)).withColumn("next_at", F.lead(order).over(w)).where(F.col(role) == prompt).withColumn("response", F.when(F.col("next_role") == response, F.col("next_at"))).drop("next_role", "next_at")


def draft_picks(packs: DataFrame, picks: DataFrame, on: list[str]) -> DataFrame:
    """Picks with their packs: status 'ok', 'not_in_pack' or 'no_pack'.  packs: array pack; picks: picked."""
    joined = picks.join(packs, on, "left")
    return joined.withColumn("status", F.when(F.col("pack").isNull(), "no_pack").when(F.array_contains("pack", F.col("picked")), "ok").otherwise("not_in_pack"))


def latest(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The newest row of each key."""
    return df.withColumn("place_", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("place_ = 1").drop("place_")


def unscored(decisions: DataFrame, cache: DataFrame, on: list[str]) -> DataFrame:
    """Rows that the cache does not hold yet."""
    return decisions.join(cache, on, "left_anti")


def resolve_names(names: DataFrame, catalogue: DataFrame, name: str, known: str) -> DataFrame:
    """Exact name, else the normalised one, else unresolved: strategy and resolved.  The catalogue has one row a name."""
    exact = catalogue.select(F.col(known).alias("exact_")).distinct()
    normal = catalogue.groupBy(normalised(F.col(known)).alias("normal_")).agg(F.min(known).alias("found_"))
    joined = names.join(exact, F.col(name) == F.col("exact_"), "left").join(normal, normalised(F.col(name)) == F.col("normal_"), "left")
    out = joined.withColumn("resolved", F.coalesce("exact_", "found_"))
    return out.withColumn("strategy", F.when(F.col("exact_").isNotNull(), "exact").when(F.col("found_").isNotNull(), "normalized").otherwise("unresolved")).drop("exact_", "normal_", "found_")


#: Typographic characters and their plain forms (fixed values).
PLAIN = {"’": "'", "‘": "'", "“": '"', "”": '"', "–": "-", "—": "-", " ": " "}


def plain_name(name: Column) -> Column:
    """Typographic quotes, dashes and spaces to ASCII, '///' to '//', spaces collapsed; case kept."""
    out = F.translate(name, "".join(PLAIN), "".join(PLAIN.values()))
    return F.trim(F.regexp_replace(F.regexp_replace(out, "///", "//"), r"\s+", " "))


def normalised(name: Column) -> Column:
    return F.lower(plain_name(name))


def allowed_edits(length: Column, least: float) -> Column:
    """Edits that leave a pair, of which the longer name has this length, at the threshold (scores are rounded to 6 places)."""
    return F.floor(F.greatest(length, F.lit(1)) * (1 - least + 1e-6)).cast("int")


#: Parts of a known name that are left out, the most common ones.
SPARE = 1


def known_segments(name: Column, least: float) -> Column:
    """(size, edits, segment, text) of a known name: cut into edits + 1 + SPARE even parts, for every number of edits that a partner may allow."""
    size = F.length(name)
    longest = F.greatest(size, F.lit(1), F.floor(F.greatest(size, F.lit(1)) / (least - 1e-6)).cast("int"))

    def parts(edits: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), edits + SPARE), lambda i: F.struct(size.alias("size"), edits.alias("edits"), i.alias("segment"), F.substring(name, segment_start(size, edits, i) + 1, segment_size(size, edits, i)).alias("text")))

    return F.flatten(F.transform(F.array_distinct(F.transform(F.sequence(F.greatest(size, F.lit(1)), longest), lambda m: allowed_edits(m, least))), parts))


def segment_size(size: Column, edits: Column, i: Column) -> Column:
    """The last parts are one longer where the size does not divide."""
    parts = edits + 1 + SPARE
    return (F.floor(size / parts) + F.when(i >= parts - size % parts, 1).otherwise(0)).cast("int")


def segment_start(size: Column, edits: Column, i: Column) -> Column:
    parts = edits + 1 + SPARE
    return (i * F.floor(size / parts) + F.greatest(F.lit(0), i - (parts - size % parts))).cast("int")


def probes(name: Column, least: float) -> Column:
    """(size, edits, segment, text) that a known name within the threshold would have: substrings where a part can stand.

    A part that an alignment leaves whole stands s places off with at most |s| + |difference of lengths - s| edits elsewhere.
    """
    own = F.length(name)
    lowest = F.floor(own * (least - 1e-6)).cast("int")
    longest = F.greatest(own, F.lit(1), F.floor(F.greatest(own, F.lit(1)) / (least - 1e-6)).cast("int"))

    def of_size(size: Column) -> Column:
        edits, gap = allowed_edits(F.greatest(own, size), least), own - size

        def of_part(i: Column) -> Column:
            start, n = segment_start(size, edits, i), segment_size(size, edits, i)
            low, high = F.greatest(F.lit(0), start - F.floor((edits - gap) / 2).cast("int")), F.least(own - n, start + F.floor((edits + gap) / 2).cast("int"))
            found = F.transform(F.sequence(low, F.greatest(low, high)), lambda s: F.struct(size.alias("size"), edits.alias("edits"), i.alias("segment"), F.substring(name, s + 1, n).alias("text")))
            return F.when(high >= low, found).otherwise(F.slice(found, 1, 0))

        every = F.flatten(F.transform(F.sequence(F.lit(0), edits + SPARE), of_part))
        return F.when(F.abs(gap) <= edits, every).otherwise(F.slice(every, 1, 0))

    return F.array_distinct(F.flatten(F.transform(F.sequence(lowest, longest), of_size)))


def fuzzy_candidates(names: DataFrame, catalogue: DataFrame, name: str, known: str, least: float = 0.72) -> DataFrame:
    """a_, b_: normalised names that share a part, so that no pair at the threshold is left out; a pair may come more than once.

    Of any edits + 1 parts of a name, as many edits leave one whole, so the rarest ones of its parts are enough.  They are
    found by the name's length, the part's number and its text: a part that is common is a key only where all parts are,
    and for names of one length.  Where a name has fewer characters than parts (thresholds under a half), empty parts let
    every name of such lengths through.
    """
    a, b = (d.select(normalised(F.col(c)).alias(n)).where(F.col(n).isNotNull()).distinct() for d, c, n in ((names, name, "a_"), (catalogue, known, "b_")))
    key = ["size", "edits", "segment", "text"]
    parts = b.select("b_", F.explode(known_segments(F.col("b_"), least)).alias("k")).select("b_", "k.*")
    counted = parts.join(parts.groupBy(key).agg(F.count("*").alias("names_")), key)
    place = F.row_number().over(Window.partitionBy("b_", "edits").orderBy("names_", "segment"))
    held = counted.withColumn("place_", place).where(F.col("place_") <= F.col("edits") + 1).select("b_", *key)
    asked = a.select("a_", F.explode(probes(F.col("a_"), least)).alias("k")).select("a_", "k.*")
    return asked.join(held, key).select("a_", "b_")


def fuzzy(names: DataFrame, catalogue: DataFrame, name: str, known: str, least: float = 0.72) -> DataFrame:
    """The best catalogue name by Levenshtein ratio, of all that reach ``least`` (ties to the least name)."""
    longer = F.greatest(F.length("a_"), F.length("b_"), F.lit(1))
    scored = fuzzy_candidates(names, catalogue, name, known, least).withColumn("score", F.round(1 - F.levenshtein("a_", "b_") / longer, 6))
    scored = scored.where(F.col("score") >= least).distinct()
    asked, held = names.select(name).distinct(), catalogue.select(known).distinct()
    pairs = asked.withColumn("a_", normalised(F.col(name))).join(scored, "a_").join(held.withColumn("b_", normalised(F.col(known))), "b_")
    return pairs.groupBy(name).agg(F.min_by(known, F.struct(-F.col("score"), F.col(known))).alias(known), F.max("score").alias("score"))


def compared(expected: DataFrame, observed: DataFrame, on: list[str], value: str) -> DataFrame:
    """Full outer comparison by path: MATCH, MISMATCH, or UNKNOWN where a side has no value."""
    e, o = expected.withColumnRenamed(value, "expected"), observed.withColumnRenamed(value, "observed")
    joined = e.join(o, on, "full")
    status = F.when(F.col("expected").isNull() | F.col("observed").isNull(), "UNKNOWN").when(semantic_equal(F.col("expected"), F.col("observed")), "MATCH").otherwise("MISMATCH")
    return joined.withColumn("status", status)


def semantic_equal(left: Column, right: Column, close: float = 1e-6) -> Column:
    """Numbers within 1e-6, texts without case; null equals null only."""
    return F.when(left.isNull() | right.isNull(), left.isNull() & right.isNull()).otherwise(F.lower(left.cast("string")).eqNullSafe(F.lower(right.cast("string"))) | F.coalesce(F.abs(left.try_cast("double") - right.try_cast("double")) <= close, F.lit(False)))


def paired(scores: DataFrame, agent: str, pair: str, score: str) -> DataFrame:
    """left, right, pair and the difference of their scores, for agents in name order that both played the pair."""
    a, b = (scores.select(F.col(agent).alias(n), pair, F.col(score).alias(f"score_{n}")) for n in ("left", "right"))
    return a.join(b, pair).where(F.col("left") < F.col("right")).withColumn("delta", F.col("score_left") - F.col("score_right"))


def pool_overlap(decks: DataFrame, pools: DataFrame, deck: str, pool: str, card: str, order: str, least: float = 0.5) -> DataFrame:
    """Each deck with the pool that shares most distinct cards (ties to the earliest); both as rows (id, card).

    A pool with less than this share of the deck's cards that any pool has is none.  So a pool that counts has one of the
    deck's rarest cards (all but the least number that it must share, and one): candidates come from those alone, and a
    card that most pools have is a key only for decks of such cards.  Candidates that, with all other cards, could not
    share as many as another has of the rarest go; the other cards are counted for what is left.
    """
    held = pools.select(pool, order, card).distinct()
    firsts = held.groupBy(pool).agg(F.min(order).alias(order))
    held = held.select(pool, card).distinct()
    cards = decks.select(deck, card).distinct().join(held.groupBy(card).agg(F.count("*").alias("pools_")), card)
    w = Window.partitionBy(deck)
    cards = cards.select(deck, card, F.row_number().over(w.orderBy("pools_", card)).alias("place_"), F.count("*").over(w).alias("known_"))
    need = F.greatest(F.lit(1), F.ceil(F.lit(least) * F.col("known_") - 1e-9))
    rare = cards.where(F.col("place_") <= F.col("known_") - need + 1)
    rest = cards.where(F.col("place_") > F.col("known_") - need + 1).select(deck, card)
    found = rare.join(held, card).groupBy(deck, pool, "known_").agg(F.count("*").alias("rare_")).withColumn("most_", F.max("rare_").over(w))
    hopeful = found.where(F.col("rare_") + need - 1 >= F.greatest("most_", need))
    more = hopeful.select(deck, pool).join(rest, deck).join(held, [pool, card], "left_semi").groupBy(deck, pool).agg(F.count("*").alias("more_"))
    shared = hopeful.join(more, [deck, pool], "left").withColumn("shared", F.col("rare_") + F.coalesce("more_", F.lit(0))).where(F.col("shared") >= need)
    return latest(shared.join(firsts, pool), [deck], [F.desc("shared"), order, pool]).select(deck, pool, "shared")


def greedy_match(expected: DataFrame, observed: DataFrame, group: list[str], weights: dict[str, float], least: float = 0.25) -> DataFrame:
    """One-to-one pairs (expected_id, observed_id, score) of each group by falling similarity, ties to the smaller ids.

    A pair scores the weights, all above 0, of its equal fields; null equals nothing.  Scores are taken level by level.
    At a level, rows that are equal in the fields of one of its sums are a class.  Where no row of a class is in another
    one, the class's rows pair by place.  In the rest, pairs that are the first choice of both rows are taken in rounds;
    every round takes one at least.
    """
    fields = list(weights)
    columns = list(dict.fromkeys([*group, *fields]))
    levels: dict[float, list[tuple[str, ...]]] = {}
    for own in (c for n in range(1, len(fields) + 1) for c in combinations(fields, n)):
        levels.setdefault(float(sum(weights[f] for f in own)), []).append(own)
    kinds = [f"{g} {expected.schema[g].dataType.simpleString()}" for g in group]
    done = expected.sparkSession.createDataFrame([], ", ".join([*kinds, "expected_id long", "observed_id long", "score double"]))
    free = {"expected_id": expected, "observed_id": observed}
    free = {name: df.select(*columns, F.col("id").cast("long").alias(name)).checkpoint() for name, df in free.items()}

    def members(name: str, sets: list[tuple[str, ...]]) -> DataFrame:
        """A row for each class: its group and fields.  Fields of the group that a set leaves out are null, or they would be equal too."""
        is_in = lambda own: reduce(lambda a, f: a & (F.col(f).isNotNull() if f in own else F.col(f).isNull()), [f for f in fields if f in own or f in group], F.lit(True))
        key = lambda n, own: F.when(is_in(own), F.to_json(F.struct(F.lit(n).alias("n_"), *own)))
        classes = F.array_compact(F.array(*(key(n, own) for n, own in enumerate(sets))))
        return free[name].select(*group, name, F.explode(classes).alias("class_"))

    for score, sets in sorted((x for x in levels.items() if x[0] >= least), reverse=True):
        a, b = members("expected_id", sets), members("observed_id", sets)
        found = []
        if len(sets) > 1:
            on = [*group, "class_"]
            both = same(a.select(*on).distinct(), b.select(*on).distinct(), on)
            a, b = (same(d, both, on, "left_semi").checkpoint() for d in (a, b))
            crowded = lambda d, name: d.withColumn("n_", F.count("*").over(Window.partitionBy(*group, name))).where("n_ > 1").select(*on)
            mixed = crowded(a, "expected_id").unionByName(crowded(b, "observed_id")).distinct().checkpoint()
            left, right = (same(d, mixed, on, "left_semi").checkpoint() for d in (a, b))
            a, b = (same(d, mixed, on, "left_anti") for d in (a, b))
            while not left.isEmpty() and not right.isEmpty():
                choice = lambda d, e, own, other: same(d, e.groupBy(*on).agg(F.min(other).alias(other)), on).groupBy(*group, own).agg(F.min(other).alias(other))
                agreed = same(choice(left, right, "expected_id", "observed_id"), choice(right, left, "observed_id", "expected_id"), [*group, "expected_id", "observed_id"]).checkpoint()
                if agreed.isEmpty():
                    break
                found.append(agreed)
                left, right = (same(d, agreed.select(*group, name), [*group, name], "left_anti").checkpoint() for d, name in ((left, "expected_id"), (right, "observed_id")))
        place = lambda d, name: d.withColumn("place_", F.row_number().over(Window.partitionBy(*group, "class_").orderBy(name)))
        found.append(same(place(a, "expected_id"), place(b, "observed_id"), [*group, "class_", "place_"]))
        pairs = reduce(DataFrame.unionByName, (f.select(*group, "expected_id", "observed_id") for f in found)).withColumn("score", F.lit(score)).checkpoint()
        done = done.unionByName(pairs)
        free = {name: same(df, pairs.select(*group, name), [*group, name], "left_anti").checkpoint() for name, df in free.items()}
    return done


def same(a: DataFrame, b: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join on columns of which nulls are equal; the columns of b's own follow."""
    b = b.toDF(*(f"{c}_r_" if c in on else c for c in b.columns))
    joined = a.join(b, reduce(lambda x, c: x & a[c].eqNullSafe(b[f"{c}_r_"]), on[1:], a[on[0]].eqNullSafe(b[f"{on[0]}_r_"])), how)
    return joined.drop(*(f"{c}_r_" for c in on)) if how in ("inner", "left") else joined


def join_analysis(decisions: DataFrame, analyses: DataFrame, on: list[str], checkpoint: str, chosen: object = None, several: bool = False) -> DataFrame:
    """Decisions with the analyses of the chosen checkpoint; with none chosen, more than one is an error unless several may be."""
    if chosen is not None:
        analyses = analyses.where(F.col(checkpoint) == F.lit(chosen))
    elif not several and analyses.select(checkpoint).distinct().limit(2).count() > 1:
        raise ValueError(f"several values of {checkpoint}: choose one")
    return decisions.join(analyses, on)
