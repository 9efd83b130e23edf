"""Checks, redactions and summaries of records, states, runs and decks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.text import COLORS
from ledgerline.operators.log_events import at

#: Words of an option that only passes or goes on.
IMPLICIT = ("PASS_PRIORITY", "PASS", "CONTINUE", "RESOLVE", "OK", "DONE", "SKIP", "NO_ACTION", "DECLINE_OPTIONAL")
#: Files that an upload bundle must have, and may have.
REQUIRED_FILES, OPTIONAL_FILES = ("decisions.jsonl", "summary.json"), ("manifest.json", "card_cache.json")
#: Fixed values of factor specs.
DIRECTIONS, TRANSFORMS = ("higher_better", "lower_better"), ("identity", "log1p", "signed_log1p", "sqrt", "tanh", "binary")
#: Kinds of values that an annotation may list, in the order in which they are looked for.
VALUE_KINDS = ("valueInt32", "valueString", "valueInt64", "valueUint32", "valueUint64", "valueBool")


# ---- states (canonical structs of boards.py)


def private(o: Column, seat: Column) -> Column:
    """An object in a hand that the seat may not see; without a seat no hand may be seen."""
    return (o["zone"] == "hand") & ~o["controller"].eqNullSafe(seat) | ((o["zone"] == "hand") & seat.isNull())


def redacted(state: Column, seat: Column) -> Column:
    """The state with every object of a hand that the seat may not see as a face-down one without name, types and numbers."""

    def hide(o: Column) -> Column:
        blank = o.withField("name", F.lit(None).cast("string")).withField("types", F.array().cast("array<string>")).withField("face_down", F.lit(True)).withField("counters", F.create_map().cast("map<string, bigint>"))
        for field, kind in (("power", "bigint"), ("toughness", "bigint"), ("damage", "bigint"), ("tapped", "boolean"), ("token", "boolean"), ("attached_to", "string")):
            blank = blank.withField(field, F.lit(None).cast(kind))
        return F.when(private(o, seat), blank).otherwise(o)

    return state.withField("objects", F.transform(state["objects"], hide))


def hidden_leaks(state: Column, seat: Column) -> Column:
    """How many objects of other hands than the seat's show their name; a state passes with none."""
    return F.size(F.filter(state["objects"], lambda o: private(o, seat) & o["name"].isNotNull())).cast("long")


def zone_counts(state: Column, zone: str) -> Column:
    """A map from seat to the size of its zone: the objects listed, else the count stated, else 0."""
    listed = lambda p: F.size(F.filter(state["objects"], lambda o: (o["zone"] == zone) & (o["owner"] == p["seat"]))).cast("long")
    return F.map_from_entries(F.transform(state["players"], lambda p: F.struct(p["seat"].alias("key"), F.coalesce(F.nullif(listed(p), F.lit(0).cast("long")), p[f"{zone}_count"], F.lit(0).cast("long")).alias("value"))))


def board_totals(state: Column) -> Column:
    """power, toughness and tapped of the whole battlefield."""
    board = F.filter(state["objects"], lambda o: o["zone"] == "battlefield")
    total = lambda field: F.aggregate(board, F.lit(0).cast("long"), lambda a, o: a + F.coalesce(o[field], F.lit(0).cast("long")))
    return F.struct(total("power").alias("power"), total("toughness").alias("toughness"), F.size(F.filter(board, lambda o: o["tapped"])).cast("long").alias("tapped"))


def state_quality(confidence: Column, unknown: Column, critical: Column, known: Column, objects: Column, least: float = 0.55) -> Column:
    """score (0.78 of the mean confidence and 0.22 of the share of named objects) and critical (paths that are unknown or below ``least``)."""
    values = F.map_values(confidence)
    mean = F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values)).otherwise(0.0)
    share = F.when(objects > 0, known / objects).otherwise(1.0)
    bad = F.filter(critical, lambda p: F.array_contains(unknown, p) | (F.coalesce(F.try_element_at(confidence, p), F.lit(0.0)) < least))
    return F.struct(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.78 * mean + 0.22 * share)).alias("score"), bad.alias("critical"))


# ---- options, annotations, samples


def is_implicit(kind: Column, label: Column, key: Column, action: Column) -> Column:
    """An option that only passes or goes on, by any of its words."""
    said = F.upper(F.concat_ws(" ", kind, label, key, action))
    return F.exists(F.array(*map(F.lit, IMPLICIT)), lambda w: F.contains(said, w))


def annotation_map(details: Column) -> Column:
    """Details (a VARIANT list of objects with key and value lists) as a map of texts; lists of one value are that value, empty lists are passed over."""

    def value(d: Column) -> Column:
        lists = [at(d, k, "array<string>") for k in VALUE_KINDS]
        return F.coalesce(*(F.when(F.size(x) > 0, F.when(F.size(x) == 1, x[0]).otherwise(F.to_json(x))) for x in lists))

    rows = F.transform(F.coalesce(F.try_variant_get(details, "$", "array<variant>"), F.array().cast("array<variant>")), lambda d: F.struct(at(d, "key").alias("key"), value(d).alias("value")))
    kept = F.filter(rows, lambda r: r["key"].isNotNull() & r["value"].isNotNull())
    last = F.filter(kept, lambda r, i: ~F.exists(F.slice(kept, i + 2, F.greatest(F.size(kept), F.lit(1))), lambda x: x["key"] == r["key"]))
    return F.map_from_entries(last)


def needs_review(df: DataFrame, keys: list[str], order: str, confidence: str, every: int, least: float, budget: int | None = None) -> DataFrame:
    """The frame with review: every ``every``-th sample or a mean confidence (of an array; of none 0) below ``least``, as long as the source's budget lasts."""
    mean = F.when(F.size(confidence) > 0, F.aggregate(confidence, F.lit(0.0), lambda a, x: a + x) / F.size(confidence)).otherwise(0.0)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1
    rows = df.withColumn("review", ((place % every == 0) if every > 0 else F.lit(False)) | (mean < least))
    if budget is None:
        return rows
    asked = F.sum(F.col("review").cast("int")).over(Window.partitionBy(*keys).orderBy(order))
    return rows.withColumn("asked_", asked).withColumn("review", F.col("review") & (F.col("asked_") <= budget)).drop("asked_")


# ---- checks


def spec_errors(specs: DataFrame, name: str = "name") -> DataFrame:
    """The specs (name, direction, transform, scale, minimum, maximum) with error: the first rule that fails, null if none."""
    finite = lambda c: ~F.isnan(c) & (F.abs(c) < float("inf"))
    twice = F.count("*").over(Window.partitionBy(name)) > 1
    rules = (
        ("empty name", F.trim(F.coalesce(F.col(name), F.lit(""))) == ""),
        ("unknown direction", ~F.coalesce(F.col("direction").isin(*DIRECTIONS), F.lit(False))),
        ("unknown transform", ~F.coalesce(F.col("transform").isin(*TRANSFORMS), F.lit(False))),
        ("scale not positive", ~F.coalesce(finite(F.col("scale")) & (F.col("scale") > 0), F.lit(False))),
        ("minimum exceeds maximum", F.coalesce(F.col("minimum") > F.col("maximum"), F.lit(False))),
        ("name twice", twice),
    )
    error = F
    for text, failed in rules:
        error = error.when(failed, text)
    return specs.withColumn("error", error)


def score_error(scores: Column, options: Column) -> Column:
    """Why a list of scores does not fit so many options, null if it does."""
    finite = F.forall(scores, lambda s: F.coalesce(~F.isnan(s) & (F.abs(s) < float("inf")), F.lit(False)))
    return F.when(~F.coalesce(F.size(scores) == options, F.lit(False)), "wrong number of scores").when(~finite, "score not finite")


def vocabulary_error(labels: DataFrame, label: str, version: int = 1) -> DataFrame:
    """One row: labels, distinct_labels, error (of an unknown version, an empty vocabulary, a label that is null or twice)."""
    rows = labels.agg(F.count("*").alias("labels"), F.countDistinct(label).alias("distinct_labels"))
    error = F.when(F.lit(version) != 1, "unknown version").when(F.col("labels") == 0, "empty").when(F.col("labels") != F.col("distinct_labels"), "label twice")
    return rows.withColumn("error", error)


def bundle_checks(files: DataFrame, bundle: str = "bundle", name: str = "name") -> DataFrame:
    """bundle, missing (required files that are not there), optional (others known that are), valid."""
    have = F.collect_set(name)
    rows = files.groupBy(bundle).agg(have.alias("have_"))
    of = lambda names, there: F.filter(F.array(*map(F.lit, names)), lambda n: F.array_contains("have_", n) if there else ~F.array_contains("have_", n))
    return rows.select(bundle, of(REQUIRED_FILES, False).alias("missing"), of(OPTIONAL_FILES, True).alias("optional")).withColumn("valid", F.size("missing") == 0)


# ---- results, runs, decks


def winner_seat(result: Column, names: tuple[str, str] = ("P0", "P1")) -> Column:
    """The seat of a winner given as a number or by name in a text; null for none."""
    text = F.trim(result.cast("string"))
    number = text.try_cast("bigint")
    return F.when(number.isNotNull(), number).when(F.contains(text, F.lit(names[0])) & ~F.contains(text, F.lit(names[1])), 0).when(F.contains(text, F.lit(names[1])) & ~F.contains(text, F.lit(names[0])), 1)


def terminal_reward(winner: Column, player: Column, over: Column) -> Column:
    """1 for the winner, -1 for the other, 0 for a draw, at the end only."""
    return F.when(over, F.when(winner.isNull(), 0.0).when(winner == player, 1.0).otherwise(-1.0))


def tournament(games: DataFrame, by: list[str]) -> DataFrame:
    """by, attempted, completed, crashes, wins (of seat 0), losses, draws, mean_decisions (of completed games), invalid of games (winner, crashed, decisions, invalid)."""
    n = lambda c: F.count(F.when(c, 1))
    done = ~F.col("crashed")
    return games.groupBy(*by).agg(
        F.count("*").alias("attempted"), n(done).alias("completed"), n(F.col("crashed")).alias("crashes"), n(done & (F.col("winner") == 0)).alias("wins"), n(done & (F.col("winner") == 1)).alias("losses"),
        n(done & F.col("winner").isNull()).alias("draws"), F.round(F.avg(F.when(done, F.col("decisions"))), 6).alias("mean_decisions"), F.sum("invalid").alias("invalid"),
    )


def captured(events: DataFrame, session: str, kind: str, order: list[str], match: str) -> DataFrame:
    """session, events, decisions, states, matched (answers that found their prompt) and match_ids in the order of first sight, of events (type, matched)."""
    first = events.where(F.col(match).isNotNull()).groupBy(session, match).agg(F.min(F.struct(*order)).alias("at_"))
    ids = first.groupBy(session).agg(F.transform(F.sort_array(F.collect_list(F.struct("at_", match))), lambda r: r[match]).alias("match_ids"))
    n = lambda c: F.count(F.when(c, 1))
    counts = events.groupBy(session).agg(F.count("*").alias("events"), n(F.col(kind) == "decision").alias("decisions"), n(F.col(kind) == "state").alias("states"), n((F.col(kind) == "decision") & F.col("matched")).alias("matched"))
    return counts.join(ids, session, "left").withColumn("match_ids", F.coalesce("match_ids", F.array().cast(ids.schema["match_ids"].dataType)))


def merged_cards(sources: DataFrame, card: str, order: list[str]) -> DataFrame:
    """One row a card: of several sources the last one wins, whole."""
    rest = [c for c in sources.columns if c not in (card, *order)]
    return sources.groupBy(card).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("last_")).select(card, "last_.*")


def deck_summary(cards: DataFrame, deck: str) -> DataFrame:
    """deck, colors (union, in W U B R G order), set_mode (commonest set of cards that are not basic; ties to the first name), curve (map of cost, 7 and more together, to cards that are no lands) of rows (colors, set, cost, basic, land)."""
    letters = F.concat(*(F.when(F.max(F.contains(F.upper(F.coalesce("colors", F.lit(""))), F.lit(c))), c).otherwise("") for c in COLORS.values()))
    colors = cards.groupBy(deck).agg(letters.alias("colors"))
    sets = cards.where(~F.col("basic")).groupBy(deck, "set").agg(F.count("*").alias("n_"))
    modes = sets.groupBy(deck).agg(F.min_by("set", F.struct(-F.col("n_"), "set")).alias("set_mode"))
    costs = cards.where(~F.col("land") & F.col("cost").isNotNull()).groupBy(deck, F.least("cost", F.lit(7)).alias("cost_")).agg(F.count("*").alias("n_"))
    curve = costs.groupBy(deck).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("cost_", "n_")))).alias("curve"))
    return colors.join(modes, deck, "left").join(curve, deck, "left")


def verified_runs(steps: DataFrame, run: str, compared: str, passed: str) -> DataFrame:
    """run, steps, verified: every step compared and passed; a run without steps has no row."""
    return steps.groupBy(run).agg(F.count("*").alias("steps"), F.every(F.coalesce(F.col(compared) & F.col(passed), F.lit(False))).alias("verified"))


def game_key(match: Column, game: Column, instance: Column) -> Column:
    """The JSON list of match, game and instance, null if none of them is there."""
    text = lambda c: F.coalesce(F.to_json(F.array(c)).substr(F.lit(2), F.length(F.to_json(F.array(c))) - 2), F.lit("null"))
    return F.when(F.coalesce(match.cast("string"), game.cast("string"), instance.cast("string")).isNotNull(), F.concat(F.lit("["), text(match), F.lit(","), text(game), F.lit(","), text(instance), F.lit("]")))


def pair_key(explicit: Column, *parts: Column) -> Column:
    """The explicit key, else the parts joined by bars (null parts are empty)."""
    return F.coalesce(explicit, F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)))


def consensus():
    """A grouped aggregate in Python of (value, times, first): the commonest value, ties to the one seen first; of counted rows, so that a group is as large as its distinct values."""

    @F.pandas_udf("string")
    def commonest(value: pd.Series, times: pd.Series, first: pd.Series) -> str:
        rows = sorted(zip(-times, first, value.fillna(""), strict=True))
        return rows[0][2] if rows else ""

    return commonest
