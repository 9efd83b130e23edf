"""Training examples of decisions, drafts and decks, each row with the reason why it gives one or none.

Records of one kind stay one row each; arrays are handled in place, and only a deck becomes a row for each card put in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions import open_json as J
from ledgerline.functions import text as T
from ledgerline.operators.log_events import let
from ledgerline.operators.records import UNKNOWN, option_bucket, option_count, prompt_type, single_choice


def option_key(option: Column) -> Column:
    """Options of one type and key do the same; an option without key is alone."""
    return F.when(option["key"].isNull(), F.concat(F.lit("index:"), option["index"])).otherwise(F.concat_ws("|", option["type"], option["key"].cast("string")))


def index_groups(options: Column) -> Column:
    """Indices of options that do the same, groups by their first option."""
    keys = F.transform(options, option_key)
    return let(keys, lambda k: F.transform(F.array_distinct(k), lambda own: F.filter(F.transform(k, lambda x, i: F.when(x == own, i)), lambda i: i.isNotNull())))


def texts(options: Column) -> Column:
    return F.transform(options, lambda o: T.option_text(o["type"], o["label"], o["key"]))


def reasons(df: DataFrame) -> DataFrame:
    """How many rows came to each reason."""
    return df.groupBy("reason").agg(F.count("*").alias("n"))


def compiled(df: DataFrame, state: Column, only_single: bool = True) -> DataFrame:
    """The frame with reason and, where it is 'compiled', example: what one decision shows and which option was chosen.

    With ``only_single``, decisions that are not one of one are 'discarded_multi_select'; else the first index counts.  A decision
    without options or with an index outside them is discarded too.
    """
    n, pick = option_count(), F.try_element_at("selectedIndices", F.lit(1))
    reason = F.when(F.coalesce(n, F.lit(0)) == 0, "discarded_no_options").when(pick.isNull() | (pick < 0) | (pick >= n), "discarded_invalid").otherwise("compiled")
    if only_single:
        reason = F.when(~single_choice(df), "discarded_multi_select").otherwise(reason)
    options = F.col("select.option")
    example = F.struct(
        F.lit(1).alias("schemaVersion"), "gameId", "sequenceNumber", "playerIndex", prompt_type().alias("promptType"), F.transform(options, lambda o: F.coalesce(o["type"], F.lit(UNKNOWN))).alias("optionTypes"),
        T.canonical_text(state).alias("stateText"), texts(options).alias("optionTexts"), pick.alias("chosenIndex"),
    )
    return df.withColumn("reason", reason).withColumn("example", F.when(F.col("reason") == "compiled", example))


def ranked(df: DataFrame, state: Column) -> DataFrame:
    """The frame with reason ('kept' or why it is skipped) and example: texts, groups of options that do the same, and the chosen group."""
    n, pick = option_count(), F.try_element_at("selectedIndices", F.lit(1))
    reason = F.when(F.coalesce(n, F.lit(0)) == 0, "skipped_no_options").when(F.coalesce(F.size("selectedIndices") != 1, F.lit(True)), "skipped_multi_or_no_select").when(pick.isNull() | (pick < 0) | (pick >= n), "skipped_bad_index").otherwise("kept")
    groups = index_groups(F.col("select.option"))
    chosen = lambda g: F.filter(F.transform(g, lambda own, i: F.when(F.array_contains(own, pick.cast("int")), i)), lambda i: i.isNotNull())[0]
    example = let(groups, lambda g: F.struct("gameId", T.canonical_text(state).alias("stateText"), prompt_type().alias("promptType"), texts(F.col("select.option")).alias("optionTexts"), g.alias("groups"), chosen(g).alias("chosenGroup")))
    return df.withColumn("reason", reason).withColumn("example", F.when(F.col("reason") == "kept", example))


def copy_number(cards: Column, place: Column) -> Column:
    """Which copy of its card stands at a place (from 0): 1 for the first."""
    return F.coalesce(place + 1 - F.size(F.array_remove(F.slice(cards, 1, place + 1), F.get(cards, place))), F.lit(0))


def copies(cards: Column) -> Column:
    """(card, which copy of it) of each place; null for no card."""
    return F.transform(cards, lambda c, i: F.when(c.isNotNull(), F.struct(c.alias("card"), copy_number(cards, i).alias("copy"))))


def positives(candidates: Column, chosen: Column) -> Column:
    """The place among the candidates of each chosen card, copies in turn; null if one is not there."""
    at = lambda held: lambda own: F.nullif(F.array_position(held, own), F.lit(0).cast("bigint")).cast("int") - 1
    found = let(copies(candidates), lambda held: F.transform(copies(chosen), at(held)))
    return let(found, lambda f: F.when(F.coalesce(F.forall(f, lambda i: i.isNotNull()), F.lit(False)), f))


def deck_steps(pool: Column, deck: Column) -> Column:
    """A step for each card of a deck that its pool still holds: place, context (cards put in before), candidates (what is left of the pool) and positives.

    Cards granted from outside the pool come into the context and are no step.  Of what is left, all that the rest of the deck
    takes is positive.  A copy in the deck takes the same copy of the pool at every step, so that they are matched once.
    """
    place_of = lambda keys: lambda own: F.array_position(keys, own).cast("int") - 1
    # Where the deck puts a copy of the pool in, and which copy of the pool a place of the deck takes; -1 if there is none.
    matched = lambda held, put: F.struct(F.transform(held, place_of(put)).alias("puts"), F.transform(put, place_of(held)).alias("takes"))

    def step(place: Column, puts: Column, takes: Column) -> Column:
        left = F.filter(F.transform(puts, lambda at, j: F.when((at < 0) | (at >= place), j)), lambda j: j.isNotNull())

        def of(left: Column) -> Column:
            candidates = F.transform(left, lambda j: F.get(pool, j))

            def chosen(candidates: Column) -> Column:
                later = F.filter(F.sequence(place, F.size(deck) - 1), lambda i: F.array_contains(candidates, F.get(deck, i)))
                found = F.transform(later, lambda i: F.nullif(F.array_position(left, F.get(takes, i)), F.lit(0).cast("bigint")).cast("int") - 1)
                fit = let(found, lambda f: F.when(F.forall(f, lambda i: i.isNotNull()), f))
                return F.struct(place.alias("place"), F.slice(deck, 1, place).alias("context"), candidates.alias("candidates"), fit.alias("positives"))

            return let(candidates, chosen)

        return let(left, of)

    def steps(m: Column) -> Column:
        taken = F.filter(F.sequence(F.lit(0), F.size(deck) - 1), lambda i: F.coalesce(F.get(m["takes"], i) >= 0, F.lit(True)))
        return F.transform(taken, lambda i: step(i, m["puts"], m["takes"]))

    return F.when(F.size(deck) > 0, let(copies(pool), lambda held: let(copies(deck), lambda put: let(matched(held, put), steps))))


def selections(records: DataFrame, keys: list[str]) -> DataFrame:
    """keys, kind, reason, mode, step, context, candidates, positives, pack, pick, group_key of draft picks, deck builds and sideboards.

    Records have kind, source, draft, match, pack, pick, cards (a pack), picked, pool, deck (built), offered, side and chosen.  A record that
    gives no example is a row without one; a deck is a row for each card put in, and none if the copies of any step don't fit.
    """
    none = F.array().cast("array<bigint>")
    cards = lambda c: F.coalesce(F.col(c), none)
    empty = lambda c: F.size(cards(c)) == 0
    one = lambda context, candidates, chosen: F.array(F.struct(F.lit(0).alias("place"), context.alias("context"), candidates.alias("candidates"), positives(candidates, chosen).alias("positives")))
    offered = F.concat(cards("offered"), cards("side"))
    kind = F.col("kind")
    steps = F.when(kind == "draftPick", one(cards("pool"), cards("cards"), cards("picked"))).when(kind == "deckBuild", deck_steps(cards("pool"), cards("deck"))).when(kind == "sideboard", one(cards("offered"), offered, cards("chosen")))
    rows = records.withColumn("steps_", steps)
    fits = F.coalesce(F.forall("steps_", lambda s: s["positives"].isNotNull()), F.lit(True))
    first = F.size(F.get(F.col("steps_"), F.lit(0))["positives"]) > 0
    reason = (
        F.when(kind == "draftPick", F.when(~empty("cards") & fits & first, "examples_draftPick").otherwise("skipped_unaligned_pick"))
        .when(kind == "deckBuild", F.when(empty("pool"), "skipped_build_without_pool").when(fits, "examples_deckBuild").otherwise("skipped_unaligned_build"))
        .when(kind == "sideboard", F.when((F.size(offered) > 0) & fits & first, "examples_sideboard").otherwise("skipped_unaligned_sideboard"))
        .otherwise("skipped_unknown_kind")
    )
    rows = rows.withColumn("reason", reason).withColumn("steps_", F.when(F.col("reason").startswith("examples"), F.col("steps_")))
    group = F.when(kind == "sideboard", F.col("match").cast("string")).otherwise(F.concat_ws(":", "source", F.col("draft").cast("string")))
    flat = rows.select(*keys, "kind", "reason", group.alias("group_key"), "pack", "pick", F.posexplode_outer("steps_").alias("step", "s"))
    made = F.col("s").isNotNull()
    return flat.select(*keys, "kind", "reason", F.when(made, F.col("kind")).alias("mode"), "step", "s.context", "s.candidates", "s.positives", F.when(kind == "draftPick", F.col("pack")).alias("pack"), F.when(kind == "draftPick", F.col("pick")).alias("pick"), "group_key")


def benchmark_rows(df: DataFrame, current: Column, select: Column, index: Column, cluster: Column) -> DataFrame:
    """A row for each decision: index, fingerprint, occurrence, cluster, eligible, chosen_group, prompt, options, bucket, source.

    A decision of one chosen option among its options is eligible; current and select (JSON texts) make the fingerprint.
    """
    n, pick = F.coalesce(option_count(), F.lit(0)), F.try_element_at("selectedIndices", F.lit(1))
    eligible = F.coalesce((n > 0) & (F.size("selectedIndices") == 1) & (pick >= 0) & (pick < n), F.lit(False))
    rows = df.select(index.cast("long").alias("index"), J.decision_fingerprint(current, select).alias("fingerprint"), cluster.alias("cluster_"), eligible.alias("eligible"), F.get(F.col("select.option"), pick.cast("int")).alias("o_"), prompt_type().alias("prompt_"), n.cast("long").alias("options"), F.col("source").alias("source_"))
    return rows.select(
        "index", "fingerprint", F.concat_ws("#", "fingerprint", "index").alias("occurrence"), F.coalesce(F.col("cluster_").cast("string"), F.concat(F.lit("decision-"), "index")).alias("cluster"), "eligible",
        F.when(F.col("eligible"), option_key(F.col("o_"))).alias("chosen_group"), F.coalesce("prompt_", F.lit("unknown")).alias("prompt"), "options", option_bucket(F.col("options")).alias("bucket"), F.coalesce("source_", F.lit("unknown")).alias("source"),
    )
