"""Native logs, plain scorers, readable analyses, comparisons of models, sideboards, open zones, redacted history, checked preferences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.operators.cards import parse_sentence, same_multiset, worth_keeping
from ledgerline.operators.labels import preference_errors, preferred_side
from ledgerline.operators.log_events import at, first_at, is_kind
from ledgerline.sources.files import read_jsonl

#: Patterns of log lines besides sentences.
JOINED = r"(?i)^(.+?) joined the game"
GAME_ID = r"(?i)\b(?:game|game id)\s*#?:?\s*(8\d{8})\b"
TURN = r"(?i)^(?:turn\s+)?(\d+):?\s*(.+?)'?s turn"
WINNER = r"(?i)^(.+?) wins the game"
#: What a kind of action is worth, the first part that its name holds.
SHAPES = {"CAST": 3.0, "PLAY_LAND": 2.5, "ACTIVATE": 2.0, "ATTACK": 1.5, "BLOCK": 1.0, "MULLIGAN": 0.0}
#: Zones, and the fields of a state that hold them.
ZONES = ("global", "player", "battlefield", "stack", "hand", "graveyard", "exile", "library", "command", "sideboard", "history", "other")
OWN_FIELDS = ("battlefield", "stack", "exile", "command", "library", "sideboard", "graveyard", "hand")
BY_SEAT = {"hands": "hand", "graveyards": "graveyard", "libraries": "library"}
SEATS = ("seat", "playerIndex", "controllerSeat", "ownerSeat", "controllerId", "ownerId")


def native_log(lines: DataFrame) -> DataFrame:
    """Lines (doc, place, line) with joined, actor, action_type, card, target, turn and unparsed.

    A turn line opens a turn that later lines carry; a line of no kind is unparsed if it is worth keeping.  Players are named
    player:n by their first mention in the document, whatever the case and the spaces of their names.
    """
    group = lambda p, n: F.nullif(F.regexp_extract("line", p, n), F.lit(""))
    plain = lambda c: F.nullif(F.lower(F.trim(F.regexp_replace(c, r"\s+", " "))), F.lit(""))
    turn, won = group(TURN, 1).try_cast("int"), group(WINNER, 1)
    rows = lines.withColumns({"turn_": turn, "won_": won, "s_": parse_sentence(F.col("line"))})
    own = F.col("turn_").isNull() & F.col("won_").isNull()
    rows = rows.withColumns({
        "joined": plain(group(JOINED, 1)),
        "actor": plain(F.when(F.col("turn_").isNotNull(), group(TURN, 2)).when(F.col("won_").isNotNull(), F.col("won_")).otherwise(F.col("s_.actor"))),
        "action_type": F.when(F.col("turn_").isNotNull(), "TURN_START").when(F.col("won_").isNotNull(), "GAME_WIN").otherwise(F.col("s_.action_type")),
        "card": F.when(own, F.col("s_.card")),
        "target": F.when(own, F.col("s_.target")),
        "turn": F.last("turn_", True).over(Window.partitionBy("doc").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)),
    })
    rows = rows.withColumn("unparsed", F.col("action_type").isNull() & worth_keeping(F.col("line"))).drop("turn_", "won_", "s_")
    said = rows.select("doc", "place", F.posexplode(F.array("joined", "actor")).alias("part", "name")).where("name is not null")
    first = said.groupBy("doc", "name").agg(F.min(F.struct("place", "part")).alias("first_"))
    alias = first.select("doc", "name", F.concat(F.lit("player:"), F.row_number().over(Window.partitionBy("doc").orderBy("first_"))).alias("alias"))
    for c in ("joined", "actor"):
        rows = rows.join(alias.select("doc", F.col("name").alias(c), F.col("alias").alias("alias_")), ["doc", c], "left").drop(c).withColumnRenamed("alias_", c)
    return rows


def native_summary(events: DataFrame) -> DataFrame:
    """doc, records, actions, unparsed, players and game_ids (in order of first mention) of native_log's rows."""
    in_order = lambda df, c: df.groupBy("doc", c).agg(F.min("at_").alias("at_")).groupBy("doc").agg(F.transform(F.sort_array(F.collect_list(F.struct("at_", c))), lambda x: x[c]).alias(f"{c}_list"))
    players = in_order(events.where("joined is not null").select("doc", "joined", F.col("place").alias("at_")), "joined")
    ids = in_order(events.select("doc", "place", F.posexplode(F.regexp_extract_all("line", F.lit(GAME_ID), F.lit(1))).alias("part", "id")).select("doc", "id", F.struct("place", "part").alias("at_")), "id")
    parsed = F.col("action_type").isNotNull() & ~F.col("action_type").isin("TURN_START", "GAME_WIN")
    counts = events.groupBy("doc").agg(F.count("*").alias("records"), F.count_if(parsed).alias("actions"), F.count_if("unparsed").alias("unparsed"))
    none = F.array().cast("array<string>")
    return counts.join(players, "doc", "left").join(ids, "doc", "left").select("doc", "records", "actions", "unparsed", F.coalesce("joined_list", none).alias("players"), F.coalesce("id_list", none).alias("game_ids"))


def shape_score(kind: Column, label: Column) -> Column:
    """What an option's kind and label alone are worth: -100 to concede, -1 to pass, else by the kind of action, 0.5 for any other."""
    kind, label = F.upper(F.coalesce(kind, F.lit(""))), F.lower(F.coalesce(label, F.lit("")))
    out = F.when(kind.contains("CONCEDE") | label.contains("concede"), -100.0).when(kind.contains("PASS") | (label == "pass"), -1.0)
    for part, worth in SHAPES.items():
        out = out.when(kind.contains(part), worth)
    return out.otherwise(0.5)


def seeded_score(fingerprint: Column, seed: int, idx: Column) -> Column:
    """A number in [0, 1] drawn by sha256 of 'fingerprint|seed|idx': its first 64 bits."""
    digest = F.sha2(F.concat_ws("|", fingerprint, F.lit(str(seed)), idx.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / float(2**64)


def analysis_text(model: Column, untrained: Column, top: Column, rank: Column, max_rows: int | None = None) -> Column:
    """Readable lines of an analysis: the model, its top options (label, probability, score) and the rank of what was played."""
    title = F.concat(F.coalesce(F.nullif(model, F.lit("")), F.lit("model")), F.when(F.coalesce(untrained, F.lit(False)), " (untrained)").otherwise(""))
    best = F.get(top, F.lit(0))["label"]
    shown = F.slice(top, 1, max_rows) if max_rows else top
    line = lambda r, i: F.concat((i + 1).cast("string"), F.lit(". "), F.coalesce(r["label"], F.lit("None")), F.lit("  "), F.when(r["probability"].isNotNull(), F.format_string("%.1f%%", 100 * r["probability"])).otherwise(F.format_string("%.4f", F.coalesce(r["score"], F.lit(0.0)))))
    played = F.when(rank == 1, "✓ Played rank: 1 — the model's top pick").when(rank.isNotNull(), F.concat(F.lit("✗ Played rank: "), rank.cast("string"), F.coalesce(F.concat(F.lit(" — model preferred "), F.nullif(best, F.lit(""))), F.lit(""))))
    lines = F.concat(F.array(F.concat(F.lit("Model analysis · "), title)), F.coalesce(F.transform(shown, line), F.array().cast("array<string>")), F.array_compact(F.array(played)))
    return F.array_join(lines, "\n")


def comparison(decisions: DataFrame, analyses: DataFrame, models: list[str]) -> DataFrame:
    """Decisions (fingerprint, human, ...) with cells, one a model in the order given, and agreement.

    analyses: fingerprint, model, created, place, top (identities, best first), chosen_rank.  The latest of a model counts.  A
    cell has covered, top and played_rank: the place of human among the distinct identities, else chosen_rank.  agreement is
    unscored, all-agree, partial-agree (some models are missing) or disagree.
    """
    cell = F.struct("model", F.max_by(F.struct("top", "chosen_rank"), F.struct("created", "place")).alias("a"))
    latest = analyses.where(F.col("model").isin(models)).groupBy("fingerprint", "model").agg(cell["a"].alias("a"))
    found = latest.groupBy("fingerprint").agg(F.map_from_entries(F.collect_list(F.struct("model", "a"))).alias("found_"))
    rows = decisions.join(found, "fingerprint", "left")

    def one(model):
        a = F.try_element_at("found_", F.lit(model))
        rank = F.coalesce(F.nullif(F.array_position(F.array_distinct(a["top"]), F.col("human")), F.lit(0).cast("long")), a["chosen_rank"].cast("long"))
        return F.struct(F.lit(model).alias("model"), a.isNotNull().alias("covered"), F.get(a["top"], F.lit(0)).alias("top"), rank.alias("played_rank"))

    rows = rows.withColumn("cells", F.array(*map(one, models))).drop("found_")
    tops = F.array_compact(F.transform("cells", lambda c: c["top"]))
    one_top = F.size(F.array_distinct(tops)) == 1
    return rows.withColumn("agreement", F.when(F.size(tops) == 0, "unscored").when(one_top & (F.size(tops) == len(models)), "all-agree").when(one_top, "partial-agree").otherwise("disagree"))


def comparison_metrics(rows: DataFrame) -> DataFrame:
    """model, covered, coverage, top1 and mrr (both of what is covered) of comparison's rows."""
    each = rows.select(F.explode("cells").alias("c")).select("c.*")
    ranks = each.groupBy("model").agg(F.count("*").alias("n"), F.count_if("covered").alias("covered"), F.count_if(F.col("covered") & (F.col("played_rank") == 1)).alias("first_"), F.coalesce(F.sum(F.when(F.col("covered"), 1 / F.nullif(F.col("played_rank"), F.lit(0).cast("long")))), F.lit(0.0)).alias("sum_"))
    share = lambda x: F.when(F.col("covered") > 0, F.col(x) / F.col("covered")).otherwise(0.0)
    return ranks.select("model", "covered", (F.col("covered") / F.col("n")).alias("coverage"), share("first_").alias("top1"), share("sum_").alias("mrr"))


def draft_picks(packs: DataFrame, picks: DataFrame) -> DataFrame:
    """source, draft, pack, pick, offered, picked, pool (what was picked before, in order) and reason of picks (source, draft, pack, pick, place, cards).

    A place of a draft keeps its first pack (source, draft, pack, pick, place, cards) and its last pick.  Without a pack the reason
    is 'picks_missing_pack', but the pick joins the pool; a card that the pack didn't offer raises.
    """
    key = ["source", "draft", "pack", "pick"]
    none = F.array().cast("array<long>")
    made = picks.groupBy(*key).agg(F.max_by(F.coalesce("cards", none), "place").alias("picked"))
    offers = packs.groupBy(*(F.col(k).alias(f"{k}_") for k in key)).agg(F.min_by(F.coalesce("cards", none), "place").alias("offered"))
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"{k}_")) for k in key))
    rows = made.join(offers, same, "left").drop(*(f"{k}_" for k in key))
    before = Window.partitionBy("source", "draft").orderBy(F.coalesce("pack", F.lit(0)), F.coalesce("pick", F.lit(0))).rowsBetween(Window.unboundedPreceding, -1)
    missing = F.array_except("picked", "offered")
    wrong = F.concat_ws(" ", F.lit("picked cards"), F.array_join(missing.cast("array<string>"), ","), F.lit("not offered in draft"), "draft", F.lit("pack"), "pack", F.lit("pick"), "pick", F.lit("of"), "source")
    checked = F.when(F.size(missing) > 0, F.raise_error(wrong).cast("array<long>")).otherwise(F.col("picked"))
    rows = rows.withColumns({"picked": checked, "pool": F.flatten(F.collect_list("picked").over(before))})
    return rows.withColumn("reason", F.when(F.col("offered").isNull(), "picks_missing_pack").otherwise("picks_compiled"))


def draft_stats(picks: DataFrame, builds: DataFrame, boards: DataFrame) -> DataFrame:
    """counter, n over draft_picks's rows, deck builds (source, draft, recovered and their content) and sideboards's rows.

    A build whose draft is null has no pool of its own, one that is recovered got one from another source; records that are
    equal but for their source are duplicates and dropped.  Counters without rows are left out.
    """
    count = lambda df, counter: df.groupBy(counter.alias("counter")).agg(F.count("*").alias("n"))
    compiled = lambda df: df.where(F.col("reason").endswith("_compiled"))

    def dropped(df):
        own = [c for c in df.columns if c not in ("source", "place", "recovered", "reason")]
        return df.groupBy(*own).agg((F.count("*") - 1).alias("n")).where("n > 0").select(F.lit("duplicates_dropped").alias("counter"), "n")

    flags = F.array_compact(F.array(F.lit("deck_builds_compiled"), F.when(F.col("draft").isNull() | F.coalesce("recovered", F.lit(False)), "deck_builds_without_pool"), F.when(F.col("recovered"), "deck_builds_pool_recovered")))
    parts = [count(picks, F.col("reason")), count(boards, F.col("reason")), count(builds.select(F.explode(flags).alias("f")), F.col("f")), dropped(compiled(picks)), dropped(builds), dropped(compiled(boards))]
    return reduce(DataFrame.unionByName, parts).groupBy("counter").agg(F.sum("n").alias("n"))


def sideboards(prompts: DataFrame, submits: DataFrame) -> DataFrame:
    """Submits (match, resp, place, deck, side) with game, offered_deck, offered_side, changed and reason.

    The last prompt (match, resp, place, game, deck, side) of the same match and number is answered; without one the reason is
    'sideboards_missing_prompt' and nothing else is known.  A deck has changed if its cards, in any order, differ.
    """
    none = F.array().cast("array<long>")
    offer = F.struct("game", F.coalesce("deck", none).alias("deck"), F.coalesce("side", none).alias("side"))
    last = prompts.groupBy(F.col("match").alias("m_"), F.col("resp").alias("r_")).agg(F.max_by(offer, "place").alias("o_"))
    rows = submits.join(last, F.col("match").eqNullSafe(F.col("m_")) & F.col("resp").eqNullSafe(F.col("r_")), "left").drop("m_", "r_")
    changed = F.when(F.col("o_").isNotNull(), ~same_multiset(F.col("o_.deck"), F.coalesce("deck", none)))
    return rows.withColumns({"game": F.col("o_.game"), "offered_deck": F.col("o_.deck"), "offered_side": F.col("o_.side"), "changed": changed, "reason": F.when(F.col("o_").isNull(), "sideboards_missing_prompt").otherwise("sideboards_compiled")}).drop("o_")


def zone_objects(states: DataFrame, state: str = "state") -> DataFrame:
    """One row for each object of the zones of a state (VARIANT): the frame's other columns, zone, seat, place, object.

    Either a map of zones, each a list of objects or lists by seat, or such fields of the state itself.  Names are singular and
    lower case, an unknown one is 'other'; bare counts hold no objects; in a plain list the object names its seat.
    """
    listed = lambda v: F.when(is_kind(v, "ARRAY"), F.try_variant_get(v, "$", "array<variant>"))
    mapped = lambda v: F.when(is_kind(v, "OBJECT"), F.try_variant_get(v, "$", "map<string, variant>"))
    group = lambda zone, seat, items: F.struct(zone.alias("zone"), seat.alias("seat"), items.alias("items"))
    nobody, nothing = F.lit(None).cast("string"), F.array().cast("array<struct<zone:string,seat:string,items:array<variant>>>")
    whole = lambda zone, v: F.array(group(zone, nobody, listed(v)))
    by_seat = lambda zone, v: F.coalesce(F.transform(F.map_entries(mapped(v)), lambda e: group(zone, e["key"], listed(e["value"]))), nothing)

    def zone_of(name):
        text = F.lower(name)
        short = F.regexp_replace(text, "s$", "")
        return F.when(text.endswith("s") & short.isin(*ZONES), short).when(text.isin(*ZONES), text).otherwise("other")

    value = F.col(state)
    zones = mapped(at(value, "zones", "variant"))
    inside = F.flatten(F.transform(F.map_entries(zones), lambda e: F.concat(whole(zone_of(e["key"]), e["value"]), by_seat(zone_of(e["key"]), e["value"]))))
    beside = F.concat(*(whole(F.lit(k), at(value, k, "variant")) for k in OWN_FIELDS), *(by_seat(F.lit(z), at(value, k, "variant")) for k, z in BY_SEAT.items()))
    rest = [c for c in states.columns if c != state]
    groups = states.select(*rest, F.explode(F.when(zones.isNotNull(), inside).otherwise(beside)).alias("g_"))
    each = groups.select(*rest, "g_.zone", F.col("g_.seat").alias("seat"), F.posexplode("g_.items").alias("place", "object"))
    return each.withColumn("seat", F.coalesce("seat", F.when(is_kind(F.col("object"), "OBJECT"), first_at(F.col("object"), SEATS))))


def redacted_history(events: DataFrame, kind: str, raw_kinds: tuple[str, ...], raw_fields: tuple[str, ...]) -> DataFrame:
    """Events whose kind is raw lose the raw fields and are stamped redacted; others stay, without the stamp."""
    raw = F.coalesce(F.col(kind).isin(*raw_kinds), F.lit(False))
    return events.withColumns({c: F.when(~raw, F.col(c)) for c in raw_fields if c in events.columns} | {"redacted": F.when(raw, True)})


def read_preferences(spark: SparkSession, path: str, factors: list[str]) -> DataFrame:
    """file, line, context, expert, preferred, confidence, weight, left, right (factors to numbers) of preference JSONL.

    The first fault of a line raises file:line: fault; without any example it raises ValueError.
    """
    rows, _ = read_jsonl(spark, path)
    if rows.isEmpty():
        raise ValueError("preference file contains no examples")
    faults = preference_errors(F.col("record"), factors)
    fault = F.raise_error(F.concat_ws(":", "file", "line", F.concat(F.lit(" "), F.get(faults, F.lit(0)))))
    record = F.col("record")
    checked = rows.withColumn("record", F.when(F.size(faults) > 0, fault.cast("variant")).otherwise(record))
    one = lambda k, kind, default: F.coalesce(at(record, k, kind), F.lit(default))
    return checked.select(
        "file", "line", first_at(record, ("contextId", "decisionId", "id")).alias("context"), one("expert", "string", "").alias("expert"), preferred_side(at(record, "preferred", "variant")).alias("preferred"),
        one("confidence", "double", 1.0).alias("confidence"), one("weight", "double", 1.0).alias("weight"), *(at(record, f"{s}.factors", "map<string, double>").alias(s) for s in ("left", "right")),
    )


def service_report(requests: DataFrame, errors: DataFrame) -> DataFrame:
    """agent, prompt, requests, failed, options (mean), median, p95 and most of the latency, and the most frequent error.

    requests: agent, prompt, options, latency; errors: agent, prompt, error.  An unnamed agent is 'random'.
    """
    keys = [F.coalesce("agent", F.lit("random")).alias("agent"), F.coalesce("prompt", F.lit("UNKNOWN")).alias("prompt")]
    good = requests.groupBy(*keys).agg(F.count("*").alias("requests"), F.avg("options").alias("options"), F.percentile("latency", F.lit(0.5)).alias("median"), F.percentile("latency", F.lit(0.95)).alias("p95"), F.max("latency").alias("most"))
    kinds = errors.groupBy(*keys, "error").agg(F.count("*").alias("n"))
    bad = kinds.groupBy("agent", "prompt").agg(F.sum("n").alias("failed"), F.min_by("error", F.struct(-F.col("n"), "error")).alias("error"))
    return good.join(bad, ["agent", "prompt"], "full").fillna(0, ["requests", "failed"])


def best_attempts(attempts: DataFrame, keys: list[str], score: str, name: str, order: list[str], gate: float = 0.60, kept: int = 8) -> DataFrame:
    """keys, status, accepted (the name, where accepted), best (the best row) and evidence (the best few rows, best first).

    The highest score is best, ties by order; it is accepted if it has a name and its score reaches the gate.  Places come from
    a window by key, so that no more rows than are kept are collected.
    """
    own = [c for c in attempts.columns if c not in keys]
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc_nulls_last(score), *order))
    rows = attempts.withColumn("place_", place).where(F.col("place_") <= kept)
    found = rows.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("place_", F.struct(*own).alias("a")))), lambda x: x["a"]).alias("evidence")).withColumn("best", F.get("evidence", F.lit(0)))
    good = F.coalesce((F.col(f"best.{name}") != "") & (F.col(f"best.{score}") >= gate), F.lit(False))
    return found.select(*keys, F.when(good, "accepted").otherwise("below-threshold").alias("status"), F.when(good, F.col(f"best.{name}")).alias("accepted"), "best", "evidence")
