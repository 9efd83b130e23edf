"""Cards, decks, options and scores: smaller record operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words that make a log line worth keeping.
SIGNALS = ("draw", "cast", "play", "attack", "block", "damage", "counter", "target", "trigger", "mulligan", "keep", "concede", "wins", "loses")
#: Sentence patterns of game logs, the first that fits wins (actor, card, target or amount by name).
SENTENCES = {
    "CAST_SPELL": r"(?i)^(?<actor>.+?) casts (?<card>.+?)(?: targeting (?<target>.+))?\.?$",
    "PLAY_LAND": r"(?i)^(?<actor>.+?) plays (?<card>.+?)\.?$",
    "ACTIVATE_ABILITY": r"(?i)^(?<actor>.+?) activates (?:an ability of )?(?<card>.+?)(?: targeting (?<target>.+))?\.?$",
    "ATTACK": r"(?i)^(?<actor>.+?) attacks with (?<card>.+?)\.?$",
    "BLOCK": r"(?i)^(?<actor>.+?) blocks with (?<card>.+?)\.?$",
    "DRAW": r"(?i)^(?<actor>.+?) draws? (?:a card|(?<card>.+?))\.?$",
    "DISCARD": r"(?i)^(?<actor>.+?) discards (?<card>.+?)\.?$",
    "SACRIFICE": r"(?i)^(?<actor>.+?) sacrifices (?<card>.+?)\.?$",
    "DESTROY": r"(?i)^(?<card>.+?) is destroyed\.?$",
    "GAIN_LIFE": r"(?i)^(?<actor>.+?) gains (?<amount>\d+) life\.?$",
    "LOSE_LIFE": r"(?i)^(?<actor>.+?) loses (?<amount>\d+) life\.?$",
    "CONCEDE": r"(?i)^(?<actor>.+?) concedes\.?$",
    "MULLIGAN": r"(?i)^(?<actor>.+?) mulligans?.*$",
    "KEEP": r"(?i)^(?<actor>.+?) keeps? (?:their )?hand.*$",
}


def worth_keeping(line: Column) -> Column:
    return F.lower(F.coalesce(line, F.lit(""))).rlike("|".join(SIGNALS))


def parse_sentence(line: Column) -> Column:
    """action_type, actor, card, target, amount of a log line; null if none fits."""
    out = F
    for kind, pattern in SENTENCES.items():
        names = [p.split(">")[0] for p in pattern.split("(?<")[1:]]
        group = lambda n: F.when(F.regexp_extract(line, pattern, names.index(n) + 1) != "", F.regexp_extract(line, pattern, names.index(n) + 1)) if n in names else F.lit(None).cast("string")  # noqa: B023, E731
        row = F.struct(F.lit(kind).alias("action_type"), *(group(n).alias(n) for n in ("actor", "card", "target", "amount")))
        out = out.when(line.rlike(pattern), row)
    return out


def expand_deck(entries: DataFrame, card: str, quantity: str) -> DataFrame:
    """Each id repeated max(1, quantity) times."""
    return entries.withColumn(card, F.explode(F.array_repeat(card, F.greatest(F.lit(1), F.col(quantity).cast("int")))))


def card_ids(value: Column) -> Column:
    """Whole numbers of a comma list."""
    return F.filter(F.transform(F.split(value, ","), lambda x: F.trim(x).try_cast("bigint")), lambda x: x.isNotNull())


def validate_decks(entries: DataFrame, cards: DataFrame, deck: str, name: str, known: str) -> DataFrame:
    """deck, valid, missing (sorted names that do not resolve)."""
    joined = entries.join(cards.select(F.col(known).alias(name), F.lit(True).alias("known_")).distinct(), name, "left")
    missing = F.array_sort(F.collect_set(F.when(F.col("known_").isNull(), F.col(name))))
    return joined.groupBy(deck).agg(missing.alias("missing")).withColumn("valid", F.size("missing") == 0)


def same_multiset(a: Column, b: Column) -> Column:
    return F.array_sort(a).eqNullSafe(F.array_sort(b))


def first_failure(checks: list[tuple[str, Column]]) -> Column:
    """The code of the first check that holds, null if none: checks are conditions of failure."""
    out = F
    for code, failed in checks:
        out = out.when(failed, code)
    return out


def forbidden_keys(json: Column, names: tuple[str, ...]) -> Column:
    """True if any key at any depth, letters and digits in lower case, is forbidden."""
    keys = F.transform(F.regexp_extract_all(json, F.lit(r'"((?:[^"\\]|\\.)*)"\s*:'), 1), lambda k: F.lower(F.regexp_replace(k, "[^A-Za-z0-9]", "")))
    return F.arrays_overlap(keys, F.array(*map(F.lit, names)))


def actor_alias(df: DataFrame, doc: str, actor: str, order: str) -> DataFrame:
    """alias 'player:n' by first appearance in the document."""
    first = df.where(F.col(actor).isNotNull()).groupBy(doc, actor).agg(F.min(order).alias("first_"))
    named = first.withColumn("alias", F.concat(F.lit("player:"), F.row_number().over(Window.partitionBy(doc).orderBy("first_", actor))))
    return df.join(named.drop("first_"), [doc, actor], "left")


def counter_map(df: DataFrame, keys: list[str], kind: str, n: str) -> DataFrame:
    """One summed map for each key."""
    sums = df.groupBy(*keys, kind).agg(F.sum(n).alias("n_"))
    return sums.groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(kind, "n_")))).alias("counters"))


def zone_summary(df: DataFrame, keys: list[str], name: str, k: int = 8) -> DataFrame:
    """The first k names in order with 'xn' where there are several, then the total."""
    counts = df.groupBy(*keys, name).agg(F.count("*").alias("n_"))
    rows = F.sort_array(F.collect_list(F.struct(name, "n_")))
    shown = F.transform(F.slice(rows, 1, k), lambda r: F.when(r["n_"] > 1, F.concat(r[name].cast("string"), F.lit(" x"), r["n_"])).otherwise(r[name].cast("string")))
    return counts.groupBy(*keys).agg(F.concat(F.array_join(shown, ", "), F.lit(" ("), F.sum("n_"), F.lit(")")).alias("summary"))


def utility(factors: dict[str, float], row: dict[str, Column]) -> Column:
    """Weighted sum of oriented factors."""
    out = F.lit(0.0)
    for name, weight in factors.items():
        out = out + row[name] * weight
    return out


def shaping(before: Column, after: Column, gamma: float) -> Column:
    return gamma * after - before


def option_match(options: DataFrame, keys: list[str], kind: Column, family: Column, card: Column, target: Column, line: Column) -> DataFrame:
    """score and rank of legal options for an observed action: same type .45 (same family .28), card .38, target .12, line .05."""
    zero = lambda c, w: F.when(F.coalesce(c, F.lit(False)), w).otherwise(0.0)
    score = F.when(F.coalesce(kind, F.lit(False)), 0.45).otherwise(zero(family, 0.28)) + zero(card, 0.38) + zero(target, 0.12) + zero(line, 0.05)
    rows = options.withColumn("score", F.round(score, 6))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "idx")).cast("long"))


def selection_metrics(options: DataFrame, keys: list[str], score: str, positive: str) -> DataFrame:
    """Of each decision with positives: top1, recall at as many as there are, reciprocal rank of the best."""
    order = Window.partitionBy(*keys).orderBy(F.desc(score), "idx")
    rows = options.withColumns({"r_": F.row_number().over(order), "k_": F.sum(F.col(positive).cast("int")).over(Window.partitionBy(*keys))})
    good = F.col(positive)
    per = rows.where("k_ > 0").groupBy(*keys).agg(F.max((good & (F.col("r_") == 1)).cast("double")).alias("top1"), (F.sum((good & (F.col("r_") <= F.col("k_"))).cast("double")) / F.first("k_")).alias("recall"), (1 / F.min(F.when(good, F.col("r_")))).alias("rr"))
    return per.agg(F.count("*").alias("decisions"), F.round(F.avg("top1"), 6).alias("top1"), F.round(F.avg("recall"), 6).alias("recall"), F.round(F.avg("rr"), 6).alias("mrr"))


def merged_reading(first: Column, first_confidence: Column, second: Column, second_confidence: Column) -> Column:
    """The second reading only where its confidence is higher."""
    return F.when(F.coalesce(second_confidence, F.lit(0.0)) > F.coalesce(first_confidence, F.lit(0.0)), second).otherwise(first)


def assemble_entries(lines: DataFrame, file: str, order: str, value: str, header: str) -> DataFrame:
    """Multi-line entries: a line that fits the header pattern opens one, the following lines belong to it."""
    starts = F.when(F.col(value).rlike(header), 1).otherwise(0)
    rows = lines.withColumn("entry", F.sum(starts).over(Window.partitionBy(file).orderBy(order))).where("entry > 0")
    return rows.groupBy(file, "entry").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, value))), lambda r: r[value]), "\n").alias("text"), F.count("*").alias("lines"))


def extract_json(text: Column) -> Column:
    """The text from the first '{', else the first '[', on; null without either."""
    at = F.when(F.instr(text, "{") > 0, F.instr(text, "{")).otherwise(F.instr(text, "["))
    return F.when(at > 0, F.substr(text, at))


def unwrap_payload(text: Column, depth: int = 3) -> Column:
    """The innermost payload of nested payload, Payload or request wrappers, JSON texts decoded."""
    out = text
    for _ in range(depth):
        inner = F.coalesce(*(F.get_json_object(out, f"$.{k}") for k in ("payload", "Payload", "request")))
        out = F.coalesce(inner, out)
    return out
