"""Queries of training examples and uploads, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.operators import catalog as C
from ledgerline.operators import examples as E
from ledgerline.operators import features as X
from ledgerline.operators import labels as L
from ledgerline.operators import uploads as U
from ledgerline.operators.log_events import let
from ledgerline.plans.board_queries import SHOWN_SQL, shown
from ledgerline.plans.registry import query
from ledgerline.plans.scratch import shared_folder
from ledgerline.plans.stream_queries import as_json
from ledgerline.plans.views import OPTIONS_SQL, decisions, option_rows, read

WITH = f"WITH {OPTIONS_SQL}"


def flawed(spark, sf_dir):
    """Decisions, of which some have no options, two selected indices, or one that is none of theirs; and state, a text."""
    df, k = decisions(spark, sf_dir), F.col("decision") % 11
    options = F.when(k == 1, F.slice("select.option", 1, 0)).otherwise(F.col("select.option"))
    selected = F.when(k == 2, F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))).when(k == 3, F.array(F.lit(99).cast("long"))).otherwise(F.col("selectedIndices"))
    state = X.state_text({"turn": F.col("sequenceNumber"), "prompt": F.col("select.type"), "id": F.col("decision")})
    return df.withColumn("select", F.col("select").withField("option", options)).withColumn("selectedIndices", selected).withColumn("state", state)


FLAWED_SQL = f"""{OPTIONS_SQL}, tx AS (SELECT decision, kind, idx, akey, 'type=' || kind || ' | label=' || label || coalesce(' | key=' || akey, '') AS text,
  CASE WHEN akey IS NULL THEN 'index:' || idx ELSE kind || '|' || akey END AS k FROM opt),
gr AS (SELECT decision, k, min(idx) AS first, list(idx ORDER BY idx) AS members FROM tx GROUP BY 1, 2),
gs AS (SELECT decision, string_agg(array_to_string(members, ','), ';' ORDER BY first) AS groups FROM gr GROUP BY 1),
ch AS (SELECT gr.decision, count(*) FILTER (h.first < gr.first) AS chosen_group FROM gr JOIN dec ON dec.decision = gr.decision AND list_contains(members, pick) JOIN gr h ON h.decision = gr.decision GROUP BY gr.decision, gr.first),
ts AS (SELECT decision, string_agg(text, ';' ORDER BY idx) AS texts, string_agg(kind, ',' ORDER BY idx) AS types FROM tx GROUP BY 1)"""
STATE_SQL = "'turn=' || seq || ' | prompt=' || prompt || ' |'"


@query(
    f"""WITH {FLAWED_SQL}, r AS (SELECT *, CASE decision % 11 WHEN 1 THEN 'discarded_no_options' WHEN 2 THEN 'discarded_multi_select' WHEN 3 THEN 'discarded_invalid' ELSE 'compiled' END AS reason FROM dec JOIN ts USING (decision))
SELECT decision, reason, CASE WHEN reason = 'compiled' THEN prompt END AS prompt, CASE WHEN reason = 'compiled' THEN {STATE_SQL} END AS state, CASE WHEN reason = 'compiled' THEN texts END AS options,
  CASE WHEN reason = 'compiled' THEN types END AS types, CASE WHEN reason = 'compiled' THEN pick END AS pick FROM r"""
)
def compile_examples(spark, sf_dir):
    df = flawed(spark, sf_dir)
    rows = E.compiled(df, F.col("state"))
    return rows.select("decision", "reason", F.col("example.promptType").alias("prompt"), F.col("example.stateText").alias("state"), F.array_join("example.optionTexts", ";").alias("options"), F.array_join("example.optionTypes", ",").alias("types"), F.col("example.chosenIndex").alias("pick"))


@query(
    f"""WITH {FLAWED_SQL}, r AS (SELECT *, CASE decision % 11 WHEN 1 THEN 'skipped_no_options' WHEN 2 THEN 'skipped_multi_or_no_select' WHEN 3 THEN 'skipped_bad_index' ELSE 'kept' END AS reason FROM dec JOIN ts USING (decision) JOIN gs USING (decision) JOIN ch USING (decision))
SELECT decision, reason, CASE WHEN reason = 'kept' THEN {STATE_SQL} END AS state, CASE WHEN reason = 'kept' THEN texts END AS options, CASE WHEN reason = 'kept' THEN groups END AS groups, CASE WHEN reason = 'kept' THEN chosen_group END AS chosen_group FROM r"""
)
def ranker_examples(spark, sf_dir):
    rows = E.ranked(flawed(spark, sf_dir), F.col("state"))
    groups = F.array_join(F.transform("example.groups", lambda g: F.array_join(g.cast("array<string>"), ",")), ";")
    return rows.select("decision", "reason", F.col("example.stateText").alias("state"), F.array_join("example.optionTexts", ";").alias("options"), groups.alias("groups"), F.col("example.chosenGroup").cast("long").alias("chosen_group"))


def deck_records(spark, sf_dir):
    """An order is a pick, a deck or a sideboard by its number; its lines (parts of nine kinds, so that copies occur) are pack, pool and decks."""
    card = lambda o: o["part"] % 9
    lines = F.transform("select.option", card)
    k, none = F.col("decision") % 5, F.array().cast("array<bigint>")
    some = lambda every: F.filter(lines, lambda c, i: i % every == 0)
    df = decisions(spark, sf_dir).select(
        "decision", F.when(k == 0, "draftPick").when(k.isin(1, 2), "deckBuild").when(k == 3, "sideboard").otherwise("other").alias("kind"), "source", F.col("gameId").alias("draft"), F.col("gameId").alias("match"), F.lit(1).alias("pack"), F.col("sequenceNumber").alias("pick"),
        lines.alias("cards"), F.when(F.col("decision") % 4 == 0, F.array(F.lit(77).cast("long"))).otherwise(F.slice(F.reverse(lines), 1, 1)).alias("picked"), F.when(F.col("decision") % 7 == 0, none).otherwise(lines).alias("pool"),
        F.concat(F.array(F.lit(50).cast("long")), F.when(F.col("decision") % 3 == 0, F.concat(some(1), some(2))).otherwise(some(2))).alias("deck"), some(2).alias("offered"), F.filter(lines, lambda c, i: i % 2 == 1).alias("side"), F.reverse(some(3)).alias("chosen"),
    )
    return df


@query(
    f"""{WITH}, l AS (SELECT decision, game, source, n, idx, part % 9 AS c, row_number() OVER (PARTITION BY decision, part % 9 ORDER BY idx) AS copy, count(*) OVER (PARTITION BY decision, part % 9) AS held FROM opt JOIN (SELECT decision, n FROM dec) USING (decision)),
b AS (SELECT *, decision % 7 = 0 AS bare FROM l WHERE decision % 5 IN (1, 2)),
k AS (SELECT decision, idx // 2 + 1 AS place, c, idx FROM b WHERE idx % 2 = 0 AND decision % 3 <> 0 UNION ALL
  SELECT decision, idx + 1, c, idx FROM b WHERE decision % 3 = 0 UNION ALL SELECT decision, n + idx // 2 + 1, c, idx FROM b WHERE idx % 2 = 0 AND decision % 3 = 0),
d AS (SELECT *, row_number() OVER (PARTITION BY decision, c ORDER BY place) AS nth, count(*) OVER (PARTITION BY decision, c) AS wanted FROM k),
t AS (SELECT d.*, held FROM d JOIN (SELECT DISTINCT decision, c, held FROM l) USING (decision, c)),
u AS (SELECT decision, bool_or(nth <= held AND EXISTS (SELECT 1 FROM t x WHERE x.decision = t.decision AND x.wanted > x.held AND x.held - (SELECT count(*) FROM t y WHERE y.decision = t.decision AND y.c = x.c AND y.place < t.place) > 0)) AS wrong FROM t GROUP BY 1),
s AS (SELECT decision, count(*) FILTER (nth <= held) AS steps, sum(CASE WHEN nth <= held THEN place END)::BIGINT AS contexts FROM t GROUP BY 1),
r AS (
  SELECT decision, CASE WHEN decision % 4 = 0 THEN 'skipped_unaligned_pick' ELSE 'examples_draftPick' END AS reason, 1 AS steps, CASE WHEN decision % 7 = 0 THEN 0 ELSE n END AS contexts FROM dec WHERE decision % 5 = 0
  UNION ALL SELECT decision, CASE WHEN decision % 7 = 0 THEN 'skipped_build_without_pool' WHEN wrong THEN 'skipped_unaligned_build' ELSE 'examples_deckBuild' END, steps, contexts FROM u JOIN s USING (decision)
  UNION ALL SELECT decision, 'examples_sideboard', 1, (n + 1) // 2 FROM dec WHERE decision % 5 = 3
  UNION ALL SELECT decision, 'skipped_unknown_kind', 1, 0 FROM dec WHERE decision % 5 = 4
)
SELECT decision, reason, CASE WHEN reason LIKE 'examples%' THEN steps ELSE 0 END::BIGINT AS examples, CASE WHEN reason LIKE 'examples%' THEN contexts ELSE 0 END::BIGINT AS contexts FROM r"""
)
def selection_examples(spark, sf_dir):
    rows = E.selections(deck_records(spark, sf_dir), ["decision"])
    return rows.groupBy("decision", "reason").agg(F.count("mode").alias("examples"), F.coalesce(F.sum(F.when(F.col("mode").isNotNull(), F.size("context"))), F.lit(0)).alias("contexts"))


@query(
    f"""WITH {SHOWN_SQL}, q AS (SELECT decision, kind, pick_idx, akey FROM (SELECT decision, kind, idx AS pick_idx, akey FROM opt WHERE chosen))
SELECT dec.decision AS index, fingerprint, fingerprint || '#' || dec.decision AS occurrence, dec.game::VARCHAR AS cluster, dec.decision % 11 NOT IN (1, 2, 3) AS eligible,
  CASE WHEN dec.decision % 11 NOT IN (1, 2, 3) THEN CASE WHEN akey IS NULL THEN 'index:' || pick_idx ELSE kind || '|' || akey END END AS chosen_group, dec.prompt, CASE WHEN dec.decision % 11 = 1 THEN 0 ELSE n END AS options,
  CASE WHEN n <= 1 OR dec.decision % 11 = 1 THEN '0-1' WHEN n <= 4 THEN '2-4' WHEN n <= 8 THEN '5-8' WHEN n <= 16 THEN '9-16' ELSE '17+' END AS bucket, source
FROM dec JOIN f USING (decision) JOIN q USING (decision)"""
)
def decision_rows(spark, sf_dir):
    df = flawed(spark, sf_dir).join(shown(spark, sf_dir).select("decision", "current", F.col("select").alias("shown")), "decision")
    return E.benchmark_rows(df, F.col("current"), F.col("shown"), F.col("decision"), F.col("gameId"))


KIND = "decision_upload"


def sent(spark, sf_dir):
    """o_orderkey, envelope: an order is an upload, sound or wrong in one of fifteen ways."""
    orders, lines = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").cast("int").alias("n"))
    k, n = F.col("o_orderkey") % 16, F.coalesce("n", F.lit(0))
    lit = F.lit
    good, last = lit('{"observation":{"a":1},"selected":[0]}'), n - 1
    bad = F.when(k == 9, '"x"').when(k == 10, '{"select":"","selected":[1]}').when(k == 11, '{"select":{},"selected":3}').when(k == 12, '{"select":{},"selectedIndices":null,"selected":[]}').otherwise(good)
    decisions_ = F.concat(lit("["), F.array_join(F.transform(F.sequence(lit(1), F.greatest(n, lit(1))), lambda i: F.when(i == F.greatest(n, lit(1)), bad).otherwise(good)), ","), lit("]"))
    consent = F.when(k == 2, "{}").when(k == 3, '{"allowTraining":1}').when(k == 4, '{"allowTraining":true,"allowPublicAggregateStats":"no"}').when(k == 13, "null").otherwise('{"allowTraining":true,"allowPublicAggregateStats":false}')
    body = F.concat(
        lit('{"kind":'), F.when(k == 1, '"other"').otherwise(f'"{KIND}"'), lit(',"consent":'), consent, lit(',"decisions":'), F.when(k == 5, "{}").when(k == 6, "[]").otherwise(decisions_),
        lit(',"manifest":'), F.when(k == 7, "0").otherwise("{}"), lit(',"redactionReport":'), F.when(k == 8, '{"rawPlayerLogUploaded":true}').when(k == 14, "{}").otherwise('{"rawPlayerLogUploaded":false}'), lit("}"),
    )
    return orders.join(lines, "o_orderkey", "left").select("o_orderkey", "o_custkey", F.when(k == 15, "7").otherwise(body).alias("envelope"))


@query(
    """SELECT o_orderkey, CASE o_orderkey % 16 WHEN 15 THEN 'BAD_ENVELOPE' WHEN 1 THEN 'BAD_KIND' WHEN 2 THEN 'NO_TRAINING_CONSENT' WHEN 3 THEN 'NO_TRAINING_CONSENT' WHEN 13 THEN 'NO_TRAINING_CONSENT' WHEN 4 THEN 'BAD_CONSENT'
  WHEN 5 THEN 'NO_DECISIONS' WHEN 6 THEN 'BAD_RECORD_COUNT' ELSE CASE WHEN n > 6 THEN 'BAD_RECORD_COUNT' WHEN o_orderkey % 16 = 7 THEN 'NO_MANIFEST' WHEN o_orderkey % 16 IN (8, 14) THEN 'RAW_LOG_UPLOAD_REJECTED'
  WHEN o_orderkey % 16 = 9 THEN 'BAD_DECISION' WHEN o_orderkey % 16 = 10 THEN 'DECISION_NO_PROMPT' WHEN o_orderkey % 16 = 11 THEN 'DECISION_NO_SELECTION' END END AS error,
  CASE WHEN o_orderkey % 16 IN (9, 10, 11) AND coalesce(n, 0) <= 6 THEN greatest(n, 1) - 1 END::INTEGER AS index
FROM orders LEFT JOIN (SELECT l_orderkey AS o_orderkey, count(*) AS n FROM lineitem GROUP BY 1) USING (o_orderkey)"""
)
def validate_envelope(spark, sf_dir):
    return sent(spark, sf_dir).select("o_orderkey", U.envelope_error(F.try_parse_json("envelope"), KIND, 6).alias("e")).select("o_orderkey", "e.error", "e.index")


@query(
    """WITH u AS (SELECT o_orderkey, substr(sha256('{"contributorId":"' || CASE WHEN o_custkey % 2 = 0 THEN o_custkey::VARCHAR ELSE 'anonymous' END || '","createdAtUnix":' || (o_custkey % 50) || ',"recordCount":3}{"a":' || (o_custkey % 3) || '}'), 1, 32) AS id FROM orders),
f AS (SELECT id, min(o_orderkey) AS o_orderkey, bool_or(o_orderkey % 10 = 0) AS seen FROM u GROUP BY 1) SELECT o_orderkey, id FROM f WHERE NOT seen"""
)
def upload_dedupe(spark, sf_dir):
    """Uploads of which every tenth has been seen before."""
    customer = F.col("o_custkey")
    key = U.upload_id(F.when(customer % 2 == 0, customer.cast("string")), customer % 50, F.lit(3), F.concat(F.lit('{"a":'), customer % 3, F.lit("}")))
    rows = read(spark, sf_dir, "orders").select("o_orderkey", key.alias("id"))
    return U.new_uploads(rows, rows.where("o_orderkey % 10 = 0").select("id").distinct(), "id", "o_orderkey").select("o_orderkey", "id")


@query(
    f"""{WITH}, g AS (SELECT game, count(*) AS n, string_agg('{{"gameId":"<' || game || '>","seq":' || seq || ',"token":"<redacted>"}}', ',' ORDER BY seq) FILTER (seq < 5) AS decisions FROM dec GROUP BY 1)
SELECT c_custkey AS bundle, CASE WHEN c_custkey % 4 = 0 THEN 'NO_CONSENT' WHEN n IS NULL THEN 'NO_DECISIONS' END AS error, coalesce(least(n, 5), 0) AS records, coalesce(n, 0) >= 5 AS truncated,
  CASE WHEN c_custkey % 4 <> 0 AND n IS NOT NULL THEN '{{"schemaVersion":1,"kind":"{KIND}","createdAtUnix":7,"contributorId":"anonymous","consent":{{"consentVersion":"training-v1","allowTraining":true,"allowPublicAggregateStats":' || (c_custkey % 3 = 0) || ',"allowRawResearchAccess":false}},"source":{{"bundleName":"'
  || c_custkey || '","recordCount":' || least(n, 5) || ',"truncated":' || (n >= 5) || '}},"manifest":{{"records":' || least(n, 5) || '}},"summary":{{"title":"<redacted>","turns":3}},"decisions":[' || decisions
  || '],"redactionReport":{{"mode":"default","rawPlayerLogUploaded":false,"containsDecisionRecords":true,"maxRecords":5}}}}' END AS envelope
FROM customer LEFT JOIN g ON game = c_custkey"""
)
def upload_envelope(spark, sf_dir):
    """A customer is a bundle; pseudonyms are shown as what they stand for."""
    shared_folder(spark, "upload")  # a folder for checkpoints
    game = F.col("gameId").cast("string")
    records = decisions(spark, sf_dir).select(F.col("gameId").alias("bundle"), F.col("sequenceNumber").alias("at"), as_json(gameId=game, seq=F.col("sequenceNumber"), token=F.lit("t")).alias("record"))
    summary = F.lit('{"turns": 3, "title": "x"}')
    k = F.col("c_custkey")
    bundles = read(spark, sf_dir, "customer").select(k.alias("bundle"), F.lit(None).cast("string").alias("contributor"), F.lit(7).alias("created"), (k % 4 != 0).alias("consent"), (k % 3 == 0).alias("stats"), summary.alias("summary"), F.lit(None).cast("string").alias("manifest"))
    from ledgerline.functions.text import pseudonym

    out = U.envelopes(records, bundles, "bundle", "at", "record", KIND, 5)
    return out.withColumn("envelope", F.replace("envelope", pseudonym(F.col("bundle").cast("string")), F.concat(F.lit("<"), "bundle", F.lit(">"))))


#: Colours of a part: those whose number divides its size.
COLORS = ((2, "W"), (3, "U"), (5, "B"), (7, "R"), (11, "G"))
COLORS_SQL = " || ".join(f"CASE WHEN p_size % {p} = 0 THEN '{c}' ELSE '' END" for p, c in COLORS)


def catalogue(spark, sf_dir):
    """The parts as catalogue responses of 500 cards, written as files and read back."""
    path = shared_folder(spark, "catalogue")
    part = read(spark, sf_dir, "part")
    colors = F.concat(*(F.when(F.col("p_size") % p == 0, c).otherwise("") for p, c in COLORS))
    card = F.to_json(F.struct(F.col("p_partkey").alias("cardId"), F.col("p_name").alias("name"), F.split("p_type", " ").alias("types"), F.array("p_brand").alias("subtypes"), colors.alias("colors"), F.col("p_size").cast("string").alias("power"), F.lit("x").alias("toughness"), (F.col("p_size") > 40).alias("isToken")))
    cards = part.groupBy(F.floor(F.col("p_partkey") / 500).alias("k")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p_partkey", card.alias("c")))), lambda x: x["c"]), ",").alias("cards"))
    cards.select("k", F.concat(F.lit('{"ok": true, "cards": ['), "cards", F.lit("]}")).alias("value")).repartition("k").write.partitionBy("k").text(path)
    return C.read_cards(spark, path)




@query(f"SELECT p_partkey AS card, p_name AS name, replace(p_type, ' ', ',') AS types, p_brand AS subtype, {COLORS_SQL} AS colors, p_size::VARCHAR AS power, p_size > 40 AS token FROM part")
def read_card_catalog(spark, sf_dir):
    return catalogue(spark, sf_dir).select(F.col("cardId").alias("card"), "name", F.array_join("types", ",").alias("types"), F.col("subtypes")[0].alias("subtype"), "colors", "power", F.col("isToken").alias("token"))


@query("SELECT p_name AS name, min(p_partkey) AS card FROM part GROUP BY 1")
def card_index_by_name(spark, sf_dir):
    cards = catalogue(spark, sf_dir).withColumn("k", F.regexp_extract("file", r"k=(\d+)", 1).cast("long"))
    return C.first_printings(cards, order=("k", "place")).select("name", F.col("cardId").alias("card"))


def seen_objects(spark, sf_dir):
    """The options of decisions as objects of a match: some face down, some without a card or with one that no catalogue has."""
    rows = option_rows(spark, sf_dir)
    card = F.when(F.col("idx") == 5, 0).when(F.col("part") % 17 == 0, -F.col("part")).otherwise(F.col("part"))
    return rows.select(
        "decision", "idx", F.col("game").cast("string").alias("match"), card.alias("card"), (F.col("qty") > 45).alias("face_down"), F.when(F.col("idx") % 2 == 0, F.col("idx").cast("int")).alias("power"), F.lit(None).cast("int").alias("toughness"),
        F.when(F.col("supp") % 3 == 0, F.col("part")).alias("source_card"), F.when(F.col("idx") % 3 == 0, "BATTLEFIELD").when(F.col("idx") % 3 == 1, "GRAVEYARD").otherwise("HAND").alias("zone"),
        F.when(F.col("supp") % 5 > 0, F.col("supp") % 2).alias("controller"), F.when(F.col("game") % 2 == 0, F.lit(1)).alias("seat"),
    )


OBJECTS_SQL = f"""{OPTIONS_SQL}, ob AS (SELECT decision, idx, game::VARCHAR AS match, idx <> 5 AND part <> 0 AND qty <= 45 AS open, idx <> 5 AND qty <= 45 AND part % 17 <> 0 AS known, part, supp, psize, label, ptype, {COLORS_SQL.replace("p_size", "psize")} AS colors,
  CASE WHEN supp % 5 > 0 THEN supp % 2 END AS controller, CASE WHEN game % 2 = 0 THEN 1 END AS seat FROM opt)"""


@query(
    f"""WITH {OBJECTS_SQL} SELECT decision, idx, NOT known AS face_down, CASE WHEN known THEN label END AS name, CASE WHEN known THEN replace(ptype, ' ', ',') END AS types, CASE WHEN known THEN nullif(colors, '') END AS colors,
  CASE WHEN idx % 2 = 0 THEN idx WHEN known THEN psize END AS power, CASE WHEN open AND supp % 3 = 0 THEN label END AS source_name FROM ob"""
)
def enrich_cards(spark, sf_dir):
    rows = C.enriched(seen_objects(spark, sf_dir), catalogue(spark, sf_dir))
    return rows.select("decision", "idx", "face_down", "name", F.array_join("types", ",").alias("types"), "colors", "power", "source_name")


@query(
    f"""WITH {OBJECTS_SQL}, c AS (SELECT match, CASE WHEN controller = seat THEN 'you' ELSE 'opponent' END AS side, unnest(string_split(colors, '')) AS c FROM ob WHERE known AND colors <> '' AND idx % 3 < 2 AND controller IS NOT NULL)
SELECT match, side, string_agg(DISTINCT c, '' ORDER BY strpos('WUBRG', c)) AS colors FROM c GROUP BY 1, 2"""
)
def colors_seen(spark, sf_dir):
    return C.colors_seen(C.enriched(seen_objects(spark, sf_dir), catalogue(spark, sf_dir)))


@query(
    """WITH d AS (SELECT doc_id, quality, doc_id % 3 <> 0 AND doc_id % 2 = 0 AS even FROM documents LEFT JOIN labels USING (doc_id))
SELECT doc_id, CASE WHEN quality IS NULL THEN '0,0,0' ELSE quality || ',' || even::INT || ',0' END AS target, CASE WHEN quality IS NULL THEN 'false,false,false' ELSE 'true,' || even || ',false' END AS mask,
  CASE WHEN quality IS NULL THEN 'unlabeled' ELSE 'human' END AS label_source FROM d"""
)
def belief_label_join(spark, sf_dir):
    """Labels of a vocabulary of three: one always given, one sometimes, one never."""
    k = F.col("doc_id")
    belief = F.concat(F.lit('{"good":'), "quality", F.when(k % 3 == 0, ',"even":null').when(k % 2 == 0, ',"even":true').otherwise(""), F.lit("}"))
    labels = read(spark, sf_dir, "labels").select("doc_id", F.parse_json(F.concat(F.lit('{"visibility":"oracle-label-only","source":"human","belief":'), belief, F.lit("}"))).alias("payload"))
    rows = L.belief_labels(read(spark, sf_dir, "documents").select("doc_id"), labels, ["doc_id"], ["good", "even", "odd"])
    return rows.select("doc_id", F.array_join(F.transform("target", lambda x: x.cast("int").cast("string")), ",").alias("target"), F.array_join(F.col("mask").cast("array<string>"), ",").alias("mask"), "label_source")


@query(
    """WITH e AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_partkey % 10 AS k FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CASE k WHEN 1 THEN 'no context' WHEN 2 THEN 'left: unknown factors luck,skill' WHEN 3 THEN 'right: no name;weight must be finite and positive' WHEN 4 THEN 'preferred must be left, right or tie' WHEN 5 THEN 'confidence must be in [0, 1]' WHEN 6 THEN 'left: factors must be numbers' WHEN 7 THEN 'right: no candidate' ELSE '' END AS errors,
  CASE WHEN k = 4 THEN NULL WHEN k = 8 THEN 'right' WHEN k = 9 THEN 'tie' ELSE 'left' END AS preferred FROM e"""
)
def check_preferences(spark, sf_dir):
    k = F.col("l_partkey") % 10
    left = F.when(k == 2, '{"id":"a","factors":{"skill":1,"life":2,"luck":0}}').when(k == 6, '{"id":"a","factors":{"life":"2"}}').otherwise('{"id":"a","factors":{"life":2.5}}')
    right = F.when(k == 3, '{"id":" ","factors":{}}').when(k == 7, "3").otherwise('{"label":"b","factors":{"cards":1}}')
    text = F.concat(
        F.lit('{"contextId":'), F.when(k == 1, '" "').otherwise('"c"'), F.lit(',"left":'), left, F.lit(',"right":'), right, F.lit(',"preferred":'), F.when(k == 4, '"up"').when(k == 8, "-0.5").when(k == 9, '" Draw "').otherwise('"A"'),
        F.lit(',"confidence":'), F.when(k == 5, "1.5").when(k == 8, "null").otherwise("0.5"), F.lit(',"weight":'), F.when(k == 3, "0").otherwise("2"), F.lit("}"),
    )
    own = let(F.parse_json(text), lambda v: F.struct(F.array_join(L.preference_errors(v, ["life", "cards"]), ";").alias("errors"), L.preferred_side(F.try_variant_get(v, "$.preferred", "variant")).alias("preferred")))
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", own.alias("own")).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "own.errors", "own.preferred")
