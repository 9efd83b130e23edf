"""Queries of whole matches, with their SQL: an order is a match, a customer's orders are one session."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerline.operators import matches as M
from ledgerline.operators import sequences as Q
from ledgerline.plans.registry import query
from ledgerline.plans.views import OPTIONS_SQL, STATES_SQL, option_rows, read, states

EVENTS = {"1-URGENT": "PremierDraft_BLB_20240730", "2-HIGH": "QuickDraft", "3-MEDIUM": "Traditional_Historic_Ladder", "4-NOT SPECIFIED": "Ladder", "5-LOW": ""}
IDENTITIES = ("W", "UB", "", "G", "R", "WU", "B")
EXPANSIONS = ("BLB", "DSK", "FDN", None, "OTJ")
PLAYER = "struct<seat:int,name:string,team:int,event:string>"
RESULT = "struct<scope:string,winner:int>"


def of_list(values, k):
    return F.get(F.array(*map(F.lit, values)), k.cast("int"))


def match_events(spark, sf_dir):
    """CONNECT (of every third match), STATE, SNAPSHOT (of every fifth) and OVER events of all orders, in order of date."""
    option = F.struct("idx", "part", "qty")
    rows = option_rows(spark, sf_dir).groupBy(F.col("game").alias("session"), F.col("decision").alias("match"), "prompt", "ts").agg(F.sort_array(F.collect_list(option)).alias("o"))
    rows = rows.join(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("session"), "c_name"), "session")
    at = F.row_number().over(Window.partitionBy("session").orderBy("ts", "match")).cast("long") * 10
    name = F.when(F.col("match") % 7 != 0, F.concat(F.replace("c_name", F.lit("#"), F.lit("-")), F.lit("#123")))
    event = F.element_at(F.create_map(*(F.lit(x) for pair in EVENTS.items() for x in pair)), F.col("prompt"))
    game = F.transform(F.slice("o", 1, 3), lambda o: F.struct(F.lit("game").alias("scope"), (1 + o["qty"].cast("int") % 2).alias("winner")))
    final = F.when(F.col("match") % 4 != 0, F.array(F.struct(F.lit("match").alias("scope"), (1 + F.col("match") % 2).cast("int").alias("winner")))).otherwise(F.array().cast(f"array<{RESULT}>"))
    day = F.date_format("ts", "yyyy-MM-dd")
    one = lambda k, kind, **given: F.struct((F.col("at") + k).alias("seq"), F.lit(kind).alias("type"), *(given.get(c, F.lit(None)).cast(t).alias(c) for c, t in (("ts", "string"), ("seat", "int"), ("deck", "array<bigint>"), ("players", f"array<{PLAYER}>"), ("event", "string"), ("results", f"array<{RESULT}>"))))
    who = lambda *ps: F.array(*(F.struct(F.lit(s).alias("seat"), n.alias("name"), F.lit(t).alias("team"), F.lit(None).cast("string").alias("event")) for s, n, t in ps))
    foe = F.concat(F.lit("Foe"), F.col("match") % 4, F.lit("#9"))
    made = [
        F.when(F.col("match") % 3 == 0, one(0, "CONNECT", seat=1 + F.floor(F.col("match") / 3) % 2, deck=F.transform("o", lambda o: o["part"]))),
        one(1, "STATE", ts=F.concat(day, F.lit("T10:00:00")), players=who((1, name, 1), (2, foe, 2)), event=event),
        F.when(F.col("match") % 5 == 0, one(2, "SNAPSHOT", ts=F.concat(day, F.lit("T11:00:00")), seat=F.lit(2), players=who((1, F.lit("Snap"), None), (2, F.lit("Seat 2"), None)))),
        one(3, "OVER", ts=F.concat(day, F.lit("T12:00:00")), results=F.concat(game, final)),
    ]
    return rows.withColumn("at", at).select("session", "match", F.explode(F.array_compact(F.array(*made))).alias("e")).select("session", F.when(F.col("e.type") != "CONNECT", F.col("match")).alias("match"), "e.*")


@query(
    f"""WITH {OPTIONS_SQL},
m AS (SELECT game AS session, decision AS match, prompt, ts, list(part ORDER BY idx) AS deck, list(1 + qty::BIGINT % 2 ORDER BY idx)[:3] AS winners,
  CASE WHEN decision % 4 <> 0 THEN 1 + decision % 2 END AS winner, row_number() OVER (PARTITION BY game ORDER BY ts, decision) AS k FROM opt GROUP BY game, decision, prompt, ts),
w AS (SELECT *, CASE WHEN match % 3 = 0 THEN 1 + (match // 3) % 2 END AS told, CASE WHEN match % 5 = 0 THEN 2 WHEN match % 3 = 0 THEN 1 + (match // 3) % 2 END AS left_with FROM m),
x AS (SELECT *, last_value(CASE WHEN match % 3 = 0 THEN match END IGNORE NULLS) OVER (PARTITION BY session ORDER BY k ROWS UNBOUNDED PRECEDING) AS dnow,
  last_value(left_with IGNORE NULLS) OVER (PARTITION BY session ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM w),
s AS (SELECT session, first(match ORDER BY k) FILTER (match % 3 = 0) AS dfirst, last(left_with ORDER BY k) FILTER (left_with IS NOT NULL) AS slast FROM w GROUP BY 1),
y AS (SELECT x.*, coalesce(dnow, dfirst) AS dm, coalesce(CASE WHEN match % 5 = 0 THEN 2 END, told, before, slast) AS seat FROM x JOIN s USING (session)),
c AS (SELECT p_partkey AS part, ['W', 'UB', '', 'G', 'R', 'WU', 'B'][1 + p_partkey % 7] AS identity, ['BLB', 'DSK', 'FDN', NULL, 'OTJ'][1 + p_size % 5] AS expansion, p_size % 9 = 0 AS basic FROM part),
dk AS (SELECT decision, idx, identity, CASE WHEN NOT basic THEN expansion END AS st FROM opt JOIN c USING (part)),
sets AS (SELECT decision, st, count(*) AS n, min(idx) AS f FROM dk WHERE st IS NOT NULL GROUP BY 1, 2),
best AS (SELECT decision, first(st ORDER BY n DESC, f) AS deck_set FROM sets GROUP BY 1),
dc AS (SELECT decision, count(*) AS deck_size, string_agg(identity, '') AS all_letters FROM dk GROUP BY 1),
seen AS (SELECT decision, string_agg(CASE WHEN idx % 2 = 1 THEN ['W', 'U', 'B', 'R', 'G', ''][1 + part % 6] ELSE '' END, '') AS own, string_agg(CASE WHEN idx % 2 = 0 THEN ['W', 'U', 'B', 'R', 'G', ''][1 + part % 6] ELSE '' END, '') AS foe FROM opt WHERE decision % 5 = 0 GROUP BY 1),
z AS (SELECT y.*, deck_size, deck_set, list_sum(list_transform(winners, lambda v: CASE WHEN v = seat THEN 1 ELSE 0 END)) AS wins, len(winners) AS games, coalesce(all_letters, '') AS dl, coalesce(own, '') AS ol, coalesce(foe, '') AS fl,
  CASE WHEN match % 7 <> 0 THEN replace(c_name, '#', '-') WHEN match % 5 = 0 THEN 'Snap' END AS name1, 'Foe' || (match % 4) AS name2
  FROM y JOIN customer ON c_custkey = session LEFT JOIN dc ON dc.decision = dm LEFT JOIN best ON best.decision = dm LEFT JOIN seen ON seen.decision = match),
l AS (SELECT *, {"||".join(f"CASE WHEN contains(dl, '{q}') THEN '{q}' ELSE '' END" for q in "WUBRG")} AS dcol, {"||".join(f"CASE WHEN contains(ol, '{q}') THEN '{q}' ELSE '' END" for q in "WUBRG")} AS ocol,
  {"||".join(f"CASE WHEN contains(fl, '{q}') THEN '{q}' ELSE '' END" for q in "WUBRG")} AS fcol,
  CASE deck_set WHEN 'BLB' THEN 'Bloomburrow' WHEN 'DSK' THEN 'Duskmourn: House of Horror' WHEN 'FDN' THEN 'Foundations' WHEN 'OTJ' THEN 'Outlaws of Thunder Junction' END AS sname FROM z)
SELECT session, match, seat, CASE seat WHEN 1 THEN name1 WHEN 2 THEN name2 END AS you,
  CASE WHEN dcol <> '' THEN dcol ELSE ocol END AS you_colors, deck_size, fcol AS opponent_colors,
  CASE WHEN name1 IS NOT NULL AND seat IS DISTINCT FROM 1 THEN name1 WHEN seat IS DISTINCT FROM 2 THEN name2 END AS opponent,
  CASE prompt WHEN '1-URGENT' THEN 'Bloomburrow Premier Draft' WHEN '2-HIGH' THEN concat_ws(' ', sname, 'Quick Draft') WHEN '3-MEDIUM' THEN 'Historic (Bo3)' WHEN '4-NOT SPECIFIED' THEN 'Standard' ELSE sname END AS event_name,
  CASE WHEN winner IS NOT NULL AND seat IS NOT NULL THEN CASE WHEN winner = seat THEN 'win' ELSE 'loss' END WHEN wins > games - wins THEN 'win' WHEN wins < games - wins THEN 'loss' ELSE 'draw' END AS result,
  wins || '-' || (games - wins) AS record, strftime(ts, '%Y-%m-%d') || 'T10:00:00' AS start_time, strftime(ts, '%Y-%m-%d') || 'T12:00:00' AS end_time FROM l"""
)
def match_metadata(spark, sf_dir):
    options = option_rows(spark, sf_dir)
    shown = options.where("decision % 5 = 0").select(F.col("game").alias("session"), F.col("decision").alias("match"), F.lit("BATTLEFIELD").alias("zone"), (1 + F.col("idx") % 2).alias("controller"), F.lit(2).alias("seat"), of_list((*"WUBRG", ""), F.col("part") % 6).alias("colors"))
    cards = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("card"), of_list(IDENTITIES, F.col("p_partkey") % 7).alias("identity"), of_list(EXPANSIONS, F.col("p_size") % 5).alias("expansion"), (F.col("p_size") % 9 == 0).alias("basic"))
    out = M.match_summary(match_events(spark, sf_dir), shown, cards)
    return out.select("session", "match", "seat", "you", "you_colors", "deck_size", "opponent_colors", "opponent", "event_name", "result", "record", "start_time", "end_time")


ZONES = {"signup": "LIBRARY", "view": "HAND", "click": "STACK", "purchase": "BATTLEFIELD", "error": "UNKNOWN"}
ZONE_CASE = "CASE zone " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ZONES.items()) + " END"


@query(
    f"""WITH {STATES_SQL}, z AS (SELECT game, seq, object, reading, {ZONE_CASE} AS zone FROM st),
mv AS (SELECT * FROM (SELECT game, seq, object, reading, zone AS z2, lag(zone) OVER (PARTITION BY game, object ORDER BY seq) AS z1 FROM z WHERE object IS NOT NULL) WHERE z1 <> z2),
mw AS (SELECT *, CASE WHEN object % 40 = 7 THEN 'EXILE' ELSE z1 END AS z0 FROM mv),
ch AS (SELECT *, lag(z2) OVER (PARTITION BY game, object ORDER BY seq) AS was FROM mw),
ends AS (SELECT game, object, last(z2 ORDER BY seq) AS zone, max(seq) AS seq, min(seq) AS f FROM mw GROUP BY 1, 2),
e AS (SELECT game, 'cast' AS "check", seq, object FROM mw WHERE z0 = 'HAND' AND z2 = 'STACK' AND reading > 20
 UNION ALL SELECT game, 'mana_tapped', seq, object FROM z WHERE reading > 45 AND object % 3 = 0 AND zone = 'HAND'
 UNION ALL SELECT game, 'spell_resolved', seq, object FROM mw WHERE z0 = 'STACK' AND z2 = 'BATTLEFIELD'
 UNION ALL SELECT game, 'moves_chain', seq, object FROM ch WHERE was <> z0 AND was <> 'UNKNOWN' AND z0 <> 'UNKNOWN'
 UNION ALL SELECT * FROM (SELECT game, 'final_agrees', first(seq ORDER BY f), first(object ORDER BY f) FROM ends WHERE zone = 'BATTLEFIELD' AND object % 6 = 0 GROUP BY 1)),
f AS (SELECT game, "check", first(seq ORDER BY seq, object) AS sequence, first(object ORDER BY seq, object) AS object FROM e GROUP BY 1, 2),
r AS (SELECT DISTINCT game, unnest(['cast', 'mana_tapped', 'spell_resolved', 'moves_chain', 'final_agrees']) AS "check" FROM st)
SELECT game AS run, "check", (sequence IS NULL) = ("check" IN ('moves_chain', 'final_agrees')) AS passed, sequence, object FROM r LEFT JOIN f USING (game, "check")"""
)
def move_invariants(spark, sf_dir):
    """Zones of all states' objects; a few moves are said to start in EXILE, and every sixth object isn't on the last battlefield."""
    zone = F.element_at(F.create_map(*(F.lit(x) for pair in ZONES.items() for x in pair)), F.col("zone"))
    rows = states(spark, sf_dir).withColumn("zone", zone).withColumnRenamed("game", "run").withColumn("place", F.lit(0).cast("long"))
    moves = Q.zone_moves(rows, "run", "object", ["seq"], "zone").withColumn("from_zone", F.when(F.col("object") % 40 == 7, "EXILE").otherwise(F.col("from_zone")))
    pays = F.col("object") % 3 == 0
    chosen = rows.where("reading > 20").select("run", "seq", F.lit("PRIORITY").alias("prompt"), F.lit("CAST").alias("kind"), "object")
    paid = rows.where("reading > 45").select("run", "seq", F.lit("PAY_MANA").alias("prompt"), F.when(pays, "PROMPT_MANA_SOURCE").otherwise("OTHER").alias("kind"), "object")
    tapped = rows.where("object is not null").select("run", "seq", "object", F.lit(False).alias("was"), (F.col("zone") == "HAND").alias("now"))
    last = moves.groupBy("run", "object").agg(F.max_by("to_zone", "seq").alias("zone"))
    final = last.where("zone = 'BATTLEFIELD' and object % 6 <> 0").select("run", "object")
    return M.move_checks(rows, chosen.unionByName(paid), moves, tapped, final, {"cast": ("CAST", "HAND", "STACK")})


@query(
    f"""WITH {OPTIONS_SQL} SELECT decision AS run, round(epoch_ms(any_value(ts)) / 1000.0, 2) AS t, count(*) AS turn, any_value(prompt) AS phase,
  max(CASE WHEN idx = 0 THEN psize END) AS life1, max(CASE WHEN idx = 1 THEN psize END) AS life2, max(CASE WHEN idx = 0 THEN part % 8 END) AS hand1, max(CASE WHEN idx = 1 THEN part % 8 END) AS hand2,
  count(*) FILTER (idx % 3 < 2 AND part % 2 = 0) AS board1, count(*) FILTER (idx % 3 < 2 AND part % 2 = 1) AS board2,
  coalesce(array_to_string(list_sort(list(DISTINCT brand) FILTER (idx % 3 < 2 AND part % 2 = 0)), '|'), '') AS names1, coalesce(array_to_string(list_sort(list(DISTINCT brand) FILTER (idx % 3 < 2 AND part % 2 = 1)), '|'), '') AS names2,
  CASE WHEN decision % 3 = 0 THEN '' ELSE last(label ORDER BY idx) END AS log, round(CASE WHEN decision % 2 = 0 THEN count(*) / 8.0 ELSE 0 END, 2) AS sure_life, 0.0::DOUBLE AS sure_phase FROM opt GROUP BY decision"""
)
def replay_rows(spark, sf_dir):
    """Options as objects of a state: their parts' parity is the seat, their size and number the life and hand of the first two."""
    option = F.struct("idx", "part", "psize", "brand", "label")
    rows = option_rows(spark, sf_dir).groupBy(F.col("decision").alias("run"), "prompt", "ts").agg(F.sort_array(F.collect_list(option)).alias("o"))
    made = rows.select(
        "run", (Q.micros(F.col("ts")) / 1000).cast("long").alias("ts_ms"), F.size("o").cast("long").alias("turn"), F.col("prompt").alias("phase"),
        F.transform(F.slice("o", 1, 2), lambda o: F.struct((o["idx"] + 1).alias("seat"), o["psize"].alias("life"), (o["part"] % 8).alias("hand"))).alias("players"),
        F.transform("o", lambda o: F.struct(F.when(o["idx"] % 3 < 2, "battlefield").otherwise("hand").alias("zone"), (1 + o["part"] % 2).alias("controller"), o["brand"].alias("name"))).alias("objects"),
        F.when(F.col("run") % 3 != 0, F.transform("o", lambda o: o["label"])).alias("history"),
        F.when(F.col("run") % 2 == 0, F.create_map(F.lit("/players/1/life"), F.size("o") / 8.0)).alias("confidence"),
    )
    out = M.timeline(made)
    return out.withColumns({f"names{s}": F.array_join(f"names{s}", "|") for s in (1, 2)} | {f"board{s}": F.col(f"board{s}").cast("long") for s in (1, 2)})
