"""Decision prompts as indexed option lists, and answers matched back to their indices.

A prompt is select(type, minCount, maxCount, option array of index, type, label, payload); an option's
payload is a map of the fields that tell it apart.  An answer becomes a list of wanted fields,
and each is looked up among the options: first exactly, then, for actions, without the card.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.operators.log_events import at

OPTIONS = "array<struct<type: string, label: string, payload: map<string, string>>>"
#: Names of mulligan answers.
KEEP_HAND, NEW_HAND = "MulliganOption_AcceptHand", "MulliganOption_Mulligan"


def _items(value: Column, path: str) -> Column:
    return F.coalesce(at(value, path, "array<variant>"), F.array().cast("array<variant>"))


def _texts(value: Column, path: str) -> Column:
    return F.coalesce(at(value, path, "array<string>"), F.array().cast("array<string>"))


def _said(value: Column) -> Column:
    return F.coalesce(value, F.lit("None"))


def _option(kind: Column | str, label: Column, **payload: Column) -> Column:
    pairs = [x for k, v in payload.items() for x in (F.lit(k), v.cast("string"))]
    fields = F.create_map(*pairs) if pairs else F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("type"), label.alias("label"), F.map_filter(fields, lambda _, v: v.isNotNull()).alias("payload"))


def _each(items: Column, make) -> Column:
    return F.transform(items, make).cast(OPTIONS)


def _ids(ids: Column, kind: str, label: str, key: str, end: Column | str = "") -> Column:
    return _each(ids, lambda i: _option(kind, F.concat(F.lit(label), i, end if isinstance(end, Column) else F.lit(end)), **{key: i}))


def _without(text: Column, prefix: str) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"^{prefix}", "")


def _json(value: Column) -> Column:
    return F.to_json(value)


def _recipient(value: Column) -> Column:
    seat, target = at(value, "playerSystemSeatId"), at(value, "targetInstanceId")
    other = F.when(_json(value) == "{}", "target").otherwise(_json(value))
    return F.when(at(value, "type") == "DamageRecType_Player", F.concat(F.lit("player seat "), _said(seat))).when(target.isNotNull(), F.concat(F.lit("instance "), target)).otherwise(other)


def _numbers(items: Column, path: str) -> Column:
    return F.aggregate(items, F.lit(0).cast("bigint"), lambda a, x: a + F.coalesce(at(x, path, "bigint"), F.lit(0)))


def option_lists(payload: Column) -> dict[str, tuple[Column, Column, Column]]:
    """Kind of prompt -> (minCount, maxCount, options); a maxCount of null stands for the number of options."""
    one, nil, some = F.lit(1).cast("bigint"), F.lit(0).cast("bigint"), F.lit(None).cast("bigint")
    fixed = lambda *options: F.array(*options).cast(OPTIONS)
    p = payload

    def action(a: Column) -> Column:
        kind = _without(at(a, "actionType"), "ActionType_")
        card = at(a, "grpId")
        label = F.when(F.coalesce(card, F.lit("0")) != "0", F.concat(kind, F.lit(" grpId="), card, F.lit(" instance="), _said(at(a, "instanceId")))).otherwise(kind)
        return _option(F.when(kind == "", "ACTION").otherwise(F.upper(kind)), label, actionType=at(a, "actionType"), instanceId=at(a, "instanceId"), grpId=card)

    groups = _items(p, "selectTargetsReq.targets")
    targets = F.flatten(F.transform(groups, lambda g: _each(_items(g, "targets"), lambda t: _option("TARGET", F.concat(F.lit("target instance="), _said(at(t, "targetInstanceId")), F.lit(" (group "), _said(at(g, "targetIdx")), F.lit(")")), targetIdx=at(g, "targetIdx"), targetInstanceId=at(t, "targetInstanceId")))))
    qualified = _items(p, "declareAttackersReq.qualifiedAttackers")
    attackers = F.when(F.size(qualified) > 0, qualified).otherwise(_items(p, "declareAttackersReq.attackers"))
    whom = lambda a: F.when(F.size(_items(a, "legalDamageRecipients")) > 0, _items(a, "legalDamageRecipients")).otherwise(F.array(F.parse_json(F.lit("{}"))))
    attack = F.flatten(F.transform(attackers, lambda a: _each(whom(a), lambda r: _option("ATTACK", F.concat(F.lit("attack with instance="), _said(at(a, "attackerInstanceId")), F.lit(" -> "), _recipient(r)), attackerInstanceId=at(a, "attackerInstanceId"), recipient=_json(r)))))
    block = F.flatten(F.transform(_items(p, "declareBlockersReq.blockers"), lambda b: _each(_texts(b, "attackerInstanceIds"), lambda a: _option("BLOCK", F.concat(F.lit("block attacker instance="), a, F.lit(" with instance="), _said(at(b, "blockerInstanceId"))), blockerInstanceId=at(b, "blockerInstanceId"), attackerInstanceId=a))))
    casting = _items(p, "castingTimeOptionsReq.castingTimeOptionReq")
    modal = F.filter(casting, lambda c: at(c, "modalReq", "variant").isNotNull())
    last = F.get(modal, F.size(modal) - 1)
    modes = F.flatten(
        F.transform(
            casting,
            lambda c: F.when(at(c, "modalReq", "variant").isNotNull(), _each(_items(c, "modalReq.modalOptions"), lambda m: _option("MODE", F.concat(F.lit("mode grpId="), _said(at(m, "grpId"))), ctoId=at(c, "ctoId"), grpId=at(m, "grpId")))).otherwise(
                fixed(_option("CASTING_OPTION", F.coalesce(at(c, "castingTimeOptionType"), F.lit("option")), ctoId=at(c, "ctoId"), castingTimeOptionType=at(c, "castingTimeOptionType")))
            ),
        )
    )
    paid = _each(_items(p, "payCostsReq.paymentActions.actions"), lambda a: _option("PAY", F.concat(_without(at(a, "actionType"), "ActionType_"), F.lit(" instance="), _said(at(a, "instanceId"))), actionType=at(a, "actionType"), instanceId=at(a, "instanceId"), grpId=at(a, "grpId")))
    auto = F.when(at(p, "payCostsReq.autoTapActionsReq", "variant").isNotNull(), fixed(_option("AUTO_TAP", F.lit("auto-tap suggested payment")))).otherwise(F.array().cast(OPTIONS))
    pay = F.concat(paid, auto, _ids(_texts(p, "payCostsReq.effectCostReq.costSelection.ids"), "COST_SELECT", "pay with id=", "id"))
    sought = _texts(p, "searchReq.itemsSought")
    sought = F.when(F.size(sought) > 0, sought).otherwise(_texts(p, "searchReq.itemsToSearch"))
    fail = F.when(F.coalesce(at(p, "searchReq.allowFailToFind"), F.lit("")).rlike("_(Any|Yes)$"), fixed(_option("FAIL_TO_FIND", F.lit("fail to find")))).otherwise(F.array().cast(OPTIONS))
    specs = F.array_join(F.transform(_items(p, "groupReq.groupSpecs"), lambda s: F.concat(_said(at(s, "zoneType")), F.lit("->"), _said(at(s, "subZoneType")))), " / ")
    order = _texts(p, "orderReq.ids")
    order = F.when(F.size(order) > 0, order).otherwise(_texts(p, "orderReq.instanceIds"))
    damage = F.flatten(
        F.transform(
            _items(p, "assignDamageReq.damageAssigners"),
            lambda d: _each(
                _items(d, "assignments"),
                lambda a: _option("ASSIGN_DAMAGE", F.concat(F.lit("instance="), _said(at(d, "instanceId")), F.lit(" damages instance="), _said(at(a, "instanceId")), F.lit(" (min "), _said(at(a, "minDamage")), F.lit(")")), assignerInstanceId=at(d, "instanceId"), instanceId=at(a, "instanceId"), minDamage=at(a, "minDamage")),
            ),
        )
    )
    positive = lambda c: F.when(c > 0, c)
    return {
        "ActionsAvailableReq": (one, one, _each(_items(p, "actionsAvailableReq.actions"), action)),
        "ChooseStartingPlayerReq": (one, one, _ids(_texts(p, "chooseStartingPlayerReq.systemSeatIds"), "SEAT", "seat ", "systemSeatId", " plays first")),
        "MulliganReq": (one, one, fixed(_option("KEEP", F.lit("keep hand"), decision=F.lit(KEEP_HAND)), _option("MULLIGAN", F.lit("mulligan"), decision=F.lit(NEW_HAND)))),
        "SelectTargetsReq": (_numbers(groups, "minTargets"), positive(_numbers(groups, "maxTargets")), targets),
        "DeclareAttackersReq": (nil, some, attack),
        "DeclareBlockersReq": (nil, some, block),
        "CastingTimeOptionsReq": (F.coalesce(at(last, "modalReq.minSel", "bigint"), one), F.coalesce(at(last, "modalReq.maxSel", "bigint"), one), modes),
        "PayCostsReq": (F.coalesce(at(p, "payCostsReq.effectCostReq.costSelection.minSel", "bigint"), nil), F.greatest(F.size(pay).cast("bigint"), one), pay),
        "SearchReq": (nil, F.coalesce(positive(at(p, "searchReq.maxFind", "bigint")), one), F.concat(_ids(sought, "FIND", "find instance=", "instanceId"), fail)),
        "SelectNReq": (F.coalesce(at(p, "selectNReq.minSel", "bigint"), nil), positive(at(p, "selectNReq.maxSel", "bigint")), _ids(_texts(p, "selectNReq.ids"), "SELECT", "select id=", "id")),
        "GroupReq": (nil, some, _ids(_texts(p, "groupReq.instanceIds"), "GROUP_ITEM", "id=", "id", F.concat(F.lit(" ("), specs, F.lit(")")))),
        "NumericInputReq": (one, one, fixed(_option("NUMBER", F.lit("numeric input"), request=_json(at(p, "numericInputReq", "variant"))))),
        "OptionalActionMessage": (one, one, fixed(_option("YES", F.lit("accept optional action"), answer=F.lit("yes")), _option("NO", F.lit("decline optional action"), answer=F.lit("no")))),
        "OrderReq": (F.size(order).cast("bigint"), some, _ids(order, "ORDER_ITEM", "id=", "id")),
        "AssignDamageReq": (nil, F.greatest(F.size(damage).cast("bigint"), one), damage),
    }


def build_prompts(df: DataFrame, message_type: str = "message_type", body: str = "body") -> DataFrame:
    """The frame with kind, msg_id and select; a message of no known kind has no options."""
    kind = _without(F.col(message_type), "GREMessageType_")
    lists = option_lists(F.col(body))
    least, most, options = F, F, F
    for name, (a, b, c) in lists.items():
        least, most, options = least.when(F.col("kind") == name, a), most.when(F.col("kind") == name, F.coalesce(b, F.size(c).cast("bigint"))), options.when(F.col("kind") == name, c)
    numbered = F.transform("option_", lambda o, i: F.struct(i.cast("bigint").alias("index"), o["type"].alias("type"), o["label"].alias("label"), o["payload"].alias("payload")))
    zero = F.lit(0).cast("bigint")
    rows = df.withColumn("kind", kind).withColumns({"least_": least.otherwise(zero), "most_": most.otherwise(zero), "option_": options.otherwise(F.array().cast(OPTIONS)), "msg_id": at(F.col(body), "msgId")})
    return rows.withColumn("select", F.struct(F.upper("kind").alias("type"), F.col("least_").alias("minCount"), F.col("most_").alias("maxCount"), numbered.alias("option"))).drop("least_", "most_", "option_")


def _find(options: Column, wanted: Column) -> Column:
    """The index of the first option whose payload has all wanted fields (a map; null is a field that is not there)."""
    fits = F.filter(options, lambda o: F.forall(F.map_entries(wanted), lambda e: F.try_element_at(o["payload"], e["key"]).eqNullSafe(e["value"])))
    return F.get(fits, F.lit(0))["index"]


def _wanted(items: Column, **fields) -> Column:
    """A map of fields for each item; a field is a function of the item."""
    return F.transform(items, lambda x: F.create_map(*(y for k, f in fields.items() for y in (F.lit(k), f(x).cast("string")))))


def matched(options: Column, kind: Column, answer: Column) -> Column:
    """Indices of the options that an answer chose; null if it names one that is not there or has no rule."""
    a = answer
    get = lambda path: lambda x: at(x, path)
    same = lambda x: x
    every = lambda wanted: F.transform(wanted, lambda w: _find(options, w))
    ids = lambda path, key="id": every(_wanted(_texts(a, path), **{key: same}))
    typed = lambda t: F.transform(F.filter(options, lambda o: o["type"] == t), lambda o: o["index"])
    single = lambda indices: F.when(F.size(indices) > 0, F.slice(indices, 1, 1))
    actions = _items(a, "performActionResp.actions")
    acted = F.transform(
        actions,
        lambda x: F.coalesce(
            _find(options, F.create_map(F.lit("actionType"), at(x, "actionType"), F.lit("instanceId"), at(x, "instanceId"), F.lit("grpId"), at(x, "grpId"))),
            _find(options, F.create_map(F.lit("actionType"), at(x, "actionType"), F.lit("instanceId"), at(x, "instanceId"))),
        ),
    )
    group = at(a, "selectTargetsResp.target.targetIdx")
    targets = every(_wanted(_items(a, "selectTargetsResp.target.targets"), targetIdx=lambda _: group, targetInstanceId=get("targetInstanceId")))
    toward = at(a, "declareAttackersResp.autoDeclareDamageRecipient", "variant")
    open_ = F.filter(options, lambda o: toward.isNull() | (o["payload"]["recipient"] == _json(toward)))
    first_of = lambda o: F.get(F.filter(open_, lambda x: x["payload"]["attackerInstanceId"].eqNullSafe(o["payload"]["attackerInstanceId"])), F.lit(0))["index"]
    auto = F.transform(F.filter(open_, lambda o: first_of(o) == o["index"]), lambda o: o["index"])
    chosen = F.transform(
        _items(a, "declareAttackersResp.selectedAttackers"),
        lambda x: F.get(
            F.filter(
                options,
                lambda o: o["payload"]["attackerInstanceId"].eqNullSafe(at(x, "attackerInstanceId"))
                & F.coalesce(o["payload"]["recipient"] == F.coalesce(_json(at(x, "selectedDamageRecipient", "variant")), _json(at(x, "damageRecipient", "variant"))), at(x, "selectedDamageRecipient", "variant").isNull() & at(x, "damageRecipient", "variant").isNull()),
            ),
            F.lit(0),
        )["index"],
    )
    attackers = F.when(F.coalesce(at(a, "declareAttackersResp.autoDeclare", "boolean"), F.lit(False)), auto).otherwise(chosen)
    blockers = F.flatten(F.transform(_items(a, "declareBlockersResp.selectedBlockers"), lambda b: every(_wanted(_texts(b, "selectedAttackerInstanceIds"), blockerInstanceId=lambda _: at(b, "blockerInstanceId"), attackerInstanceId=same))))
    cast = "castingTimeOptionsResp.castingTimeOptionResp"
    plain = F.filter(options, lambda o: (o["payload"]["castingTimeOptionType"] == at(a, f"{cast}.castingTimeOptionType")) & F.coalesce(o["payload"]["ctoId"] == at(a, f"{cast}.ctoId"), F.lit(True)))
    casting = F.when(at(a, f"{cast}.chooseModalResp", "variant").isNotNull(), ids(f"{cast}.chooseModalResp.grpIds", "grpId")).otherwise(single(F.transform(plain, lambda o: o["index"])))
    search = F.when(F.size(_texts(a, "searchResp.itemsFound")) > 0, ids("searchResp.itemsFound", "instanceId")).otherwise(single(typed("FAIL_TO_FIND")))
    picked, n = _texts(a, "selectNResp.ids"), F.size(options)
    places = F.transform(picked, lambda x: x.try_cast("bigint"))
    all_ = F.transform(options, lambda o: o["index"])
    in_place = F.forall(places, lambda i: F.coalesce((i >= 0) & (i < n), F.lit(False))) & ~((F.size(picked) == 1) & (F.get(picked, F.lit(0)) == "0") & (n > 1))
    arbitrary = F.when(F.coalesce(at(a, "selectNResp.useArbitrary", "string"), F.lit("false")) != "false", F.when(in_place, places).otherwise(all_))
    several = F.when(F.forall(ids("selectNResp.ids"), lambda i: i.isNotNull()), ids("selectNResp.ids")).otherwise(arbitrary)
    groups = _items(a, "groupResp.groups")
    later = F.flatten(F.transform(F.slice(groups, 2, 1 << 20), lambda g: _texts(g, "ids")))
    grouped = F.when(F.size(groups) > 0, every(_wanted(later, id=same)))
    cost = F.transform(_texts(a, "effectCostResp.costSelection.ids"), lambda i: F.least(_find(options, F.create_map(F.lit("instanceId"), i)), _find(options, F.create_map(F.lit("id"), i))))
    said = at(a, "optionalResp.response")
    optional = single(F.filter(every(F.array(F.create_map(F.lit("answer"), F.when(said.endswith("_No"), "no").when(said.endswith("_Yes"), "yes").otherwise("?")))), lambda i: i.isNotNull()))
    assigned = F.flatten(
        F.transform(_items(a, "assignDamageResp.assigners"), lambda d: every(_wanted(F.filter(_items(d, "assignments"), lambda x: F.coalesce(at(x, "assignedDamage", "bigint"), F.lit(0)) != 0), assignerInstanceId=lambda _: at(d, "instanceId"), instanceId=get("instanceId"))))
    )
    rules = {
        "ConcedeReq": F.array(F.lit(0).cast("bigint")),
        "PerformActionResp": acted,
        "ChooseStartingPlayerResp": every(_wanted(F.array(a), systemSeatId=get("chooseStartingPlayerResp.systemSeatId"))),
        "MulliganResp": every(_wanted(F.array(a), decision=get("mulliganResp.decision"))),
        "SelectTargetsResp": targets,
        "SubmitTargetsReq": targets,
        "DeclareAttackersResp": attackers,
        "SubmitAttackersReq": attackers,
        "DeclareBlockersResp": blockers,
        "SubmitBlockersReq": blockers,
        "CastingTimeOptionsResp": casting,
        "SearchResp": search,
        "SelectNResp": several,
        "GroupResp": grouped,
        "PerformAutoTapActionsResp": F.slice(typed("AUTO_TAP"), 1, 1),
        "EffectCostResp": cost,
        "OrderResp": ids("orderResp.ids"),
        "OptionalActionResp": optional,
        "AssignDamageResp": assigned,
    }
    out = F
    for name, indices in rules.items():
        out = out.when(kind == name, indices)
    return F.when(F.forall(out, lambda i: i.isNotNull()), F.array_distinct(out))


def match_responses(prompts: DataFrame, answers: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """Answers (keys, order, message_type, body) with the prompt (msg_id, select) that they answer, selected and matched.

    An answer belongs to the first prompt before it that it names and that has no earlier answer; a concession needs none; other answers without
    a prompt confirm one that was answered, and go.
    """
    kind = _without(F.col("message_type"), "ClientMessageType_")
    said = answers.withColumns({"answer_kind": kind, "msg_id": at(F.col("body"), "respId")})
    named = said.where("answer_kind <> 'ConcedeReq' and msg_id is not null")
    place = lambda df: df.withColumn("place_", F.row_number().over(Window.partitionBy(*keys, "msg_id").orderBy(order)))
    asked = place(prompts.select(*keys, "msg_id", F.col(order).alias("asked_at"), "select").withColumnRenamed("asked_at", order)).withColumnRenamed(order, "asked_at")
    both = place(named).join(asked, [*keys, "msg_id", "place_"]).where(F.col("asked_at") < F.col(order)).drop("place_")
    kinds = {f.name: f.dataType for f in both.schema}
    alone = said.where("answer_kind = 'ConcedeReq'").withColumns({"select": F.lit(None).cast(kinds["select"]), "asked_at": F.lit(None).cast(kinds["asked_at"])})
    selected = matched(F.coalesce(F.col("select.option"), F.array().cast(kinds["select"]["option"].dataType)), F.col("answer_kind"), F.col("body"))
    return both.unionByName(alone).withColumn("selected", selected).withColumn("matched", F.col("selected").isNotNull())
