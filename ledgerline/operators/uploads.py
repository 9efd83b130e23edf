"""Uploads of decision records: checks of an envelope in order, its stable id, repeats, and envelopes made from bundles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.operators.log_events import at, is_kind, let
from ledgerline.operators.redaction import redacted

#: Most records of an upload, and the text of consent that it was given for (fixed values).
MOST, CONSENT = 20_000, "training-v1"


def truthy(value: Column) -> Column:
    """Whether a JSON value counts as true: not null, false, 0 or an empty text."""
    text = F.try_variant_get(value, "$", "string")
    kind = F.schema_of_variant(value)
    number = F.try_variant_get(value, "$", "double")
    return F.coalesce(F.when(kind.startswith("OBJECT") | kind.startswith("ARRAY"), True).when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean")).when(kind == "STRING", text != "").when(kind == "VOID", False).otherwise(number != 0), F.lit(False))


def is_object(value: Column) -> Column:
    return is_kind(value, "OBJECT") | is_kind(value, "ARRAY")


def is_boolean(value: Column, expected: bool) -> Column:
    return is_kind(value, "BOOLEAN") & F.coalesce(F.try_variant_get(value, "$", "boolean") == expected, F.lit(False))


def decision_error(decision: Column) -> Column:
    """What is wrong with one decision, null if nothing."""
    get = lambda k: at(decision, k, "variant")
    selected = F.when(truthy(get("selectedIndices")), get("selectedIndices")).otherwise(get("selected"))
    return F.when(~is_object(decision), "BAD_DECISION").when(~truthy(get("observation")) & ~truthy(get("select")), "DECISION_NO_PROMPT").when(~is_kind(selected, "ARRAY"), "DECISION_NO_SELECTION")


def envelope_error(envelope: Column, kind: str, most: int = MOST) -> Column:
    """(error, index): the first check that an envelope (VARIANT) fails, and the first decision that does; null if it is sound."""

    def of(e: Column) -> Column:
        get = lambda k: at(e, k, "variant")
        stats = get("consent.allowPublicAggregateStats")
        decisions = F.when(is_kind(get("decisions"), "ARRAY"), at(e, "decisions", "array<variant>"))
        errors = F.transform(decisions, lambda d, i: F.struct(decision_error(d).alias("error"), i.cast("int").alias("index")))
        first = F.get(F.filter(errors, lambda x: x["error"].isNotNull()), F.lit(0))
        said = lambda code: F.struct(F.lit(code).alias("error"), F.lit(None).cast("int").alias("index"))
        return (
            F.when(~is_object(e), said("BAD_ENVELOPE"))
            .when(~is_kind(get("kind"), "STRING") | (at(e, "kind") != kind), said("BAD_KIND"))
            .when(~is_boolean(get("consent.allowTraining"), True), said("NO_TRAINING_CONSENT"))
            .when(stats.isNotNull() & ~is_kind(stats, "BOOLEAN"), said("BAD_CONSENT"))
            .when(decisions.isNull(), said("NO_DECISIONS"))
            .when((F.size(decisions) < 1) | (F.size(decisions) > most), said("BAD_RECORD_COUNT"))
            .when(~is_object(get("manifest")), said("NO_MANIFEST"))
            .when(~is_boolean(get("redactionReport.rawPlayerLogUploaded"), False), said("RAW_LOG_UPLOAD_REJECTED"))
            .otherwise(first)
        )

    return let(F.coalesce(envelope, F.parse_json(F.lit("null"))), of)


def upload_id(contributor: Column, created: Column, records: Column, manifest: Column) -> Column:
    """32 hex digits of what an upload is: contributor, time, number of records and manifest (a JSON text)."""
    stable = F.struct(F.coalesce(contributor, F.lit("anonymous")).alias("contributorId"), created.alias("createdAtUnix"), records.alias("recordCount"))
    return F.substring(F.sha2(F.concat(F.to_json(stable), F.coalesce(manifest, F.lit("null"))), 256), 1, 32)


def new_uploads(uploads: DataFrame, seen: DataFrame, key: str, order: str) -> DataFrame:
    """Uploads whose id neither an earlier one of them nor ``seen`` has; equal ids meet after each task has kept its first."""
    first = uploads.groupBy(key).agg(F.min(order).alias("first_")).join(seen.select(key), key, "left_anti")
    return uploads.join(first.toDF("key_", "first_"), (F.col(key) == F.col("key_")) & (F.col(order) == F.col("first_")), "left_semi")


def envelopes(decisions: DataFrame, bundles: DataFrame, bundle: str, order: str, record: str, kind: str, most: int = MOST) -> DataFrame:
    """bundle, error, records, truncated, envelope (a JSON text) of each bundle: its first ``most`` decisions (JSON texts) redacted, with consent, source, manifest, summary and report.

    Bundles have contributor, created, consent, stats (booleans; null is no), summary and manifest (JSON texts, or null: counts are
    the manifest).  Without consent, or without decisions, there is an error and no envelope.  ``most`` is what an upload may hold.
    """
    place = F.row_number().over(Window.partitionBy(bundle).orderBy(order))
    kept = redacted(decisions.select(bundle, order, record).withColumn("place_", place).where(F.col("place_") <= most), record)
    texts = F.transform(F.sort_array(F.collect_list(F.struct("place_", record))), lambda x: x[record])
    own = kept.groupBy(bundle).agg(F.count("*").alias("records"), texts.alias("texts_"))
    told = redacted(redacted(bundles, "summary"), "manifest")
    rows = told.join(own, bundle, "left").withColumn("records", F.coalesce("records", F.lit(0)))
    error = F.when(~F.coalesce("consent", F.lit(False)), "NO_CONSENT").when(F.col("records") == 0, "NO_DECISIONS")
    rows = rows.withColumns({"error": error, "truncated": F.col("records") >= most})
    part = lambda **fields: F.to_json(F.struct(*(v.alias(k) for k, v in fields.items())), {"ignoreNullFields": "false"})
    lit = F.lit
    counts = part(records=F.col("records"))
    fields = {
        "schemaVersion": lit("1"),
        "kind": lit(f'"{kind}"'),
        "createdAtUnix": F.coalesce(F.col("created").cast("string"), lit("null")),
        "contributorId": F.to_json(F.array(F.coalesce("contributor", lit("anonymous")))).substr(lit(2), F.length(F.to_json(F.array(F.coalesce("contributor", lit("anonymous"))))) - 2),
        "consent": part(consentVersion=lit(CONSENT), allowTraining=lit(True), allowPublicAggregateStats=F.coalesce("stats", lit(False)), allowRawResearchAccess=lit(False)),
        "source": part(bundleName=F.col(bundle).cast("string"), recordCount=F.col("records"), truncated=F.col("truncated")),
        "manifest": F.coalesce("manifest", counts),
        "summary": F.coalesce("summary", lit("{}")),
        "decisions": F.concat(lit("["), F.array_join("texts_", ","), lit("]")),
        "redactionReport": part(mode=lit("default"), rawPlayerLogUploaded=lit(False), containsDecisionRecords=lit(True), maxRecords=lit(most)),
    }
    envelope = F.concat(lit("{"), F.concat_ws(",", *(F.concat(lit(f'"{k}":'), v) for k, v in fields.items())), lit("}"))
    return rows.select(bundle, "error", "records", "truncated", F.when(error.isNull(), envelope).alias("envelope"))
