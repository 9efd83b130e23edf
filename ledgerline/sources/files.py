"""Scans and sinks of decision logs: JSONL, decklists, file inventories, bundles."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 1, counted before any filter), value of text files.

    Lines are counted within the blocks that tasks read; what stands before a block comes from a table of one row a block.
    """
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    blocks = rows.groupBy("file", "block").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("block")) - F.col("n")
    own = F.row_number().over(Window.partitionBy("file", "block").orderBy("id"))
    return rows.withColumn("own", own).join(blocks.select("file", "block", before.alias("before")), ["file", "block"]).select("file", (F.col("before") + F.col("own")).alias("line"), "value")


def parsed(value: Column) -> Column:
    """The VARIANT of a line that is exactly one JSON object, else null."""
    wrapped = F.try_parse_json(F.concat(F.lit("["), value, F.lit("]")))
    one = F.try_variant_get(wrapped, "$[1]", "variant").isNull()
    whole = F.try_variant_get(wrapped, "$[0]", "variant")
    return F.when(one & F.schema_of_variant(whole).startswith("OBJECT"), whole)


def read_jsonl(spark: SparkSession, path: str, mode: str = "fail") -> tuple[DataFrame, DataFrame]:
    """(rows file, line, value, record; bad lines file, line, value).  Blank lines are skipped; mode 'fail' raises on a bad line."""
    rows = read_lines(spark, path).where("trim(value) <> ''").withColumn("record", parsed(F.col("value")))
    if mode == "fail":
        error = F.raise_error(F.concat_ws(":", F.col("file"), F.col("line"), F.lit(" not a JSON object")))
        rows = rows.withColumn("record", F.when(F.col("record").isNull(), error.cast("variant")).otherwise(F.col("record")))
        return rows, rows.where("false").drop("record")
    return rows.where("record is not null"), rows.where("record is null").drop("record")


def write_jsonl(df: DataFrame, path: str) -> None:
    """One object a line, keys sorted, nulls kept."""
    df.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("value")).write.text(path)


def read_decklists(lines: DataFrame) -> DataFrame:
    """file, count, name of 'count name' lines; '#' starts a comment, the count is 1 unless given."""
    text = F.trim(F.split_part("value", F.lit("#"), F.lit(1)))
    rows = lines.withColumn("text", text).where("text <> ''")
    count = F.regexp_extract("text", r"^(\d+)\s+(.+)$", 1)
    return rows.select("file", F.when(count != "", count.cast("long")).otherwise(1).alias("count"), F.when(count != "", F.regexp_extract("text", r"^(\d+)\s+(.+)$", 2)).otherwise(F.col("text")).alias("name"))


def inventory(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """file, bytes, sha256 of the files below a path, in path order."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    return rows.orderBy("file").limit(limit) if limit else rows


def discover(spark: SparkSession, root: str, pattern: str = "*", limit: int | None = None) -> DataFrame:
    """file, bytes, modified of candidate files, in path order, without reading them; all of them unless a limit is asked for."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    found = rows.select(F.col("path").alias("file"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified")).orderBy("file")
    return found.limit(limit) if limit else found


def read_log(spark: SparkSession, path: str, header: str) -> DataFrame:
    """file, entry (from 1), header, text of raw logs below a path: bytes that are no UTF-8 are replaced, a line that fits the header opens an entry.

    Files are read in blocks.  A block's lines know how many entries open before them in the block, and a table of one row
    a block how many open before the block, so an entry that is open at a block's end goes on in the next.  Lines before
    the first header are an entry without one; a file without bytes has none.
    """
    lines = spark.read.option("recursiveFileLookup", "true").option("lineSep", "\n").text(path)
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")]
    value = F.regexp_replace(F.make_valid_utf8("value"), r"\r$", "")
    rows = lines.select(*place, value.alias("value")).withColumn("opens", F.col("value").rlike(header))
    counts = rows.groupBy("file", "block").agg(F.count_if("opens").alias("n"))
    # Where a file's first line opens no entry, one without a header comes first.
    first = rows.groupBy("file").agg(F.min_by("opens", F.struct("block", "line")).alias("whole"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("block")) - F.col("n")
    starts = counts.join(first, "file").select("file", "block", (before + F.when(F.col("whole"), 0).otherwise(1)).alias("before"))
    own = F.count_if("opens").over(Window.partitionBy("file", "block").orderBy("line"))
    entries = rows.withColumn("own", own).join(starts, ["file", "block"]).withColumn("entry", F.col("before") + F.col("own"))
    texts = F.sort_array(F.collect_list(F.when(~F.col("opens"), F.struct("block", "line", "value"))))
    return entries.groupBy("file", "entry").agg(F.max(F.when(F.col("opens"), F.col("value"))).alias("header"), F.array_join(F.transform(texts, lambda x: x["value"]), "\n").alias("text"))


def read_states(spark: SparkSession, path: str) -> DataFrame:
    """file, state (typed, absent lists empty) of JSONL files of canonical states; a line that is no object is an error."""
    from ledgerline.operators.boards import OBJECTS, PLAYERS, SCALARS

    rows, _ = read_jsonl(spark, path)
    kind = ", ".join(f"{k}: {v}" for k, v in {**SCALARS, "players": PLAYERS, "objects": OBJECTS}.items())
    state = F.from_json("value", f"struct<{kind}>")
    fields = [F.coalesce(state[k], F.array().cast(t)).alias(k) for k, t in (("players", PLAYERS), ("objects", OBJECTS))]
    return rows.select("file", F.struct(*(state[k].alias(k) for k in SCALARS), *fields).alias("state"))


#: Fixed values of factor ontologies.
ONTOLOGY_VERSION, ONTOLOGY_KIND = 1, "expert-factor-ontology-v1"


def read_ontology(spark: SparkSession, path: str) -> DataFrame:
    """name, transform, scale, sign of the factors of an ontology file: a list, or an object with version, kind and factors.

    Another version or kind, no factors, or a factor without a name or named twice is an error.
    """
    text = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"))
    get = lambda p, kind="string": F.try_variant_get("v", p, kind)
    listed = F.coalesce(get("$.factors", "array<variant>"), get("$", "array<variant>"))
    names = F.transform(listed, lambda f: F.try_variant_get(f, "$.name", "string"))
    wrong = (
        F.when(get("$.schemaVersion", "int") != ONTOLOGY_VERSION, "unsupported ontology version")
        .when(get("$.kind") != ONTOLOGY_KIND, "not a factor ontology")
        .when(F.coalesce(F.size(listed), F.lit(0)) < 1, "an ontology needs factors")
        .when(F.exists(names, lambda n: n.isNull()) | (F.size(F.array_distinct(names)) < F.size(names)), "factors need names of their own")
    )
    rows = text.select(F.explode(F.when(wrong.isNotNull(), F.raise_error(wrong).cast("array<variant>")).otherwise(listed)).alias("f"))
    of = lambda p, kind="string": F.try_variant_get("f", f"$.{p}", kind)
    return rows.select(of("name").alias("name"), F.coalesce(of("transform"), F.lit("identity")).alias("transform"), F.coalesce(of("scale", "double"), F.lit(1.0)).alias("scale"), F.coalesce(of("sign", "int"), F.lit(1)).alias("sign"))


#: File names of a run's states, decisions and ready transitions (fixed values).
STATES_FILE, DECISIONS_FILE, TRANSITIONS_FILE = "mirror_states.jsonl", "decisions.jsonl", "transitions.jsonl"


def read_inputs(spark: SparkSession, path: str) -> DataFrame:
    """run (folder), kind, value of the lines of all runs below a path; the file's name (or that of a folder of its parts) tells the kind.

    Ready transitions count only in runs that have neither states nor decisions; other names are decisions.
    """
    lines = spark.read.option("recursiveFileLookup", "true").text(path).select("value", F.col("_metadata.file_path").alias("file")).where("trim(value) <> ''")
    place = r"^(.*)/([^/]+\.jsonl)(?:/[^/]+)?$"
    name = F.regexp_extract("file", place, 2)
    kind = F.when(name == STATES_FILE, "states").when(name == TRANSITIONS_FILE, "transitions").otherwise("decisions")
    rows = lines.select(F.regexp_extract("file", place, 1).alias("run"), kind.alias("kind"), "value")
    made = rows.where("kind <> 'transitions'").select("run").distinct()
    return rows.where("kind <> 'transitions'").unionByName(rows.where("kind = 'transitions'").join(made, "run", "left_anti"))


def decode_bytes(content: Column) -> Column:
    """UTF-8 (a mark at the start goes), UTF-16 by its mark, else Latin text."""
    utf16 = content.substr(1, 2).isin(bytearray(b"\xff\xfe"), bytearray(b"\xfe\xff"))
    plain = F.try_validate_utf8(content.cast("string"))
    marked = F.regexp_replace(plain, r"^\x{FEFF}", "")
    return F.when(utf16, F.decode(content, "UTF-16")).otherwise(F.coalesce(marked, F.decode(content, "ISO-8859-1")))


def dedupe_sources(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each coalesced key; rows without a key all stay."""
    key = F.coalesce(*(F.col(k).cast("string") for k in keys))
    rows = df.withColumn("key_", key).withColumn("place_", F.row_number().over(Window.partitionBy("key_").orderBy(*order)))
    return rows.where("key_ is null or place_ = 1").drop("key_", "place_")


def plan_run(entries: DataFrame, done: DataFrame, key: str, status: str = "status") -> DataFrame:
    """Entries as completed, failed or pending, from a table of finished ones."""
    return entries.join(done.select(key, status), key, "left").withColumn("plan", F.when(F.col(status) == "ok", "skip").when(F.col(status).isNotNull(), "retry").otherwise("run")).drop(status)


def quality_split(df: DataFrame, score: str, threshold: float = 0.65) -> tuple[DataFrame, DataFrame]:
    """(training rows, quarantined rows); rows without a score are quarantined."""
    good = F.coalesce(F.col(score) >= threshold, F.lit(False))
    return df.where(good), df.where(~good)


def write_bundle(parts: dict[str, DataFrame], path: str, bundle: str = "bundle") -> None:
    """Each part as JSONL, keys sorted, by bundle below path/part, then path/summary: how many rows each part has in each bundle."""
    spark = next(iter(parts.values())).sparkSession
    for name, df in parts.items():
        row = F.to_json(F.struct(*sorted(c for c in df.columns if c != bundle)), {"ignoreNullFields": "false"})
        df.select(F.col(bundle).cast("string").alias(bundle), row.alias("value")).write.partitionBy(bundle).text(f"{path}/{name}")
    counts = [read_part(spark, path, name, bundle).groupBy(bundle).agg(F.count("*").alias("rows")).select(F.lit(name).alias("part"), bundle, "rows") for name in parts]
    write_jsonl(reduce(DataFrame.unionByName, counts), f"{path}/summary")


def read_part(spark: SparkSession, path: str, name: str, bundle: str = "bundle") -> DataFrame:
    """bundle (from the path, a text) and record (VARIANT, null for a line that is no object) of a part; no rows where a part isn't there."""
    schema = f"value string, {bundle} string"
    try:
        rows = spark.read.schema(schema).text(f"{path}/{name}")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], schema)
    return rows.where("trim(value) <> ''").select(bundle, parsed(F.col("value")).alias("record"))


def read_bundle(spark: SparkSession, path: str, parts: tuple[str, ...] = ("mirror_states", "decisions"), bundle: str = "bundle") -> tuple[dict[str, DataFrame], DataFrame]:
    """(a frame of bundle and record for each part; summary: part, bundle, rows, empty where none was written)."""
    schema = f"part string, {bundle} string, rows long"
    try:
        summary = spark.read.schema(schema).json(f"{path}/summary")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        summary = spark.createDataFrame([], schema)
    return {name: read_part(spark, path, name, bundle) for name in parts}, summary
