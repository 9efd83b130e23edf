"""Corpus pipeline: stages over documents, each written as Parquet and read again.

Every stage takes all that the one before kept and returns the columns of documents, the
last one the packed pieces.  Nulls, empty texts and repeated rows are kept or dropped as
each operator defines them; an empty table passes through as an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import packing, quality, queries, repeats, shingle_join
from ledgerline.llm.common import scratch, ship, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents that the classifier scores under 0.7 go."""
    model = quality.quality_model(docs, table(spark, sf_dir, "labels"))
    return docs.where(quality.score(docs, model, F.col("text")) >= 0.7).select(COLUMNS)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: of each component the document of the smallest id stays; documents without words stay."""
    return shingle_join.one_of_each(docs.select(COLUMNS))


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: repeated strings of 400 bytes go; what is left of a text is its text, and bytes that no longer form UTF-8 are replaced.  Emptied documents go."""
    left = repeats.without_repeats(docs, carry=("lang", "source")).where("n_removed = 0 or n_removed < n_bytes")
    text = F.make_valid_utf8(F.col("kept").cast("string"))
    return left.select("doc_id", text.alias("text"), "lang", "source", F.length(text).cast("long").alias("n_chars"))


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: the pieces of all documents with their sequences."""
    return packing.pack(packing.token_pieces(docs, queries.vocabulary("byte_bpe_50k.json")))


STAGES = [
    ("quality classifier", keep_good),
    ("n-gram Jaccard join", keep_one_of_near_copies),
    ("suffix-array dedup", drop_repeats),
    ("best-fit packing", pack_documents),
]
#: The classifier, the join and the packing are not for SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    ship(spark)
    path = f"{sf_dir}/documents.parquet"
    for _, stage in STAGES:
        out = scratch(spark, "stage")
        stage(spark, spark.read.parquet(path), sf_dir).write.parquet(out)
        path = out
    return spark.read.parquet(path)
