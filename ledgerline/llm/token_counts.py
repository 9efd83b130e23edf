"""Operator 2: token counts by the whole-token shortcut.

A SentencePiece BPE model without pieces that cross from text into a later space
marker splits exactly before every space that follows another character.  Offline
(on the driver) every vocabulary string is encoded alone; those that come back as one
token are proven whole tokens.  Pre-tokens among them count 1 at once; only the
rest is merged, by the library, behind a bounded memo.

Nulls count as empty (0 tokens); texts may be of any length; rows repeat as they come;
other columns of the input are ignored.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import remembered

MARK = "▁"
#: Pre-tokens that a worker remembers at most; beyond it, it starts anew.
MEMO = 1 << 19
#: Longer pre-tokens are not remembered.
MEMO_CHARS = 64

split_words = re.compile(r"(?<=[^ ]) ").split


@lru_cache(maxsize=4)
def processor(model_path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model_path)


@lru_cache(maxsize=4)
def splits_at_spaces(model_path: str) -> bool:
    """True if no piece holds a space marker after another character, and spaces are kept as they are."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    with open(model_path, "rb") as f:
        model.ParseFromString(f.read())
    spec = model.normalizer_spec
    plain = not spec.precompiled_charsmap and spec.add_dummy_prefix and spec.escape_whitespaces and not spec.remove_extra_whitespaces
    return bool(plain) and not any(re.search(f"[^{MARK}]{MARK}", p.piece) for p in model.pieces)


@lru_cache(maxsize=4)
def whole_tokens(model_path: str) -> frozenset[str]:
    """The vocabulary strings (without their space marker) that encode alone as one token."""
    sp = processor(model_path)
    words = [p[1:] for p in map(sp.id_to_piece, range(sp.get_piece_size())) if re.fullmatch(f"{MARK}[^{MARK}]+", p)]
    return frozenset(w for w, ids in zip(words, sp.encode(words, num_threads=1), strict=True) if len(ids) == 1)


class Counts(dict):
    """Pre-token -> number of tokens."""

    def __init__(self, model_path: str, proven: frozenset[str], memo: int = MEMO):
        super().__init__(dict.fromkeys(proven, 1))
        self.sp, self.split, self.proven, self.memo = processor(model_path), splits_at_spaces(model_path), proven, memo
        if self.split:
            # A last space alone: one marker, cut off from any text before it.
            self[""] = len(self.sp.encode("a ")) - len(self.sp.encode("a"))

    def __missing__(self, word: str) -> int:
        n = len(self.sp.encode(word))
        if len(word) <= MEMO_CHARS:
            if len(self) >= self.memo + len(self.proven):
                last = self[""]
                self.clear()
                self.update(dict.fromkeys(self.proven, 1))
                self[""] = last
            self[word] = n
        return n

    def of(self, text: str) -> int:
        if not text:
            return 0
        if not self.split:
            return len(self.sp.encode(text))
        return sum(map(self.__getitem__, split_words(text.replace(MARK, " "))))


def count_tokens(spark: SparkSession, text: Column, model_path: str) -> Column:
    """The number of tokens of each text, as the library's encode() gives them."""
    proven = spark.sparkContext.broadcast(whole_tokens(model_path))  # at most one string for each piece of the vocabulary

    @F.arrow_udf("long")
    def n_tokens(texts: pa.Array) -> pa.Array:
        counts = remembered(("counts", model_path), lambda: Counts(model_path, proven.value))
        return pa.array([counts.of(x.as_py() or "") for x in texts], pa.int64())

    return n_tokens(text)


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit: one row for each row of docs (none for an empty table)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    counted = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), count_tokens(docs.sparkSession, text, model_path).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
