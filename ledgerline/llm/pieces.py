"""Operator 10: SentencePiece encoding and decoding with byte offsets.

Texts are normalised by longest-prefix matches in the model's compiled character map
(a double-array trie, unpacked here with numpy); each normalised byte keeps the source
byte it came from.  Pieces of the normalised text are thereby projected to spans of
the original bytes: spans follow one another without gaps and cover the text.
Decoding joins the pieces' surfaces and bytes again.

Nulls are empty texts (only the end id; decoded empty).  Texts of any length are encoded
whole; rows repeat as they come, and other columns of the input are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import codecs
import hashlib
import re
import struct
import zlib
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import remembered
from ledgerline.llm.token_counts import MARK, MEMO, MEMO_CHARS, processor, split_words


#: Every byte that is no UTF-8 becomes a U+FFFD of its own.
codecs.register_error("each_byte", lambda e: ("\ufffd" * (e.end - e.start), e.end))


def unpack_charsmap(blob: bytes) -> dict[bytes, bytes]:
    """All (source bytes -> replacement) rules of a compiled character map.

    The blob is the trie's size, the trie's 32-bit units, then NUL-ended replacements.
    The trie is walked breadth-first, all 255 labels of all nodes of a level at once.
    """
    if not blob:
        return {}
    (size,) = struct.unpack("<I", blob[:4])
    units = np.frombuffer(blob[4 : 4 + size], "<u4").astype(np.int64)
    values = blob[4 + size :]
    labels = np.arange(1, 256)
    offset = lambda u: (u >> 10) << ((u & 512) >> 6)
    rules, nodes, keys = {}, offset(units[:1]), [b""]
    while len(nodes):
        children = nodes[:, None] ^ labels
        inside = children < len(units)
        found = inside & ((units[np.where(inside, children, 0)] & 0x800000FF) == labels)
        row, column = np.nonzero(found)
        at = children[row, column]
        keys = [keys[r] + bytes([labels[c]]) for r, c in zip(row, column, strict=True)]
        nodes = at ^ offset(units[at])
        for key, unit, node in zip(keys, units[at], nodes, strict=True):
            if unit >> 8 & 1:
                start = int(units[node] & 0x7FFFFFFF)
                rules[key] = values[start : values.index(b"\0", start)]
    return rules


class Normaliser:
    """text -> (normalised text with plain spaces for markers, source byte offset of each normalised byte).

    The offsets are None where both texts are the same bytes.  The dummy prefix is not
    part of the normalised text.
    """

    def __init__(self, charsmap: bytes = b"", remove_extra_whitespaces: bool = False):
        self.rules = {k.decode(): v.decode() for k, v in unpack_charsmap(charsmap).items()}
        self.squeeze = remove_extra_whitespaces
        self.lengths: dict[str, list[int]] = {}
        for key in self.rules:
            self.lengths.setdefault(key[0], []).append(len(key))
        self.lengths = {c: sorted(set(x), reverse=True) for c, x in self.lengths.items()}
        self.starts = re.compile("[" + "".join(map(re.escape, self.lengths)) + "]") if self.rules else None

    def __call__(self, text: str) -> tuple[str, np.ndarray | None]:
        if not self.squeeze and MARK not in text and not (self.starts and self.starts.search(text)):
            return text, None
        out: list[str] = []
        origin: list[int] = []
        at = source = 0
        while at < len(text):
            width, new = 1, text[at]
            for n in self.lengths.get(text[at], ()):
                if (hit := self.rules.get(text[at : at + n])) is not None:
                    width, new = n, hit
                    break
            for c in new.replace(MARK, " "):
                if not (self.squeeze and c == " " and (not out or out[-1] == " ")):
                    out.append(c)
                    origin += [source] * len(c.encode())
            source += len(text[at : at + width].encode())
            at += width
        while self.squeeze and out and out[-1] == " ":
            out.pop()
            origin.pop()
        return "".join(out), np.array([*origin, source], np.int64)


@lru_cache(maxsize=4)
def model_spec(model_path: str):
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    with open(model_path, "rb") as f:
        model.ParseFromString(f.read())
    return model


class Codec(dict):
    """Word (pre-token without its marker) -> (ids as text, number of ids, decoded text, byte length of each piece)."""

    def __init__(self, model_path: str, memo: int = MEMO):
        super().__init__()
        spec, self.sp, self.memo = model_spec(model_path), processor(model_path), memo
        norm = spec.normalizer_spec
        self.normalise = Normaliser(norm.precompiled_charsmap, norm.remove_extra_whitespaces)
        self.splits = not any(re.search(f"[^{MARK}]{MARK}", p.piece) for p in spec.pieces) and norm.add_dummy_prefix
        unknown = spec.trainer_spec.unk_surface.encode()
        #: id -> the bytes that it stands for (markers as spaces)
        self.surface = [bytes([int(p.piece[3:5], 16)]) if p.type == 6 else b"" if p.type == 3 else unknown if p.type == 2 else p.piece.replace(MARK, " ").encode() for p in spec.pieces]
        #: ids whose piece begins with a marker: the dummy prefix, if they come first
        self.marked = {i for i, p in enumerate(spec.pieces) if p.piece.startswith(MARK)}
        self.end = self.sp.eos_id()

    def __missing__(self, word: str):
        if word:
            ids = self.sp.encode(word)
        else:  # a last space alone
            ids = self.sp.encode("a ")[len(self.sp.encode("a")) :]
        surfaces = [self.surface[i] for i in ids]
        entry = (" ".join(map(str, ids)), len(ids), b"".join(surfaces).decode("utf-8", "each_byte"), np.array([len(s) for s in surfaces], "<u4").tobytes(), ids)
        if len(word) <= MEMO_CHARS:
            if len(self) >= self.memo:
                self.clear()
            self[word] = entry
        return entry

    def _words(self, text: str) -> tuple[list, np.ndarray | None]:
        norm, origin = self.normalise(text)
        if not norm:
            return [], origin
        return [self[w] for w in (split_words(norm) if self.splits else [norm])], origin

    def encode(self, text: str) -> tuple[list[int], np.ndarray]:
        """All ids with the end id, and the end offset in source bytes of each piece before it."""
        words, origin = self._words(text)
        return [i for w in words for i in w[4]] + [self.end], self._ends(words, origin)

    def _ends(self, words: list, origin: np.ndarray | None) -> np.ndarray:
        if not words:
            return np.zeros(0, np.int64)
        ends = np.cumsum(np.frombuffer(b"".join([w[3] for w in words]), "<u4"), dtype=np.int64) - 1  # the dummy prefix has no source byte
        return ends if origin is None else origin[ends]

    def decode(self, ids: list[int]) -> str:
        """Joined surfaces, without the dummy prefix; each byte that is no UTF-8 becomes a U+FFFD."""
        runs = groupby((self.surface[i] for i in ids), key=bool)  # control pieces, which have no surface, part bytes
        text = "".join([b"".join(run).decode("utf-8", "each_byte") for _, run in runs])
        first = next((i for i in ids if self.surface[i]), None)
        return text[1:] if first in self.marked else text

    def digest(self, text: str) -> tuple[int, str, str, int, int]:
        words, origin = self._words(text)
        ends = self._ends(words, origin)
        ids = " ".join([w[0] for w in words] + [str(self.end)])
        decoded = "".join([w[2] for w in words]).removeprefix(" ")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        return sum([w[1] for w in words]) + 1, sha(ids), sha(decoded), int(ends[-1]) if len(ends) else 0, zlib.crc32(ends.astype("<u4").tobytes())


def codec(model_path: str) -> Codec:
    return remembered(("codec", model_path), lambda: Codec(model_path))


def encode_pieces(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, ids array<int> (with the end id), ends array<long>: where each piece ends in the text's bytes (it starts where the last ended)."""
    def run(batches):
        c = codec(model_path)
        for b in batches:
            made = [c.encode(x or "") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x for x, _ in made], pa.list_(pa.int32())), pa.array([y.tolist() for _, y in made], pa.list_(pa.int64()))], ["doc_id", "ids", "ends"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids array<int>, ends array<long>")


def decode_pieces(encoded: DataFrame, model_path: str) -> DataFrame:
    """doc_id, text from (doc_id, ids)."""
    @F.arrow_udf("string")
    def decoded(ids: pa.Array) -> pa.Array:
        c = codec(model_path)
        return pa.array([None if x is None else c.decode(x) for x in ids.to_pylist()], pa.string())

    return encoded.select("doc_id", decoded("ids").alias("text"))


def piece_digests(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, and of the spans covered_bytes and ends_crc32."""
    kind = pa.struct([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("covered_bytes", pa.int64()), ("ends_crc32", pa.int64())])

    @F.arrow_udf("n_tokens long, ids_sha256 string, decoded_sha256 string, covered_bytes long, ends_crc32 long")
    def digest(texts: pa.Array) -> pa.Array:
        c = codec(model_path)
        rows = [c.digest(x.as_py() or "") for x in texts]
        return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], kind.field(i).type) for i in range(5)], fields=list(kind))

    return docs.select("doc_id", digest("text").alias("d")).select("doc_id", "d.*")
