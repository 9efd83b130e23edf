"""Byte-level BPE ids by the tokenizers library, behind a bounded memo of words.

A byte-level pre-tokenizer always cuts before a space that is followed by a character other than
white space; so do the words, numbers, marks and white space that its pattern tells apart, where
ASCII settles it.  Texts are split there and every part is encoded alone.  The parts of many texts
are looked up together, each distinct one once; those that are not known yet go to the library
in one call: joined, each begins with the only token that starts with a space, or stands
between line ends.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa

from ledgerline.llm.common import remembered, text_bytes

#: Parts that a worker remembers; beyond it the older half goes.
MEMO = 3 << 18
#: Longer parts are not remembered.
MEMO_CHARS = 64
#: Characters of text that are split and looked up together.
GROUP = 1 << 20
#: Parts in one call of the library.
CALL = 512

part_start = re.compile(r" (?=\S)")
white = re.compile(r"\s")
#: White space by its UTF-8 bytes: of one byte, and of two or three as numbers.
WHITE = [c.encode() for c in white.findall("".join(map(chr, range(0x3001))))]
WHITE_2, WHITE_3 = (np.array([int.from_bytes(c) for c in WHITE if len(c) == n], np.int64) for n in (2, 3))
#: Classes of bytes: what is beyond ASCII or white to some libraries only, control characters, white space but the space, space, letters, digits, apostrophe, marks.
OTHER, CONTROL, LINE, SPACE, LETTER, DIGIT, QUOTE, MARK = range(8)
INK = (LETTER, DIGIT, QUOTE, MARK)


def classes() -> np.ndarray:
    kind = np.full(256, OTHER, np.uint8)
    kind[:28] = kind[127] = CONTROL
    kind[9:14], kind[32], kind[33:127], kind[39] = LINE, SPACE, MARK, QUOTE
    kind[48:58], kind[65:91], kind[97:123] = DIGIT, LETTER, LETTER
    return kind


def pairs(*own: tuple[int, int]) -> np.ndarray:
    table = np.zeros(64, bool)
    table[[a * 8 + b for a, b in own]] = True
    return table


CLASS = classes()
#: Neighbours between which the pattern always cuts; those before the first of which it does, in any pattern and in the usual one.
BETWEEN = pairs(*((a, b) for a in INK for b in (LINE, SPACE)), *((LINE, b) for b in INK), (LETTER, DIGIT), (LETTER, QUOTE), (LETTER, MARK), (DIGIT, LETTER), (DIGIT, QUOTE), (DIGIT, MARK), (QUOTE, DIGIT), (MARK, DIGIT), (MARK, LETTER))
BEFORE = pairs(*((SPACE, b) for b in (CONTROL, *INK)))
BEFORE_LINES = BEFORE | pairs(*((LINE, b) for b in INK))


def tokenizer(path: str):
    """Kept by its memo alone, so that it goes when a worker forgets that."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the threads
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def blocks(text: str) -> Iterator[str]:
    """A text in pieces of about GROUP characters that end before a part."""
    at = 0
    while len(text) - at > GROUP:
        found = part_start.search(text, at + GROUP)
        if not found:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:] if at else text


def part_starts(data: np.ndarray, offsets: np.ndarray, fine: bool) -> np.ndarray:
    """Where the parts of texts begin, in the UTF-8 bytes of all: at a text's first byte and wherever ``part_start`` matches in it; fine: also where BETWEEN and BEFORE_LINES say."""
    start = np.zeros(len(data) + 1, bool)
    if len(data) > 1:
        kind = CLASS[data]
        pair = kind[:-1] << 3 | kind[1:]
        cross = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))] - 1
        pair[cross] = OTHER
        start[: len(data) - 1] = (BEFORE_LINES if fine else BEFORE)[pair]
        if fine:
            start[1 : len(data)] |= BETWEEN[pair]
        wide = np.nonzero(pair == SPACE << 3 | OTHER)[0]
        if len(wide):
            after = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.int64)
            two = after[wide + 1] << 8 | after[wide + 2]
            start[wide[~(((data[wide + 1] >= 28) & (data[wide + 1] < 32)) | np.isin(two, WHITE_2) | np.isin(two << 8 | after[wide + 3], WHITE_3))]] = True
    start[offsets] = True
    return np.nonzero(start[: len(data)])[0]


class PartIds(dict):
    """Part (with the space that it begins with) -> its ids as bytes of ``kind``."""

    def __init__(self, path: str, memo: int = MEMO):
        super().__init__()
        self.tokenizer, self.memo = tokenizer(path), memo
        self.pre, self.model = self.tokenizer.pre_tokenizer, self.tokenizer.model
        self.special = re.compile("|".join(map(re.escape, sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True))) or r"(?!)")
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.starts = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, bool)  # tokens that start with a space
        self.starts[[i for t, i in self.tokenizer.get_vocab().items() if t.startswith("Ġ")]] = True
        self.line = self.tokenizer.token_to_id("Ċ")
        usual = json.loads(self.tokenizer.to_str())
        self.usual = usual["normalizer"] is None and (usual["pre_tokenizer"] or {}) == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": usual["pre_tokenizer"].get("trim_offsets"), "use_regex": True}

    def ids(self, part: str) -> list[int]:
        if self.special.search(part):
            return self.tokenizer.encode(part, add_special_tokens=False).ids
        return [t.id for word, _ in self.pre.pre_tokenize_str(part) for t in self.model.tokenize(word)]

    def __missing__(self, part: str) -> bytes:
        return np.array(self.ids(part), self.kind).tobytes()

    def learn(self, new: list[str]) -> None:
        """Remember distinct parts that are not known yet."""
        if len(self) >= self.memo:
            newer = list(islice(self.items(), len(self) // 2, None))
            self.clear()
            self.update(newer)
        spaced, bare = [], []
        for p in new:
            if self.special.search(p) or white.search(p, 1) or p in (" ", "\n") or p[0] != " " and (not self.usual or white.match(p)):
                self[p] = self[p]
            else:
                (spaced if p[0] == " " else bare).append(p)
        self._call(spaced, "", self.starts)
        if bare:
            self._call(bare, "\n", np.arange(len(self.starts)) == self.line)

    def _call(self, parts: list[str], between: str, first: np.ndarray) -> None:
        """Remember parts joined in calls of the library; first: the tokens that only their beginnings (after ``between``) have."""
        skip, size = len(between), self.kind.itemsize
        for i in range(0, len(parts), CALL):
            own = parts[i : i + CALL]
            ids = np.array(self.tokenizer.encode_batch_fast([between + between.join(own)], add_special_tokens=False)[0].ids, self.kind)
            at = np.nonzero(first[ids])[0]
            if len(at) != len(own):
                raise ValueError("a part's first token is not the only one of its kind")
            data, starts, ends = ids.tobytes(), ((at + skip) * size).tolist(), [*(at[1:] * size).tolist(), len(ids) * size]
            self.update((p, data[a:b]) for p, a, b in zip(own, starts, ends, strict=True))

    def of_many(self, texts: Iterable[str | None], end: int) -> Iterator[np.ndarray]:
        """All ids of each text (none: empty), then ``end``."""
        last = np.array([end], self.kind).tobytes()
        group, size = [], 0
        for text in texts:
            if len(text or "") > GROUP:
                yield from self._ended(group, last)
                group, size = [], 0
                yield np.frombuffer(b"".join([*(x for block in blocks(text) for x in self._group([block])), last]), self.kind)
                continue
            group.append(text or "")
            size += len(group[-1])
            if size >= GROUP:
                yield from self._ended(group, last)
                group, size = [], 0
        yield from self._ended(group, last)

    def _ended(self, texts: list[str], last: bytes) -> Iterator[np.ndarray]:
        for own in self._group(texts):
            yield np.frombuffer(b"".join([own, last]), self.kind)

    def _group(self, texts: list[str]) -> Iterator[memoryview]:
        """The ids of each text, as bytes of ``kind``."""
        data, offsets = text_bytes(pa.array(texts, pa.string()))
        starts = part_starts(data, offsets, self.usual and not any(map(self.special.search, texts)))
        parts = pa.StringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, len(data)).astype(np.int32)), pa.py_buffer(data)).dictionary_encode()
        distinct = parts.dictionary.to_numpy(zero_copy_only=False).tolist()
        known = list(map(self.get, distinct))
        self.learn([p for p, x in zip(distinct, known, strict=True) if x is None and len(p) <= MEMO_CHARS])
        ids = pa.array([self[p] if x is None else x for p, x in zip(distinct, known, strict=True)], pa.binary()).take(parts.indices)
        made, ends = text_bytes(ids)
        made, bounds = memoryview(made), ends[np.searchsorted(starts, offsets)].tolist()
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            yield made[a:b]

    def of(self, text: str, end: int) -> np.ndarray:
        """All ids of a text, then ``end``."""
        return next(self.of_many([text], end))


def part_ids(path: str) -> PartIds:
    return remembered(("parts", path), lambda: PartIds(path))
