"""Operator 4: media columns of telephony audio.

mu-law and A-law samples are expanded by 256-entry tables made from their rules; IMA
ADPCM is decoded with numpy across blocks (the k-th nibble of all blocks at once); PCM is
resampled by rational linear interpolation and stored as WAVE bytes in a column.

Texts are stored as the samples of one of the three forms, by the crc32 of their bytes, and
beside them the sound resampled to PCM.  Null texts are empty ones and padded to one unit;
equal texts give equal media, and rows that repeat stay.  Long sounds are resampled and
measured in pieces, so that a text takes a few times its size.  Media that are null or
no WAVE file give null.  An empty table gives no rows; other columns of texts are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import written

PCM, A_LAW, MU_LAW, ADPCM = 1, 6, 7, 17
UNIT = 64
#: Samples a second: of the coded sound, of decoded media, and of the sound kept beside a text.
RATE, OUT_RATE, TEXT_RATE = 8_000, 12_000, 2_000
#: Samples that are resampled or measured at once.
PIECE = 1 << 20
#: An ADPCM block of a text: a header and one unit of its bytes.
TEXT_BLOCK = UNIT + 4

#: Fixed values of IMA ADPCM: how each code moves the step index.
INDEX_MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2)
#: Fixed values of IMA ADPCM: the step sizes.
STEPS = np.array(
    [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767]
)


def _mu_table() -> np.ndarray:
    code = ~np.arange(256) & 255
    size = (((code & 15) << 3) + 132 << (code >> 4 & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def _a_table() -> np.ndarray:
    code = np.arange(256) ^ 0x55
    step, fine = code >> 4 & 7, (code & 15) << 4
    size = np.where(step == 0, fine + 8, fine + 264 << np.maximum(step - 1, 0))
    return np.where(code & 128, size, -size).astype(np.int16)


MU_TABLE, A_TABLE = _mu_table(), _a_table()


def adpcm_decode(data: bytes, block: int) -> np.ndarray:
    """Mono IMA ADPCM: the blocks (a 4-byte header, then low nibble first) are decoded side by side."""
    n = len(data) // block
    if not n:
        return np.zeros(0, np.int16)
    rows = np.frombuffer(data[: n * block], np.uint8).reshape(n, block)
    value = rows[:, :2].copy().view("<i2").ravel().astype(np.int64)
    index = np.minimum(rows[:, 2].astype(np.int64), 88)
    codes = np.stack([rows[:, 4:] & 15, rows[:, 4:] >> 4], axis=2).reshape(n, -1)
    out = np.empty((n, codes.shape[1] + 1), np.int16)
    out[:, 0] = value
    for k in range(codes.shape[1]):
        code, step = codes[:, k], STEPS[index]
        move = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
        value = np.clip(value + np.where(code & 8, -move, move), -32768, 32767)
        index = np.clip(index + INDEX_MOVES[code], 0, 88)
        out[:, k + 1] = value
    return out.ravel()


def adpcm_encode(pcm: np.ndarray, block: int) -> bytes:
    """The inverse for tests and sinks, also across blocks; the last block is filled with its last value."""
    per = (block - 4) * 2 + 1
    n = -(-len(pcm) // per)
    if not n:
        return b""
    rows = np.concatenate([pcm, np.full(n * per - len(pcm), pcm[-1])]).reshape(n, per).astype(np.int64)
    value, index = rows[:, 0].copy(), np.zeros(n, np.int64)
    codes = np.zeros((n, per - 1), np.uint8)
    for k in range(per - 1):
        gap, step = rows[:, k + 1] - value, STEPS[index]
        sign, left = np.where(gap < 0, 8, 0), np.abs(gap)
        code = np.where(left >= step, 4, 0)
        left = left - np.where(code, step, 0)
        half = left >= step >> 1
        code, left = code + 2 * half, left - np.where(half, step >> 1, 0)
        code = code + (left >= step >> 2) + sign
        move = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
        value = np.clip(value + np.where(code & 8, -move, move), -32768, 32767)
        index = np.clip(index + INDEX_MOVES[code], 0, 88)
        codes[:, k] = code
    head = np.zeros((n, 4), np.uint8)
    head[:, :2] = rows[:, :1].astype("<i2").view(np.uint8).reshape(n, 2)
    return np.concatenate([head, codes[:, ::2] | codes[:, 1::2] << 4], axis=1).tobytes()


def wave(data: bytes, form: int, rate: int = RATE, block: int = 1) -> bytes:
    """WAVE bytes of one channel: fmt and data chunks; an odd data chunk gets its pad byte."""
    bits = {PCM: 16, ADPCM: 4}.get(form, 8)
    block = 2 if form == PCM else block
    fmt = struct.pack("<HHIIHHH", form, 1, rate, rate * block if form != ADPCM else rate // 2, block, bits, 0)
    body = b"WAVE" + b"fmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def unwave(media: bytes) -> tuple[int, int, int, bytes]:
    """(form, rate, block, data) of WAVE bytes; other chunks are passed over."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, form, rate, block, data = 12, None, None, 1, None
    while at + 8 <= len(media):
        kind, size = media[at : at + 4], struct.unpack("<I", media[at + 4 : at + 8])[0]
        if kind == b"fmt ":
            form, _, rate, _, block = struct.unpack("<HHIIH", media[at + 8 : at + 22])
        elif kind == b"data":
            data = media[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    if form is None or data is None:
        raise ValueError("no fmt or data chunk")
    return form, rate, block, data


def is_wave(media: bytes | None) -> bool:
    """True if unwave() can read it."""
    if not media:
        return False
    try:
        return unwave(media)[0] in (PCM, A_LAW, MU_LAW, ADPCM)
    except (ValueError, struct.error):
        return False


def expand(form: int, block: int, data: bytes) -> np.ndarray:
    """16-bit samples of the stored data."""
    codes = np.frombuffer(data, np.uint8)
    if form == MU_LAW:
        return MU_TABLE[codes]
    if form == A_LAW:
        return A_TABLE[codes]
    if form == ADPCM:
        return adpcm_decode(data, block)
    return np.frombuffer(data[: len(data) // 2 * 2], "<i2")


def resample(pcm: np.ndarray, rate: int, out_rate: int) -> np.ndarray:
    """Linear interpolation in whole numbers: the same on every machine."""
    if rate == out_rate or not len(pcm):
        return pcm
    out = np.empty((len(pcm) - 1) * out_rate // rate + 1, np.int16)
    for start in range(0, len(out), PIECE):
        place = np.arange(start, min(start + PIECE, len(out)), dtype=np.int64) * rate
        left, part = place // out_rate, place % out_rate
        a, b = pcm[left].astype(np.int64), pcm[np.minimum(left + 1, len(pcm) - 1)].astype(np.int64)
        out[start : start + PIECE] = a + (b - a) * part // out_rate
    return out


def mean_resample(pcm: np.ndarray, rate: int, out_rate: int) -> np.ndarray:
    """To a lower rate by the floor of the mean over each new sample's time, shares of samples included, so that every sample counts.

    The last covers what is left; to a rate that is not lower as resample does.
    """
    if out_rate >= rate or not len(pcm):
        return resample(pcm, rate, out_rate)
    end = len(pcm) * out_rate
    out = np.empty(-(-end // rate), np.int16)
    for start in range(0, len(out), PIECE):
        edges = np.minimum(np.arange(start, min(start + PIECE, len(out)) + 1, dtype=np.int64) * rate, end)
        left, part = edges // out_rate, edges % out_rate
        first = int(left[0])
        x = np.append(pcm[first : int(left[-1]) + 1].astype(np.int64), 0)
        before = np.append(0, np.cumsum(x)) * out_rate
        out[start : start + PIECE] = np.diff(before[left - first] + x[left - first] * part) // np.diff(edges)
    return out


def feature(pcm: np.ndarray) -> str:
    """samples:mean size:peak:sign changes:energy in thousandths, of resampled PCM."""
    total = peak = turns = energy = 0
    for start in range(0, len(pcm), PIECE):
        x = pcm[max(0, start - 1) : start + PIECE].astype(np.int64)
        turns += int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
        x = x[1:] if start else x
        total, peak, energy = total + int(np.abs(x).sum()), max(peak, int(np.abs(x).max())), energy + int((x * x).sum())
    n = max(1, len(pcm))
    return f"{len(pcm)}:{total // n}:{peak}:{turns}:{energy * 1000 // (n << 30)}"


def payload(text: str | None) -> bytes:
    data = (text or "").encode()
    return data + b"\0" * ((-len(data)) % UNIT or (0 if data else UNIT))


def coded(data: bytes) -> bytes:
    """A payload as WAVE bytes: samples of mu-law or A-law, or the codes of ADPCM blocks whose headers are 0."""
    form = (MU_LAW, A_LAW, ADPCM)[zlib.crc32(data) % 3]
    if form != ADPCM:
        return wave(data, form)
    rows = np.zeros((len(data) // UNIT, TEXT_BLOCK), np.uint8)
    rows[:, 4:] = np.frombuffer(data, np.uint8).reshape(-1, UNIT)
    return wave(rows.tobytes(), form, block=TEXT_BLOCK)


def uncoded(form: int, block: int, data: bytes) -> bytes:
    """The payload of stored data."""
    return np.frombuffer(data, np.uint8).reshape(-1, block)[:, 4:].tobytes() if form == ADPCM else data


def as_pcm(media: list[bytes], out_rate: int, convert=resample) -> list[bytes]:
    """Media of any form above as resampled 16-bit PCM WAVE bytes; ADPCM blocks of many of them are decoded side by side."""
    out: list[bytes] = [b""] * len(media)
    waiting: dict[int, list[tuple[int, int, bytes]]] = {}

    def done(k: int, rate: int, pcm: np.ndarray) -> None:
        out[k] = wave(convert(pcm, rate, out_rate).astype("<i2").tobytes(), PCM, out_rate)

    def decode(block: int) -> None:
        rows = waiting.pop(block)
        sound, per, at = adpcm_decode(b"".join(d for _, _, d in rows), block), (block - 4) * 2 + 1, 0
        for k, rate, data in rows:
            n = len(data) // block * per
            done(k, rate, sound[at : at + n])
            at += n

    for k, x in enumerate(media):
        form, rate, block, data = unwave(x)
        if form != ADPCM:
            done(k, rate, expand(form, block, data))
            continue
        waiting.setdefault(block, []).append((k, rate, data[: len(data) // block * block]))
        if len(data) > PIECE or len(waiting[block]) >= 512:
            decode(block)
    for block in list(waiting):
        decode(block)
    return out


def text_media(docs: DataFrame, out_rate: int = TEXT_RATE, convert=resample) -> DataFrame:
    """doc_id, n_bytes, media (each text's padded bytes in a WAVE file) and pcm (its sound, resampled by convert)."""
    @F.arrow_udf("media binary, pcm binary")
    def stored(texts: pa.Array) -> pa.Array:
        media = [coded(payload(x.as_py())) for x in texts]
        return pa.StructArray.from_arrays([pa.array(media, pa.binary()), pa.array(as_pcm(media, out_rate, convert), pa.binary())], ["media", "pcm"])

    return docs.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), stored("text").alias("m")).select("doc_id", "n_bytes", "m.*")


def decode_media(media: DataFrame, out_rate: int = OUT_RATE) -> DataFrame:
    """The frame with its column media (any form above) as resampled 16-bit PCM WAVE bytes; null where it is null or no WAVE file."""
    @F.arrow_udf("binary")
    def pcm(column: pa.Array) -> pa.Array:
        media = column.to_pylist()
        made = iter(as_pcm([x for x in media if is_wave(x)], out_rate))
        return pa.array([next(made) if is_wave(x) else None for x in media], pa.binary())

    return media.withColumn("media", pcm("media"))


def media_digests(media: DataFrame) -> DataFrame:
    """What the stored columns media and pcm hold: payload and media digests and the feature of the sound; null where a column is null or no WAVE file."""
    kind = pa.struct([("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])

    @F.arrow_udf("payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    def digest(column: pa.Array, sounds: pa.Array) -> pa.Array:
        rows = []
        for k in range(len(column)):
            x, sound = column[k].as_py(), sounds[k].as_py()
            heard = feature(np.frombuffer(unwave(sound)[3], "<i2")) if is_wave(sound) else None
            if not is_wave(x):
                rows.append((None, None, None, None, None, heard))
                continue
            form, _, block, data = unwave(x)
            data = uncoded(form, block, data)
            rows.append((len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-UNIT:]), len(x), hashlib.sha256(x).hexdigest(), heard))
        return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], kind.field(i).type) for i in range(6)], fields=list(kind))

    return media.select("doc_id", "n_bytes", digest("media", "pcm").alias("d")).select("doc_id", "n_bytes", "d.*")


def stored_text_media(docs: DataFrame, convert=resample) -> DataFrame:
    """Write the media table to the shared folder and compute digests from what is read back."""
    return media_digests(written(text_media(docs, convert=convert), "media"))
