"""Telephony audio columns: mu-law, A-law and IMA ADPCM in WAV containers, and resampled PCM.

Companded samples are expanded by lookup tables. ADPCM is sequential inside a block and independent between blocks, so
numpy decodes sample k of all blocks of a batch in one step. Texts may stand in for audio: any bytes are valid samples.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map

FORMAT = {"mulaw": 7, "alaw": 6, "adpcm": 0x11}
UNIT = 64  # bytes of an ADPCM block; payloads are padded to this
RATE = 8000


@functools.cache
def mulaw_table() -> np.ndarray:
    """G.711 mu-law: code to 16-bit sample."""
    c = ~np.arange(256, dtype=np.int32) & 0xFF
    size = (((c & 0x0F) << 3) + 0x84) << ((c & 0x70) >> 4)
    return np.where(c & 0x80, 0x84 - size, size - 0x84).astype(np.int16)


@functools.cache
def alaw_table() -> np.ndarray:
    """G.711 A-law: code to 16-bit sample."""
    c = np.arange(256, dtype=np.int32) ^ 0x55
    segment, low = (c & 0x70) >> 4, (c & 0x0F) << 4
    size = np.where(segment == 0, low + 8, (low + 0x108) << np.maximum(segment - 1, 0))
    return np.where(c & 0x80, size, -size).astype(np.int16)


@functools.cache
def ima_steps() -> np.ndarray:
    """The 89 step sizes of IMA ADPCM (fixed values of the format)."""
    return np.array(
        [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767],
        dtype=np.int32,
    )


#: How far a nibble's size moves the step index (fixed values of the format).
IMA_MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8], dtype=np.int32)


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """(n, block bytes) uint8 to (n, samples) int16: a 4-byte header (sample, step index), then two samples a byte."""
    n, width = blocks.shape
    header = np.ascontiguousarray(blocks[:, :2]).view("<i2")[:, 0]
    value, index = header.astype(np.int32), np.minimum(blocks[:, 2], 88).astype(np.int32)
    out = np.empty((n, 1 + 2 * (width - 4)), np.int16)
    out[:, 0] = value
    steps = ima_steps()
    for k in range(2 * (width - 4)):
        code = (blocks[:, 4 + k // 2] >> (4 * (k % 2))) & 0x0F
        step, size = steps[index], (code & 7).astype(np.int32)
        moved = ((2 * size + 1) * step) >> 3
        value = np.clip(np.where(code & 8, value - moved, value + moved), -32768, 32767)
        index = np.clip(index + IMA_MOVES[size], 0, 88)
        out[:, k + 1] = value
    return out


def encode_adpcm(pcm: np.ndarray, width: int = UNIT) -> np.ndarray:
    """Samples to blocks, by the same steps; the last block is filled with its last sample."""
    per = 1 + 2 * (width - 4)
    n = max(1, -(-len(pcm) // per))
    x = np.concatenate((pcm, np.full(n * per - len(pcm), pcm[-1] if len(pcm) else 0))).reshape(n, per).astype(np.int32)
    blocks, steps = np.zeros((n, width), np.uint8), ima_steps()
    blocks[:, :2] = x[:, 0].astype("<i2")[:, None].view(np.uint8)
    value, index = x[:, 0].copy(), np.zeros(n, np.int32)
    for k in range(per - 1):
        step, gap = steps[index], x[:, k + 1] - value
        size = np.minimum(np.abs(gap) * 4 // step, 7).astype(np.int32)
        moved = ((2 * size + 1) * step) >> 3
        value = np.clip(np.where(gap < 0, value - moved, value + moved), -32768, 32767)
        index = np.clip(index + IMA_MOVES[size], 0, 88)
        blocks[:, 4 + k // 2] |= ((size | np.where(gap < 0, 8, 0)) << (4 * (k % 2))).astype(np.uint8)
    return blocks


def resample2(pcm: np.ndarray) -> np.ndarray:
    """Twice the rate: the samples, and between them a four-point half-band interpolation."""
    if not len(pcm):
        return pcm.astype(np.int16)
    x = np.concatenate((pcm[:1], pcm, pcm[-1:], pcm[-1:])).astype(np.int32)
    between = (9 * (x[1:-2] + x[2:-1]) - (x[:-3] + x[3:]) + 8) >> 4
    out = np.empty(2 * len(pcm), np.int16)
    out[::2], out[1::2] = pcm, np.clip(between, -32768, 32767)
    return out


def wav(samples: bytes, codec: str = "mulaw", rate: int = RATE) -> bytes:
    """A RIFF/WAVE file of one channel."""
    if codec == "adpcm":
        per = 1 + 2 * (UNIT - 4)
        form = struct.pack("<HHIIHHHH", FORMAT[codec], 1, rate, rate * UNIT // per, UNIT, 4, 2, per)
        count = len(samples) // UNIT * per
    else:
        form = struct.pack("<HHIIHHH", FORMAT[codec], 1, rate, rate, 1, 8, 0)
        count = len(samples)
    body = b"WAVEfmt " + struct.pack("<I", len(form)) + form + b"fact" + struct.pack("<II", 4, count) + b"data" + struct.pack("<I", len(samples)) + samples + b"\0" * (len(samples) % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def unwav(data: bytes) -> tuple[str, int, bytes]:
    """Codec, rate and sample bytes of a file by wav(); chunks it doesn't know are skipped."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, codec, rate = 12, None, 0
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name == b"fmt ":
            tag, _, rate = struct.unpack_from("<HHI", data, at + 8)
            codec = next((k for k, v in FORMAT.items() if v == tag), None)
        elif name == b"data":
            if codec is None or at + 8 + size > len(data):
                raise ValueError("unknown format or short data")
            return codec, rate, data[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data")


def adpcm_counts(sizes: np.ndarray) -> np.ndarray:
    """Samples in so many bytes of ADPCM blocks; a last block that ends early has fewer, one without its whole header none."""
    rest = sizes % UNIT
    return sizes // UNIT * (1 + 2 * (UNIT - 4)) + np.where(rest < 4, 0, 1 + 2 * (rest - 4))


def adpcm_pcm(payloads: list[bytes]) -> np.ndarray:
    """PCM of the ADPCM blocks of several files, one file after the other."""
    per = 1 + 2 * (UNIT - 4)
    sizes = np.array([len(x) for x in payloads], np.int64)
    whole = np.frombuffer(b"".join(x + b"\0" * (-len(x) % UNIT) for x in payloads), np.uint8)
    pcm, counts, room = decode_adpcm(whole.reshape(-1, UNIT)).reshape(-1), adpcm_counts(sizes), -(-sizes // UNIT) * per
    if (counts == room).all():
        return pcm
    starts = np.cumsum(room) - room
    return np.concatenate([pcm[at : at + n] for at, n in zip(starts.tolist(), counts.tolist(), strict=True)])


def expand(codec: str, samples: bytes) -> np.ndarray:
    """PCM of one file's samples."""
    if codec == "adpcm":
        return adpcm_pcm([samples])
    return (mulaw_table() if codec == "mulaw" else alaw_table())[np.frombuffer(samples, np.uint8)]


def encode_media(docs: DataFrame, keys: list[str], codec: str = "mulaw", text: str = "text") -> DataFrame:
    """keys, n_bytes, media (a WAV file) for every row: the text's UTF-8 bytes, padded with 0 to a positive multiple of 64, as samples.

    Null and empty texts become 64 zero bytes. Nothing is lost: the payload is read back from the file unchanged. Repeated rows give
    equal files, an empty table gives an empty result, a very long text is one file (a WAVE file holds up to 4 GB), and columns of docs
    that are not in keys are ignored.
    """
    picked = docs.select(*keys, F.col(text).alias("__text"))
    types = dict(picked.dtypes)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column("__text").to_pylist()]
        files = [wav(x + b"\0" * (max(UNIT, -(-len(x) // UNIT) * UNIT) - len(x)), codec) for x in raw]
        return pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array([len(x) for x in raw], pa.int64()), pa.array(files, pa.binary())], [*keys, "n_bytes", "media"])

    return arrow_map(picked, run, ", ".join(f"`{k}` {types[k]}" for k in keys) + ", n_bytes long, media binary", "__text")


def pcm_media(media: DataFrame, keys: list[str]) -> DataFrame:
    """keys, rate and pcm (16-bit little-endian at twice the file's rate) of a `media` column; null media give nulls."""
    types = dict(media.dtypes)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rates, pcm = [], []
        for data in batch.column("media").to_pylist():
            codec, rate, samples = unwav(data) if data is not None else (None, None, None)
            rates.append(None if rate is None else 2 * rate)
            pcm.append(None if codec is None else resample2(expand(codec, samples)).astype("<i2").tobytes())
        return pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(rates, pa.int32()), pa.array(pcm, pa.binary())], [*keys, "rate", "pcm"])

    return arrow_map(media.select(*keys, "media"), run, ", ".join(f"`{k}` {types[k]}" for k in keys) + ", rate int, pcm binary", "media")


def _levels(pcm: np.ndarray, counts: np.ndarray) -> list[tuple[int, int, int]]:
    """Root mean square, peak and sign changes of each file's stretch of pcm; 0 for a file without samples."""
    out, full = np.zeros((len(counts), 3), np.int64), counts > 0
    if full.any():
        starts = (np.cumsum(counts) - counts)[full]
        x = pcm.astype(np.int64)
        turn = np.zeros(len(x), np.int64)
        turn[1:] = (x[1:] < 0) != (x[:-1] < 0)
        turn[starts] = 0
        out[full, 0] = np.sqrt(np.add.reduceat(x * x, starts) // counts[full])
        out[full, 1] = np.maximum.reduceat(np.abs(x), starts)
        out[full, 2] = np.add.reduceat(turn, starts)
    return [tuple(x) for x in out.tolist()]


def read_media(media: DataFrame, keys: list[str]) -> DataFrame:
    """What is in the stored files: keys, payload digests, file digests, a feature string, and rate and pcm as pcm_media() gives them.

    feature: root mean square, peak and sign changes of the samples as mu-law, as A-law and as 64-byte ADPCM blocks (the last may be
    short). Files may hold any number of bytes of samples; null media give nulls. Files are opened about 1 MB at a time, a larger one by
    itself; PCM over 2 GB is an error, since no row holds it. Repeated rows give equal results, an empty table gives an empty result.
    """
    types = dict(media.dtypes)
    out_schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, rate int, pcm binary"

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        files = batch.column("media").to_pylist()
        opened = [unwav(x) if x is not None else None for x in files]
        payloads = [x[2] if x is not None else b"" for x in opened]
        counts = np.array([len(x) for x in payloads], np.int64)
        codes = np.frombuffer(b"".join(payloads), np.uint8)
        sounds = {"mulaw": mulaw_table()[codes], "alaw": alaw_table()[codes], "adpcm": adpcm_pcm(payloads)}
        sizes = {"mulaw": counts, "alaw": counts, "adpcm": adpcm_counts(counts)}
        levels = {name: _levels(sounds[name], sizes[name]) for name in sounds}
        ends = {name: np.cumsum(sizes[name]) for name in sounds}
        feature, pcm = [], []
        for i, x in enumerate(opened):
            if x is None:
                feature.append(None)
                pcm.append(None)
                continue
            feature.append(";".join(f"{name}:{','.join(map(str, levels[name][i]))}" for name in sounds))
            own = sounds[x[0]][ends[x[0]][i] - sizes[x[0]][i] : ends[x[0]][i]]
            pcm.append(resample2(own).astype("<i2").tobytes())
        there = lambda fn, values, kind: pa.array([fn(v) if x is not None else None for v, x in zip(values, opened, strict=True)], kind)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        cols = [*(batch.column(k) for k in keys), there(len, payloads, pa.int64()), there(sha, payloads, pa.string()), there(lambda x: zlib.crc32(x[-UNIT:]), payloads, pa.int64())]
        cols += [there(len, files, pa.int64()), there(sha, files, pa.string()), pa.array(feature, pa.string()), there(lambda x: 2 * x[1], opened, pa.int32()), pa.array(pcm, pa.binary())]
        return pa.RecordBatch.from_arrays(cols, [*keys, "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "rate", "pcm"])

    return arrow_map(media.select(*keys, "media"), run, out_schema, "media", 1 << 20)


def with_pcm_crc(heard: DataFrame) -> DataFrame:
    """heard with rate and the CRC of the bytes of pcm at the end of its feature in place of both columns; null pcm give null features."""
    crc = F.lpad(F.lower(F.hex(F.crc32("pcm"))), 8, "0")
    return heard.withColumn("feature", F.concat("feature", F.lit(";pcm"), F.col("rate").cast("string"), F.lit(":"), crc)).drop("rate", "pcm")
