"""Telephony audio in WAV containers: mu-law and A-law by lookup tables, IMA ADPCM with numpy across blocks.

``decode`` turns a column of WAV bytes into resampled 16-bit PCM. Malformed or null bytes give status ``bad`` and null
PCM, an empty data chunk gives empty PCM; no row is dropped. ``op3_telephony_media`` stores each text's bytes as 8-bit
mu-law samples, reads them back from the stored form and computes features of all three decodings.

Defined cases of the query besides: equal rows have equal results, each its own; an empty table gives an empty result; further columns
are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import common as c

BLOCK = 576
RATE = 8000
OUT_RATE = 16000
ALAW, ULAW, ADPCM = 6, 7, 17


def _ulaw() -> np.ndarray:
    u = ~np.arange(256, dtype=np.uint8)
    t = (((u & 15).astype(np.int32) << 3) + 132 << (u >> 4 & 7).astype(np.int32)) - 132
    return np.where(u & 128, -t, t).astype(np.int16)


def _alaw() -> np.ndarray:
    a = np.arange(256, dtype=np.uint8) ^ 0x55
    seg, low = (a >> 4 & 7).astype(np.int32), (a & 15).astype(np.int32) << 4
    t = np.where(seg == 0, low + 8, low + 264 << np.maximum(seg - 1, 0))
    return np.where(a & 128, t, -t).astype(np.int16)


ULAW_PCM, ALAW_PCM = _ulaw(), _alaw()
#: The standard 89 step sizes: each about 1.1 times the one before.
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], np.int32)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For step index * 16 + nibble: what the sample moves by, and the next step index * 16."""
    s, n = STEPS[:, None], np.arange(16)[None, :]
    move = (s >> 3) + np.where(n & 1, s >> 2, 0) + np.where(n & 2, s >> 1, 0) + np.where(n & 4, s, 0)
    step = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2)[None, :]
    nxt = np.clip(np.arange(89)[:, None] + step, 0, 88) * 16
    return np.where(n & 8, -move, move).astype(np.int32).ravel(), nxt.astype(np.int32).ravel()


MOVE, NEXT = _tables()


def adpcm(data: np.ndarray, block: int) -> np.ndarray:
    """(blocks, samples) of mono IMA ADPCM: one step of the recurrence at a time, over all blocks at once."""
    b = data.reshape(-1, block)
    nib = np.empty(((block - 4) * 2, len(b)), np.int32)
    nib[0::2], nib[1::2] = (b[:, 4:] & 15).T, (b[:, 4:] >> 4).T
    pred = np.ascontiguousarray(b[:, :2]).view("<i2").ravel().astype(np.int32)
    at = np.minimum(b[:, 2], 88).astype(np.int32) * 16
    out = np.empty((len(nib) + 1, len(b)), np.int16)
    out[0] = pred
    for i, x in enumerate(nib):
        at += x
        pred += MOVE[at]
        np.clip(pred, -32768, 32767, out=pred)
        at = NEXT[at]
        out[i + 1] = pred
    return np.ascontiguousarray(out.T)


def resample(pcm: np.ndarray, rate: int, to: int = OUT_RATE) -> np.ndarray:
    """Doubling is a four-point filter, any other ratio is linear."""
    if rate == to or not len(pcm):
        return pcm.astype("<i2")
    if to == 2 * rate:
        x = np.empty(len(pcm) + 3, np.int32)
        x[1:-2], x[0], x[-2:] = pcm, pcm[0], pcm[-1]
        out = np.empty(2 * len(pcm), "<i2")
        out[0::2] = pcm
        mid = 9 * (x[1:-2] + x[2:-1]) - x[:-3] - x[3:] + 8 >> 4
        out[1::2] = np.clip(mid, -32768, 32767)
        return out
    n = len(pcm) * to // rate
    return np.rint(np.interp(np.arange(n) * rate / to, np.arange(len(pcm)), pcm)).astype("<i2")


def wav(payload: bytes, tag: int = ULAW, rate: int = RATE, block: int = 1) -> bytes:
    """A mono container; for ADPCM, block is its block size and the payload whole blocks."""
    per = (block - 4) * 2 + 1 if tag == ADPCM else 1
    more = struct.pack("<HH", 2, per) if tag == ADPCM else struct.pack("<H", 0)
    fmt = struct.pack("<HHIIHH", tag, 1, rate, rate * block // per, block, 4 if tag == ADPCM else 8) + more
    body = b"WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + b"fact" + struct.pack("<II", 4, len(payload) // block * per) + b"data" + struct.pack("<I", len(payload)) + payload
    return b"RIFF" + struct.pack("<I", len(body) + len(payload) % 2) + body + b"\0" * (len(payload) % 2)


def parse(media: bytes) -> tuple[int, int, int, memoryview] | None:
    """(format tag, rate, block, data), or None for what isn't such a container."""
    if len(media) < 12 or media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        return None
    at, fmt, view = 12, None, memoryview(media)
    while at + 8 <= len(media):
        name, n = media[at : at + 4], int.from_bytes(media[at + 4 : at + 8], "little")
        body = view[at + 8 : at + 8 + n]
        if name == b"fmt " and len(body) >= 16:
            fmt = struct.unpack("<HHIIHH", body[:16])
        elif name == b"data" and fmt and len(body) == n and fmt[1] == 1 and fmt[2]:
            return fmt[0], fmt[2], fmt[4], body
        at += 8 + n + n % 2
    return None


def to_pcm(media: bytes | None, to: int = OUT_RATE) -> np.ndarray | None:
    found = parse(media) if media else None
    if found is None:
        return None
    tag, rate, block, data = found
    raw = np.frombuffer(data, np.uint8)
    if tag in (ULAW, ALAW):
        return resample((ULAW_PCM if tag == ULAW else ALAW_PCM)[raw], rate, to)
    if tag == ADPCM and block > 4 and len(raw) % block == 0:
        return resample(adpcm(raw, block).ravel(), rate, to)
    return None


def decode(df: DataFrame, column: str = "media", to: int = OUT_RATE) -> DataFrame:
    """df with status, n_samples and pcm (16-bit little-endian at ``to`` Hz) beside its own columns. Clashing names give
    way: the new columns are then called status_decoded and so on."""
    names = {x: x if x not in df.columns else f"{x}_decoded" for x in ("status", "n_samples", "pcm")}
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                pcm = [to_pcm(x, to) for x in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(["bad" if x is None else "ok" for x in pcm]), pa.array([None if x is None else len(x) for x in pcm], pa.int64()), pa.array([None if x is None else x.tobytes() for x in pcm], pa.binary())], [f"c{k}" for k in range(part.num_columns + 3)])

    kinds = [*(t for _, t in df.dtypes), "string", "long", "binary"]
    out = df.toDF(*(f"c{k}" for k in range(len(df.columns)))).mapInArrow(run, ", ".join(f"c{k} {t}" for k, t in enumerate(kinds)))
    return out.toDF(*df.columns, *names.values())


def _level(pcm: np.ndarray) -> str:
    x = pcm.astype(np.int64)
    return f"{int(np.dot(x, x)) // len(x)}/{int(np.count_nonzero((pcm[1:] < 0) != (pcm[:-1] < 0)))}"


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """feature: mean square and sign changes by mu-law and by A-law; checksums of the ADPCM and of the resampled PCM."""
    for b in batches:
        data, off = c.utf8(b.column(1))
        i = 0
        while i < b.num_rows:
            j = max(i + 1, int(np.searchsorted(off, off[i] + (4 << 20), "right")) - 1)
            rows, blocks, read = [], [0], []
            for k in range(i, j):
                raw = data[off[k] : off[k + 1]].tobytes()
                media = wav(raw + b"\xff" * (-len(raw) % BLOCK or (0 if raw else BLOCK)))
                tag, rate, _, body = parse(media)
                back = np.frombuffer(body, np.uint8)
                read.append(back)
                blocks.append(blocks[-1] + len(back) // BLOCK)
                pcm = resample(ULAW_PCM[back], rate)
                rows.append([len(raw), len(back), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-32:]), len(media), hashlib.sha256(media).hexdigest(), f"ulaw={_level(ULAW_PCM[back])};alaw={_level(ALAW_PCM[back])};pcm={zlib.crc32(pcm.tobytes()):08x}", len(pcm)])
            wave = adpcm(np.concatenate(read), BLOCK)
            for r, s, e in zip(rows, blocks, blocks[1:], strict=False):
                r[6] += f";adpcm={zlib.crc32(wave[s:e]):08x}"
            cols = list(zip(*rows, strict=True))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i).cast(pa.int64()), *(pa.array(x, t) for x, t in zip(cols, kinds, strict=True))], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pcm_samples"])
            i = j


def op3_telephony_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.table(spark, sf_dir, "documents").select("doc_id", "text").mapInArrow(_digest, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pcm_samples long")
