"""Telephony audio: G.711 expansion by lookup tables, IMA ADPCM decoded across blocks, resampled PCM."""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BLOCK, RATE = 192, 8000
#: Of Zstandard, for media and PCM on disk.
LEVEL = 9
#: Format tags of WAVE files.
TAGS = {"alaw": 6, "mulaw": 7, "adpcm": 0x11}
#: The step sizes and index changes of IMA ADPCM.
STEPS = [
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
    130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060,
    1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484,
    7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
]
INDEX_CHANGES = [-1, -1, -1, -1, 2, 4, 6, 8]


def mulaw_table() -> np.ndarray:
    code = ~np.arange(256) & 0xFF
    size = (((code & 0x0F) << 3) + 0x84 << (code >> 4 & 7)) - 0x84
    return np.where(code & 0x80, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    code = np.arange(256) ^ 0x55
    exponent, size = code >> 4 & 7, ((code & 0x0F) << 4) + 8
    size = np.where(exponent > 0, size + 0x100 << np.maximum(exponent - 1, 0), size)
    return np.where(code & 0x80, size, -size).astype(np.int16)


def _adpcm_tables() -> tuple[np.ndarray, np.ndarray]:
    """For 16 x index + nibble: the change of the sample, and 16 x the next index."""
    step, nibble = np.array(STEPS)[:, None], np.arange(16)[None, :]
    change = (step >> 3) + (step >> 2) * (nibble & 1) + (step >> 1) * (nibble >> 1 & 1) + step * (nibble >> 2 & 1)
    after = np.clip(np.arange(89)[:, None] + np.array(INDEX_CHANGES * 2)[None, :], 0, 88)
    return np.where(nibble & 8, -change, change).astype(np.int32).ravel(), (16 * after).astype(np.int32).ravel()


MULAW, ALAW = mulaw_table(), alaw_table()
_CHANGE, _AFTER = _adpcm_tables()


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """int16 samples (n, 377) of n IMA ADPCM blocks (n, 192): all blocks advance together, one nibble at a time.

    A block has a first sample of two bytes, an index byte (clipped to 88), a reserved byte, then low nibbles first.
    """
    n = len(blocks)
    out = np.empty((2 * (BLOCK - 4) + 1, n), np.int16)
    value = blocks[:, :2].copy().view("<i2").ravel().astype(np.int32)
    state = 16 * np.minimum(blocks[:, 2], 88).astype(np.int32)
    data = np.ascontiguousarray(blocks[:, 4:].T)
    out[0] = value
    for k in range(BLOCK - 4):
        for shift in (0, 4):
            code = state + (data[k] >> shift & 15)
            value += _CHANGE[code]
            np.clip(value, -32768, 32767, out=value)
            state = _AFTER[code]
            out[2 * k + 1 + (shift > 0)] = value
    return out.T


def _between(pcm: np.ndarray) -> np.ndarray:
    """int32: after each sample (-1, 9, 9, -1) / 16 of its neighbours, the ends repeated."""
    if not len(pcm):
        return pcm.astype(np.int32)
    x = np.pad(pcm.astype(np.int32), (1, 2), mode="edge")
    return np.clip((9 * (x[1:-2] + x[2:-1]) - x[:-3] - x[3:] + 8) >> 4, -32768, 32767)


def resample_double(pcm: np.ndarray) -> np.ndarray:
    """Twice the rate: samples between are (-1, 9, 9, -1) / 16 of their neighbours, the ends repeated."""
    out = np.empty(2 * len(pcm), "<i2")
    out[0::2] = pcm
    out[1::2] = _between(pcm)
    return out


def pack_pcm(pcm: np.ndarray) -> bytes:
    """As many bytes as any 16-bit samples have, in an order that Zstandard compresses well and without loss: every second
    sample as it is, then what the others differ by from the interpolation of those (modulo 2 ** 16)."""
    rest = pcm[1::2].astype(np.int32)
    return pcm[0::2].astype("<i2").tobytes() + (rest - _between(pcm[0::2])[: len(rest)]).astype("<i2").tobytes()


def unpack_pcm(packed: bytes) -> np.ndarray:
    """The samples of pack_pcm(), from its bytes alone."""
    found = np.frombuffer(packed, "<i2")
    half = -(-len(found) // 2)
    out = np.empty(len(found), "<i2")
    out[0::2] = found[:half]
    out[1::2] = (found[half:] + _between(found[:half])[: len(found) - half]).astype("<i2")
    return out


def to_wav(payload: bytes, codec: str = "mulaw") -> bytes:
    """A mono WAVE file of 8 kHz whose data chunk is the payload as it is."""
    if codec == "adpcm":
        per_block = 2 * (BLOCK - 4) + 1
        fmt = struct.pack("<HHIIHHHH", TAGS[codec], 1, RATE, RATE * BLOCK // per_block, BLOCK, 4, 2, per_block)
        samples = len(payload) // BLOCK * per_block
    else:
        fmt, samples = struct.pack("<HHIIHHH", TAGS[codec], 1, RATE, RATE, 1, 8, 0), len(payload)
    chunks = b"".join(k + struct.pack("<I", len(x)) + x + b"\0" * (len(x) % 2) for k, x in ((b"fmt ", fmt), (b"fact", struct.pack("<I", samples)), (b"data", payload)))
    return b"RIFF" + struct.pack("<I", 4 + len(chunks)) + b"WAVE" + chunks


def from_wav(wav: bytes) -> tuple[str, bytes]:
    """(codec, payload) of a WAVE file that to_wav() could have written."""
    if wav[:4] != b"RIFF" or wav[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, tag = 12, -1
    while at + 8 <= len(wav):
        (size,) = struct.unpack_from("<I", wav, at + 4)
        if wav[at : at + 4] == b"fmt ":
            (tag,) = struct.unpack_from("<H", wav, at + 8)
        elif wav[at : at + 4] == b"data":
            return {v: k for k, v in TAGS.items()}[tag], wav[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("a WAVE file without data")


def pcm_of(payload: bytes, codec: str) -> np.ndarray:
    raw = np.frombuffer(payload, np.uint8)
    if codec == "adpcm":
        return decode_adpcm(raw.reshape(-1, BLOCK)).ravel()
    return (MULAW if codec == "mulaw" else ALAW)[raw]


def _sums(pcm: np.ndarray) -> str:
    wide = pcm.astype(np.int64)
    turns = int(np.count_nonzero((pcm[1:] < 0) != (pcm[:-1] < 0)))
    return f"{len(pcm)}:{int(wide @ wide)}:{turns}:{int(np.abs(wide).max(initial=0))}"


def payload_of(text: str) -> tuple[int, bytes]:
    raw = text.encode("utf-8", "surrogatepass")
    return len(raw), raw.ljust(max(1, -(-len(raw) // BLOCK)) * BLOCK, b" ")


def store_texts(docs: DataFrame, codec: str = "mulaw", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each text's UTF-8 bytes, padded by blanks to a positive multiple of 192, as a WAVE file.

    Null texts are empty (one block of blanks). Repeated rows and null ids keep a row each.
    """

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [payload_of(x) for x in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([n for n, _ in found], pa.int64()), pa.array([to_wav(x, codec) for _, x in found], pa.binary())], ["doc_id", "n_bytes", "media"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), common.text_of(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, media binary")


def resampled_pcm(media: DataFrame, media_col: str = "media") -> DataFrame:
    """media's columns and pcm: 16-bit little-endian samples of 16 kHz, decoded from the WAVE files by their own codec."""

    @F.pandas_udf("binary")
    def convert(wavs):
        return wavs.map(lambda x: None if x is None else resample_double(pcm_of(*from_wav(x)[::-1])).tobytes())

    return media.withColumn("pcm", convert(F.col(media_col)))


def _groups(batches, most: int = 2 << 20):
    """Slices of about most bytes of media, at least a row each."""
    for batch in batches:
        ends = np.cumsum([len(x) for x in batch.column("media").to_pylist()])
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most)))
            yield batch.slice(at, to - at)
            at = to


def with_pcm(media: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media, pcm): of each WAVE file the samples of 16 kHz, decoded by its own codec, as pack_pcm() has
    them. No file is left out or shortened."""

    def run(batches):
        for part in _groups(batches):
            found = [pack_pcm(resample_double(pcm_of(*from_wav(x)[::-1]))) for x in part.column("media").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in ("doc_id", "n_bytes", "media")), pa.array(found, pa.binary())], ["doc_id", "n_bytes", "media", "pcm"])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, media binary, pcm binary")


def stored(media: DataFrame) -> DataFrame:
    """with_pcm(media), written and read back. PCM has four times the payload's bytes, so it is compressed at LEVEL."""
    return common.cut(with_pcm(media), "media", LEVEL)


def features(media: DataFrame) -> DataFrame:
    """Digests and features of stored media (doc_id, n_bytes, media, pcm), all from the bytes read back; media without pcm
    is stored with it first.

    feature has count:energy:sign changes:peak of the payload read as mu-law, as A-law and as ADPCM blocks, and the
    crc32 of the stored samples of 16 kHz; pcm_bytes and pcm_sha256 are theirs too. ADPCM blocks of many documents are
    decoded together.
    """

    def run(batches):
        digest = lambda x: hashlib.sha256(x).hexdigest()
        for part in _groups(batches):
            wavs = part.column("media").to_pylist()
            payloads = [from_wav(x)[1] for x in wavs]
            counts = np.cumsum([0, *(len(x) // BLOCK for x in payloads)])
            blocks = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, BLOCK)
            adpcm = np.concatenate([decode_adpcm(blocks[i : i + 4096]) for i in range(0, len(blocks), 4096)])
            said, sizes, digests = [], [], []
            for k, (x, packed) in enumerate(zip(payloads, part.column("pcm"), strict=True)):
                raw, pcm = np.frombuffer(x, np.uint8), unpack_pcm(packed.as_buffer()).tobytes()
                said.append(f"mu={_sums(MULAW[raw])};a={_sums(ALAW[raw])};adpcm={_sums(adpcm[counts[k] : counts[k + 1]].ravel())};pcm16k={zlib.crc32(pcm)}")
                sizes.append(len(pcm))
                digests.append(digest(pcm))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("n_bytes"), pa.array([len(x) for x in payloads], pa.int64()), pa.array(map(digest, payloads)), pa.array([zlib.crc32(x[-16:]) for x in payloads], pa.int64()), pa.array([len(x) for x in wavs], pa.int64()), pa.array(map(digest, wavs)), pa.array(said), pa.array(sizes, pa.int64()), pa.array(digests)],
                ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pcm_bytes", "pcm_sha256"],
            )

    rows = media if "pcm" in media.columns else stored(media)
    return rows.select("doc_id", "n_bytes", "media", "pcm").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pcm_bytes long, pcm_sha256 string")
