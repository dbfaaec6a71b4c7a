"""Byte-level BPE by way of a SentencePiece model that is serialised directly from a rank vocabulary."""

from __future__ import annotations

import base64
import hashlib
import struct
from functools import lru_cache
from itertools import islice
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: A worker keeps the ids of so many distinct words, some 200 bytes each, and of as many that it used before; it looks
#: words up for so many characters of texts at a time.
ENTRIES, TOGETHER = 60_000, 6_000_000


def byte_map() -> dict[int, str]:
    """A printable character for each byte: itself where it is printable Latin-1, else the next from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank from lines of base64 and rank."""
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in Path(path).read_bytes().splitlines() if x)}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | int | float) -> bytes:
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def sentencepiece_model(ranks: dict[bytes, int]) -> bytes:
    """The serialised ModelProto: a piece for each token at the place of its rank, scored by negative rank.

    Bytes are written as characters by byte_map(), the normaliser changes nothing, and one unknown piece follows last.
    """
    chars = byte_map()
    by_rank = {r: b for b, r in ranks.items()}
    n = max(by_rank, default=-1) + 1
    pieces = b"".join(
        _field(1, _field(1, "".join(chars[b] for b in by_rank[r]).encode()) + _field(2, float(-r)) + _field(3, 1))
        if r in by_rank
        else _field(1, _field(1, f"<unused{r}>".encode()) + _field(2, float(-r)) + _field(3, 5))
        for r in range(n)
    )
    unknown = _field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))
    trainer = _field(3, 2) + _field(4, n + 1) + _field(40, n)  # BPE, size, id of the unknown piece
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)  # no prefix, nothing removed or escaped
    return pieces + unknown + _field(2, trainer) + _field(3, normalizer)


class Codec:
    """Ids of texts as a rank-merging tokenizer gives them, and bytes of ids.

    A pre-token that is a token as a whole is that token; else SentencePiece merges its bytes by rank.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex
        import sentencepiece

        self.ranks, self.split = ranks, regex.compile(pattern).findall
        self.model = sentencepiece.SentencePieceProcessor()
        self.model.LoadFromSerializedProto(sentencepiece_model(ranks))
        chars = byte_map()
        self.chars = {b: chars[b] for b in range(256)}
        self.table = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.table[rank] = token
        self.names = list(map(str, range(len(self.table))))
        self.cache = common.PieceCache(self._piece, ENTRIES, self._words)

    def _piece(self, piece: str) -> bytes:
        ids: list[int] = []
        for token in self.split(piece):
            raw = token.encode("utf-8")
            if raw in self.ranks:
                ids.append(self.ranks[raw])
            else:
                ids += self.model.EncodeAsIds(raw.decode("latin-1").translate(self.chars))
        return common.u32(ids)

    def _words(self, words: list[str]) -> list[bytes]:
        raws = [(" " + w).encode("utf-8") for w in words]
        rest = [raw.decode("latin-1").translate(self.chars) for raw in raws if raw not in self.ranks]
        found = iter(self.model.EncodeAsIds(rest, num_threads=1) if rest else ())
        return [common.u32([self.ranks[raw]] if raw in self.ranks else next(found)) for raw in raws]

    def digests(self, raw: bytes) -> tuple[str, str]:
        """SHA-256 of the decimal ids joined by commas and of the decoded bytes, some ids at a time."""
        ids, said, decoded = np.frombuffer(raw, "<u4"), hashlib.sha256(), hashlib.sha256()
        for at in range(0, len(ids), 65_536):
            part = ids[at : at + 65_536].tolist()
            said.update(("," if at else "").encode() + ",".join(map(self.names.__getitem__, part)).encode())
            decoded.update(b"".join(map(self.table.__getitem__, part)))
        return said.hexdigest(), decoded.hexdigest()

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.cache.of(text), dtype="<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.table.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def _codec(packed: bytes, pattern: str) -> Codec:
    return Codec({base64.b64decode(a): int(b) for a, b in (x.split() for x in packed.splitlines() if x)}, pattern)


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row of docs, whole texts; with ids also the ids as a binary
    of little-endian unsigned 32-bit integers.

    Null and empty texts have no tokens and the hashes of nothing. Repeated rows and null ids keep a row each. The
    vocabulary file is read by the driver and broadcast (its size, about 1 MB, doesn't depend on the data).
    """
    packed = docs.sparkSession.sparkContext.broadcast(Path(ranks_path).read_bytes())

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * ids

    def run(batches):
        codec = _codec(packed.value, pattern)
        for group in common.text_groups(batches, TOGETHER):
            doc_ids, at = group.column("doc_id").combine_chunks(), 0
            found = codec.cache.of_many(group.column("text"), TOGETHER)
            while raw := list(islice(found, 256)):
                hashes, decoded = zip(*map(codec.digests, raw), strict=True)
                columns = [doc_ids.slice(at, len(raw)), pa.array([len(x) // 4 for x in raw], pa.int64()), pa.array(hashes), pa.array(decoded)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(raw, pa.binary())] if ids else columns, names)
                at += len(raw)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), common.text_of(text_col).alias("text"))
    return rows.mapInArrow(common.task("bpe", run, _codec.cache_clear), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * ids)
