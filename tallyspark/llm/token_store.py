"""Token ids on disk: one Zstandard frame per document under a shared dictionary, in segments with an offset index."""

from __future__ import annotations

import hashlib
import os
import zlib
from functools import lru_cache
from itertools import islice
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .bpe import byte_map

#: The dictionary is trained on at most so many documents (those with the smallest hashed ids), each of at most so many bytes of ids.
SAMPLE, SAMPLE_BYTES, DICTIONARY_BYTES = 512, 16_384, 65_536
#: A segment ends when its frames reach this size.
SEGMENT_BYTES = 1 << 20
LEVEL = 3
#: A worker keeps the ids of so many distinct words, some 200 bytes each, and of as many that it used before; it
#: looks words up for so many characters of texts at a time. Such a part has some 210,000 distinct words, most of which
#: the parts before had too: fewer entries would be driven out before they are used again.
ENTRIES, TOGETHER = 250_000, 12_000_000

#: A document's line in a segment's index.
INDEX = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("offset", "<u8"), ("length", "<u4"), ("n_tokens", "<u4")])


#: A blank and letters below this code point are one pre-token in every Unicode version.
_LATIN = "\u0250"


def _splits_at_blanks(tokenizer) -> bool:
    """Whether a blank and Latin letters are one pre-token, whose byte characters go to the merges as they are, and no
    added token could span a cut of a text."""
    probe = " \u00e9tait Stra\u00dfe"
    if tokenizer.normalizer is not None or tokenizer.post_processor is not None or tokenizer.pre_tokenizer is None:
        return False
    added = tokenizer.get_added_tokens_decoder().values()
    if any(x.lstrip or x.rstrip or x.single_word or len(x.content.split()) != 1 or x.content != x.content.strip() or x.content[-1].isalpha() or x.content[-1] in ",." for x in added):
        return False
    words = ["".join(byte_map()[b] for b in x.encode()) for x in (" \u00e9tait", " Stra\u00dfe")]
    return [x for x, _ in tokenizer.pre_tokenizer.pre_tokenize_str(probe)] == words


class _Whole:
    """What PieceCache does, for a tokenizer that allows no cuts: the library's ids of each whole text."""

    def __init__(self, whole):
        self.of = whole

    def release(self) -> None:
        pass

    def of_many(self, texts, most: int = 0):
        return map(self.of, texts.to_pylist() if hasattr(texts, "to_pylist") else texts)


@lru_cache(maxsize=2)
def _tokenizer(json: str):
    import tokenizers

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    found = tokenizers.Tokenizer.from_str(json)
    whole = lambda piece: common.u32(found.encode(piece, add_special_tokens=False).ids)
    if not _splits_at_blanks(found):
        return _Whole(whole)
    chars = byte_map()
    # the same merges without the splitting, for words in byte characters: a token with the blank's starts a word
    merges = tokenizers.Tokenizer.from_str(json)
    merges.pre_tokenizer = tokenizers.pre_tokenizers.WhitespaceSplit()
    merge = found.model.tokenize

    def piece_of(piece: str) -> bytes:
        if piece.isalpha() and max(piece) < _LATIN:
            return common.u32([x.id for x in merge(piece.encode().decode("latin-1").translate(chars))])
        return whole(piece)

    vocabulary = found.get_vocab(with_added_tokens=True)
    starts = np.zeros(max(vocabulary.values()) + 1, bool)
    starts[[i for token, i in vocabulary.items() if token[0] == chars[32]]] = True

    blank = " " + chars[32]
    table = np.arange(256, dtype="<u2")
    table[128:] = [ord(chars[b]) for b in range(128, 256)]

    def words_of(words: list[str]) -> list[bytes]:
        latin = [w for w in words if w.isascii() or max(w) < _LATIN]
        if not latin:
            return [whole(" " + w) for w in words]
        # letters of ASCII are their own byte characters; the blanks are put in after the others are mapped
        line = " ".join(latin)
        if not line.isascii():
            line = table[np.frombuffer(line.encode(), np.uint8)].tobytes().decode("utf-16-le")
        ids = np.array(merges.encode_batch_fast([blank + line.replace(" ", blank)], add_special_tokens=False)[0].ids, "<u4")
        at = (4 * np.flatnonzero(starts[ids])).tolist()
        if len(at) != len(latin):
            return [whole(" " + w) for w in words]
        raw = ids.tobytes()
        found = [raw[s:e] for s, e in zip(at, [*at[1:], len(raw)], strict=True)]
        if len(latin) == len(words):
            return found
        known = dict(zip(latin, found, strict=True))
        return [known[w] if w in known else whole(" " + w) for w in words]

    def pieces_of(pieces: list[str]) -> list[bytes]:
        return [common.u32(x.ids) for x in found.encode_batch_fast(pieces, add_special_tokens=False)]

    return common.GroupedCache(piece_of, ENTRIES, words_of, pieces_of)


@lru_cache(maxsize=2)
def _dictionary(raw: bytes):
    import zstandard

    return zstandard.ZstdCompressionDict(raw) if raw else None


def dictionary_hash(raw: bytes) -> str:
    return hashlib.sha256(raw).hexdigest()


def train_dictionary(samples: list[bytes]) -> bytes:
    """A dictionary for serialised id arrays; empty where there is too little to train on."""
    import zstandard

    samples = [x for x in samples if x]
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, sum(map(len, samples)) // 8), samples).as_bytes() if len(samples) >= 16 else b""
    except zstandard.ZstdError:
        return b""


def write_token_store(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every text and write it at path, in ascending order of id.

    ``path/dictionary`` has the dictionary, its hash and the width of an id (2 bytes where the vocabulary allows, else
    4); ``path/segments`` has rows of (shard, seq, first_id, dict_hash, n_docs, n_tokens, index, blob). ``blob`` is
    frames of one document each; ``index`` has INDEX lines. end_id is appended to each document. Null texts are empty,
    null ids come first, repeated ids are ordered by the content of their ids; an empty table gives no segments.
    """
    spark = docs.sparkSession
    import tokenizers

    json = Path(tokenizer_path).read_text()
    width = 2 if max(tokenizers.Tokenizer.from_str(json).get_vocab_size(), end_id + 1) <= 1 << 16 else 4
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), common.text_of(text_col).alias("text"))
    told = spark.sparkContext.broadcast(json)
    end = common.u32([end_id])

    def ids_of(texts: pa.Array):
        return (np.frombuffer(x + end, "<u4").astype(f"<u{width}").tobytes() for x in _tokenizer(told.value).of_many(texts, TOGETHER))

    def sample(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([x[:SAMPLE_BYTES] for x in ids_of(batch.column("text"))], pa.binary())], ["ids"])

    wanted = [r[0] for r in rows.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE).collect()]
    raw = train_dictionary(sorted(bytes(r[0]) for r in rows.where(F.col("doc_id").isin(wanted)).mapInArrow(sample, "ids binary").orderBy("ids").limit(2 * SAMPLE).collect()))
    dictionary, named = spark.sparkContext.broadcast(raw), dictionary_hash(raw)
    spark.createDataFrame([(named, bytearray(raw), width)], "dict_hash string, dictionary binary, width int").coalesce(1).write.parquet(f"{path}/dictionary")

    def encode(batches):
        import zstandard

        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(dictionary.value))
        for group in common.text_groups(batches, TOGETHER):
            doc_ids, at = group.column("doc_id").combine_chunks(), 0
            found = ids_of(group.column("text"))
            while part := list(islice(found, 512)):
                yield pa.RecordBatch.from_arrays([doc_ids.slice(at, len(part)), pa.array([zlib.crc32(x) for x in part], pa.int64()), pa.array([len(x) // width for x in part], pa.int64()), pa.array(list(map(packer.compress, part)), pa.binary())], ["doc_id", "crc", "n_tokens", "frame"])
                at += len(part)

    def pack(batches):
        shard, seq, lines, frames, size = TaskContext.get().partitionId(), 0, [], [], 0

        def segment():
            index = np.array(lines, dtype=INDEX)
            values = [shard, seq, lines[0][0] if not lines[0][1] else None, named, len(lines), int(index["n_tokens"].sum()), index.tobytes(), b"".join(frames)]
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(values, fields, strict=True)], schema=pa.schema(fields))

        fields = [pa.field(n, t) for n, t in (("shard", pa.int32()), ("seq", pa.int32()), ("first_id", pa.int64()), ("dict_hash", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("index", pa.binary()), ("blob", pa.binary()))]
        for batch in batches:
            for doc_id, n_tokens, frame in zip(*(batch.column(k).to_pylist() for k in ("doc_id", "n_tokens", "frame")), strict=True):
                if size and size + len(frame) > SEGMENT_BYTES:
                    yield segment()
                    seq, lines, frames, size = seq + 1, [], [], 0
                lines.append((doc_id or 0, doc_id is None, size, len(frame), n_tokens))
                frames.append(frame)
                size += len(frame)
        if lines:
            yield segment()

    interim = f"{path}/_frames"
    rows.mapInArrow(common.task("token_store", encode, _tokenizer.cache_clear), "doc_id long, crc long, n_tokens long, frame binary").write.option("compression", "none").parquet(interim)
    key = ["doc_id", "crc", "n_tokens"]
    ordered = spark.read.parquet(interim).repartitionByRange(*key).sortWithinPartitions(*key)
    packed = ordered.mapInArrow(pack, "shard int, seq int, first_id long, dict_hash string, n_docs long, n_tokens long, index binary, blob binary")
    packed.write.option("compression", "none").parquet(f"{path}/segments")
    common.drop_path(spark, interim)


def _starts(segments: DataFrame) -> DataFrame:
    """Adds start, the tokens of all segments before: sums within a shard, then over the few shards (as many as tasks wrote)."""
    shards = segments.groupBy("shard").agg(F.sum("n_tokens").alias("own"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("shard").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return segments.withColumn("inner", F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).join(shards, "shard").withColumn("start", F.col("base") + F.col("inner"))


def read_token_store(spark: SparkSession, path: str, doc_ids: list[int] | None = None, ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document, or of those of doc_ids alone.

    start is the number of ids before the document's in the whole store. With doc_ids, segments whose first ids rule
    them out aren't decoded, and of the others only the frames asked for are. The dictionary's hash is verified.
    """
    one = spark.read.parquet(f"{path}/dictionary").first()
    if one is None or dictionary_hash(bytes(one["dictionary"])) != one["dict_hash"]:
        raise ValueError(f"the dictionary of {path} doesn't match its hash")
    told = spark.sparkContext.broadcast((bytes(one["dictionary"]), one["dict_hash"], one["width"], None if doc_ids is None else np.array(sorted(doc_ids), dtype=np.int64)))
    segments = spark.read.parquet(f"{path}/segments")
    starts = _starts(segments.select("shard", "seq", "n_tokens")).select("shard", "seq", "start")
    n = starts.count()
    segments = segments.join(common.maybe_broadcast(starts, n), ["shard", "seq"]).select("start", "dict_hash", "index", "blob")

    def decode(batches):
        import zstandard

        raw, named, width, wanted = told.value
        unpack = zstandard.ZstdDecompressor(dict_data=_dictionary(raw)).decompress
        for batch in batches:
            for start, own, index, blob in zip(*(batch.column(k).to_pylist() for k in ("start", "dict_hash", "index", "blob")), strict=True):
                if own != named:
                    raise ValueError("a segment was written with another dictionary")
                lines = np.frombuffer(index, INDEX)
                starts = start + np.cumsum(lines["n_tokens"].astype(np.int64)) - lines["n_tokens"]
                at = np.arange(len(lines)) if wanted is None else np.flatnonzero(np.isin(lines["doc_id"], wanted) & (lines["null"] == 0))
                for part in (at[i : i + 256] for i in range(0, len(at), 256)):
                    raws = [np.frombuffer(unpack(blob[o : o + n]), f"<u{width}").astype("<u4").tobytes() for o, n in zip(lines["offset"][part].tolist(), lines["length"][part].tolist(), strict=True)]
                    columns = [pa.array(lines["doc_id"][part], mask=lines["null"][part] > 0), pa.array(starts[part], pa.int64()), pa.array([len(x) // 4 for x in raws], pa.int64()), pa.array([zlib.crc32(x) for x in raws], pa.int64())]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(raws, pa.binary())] if ids else columns, ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * ids)

    return segments.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * ids)
