"""Helpers that the operators of this folder share: shared storage, safe cuts of texts, connected components."""

from __future__ import annotations

import ctypes
import re
import sys
import tempfile
import uuid
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own_folders: dict[str, str] = {}

#: Tables of at most so many rows of a few dozen bytes are broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 50_000


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Python workers get texts in batches of at most so many rows: the default of 10,000 takes a gigabyte of long texts.
    A session with a smaller setting keeps it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, or one of this application's own where that is unset (a single machine)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own_folders:
        _own_folders[app] = tempfile.mkdtemp(prefix="tallyspark-")
    return _own_folders[app]


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str = "cut", level: int = 3) -> DataFrame:
    """Write df once in the shared folder, compressed at this level of Zstandard, and read it back: its lineage ends there
    and a lost executor costs nothing."""
    spark = df.sparkSession
    small_batches(spark)
    path = shared_path(spark, name)
    df.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", str(level)).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder that this run wrote."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def maybe_broadcast(small: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast only what has been counted and is within the limit."""
    return F.broadcast(small) if rows <= limit else small


# Cutting a text where no pre-token can span --------------------------------------------------------------------------

#: White space of any reading: what Python, Rust and Oniguruma take as \s, and the four separators on which they differ.
_WS = "\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_IRREGULAR = re.compile(f"[{_WS}][ \n]")
#: The same without the four separators: a cut must be made only before what every reading takes as white space.
_SURE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SPACED = re.compile(f"[{_SURE}]")
_PIECES = re.compile(f"[{_SURE}]*[^{_SURE}]+|[{_SURE}]+")


def u32(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit integers."""
    found = array("I", ids)
    if sys.byteorder == "big":
        found.byteswap()
    return found.tobytes()


_claimed: list = [None, None]


def claim(owner: str, release=None) -> None:
    """A worker keeps the caches of one operator at a time: the one before is told to let go of its own."""
    if _claimed[0] != owner:
        if _claimed[1] is not None:
            _claimed[1]()
        _claimed[:] = [owner, release]
        settle()


def settle() -> None:
    """Give freed memory back to the system: Arrow's pool, then the C library's."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def task(owner: str, run, release=None):
    """run, a function from batches to batches, as a task of owner: caches of other operators go before it starts, and
    what it freed goes back to the system when it ends."""

    def claimed(batches):
        claim(owner, release)
        try:
            yield from run(batches)
        finally:
            settle()

    return claimed


def text_groups(batches, most: int):
    """Tables of whole batches (with a column text) that hold most bytes together, or end the input."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.column("text").nbytes
        if n >= most:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


class PieceCache(dict):
    """Value of each piece of text, computed once per worker for each distinct piece.

    Pre-tokens hold white space at their start only, so a text may be cut before any white space that follows
    something else, and between a letter and a comma or stop; the value of a text (ids, bytes) is the concatenation of
    its pieces' values. ``compute`` gets one piece, ``compute_words`` words of letters, each of which has a blank before
    it. Keys are pieces without their leading blank in ``self`` and whole
    pieces in ``plain``. Each of the two is in two generations, of at most ``limit`` entries each in ``self`` and half
    of that in ``plain``; what is used again outlives the older one. Pieces of over ``LONGEST`` characters are computed
    each time, which bounds the memory: some 200 bytes an entry.
    """

    LONGEST = 48

    def __init__(self, compute, limit: int, compute_words=None):
        super().__init__()
        self.compute, self.limit = compute, limit
        self.compute_words = compute_words or (lambda words: [compute(" " + w) for w in words])
        self.older: dict[str, bytes] = {}
        self.plain: dict[str, bytes] = {}
        self.plain_older: dict[str, bytes] = {}

    def release(self) -> None:
        for held in (self, self.older, self.plain, self.plain_older):
            held.clear()

    def whole(self, piece: str) -> bytes:
        found = self.plain.get(piece)
        if found is None:
            found = self.plain_older.pop(piece, None)
            if found is None:
                if len(piece) > 1 and piece[-1] in ",." and piece[-2].isalpha():
                    return self.whole(piece[:-1]) + self.whole(piece[-1])
                found = self.compute(piece)
            if len(piece) > self.LONGEST:
                return found
            if len(self.plain) >= self.limit // 2:
                self.plain, self.plain_older = {}, self.plain
            self.plain[piece] = found
        return found

    def __missing__(self, part: str) -> bytes:
        value = self.older.pop(part, None)
        if value is None:
            if part.isalpha():
                value = self.compute(" " + part)
            elif part[:1] == "\n":  # a line end without a blank before it
                word = part[1:-1] if part[-1] in ",." else part[1:]
                pieces = ["\n", word, part[len(word) + 1 :]] if word.isalpha() else _PIECES.findall(part)
                value = b"".join([self.whole(x) for x in pieces if x])
            elif len(part) > 1 and part[-1] in ",." and part[-2].isalpha():
                return self[part[:-1]] + self.whole(part[-1])
            else:
                pieces = _PIECES.findall(" " + part)
                if len(pieces) > 1:
                    head = pieces[0]
                    return (self[head[1:]] if head[0] == " " and head[1:] != part else self.whole(head)) + b"".join(map(self.whole, pieces[1:]))
                value = self.compute(" " + part)
        self._keep(part, value)
        return value

    def _keep(self, part: str, value: bytes) -> None:
        if len(part) <= self.LONGEST:
            if len(self) >= self.limit:
                self.older = dict(self)
                self.clear()
            self[part] = value

    def _letters(self, words: list[str]) -> list[bytes]:
        """The values of distinct words of letters; those that aren't kept are computed together."""
        values = list(map(self.get, words))
        older, todo = self.older, []
        for k in [k for k, v in enumerate(values) if v is None]:
            word = words[k]
            found = older.get(word)
            if found is None:
                todo.append(k)
            else:
                values[k] = found
                self._keep(word, found)
        for at in range(0, len(todo), 512):
            part = todo[at : at + 512]
            names = [words[k] for k in part]
            for k, word, value in zip(part, names, self.compute_words(names), strict=True):
                values[k] = value
                self._keep(word, value)
        return values

    def _others(self, words: list[str]) -> list[bytes]:
        return [self[w] for w in words]

    def of(self, text: str) -> bytes:
        if _IRREGULAR.search(text):
            return b"".join(map(self.whole, _PIECES.findall(text)))
        first, *rest = text.replace("\n", " \n").split(" ")
        start = b"".join(map(self.whole, _PIECES.findall(first)))
        return start + b"".join(map(self.__getitem__, rest)) if rest else start

    def of_many(self, texts, most: int = 1 << 22):
        """of() of each text (a list or an Arrow array without nulls), in order. Words are told apart by Arrow, some most
        bytes of texts at a time, so that each distinct word of such a part is looked up once."""
        if isinstance(texts, list):
            texts = pa.array(texts, pa.string())
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most, "right")))
            yield from self._part(texts.slice(at, to - at))
            at = to

    def _part(self, texts: pa.Array) -> list[bytes]:
        odd = pc.match_substring_regex(texts, _IRREGULAR.pattern)
        split = pc.split_pattern(pc.replace_substring(pc.if_else(odd, "", texts), "\n", " \n"), " ")
        ends = split.offsets.to_numpy()
        words = split.flatten().dictionary_encode()
        place, known = words.indices.to_numpy(), words.dictionary
        # words of letters, words of letters and a mark, and others; the first two share their letters' values
        stem, mark = pc.utf8_slice_codeunits(known, 0, stop=-1), pc.utf8_slice_codeunits(known, -1)
        letters = pc.utf8_is_alpha(known).to_numpy(zero_copy_only=False)
        marked = pc.and_(pc.is_in(mark, value_set=pa.array([",", "."])), pc.utf8_is_alpha(stem)).to_numpy(zero_copy_only=False)
        a, b, c = np.flatnonzero(letters), np.flatnonzero(marked), np.flatnonzero(~letters & ~marked)
        stems = pa.concat_arrays([known.take(pa.array(a)), stem.take(pa.array(b))]).dictionary_encode()
        values = pa.array(self._letters(stems.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary()).take(stems.indices)
        marks = pa.array([self.whole(","), self.whole(".")], pa.large_binary()).take(pc.index_in(mark.take(pa.array(b)), value_set=pa.array([",", "."])))
        both = pc.binary_join_element_wise(values.slice(len(a)), marks, pa.scalar(b"", pa.large_binary()))
        rest = pa.array(self._others(known.take(pa.array(c)).to_pylist()), pa.large_binary())
        # a text's first word has no blank before it: its value is the text's own
        starts = [b"".join(map(self.whole, _PIECES.findall(x))) for x in known.take(pa.array(place[ends[:-1]])).to_pylist()]
        for k in np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist():
            starts[k] = self.of(texts[k].as_py())
        to = np.empty(len(known), np.int64)
        to[np.concatenate([a, b, c])] = np.arange(len(known))
        at = to[place]
        at[ends[:-1]] = np.arange(len(known), len(known) + len(texts))
        found = pa.concat_arrays([values.slice(0, len(a)), both, rest, pa.array(starts, pa.large_binary())]).take(pa.array(at))
        offsets = np.frombuffer(found.buffers()[1], np.int64)[found.offset : found.offset + len(found) + 1]
        raw = memoryview(found.buffers()[2] or b"")
        cuts = offsets[ends].tolist()
        return [bytes(raw[s:e]) for s, e in zip(cuts, cuts[1:], strict=False)]


class GroupedCache(PieceCache):
    """A PieceCache that keeps values in groups, and computes words of other kinds than letters together as well:
    ``compute_pieces`` gets a list of pieces."""

    def __init__(self, compute, limit: int, compute_words, compute_pieces):
        super().__init__(compute, limit, compute_words)
        self.compute_pieces = compute_pieces

    def _keep_all(self, words: list[str], values: list[bytes]) -> None:
        """_keep() of some distinct words, as many as the limit at most."""
        if words and max(map(len, words)) > self.LONGEST:
            short = [k for k, w in enumerate(words) if len(w) <= self.LONGEST]
            words, values = [words[k] for k in short], [values[k] for k in short]
        if len(self) + len(words) > self.limit:
            self.older = dict(self)
            self.clear()
        self.update(zip(words, values, strict=True))

    def _known(self, words: list[str], compute, wanted=None) -> list[bytes | None]:
        """The values of distinct words; those that aren't kept are computed together, if they are wanted, else None."""
        values, older, step = list(map(self.get, words)), self.older, min(512, self.limit)
        missing = [k for k, v in enumerate(values) if v is None]
        again = [k for k in missing if words[k] in older]
        for at in range(0, len(again), step):
            names = [words[k] for k in again[at : at + step]]
            found = [older[w] for w in names]
            self._keep_all(names, found)
            for k, value in zip(again[at : at + step], found, strict=True):
                values[k] = value
        todo = [k for k in missing if values[k] is None and (wanted is None or wanted(words[k]))]
        for at in range(0, len(todo), step):
            names = [words[k] for k in todo[at : at + step]]
            found = compute(names)
            self._keep_all(names, found)
            for k, value in zip(todo[at : at + step], found, strict=True):
                values[k] = value
        return values

    def _letters(self, words: list[str]) -> list[bytes]:
        return self._known(words, self.compute_words)

    def _others(self, words: list[str]) -> list[bytes]:
        """The values of words of other kinds. Those that are one piece with their blank are computed together."""
        one = lambda w: not _SPACED.search(w) and not (len(w) > 1 and w[-1] in ",." and w[-2].isalpha())
        values = self._known(words, lambda names: self.compute_pieces([" " + w for w in names]), one)
        return [self[w] if v is None else v for w, v in zip(words, values, strict=True)]


# Connected components ------------------------------------------------------------------------------------------------


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node of its local component), as many as the nodes less the components."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = np.arange(len(nodes))
    x, y = at[: len(a)], at[len(a) :]
    while True:
        low = np.minimum(parent[x], parent[y])
        new = parent.copy()
        np.minimum.at(new, parent[x], low)
        np.minimum.at(new, parent[y], low)
        while not np.array_equal(shorter := new[new], new):
            new = shorter
        if np.array_equal(new, parent):
            break
        parent = new
    child = np.flatnonzero(parent != np.arange(len(nodes)))
    return nodes[child], nodes[parent[child]]


def _local_stars(batches):
    for batch in _gathered(batches, 1_000_000):
        u, v = (batch.column(k).to_numpy() for k in ("u", "v"))
        if len(u):
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in stars(u, v)], ["u", "v"])


def _gathered(batches, rows: int):
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges (u, v); component is the smallest node reachable.

    Alternates large-star and small-star (Kiveris et al., "Connected components in MapReduce and beyond", 2014) until
    nothing changes; each task first shrinks its own edges to stars. Each round is a written table. Self links and
    repeated links are ignored; links with a null end too.
    """
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v")
    e = cut(e.mapInArrow(_local_stars, "u long, v long").distinct(), "components")
    seen = None
    for _ in range(rounds):
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen or not now[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
        seen = now
        both = e.union(e.select("v", "u").toDF("u", "v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least)
        e = cut(small.where("u > v").distinct(), "components")
    raise RuntimeError(f"components did not settle in {rounds} rounds")
