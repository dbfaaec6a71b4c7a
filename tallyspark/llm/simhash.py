"""SimHash near-duplicates: segment-popcount embedding, grid join under Manhattan distance, exact verification."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SHINGLE, SEED, DISTANCE = 3, 42, 3
#: 32 segments of 2 bits in BLOCKS blocks; texts within DISTANCE agree on all popcounts of BLOCKS - DISTANCE blocks.
BLOCKS = 6
#: Cells with more fingerprints are compared in pairs of parts of about that size, in tasks of their own.
CELL = 4096


def fingerprint(text: str) -> int:
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < SHINGLE:
        return digest(b" ".join(words), SEED)
    ones, n = np.zeros(64, np.int64), len(words) - SHINGLE + 1
    for at in range(0, n, 65_536):  # so many shingles at a time
        part = words[at : at + 65_536 + SHINGLE - 1]
        whole = b" ".join(part)
        lengths = np.fromiter(map(len, part), np.int64, len(part))
        ends = np.cumsum(lengths + 1) - 1
        starts = (ends - lengths)[: 1 - SHINGLE].tolist()
        found = np.array([digest(whole[s:e], SEED) for s, e in zip(starts, ends[SHINGLE - 1 :].tolist(), strict=True)], dtype=">u8")
        ones += np.unpackbits(found.view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, dtype=np.uint64).view(np.int64), pa.int64())


def _fingerprints(batches):
    for batch in batches:
        texts = batch.column("text").to_pylist()
        yield pa.RecordBatch.from_arrays([batch.column("id"), _signed([fingerprint(t) for t in texts])], ["id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): the 64 bits of each whole text as a signed long."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), common.text_of(text_col).alias("text"))
    return rows.mapInArrow(common.task("simhash", _fingerprints), "id long, fp long")


def segment_counts(fp: np.ndarray) -> np.ndarray:
    """The popcounts of the 32 two-bit segments, each in its segment's two bits."""
    return fp - ((fp >> np.uint64(1)) & np.uint64(0x5555555555555555))


_FOURS = np.array([[(x >> s) & 3 for s in (0, 2, 4, 6)] for x in range(256)], dtype=np.int8)
_BYTE_DISTANCE = np.abs(_FOURS[:, None, :] - _FOURS[None, :, :]).sum(2).astype(np.uint8).ravel()


def manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Manhattan distance of two embeddings, never more than the Hamming distance of their fingerprints."""
    at = a.view(np.uint8).astype(np.int64) * 256 + b.view(np.uint8)
    return _BYTE_DISTANCE[at].reshape(-1, 8).sum(1, dtype=np.int64)


def _block_masks() -> list[int]:
    edges = [round(i * 32 / BLOCKS) for i in range(BLOCKS + 1)]
    blocks = [sum(3 << (2 * s) for s in range(lo, hi)) for lo, hi in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in combinations(blocks, BLOCKS - DISTANCE)]


def _cells(batches):
    """One row for each cell of each projected grid (width 1) that a point lies in: the grid's number and coordinates, hashed."""
    for batch in batches:
        node, fp = batch.column("node"), batch.column("fp").to_numpy()
        counts = segment_counts(fp.view(np.uint64))
        for k, mask in enumerate(_block_masks()):
            cell = counts & np.uint64(mask)
            cell = (cell ^ (cell >> np.uint64(29)) ^ np.uint64((k + 1) * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
            cell ^= cell >> np.uint64(32)
            yield pa.RecordBatch.from_arrays([pa.array(cell.view(np.int64)), node, batch.column("fp")], ["cell", "node", "fp"])


def _compare(cell, part, node, fp):
    """Links among rows sorted by (cell, part): nodes of one cell whose fingerprints differ in at most DISTANCE bits."""
    counts, found, step, n = segment_counts(fp), [], 1, len(fp)
    first = np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]) | (part[1:] != part[:-1])]) if n else np.zeros(0, int)
    run = np.diff(np.r_[first, n])
    left = np.repeat(first + run, run) - np.arange(n)  # rows of the same cell from here on
    at = np.flatnonzero(left > 1)
    while len(at):
        other = at + step
        near = manhattan(counts[at], counts[other]) <= DISTANCE
        a, b = at[near], other[near]
        near = np.bitwise_count(fp[a] ^ fp[b]) <= DISTANCE
        found.append((node[a[near]], node[b[near]]))
        step += 1
        at = at[left[at] > step]
    a, b = (np.concatenate([x[i] for x in found]) if found else np.zeros(0, np.int64) for i in (0, 1))
    return common.stars(a, b)


def _links(batches):
    """Compares complete cells, about 200,000 rows at a time; what is held is that and one cell (CELL bounds it)."""
    held = []

    def done(table, n):
        cell, part, node, fp = (table.column(k).to_numpy()[:n] for k in ("cell", "part", "node", "fp"))
        u, v = _compare(cell, part, node, np.ascontiguousarray(fp).view(np.uint64))
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (u, v)], ["u", "v"])

    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < 200_000:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        cell, part = table.column("cell").to_numpy(), table.column("part").to_numpy()
        n = int(np.argmax((cell == cell[-1]) & (part == part[-1])))
        if n:
            yield done(table, n)
        held, rows = table.slice(n).to_batches(), table.num_rows - n
    if rows:
        yield done(pa.Table.from_batches(held).combine_chunks(), rows)


def split_hot(cells: DataFrame, limit: int) -> DataFrame:
    """Adds part: 0, or for a cell of over limit rows each of the pairs of parts that a row's part is in.

    Every two rows of such a cell meet in some part, whose size is about limit; no row is dropped.
    """
    hot = common.cut(cells.groupBy("cell").count().where(F.col("count") > limit), "hot")
    n = hot.count()
    if not n:
        return cells.withColumn("part", F.lit(0))
    parts = hot.select("cell", F.ceil(F.col("count") * 2 / limit).cast("int").alias("parts"))
    joined = cells.join(common.maybe_broadcast(parts, n), "cell", "left")
    own = F.pmod(F.xxhash64("node"), F.col("parts").cast("long")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda x: F.least(x, own) * F.col("parts") + F.greatest(x, own))
    return joined.withColumn("part", F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(pairs))).drop("parts")


def fingerprint_groups(fps: DataFrame) -> DataFrame:
    """(fp, group, component_id) for each distinct fingerprint of fps (id, fp): group is the smallest fingerprint reachable
    by links, component_id the smallest id that has a fingerprint of the group (null if only null ids have).

    Fingerprints are the nodes, so rows that share an id and no fingerprint aren't linked by it.
    """
    reps = common.cut(fps.groupBy("fp").agg(F.min("id").alias("least")), "reps")
    cells = common.cut(reps.select(F.col("fp").alias("node"), "fp").mapInArrow(_cells, "cell long, node long, fp long"), "cells")
    placed = split_hot(cells, CELL).repartition("cell", "part").sortWithinPartitions("cell", "part")
    links = placed.select("cell", "part", "node", "fp").mapInArrow(_links, "u long, v long")
    components = common.connected_components(links)
    groups = common.cut(reps.join(components, reps["fp"] == components["node"], "left").select("fp", F.coalesce("component", "fp").alias("group"), "least"), "groups")
    least = groups.groupBy("group").agg(F.min("least").alias("component_id"))
    return groups.select("fp", "group").join(least, "group")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id), a row per row of docs.

    A null or empty text, or one of white space, has fingerprint zero and links like any other. Rows that repeat keep a
    row each. Rows with a null id keep their fingerprint, which links like any other; their component is the smallest
    id of their group, null if it has none. An empty table gives no rows.
    """
    fps = common.cut(fingerprints(docs, id_col, text_col), "fingerprints")
    found = fps.join(fingerprint_groups(fps), "fp", "left")
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group with all its columns: the one with the smallest (id, fingerprint).

    Rows are told apart by id and fingerprint: of rows that share an id, each counts in its own group. Of rows that
    repeat both one stays, that with the smallest hash of its text. Rows with a null id can't be named as members; they
    all stay. Where ids don't repeat, the shorter of the lists of kept and of removed ids travels to the texts.
    """
    fps = common.cut(fingerprints(docs, id_col, text_col), "fingerprints")
    known = fps.where("id is not null").groupBy("id", "fp").agg(F.count(F.lit(1)).alias("n")).join(fingerprint_groups(fps), "fp")
    known = common.cut(known.select("group", "id", "fp", "n"), "near")
    first = known.groupBy("group").agg(F.min(F.struct("id", "fp")).alias("first")).select("first.*", F.lit(True).alias("first"))
    own = F.col(id_col).cast("long")
    by_id = known.join(first, ["id", "fp"], "left").groupBy("id").agg(F.sum("n").alias("rows"), F.bool_or(F.coalesce("first", F.lit(False))).alias("kept"))
    by_id = common.cut(by_id, "decided")
    told = by_id.agg(F.count_if(F.expr("rows > 1 and kept")), F.count_if("kept"), F.count_if(~F.col("kept"))).first()
    repeated, kept, removed = (int(x or 0) for x in told)
    keep = by_id.where("kept and rows = 1").select(F.col("id").alias("id__"))
    lost = by_id.where("not kept or rows > 1").select(F.col("id").alias("id__"))
    if removed + repeated < kept:
        stay = docs.join(common.maybe_broadcast(lost, removed + repeated), own == F.col("id__"), "left_anti")
    else:
        stay = docs.join(common.maybe_broadcast(keep, kept), own == F.col("id__"), "left_semi")
        if fps.where("id is null").limit(1).count():
            stay = stay.unionByName(docs.where(own.isNull()))
    if not repeated:
        return stay
    again = by_id.where("kept and rows > 1").select(F.col("id").alias("id__"))
    again = docs.join(common.maybe_broadcast(again, repeated), own == F.col("id__"), "left_semi")
    # the fingerprint is computed once more, for rows of repeated ids alone
    fingerprint_of = F.pandas_udf(lambda texts: pd.Series(np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64)), "long")
    again = again.withColumn("fp__", fingerprint_of(common.text_of(text_col)))
    again = again.join(first.select(F.col("id").alias("id__"), F.col("fp").alias("first__")), (own == F.col("id__")) & (F.col("fp__") == F.col("first__")), "left_semi")
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    one = again.groupBy(own.alias("id__"), "fp__").agg(F.min_by(whole, F.struct(F.xxhash64(common.text_of(text_col)), F.xxhash64(F.to_json(whole)))).alias("row__"))
    return stay.unionByName(one.select("row__.*"))
