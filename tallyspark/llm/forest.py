"""Near-duplicate embeddings by a forest of random-projection trees with spill overlap."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, simhash

SIMILARITY = 0.9
#: Trees, rows that a leaf should have, and the share of a node's rows on either side of a split that go to both sides.
TREES, LEAF, SPILL = 8, 192, 0.06
#: The splits are fitted on at most so many vectors (those with the smallest hashed ids), to at most so many levels.
SAMPLE, DEPTH = 20_000, 12
#: Leaves with more rows are compared in pairs of parts of about that size, in tasks of their own.
LEAF_ROWS = 2048
#: A vector is in a dense group if it links with more of the sample than a leaf holds, and with so many at least.
DENSE = 8
SEED = 20240917
#: The precision of keys by their first byte.
WIDTHS = {"f": "<f4", "d": "<f8"}
#: Leaves of so many times the rows that a leaf should have are split on where they are, in rounds over the cluster.
OVERFULL = 4


def _keys(kind: str):
    def run(batches):
        """Canonical bytes of each vector's finite non-zero components, of the table's own precision (kind), named by their
        first byte; null for vectors that link with nothing."""
        for batch in batches:
            keys = []
            for vector in batch.column("vector").to_pylist():
                key = None
                if vector and None not in vector:
                    x = np.array(vector, dtype=np.float64)
                    if np.isfinite(x).all() and x.any():
                        key = kind.encode() + (x + 0.0).astype(WIDTHS[kind]).tobytes()
                keys.append(key)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(keys, pa.binary())], ["id", "key"])

    return run


@dataclass
class Forest:
    """directions[t] has a column per level of tree t; cuts[t][level] has (low, middle, high) of each node of the level."""

    directions: np.ndarray
    cuts: list[list[np.ndarray]]

    def leaves(self, unit: np.ndarray):
        """(row, tree, leaf) of every leaf that each row reaches; within low and high of a split it goes both ways."""
        for t, levels in enumerate(self.cuts):
            shadow = unit @ self.directions[t]
            row, node = np.arange(len(unit)), np.zeros(len(unit), np.int64)
            for level, bounds in enumerate(levels):
                x = shadow[row, level]
                low, high = bounds[node, 0], bounds[node, 2]
                left, right = x <= high, x > low
                left |= ~right
                row = np.concatenate([row[left], row[right]])
                node = np.concatenate([2 * node[left], 2 * node[right] + 1])
            yield row, t, node


def _depth(sample: int, rows: int, leaf: int) -> int:
    return int(max(0, min(DEPTH, np.ceil(np.log2(max(1, rows) / leaf)), np.log2(max(1, sample)) - 3)))


def fit_forest(unit: np.ndarray, rows: int, trees: int = TREES, leaf: int = LEAF, spill: float = SPILL, seed: int = SEED) -> Forest:
    """Random splits at the median of a sample, recursively, to leaves of about leaf of all rows."""
    rng = np.random.default_rng(seed)
    depth = _depth(len(unit), rows, leaf)
    directions, cuts = rng.standard_normal((trees, unit.shape[1], max(1, depth))), []
    for t in range(trees):
        shadow, node, levels = unit @ directions[t], np.zeros(len(unit), np.int64), []
        for level in range(depth):
            x, bounds = shadow[:, level], np.zeros((2**level, 3))
            for k in range(2**level):
                own = x[node == k]
                if len(own):
                    bounds[k] = np.quantile(own, [0.5 - spill, 0.5, 0.5 + spill])
            levels.append(bounds)
            node = 2 * node + (x > bounds[node, 1])
        cuts.append(levels)
    return Forest(directions, cuts)


def _matrix(keys) -> np.ndarray:
    """The vectors in double precision, each times the power of two that brings its largest component near 1: cosines are
    the same, and no norm overflows or vanishes."""
    raw = np.frombuffer(b"".join(keys), np.uint8).reshape(len(keys), -1)
    kind = WIDTHS[chr(raw[0, 0])] if len(raw) else "<f8"
    whole = np.ascontiguousarray(raw[:, 1:]).view(kind).astype(np.float64)
    return np.ldexp(whole, -np.frexp(np.abs(whole).max(axis=1, keepdims=True))[1]) if whole.size else whole


def _pairs(node: np.ndarray, keys: list, similarity: float):
    """Rows of one leaf, all against all in blocks, by cosine in double precision."""
    whole = _matrix(keys)
    unit = whole / np.linalg.norm(whole, axis=1, keepdims=True)
    for at in range(0, len(unit), 512):
        i, j = np.nonzero(unit[at : at + 512] @ unit[at:].T >= similarity - 1e-9)
        i, j = i[i < j] + at, j[i < j] + at
        a, b = whole[i], whole[j]
        cosine = np.einsum("ij,ij->i", a, b) / (np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1))
        good = cosine >= similarity
        yield np.minimum(node[i], node[j])[good], np.maximum(node[i], node[j])[good]


def _leaf_links(similarity: float):
    def run(batches):
        held, rows = [], 0

        def done(table):
            cell, part, node, key = (table.column(k) for k in ("cell", "part", "node", "key"))
            cell, part, node, keys = cell.to_numpy(), part.to_numpy(), node.to_numpy(), key.to_pylist()
            first = np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]) | (part[1:] != part[:-1])])
            found = [x for s, e in zip(first, np.r_[first[1:], len(cell)], strict=True) if e - s > 1 for x in _pairs(node[s:e], keys[s:e], similarity)]
            if found:
                # each batch's pairs once; the same pair from another leaf goes in distinct()
                pairs = np.unique(np.stack([np.concatenate(x) for x in zip(*found, strict=True)]), axis=1)
                for at in range(0, pairs.shape[1], 50_000):
                    yield pa.RecordBatch.from_arrays([pa.array(pairs[k, at : at + 50_000]) for k in (0, 1)], ["u", "v"])

        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows < 8192:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            cell, part = table.column("cell").to_numpy(), table.column("part").to_numpy()
            n = int(np.argmax((cell == cell[-1]) & (part == part[-1])))
            if n:
                yield from done(table.slice(0, n))
            held, rows = table.slice(n).to_batches(), table.num_rows - n
        if rows:
            yield from done(pa.Table.from_batches(held).combine_chunks())

    return run


def dense_centres(unit: np.ndarray, rows: int, similarity: float, leaf: int = LEAF) -> np.ndarray:
    """Vectors of a sample, each linked with more of the sample than a leaf holds, and not with an earlier one.

    A split would fall inside such a group and part linked vectors. What is linked with no centre has fewer links than
    that among its like. There are at most about as many centres as leaves.
    """
    x = unit.astype(np.float32)
    least = max(DENSE, len(x) / 2 ** _depth(len(x), rows, leaf))

    def links(these: np.ndarray, with_: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.int64), *(np.count_nonzero(these[at : at + 512] @ with_.T >= similarity, axis=1) for at in range(0, len(these), 512))])

    centres, left = [], np.arange(len(x))
    counts = links(x, x)
    while len(left) and counts.max() > least:
        k = int(counts.argmax())
        centres.append(left[k])
        ball = x[left] @ x[left[k]] >= similarity
        ball[k] = True
        counts = counts[~ball] - links(x[left[~ball]], x[left[ball]])
        left = left[~ball]
    return unit[centres]


def _homes(told, similarity: float):
    """The nearest centre that each vector links with (home, -1 if none), and the others' cells where it is a guest.

    Whatever links with a vector at home is within twice the link angle of that centre, so it is at home there or a
    guest. Of two vectors at home in different cells only the one of the later cell is a guest of the other: each pair
    meets in one cell.
    """
    reach = 2 * similarity * similarity - 1 - 1e-9 if similarity > 0 else -2.0

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                whole = _matrix(part.column("key").to_pylist())
                near = whole / np.linalg.norm(whole, axis=1, keepdims=True) @ told.value.T
                home = np.where(near.max(1) >= similarity, near.argmax(1), -1)
                guest = (near >= reach) & ((home < 0)[:, None] | (np.arange(near.shape[1]) < home[:, None]))
                ends = np.r_[0, np.cumsum(guest.sum(1))].astype(np.int32)
                cells = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.nonzero(guest)[1].astype(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(k) for k in ("node", "key", "copies")] + [pa.array(home.astype(np.int64)), cells], ["node", "key", "copies", "home", "guest"])

    return run


def _dense_pairs(part: np.ndarray, home: np.ndarray, node: np.ndarray, keys: list, copies: np.ndarray, similarity: float):
    """Of two parts of a cell (or one): each vector's linked copies on the other side, and links that join the same nodes."""
    whole = _matrix(keys)
    norm = np.linalg.norm(whole, axis=1)
    unit, linked = whole / norm[:, None], np.zeros((len(whole), len(whole)), bool)
    apart = part[0] != part[-1]
    for at in range(0, len(unit), 512):
        here = slice(at, at + 512)
        cosine = unit[here] @ unit.T
        good = (cosine >= similarity) & (home[here, None] | home)
        i, j = np.nonzero(np.abs(cosine - similarity) <= 1e-9)
        a, b = whole[i + at], whole[j]
        good[i, j] = (np.einsum("ij,ij->i", a, b) / (norm[i + at] * norm[j]) >= similarity) & (home[i + at] | home[j])
        linked[here] = good & (part[here, None] != part) if apart else good
    np.fill_diagonal(linked, False)
    more = linked.sum(1) if (copies == 1).all() else np.concatenate([linked[at : at + 512] @ copies for at in range(0, len(unit), 512)])
    root, todo = np.arange(len(node)), more > 0
    for k in np.argsort(node):
        if not todo[k]:
            continue
        todo[k], edge = False, np.array([k])
        while len(edge):
            edge = np.flatnonzero(linked[edge].any(0) & todo)
            todo[edge], root[edge] = False, k
    child = np.flatnonzero(root != np.arange(len(node)))
    own = np.flatnonzero(more)
    return np.r_[node[own], node[root[child]]], np.r_[np.full(len(own), -1), node[child]], np.r_[more[own], np.zeros(len(child), np.int64)], np.arange(len(own) + len(child)) < len(own)


def _dense_links(similarity: float):
    def run(batches):
        held: list[pa.Table] = []

        def done():
            table = pa.concat_tables(held).combine_chunks()
            part, home, node, key, copies = (table.column(k) for k in ("part", "own", "node", "key", "copies"))
            u, v, more, alone = _dense_pairs(part.to_numpy(), home.to_numpy(), node.to_numpy(), key.to_pylist(), copies.to_numpy(), similarity)
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v, mask=alone), pa.array(more)], ["u", "v", "more"])

        now = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            names = np.stack([table.column(k).to_numpy() for k in ("cell", "a", "b")], axis=1)
            first = np.flatnonzero(np.r_[True, (names[1:] != names[:-1]).any(1)]) if len(names) else []
            for s, e in zip(first, [*first[1:], len(names)], strict=True):
                if now is not None and tuple(names[s]) != now:
                    yield done()
                    held.clear()
                now = tuple(names[s])
                held.append(table.slice(s, e - s))
        if held:
            yield done()

    return run


def links_of_dense(classes: DataFrame, centres: np.ndarray, similarity: float) -> tuple[DataFrame, DataFrame]:
    """(u, v, more) of the links of classes (node, key, copies) near centres, and the classes that are near none.

    Every link with one end near a centre counts, and no other: more is u's linked copies, where v is null; other rows
    are links enough to join the same nodes. Pairs are counted where they are compared, so that a group of any size
    makes rows by its size and not by its square. Cells are compared in pairs of parts, nothing is left out.
    """
    told = classes.sparkSession.sparkContext.broadcast(centres)
    placed = common.cut(classes.select("node", "key", "copies").mapInArrow(_homes(told, similarity), "node long, key binary, copies long, home long, guest array<long>"), "homes")
    own = placed.where("home >= 0").select(F.col("home").alias("cell"), F.lit(True).alias("own"), "node", "key", "copies")
    cells = own.unionByName(placed.select(F.explode("guest").alias("cell"), F.lit(False).alias("own"), "node", "key", "copies"))
    sizes = cells.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) * 2 / LEAF_ROWS).cast("int").alias("parts"))
    cells = cells.join(F.broadcast(common.cut(sizes, "sizes")), "cell").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts").cast("long")).cast("int"))
    cells = cells.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("a", F.least("part", "other")).withColumn("b", F.greatest("part", "other"))
    cells = cells.select("cell", "a", "b", "part", "own", "node", "key", "copies").repartition("cell", "a", "b").sortWithinPartitions("cell", "a", "b", "part")
    found = common.cut(cells.mapInArrow(_dense_links(similarity), "u long, v long, more long"), "dense")
    return found, placed.where("home < 0").select("node", "key", "copies")


def vector_classes(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, DataFrame]:
    """Keys of all rows (id, key), and a row per distinct vector (node = smallest id, copies, key)."""
    kind = "f" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "d"
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    keys = common.cut(rows.mapInArrow(common.task("forest", _keys(kind)), "id long, key binary"), "vectors")
    classes = keys.where("key is not null and id is not null").groupBy("key").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("copies"))
    return keys, common.cut(classes, "classes")


def _sample(classes: DataFrame) -> np.ndarray:
    sample = _matrix([bytes(r[0]) for r in classes.orderBy(F.xxhash64("node"), "node").limit(SAMPLE).select("key").collect()])
    return sample / np.linalg.norm(sample, axis=1, keepdims=True)


def links_of_classes(classes: DataFrame, similarity: float = SIMILARITY, trees: int = TREES, leaf: int = LEAF, spill: float = SPILL) -> tuple[DataFrame, DataFrame]:
    """Links of classes (node, key, copies) that have at least that cosine: pairs (u, v), u < v, that share a leaf of some
    tree, and (u, v, more) of dense groups (see links_of_dense), which no tree takes apart.

    Vectors of different length never share a leaf. Nothing that shares a leaf is left out, however large the leaf. The
    trees are fitted to a sample; leaves that are too large for it are split on where they are. Components of any size
    from the smallest to the largest double count: vectors are scaled first.
    """
    spark = classes.sparkSession
    sizes = [r[0] for r in classes.select(F.length("key").alias("n")).distinct().orderBy("n").collect()]
    found, dense = spark.createDataFrame([], "u long, v long"), spark.createDataFrame([], "u long, v long, more long")
    for size in sizes:
        own = classes.where(F.length("key") == size)
        rows, unit = own.count(), _sample(own)
        centres = dense_centres(unit, rows, similarity, leaf)
        if len(centres):
            counted, own = links_of_dense(own, centres, similarity)
            dense = dense.union(counted)
            rows = own.count()
            if not rows:
                continue
            unit = _sample(own)
        told = spark.sparkContext.broadcast(fit_forest(unit, rows, trees, leaf, spill))

        def place(batches, told=told):
            for batch in batches:
                for at in range(0, batch.num_rows, 2048):
                    part = batch.slice(at, 2048)
                    whole = _matrix(part.column("key").to_pylist())
                    for row, t, leaf in told.value.leaves(whole / np.linalg.norm(whole, axis=1, keepdims=True)):
                        yield pa.RecordBatch.from_arrays([pa.array(leaf * TREES_MOST + t), part.column("node").take(pa.array(row)), part.column("key").take(pa.array(row))], ["cell", "node", "key"])

        leaves = common.cut(own.select("node", "key").mapInArrow(common.task("forest", place), "cell long, node long, key binary"), "leaves")
        placed = simhash.split_hot(split_on(leaves, OVERFULL * max(leaf, 1), spill), LEAF_ROWS)
        links = placed.select("cell", "part", "node", "key").repartition("cell", "part").sortWithinPartitions("cell", "part")
        found = found.union(links.mapInArrow(_leaf_links(similarity), "u long, v long").distinct())
    return found, dense


TREES_MOST = 1024


def _shadows(seed: int):
    """Each row's projection on its cell's own random direction."""

    def run(batches):
        for batch in batches:
            whole = _matrix(batch.column("key").to_pylist())
            cell, x = batch.column("cell").to_numpy(), np.empty(batch.num_rows)
            unit = whole / np.linalg.norm(whole, axis=1, keepdims=True) if len(whole) else whole
            for c in np.unique(cell):
                rng = np.random.default_rng([seed, int(np.uint64(np.int64(c).view(np.uint64)))])
                own = cell == c
                x[own] = unit[own] @ rng.standard_normal(unit.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column("cell"), batch.column("node"), batch.column("key"), pa.array(x)], ["cell", "node", "key", "x"])

    return run


def split_on(leaves: DataFrame, most: int, spill: float = SPILL, seed: int = SEED, rounds: int = 40) -> DataFrame:
    """leaves (cell, node, key) with cells of over most rows split at their medians, with spill, until none is left that a
    split makes smaller. Each round rewrites only the rows of such cells; nothing but cells' sizes is gathered."""
    done = None
    for turn in range(rounds):
        sizes = common.cut(leaves.groupBy("cell").agg(F.count(F.lit(1)).alias("n")), "sizes")
        big = sizes.where(F.col("n") > most)
        n = big.count()
        if not n:
            break
        small = leaves.join(common.maybe_broadcast(big, n), "cell", "left_anti")
        done = small if done is None else done.unionByName(small)
        told = leaves.join(common.maybe_broadcast(big, n), "cell").select("cell", "node", "key").mapInArrow(_shadows(seed + turn), "cell long, node long, key binary, x double")
        told = common.cut(told, "shadows")
        cuts = told.groupBy("cell").agg(F.percentile_approx("x", [0.5 - spill, 0.5 + spill], 1000).alias("q"), F.count(F.lit(1)).alias("n"))
        cuts = cuts.select("cell", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"), "n")
        own = told.join(common.maybe_broadcast(common.cut(cuts, "cuts"), n), "cell")
        sides = F.array_compact(F.array(F.when((F.col("x") <= F.col("high")) | (F.col("x") <= F.col("low")), 0), F.when(F.col("x") > F.col("low"), 1)))
        own = own.withColumn("side", F.explode(sides))
        counts = own.groupBy("cell", "side").agg(F.count(F.lit(1)).alias("m"), F.first("n").alias("n"))
        # a cell that a split doesn't make smaller stays whole; its rows are compared in parts
        stuck = counts.groupBy("cell").agg(F.max(F.col("m") / F.col("n")).alias("share")).where("share > 0.9").select("cell", F.lit(True).alias("stuck"))
        stuck = common.cut(stuck, "stuck")
        m = stuck.count()
        own = own.join(common.maybe_broadcast(stuck, m), "cell", "left")
        whole = own.where("stuck").select("cell", "node", "key").distinct()
        done = done.unionByName(whole) if m else done
        child = F.pmod(F.xxhash64("cell", "side", F.lit(turn)), F.lit((1 << 62) - 1)) + F.lit(1 << 62)
        leaves = common.cut(own.where("stuck is null").select(child.alias("cell"), "node", "key"), "leaves")
    return leaves if done is None else done.unionByName(leaves)


def near_duplicate_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", similarity: float = SIMILARITY, **forest) -> DataFrame:
    """(vec_id, n_links, component_id, kept): a row per row of vectors.

    Equal vectors are one class, so that a group of copies of any size costs one row; n_links counts each copy.
    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing, and neither does a row
    with a null id (its component is null and it isn't kept). Repeated ids count as separate vectors of the same id.
    """
    keys, classes = vector_classes(vectors, id_col, vector_col)
    links, dense = links_of_classes(classes, similarity, **forest)
    links = common.cut(links, "links")
    both = links.union(links.select("v", "u").toDF("u", "v"))
    outer = both.join(classes.select(F.col("node").alias("v"), "copies"), "v").select("u", "copies").union(dense.where("v is null").select("u", "more"))
    outer = outer.groupBy(F.col("u").alias("node")).agg(F.sum("copies").alias("more"))
    links = links.union(dense.where("v is not null").select("u", "v"))
    known = classes.join(outer, "node", "left").join(common.connected_components(links), "node", "left")
    known = known.select("key", (F.col("copies") - 1 + F.coalesce("more", F.lit(0))).alias("n"), F.coalesce("component", "node").alias("c"))
    rows = keys.where("id is not null").join(known, "key", "left").select("id", F.coalesce("n", F.lit(0)).alias("n_links"), F.coalesce("c", "id").alias("component_id"))
    rows = rows.unionByName(keys.where("id is null").select("id", F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("long").alias("component_id")))
    return rows.select(F.col("id").alias("vec_id"), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
