import numpy as np
import pyarrow as pa
import pytest

from tallyspark.llm import common, forest, queries

SF = "/root/testdata/sf0.001"


def brute(rows, least=0.9):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and len(v) and None not in v and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, float))]
    links = {k: set() for k in range(len(good))}
    for a in range(len(good)):
        for b in range(a + 1, len(good)):
            x, y = good[a][1], good[b][1]
            if len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= least:
                links[a].add(b)
                links[b].add(a)
    return good, links


def test_query_against_brute_force(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in common.table(spark, SF, "embeddings").collect()]
    unit = np.array([v for _, v in rows], float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    got = {r["vec_id"]: r for r in queries.op3_embedding_neardup(spark, SF).collect()}
    found, there = sum(got[i]["n_links"] for i, _ in rows), int(near.sum())
    assert len(got) == len(rows) and found <= there and found >= 0.9 * there
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) and r["component_id"] <= r["vec_id"] for r in got.values())


def test_recall_of_deep_trees(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((700, 32))
    x = np.concatenate([centres, centres + rng.standard_normal((700, 32)) * 0.2, centres[:40]])
    vectors = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["n_links"] for r in forest.near_duplicate_vectors(vectors, leaf=24).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (unit @ unit.T >= 0.9).sum(1) - 1
    assert all(got[i] <= n for i, n in enumerate(near)) and sum(got.values()) >= 0.9 * near.sum()


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (8, [None, 1.0]), (None, [1.0, 0.0]), (9, [0.0, 1.0]), (10, [1.0, 0.0, 0.0])]
    vectors = spark.createDataFrame([(*r, 0, 0) for r in rows], "vec_id long, embedding array<double>, key int, node int")
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in forest.near_duplicate_vectors(vectors).collect()), key=str)
    assert got == sorted([(1, 2, 1, True), (2, 2, 1, False), (2, 2, 1, False), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True), (6, 0, 6, True), (7, 0, 7, True), (8, 0, 8, True), (None, 0, None, False), (9, 0, 9, True), (10, 0, 10, True)], key=str)
    assert forest.near_duplicate_vectors(vectors.limit(0)).count() == 0


def test_large_leaves_are_compared_whole(spark, monkeypatch):
    monkeypatch.setattr(forest, "LEAF_ROWS", 16)
    rng = np.random.default_rng(4)
    x = rng.standard_normal(8) + rng.standard_normal((150, 8)) * 0.25
    rows = [(i, [float(a) for a in v]) for i, v in enumerate(x)]
    got = {r["vec_id"]: r["n_links"] for r in forest.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), leaf=1000).collect()}
    good, links = brute(rows)
    assert got == {good[k][0]: len(v) for k, v in links.items()}


@pytest.mark.parametrize("n", [3000, 6000, 15000])
def test_one_group_of_a_third_of_the_rows(spark, n):
    rng = np.random.default_rng(n)
    x = rng.standard_normal((n, 64))
    x[: n // 3] = x[0] + rng.standard_normal((n // 3, 64)) * 0.2
    x[n // 3 : n // 3 + 300] = x[-1] + rng.standard_normal((300, 64)) * 0.2
    x[:20] = x[:1]
    got = forest.near_duplicate_vectors(spark.createDataFrame(pa.table({"vec_id": np.arange(n), "embedding": list(x)}))).toPandas().set_index("vec_id").sort_index()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = np.array([np.count_nonzero(unit[at : at + 500] @ unit.T >= 0.9, axis=1) for at in range(0, n, 500)]).ravel() - 1
    assert (got["n_links"] <= near).all() and got["n_links"].sum() >= 0.99 * near.sum()
    assert (got["n_links"][: n // 3] == near[: n // 3]).all() and (got["component_id"][: n // 3] == 0).all()


def test_dense_groups_in_parts_beside_each_other(spark, monkeypatch):
    monkeypatch.setattr(forest, "LEAF_ROWS", 32)
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.standard_normal(8) + rng.standard_normal((300, 8)) * 0.45, rng.standard_normal((100, 8)), rng.standard_normal((120, 2)) @ rng.standard_normal((2, 8))])
    rows = [(i, [float(a) for a in v]) for i, v in enumerate(x)]
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    centres = forest.dense_centres(unit, len(x), 0.9, 24)
    dense = np.flatnonzero((unit @ centres.T >= 0.9).any(1))
    got = {r["vec_id"]: r["n_links"] for r in forest.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), leaf=24).collect()}
    good, links = brute(rows)
    assert len(centres) > 1 and all(got[k] == len(links[k]) for k in dense)


def test_very_large_and_small_components_link(spark):
    rows = [(1, [1e200, 0.0]), (2, [2e200, 0.0]), (3, [1e-200, 0.0]), (4, [2e-200, 1e-300]), (5, [1.0, 0.0]), (6, [0.0, 5e-324]), (7, [0.0, 1.0])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in forest.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (4, 1), 2: (4, 1), 3: (4, 1), 4: (4, 1), 5: (4, 1), 6: (1, 6), 7: (1, 6)}


def test_recall_of_planted_pairs_at_depths():
    rng = np.random.default_rng(8)
    base = rng.standard_normal((10_000, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    side = rng.standard_normal(base.shape)
    side -= (side * base).sum(1, keepdims=True) * base
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    for cosine, least in ((0.92, 0.99), (0.9001, 0.98)):
        near = cosine * base + np.sqrt(1 - cosine**2) * side
        unit = np.concatenate([base, near])
        for depth in (9, 11):
            trees = forest.fit_forest(unit[:: 2], 192 << depth)
            assert len(trees.cuts[0]) == min(depth, forest._depth(10_000, 192 << depth, 192))
            met = np.zeros(10_000, bool)
            for row, _, leaf in trees.leaves(unit):
                pairs = row * (1 << 20) + leaf
                first, second = pairs[row < 10_000], pairs[row >= 10_000] - (10_000 << 20)
                met[np.unique(np.intersect1d(first, second) >> 20)] = True
            assert met.mean() >= least, (cosine, depth, met.mean())


def test_leaves_that_the_sample_can_not_split_are_split_on(spark):
    rng = np.random.default_rng(9)
    own = rng.standard_normal((3_000, 16))
    keys = [b"d" + x.astype("<f8").tobytes() for x in own]
    leaves = spark.createDataFrame([(5, i, bytearray(k)) for i, k in enumerate(keys)] + [(6, i, bytearray(keys[0])) for i in range(500)] + [(7, 1, bytearray(keys[1]))], "cell long, node long, key binary")
    got = forest.split_on(leaves, 200)
    sizes = {r["cell"]: r["count"] for r in got.groupBy("cell").count().collect()}
    assert sizes[6] == 500 and sizes[7] == 1 and 5 not in sizes and max(n for c, n in sizes.items() if c != 6) <= 200
    assert got.where("cell not in (6, 7)").select("node").distinct().count() == 3_000
