import random
import re

import numpy as np
import xxhash

from tallyspark.llm import common, queries, simhash

SF = "/root/testdata/sf0.001"


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(fps):
    ids = [i for i, _ in fps]
    parent = {i: i for i in ids}
    for _ in range(len(ids)):
        changed = False
        for i, a in fps:
            low = min(parent[j] for j, b in fps if bin(a ^ b).count("1") <= 3)
            if low < parent[i]:
                parent[i], changed = low, True
        if not changed:
            break
    return parent


def test_query_equals_brute_force(spark):
    docs = [(r["doc_id"], slow_fingerprint(r["text"])) for r in common.table(spark, SF, "documents").collect()]
    want = slow_components(docs)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op6_simhash(spark, SF).collect()}
    assert got == {i: (f"{f:016x}", want[i]) for i, f in docs}


def test_links_of_close_fingerprints(spark, monkeypatch):
    rnd = random.Random(5)
    base = [rnd.getrandbits(64) for _ in range(12)]
    fps = [b ^ sum(1 << p for p in rnd.sample(range(64), rnd.randint(0, 5))) for b in base for _ in range(25)]
    rows = list(enumerate(fps))
    frame = spark.createDataFrame([(i, int(np.uint64(f).astype(np.int64))) for i, f in rows], "id long, fp long")
    want = slow_components(rows)
    for cell in (4096, 6):
        monkeypatch.setattr(simhash, "CELL", cell)
        groups = {r["fp"]: r["component_id"] for r in simhash.fingerprint_groups(frame).collect()}
        assert {i: groups[int(np.uint64(f).astype(np.int64))] for i, f in rows} == want


def test_manhattan_is_a_lower_bound():
    rng = np.random.default_rng(6)
    a, b = rng.integers(0, 2**63, (2, 500), dtype=np.uint64)
    low = simhash.manhattan(simhash.segment_counts(a), simhash.segment_counts(b))
    assert (low <= np.bitwise_count(a ^ b)).all() and low.max() > 5
    exact = [sum(abs(bin(int(x) >> s & 3).count("1") - bin(int(y) >> s & 3).count("1")) for s in range(0, 64, 2)) for x, y in zip(a, b)]
    assert low.tolist() == exact


def test_odd_documents(spark, odd_docs, no_docs):
    got = sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(odd_docs).collect()), key=str)
    text = f"{slow_fingerprint('alpha beta gamma delta epsilon'):016x}"
    zero = "0" * 16
    assert [x for x in got if x[1] == text] == [(1, text, 1), (1, text, 1), (None, text, 1)]
    assert [x for x in got if x[1] == zero] == [(2, zero, 2), (3, zero, 2), (4, zero, 2), (None, zero, 2)]
    kept = simhash.deduplicate(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == [1, 2, 5, 6, 7, None, None]
    assert simhash.near_duplicates(no_docs).count() == 0 and simhash.deduplicate(no_docs).count() == 0


def test_components(spark):
    rnd = random.Random(7)
    edges = [(i, i + 1) for i in range(0, 400) if i % 100 != 99] + [(1000, rnd.randint(1001, 1300)) for _ in range(200)] + [(5, 5), (None, 3)]
    got = {r["node"]: r["component"] for r in common.connected_components(spark.createDataFrame(edges, "u long, v long").repartition(4)).collect()}
    assert all(got[i] == i - i % 100 for i in range(400) if i % 100) and all(c == 1000 for n, c in got.items() if n > 1000)
    assert common.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_repeated_ids_count_in_their_own_groups(spark):
    a, b, c = "alpha beta gamma delta epsilon zeta", "quite another text about entirely different things", "a third one that shares no words"
    rows = [(1, a), (5, a), (5, b), (7, b), (9, c), (9, c)]
    got = sorted(map(tuple, simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == [(1, a), (5, b), (9, c)]
    alone = sorted(map(tuple, simhash.deduplicate(spark.createDataFrame([(5, a), (5, b)], "doc_id long, text string")).collect()))
    assert alone == [(5, a), (5, b)]
    found = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[5, f"{simhash.fingerprint(a):016x}"] == 1 and found[7, f"{simhash.fingerprint(b):016x}"] == 5
