import itertools
import random

import numpy as np
import xxhash

from canasta.llm import simhash
from canasta.llm.components import components


def fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def brute_components(fps):
    ids = sorted(fps, key=lambda x: -1 if x is None else x)
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(ids, 2):
        if (fps[a] ^ fps[b]).bit_count() <= 4:
            x, y = root(a), root(b)
            if x != y:
                up[ids[max(ids.index(x), ids.index(y))]] = ids[min(ids.index(x), ids.index(y))]
    return {i: root(i) for i in ids}


def test_against_brute_force(spark, documents, texts):
    fps = {i: fingerprint(t) for i, t in texts.items()}
    want = brute_components(fps)
    rows = simhash.near_duplicates(documents).collect()
    assert {r["doc_id"]: r["fp"] % 2**64 for r in rows} == fps
    assert {r["doc_id"]: r["component_id"] for r in rows} == want


def test_odd_rows(odd, empty):
    rows = simhash.near_duplicates(odd.where("doc_id is not null")).collect()
    got = {r["doc_id"]: r["component_id"] for r in rows}
    assert got[0] == got[1] == got[2] == got[7] == 0 and got[5] == got[6] == 5
    assert len(rows) == odd.count() - 1
    assert simhash.near_duplicates(odd).count() == odd.count()
    assert simhash.near_duplicates(empty).count() == 0


def planted(seed, count=300, balls=3, size=120):
    rng = random.Random(seed)
    fps = {rng.getrandbits(64) for _ in range(count)}
    for _ in range(balls):
        center = rng.getrandbits(64)
        for _ in range(size):
            x = center
            for b in rng.sample(range(64), rng.randint(0, 5)):
                x ^= 1 << b
            fps.add(x)
    return sorted(fps)


def linked(spark, fps, cell, blocks=simhash.BLOCKS):
    distinct = spark.createDataFrame([(int(np.uint64(x).view(np.int64)),) for x in fps], "fp long")
    roots = {r["node"]: r["root"] for r in components(simhash.links(distinct, cell=cell, blocks=blocks)).collect()}
    groups = {}
    for x in fps:
        s = int(np.uint64(x).view(np.int64))
        groups.setdefault(roots.get(s, s), set()).add(x)
    return sorted(map(sorted, groups.values()))


def test_dense_groups_whole_and_in_cells(spark):
    fps = planted(7)
    by_root = {}
    for x, r in brute_components(dict(enumerate(fps))).items():
        by_root.setdefault(r, set()).add(fps[x])
    want = sorted(map(sorted, by_root.values()))
    assert linked(spark, fps, simhash.CELL) == want
    assert linked(spark, fps, 16) == want
    assert linked(spark, fps, simhash.CELL, simhash.FINE_BLOCKS) == want


def test_every_near_pair_shares_a_key(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(200):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), 4):
            y ^= 1 << b
        rows.append(tuple(int(np.uint64(v).view(np.int64)) for v in (x, y)))
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "x long, y long")
    for blocks in (simhash.BLOCKS, simhash.FINE_BLOCKS):
        assert df.where(F.arrays_overlap(simhash.keys(F.col("x"), blocks), simhash.keys(F.col("y"), blocks))).count() == 200
    table = df.select(F.abs(F.shiftrightunsigned(simhash.pivot_table(F.col("x")), 0).bitwiseAND(F.lit(255)) - simhash.pivot_table(F.col("y")).bitwiseAND(F.lit(255))).alias("d"))
    assert table.agg(F.max("d")).first()[0] <= 4


def test_components_of_a_chain_and_a_hub(spark):
    chain = [(i + 1, i) for i in range(200)] + [(1000 + i, 999) for i in range(1, 300)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(chain, "hi long, lo long")).collect()}
    assert all(got[i] == 0 for i in range(201)) and all(got[1000 + i] == 999 for i in range(1, 300))
