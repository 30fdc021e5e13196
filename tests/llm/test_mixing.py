import hashlib
import re
from collections import defaultdict

import pytest

from canasta.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def water_filled(sizes, weights=(5, 2, 1), most=3):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in capped]
        if not free:
            return {s: sizes[s] * most for s in order}
        share = (total - sum(sizes[s] * most for s in capped)) / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * share > sizes[s] * most}
        if not over:
            return {s: sizes[s] * most if s in capped else weight[s] * share for s in order}
        capped |= over


def brute(rows):
    sizes = defaultdict(int)
    for _, source, text in rows:
        sizes[source] += len(WORD.findall(text or ""))
    targets = water_filled(sizes)
    drawn = defaultdict(list)
    for k in range(mixing.DRAWS):
        total = defaultdict(int)
        for key, source, text in rows:
            total[source] += times(key, sizes[source], targets[source], k) * len(WORD.findall(text or ""))
        for s in sizes:
            drawn[s].append(abs(total[s] - targets[s]))
    best = {s: drawn[s].index(min(drawn[s])) for s in sizes}
    return sorted(
        (-1 if key is None else key, n := len(WORD.findall(text or "")), sizes[source], round(targets[source], 6), n * times(key, sizes[source], targets[source], best[source]))
        for key, source, text in rows
    )


def times(key, size, target, k):
    rate = min(target / size, 3.0) if size else 0.0
    digest = hashlib.sha256(f"{'' if key is None else key}:{k // 12}".encode()).hexdigest()
    return int(rate) + (int(digest[5 * (k % 12) :][:5], 16) / 16**5 < rate - int(rate))


def planned(docs):
    rows = mixing.plan(docs).collect()
    return sorted((-1 if r["doc_id"] is None else r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in rows)


def test_plan_against_brute_force(documents, odd):
    for docs in (documents, odd):
        assert planned(docs) == brute([(r["doc_id"], r["source"], r["text"]) for r in docs.collect()])


def test_near_targets_and_bounds(spark):
    taken, target = defaultdict(int), {}
    for r in mixing.plan(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect():
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert r["taken"] <= 3 * r["size"]
    assert all(abs(taken[s] - target[s]) <= 0.05 * target[s] for s in target)
    assert abs(sum(taken.values()) - sum(target.values())) < 0.01 * sum(target.values())


def test_mix_repeats_rows_as_planned(documents):
    copies = {r["doc_id"]: r["copies"] for r in mixing.plan(documents).collect()}
    mixed = mixing.mix(documents)
    assert mixed.columns == documents.columns
    got = {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert got == {k: v for k, v in copies.items() if v}


@pytest.mark.parametrize("limit", [0])
def test_many_sources_join_by_salt(documents, monkeypatch, limit):
    want = planned(documents)
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", limit)
    assert planned(documents) == want


def test_empty_table(empty):
    assert mixing.plan(empty).count() == 0
    assert mixing.mix(empty).count() == 0
