import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from canasta.llm import cotraining as c


def test_held_out_accuracy_and_no_leak(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rows = {r["doc_id"]: r for r in c.score(docs, labels).collect()}
    assert len(rows) == docs.count()
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    held = [(truth[i], r["predicted"]) for i, r in rows.items() if r["held_out"] and i in truth]
    assert all(zlib.crc32(str(i).encode()) % 5 == 0 for i, r in rows.items() if r["held_out"])
    share = max(np.mean([a for a, _ in held]), 1 - np.mean([a for a, _ in held]))
    assert np.mean([a == b for a, b in held]) >= max(0.9, share)
    flipped = labels.withColumn("quality", F.when(c.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r["doc_id"]: r["score"] for r in c.score(docs, flipped).collect()}
    assert all(abs(again[i] - r["score"]) < 1e-9 for i, r in rows.items())


def told_apart(spark, labelled=60, free=3000, seed=1):
    """Two views of the same classes, each of one telling column, drowned in noise."""
    rng = np.random.default_rng(seed)
    n = labelled + free
    y = (rng.random(n) < 0.4).astype(float)
    one = rng.normal(0, 1, (n, c.CONTENT)).astype(np.float32)
    one[:, :3] += (y * 2 - 1)[:, None] * 0.9
    lang = np.where(rng.random(n) < 0.9, y, 1 - y).astype(int) + 2
    size = (rng.normal(0, 1, n) + 3 * y).astype(np.float32)
    rows = [(i, one[i].tolist(), int(lang[i]), 7, float(size[i]), float(y[i]) if i < labelled else None, i < labelled and i % 5 == 0) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, content array<float>, lang int, source int, size float, y double, held boolean").repartition(3), y, rows


def brute(rows, rounds, share, sure):
    """The same training with the pseudo-labels kept in arrays."""
    one = np.array([r[1] for r in rows], np.float32).astype(float)
    two = np.zeros((len(rows), c.META))
    for i, r in enumerate(rows):
        two[i, r[2]] += 1
        two[i, r[3]] += 1
        two[i, c.NAMES], two[i, c.NAMES + 1] = np.float32(r[4]), float(np.float32(r[4])) ** 2 / 10
    known = np.array([r[5] is not None for r in rows])
    learn_from = np.array([r[5] is not None and not r[6] for r in rows])
    y = np.array([np.nan if r[5] is None else r[5] for r in rows])
    z = [np.column_stack([np.ones(len(x)), np.clip((x - x.mean(0)) / (x.std(0) + 1e-6), -8, 8)]) for x in (one, two)]
    prior = np.mean(y[learn_from])
    said = [np.full(len(rows), np.nan), np.full(len(rows), np.nan)]
    w = [np.zeros(x.shape[1]) for x in z]

    def newton(x, t, ridge, count):
        v = np.zeros(x.shape[1])
        for _ in range(count):
            p = 1 / (1 + np.exp(-np.clip(x @ v, -30, 30)))
            g = x.T @ (p - t) + ridge * v
            h = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + ridge * np.eye(len(v))
            step = np.linalg.solve(h, g)
            v = v - step * min(1.0, 10 / np.abs(step).max())
        return v

    def learn():
        for v in (0, 1):
            t = np.where(learn_from, y, np.where(known, np.nan, said[1 - v]))
            at = ~np.isnan(t)
            w[v] = newton(z[v][at], t[at], c.RIDGE, c.STEPS)

    learn()
    held = known & ~learn_from
    for _ in range(rounds):
        marks, odds = [], [np.clip(x @ a, -30, 30) for x, a in zip(z, w)]
        for v in (0, 1):
            curve = newton(np.column_stack([np.ones(held.sum()), odds[v][held]]), y[held], 0.1, 25)
            told = lambda o: curve[0] + max(0, curve[1]) * o  # noqa: B023, E731
            edge = np.log(sure / (1 - sure))
            open_ = ~known & np.isnan(said[v])
            o = np.floor((odds[v][open_] + 30) * 100).astype(int)  # bins of a hundredth
            highs = [b for b in range(6000) if (o >= b).sum() <= share * (~known).sum() * prior and told(b / 100 - 30) >= edge]
            lows = [b for b in range(6000) if (o <= b).sum() <= share * (~known).sum() * (1 - prior) and told((b + 1) / 100 - 30) <= -edge]
            marks.append((open_, highs[0] if highs and curve[1] > 0 else 10**9, lows[-1] if lows and curve[1] > 0 else -1))
        for v, (open_, high, low) in enumerate(marks):
            o = np.floor((odds[v] + 30) * 100)
            said[v][open_ & (o >= high)] = 1
            said[v][open_ & (o <= low)] = 0
        learn()
    return w, said


@pytest.mark.parametrize("rounds", [0, 3])
def test_against_brute_force(spark, rounds):
    table, _, rows = told_apart(spark, free=400)
    model = c.fit(table, rounds, 0.2, 0.7)
    want, said = brute(rows, rounds, 0.2, 0.7)
    for a, b in zip(model.weights, want):
        assert np.allclose(a, b, atol=0.02)
    if rounds:
        got = summary(model, rows)
        assert all(np.mean((a == b) | (np.isnan(a) & np.isnan(b))) > 0.98 for a, b in zip(got, said))
        assert all(np.nansum(s == 1) and np.nansum(s == 0) for s in said)


def summary(model, rows):
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([r[1] for r in rows], pa.list_(pa.float32())), pa.array([r[2] for r in rows], pa.int32()), pa.array([r[3] for r in rows], pa.int32()), pa.array([r[4] for r in rows], pa.float32())], names=["content", "lang", "source", "size"])
    z = model.columns(c.views(batch))
    free = np.array([r[5] is None for r in rows])
    return [np.where(free, model.labels_by(v, z), np.nan) for v in (0, 1)]


def test_rounds_teach(spark):
    """With few labels, both views do better after the rounds than without them."""
    import pyarrow as pa

    gains = []
    for seed in (1, 2, 3):
        table, y, rows = told_apart(spark, labelled=30, seed=seed)
        batch = pa.RecordBatch.from_arrays([pa.array([r[1] for r in rows], pa.list_(pa.float32())), *(pa.array([r[k] for r in rows], t) for k, t in ((2, pa.int32()), (3, pa.int32()), (4, pa.float32())))], names=["content", "lang", "source", "size"])
        right = [np.mean((c.fit(table, rounds).score(c.views(batch)) >= 0.5) == y) for rounds in (0, c.ROUNDS)]
        gains.append(right[1] - right[0])
    assert np.mean(gains) > 0.01, gains


def test_bounds_keep_both_classes_in_proportion():
    found = np.zeros(c.BINS)
    found[5000:] = 10  # 10,000 rows that are surely 1
    found[:100] = 10  # and 1,000 that are surely 0
    high, low = c.bounds(found, (0.0, 1.0), 20_000, 0.5, 0.1, 0.95)
    edges = np.linspace(-30, 30, c.BINS + 1)
    assert found[edges[:-1] >= high].sum() == 1000 and found[edges[1:] <= low].sum() == 1000
    assert c.bounds(np.zeros(c.BINS), (0.0, 1.0), 0, 0.5, 0.1, 0.95)[0] >= np.log(19)
    assert c.bounds(found, (2.0, -0.5), 20_000, 0.5, 0.1, 0.95) == (np.inf, -np.inf)  # a view that is wrong more often than right


def test_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(i, i % 2) for i in range(17)], "doc_id long, quality int")
    rows = c.score(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert {r["score"] for r in c.score(odd, labels.limit(0)).collect()} == {0.5}
    assert c.score(empty, labels).count() == 0


def test_names_have_columns_of_their_own(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"s{i % 90}", None if i % 2 else "en") for i in range(180)], "doc_id long, source string, lang string")
    own, width = c.name_columns(docs)
    assert width == len(own) == 92 and sorted(own.values()) == list(range(92))
    assert c.name_column("lang", None, own) == own["lang", None]
    monkeypatch.setattr(c, "MOST_NAMES", 10)
    own, width = c.name_columns(docs)
    assert len(own) == 10 and width == 10 + c.NAMES and 10 <= c.name_column("source", "s89", own) < width
    assert c.name_columns(docs.limit(0)) == ({}, 1)
