import math
import re
import zlib

import numpy as np
import pytest
from canasta.llm import lm_scoring as lm
from canasta.llm import registry

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def is_held(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5 == 1


def brute(docs):
    """doc_id, held_out, n_tokens, n_known, train_tokens and base_score of (doc_id, text)."""
    counts, texts = {}, 0
    for i, t in docs:
        if not is_held(i):
            texts += 1
            for w in words(t):
                counts[w] = counts.get(w, 0) + 1
    total, different = sum(counts.values()) + texts, len(counts) + bool(texts)
    out = []
    for i, t in docs:
        found = [counts.get(w, 0) for w in words(t)] + [texts]
        out.append((i, is_held(i), len(found), sum(c > 0 for c in found), total, sum(math.log10((c + 0.5) / (total + 0.5 * (different + 1))) for c in found)))
    return out


def held_against(got, want):
    key = lambda r: (repr(r[:5]), r[5])
    got, want = sorted((tuple(r)[:6] for r in got), key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5] for r in got], [r[5] for r in want], rtol=1e-9, atol=1e-9)


@pytest.fixture(scope="module")
def query(spark):
    return registry.op13_lm_scoring(spark, SF).collect()


def test_base_against_brute_force(documents, query):
    held_against(query, brute([(r["doc_id"], r["text"]) for r in documents.collect()]))


def test_context_helps_on_held_out_texts(query):
    held = [r for r in query if r["held_out"]]
    tokens = sum(r["n_tokens"] for r in held)
    assert sum(r["score"] for r in held) / tokens > sum(r["base_score"] for r in held) / tokens + 0.1


def test_words_not_looked_up_come_by_the_join(spark, documents, monkeypatch):
    monkeypatch.setattr(lm, "LOOKUP", 100)
    held_against(lm.score(documents, rounds=1).collect(), brute([(r["doc_id"], r["text"]) for r in documents.collect()]))


def test_odd_texts(spark, odd, empty):
    got = lm.score(odd.select("doc_id", "text"), rounds=1).collect()
    held_against(got, brute([(r["doc_id"], r["text"]) for r in odd.collect()]))
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    assert lm.score(empty).count() == 0


def test_without_training_texts(spark):
    docs = spark.createDataFrame([(i, "a b") for i in range(60) if is_held(i)], "doc_id long, text string")
    got = lm.score(docs).collect()
    assert {(r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in got} == {(3, 0, 0, 0.0)}
    assert all(math.isfinite(r["score"]) for r in got)


def test_probabilities_add_up_to_one():
    """Over all slots after a context, and over the words of a tail and its unseen one."""
    rng = np.random.default_rng(2)
    model = lm.Model.of(rng.integers(0, 1000, lm.SLOTS).astype(float))
    texts = rng.zipf(1.3, 5000).clip(1, lm.SLOTS).astype(np.uint16) - 1
    model.train(texts.astype(np.uint16), np.array([0, 1, 3, 2000]), 0.5, 1)
    for before in ([], [3], [7, 1, 900]):
        text = np.array([x for slot in range(lm.SLOTS) for x in (*before, slot)], np.uint16)
        size = len(before) + 1
        logs = model.log_probabilities(text, np.arange(0, len(text), size))[size - 1 :: size]
        assert abs(np.exp(logs).sum() - 1) < 1e-5
    vocabulary = lm.Vocabulary(None, np.zeros(0), 1, 9, 3, np.zeros(0), np.arange(lm.TAILS), 0, np.zeros(0, bool), np.full(lm.SLOTS, 8.0), np.full(lm.TAILS, 3.0))
    counts = np.array([5, 2, 1, 0])
    assert abs(((counts + 0.5) / np.exp(vocabulary.shares()[0])).sum() - 1) < 1e-12


def test_steps_follow_the_gradient():
    """One step moves each row by the gradient of the mini-batch's log loss over the root of its squares."""
    rng = np.random.default_rng(3)
    soft = lm.Softmax(rng.normal(0, 0.3, (50, 8)).astype(np.float32), np.ones(50, np.float32), np.zeros(50, np.float32))
    rows, bias, outcome = rng.integers(0, 50, (4, 300)).astype(np.uint16), np.zeros(8, np.float32), rng.integers(0, 8, 300)
    rows[0, :60] = 7  # a long run
    before = soft.weights.astype(float)
    z = before[rows].sum(axis=0)
    p = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
    p[np.arange(300), outcome] -= 1
    gradient = np.zeros((50, 8))
    for r in rows:
        np.add.at(gradient, r, p)
    soft.step(rows, bias, outcome, 0.5)
    want = before - 0.5 * gradient / np.sqrt(1 + (gradient**2).sum(axis=1))[:, None]
    assert np.allclose(soft.weights, want, atol=1e-4)
    assert soft.moved.sum() == 1200


def test_features_stop_at_the_text_s_start():
    slots = np.array([5, 6, 7, 8, 9, 5, 6, 7], np.uint16)
    together = lm.features(slots, np.array([0, 2, 3]))
    apart = [lm.features(slots[a:b], np.array([0])) for a, b in ((0, 2), (2, 3), (3, 8))]
    for k in range(4):
        assert together[k].tolist() == [h for part in apart for h in part[k].tolist()]


def test_tail_slots_agree_with_sql(spark):
    said = ["the", "a", "", "été", "日本語テスト", "x" * 50, "ndhest.", "🙂🙂"]
    df = spark.createDataFrame([(w,) for w in said], "word string").select("word", lm.tail_slot(lm.F.col("word")).alias("s"))
    import pyarrow as pa

    assert [r["s"] for r in df.collect()] == lm.tail_slots(pa.array(said)).tolist()
