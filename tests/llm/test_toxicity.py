import math
import random
import re
import zlib
from collections import Counter

import xxhash
from canasta.llm import toxicity
from pyspark.sql import functions as F

LEXICON = {"idiot": 4.0, "scum": 4.0, "trash": 3.0}


def test_folding_keeps_length_and_undoes_disguises():
    for raw, plain in [("1d10t", "idiot"), ("іdіоt", "idiot"), ("ｉｄｉｏｔ", "idiot"), ("$cum", "scum"), ("5CUM", "scum"), ("tr@sh", "trash"), ("İstanbul 2024 $$$", None), ("100 apples", None)]:
        assert len(toxicity.fold(raw)) == len(raw)
        if plain:
            assert toxicity.fold(raw) == plain
    assert toxicity.fold("in 1984 $50!! a!") == "in 1984 $50!! a!"


def test_words_bounds_and_exceptions():
    found = lambda t: [t[a:b] for a, b, _ in toxicity.Matcher(LEXICON).spans(t)]
    assert found("You IDIOT, 1d10t!") == ["IDIOT", "1d10t"]
    assert found("idiotic trashing") == []
    assert found("put it in the trash can, trash") == ["trash"]
    assert found("") == []


def test_other_forms_of_letters_fold():
    for raw in ("𝐢𝐝𝐢𝐨𝐭", "ⓘⓓⓘⓞⓣ", "IDIOT", "ıdıot", "𝕴𝖉𝖎𝖔𝖙"):
        assert toxicity.fold(raw) == "idiot" and len(toxicity.fold(raw)) == len(raw)
    assert toxicity.fold("façade naïve Straße 日本") == "façade naïve strase 日本"
    assert len("".join(toxicity.HOMOGLYPHS)) == len(toxicity.HOMOGLYPHS)


def naive_spans(text, lexicon, exceptions):
    """Each entry and phrase sought by itself."""
    folded = toxicity.fold(text)

    def at(entry):
        phrase, stem = entry.rstrip("*"), entry.endswith("*")
        k = folded.find(phrase)
        while k >= 0:
            end = k + len(phrase)
            if not (k and folded[k - 1].isalpha()) and (stem or not (end < len(folded) and folded[end].isalpha())):
                yield k, end
            k = folded.find(phrase, k + 1)

    spared = [s for p in exceptions for s in at(p)]
    return sorted((a, b, w) for e, w in lexicon.items() for a, b in at(e) if not any(x <= a and b <= y for x, y in spared))


def test_matcher_against_a_naive_one(documents, texts):
    words = Counter(w for t in texts.values() for w in re.findall(r"[^\W\d_]+", toxicity.fold(t or "")))
    lexicon = {w: float(i % 7 + 1) for i, w in enumerate(list(words)[:: max(1, len(words) // 150)])} | LEXICON
    lexicon |= {f"{w[:5]}*": 0.5 for w in list(lexicon)[::9] if len(w) > 5}
    often = Counter(x for t in texts.values() for x in re.findall(r"(?=\b([^\W\d_]+ [^\W\d_]+)\b)", toxicity.fold(t or "")) if x.split()[0] in lexicon)
    exceptions = (*toxicity.EXCEPTIONS, *[p for p, _ in often.most_common(20)])
    found = {r["doc_id"]: sorted((s["start"], s["end"], s["weight"]) for s in r["spans"]) for r in toxicity.spans(documents, lexicon, exceptions).collect()}
    assert found == {i: naive_spans(t or "", lexicon, exceptions) for i, t in texts.items()}
    assert sum(map(len, found.values())) > 200 and any(naive_spans(t or "", lexicon, ()) != found[i] for i, t in texts.items())


def test_exceptions_are_learned_and_the_curve_is_fitted_on_other_rows(spark):
    rng = random.Random(4)
    filler = [f"w{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}" for i in range(100)]
    said = lambda *more: " ".join([*rng.sample(filler, 30), *more, *rng.sample(filler, 10)])
    rows = [(i, said("you", "numbskull", "there") if i % 2 else said("numbskull", "island") if i % 30 == 0 else said(), i % 2) for i in range(300)]
    sample = spark.createDataFrame(rows, "doc_id long, text string, toxic int").select("text", "toxic")
    lexicon, exceptions, curve = toxicity.learn(sample)
    assert "numbskull" in lexicon and "numbskull island" in exceptions and "you numbskull" not in exceptions
    docs = spark.createDataFrame([(1, said("numbskull", "island")), (2, said("numbskull", "again"))], "doc_id long, text string")
    hits = {r["doc_id"]: r["hits"] for r in toxicity.score_parts(docs, lexicon, exceptions=exceptions).collect()}
    assert hits[1] == 0 < hits[2]


def plain_learning(rows):
    """Lexicon of (text, toxic, copies) rows by plain counting; the third by xxh64 is not seen."""
    seen = [(t, y, c) for t, y, c in rows if _signed(t) % 3]
    docs = {y: len({c for _, z, c in seen if z == y}) for y in (0, 1)}
    holds = {}
    for t, y, c in seen:
        words = {w for w in re.findall(r"[^\W\d_]+", toxicity.fold(t or "")) if len(w) >= 3}
        for w in {w for w in words if len(w) <= 40} | {f"{w[:k]}*" for w in words for k in toxicity.STEMS if len(w) > k}:
            holds.setdefault(w, (set(), set()))[y].add(c)
    found, s, share = {}, toxicity.SMOOTHING, docs[1] / (docs[0] + docs[1])
    for w, (g, b) in holds.items():
        g, b = len(g), len(b)
        if b < toxicity.LEAST_DOCS:
            continue
        weight = math.log((b + s) / (docs[1] + 2 * s)) - math.log((g + s) / (docs[0] + 2 * s))
        evidence = b * math.log(b / ((b + g) * share)) + (g * math.log(g / ((b + g) * (1 - share))) if g else 0)
        if weight >= (toxicity.LEAST_STEM_WEIGHT if w.endswith("*") else toxicity.LEAST_WEIGHT) and evidence >= toxicity.LEAST_EVIDENCE:
            found[w] = (evidence, weight)
    kept = {}
    for w in sorted(found, key=lambda e: (-found[e][0], e.endswith("*"), -len(e), e)):
        key = w.rstrip("*")
        if not any(key.startswith(k.rstrip("*")) and k.endswith("*") or (w.endswith("*") and k.rstrip("*").startswith(key)) for k in kept):
            kept[w] = found[w][1]
    return kept


def _signed(text):
    h = xxhash.xxh64_intdigest((text or "").encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def test_learning_and_score_against_a_plain_version(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    taught = [i for i, in labels.where("toxic is not null").select("doc_id").collect() if zlib.crc32(str(i).encode()) % 5]
    sample = docs.join(labels, "doc_id").where(F.col("doc_id").isin(taught)).select("doc_id", "text", "toxic")
    near = toxicity.near_copies(sample).cache()
    rows = [(r["text"], r["toxic"], r["copies"]) for r in near.collect()]
    want = plain_learning(rows)
    lexicon, exceptions, curve = toxicity.learn(near)
    assert lexicon.keys() == want.keys() and all(abs(lexicon[w] - want[w]) < 1e-9 for w in want) and lexicon
    scored = {r["doc_id"]: r["score"] for r in toxicity.score(docs, labels).collect()}
    for r in docs.collect():
        text = r["text"] or ""
        total = sum(w for _, _, w in naive_spans(text, lexicon, exceptions))
        x = (1.0, math.log1p(total), math.log1p(total / math.sqrt(max(1, text.count(" ") + text.count("\n") + 1))))
        assert abs(scored[r["doc_id"]] - 1 / (1 + math.exp(-sum(a * b for a, b in zip(curve, x))))) < 1e-9


def test_entries_of_most_evidence_stay():
    found = {"scum": (30.0, 5.0), "scumm*": (20.0, 4.0), "scummy": (25.0, 4.0), "idiot*": (40.0, 3.0), "idiotic": (39.0, 6.0), "moron": (9.0, 2.0), "moron*": (9.0, 2.0)}
    assert toxicity.apart(found) == {"idiot*": 3.0, "scum": 5.0, "scummy": 4.0, "moron": 2.0}


def test_near_copies_count_once(spark):
    said = "the long and plain text of many words that is copied a lot of times with hardly any change at all in it and more"
    rows = [(i, f"{said} vilename {said}", 1) for i in range(30)] + [(100 + i, f"text {i} of some {i * 7} other {i * 3} words and {i * 11} more", i % 2) for i in range(60)]
    sample = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    assert "vilename" not in toxicity.learn(toxicity.near_copies(sample))[0]
    assert len({r["copies"] for r in toxicity.near_copies(sample).where("doc_id < 100").collect()}) == 1


def test_held_out_accuracy_and_no_leak(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rows = {r["doc_id"]: r for r in toxicity.score(docs, labels).collect()}
    assert len(rows) == docs.count()
    for i, r in rows.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    held = [(truth[i], r["predicted"]) for i, r in rows.items() if r["held_out"] and i in truth]
    assert sum(a == b for a, b in held) / len(held) >= 0.9
    flipped = labels.selectExpr("doc_id", "case when crc32(cast(cast(doc_id as string) as binary)) % 5 = 0 then 1 - toxic else toxic end as toxic")
    again = {r["doc_id"]: r["score"] for r in toxicity.score(docs, flipped).collect()}
    assert again == {i: r["score"] for i, r in rows.items()}


def test_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(i, i % 2) for i in range(17)], "doc_id long, toxic int")
    assert toxicity.score(odd, labels).count() == odd.count()
    none = toxicity.score(odd, labels.limit(0)).collect()
    assert len({r["score"] for r in none}) == 1 and none[0]["predicted"] == 0
    assert toxicity.score(empty, labels).count() == 0


def test_spans_are_of_the_original(spark):
    docs = spark.createDataFrame([(1, "🙂 such ｉｄｉｏｔ"), (2, None)], "doc_id long, text string")
    got = {r["doc_id"]: [(s["start"], s["end"]) for s in r["spans"]] for r in toxicity.spans(docs, LEXICON).collect()}
    assert got == {1: [(7, 12)], 2: []}
