import re
from collections import Counter

from canasta.llm import quality_rules as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    triples = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(triples)
    covered = {i + k for i, t in enumerate(triples) if often[t] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n


def measured(docs):
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    return sorted((r["doc_id"] or -1, *(r[x] for x in names)) for r in q.apply_rules(docs.select("doc_id", "text")).collect())


def test_against_brute_force(documents, odd):
    for docs in (documents, odd):
        assert measured(docs) == sorted((r["doc_id"] or -1, *brute(r["text"])) for r in docs.collect())


def test_kept_implies_base_and_names_failures(documents):
    for r in q.apply_rules(documents).collect():
        assert r["kept"] == (not r["failed_rules"])
        assert not (r["kept"] and r["base_failed"])


def test_verdict_on_labelled_quality(spark, documents):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").where("quality = 1")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").join(labels, "doc_id", "left_semi")
    judged = q.apply_rules(docs).where("not base_failed")
    assert judged.where("kept").count() >= 0.97 * judged.count()


def test_filtered_plan_has_each_measure_once(documents):
    text = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    plain, filtered = (text(df) for df in (q.apply_rules(documents), q.apply_rules(documents).where("not base_failed and kept")))
    for part in ("xxhash64(", "split(", "regexp_extract_all(", "array_distinct("):
        assert plain.count(part) == filtered.count(part) > 0, part


def test_long_texts_filtered(spark):
    rows = [(i, " ".join(f"w{k * (i + 1) % 4999}" for k in range(20_000)), "x", "y") for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _w string, _own string")
    out = q.apply_rules(docs).where("not base_failed")
    assert out.columns[:4] == docs.columns and out.count() == sum(not brute(t)[-1] for _, t, *_ in rows)


def test_rules_of_lines(spark):
    said = "the quick word of the day is to be said in full"
    texts = {
        "bullets": "\n".join(f"- {said} {i}." for i in range(10)),
        "ellipses": "\n".join(f"{said} {i}{'...' if i % 2 else '.'}" for i in range(10)),
        "sentences": "\n".join(f"{said} {i}" for i in range(12)),
        None: "\n".join(f"{'* ' if i % 2 else ''}a{i} b{i} c{i} of the d{i} e{i}{'…' if i < 3 else '.' if i < 5 else ''}" for i in range(10)),
    }
    rows = q.apply_rules(spark.createDataFrame([(str(k), t) for k, t in texts.items()], "doc_id string, text string"), base=()).collect()
    assert {r["doc_id"]: r["failed_rules"] for r in rows} == {str(k): [k] if k else [] for k in texts}


def test_native_plan_without_shuffle(documents):
    plan = q.apply_rules(documents)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_empty_table(empty):
    assert q.apply_rules(empty.select("doc_id", "text")).count() == 0
