import corpus_pipeline
import pytest
from canasta.llm import digests as digest_operator
from canasta.llm import registry
from test_codec import digests, library
from test_dedup import brute_lines
from test_mixing import times, water_filled, WORD
from test_simhash import brute_components, fingerprint

from pyspark.sql import functions as F

from canasta.llm import cotraining, line_dedup, mixing, quality_rules, secrets, simhash, substring_dedup, toxicity


def brute(docs):
    """Rows of the whole pipeline from (doc_id, source, text, kept by the rules)."""
    rows = {i: (s, t) for i, s, t, kept in docs if kept}
    gone = brute_lines((i, t) for i, (_, t) in rows.items())
    rows = {i: (s, "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone.get(i, ()))) for i, (s, t) in rows.items()}
    groups = brute_components({i: fingerprint(t) for i, (_, t) in rows.items()})
    rows = {i: v for i, v in rows.items() if groups[i] == i}
    sizes = {}
    for s, t in rows.values():
        sizes[s] = sizes.get(s, 0) + len(WORD.findall(t))
    targets = water_filled(sizes)
    out = []
    for source in sizes:
        own = {i: t for i, (s, t) in rows.items() if s == source}
        gaps = [abs(sum(times(i, sizes[source], targets[source], k) * len(WORD.findall(t)) for i, t in own.items()) - targets[source]) for k in range(mixing.DRAWS)]
        for i, t in own.items():
            out += [(i, *digests(*library(t)))] * times(i, sizes[source], targets[source], gaps.index(min(gaps)))
    return sorted(out)


def test_run_against_brute_force(spark, documents):
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.apply_rules(documents).collect()}
    want = brute([(r["doc_id"], r["source"], r["text"], kept[r["doc_id"]]) for r in documents.collect()])
    got = sorted((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect())
    assert got == want


def test_stages_keep_columns_and_take_odd_and_empty_tables(spark, odd, empty):
    for docs in (odd, empty):
        names = docs.columns
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, "/nowhere").cache()
            assert docs.columns == names, name
            docs.count()
        assert corpus_pipeline.STAGES[-1][1](spark, docs, "/nowhere").columns[0] == "doc_id"


#: Names that operators use for themselves, somewhere or other.
PRIVATE = """_row _w _lines _tri _sorted _own _text _id _key _doc _d _gone _spans _source _rate _draw _times _copy _s _salt _at _part _last _place _y _h _all
d id k line lines fp first last root size copies taken target rate kept n_words failed_rules col word n range copy y held content score""".split()


@pytest.fixture(params=["long", "string"])
def hostile(spark, request):
    """Rows that share an id with other texts, rows without an id, equal rows, odd texts, and a column of every private name."""
    said = "the quick line of many plain words that is to be said in the long and quiet evening of a day in june"
    texts = [f"{said} {i}.\n" + " ".join(f"w{i}x{k}" for k in range(60)) + " and the rest of it is in here." for i in range(12)]
    ids = [1, 1, 2, None, None, 3, 3, 4, 5, 6, 7, None]
    rows = [(i if i is None or request.param == "long" else f"doc{i}", t) for i, t in zip(ids, texts)]
    rows += [rows[0], rows[3], (rows[-2][0], None), (None, ""), (rows[-2][0], texts[0] + " more")]
    more = [(*r, ["en", None][i % 2], ["a", "b", None][i % 3], len(r[1] or ""), *(f"{c}{i}" for c in PRIVATE)) for i, r in enumerate(rows)]
    return spark.createDataFrame(more, f"doc_id {request.param}, text string, lang string, source string, n_chars int, " + ", ".join(f"`{c}` string" for c in PRIVATE))


def test_every_stage_and_operator_takes_hostile_rows(spark, hostile):
    rows = {tuple(r[c] for c in PRIVATE): r for r in hostile.collect()}
    docs = hostile
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "/nowhere").cache()
        assert docs.columns == hostile.columns, name
        for r in docs.collect():  # each kept row has its own columns still
            was = rows[tuple(r[c] for c in PRIVATE)]
            assert (r["doc_id"], r["lang"], r["source"]) == (was["doc_id"], was["lang"], was["source"]), name
    assert docs.count() > 0
    assert corpus_pipeline.encode(spark, docs, "/nowhere").count() == docs.count()
    labels = hostile.select("doc_id", (F.length("text") % 2).alias("quality"), (F.length("text") % 2).alias("toxic"))
    n = hostile.count()
    for made in (
        mixing.plan(hostile.select("doc_id", "source", "text")), quality_rules.apply_rules(hostile), simhash.near_duplicates(hostile), toxicity.score(hostile, labels), digest_operator.with_edits(hostile), secrets.scan(hostile),
        substring_dedup.report(hostile, whole_lines=True), substring_dedup.remove_spans(hostile, whole_lines=True), cotraining.score(hostile, labels), line_dedup.report(hostile), line_dedup.remove_lines(hostile),
    ):
        assert made.count() == n
    for removed in (line_dedup.remove_lines(hostile), substring_dedup.remove_spans(hostile)):
        left = {tuple(r[c] for c in PRIVATE): r["text"] for r in removed.collect()}
        assert all((was["text"] is None) == (left[k] is None) for k, was in rows.items())
        assert sum(1 for t in left.values() if t and "w1x5 " in t) == 1  # what no other text holds stays, whatever else shares its id


def test_registered():
    assert len(corpus_pipeline.STAGES) == 5
    assert sorted(registry.QUERIES) == sorted(["pipeline", *(n for n in registry.QUERIES if n.startswith("op"))]) and len(registry.QUERIES) == 14
