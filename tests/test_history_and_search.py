"""The sweep over price states and covered periods, streaks, and the inverted index, against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from canasta.functions import text as T
from canasta.operators import history as H
from canasta.operators import inverted_index as I


def plain_segments(states, periods, start, end):
    """(segment start, from, until, price) of one listing, by all pairs of periods and states."""
    out = []
    for first, last in sorted(periods):
        path, before = [], None
        paths = [path]
        for price, a, b, is_open in sorted(states, key=lambda s: s[1]):
            lo, hi = max(first, a, start), min(last, b, end)
            if lo > hi or (lo == hi and not is_open):
                continue
            if before is not None and before != lo:
                path = []
                paths.append(path)
            path.append((lo, hi, price))
            before = hi
        out += [(p[0][0], *step) for p in paths if p and p[0][0] < p[-1][1] for step in p]
    return sorted(out)


def history(rng):
    """States with gaps and covered periods of a listing; the last state is open up to the last observation."""
    at, states = rng.randrange(5), []
    for _ in range(rng.randrange(1, 7)):
        until = at + rng.randrange(1, 9)
        states.append((rng.randrange(3), at, until, False))
        at = until + (rng.randrange(1, 4) if rng.random() < 0.3 else 0)
    seen = at + rng.randrange(0, 5)
    states.append((rng.randrange(3), at, seen, True))
    marks = sorted(rng.sample(range(seen + 1), min(seen + 1, 2 * rng.randrange(1, 4)) // 2 * 2))
    periods = list(zip(marks[::2], marks[1::2]))
    if rng.random() < 0.5 and (not periods or periods[-1][1] < seen):
        periods.append((seen, seen))
    return states, periods


@pytest.mark.parametrize("start, end", [(0, 99), (7, 15)])
def test_segments_against_all_pairs(spark, start, end):
    rng = random.Random(8)
    made = {i: history(rng) for i in range(150)}
    states = spark.createDataFrame([(i, *s) for i, (ss, _) in made.items() for s in ss], "listing long, price long, from long, until long, open boolean")
    periods = spark.createDataFrame([(i, *p) for i, (_, ps) in made.items() for p in ps], "listing long, first long, last long")
    inside = states.where((F.col("from") <= end) & ((F.col("until") > start) | (F.col("open") & (F.col("until") >= start))))
    got = {}
    for r in H.step_segments(inside, periods.where((F.col("last") >= start) & (F.col("first") <= end)), F.lit(start).cast("long"), F.lit(end).cast("long")).collect():
        got.setdefault(r["listing"], []).append((r["segment_from"], r["from"], r["until"], r["price"]))
    want = {i: w for i, (ss, ps) in made.items() if (w := plain_segments([s for s in ss if s[1] <= end and (s[2] > start or s[3] and s[2] >= start)], ps, start, end))}
    assert {i: sorted(g) for i, g in got.items()} == want and len(want) > 50


def test_points_and_streaks(spark):
    states = spark.createDataFrame([(1, 5, 0, 4, False), (1, 6, 4, 9, True), (2, 7, 3, 3, True)], "listing long, price long, from long, until long, open boolean")
    got = sorted((r["listing"], r["at"], r["price"], r["kind"]) for r in H.points(states, F.lit(1), F.lit(20)).collect())
    assert got == [(1, 4, 6, "state-start"), (1, 9, 6, "latest-observation"), (2, 3, 7, "state-start")]
    days = spark.createDataFrame([(1, 0, True), (1, 1, True), (1, 3, True), (2, 0, True), (3, 1, True), (4, 0, False), (4, 1, True)], "listing long, back int, kept boolean")
    assert {r["listing"]: r["streak"] for r in H.unchanged_days(days).collect()} == {1: 2, 2: None}


def test_index_finds_what_the_predicate_does(spark):
    rng = random.Random(2)
    syllables = ["le", "che", "ar", "roz", "5", "50", "a", "ñ", "glo", "ria"]
    word = lambda: "".join(rng.sample(syllables, rng.randrange(1, 4)))
    texts = spark.createDataFrame([(" ".join(word() for _ in range(rng.randrange(0, 6))),) for _ in range(200)], "text string").distinct().withColumn("words", T.tokens(F.col("text")))
    queries = spark.createDataFrame([(" ".join(word()[: rng.randrange(1, 5)] for _ in range(rng.randrange(0, 4))),) for _ in range(80)] + [("5",), ("zzz",), ("",), ("le le",)], "query string").distinct().withColumn("tokens", T.tokens(F.col("query")))
    got = sorted((r["query"], r["text"]) for r in I.search(queries, texts).collect())
    held, wanted = [tuple(r) for r in texts.collect()], [tuple(r) for r in queries.collect()]
    fits = lambda t, w: w == t if t.isdigit() else w.startswith(t)
    assert got == sorted((q, x) for q, ts in wanted if ts for x, ws in held if all(any(fits(t, w) for w in ws) for t in ts)) and len(got) > 100


def test_index_has_no_nested_loop(spark):
    texts = spark.createDataFrame([("a b", ["a", "b"])], "text string, words array<string>")
    queries = spark.createDataFrame([("a", ["a"])], "query string, tokens array<string>")
    plan = I.search(queries, texts)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_searches_with_controls_and_odd_spaces_are_judged_as_the_sql_does(spark, tmp_path):
    import duckdb

    from canasta import plans

    texts = ["one.\ntwo x", "a\tb", "ab\x0bcd ef", "ab cd\x0bef", " a   b ", "abc\x01 d\x7f", "a   3", "ab   　c", "a " + "b" * 78, "a " + "b" * 79, ". ½٣Ⅷ", "alone", "", None]
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (text VARCHAR, role VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, 'user')", [(t,) for t in texts])
    con.execute(f"COPY conversations TO '{tmp_path}/conversations.parquet'")
    want = con.execute(plans.ORACLE["str06_valid_demand"]).fetchall()
    got = [tuple(r) for r in plans.QUERIES["str06_valid_demand"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and ("one.\ntwo", True) in got
    assert not spark.sql("select 'one.\ntwo' as q").select(T.valid_demand(F.col("q"))).first()[0]
