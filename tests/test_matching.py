"""Components, groups of automatic matches and the store of decisions."""

import itertools
import random

import pytest

from canasta.operators import decisions as D
from canasta.operators import matching as M
from canasta.operators.components import components


def greedy(rows):
    """Complete-link merging over all pairs (a, b, retailer_a, retailer_b, score): groups of two and more."""
    shop, auto = {}, set()
    for a, b, x, y, _ in rows:
        shop |= {a: x, b: y}
        auto |= {(a, b), (b, a)}
    groups = {n: {n} for n in shop}
    for a, b, *_ in sorted(rows, key=lambda r: (-r[4], r[0], r[1])):
        one, two = groups[a], groups[b]
        if one is not two and all((x, y) in auto and shop[x] != shop[y] for x in one for y in two):
            one |= two
            for x in two:
                groups[x] = one
    return sorted({tuple(sorted(g)) for g in groups.values() if len(g) > 1})


def groups_of(df):
    found = {}
    for r in df.collect():
        found.setdefault((r["group"]), []).append(r["member"])
    assert all(g == min(m) for g, m in found.items())
    return sorted(tuple(sorted(m)) for m in found.values())


def in_components(edges):
    label = {x: x for e in edges for x in e if None not in e}
    while True:
        before = dict(label)
        for a, b in edges:
            if None not in (a, b):
                label[a] = label[b] = min(label[a], label[b])
        if label == before:
            return sorted(label.items())


random.seed(5)
LINKS = {
    "chain": [(i, i + 1) for i in range(40)],
    "backward chain": [(i + 1, i) for i in random.sample(range(60), 60)],
    "hub": [(500, i) for i in range(50)],
    "alone and null": [(1, 1), (2, 3), (None, 4), (5, None), (3, 2), (2, 3)],
    "empty": [],
    "any": [(random.randrange(80), random.randrange(80)) for _ in range(60)],
}


@pytest.mark.parametrize("name", LINKS)
def test_components(spark, name):
    df = spark.createDataFrame(LINKS[name], "a long, b long")
    assert sorted(map(tuple, components(df).collect())) == in_components(LINKS[name])


def pairs_of(nodes, linked, scores):
    return [(a, b, nodes[a], nodes[b], scores(a, b)) for a, b in itertools.combinations(sorted(nodes), 2) if nodes[a] != nodes[b] and linked(a, b)]


PAIRS = {
    "chain": pairs_of({i: i % 4 for i in range(30)}, lambda a, b: b == a + 1, lambda a, b: 9000 + (a * 7) % 10),
    "hub": pairs_of({i: 0 if i == 0 else i % 3 + 1 for i in range(30)}, lambda a, b: a == 0, lambda a, b: 9000 + b % 5),
    "near cliques": pairs_of({i: i % 4 for i in range(24)}, lambda a, b: a // 8 == b // 8 and (a + b) % 5, lambda a, b: 9000 + (a * b) % 3),
}


@pytest.mark.parametrize("name", PAIRS)
def test_complete_link_by_component(spark, name):
    df = spark.createDataFrame(PAIRS[name], "a long, b long, retailer_a int, retailer_b int, score int")
    assert groups_of(M.complete_link_groups(df)) == greedy(PAIRS[name])


def test_equal_evidence_needs_no_pairs(spark):
    rows = [(i, random.randrange(4), random.choice("xyz")) for i in range(60)] + [(99, 1, None), (98, 2, None)]
    told = {i: (r, e) for i, r, e in rows}
    pairs = [(a, b, told[a][0], told[b][0], 10000) for a, b in itertools.combinations(sorted(told), 2) if told[a][1] and told[a][1] == told[b][1] and told[a][0] != told[b][0]]
    df = spark.createDataFrame(rows, "id long, retailer int, e string")
    assert groups_of(M.evidence_groups(df, ["e"])) == greedy(pairs)


CURRENT = "id long, retailer int, brand string, name string, size long, type string, count int, issue boolean, waiting boolean"


def listings(spark, rows):
    """(id, retailer, count, issue, waiting) of one brand and size; the name is the tens of the id."""
    df = spark.createDataFrame([(i, r, "B", f"n{i // 10}", 1, "T", c, issue, waiting) for i, r, c, issue, waiting in rows], CURRENT)
    return df.withColumn("fingerprint", D.fingerprint("name", "count", "issue"))


def decided(store):
    return {r["id"]: (r["was_product"], r["product"], r["state"]) for r in store.collect()}


def test_generations_of_decisions(spark):
    first = D.match_changed(listings(spark, [(10, 0, 1, False, False), (11, 1, 1, False, False), (20, 0, 2, False, False), (21, 1, 2, False, False), (22, 2, 2, True, False), (30, 0, 3, False, False)]), D.empty_store(spark), 1)
    assert decided(first) == {10: (None, "1-10", "created"), 11: (None, "1-10", "created"), 20: (None, "1-20", "created"), 21: (None, "1-20", "created"), 22: (None, None, "checkpointed"), 30: (None, None, "unmatched")}
    same = listings(spark, [(10, 0, 1, False, False), (11, 1, 1, False, False), (20, 0, 2, False, False), (21, 1, 2, False, False), (22, 2, 2, True, False), (30, 0, 3, False, False)])
    again = D.match_changed(same, first, 2)
    assert {s for _, _, s in decided(again).values()} == {"carried"} and {k: v[1] for k, v in decided(again).items()} == {k: v[1] for k, v in decided(first).items()}
    # 12 joins the first product, which stays; 21 leaves the second for another count, where nothing is
    more = [(10, 0, 1, False, False), (11, 1, 1, False, False), (12, 2, 1, False, False), (20, 0, 2, False, False), (21, 1, 5, False, False), (22, 2, 2, True, False), (30, 0, 3, False, False)]
    second = decided(D.match_changed(listings(spark, more), again, 3))
    assert second == {
        10: ("1-10", "1-10", "kept"), 11: ("1-10", "1-10", "kept"), 12: (None, "1-10", "created"), 20: ("1-20", None, "removed"), 21: ("1-20", None, "removed"),
        22: (None, None, "unmatched"), 30: (None, None, "carried")}
    # the same, but a member of the unit is not normalised: all of it waits, the other unit is decided
    wait = [(i, r, c, issue, i == 20) for i, r, c, issue, _ in more]
    held = decided(D.match_changed(listings(spark, wait), again, 3))
    assert held[12] == (None, "1-10", "created") and {held[i][2] for i in (20, 21, 22)} == {"deferred"} and held[20][1] == held[21][1] == "1-20"


def test_another_version_decides_anew(spark):
    rows = listings(spark, [(10, 0, 1, False, False), (11, 1, 1, False, False)])
    first = D.match_changed(rows, D.empty_store(spark), 1)
    assert {v[2] for v in decided(D.match_changed(rows, first, 2, version=2)).values()} == {"kept"}


VERDICTS = [
    # old products by listing, new groups by listing, verdict of each new group
    ({1: "p", 2: "p"}, {1: 1, 2: 1}, {1: "kept"}),
    ({1: "p"}, {1: 1, 2: 1}, {1: "one_anchor"}),
    ({}, {1: 1, 2: 1}, {1: "new"}),
    ({1: "p", 2: "p", 3: "q"}, {1: 1, 2: 1, 3: 1}, {1: "several_predecessors"}),
    ({1: "p", 2: "p", 3: "p", 4: "p"}, {1: 1, 2: 1, 3: 3, 4: 3}, {1: "split", 3: "split"}),
    ({1: "other", 2: "other"}, {1: 1, 2: 1}, {1: "identity_changed"}),
]


@pytest.mark.parametrize("old, new, want", VERDICTS)
def test_identity_continuity(spark, old, new, want):
    store = spark.createDataFrame([(i, p, "J" if p == "other" else "I") for i, p in old.items()], "id long, product string, identity string")
    groups = spark.createDataFrame([(g, i, "I") for i, g in new.items()], "group long, member long, identity string")
    assert {r["group"]: r["verdict"] for r in D.identity_continuity(groups, store).collect()} == want


@pytest.fixture(scope="module")
def odd_listings(tmp_path_factory):
    """Tables with missing evidence, names without words and 160 products of one kind; DuckDB over them."""
    import duckdb

    rng, folder, con = random.Random(11), tmp_path_factory.mktemp("odd"), duckdb.connect()
    parts = [(i, rng.choice(["red ring", "blue ring", "RED ring", "red  rings", "--", "", None]), rng.choice(["B1", "B2", None]), rng.choice(["X", "Y", None]), rng.choice([1, 2, None])) for i in range(200)]
    parts += [(i, "red ring", "B1", "X", 1) for i in range(200, 360)]
    lines = [(i, p, s) for i, (p, s) in enumerate((p[0], s) for p in parts for s in rng.sample(range(8), rng.randrange(1, 5)))] + [(9001, 210, None), (9002, None, 1)]
    con.execute("CREATE TABLE p (p_partkey BIGINT, p_name VARCHAR, p_brand VARCHAR, p_type VARCHAR, p_size INTEGER)")
    con.executemany("INSERT INTO p VALUES (?, ?, ?, ?, ?)", parts)
    con.execute("CREATE TABLE l (l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT)")
    con.executemany("INSERT INTO l VALUES (?, ?, ?)", lines)
    con.execute(f"COPY (SELECT *, 1.5::DOUBLE AS p_retailprice FROM p) TO '{folder}/part.parquet'")
    con.execute(f"COPY (SELECT *, 1 AS l_linenumber, 2.0::DOUBLE AS l_quantity, 3.0::DOUBLE AS l_extendedprice, 'N' AS l_returnflag, TIMESTAMP '2000-01-01' + to_days(l_orderkey::INTEGER) AS l_shipdate FROM l) TO '{folder}/lineitem.parquet'")
    for t in ("part", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con, str(folder)


@pytest.mark.parametrize("name", ["mat04_score", "mat05_decision", "mat08_pair_evaluation", "mat13_evaluation_metrics", "mat14_match_summary"])
def test_pairs_of_odd_listings_match_the_sql(spark, odd_listings, name):
    from canasta import plans

    con, folder = odd_listings
    df, want = plans.QUERIES[name](spark, folder), con.execute(plans.ORACLE[name])
    columns = [c[0] for c in want.description]
    want, got = want.fetchall(), [tuple(r) for r in df.select(*columns).collect()]
    assert len(got) == len(set(got)) and sorted(got, key=repr) == sorted(want, key=repr)


def test_scores_are_made_by_kind(spark, odd_listings):
    """Rows that are scored grow with the square of a block's kinds, not of its listings; counting pairs joins none."""
    from canasta.plans import QUERIES, matching

    _, folder = odd_listings
    assert matching.decided(spark, folder).count() * 20 < QUERIES["mat04_score"](spark, folder).count()
    assert "Join" not in QUERIES["mat13_evaluation_metrics"](spark, folder)._jdf.queryExecution().optimizedPlan().toString().split("Window")[0]
