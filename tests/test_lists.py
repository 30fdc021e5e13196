"""Folds in order, lists by compare-and-set, and the import merge."""

import random

from canasta.operators import lists as L
from canasta.operators.folds import ordered_fold


def test_fold_streams_through_keys(spark, monkeypatch):
    from canasta.operators import folds

    monkeypatch.setattr(folds, "BATCH", 7)
    rows = [(random.Random(i).randrange(5), i, i % 3) for i in range(500)] + [(None, 1000, 1), (None, 1001, 2)]
    df = spark.createDataFrame(rows, "k long, at long, v long").repartition(7)
    got = ordered_fold(df, ["k"], ["at"], lambda: 0, lambda s, r: (s + r["v"], {"k": r["k"], "at": r["at"], "s": s + r["v"]} if r["v"] else None), "k long, at long, s long").collect()
    want, sums = [], {}
    for k, at, v in sorted(rows, key=lambda r: r[1]):
        sums[k] = sums.get(k, 0) + v
        if v:
            want.append((k, at, sums[k]))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_changes_by_expected_revision(monkeypatch):
    monkeypatch.setattr(L, "CAPACITY", 2)
    s = L.start()
    said = []
    for removes, item, expected in [(True, "a", 0), (False, "a", 0), (False, "b", 0), (False, "b", 1), (False, "c", 2), (False, "a", 2), (True, "z", 3), (True, "a", 3), (False, "c", 4), (True, "a", 3)]:
        s, status = L.change(s, removes, item, 1, expected)
        said.append((status, s["revision"]))
    assert said == [("unchanged", 0), ("saved", 1), ("conflict", 1), ("saved", 2), ("rejected", 2), ("saved", 3), ("unchanged", 3), ("removed", 4), ("saved", 5), ("conflict", 5)]


def test_devices_learn_from_conflicts(spark):
    ops = spark.createDataFrame([(1, t, d, r, i, 1) for t, d, r, i in [(1, 1, False, "a"), (2, 2, False, "b"), (3, 2, False, "b"), (4, 1, True, "a"), (5, 1, True, "a")]], "owner long, t long, device int, removes boolean, item string, amount long")
    got = [(r["t"], r["expected"], r["status"], r["revision"], r["items"]) for r in L.mutate(ops, ["t"]).orderBy("t").collect()]
    assert got == [(1, 0, "saved", 1, 1), (2, 0, "conflict", 1, 1), (3, 1, "saved", 2, 2), (4, 1, "conflict", 2, 2), (5, 2, "removed", 3, 1)]


def test_tied_operations_have_one_order(spark):
    """However the rows lie, removals come first, then device, item and amount decide."""
    rows = [(1, 1, 1, False, "a", 1), (1, 2, 1, False, "b", 2), (1, 2, 1, True, "a", 3), (1, 3, 2, False, "c", 4), (1, 3, 1, False, "d", 5), (1, 4, 2, True, "d", 6), (1, 4, 2, True, "c", 7)]
    want = [(1, 0, "saved", 1, 1), (2, 1, "removed", 2, 0), (2, 2, "saved", 3, 1), (3, 3, "saved", 4, 2), (3, 0, "conflict", 4, 2), (4, 4, "unchanged", 4, 2), (4, 4, "removed", 5, 1)]
    for turned in (rows, rows[::-1]):
        ops = spark.createDataFrame(turned, "owner long, t long, device int, removes boolean, item string, amount long").coalesce(1)
        got = [(r["t"], r["expected"], r["status"], r["revision"], r["items"]) for r in L.mutate(ops, ["t"]).collect()]
        assert sorted(got) == sorted(want)


def test_lines_tied_in_date_order_and_number_match_the_sql_on_dates_apart(spark, tmp_path):
    """The SQL's ORDER BY leaves such lines open: with their dates nudged apart by microseconds it has to give the query's rows, in either order of lines."""
    import duckdb

    from canasta import plans

    name, lines = "ing24_cas_list_mutation", [(day, ln, part, flag) for day, ln, ties in [(1, 1, [(1, "N")]), (2, 2, [(2, "N"), (1, "R")]), (3, 3, [(1, "N"), (3, "N")]), (4, 4, [(3, "R"), (4, "R")]), (5, 5, [(2, "N"), (2, "N")])] for part, flag in ties]
    con, got = duckdb.connect(), {}
    con.execute("CREATE TABLE orders AS SELECT 7::BIGINT AS o_orderkey, 9::BIGINT AS o_custkey, '2-HIGH' AS o_orderpriority")
    con.execute("CREATE TABLE part AS SELECT i AS p_partkey, 'Brand#' || i AS p_brand, 'T' AS p_type FROM range(1, 5) t(i)")
    con.execute("CREATE TABLE all_lines (day INTEGER, l_linenumber INTEGER, l_partkey BIGINT, l_returnflag VARCHAR)")
    con.executemany("INSERT INTO all_lines VALUES (?, ?, ?, ?)", lines)
    columns = "7::BIGINT AS l_orderkey, l_linenumber, l_partkey, l_returnflag, 1.0::DOUBLE AS l_quantity"
    for way in ("ASC", "DESC"):
        folder = tmp_path / way
        folder.mkdir()
        for table in ("orders", "part"):
            con.execute(f"COPY {table} TO '{folder}/{table}.parquet'")
        con.execute(f"COPY (SELECT {columns}, TIMESTAMP '2000-01-01' + to_days(day) AS l_shipdate FROM all_lines ORDER BY rowid {way}) TO '{folder}/lineitem.parquet'")
        got[way] = sorted(map(tuple, plans.QUERIES[name](spark, str(folder)).collect()))
    con.execute(f"CREATE VIEW lineitem AS SELECT {columns}, TIMESTAMP '2000-01-01' + to_days(day) + to_microseconds(row_number() OVER (PARTITION BY day ORDER BY l_returnflag DESC, l_partkey)) AS l_shipdate FROM all_lines")
    want = sorted(con.execute(plans.ORACLE[name]).fetchall())
    assert got["ASC"] == want and got["DESC"] == want


def plain_merge(remote, anonymous, capacity):
    held, out = dict(remote), {k: "remote" for k in remote}
    for item, at in anonymous:
        if item in held:
            out[item] = "unchanged" if held[item] >= at else "updated"
        elif len(held) < capacity:
            held[item] = at
            out[item] = "added"
        else:
            out[item] = "rejected"
    return out


def test_import_merge_against_a_plain_one(spark, monkeypatch):
    monkeypatch.setattr(L, "CAPACITY", 6)
    rng, remote, anonymous, want = random.Random(3), [], [], {}
    for owner in range(40):
        r = {f"i{k}": rng.randrange(10) for k in rng.sample(range(12), rng.randrange(7))}
        a = [(f"i{k}", rng.randrange(10)) for k in rng.sample(range(12), rng.randrange(9))]
        remote += [(owner, i, at) for i, at in r.items()]
        anonymous += [(owner, i, at, n) for n, (i, at) in enumerate(a)]
        want |= {(owner, i): o for i, o in plain_merge(r, a, 6).items()}
    plan = L.import_plan(spark.createDataFrame(remote, "owner long, item string, updated long"), spark.createDataFrame(anonymous, "owner long, item string, updated long, order long"))
    assert {(r["owner"], r["item"]): r["outcome"] for r in plan.collect()} == want and set(want.values()) == {"remote", "unchanged", "updated", "added", "rejected"}
