import hashlib
import re

import duckdb
import pytest
from canasta.llm import fill_in_middle as fim
from canasta.llm import oracle, registry
from hypothesis import given, settings
from hypothesis import strategies as st

SF = "/root/testdata/sf0.001"
SPLIT = {"lines": r"[^\n]*\n|[^\n]+", "chars": r"(?s:.)", "words": r"^[ \t\n\r\x0b\x0c]+|[^ \t\n\r\x0b\x0c]+[ \t\n\r\x0b\x0c]*"}


def brute(doc_id, text, seed=7, rate=100, spm=50, unit="lines"):
    """n, form, prefix_chars, middle_chars, output of a text, by its whole list of units."""
    text = text or ""
    units = re.findall(SPLIT[unit], text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    return (len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < spm else (len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_query_against_brute_force_and_sql(spark, documents):
    got = sorted(tuple(r) for r in registry.op12_fill_in_middle(spark, SF).collect())
    assert got == sorted((r["doc_id"], *(w := brute(r["doc_id"], r["text"]))[:4], sha(w[4]), sha(r["text"] or "")) for r in documents.collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert got == sorted(con.execute(oracle.ORACLE["op12_fill_in_middle"]).fetchall())


@pytest.mark.parametrize("unit", fim.UNITS)
def test_odd_texts(spark, odd, empty, unit):
    marked = spark.createDataFrame([(50, "one <P> two\nthree", "w")] + [(51 + i, t, "w") for i, t in enumerate(("a<\nP>\n<", "<S", "\n", ">\n<\n>"))], "doc_id long, text string, n string")
    for docs in (odd, marked):
        got = fim.transform(docs, seed=3, rate=80, spm=30, unit=unit).collect()
        want = [(r["doc_id"], *brute(r["doc_id"], r["text"], 3, 80, 30, unit)) for r in docs.collect()]
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert fim.transform(empty, unit=unit).count() == 0
    assert fim.transform(odd.where("false"), digests=True).columns[-1] == "restored_sha256"


def test_unit_is_a_known_one(odd):
    with pytest.raises(ValueError):
        fim.transform(odd, unit="pages")


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab \n\té日🙂<PSM>", max_size=80), st.sampled_from(fim.UNITS), st.integers(1, 9), st.integers(0, 50))
def test_cuts_by_checkpoints(text, unit, every, seed):
    data, units = text.encode(), re.findall(SPLIT[unit], text)
    index = fim.indexed(data, unit, every)
    assert (index.units, index.chars, len(index.unit)) == (len(units), len(text), -(-len(units) // every))
    for k in range(len(units) + 1):
        before = "".join(units[:k])
        assert fim.cut_at(data, index, k, unit) == (len(before.encode()), len(before))
    piece = fim.transformed(data, 1, seed, 100, 50, unit, every)
    assert fim.restored(piece.output, piece.form) == data


def test_blocks_join_up(monkeypatch):
    text = "".join(f"line {i} é日\n" * (i % 3) + "x" * (i % 5) for i in range(400))
    whole = {u: fim.indexed(text.encode(), u) for u in fim.UNITS}
    monkeypatch.setattr(fim, "BLOCK", 13)
    assert {u: fim.indexed(text.encode(), u) for u in fim.UNITS} == whole


def test_a_very_long_text(spark):
    text = "été 日\n" * 500_000
    got = fim.transform(spark.createDataFrame([(1, text)], "doc_id long, text string"), digests=True).first()
    want = brute(1, text)
    assert tuple(got) == (1, *want[:4], sha(want[4]), sha(text))
