import re
import string
from collections import defaultdict

from canasta.llm import line_dedup, registry, substring_dedup

PUNCT = line_dedup.PUNCTUATION


def line_sets(rows):
    out = []
    for key, text in rows:
        for n, line in enumerate((text or "").split("\n")):
            words = frozenset(w for w in (x.decode().lower().strip(PUNCT) for x in line.encode().split()) if w)
            if len(words) >= 1:
                out.append(((key is not None, key or 0), n, words))
    return sorted(out, key=lambda x: x[:2])


def brute_lines(rows):
    gone, seen = defaultdict(set), []
    for key, n, words in line_sets(rows):
        if any((key, n) != s[:2] and 5 * len(words & s[2]) >= 4 * len(words | s[2]) for s in seen):
            gone[key].add(n)
        seen.append((key, n, words))
    return {(k[1] if k[0] else None): sorted(v) for k, v in gone.items()}


def removed(docs):
    return {r["doc_id"]: [int(x) for x in r["removed"].split(",") if x] for r in line_dedup.report(docs).collect() if r["n_removed"]}


def test_lines_against_brute_force(documents, texts):
    assert removed(documents) == brute_lines(texts.items())


def variants(spark):
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
    rows = [(i, " ".join(base[:k] + [f"w{i}"] + base[k + 1 :])) for i, k in ((i, i % 20) for i in range(90))]
    rows += [(100 + i, " ".join([f"v{i % 7}", f"u{i % 5}", *base[: 12 + i % 8], f"t{i % 3}"])) for i in range(60)]
    rows += [(200, "the of and to in"), (201, "the of and to in a"), (202, "to in the of and"), (203, "the of and to")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string")


def test_dense_groups_in_cells_and_blocks(spark, monkeypatch):
    rows, docs = variants(spark)
    want = brute_lines(rows)
    assert removed(docs) == want
    monkeypatch.setattr(line_dedup, "CELL", 20)
    assert removed(docs) == want
    for bound, value in (("ROWS_AT_ONCE", 5), ("PAIRS_AT_ONCE", 7), ("BLOCK_ROWS", 9), ("EMIT", 3), ("BLOCK_BYTES", 300)):
        monkeypatch.setattr(line_dedup, bound, value)
    assert removed(docs) == want


def test_every_candidate_is_tried_where_the_likeliest_fails(spark):
    # parity signatures tell sets apart by words that differ an odd number of times in a bit: some lines of 0.79 look nearer than those of 0.8
    base = [f"b{i}" for i in range(45)]
    rows = [(i, " ".join([*base[: 45 - i % 7], *(f"x{i}y{k}" for k in range(i % 7))])) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert removed(docs) == brute_lines(rows)


def test_rows_that_share_an_id_and_ids_of_other_types(spark):
    said = "second line that nothing else ever matches today"
    rows = [(1, "a first line of seven plain words here\nother things entirely follow on this line"), (2, "a first line of seven plain words here\nmore"), (2, f"unlike\n{said}"), (2, f"unlike\n{said}"), (None, "x y z w"), (None, "x y z w v")]
    out = line_dedup.remove_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    left = sorted(((r["doc_id"] or -1, r["text"]) for r in out.collect()), key=str)
    assert sum(said in t for _, t in left) == 2 and len(left) == 6
    assert (2, "more") in left and sorted(t for i, t in left if i == -1).count("") == 1
    for kind in ("string", "double", "date"):
        value = {"string": "concat('doc number ', lpad(cast(doc_id as string), 4, '0'))", "double": "cast(doc_id as double)", "date": "date_add(date'2024-01-01', cast(doc_id as int))"}[kind]
        _, docs = variants(spark)
        want = {str(r[0]): r[1] for r in docs.selectExpr("doc_id", f"cast({value} as string)").collect()}
        got = {r["doc_id"]: r["removed"] for r in line_dedup.report(docs.selectExpr(f"{value} as doc_id", "text")).collect()}
        assert {str(k): v for k, v in got.items()} == {want[str(r["doc_id"])]: r["removed"] for r in line_dedup.report(docs).collect()}


def test_extra_columns_of_any_name_pass(spark):
    names = ["_doc", "_d", "_row", "_text", "_lines", "_id", "_key", "d", "lines", "line", "id"]
    docs = spark.createDataFrame([(1, "one two three four\none two three four", 40, *names)], f"doc_id long, text string, n_chars int, {', '.join(f'{n} string' for n in names)}")
    out = line_dedup.remove_lines(docs).first()
    assert out.asDict() == {"doc_id": 1, "text": "one two three four", "n_chars": 18} | {n: n for n in names}


def test_lines_of_few_different_words_go(spark):
    rows = [(1, "All rights reserved.\nMenu\n...\n\nno no yes " + "no yes " * 50), (2, "reserved all rights\nmenu!\n...\n\nyes no"), (3, "All rights\nMenus\nword of four here"), (4, "word of four here now\nword of four there"), (None, "Menu")]
    assert removed(spark.createDataFrame(rows, "doc_id long, text string")) == {1: [1], 2: [0, 1, 4], 4: [0]} == brute_all(rows)


def brute_all(rows):
    gone, seen = defaultdict(list), []
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        for n, line in enumerate(text.split("\n")):
            words = {w for w in (x.lower().strip(PUNCT) for x in line.split()) if w}
            if words and any(5 * len(words & s) >= 4 * len(words | s) for s in seen):
                gone[key].append(n)
            seen.append(words)
    return dict(gone)


def test_removed_lines_leave_the_text(spark, documents, texts):
    gone = brute_lines(texts.items())
    out = line_dedup.remove_lines(documents)
    assert out.columns == documents.columns
    for r in out.collect():
        kept = [x for i, x in enumerate(texts[r["doc_id"]].split("\n")) if i not in gone.get(r["doc_id"], ())]
        assert r["text"] == "\n".join(kept) and r["n_chars"] == len(r["text"])


def test_odd_lines(odd, empty):
    rows = line_dedup.report(odd).collect()
    assert len(rows) == odd.count()
    assert {r["doc_id"]: r["removed"] for r in rows}[13] == "1"
    assert line_dedup.report(empty).count() == 0
    assert line_dedup.remove_lines(odd).columns == odd.columns


def plain_words(text):
    """Words as plain Python finds them: (word without punctuation, start, end)."""
    out = []
    for m in re.finditer(r"[^ \t\n\r\x0b\x0c]+", text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in m.group(0))
        if word := "".join(c for c in low if c not in string.punctuation):
            out.append((word, *m.span()))
    return out


def brute_units(rows, run_words=substring_dedup.RUN_WORDS):
    """Repeated units removed after their first place; where units begin is taken from the module, what they hold is compared as words."""
    first, every = {}, defaultdict(list)
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        words = plain_words(text or "")
        at = {a: i for i, (_, a, _) in enumerate(words)}
        upto = {b: i + 1 for i, (_, _, b) in enumerate(words)}
        for k, a, b, _ in substring_dedup.units_of(text or ""):
            held = tuple(w for w, _, _ in words[at[a] : upto[b]])
            assert len(held) >= run_words
            every[key].append((a, b, held, k))
            first.setdefault(held, (key, k))
    out = {}
    for key, units in every.items():
        runs, last = [], None
        for a, b, held, k in units:
            if first[held] != (key, k):
                if last == k - 1:
                    runs[-1] = (runs[-1][0], b)
                else:
                    runs.append((a, b))
                last = k
        if runs:
            out[key] = runs
    return out


def test_texts_in_a_block_do_not_touch(texts):
    every = [t or "" for t in texts.values()] + ["", "a", "\n", "x y\nz", "…", "🙂 é\n\nÀ b"]
    together = substring_dedup.Words(every)
    for one, found in ((substring_dedup.units_of, together.units(substring_dedup.RUN_WORDS)), (substring_dedup.lines_of, together.lines())):
        got = defaultdict(list)
        for text, *rest in zip(*(c.tolist() for c in found)):
            got[text].append((*rest[:3], tuple(rest[3:])))
        assert all(got[i] == one(t) for i, t in enumerate(every))


def test_lines_are_those_of_plain_python(texts):
    for text in [t or "" for t in texts.values()][:80]:
        at, want = 0, []
        for k, line in enumerate(text.split("\n")):
            if words := tuple(w for w, _, _ in plain_words(line)):
                want.append((k, at + len(line) - len(line.lstrip(" \t\r\x0b\x0c")), at + len(line.rstrip(" \t\r\x0b\x0c")), words))
            at += len(line) + 1
        got = substring_dedup.lines_of(text)
        assert [x[:3] for x in got] == [x[:3] for x in want]
        assert len({x[3] for x in got}) == len({x[3] for x in want})


def spans(docs):
    return {r["doc_id"]: [tuple(map(int, s.split(":"))) for s in r["spans"].split(",")] for r in substring_dedup.report(docs).collect() if r["spans"]}


def test_units_against_brute_force(documents, texts):
    want = brute_units(texts.items())
    assert want and spans(documents) == want
    for r in substring_dedup.remove_spans(documents).collect():
        text, at = texts[r["doc_id"]], 0
        kept = ""
        for a, b in want.get(r["doc_id"], ()):
            kept, at = kept + text[at:a], b
        assert r["text"] == kept + text[at:]


def test_passage_within_lines_is_found(spark):
    passage = " ".join(f"Sentence number {i} has some words in it." for i in range(12))
    rows = [(1, f"Intro one. {passage} Outro one."), (2, f"Another start, {passage}\nand an end."), (3, "Short. Repeated. Short."), (4, "Short. Repeated."), (5, None), (6, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = spans(docs)
    assert set(got) == {2}
    a, b = got[2][0]
    assert b - a > 0.85 * len(passage)


def test_passage_of_51_words_amid_longer_sentences_is_found(spark):
    passage = " ".join(f"p{i * i % 97}x{i}" for i in range(51))
    rows = [(k, " ".join([*(f"a{k}b{i}" for i in range(k)), passage, *(f"c{k}d{i}" for i in range(40 - k))])) for k in range(1, 30)]
    rows.append((40, rows[0][1].split(" ", 1)[1].replace(" ", "\n", 30)))  # other lines
    got = spans(spark.createDataFrame(rows, "doc_id long, text string"))
    assert set(got) == {k for k, _ in rows[1:]}
    for k, text in rows[1:]:
        a, b = got[k][0]
        flat = text.replace("\n", " ")
        assert len(got[k]) == 1 and flat[a:b] in rows[0][1] and len(flat[a:b].split()) >= 20


def test_sentences_that_repeat_apart_stay(spark):
    said = [f"Sentence number {i} has some words in it." for i in range(12)]
    rows = [(i, f"{s} Then follow quite other words of document {i * 7919}.") for i, s in enumerate(said)] + [(99, " ".join(reversed(said)))]
    assert spans(spark.createDataFrame(rows, "doc_id long, text string")) == {}


def test_whole_lines_go_whatever_their_length(spark, documents, texts, tmp_path):
    passage = " ".join(f"p{i * i % 97}x{i}" for i in range(60))
    rows = [(1, f"All rights reserved.\nFirst text here.\n{passage}"), (2, f"Other text.\n  all rights reserved\n{passage} and more"), (3, "It says: All rights reserved.\n--\nSubscribe\nSubscribe!"), (4, "--")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in registry.QUERIES["op8_substring_dedup"](spark, str(tmp_path)).collect()}
    pieces = {k: [text[int(a) : int(b)] for a, _, b in (s.partition(":") for s in got[k]["spans"].split(",") if s)] for k, text in rows}
    assert pieces[1] == pieces[4] == [] and pieces[3] == ["Subscribe!"]
    assert pieces[2][0] == "all rights reserved" and len(pieces[2]) == 2 and pieces[2][1] in passage
    assert got[2]["removed_chars"] == sum(map(len, pieces[2]))
    left = {r["doc_id"]: r["text"] for r in substring_dedup.remove_spans(documents, whole_lines=True).collect()}
    seen = set()
    for key, text in sorted(texts.items()):
        own = {digest: text[a:b] for _, a, b, digest in substring_dedup.lines_of(text or "")}
        stay = [x.strip() for x in left[key].split("\n")]
        assert all(stay.count(line) <= (digest not in seen) for digest, line in own.items())
        seen |= set(own)


def test_odd_units(odd, empty):
    assert substring_dedup.report(odd).count() == odd.count()
    assert substring_dedup.report(empty).count() == 0
    assert substring_dedup.remove_spans(odd).columns == odd.columns
