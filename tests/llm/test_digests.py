import hashlib

import pytest
import xxhash

from canasta.llm import digests


def text_order(text):
    h = xxhash.xxh64_intdigest((text or "").encode(), 42)
    return h - 2**64 if h >> 63 else h


def brute(rows):
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or type(r[0] or 0)(), text_order(r[1])))
    out = []
    for (key, text), (_, after) in zip(ordered, ordered[1:] + ordered[:1]):
        text, after = text or "", after or ""
        k = len(text) // 4
        edited = text[: len(text) - k] + after[:k]
        own, changed, other = (digests.digest(t.encode()) for t in (text, edited, after))
        out.append((key if key is not None else -1, len(text), hashlib.sha256(edited.encode()).hexdigest(), own, changed, digests.likeness(own, changed), digests.likeness(own, other)))
    return sorted(out)


def found(docs):
    names = ("n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
    return sorted((r["doc_id"] if r["doc_id"] is not None else -1, *(r[x] for x in names)) for r in digests.with_edits(docs).collect())


def test_against_brute_force(documents, odd):
    for docs in (documents, odd):
        assert found(docs) == brute([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_single_document_and_empty_table(documents, empty):
    assert found(documents.limit(1)) == brute([(r["doc_id"], r["text"]) for r in documents.limit(1).collect()])
    assert digests.with_edits(empty).count() == 0


def test_ids_that_are_strings_null_or_shared(spark, documents, monkeypatch):
    monkeypatch.setattr(digests, "RANGE_ROWS", 3)
    named = documents.selectExpr("case when doc_id % 7 = 0 then null when doc_id % 5 = 0 then 'shared' else concat('doc', doc_id) end as doc_id", "text").limit(80).cache()
    rows = [(r["doc_id"], r["text"]) for r in named.collect()]
    got = sorted(((r["doc_id"] or "", r["n_chars"], r["edited_sha256"], r["near_next"]) for r in digests.with_edits(named).collect()), key=str)
    assert got == sorted((((k if k != -1 else ""), n, sha, after) for k, n, sha, _, _, _, after in brute_any(rows)), key=str)
    with pytest.raises(ValueError):
        digests.with_edits(documents.selectExpr("cast(doc_id as double) as doc_id", "text"))


def brute_any(rows):
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", text_order(r[1])))
    for (key, text), (_, after) in zip(ordered, ordered[1:] + ordered[:1]):
        k = len(text) // 4
        edited = text[: len(text) - k] + after[:k]
        own, changed, other = (digests.digest(t.encode()) for t in (text, edited, after))
        yield (key if key is not None else -1, len(text), hashlib.sha256(edited.encode()).hexdigest(), own, changed, digests.likeness(own, changed), digests.likeness(own, other))


def plain_digest(data):
    """The digest byte by byte, without numpy."""
    buckets = [0] * 256
    for at in range(len(data) - 4):
        for salt, (i, j, k) in enumerate(((0, 1, 2), (0, 1, 3), (0, 2, 4), (0, 3, 4))):
            h = data[at + i] * 0x9E3779B1 + data[at + j] * 0x85EBCA6B + data[at + k] * 0xC2B2AE35 + 0x27D4EB2F * (salt + 1) & 0xFFFFFFFF
            h ^= h >> 15
            buckets[(h * 0x2C1B3C6D & 0xFFFFFFFF) >> 24] += 1
    q1, q2, q3 = (sorted(buckets)[k] for k in (63, 127, 191))
    quartile = ["00" if n <= q1 else "01" if n <= q2 else "10" if n <= q3 else "11" for n in buckets]
    bits = len(data).bit_length()
    size = min(255, 8 * bits + (len(data) * 8 // 2 ** max(0, bits - 1)) % 8)
    return f"{size:02x}" + f"{int(''.join(quartile), 2):0128x}"


def test_digest_and_likeness_against_plain_versions(texts):
    short = [t[:700].encode() for t in texts.values() if t][:60] + [b"", b"abc", b"abcde", "naïve 日本".encode()]
    marks = [digests.digest(t) for t in short]
    assert marks == [plain_digest(t) for t in short]
    for a, b in zip(marks, marks[1:]):
        steps = sum(abs(int(x, 4) - int(y, 4)) for x, y in zip(fours(a), fours(b))) + max(0, abs(int(a[:2], 16) - int(b[:2], 16)) - 1)
        assert digests.likeness(a, b) == max(0.0, 1 - steps / digests.UNRELATED) == digests.likeness(b, a)


def fours(mark):
    return "".join(f"{int(c, 16) // 4}{int(c, 16) % 4}" for c in mark[2:])


def test_edits_stay_nearer_than_neighbours(documents):
    rows = [r for r in digests.with_edits(documents).collect() if r["n_chars"] > 200]
    assert sum(r["near_edited"] > r["near_next"] or r["near_next"] == 1 for r in rows) >= 0.97 * len(rows)


@pytest.mark.parametrize("text", ["", "a", "abcd", "abcde", "x" * 600_000])
def test_counts_in_blocks(text, monkeypatch):
    data = text.encode()
    whole = digests.counts(data)
    monkeypatch.setattr(digests, "BLOCK", 1000)
    assert (digests.counts(data) == whole).all()
    assert whole.sum() == max(0, len(data) - 4) * len(digests.TRIPLETS)
    assert digests.likeness(digests.digest(data), digests.digest(data)) == 1
