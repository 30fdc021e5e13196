import hashlib

import public_tokenizers
import sentencepiece

from canasta.llm import sentencepiece_codec as codec

PATH = public_tokenizers.path("piece_bpe_32k.model")


def library(text):
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    ids = sp.encode(text or "", add_bos=True, add_eos=True)
    return ids, sp.decode(ids)


def digests(ids, text):
    return len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest(), hashlib.sha256(text.encode()).hexdigest()


def test_as_the_library_encodes(documents, odd):
    for docs in (documents, odd):
        want = sorted((r["doc_id"] or -1, *digests(*library(r["text"]))) for r in docs.collect())
        got = sorted((r["doc_id"] or -1, r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in codec.codec_digests(docs).collect())
        assert got == want


def test_round_trip_through_ids(documents):
    ids = codec.encode(documents)
    back = {r["doc_id"]: r["text"] for r in codec.decode(ids).collect()}
    for r in documents.collect():
        assert back[r["doc_id"]] == library(r["text"])[1]


def test_table_is_cleared_when_full(monkeypatch):
    monkeypatch.setattr(codec, "TABLE_ENTRIES", 3)
    table = codec.ChunkTable(PATH)
    for text in ("one two three four five", "six seven eight", "one two"):
        assert table.encode([text])[0].tolist() == library(text)[0]


def test_empty_table(empty):
    assert codec.codec_digests(empty).count() == 0
