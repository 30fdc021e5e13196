"""SentencePiece encoding and decoding by a table of distinct chunks.

No piece of the vocabulary runs across the start of a white-space mark, so a
text splits into marked words (a run of marks and what follows it) that can be
segmented on their own. Each task turns the marked words of its documents into
a dictionary (distinct words, and one index for each position), segments only
words it has not met before with the sentencepiece library, and takes the ids
back by position. The table of a task is bounded by ``TABLE_ENTRIES`` words and
cleared beyond that; nothing is shuffled, broadcast or kept between tasks. (A
table for the whole corpus would need one shuffled row for each position or
for each task's distinct word: more disk than the documents themselves.)

Defined results: null and empty texts encode to the begin and end ids and
decode to the empty text; equal texts encode alike; an empty table gives an
empty result; clashing extra columns stay out of the encoder's input.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

MARK = "▁"
#: Distinct words that a task holds at once, and bytes of text that it takes up at once.
TABLE_ENTRIES = 200_000
BLOCK_BYTES = 1_000_000
#: Longer words are segmented each time, so that the table stays small.
LONGEST_KEPT = 200


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def splits_at_marks(processor) -> bool:
    """Whether no piece has a mark after another character, as this method needs."""
    pieces = (processor.id_to_piece(i) for i in range(processor.get_piece_size()))
    return not any(re.search(f"[^{MARK}]{MARK}", piece) for piece in pieces)


class ChunkTable:
    """The distinct marked words met by a task: word -> number, and ids by number."""

    def __init__(self, model_path: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        if not splits_at_marks(self.sp):
            raise ValueError(f"{model_path}: a piece runs across a white-space mark")
        self.mark_id = self.sp.piece_to_id(MARK)
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, np.ndarray] = {}

    def ids_of(self, chunks: list[str]) -> list[np.ndarray]:
        """The ids of distinct chunks; each starts with a mark, which the library itself puts first."""
        if len(self.known) > TABLE_ENTRIES:
            self.clear()
        new = [c for c in chunks if c not in self.known]
        found = {}
        for c, ids in zip(new, self.sp.encode([c[1:] for c in new], num_threads=1) if new else []):
            found[c] = np.asarray(ids if c != MARK else [self.mark_id], dtype="<u4")
        self.known.update((c, ids) for c, ids in found.items() if len(c) <= LONGEST_KEPT)
        return [found[c] if c in found else self.known[c] for c in chunks]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text with begin and end ids."""
        bos, eos = np.array([self.sp.bos_id()], "<u4"), np.array([self.sp.eos_id()], "<u4")
        marked = [(MARK + t).replace(" ", MARK) if t else "" for t in texts]
        # a cut before each run of marks: position by position, the marked words of the block
        parts = [CHUNK.findall(m) for m in marked]
        counts = np.fromiter(map(len, parts), np.int64, len(parts))
        column = pa.array([c for p in parts for c in p], pa.large_string()).dictionary_encode()
        table = self.ids_of(column.dictionary.to_pylist())
        sizes = np.fromiter(map(len, table), np.int64, len(table))
        starts = np.concatenate([[0], np.cumsum(sizes)])
        flat = np.concatenate(table) if table else np.empty(0, "<u4")
        at = column.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(sizes[at])])  # of each position's ids in the block
        take = np.arange(ends[-1]) + np.repeat(starts[at] - ends[:-1], sizes[at])
        ids = flat[take]
        bounds = ends[np.concatenate([[0], np.cumsum(counts)])]
        return [np.concatenate([bos, ids[a:b], eos]) for a, b in zip(bounds[:-1], bounds[1:])]

    def decode(self, ids: np.ndarray) -> str:
        return self.sp.decode(ids.tolist())


CHUNK = re.compile(f"{MARK}+[^{MARK}]*")


def blocks(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of the batches with their texts, each slice of bounded size (or of one text)."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        block = np.cumsum(lengths, dtype=np.int64) // BLOCK_BYTES
        edges = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows] if batch.num_rows else [0]
        for a, b in zip(edges[:-1], edges[1:]):
            part = batch.slice(a, b - a)
            yield part, [t or "" for t in part.column(column).to_pylist()]


def _mapped(df: DataFrame, column: str, carry: list[str], added: list[T.StructField], make: Callable) -> DataFrame:
    """df's carried columns, and what make(ChunkTable, values) returns for each block of a column."""
    schema = T.StructType([df.schema[c] for c in carry] + added)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = make()
        for part, texts in blocks(batches, column):
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carry), *run(texts)], names=schema.names)

    return df.select(*dict.fromkeys([*carry, column])).mapInArrow(work, schema)


def encode(df: DataFrame, text: str = "text", carry: tuple[str, ...] = ("doc_id",), model_path: str | None = None) -> DataFrame:
    """carry columns and ``ids`` (array<int>): the ids of each text, begin and end ids included."""
    model_path = model_path or default_model()

    def make():
        table = ChunkTable(model_path)
        return lambda texts: [pa.array([x.astype(np.int32) for x in table.encode(texts)], pa.list_(pa.int32()))]

    return _mapped(df, text, list(carry), [T.StructField("ids", T.ArrayType(T.IntegerType()))], make)


def decode(df: DataFrame, ids: str = "ids", carry: tuple[str, ...] = ("doc_id",), model_path: str | None = None) -> DataFrame:
    """carry columns and ``text``: what the library decodes the ids to (null: the empty text)."""
    model_path = model_path or default_model()
    schema = T.StructType([df.schema[c] for c in carry] + [T.StructField("text", T.StringType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                texts = [sp.decode(x or []) for x in part.column(ids).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carry), pa.array(texts, pa.string())], names=schema.names)

    return df.select(*dict.fromkeys([*carry, ids])).mapInArrow(work, schema)


def codec_digests(df: DataFrame, text: str = "text", carry: tuple[str, ...] = ("doc_id",), model_path: str | None = None) -> DataFrame:
    """carry columns, n_tokens, ids_sha256 (ids as little-endian 32-bit) and decoded_sha256, in one pass."""
    model_path = model_path or default_model()

    def make():
        table = ChunkTable(model_path)

        def run(texts: list[str]) -> list[pa.Array]:
            ids = table.encode(texts)
            return [
                pa.array([len(x) for x in ids], pa.int64()),
                pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in ids], pa.string()),
                pa.array([hashlib.sha256(table.decode(x).encode()).hexdigest() for x in ids], pa.string()),
            ]

        return run

    added = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return _mapped(df, text, list(carry), added, make)
