"""Fill-in-middle transformation with a sparse checkpoint index.

A text is cut at two units (lines, words with the white space after them, or code
points) into prefix, middle and suffix, and these are put in another order between
marks. Counting the units passes over the text's bytes block by block and records,
every ``EVERY`` units, the byte and the code point where the unit begins. A cut is
then found by a binary search among these checkpoints and a scan of less than
``EVERY`` units from the one before it, so that the index of a text of any length
is a small part of it and no list of its units is made.

Where the cuts fall and which form a text takes follow from a digest of the seed and
the document's id, so that every run makes the same.

Defined results: null texts count as empty; empty texts and texts that hold a mark
stay plain; a text is its units joined, whatever stands in it; a null id is written
as nothing in the digest; rows that share an id are cut by the same numbers, each on
its own text; an empty table gives an empty result; extra columns stay out.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARKS = ("<P>", "<S>", "<M>")
#: Units between checkpoints, and bytes counted at once.
EVERY = 64
BLOCK = 1 << 20
#: Bytes of text that a task takes up at once.
BATCH_BYTES = 4_000_000
UNITS = ("lines", "words", "chars")
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True


@dataclass
class Index:
    """The units of a text and their checkpoints: the number, byte and code point at which every so manieth unit begins."""

    units: int
    size: int
    chars: int
    unit: list[int]
    byte: list[int]
    char: list[int]


def unit_starts(block: np.ndarray, before: int, unit: str) -> np.ndarray:
    """Where units begin in a block of bytes; ``before`` is the byte before it (a line end where the text begins)."""
    previous = np.concatenate([np.array([before], np.uint8), block[:-1]])
    if unit == "lines":
        return np.flatnonzero(previous == 10)
    if unit == "chars":
        return np.flatnonzero((block & 0xC0) != 0x80)
    return np.flatnonzero(SPACES[previous] & ~SPACES[block])


def indexed(data: bytes, unit: str = "lines", every: int = EVERY) -> Index:
    """Counts the units of a text in UTF-8 and records the checkpoints. White space at the very start is a unit of words."""
    found = Index(0, len(data), 0, [], [], [])
    whole = np.frombuffer(data, np.uint8)
    before = 10
    for start in range(0, len(data), BLOCK):
        block = whole[start : start + BLOCK]
        lead = (block & 0xC0) != 0x80
        starts = unit_starts(block, before, unit)
        if unit == "words" and not start and (not len(starts) or starts[0]):
            starts = np.concatenate([[0], starts])
        marked = starts[-found.units % every :: every]
        number = found.units + np.arange(-found.units % every, len(starts), every)
        chars = np.cumsum(lead, dtype=np.int64)[marked] - lead[marked] + found.chars
        found.unit += number.tolist()
        found.byte += (marked + start).tolist()
        found.char += chars.tolist()
        found.units += len(starts)
        found.chars += int(lead.sum())
        before = int(block[-1])
    return found


def cut_at(data: bytes, index: Index, units: int, unit: str = "lines") -> tuple[int, int]:
    """The byte and code point where the unit of that number begins; the end of the text for the number of all units."""
    if units >= index.units:
        return index.size, index.chars
    at = bisect_right(index.unit, units) - 1
    byte, char, more = index.byte[at], index.char[at], units - index.unit[at]
    whole, here = np.frombuffer(data, np.uint8), byte
    step = 1 << 12
    # the unit at the checkpoint is number 0 of the scan
    while True:
        block = whole[here : here + step]
        first = here == byte
        starts = unit_starts(block, 10 if first else int(whole[here - 1]), unit)
        if first and (not len(starts) or starts[0]):
            starts = np.concatenate([[0], starts])
        if more < len(starts):
            end = here + int(starts[more])
            return end, char + int(((whole[here:end] & 0xC0) != 0x80).sum())
        more -= len(starts)
        char += int(((block & 0xC0) != 0x80).sum())
        here += len(block)


def draws(doc_id: object, seed: int) -> list[int]:
    """Four unsigned 32-bit numbers from the digest of seed and id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]


@dataclass
class Piece:
    """What a text becomes: its units, form, cuts (code points) and output."""

    units: int
    form: str
    prefix_chars: int | None
    middle_chars: int | None
    output: bytes


def transformed(data: bytes, doc_id: object, seed: int, rate: int, spm: int, unit: str, every: int = EVERY) -> Piece:
    index = indexed(data, unit, every)
    h1, h2, h3, h4 = draws(doc_id, seed)
    marks = [m.encode() for m in MARKS]
    if not data or any(m in data for m in marks) or h3 % 100 >= rate:
        return Piece(index.units, "plain", None, None, data)
    a, b = sorted((h1 % (index.units + 1), h2 % (index.units + 1)))
    (first, first_char), (second, second_char) = (cut_at(data, index, u, unit) for u in (a, b))
    prefix, middle, suffix = data[:first], data[first:second], data[second:]
    p, s, m = marks
    form = "spm" if h4 % 100 < spm else "psm"
    output = s + suffix + p + prefix + m + middle if form == "spm" else p + prefix + s + suffix + m + middle
    return Piece(index.units, form, first_char, second_char - first_char, output)


def restored(output: bytes, form: str) -> bytes:
    """The text from an output and its form. Marks cannot overlap each other, so each is found where it was put."""
    if form == "plain":
        return output
    p, s, m = (x.encode() for x in MARKS)
    first, second = (s, p) if form == "spm" else (p, s)
    body, _, middle = output[len(first) :].partition(m)
    one, _, other = body.partition(second)
    prefix, suffix = (other, one) if form == "spm" else (one, other)
    return prefix + middle + suffix


def transform(df: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50, unit: str = "lines", digests: bool = False) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars and output of each text; with ``digests`` those of output and restored text instead of the output.

    ``rate`` and ``spm`` are the percentages of texts that are transformed, and of those that begin with the suffix.
    """
    if unit not in UNITS:
        raise ValueError(f"unit is one of {', '.join(UNITS)}")
    kind = df.schema["doc_id"].dataType.simpleString()
    last = ["output_sha256", "restored_sha256"] if digests else ["output"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bytes_ = pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False)
            edges = (np.flatnonzero(np.diff(np.cumsum(bytes_, dtype=np.int64) // BATCH_BYTES)) + 1).tolist()
            for start, end in zip([0, *edges], [*edges, batch.num_rows]):
                part = batch.slice(start, end - start)
                columns: list[list] = [[] for _ in range(4 + len(last))]
                for doc_id, data in zip(part.column(0).to_pylist(), part.column(1)):
                    piece = transformed(data.as_py(), doc_id, seed, rate, spm, unit)
                    tail = [hashlib.sha256(x).hexdigest() for x in (piece.output, restored(piece.output, piece.form))] if digests else [piece.output.decode("utf-8", "surrogatepass")]
                    for column, value in zip(columns, [piece.units, piece.form, piece.prefix_chars, piece.middle_chars, *tail]):
                        column.append(value)
                types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), *[pa.string()] * len(last)]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(columns, types))], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", *last])

    texts = df.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return texts.mapInArrow(work, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, " + ", ".join(f"{c} string" for c in last))
