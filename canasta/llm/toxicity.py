"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded text.

Folding lower-cases, turns homoglyphs and full-width letters into Latin ones
and undoes digit and symbol substitutions inside words, character by character,
so matches keep their offsets. The lexicon is learned from labelled rows: the
documents of each class that hold a folded word are counted over two thirds of a
sample of at most ``MOST_LABELLED`` rows, near copies (by SimHash) of one class as
one, and words that toxic documents hold far more often, by more evidence than chance gives, get the log of the odds as
weight. Stems, the first ``STEMS`` letters of words, are entries too, written with a
star, as languages that inflect their insults need; of an entry and one that begins
with it the one of more evidence stays. An exception phrase is an entry with the word before or after it that
only documents of label 0 hold, or one of ``EXCEPTIONS``. Each task matches all
entries at once with an automaton, at word bounds alone; exception phrases are
entries too, and a match inside one does not count. The weights found are
summed, divided by the square root of the length in words, and a logistic curve,
fitted on the third of the sample that the lexicon has not seen, turns both
figures into a score.

Defined results: null, empty and blank texts match nothing and get the score of
a text without matches; repeated rows score alike; without labelled rows of
both classes the lexicon is empty and every score is under 0.001, or over 0.999
if all labels are toxic; null ids have no label; an empty table gives an empty
result; extra columns stay out.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut
from .simhash import near_duplicates


#: Letters of other scripts that look like Latin ones (fixed values).
HOMOGLYPHS = dict(zip(
    "аеорсухіјѕԁһӏԛԝвнкмтαεορυικνχτβ" "ɑɡıɩłøđħŧßʏʀᴀᴄᴅᴇᴊᴋᴍɴᴏᴘᴛᴜᴠᴡᴢ" "գզհոսցօրուաե" "ⅼⅰⅽⅾⅿⅴⅹ",
    "aeopcyxijsdhlqwbhkmtaeopuiknxtb" "agiilodhtsyracdejkmnoptuvwz" "qqhnugopnuwe" "licdmvx",
))
#: Digits and symbols written for letters (fixed values).
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}
#: Phrases in which an entry is no insult, whatever the labelled rows hold (fixed values).
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "pathetic fallacy", "biggest loser", "class clown", "dummy variable", "dummy text", "crash test dummy", "kill switch", "dead pixel", "idiot proof")

MOST_LABELLED = 20_000
LEAST_DOCS = 3
#: Letters of stems, and the least weights of words and of stems, several of which a toxic text holds.
STEMS = (5, 6, 7, 8)
LEAST_WEIGHT, LEAST_STEM_WEIGHT = 2.5, 1.8
#: Log likelihood ratio of a word's documents, as chance gives once in twenty times among half a million words.
LEAST_EVIDENCE = 14.0
SMOOTHING = 0.5
#: Bytes of text that a task takes up at once.
BLOCK_BYTES = 4_000_000


def plain_letter(c: str) -> str:
    """The Latin letter that a character stands for (full-width, mathematical and other forms of letters too), or the character."""
    if c in HOMOGLYPHS:
        return HOMOGLYPHS[c]
    same = unicodedata.normalize("NFKC", c).lower()
    return same if len(same) == 1 and same.isascii() else c


def fold(text: str) -> str:
    """Same length as the text, so that offsets hold."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    if not low.isascii():
        low = low.translate({ord(c): plain_letter(c) for c in set(low) if c > "\x7f"})
    return SUBSTITUTED.sub(_plain, low)


SUBSTITUTED = re.compile("[" + re.escape("".join(SUBSTITUTES)) + "]+")


def _plain(run: re.Match) -> str:
    """A run of substitutes stands for letters before a letter, or if all digits after one."""
    text, (a, b), chars = run.string, run.span(), run.group(0)
    if (b < len(text) and text[b].isalpha()) or (a and text[a - 1].isalpha() and chars.isdigit()):
        return "".join(SUBSTITUTES[c] for c in chars)
    return chars


def is_letter(c: str) -> bool:
    return c.isalpha()


class Matcher:
    """All entries and exception phrases in one automaton."""

    def __init__(self, lexicon: dict[str, float], exceptions: tuple[str, ...] = EXCEPTIONS):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for word, weight in lexicon.items():
            key = word.rstrip("*")
            self.automaton.add_word(key, (len(key), weight, key != word))
        for phrase in exceptions:
            self.automaton.add_word(phrase, (len(phrase), None, False))
        self.empty = not (lexicon or exceptions)
        if not self.empty:
            self.automaton.make_automaton()

    def spans(self, text: str) -> list[tuple[int, int, float]]:
        """start, end and weight of each entry that stands as a word, or begins one if it is a stem, outside every exception phrase."""
        if self.empty or not text:
            return []
        folded = fold(text)
        found, spared = [], []
        for last, (size, weight, stem) in self.automaton.iter(folded):
            a, b = last - size + 1, last + 1
            if (a == 0 or not is_letter(folded[a - 1])) and (stem or b == len(folded) or not is_letter(folded[b])):
                (spared if weight is None else found).append((a, b, weight))
        if spared:
            found = [f for f in found if not any(a <= f[0] and f[1] <= b for a, b, _ in spared)]
        return found


def blocks(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """Slices of batches with texts of bounded size, or one text."""
    for batch in batches:
        bytes_ = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        edges = (np.flatnonzero(np.diff(np.cumsum(bytes_, dtype=np.int64) // BLOCK_BYTES)) + 1).tolist()
        for a, b in zip([0, *edges], [*edges, batch.num_rows]):
            if b > a:
                yield batch.slice(a, b - a)


def learn(labelled: DataFrame) -> tuple[dict[str, float], tuple[str, ...], list[float]]:
    """The lexicon, the exception phrases and the curve from a bounded sample of rows with text and toxic (0 or 1)."""
    copies = F.col("copies") if "copies" in labelled.columns else F.xxhash64("text")  # what near copies share
    sample = labelled.where("toxic in (0, 1)").select("text", F.col("toxic").cast("int").alias("toxic"), copies.alias("copies"), (F.pmod(F.xxhash64("text"), F.lit(3)) == 0).alias("unseen"))
    seen, unseen = sample.where(~F.col("unseen")), sample.where("unseen")
    totals = {(r["unseen"], r["toxic"]): r["n"] for r in sample.groupBy("unseen", "toxic").agg(F.count_distinct("copies").alias("n")).collect()}
    if not all(totals.get((False, k)) and totals.get((True, k)) for k in (0, 1)):
        seen = unseen = sample  # too few rows to part
    bad, good = (sum(totals.get((u, k), 0) for u in ((False,) if seen is not sample else (False, True))) for k in (1, 0))
    if not bad or not good:
        return {}, EXCEPTIONS, [8.0 if bad else -8.0, 0.0, 0.0]
    # counts of a bounded sample: distinct folded words by document, then documents by word
    words = seen.select("toxic", "copies", "text").mapInArrow(_folded_words, "toxic int, copies long, word string").distinct()
    weight = F.log((F.col("b") + SMOOTHING) / F.lit(bad + 2 * SMOOTHING)) - F.log((F.col("g") + SMOOTHING) / F.lit(good + 2 * SMOOTHING))
    n, share = F.col("b") + F.col("g"), bad / (bad + good)
    evidence = F.col("b") * F.log(F.col("b") / (n * share)) + F.when(F.col("g") > 0, F.col("g") * F.log(F.col("g") / (n * (1 - share)))).otherwise(0.0)
    counted = (
        words.groupBy("word")
        .agg(F.sum("toxic").alias("b"), F.sum(1 - F.col("toxic")).alias("g"))
        .where(F.col("b") >= LEAST_DOCS)
        .withColumn("weight", weight)
        .withColumn("evidence", evidence)
        .where((F.col("weight") >= F.when(F.col("word").endswith("*"), LEAST_STEM_WEIGHT).otherwise(LEAST_WEIGHT)) & (F.col("evidence") >= LEAST_EVIDENCE))
    )
    lexicon = apart({r["word"]: (float(r["evidence"]), float(r["weight"])) for r in counted.collect()})  # of a bounded sample
    exceptions = (*EXCEPTIONS, *learned_exceptions(seen, lexicon))
    held = score_parts(unseen, lexicon, ("toxic",), exceptions).select("toxic", "hits", "density").toArrow().to_pandas()  # the bounded sample
    return lexicon, exceptions, fit(held["hits"].to_numpy(), held["density"].to_numpy(), held["toxic"].to_numpy())


def apart(found: dict[str, tuple[float, float]]) -> dict[str, float]:
    """Weights of the entries (evidence, weight) that stay, so that no word counts twice: those of most evidence, words before stems and long stems before short ones."""
    kept, beginnings = {}, set()
    for entry in sorted(found, key=lambda e: (-found[e][0], e.endswith("*"), -len(e), e)):
        key = entry.rstrip("*")
        begins = {key[:k] for k in range(1, len(key) + 1)}
        # an entry of more evidence that is a stem of this one, or that this one is a stem of
        if not any(f"{b}*" in kept for b in begins) and not (entry != key and key in beginnings):
            kept[entry] = found[entry][1]
            beginnings |= begins
    return kept


def learned_exceptions(sample: DataFrame, lexicon: dict[str, float]) -> list[str]:
    """Entries with a neighbouring word, as LEAST_DOCS documents of label 0 and none of label 1 hold them."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(lexicon, ())
        for part in blocks(batches, 1):
            for toxic, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                if found := matcher.spans(text or ""):
                    folded, phrases = fold(text), set()
                    for a, b, _ in found:
                        phrases |= {m.group(0) for m in (BEFORE.search(folded[max(0, a - 42) : b]), AFTER.match(folded[a : b + 42])) if m and len(m.group(0)) > b - a}
                    yield pa.RecordBatch.from_arrays([pa.array([toxic] * len(phrases), pa.int32()), pa.array(sorted(phrases), pa.string())], names=["toxic", "phrase"])

    found = sample.select("toxic", "text").mapInArrow(work, "toxic int, phrase string").groupBy("phrase").agg(F.sum("toxic").alias("b"), F.count("*").alias("n"))
    return [r["phrase"] for r in found.where((F.col("b") == 0) & (F.col("n") >= LEAST_DOCS)).orderBy("phrase").collect()]


#: The word before an entry that ends a text, and the word after one that begins it.
BEFORE = re.compile(r"(?<![^\W\d_])[^\W\d_]+ [^\W\d_]+\Z")
AFTER = re.compile(r"[^\W\d_]+ [^\W\d_]+(?![^\W\d_])")


def _folded_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in blocks(batches, 2):
        for toxic, copies, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
            words = {w for w in re.findall(r"[^\W\d_]+", fold(text or "")) if len(w) >= 3}
            words = sorted({w for w in words if len(w) <= 40} | {f"{w[:k]}*" for w in words for k in STEMS if len(w) > k})
            yield pa.RecordBatch.from_arrays([pa.array([toxic] * len(words), pa.int32()), pa.array([copies] * len(words), pa.int64()), pa.array(words, pa.string())], names=["toxic", "copies", "word"])


def fit(hits: np.ndarray, density: np.ndarray, toxic: np.ndarray, steps: int = 60) -> list[float]:
    """A logistic curve over log hits and log density, by damped Newton steps."""
    x = np.column_stack([np.ones(len(hits)), np.log1p(hits), np.log1p(density)])
    w = np.zeros(3)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - toxic) + 0.05 * w
        hess = (x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(3)
        w = w - np.linalg.solve(hess, grad)
    return [float(v) for v in w]


def score_parts(df: DataFrame, lexicon: dict[str, float], carry: tuple[str, ...] = ("doc_id",), exceptions: tuple[str, ...] = EXCEPTIONS) -> DataFrame:
    """carry columns, hits (summed weights) and density (by the square root of the words)."""
    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in carry)
    names = [*carry, "hits", "density"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(lexicon, exceptions)
        for batch in blocks(batches, len(carry)):
            hits, density = [], []
            for text in batch.column(len(carry)):
                t = text.as_py() or ""
                total = sum(w for _, _, w in matcher.spans(t))
                hits.append(total)
                density.append(total / math.sqrt(max(1, t.count(" ") + t.count("\n") + 1)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(carry)], pa.array(hits, pa.float64()), pa.array(density, pa.float64())], names=names)

    return df.select(*carry, "text").mapInArrow(work, f"{fields}, hits double, density double")


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning: crc32 of its id as text, modulo five."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5) == 0


def near_copies(sample: DataFrame) -> DataFrame:
    """The sample with copies, a number that near copies share."""
    near = near_duplicates(sample.select("doc_id", "text")).select(F.col("doc_id").alias("_id"), F.hash("component_id").cast("long").alias("copies"))
    return sample.join(near, F.col("doc_id") == F.col("_id")).drop("_id")


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for all documents; labels of held-out rows are never read."""
    labelled = labels.where("toxic in (0, 1)").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    taught = labelled.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MOST_LABELLED)  # a bounded sample by hash, so its ids can be broadcast
    sample = docs.select("doc_id", "text").join(F.broadcast(taught), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))  # an id's rows count once
    lexicon, exceptions, curve = learn(near_copies(cut(sample)))
    parts = score_parts(docs, lexicon, exceptions=exceptions)
    z = F.lit(curve[0]) + F.lit(curve[1]) * F.log1p("hits") + F.lit(curve[2]) * F.log1p("density")
    scored = parts.withColumn("score", 1 / (1 + F.exp(-z)))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "hits", "density")


def spans(docs: DataFrame, lexicon: dict[str, float], exceptions: tuple[str, ...] = EXCEPTIONS) -> DataFrame:
    """doc_id and the matched spans (start, end in code points, weight) of each text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(lexicon, exceptions)
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("weight", pa.float64())]))
        for batch in batches:
            found = [[dict(zip(("start", "end", "weight"), s)) for s in matcher.spans(t or "")] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], names=["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, spans array<struct<start:int,end:int,weight:double>>")
