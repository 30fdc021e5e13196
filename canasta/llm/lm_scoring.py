"""Language-model scoring with a hashed maximum-entropy model.

Words are lower-cased (A-Z alone) runs of non-blanks; each text ends with an end
token. Words of the training texts are counted by Spark into a stored table. A token
belongs to one of ``CLASSES * PLACES`` slots: the end token and the most frequent
words have a slot each, all others share ``TAILS`` slots by their last letters. The
probability of a token is that of its slot's class in the context, times that of the
slot in the class and the context, times the token's share of its slot by smoothed
counts, with one unseen word a slot; over all words and an unseen one for each slot
these add up to one.

Classes and slots have softmax models whose weights are rows of hashed tables: the
features of a token are the slot before it, the two slots before it as a pair, and
the slots two and three before it by themselves (skips). In each of ``ROUNDS`` rounds
every task takes a share of the training texts, goes from the common weights through
mini-batches of gradient steps, and sends how far each row of weights moved; rows
are averaged by the number of tokens that moved them, in groups of tasks, and become
the next round's common weights. Every training text is learned from in one round.

Texts are tokenized once for training and scoring, into a stored table of slots.
The ``LOOKUP`` most frequent words travel to the tasks as a table; the counts of all
others come by a join on the word, so that none is dropped and nothing that grows
is broadcast. What a task computes at once is bounded, whatever a text's length.

Defined results: null and blank texts have the end token alone; repeated rows score
alike, each for itself; a null id is written as nothing in the digest; without
training texts the base score is 0 and the slots are as likely as one another; an
empty table gives an empty result; extra columns stay out. Which texts share a task
follows from the files, so scores of the model (no counts) depend on it in the last digits.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fan_in, shuffles_dropped, stored

CLASSES = PLACES = 32
TAILS = 256
#: Words that travel to the tasks as a table, and the longest of them.
LOOKUP = 1 << 18
LONGEST = 64
ROUNDS = 3
#: Bits of the row numbers of both tables of weights.
CLASS_BITS, SLOT_BITS = 14, 15
ROWS = (1 << CLASS_BITS) + (1 << SLOT_BITS)
#: Rows of weights that travel together.
SLICE = 1 << 12
RATE = 0.5
MOST_WEIGHT = 8.0
#: Tokens of a mini-batch, and of what a task lays out at once.
STEP = 1 << 14
LAID = 1 << 18
#: Bytes of text tokenized at once.
BLOCK_BYTES = 8_000_000
SLOTS = CLASSES * PLACES
#: The slot before a text begins.
BEFORE = SLOTS
#: Counts up to this are told apart when the looked-up words are chosen.
TOLD_APART = 1 << 14


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning: crc32 of its id as text, modulo five, is one."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5) == 1


# tokens


def text_blocks(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """Slices of batches with texts of bounded size, or one text."""
    for batch in batches:
        bytes_ = pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False)
        edges = (np.flatnonzero(np.diff(np.cumsum(bytes_, dtype=np.int64) // BLOCK_BYTES)) + 1).tolist()
        for a, b in zip([0, *edges], [*edges, batch.num_rows]):
            if b > a:
                yield batch.slice(a, b - a)


def tokenized(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The different words of some texts, each token's place among them, and the tokens of each text."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat = parts.flatten()
    there = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    upto = np.concatenate([[0], np.cumsum(there)])[parts.offsets.to_numpy() - parts.offsets[0].as_py()]
    found = flat.filter(pa.array(there)).dictionary_encode()
    if isinstance(found, pa.ChunkedArray):
        found = found.combine_chunks()
    return found.dictionary, found.indices.to_numpy(), np.diff(upto)


def counted(texts: DataFrame) -> DataFrame:
    """word and n of the words in a column text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, 0):
            words, places, _ = tokenized(block.column(0))
            yield pa.RecordBatch.from_arrays([words, pa.array(np.bincount(places, minlength=len(words)).astype(np.int64))], names=["word", "n"])

    return texts.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(work, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def tail_slots(words: pa.Array) -> np.ndarray:
    """The shared slot of each word, by its last three letters."""
    ends = pc.utf8_slice_codeunits(words, start=-3).dictionary_encode()
    slots = np.array([zlib.crc32(e.encode("utf-8", "surrogatepass")) % TAILS for e in ends.dictionary.to_pylist()], np.int64)
    return slots[ends.indices.to_numpy()] if len(slots) else np.zeros(0, np.int64)


def tail_slot(word: Column) -> Column:
    return F.crc32(F.right(word, F.lit(3)).cast("binary")) % TAILS


@dataclass
class Vocabulary:
    """Looked-up words by falling count, counts of the whole training texts, and the slots."""

    words: pa.Array
    counts: np.ndarray
    texts: int
    tokens: int
    different: int
    #: Slot of each looked-up word and of each tail, in the order of mass; the end token's.
    slot: np.ndarray
    tails: np.ndarray
    end: int
    #: Whether a looked-up word has a slot to itself, training tokens by slot, and different words by tail.
    alone: np.ndarray
    mass: np.ndarray
    kinds: np.ndarray

    @property
    def denominator(self) -> float:
        """Of the base score: all tokens, and half a token for each that is known and an unknown one."""
        return self.tokens + 0.5 * (self.different + 1)

    def shares(self) -> np.ndarray:
        """By tail, the log of what a word's smoothed count in it is divided by."""
        return np.log(self.mass[self.tails] + 0.5 * (self.kinds + 1))


def vocabulary(counts: DataFrame, texts: int) -> Vocabulary:
    """From a stored table of word and n, and the number of training texts."""
    by_count = counts.groupBy(F.least("n", F.lit(TOLD_APART)).alias("n")).agg(F.count("*").alias("words")).orderBy(F.desc("n")).collect()  # TOLD_APART rows at most
    least, room = TOLD_APART + 1, LOOKUP
    for r in by_count:
        if r["words"] > room:
            break
        least, room = r["n"], room - r["words"]
    found = counts.where((F.col("n") >= least) & (F.octet_length("word") <= LONGEST)).toArrow()
    n = found.column("n").to_numpy()
    order = np.lexsort([np.array(found.column("word").to_pylist(), object), -n]) if len(n) else np.zeros(0, np.int64)
    words, n = found.column("word").combine_chunks().take(pa.array(order)), n[order]
    alone = np.arange(len(n)) < SLOTS - TAILS - 1
    tail = tail_slots(words)
    whole = counts.groupBy(tail_slot(F.col("word")).alias("tail")).agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).collect()  # TAILS rows at most
    of_tail, kinds = np.zeros(TAILS), np.zeros(TAILS)
    for r in whole:
        of_tail[r["tail"]], kinds[r["tail"]] = r["n"], r["kinds"]
    of_tail -= np.bincount(tail[alone], n[alone], TAILS)
    kinds -= np.bincount(tail[alone], minlength=TAILS)
    mass = np.zeros(SLOTS)
    mass[0] = texts
    mass[1 : alone.sum() + 1] = n[alone]
    mass[SLOTS - TAILS :] = of_tail
    rank = np.empty(SLOTS, np.int64)
    rank[np.argsort(-mass, kind="stable")] = np.arange(SLOTS)
    slot = rank[np.where(alone, np.arange(1, len(n) + 1), SLOTS - TAILS + tail)]
    ranked = np.zeros(SLOTS)
    ranked[rank] = mass
    total = int(sum(r["n"] for r in whole)) + texts
    return Vocabulary(words, n, texts, total, int(sum(r["kinds"] for r in whole)) + bool(texts), slot, rank[SLOTS - TAILS :], int(rank[0]), alone, ranked, kinds)


def encoded(docs: DataFrame, vocabulary: Vocabulary, rounds: int = ROUNDS) -> DataFrame:
    """A row for each document: row (its number), doc_id, held_out, round, n_tokens, and of its tokens n_known, the logs of the base counts and of the shares of their slots, the slots, and the words that are not looked up."""
    shared = docs.sparkSession.sparkContext.broadcast(vars(vocabulary))
    rare_kind = pa.list_(pa.struct([("word", pa.string()), ("times", pa.int64())]))
    names = ["row", "doc_id", "held_out", "round", "n_tokens", "n_known", "counted", "shared", "slots", "rare"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vocabulary(**shared.value)
        shares, log_counts, number = v.shares(), np.log(v.counts + 0.5), TaskContext.get().partitionId() << 33
        tail_of = v.tails
        for block in text_blocks(batches, 3):
            words, places, sizes = tokenized(block.column(3))
            at = pc.fill_null(pc.index_in(words, value_set=v.words), -1).to_numpy()
            known, tail = at >= 0, tail_slots(words)
            at = np.maximum(at, 0)
            # of each different word of the block: its slot, log count, and log share of its slot
            alone = known & v.alone[at] if len(v.counts) else known
            slot = np.where(alone, v.slot[at], tail_of[tail]) if len(v.counts) else tail_of[tail]
            count = np.where(known, log_counts[at], np.log(0.5)) if len(v.counts) else np.full(len(words), np.log(0.5))
            share = np.where(alone, 0.0, count - shares[tail])
            n, ends = len(sizes), np.cumsum(sizes + 1)
            text = np.repeat(np.arange(n), sizes)
            by_text = lambda weights: np.bincount(text, weights, n)
            sequence = np.full(len(places) + n, v.end, np.uint16)
            sequence[np.arange(len(places)) + text] = slot[places]
            rare = ~known[places]
            pairs, times = np.unique(text[rare] * np.int64(len(words) + 1) + places[rare], return_counts=True)
            of, word = np.divmod(pairs, len(words) + 1)
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(n + 1)).astype(np.int32)), pa.StructArray.from_arrays([words.take(pa.array(word)), pa.array(times.astype(np.int64))], names=["word", "times"]))
            raw = sequence.tobytes()
            begins = np.concatenate([[0], ends[:-1]])
            columns = [pa.array(number + np.arange(n)), block.column(0), block.column(1), block.column(2), pa.array((sizes + 1).astype(np.int64))]
            columns += [pa.array((by_text(known[places]) + bool(v.texts)).astype(np.int64)), pa.array(by_text(count[places]) + np.log(v.texts + 0.5)), pa.array(by_text(share[places]))]
            columns += [pa.array([raw[2 * a : 2 * b] for a, b in zip(begins.tolist(), ends.tolist())], pa.binary()), lists.cast(rare_kind)]
            number += n
            yield pa.RecordBatch.from_arrays(columns, names=names)

    held = held_out(F.col("doc_id"))
    text = F.coalesce("text", F.lit(""))
    round_ = F.when(~held, F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(rounds))).otherwise(-1).cast("int")
    rows = docs.select("doc_id", held.alias("held_out"), round_.alias("round"), text.alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(work, f"row long, doc_id {kind}, held_out boolean, round int, n_tokens long, n_known long, counted double, shared double, slots binary, rare array<struct<word:string,times:bigint>>")


# the model


def scrambled(a: np.ndarray) -> np.ndarray:
    """A hash of unsigned 32-bit numbers."""
    a = a * np.uint32(0x9E3779B1)
    a ^= a >> np.uint32(15)
    a *= np.uint32(0x85EBCA6B)
    return a ^ (a >> np.uint32(13))


def laid_out(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of batches with their tokens' slots in one array and where each text begins, LAID tokens at once or one text."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False) // 2
        edges = (np.flatnonzero(np.diff(np.cumsum(sizes, dtype=np.int64) // LAID)) + 1).tolist()
        for a, b in zip([0, *edges], [*edges, batch.num_rows]):
            if b > a:
                raw = b"".join(batch.column(column).slice(a, b - a).to_pylist())
                yield batch.slice(a, b - a), np.frombuffer(raw, np.uint16), np.concatenate([[0], np.cumsum(sizes[a : b - 1], dtype=np.int64)])


def features(slots: np.ndarray, begins: np.ndarray) -> list[np.ndarray]:
    """The hashed features of each token: the slot before, the pair before, and the slots two and three before."""
    before = []
    for lag in (1, 2, 3):
        shifted = np.full(len(slots), BEFORE, np.uint32)
        shifted[lag:] = slots[:-lag]
        for k in range(lag):
            at = begins + k
            shifted[at[at < len(slots)]] = BEFORE
        before.append(shifted)
    # a text shorter than the lag runs into the next one, whose first tokens are set for each lag
    one, two, three = before
    kinds = SLOTS + 1
    return [scrambled(x) for x in (one, one * np.uint32(kinds) + two + np.uint32(4 * kinds), two + np.uint32(kinds), three + np.uint32(2 * kinds))]


def class_rows(hashed: list[np.ndarray]) -> np.ndarray:
    return np.stack([(h >> np.uint32(32 - CLASS_BITS)).astype(np.uint16) for h in hashed])


def slot_rows(hashed: list[np.ndarray], classes: np.ndarray) -> np.ndarray:
    of_class = scrambled(classes.astype(np.uint32) + np.uint32(77))
    return np.stack([((h ^ of_class) * np.uint32(0xC2B2AE35) >> np.uint32(32 - SLOT_BITS)).astype(np.uint16) for h in hashed])


def segment_sums(rows: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of runs of rows: long runs by a product with ones, short ones a row of all at a time."""
    out = np.empty((len(starts), rows.shape[1]), rows.dtype)
    long = sizes >= 24
    for i in np.flatnonzero(long):
        out[i] = np.ones(sizes[i], rows.dtype) @ rows[starts[i] : starts[i] + sizes[i]]
    at, left, into, k = starts[~long], sizes[~long], np.flatnonzero(~long), 1
    out[into] = rows[at]
    while len(at := at[more := left > k]):
        left, into = left[more], into[more]
        out[into] += rows[at + k]
        k += 1
    return out


@dataclass
class Softmax:
    """Rows of weights by hashed feature over WIDTH outcomes, each with the squares of its gradients and the tokens that moved it."""

    weights: np.ndarray
    squares: np.ndarray
    moved: np.ndarray

    @classmethod
    def zero(cls, rows: int, width: int) -> Softmax:
        return cls(np.zeros((rows, width), np.float32), np.ones(rows, np.float32), np.zeros(rows, np.float32))

    def logits(self, rows: np.ndarray, bias: np.ndarray) -> np.ndarray:
        found = np.take(self.weights, rows[0], axis=0)
        for r in rows[1:]:
            found += np.take(self.weights, r, axis=0)
        found += bias
        return found

    def log_probability(self, rows: np.ndarray, bias: np.ndarray, outcome: np.ndarray) -> np.ndarray:
        """Logits stay far from where exp overflows: biases are under 0 and weights within MOST_WEIGHT."""
        found = self.logits(rows, bias)
        chosen = found[np.arange(len(outcome)), outcome].astype(float)
        return chosen - np.log((np.exp(found, out=found) @ np.ones(found.shape[1], np.float32)).astype(float))

    def step(self, rows: np.ndarray, bias: np.ndarray, outcome: np.ndarray, rate: float) -> None:
        """One gradient step on a mini-batch, each row by the squares of its gradients so far."""
        off = self.logits(rows, bias)
        np.exp(off, out=off)
        off *= (1 / (off @ np.ones(off.shape[1], np.float32)))[:, None]
        off[np.arange(len(outcome)), outcome] -= 1
        keys = rows.ravel()
        order = np.argsort(keys, kind="stable")
        sorted_ = keys[order]
        starts = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
        sizes = np.diff(np.append(starts, len(sorted_)))
        gradient = segment_sums(np.take(off, order % len(outcome), axis=0), starts, sizes)
        touched = sorted_[starts]
        self.squares[touched] += np.einsum("ij,ij->i", gradient, gradient)
        self.moved[touched] += sizes
        gradient *= (rate / np.sqrt(self.squares[touched]))[:, None]
        self.weights[touched] = np.clip(self.weights[touched] - gradient, -MOST_WEIGHT, MOST_WEIGHT)


@dataclass
class Model:
    """Biases by the slots' training tokens, and the softmax over classes and over the slots of a class."""

    class_bias: np.ndarray
    slot_bias: np.ndarray
    classes: Softmax
    slots: Softmax

    @classmethod
    def of(cls, mass: np.ndarray) -> Model:
        m = mass.reshape(CLASSES, PLACES) + 0.5
        by_class = m.sum(axis=1)
        return cls(np.log(by_class / by_class.sum()).astype(np.float32), np.log(m / by_class[:, None]).astype(np.float32), Softmax.zero(1 << CLASS_BITS, CLASSES), Softmax.zero(1 << SLOT_BITS, PLACES))

    def train(self, slots: np.ndarray, begins: np.ndarray, rate: float, seed: int) -> None:
        """Mini-batch steps over all tokens of some texts, in a mixed order."""
        hashed = features(slots, begins)
        order = np.random.default_rng(seed).permutation(len(slots))
        for at in range(0, len(order), STEP):
            chosen = order[at : at + STEP]
            cls, place = np.divmod(slots[chosen].astype(np.int64), PLACES)
            mine = [h[chosen] for h in hashed]
            self.classes.step(class_rows(mine), self.class_bias, cls, rate)
            self.slots.step(slot_rows(mine, cls), self.slot_bias[cls], place, rate)

    def log_probabilities(self, slots: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Of each token's slot."""
        hashed, out = features(slots, begins), np.empty(len(slots))
        for at in range(0, len(slots), STEP):
            cls, place = np.divmod(slots[at : at + STEP].astype(np.int64), PLACES)
            mine = [h[at : at + STEP] for h in hashed]
            out[at : at + STEP] = self.classes.log_probability(class_rows(mine), self.class_bias, cls) + self.slots.log_probability(slot_rows(mine, cls), self.slot_bias[cls], place)
        return out

    def parts(self) -> tuple[np.ndarray, ...]:
        """Arrays that :meth:`from_parts` makes the model of again, so that tasks need no class of this package."""
        return self.class_bias, self.slot_bias, *self.table()[:2]

    @classmethod
    def from_parts(cls, class_bias: np.ndarray, slot_bias: np.ndarray, weights: np.ndarray, squares: np.ndarray) -> Model:
        model = cls(class_bias, slot_bias, Softmax.zero(0, CLASSES), Softmax.zero(0, PLACES))
        model.set_table(weights, squares)
        return model

    def table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Weights, squares and moved of both softmaxes one over the other."""
        return tuple(np.concatenate([getattr(self.classes, k), getattr(self.slots, k)]) for k in ("weights", "squares", "moved"))

    def set_table(self, weights: np.ndarray, squares: np.ndarray) -> None:
        rows = 1 << CLASS_BITS
        self.classes = Softmax(weights[:rows].copy(), squares[:rows].copy(), np.zeros(rows, np.float32))
        self.slots = Softmax(weights[rows:].copy(), squares[rows:].copy(), np.zeros(len(weights) - rows, np.float32))


def train_round(rows: DataFrame, model: Model, rate: float) -> None:
    """Moves the model by what tasks learn, each from its share of the rows with a column slots."""
    shared = rows.sparkSession.sparkContext.broadcast(model.parts())

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, mine = TaskContext.get().partitionId(), Model.from_parts(*shared.value)
        weights, squares, _ = mine.table()
        for k, (_, slots, begins) in enumerate(laid_out(batches, 0)):
            mine.train(slots, begins, rate, at * 1_000_003 + k)
        new, new_squares, moved = mine.table()
        for key in range(ROWS // SLICE):
            s = slice(key * SLICE, (key + 1) * SLICE)
            if moved[s].any():
                # movements weighed by tokens, so that rows which few tasks meet are not diluted
                state = np.column_stack([moved[s], moved[s] * (new_squares[s] - squares[s]), moved[s, None] * (new[s] - weights[s])]).astype(np.float32)
                yield pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), pa.array([at], pa.int64()), pa.array([state.tobytes()], pa.binary())], names=["key", "part", "state"])

    def merge(state: np.ndarray | None, data: bytes) -> np.ndarray:
        found = np.frombuffer(data, np.float32)
        return found if state is None else state + found

    states = rows.select("slots").mapInArrow(part, "key int, part long, state binary")
    weights, squares, _ = model.table()
    with shuffles_dropped(rows.sparkSession):
        found = fan_in(states, rows.rdd.getNumPartitions(), merge, lambda state: state.tobytes()).collect()  # ROWS / SLICE rows of fixed size
    for r in found:
        s = slice(r["key"] * SLICE, (r["key"] + 1) * SLICE)
        state = np.frombuffer(r["state"], np.float32).reshape(SLICE, -1)
        share = 1 / np.maximum(state[:, 0], 1)
        squares[s] += state[:, 1] * share
        weights[s] += state[:, 2:] * share[:, None]
    model.set_table(weights, squares)
    shared.destroy()


def fit(rows: DataFrame, vocabulary: Vocabulary, rounds: int = ROUNDS, rate: float = RATE) -> Model:
    """The model, from a stored table of :func:`encoded`, of which rows with a round of 0 or more teach."""
    model = Model.of(vocabulary.mass)
    for k in range(rounds):
        train_round(rows.where(F.col("round") == k), model, rate)
    return model


# scores


def scored(rows: DataFrame, model: Model) -> DataFrame:
    """row, doc_id, held_out, n_tokens, n_known, counted, and model (log probability of the slots and of the looked-up words' shares)."""
    shared = rows.sparkSession.sparkContext.broadcast(model.parts())
    keep = ["row", "doc_id", "held_out", "n_tokens", "n_known", "counted", "shared"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = Model.from_parts(*shared.value)
        for part, slots, begins in laid_out(batches, len(keep)):
            of_slots = np.add.reduceat(mine.log_probabilities(slots, begins), begins)  # no text is without a token
            yield pa.RecordBatch.from_arrays([*part.columns[:-2], pa.array(of_slots + part.column(len(keep) - 1).to_numpy())], names=[*keep[:-1], "model"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select(*keep, "slots").mapInArrow(work, f"row long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, counted double, model double")


def rare_sums(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """row, known (tokens) and more (what their counts add to the logs of unseen words) for the words that are not looked up."""
    words = rows.select("row", F.explode("rare").alias("r")).select("row", F.col("r.word").alias("word"), F.col("r.times").alias("times"))
    met = words.join(counts, "word")
    return met.groupBy("row").agg(F.sum("times").alias("known"), F.sum(F.col("times") * (F.log(F.col("n") + 0.5) - F.lit(float(np.log(0.5))))).alias("more"))


def score(docs: DataFrame, rounds: int = ROUNDS, rate: float = RATE) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10) of every document with columns doc_id and text."""
    train = docs.where(~held_out(F.col("doc_id")))
    counts = stored(counted(train))
    v = vocabulary(counts, train.count())
    rows = stored(encoded(docs, v, rounds))
    model = fit(rows, v, rounds, rate)
    rare = rare_sums(rows, counts)
    both = scored(rows, model).join(rare, "row", "left")
    more = F.coalesce("more", F.lit(0.0))
    ten = float(np.log(10))
    return both.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(v.tokens).cast("long").alias("train_tokens"),
        ((F.col("counted") + more - F.col("n_tokens") * F.lit(float(np.log(v.denominator)))) / F.lit(ten)).alias("base_score"),
        ((F.col("model") + more) / F.lit(ten)).alias("score"),
    )
