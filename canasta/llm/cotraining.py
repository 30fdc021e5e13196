"""Quality classifier by co-training of two views.

The content view measures a text alone (shares of kinds of characters, lengths
of words and lines, repetition); the metadata view has what the page says about
itself (language, source, declared length; the ``MOST_NAMES`` languages and sources
of most rows have a column each). Each view has a logistic
classifier, fitted on the labelled rows and on pseudo-labels from the other
view. In each of ``ROUNDS`` rounds a view labels, among all unlabelled rows that
it has not labelled yet, those of which it is surest: both classes in the
proportion of the labelled rows, ``SHARE`` of all at most, and none of which it
is less sure than ``SURE``. How sure it is, a curve of two parameters tells that
is fitted anew in each round on labelled rows that neither view learns from, so
that a view that knows little teaches little. What a view has taught stays
taught. At the end the calibrated views are added as log odds, weighed by how
well each does on the rows of the curves.

Every unlabelled row of the table takes part. Texts are measured once, into a
stored table of numbers; a Newton step is one pass over it that sends sums of
gradients and curvatures, whose size is that of the columns, and a round's
bounds come from histograms of log odds. Which rows a view has taught follows
from the models and bounds of the rounds so far, so no state is written. Only
the calibration curves use a bounded sample (``MOST_CALIBRATION`` labelled rows,
by hash).

Defined results: null, empty and blank texts have all measures zero and are
scored like any other; repeated rows score alike, each for itself; null ids have
no label; without labelled rows of both classes every score is 0.5; an empty
table gives an empty result; extra columns stay out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

MOST_CALIBRATION = 20_000
ROUNDS = 5
#: The share of the unlabelled rows that each view labels in a round at most, and how sure it must be.
SHARE = 0.1
SURE = 0.95
RIDGE = 1.0
STEPS = 7
#: Log odds are kept within this; histograms of them have BINS bins.
MOST_ODDS = 30.0
BINS = 6_000
#: Languages and sources that have a column of their own, those of most rows, and the hashed columns that all others share.
MOST_NAMES = 512
NAMES = 64
META = NAMES + 2
#: Partial sums are added up in so many groups before they reach the driver.
SLOTS = 64
#: Bytes of text measured at once.
BLOCK_BYTES = 4_000_000

#: Kinds of bytes: upper, lower, digit, space, line end, stop, other mark, beyond ASCII.
KIND = np.full(256, 6, np.uint8)
for _k, _chars in enumerate([b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t\r\x0b\x0c", b"\n", b".,;:'"]):
    KIND[list(_chars)] = _k
KIND[128:] = 7
CONTENT = 17


def content(text: str | None) -> np.ndarray:
    """The measures of a text."""
    out = np.zeros(CONTENT)
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    if not len(data):
        return out
    kinds = KIND[data]
    share = np.bincount(kinds, minlength=8) / len(data)
    white = (kinds == 3) | (kinds == 4)
    begins = np.flatnonzero(~white & np.concatenate([[True], white[:-1]]))
    words = text.split()
    n = max(1, len(words))
    lines = text.split("\n")
    out[:8] = share
    out[8] = np.log1p(len(words))
    out[9] = np.log1p(len(data) / n)
    out[10] = len(set(words)) / n
    out[11] = np.log1p(len(words) / len(lines))
    out[12] = len(set(lines)) / len(lines)
    out[13] = np.mean(kinds[begins] == 0) if len(begins) else 0.0
    ends = np.flatnonzero(~white & np.concatenate([white[1:], [True]]))
    out[14] = np.mean(kinds[ends] == 6) if len(ends) else 0.0
    out[15] = np.mean(np.diff(begins) <= 3) if len(begins) > 1 else 0.0
    out[16] = len(set(zip(words, words[1:]))) / n
    return out


def name_columns(docs: DataFrame) -> tuple[dict[tuple[str, str | None], int], int]:
    """The column of each language and source that has one, and how many columns names take in all."""
    kinds = [docs.groupBy(F.lit(k).alias("kind"), F.col(k).cast("string").alias("value")).count() for k in ("lang", "source")]
    found = kinds[0].union(kinds[1]).orderBy(F.desc("count"), "kind", F.col("value").asc_nulls_first()).limit(MOST_NAMES + 1).collect()
    own = {(r["kind"], r["value"]): i for i, r in enumerate(found[:MOST_NAMES])}
    return own, max(1, len(own) + (NAMES if len(found) > MOST_NAMES else 0))


def name_column(kind: str, value: str | None, own: dict[tuple[str, str | None], int]) -> int:
    import xxhash

    at = own.get((kind, value))
    return len(own) + xxhash.xxh64_intdigest(f"{kind}={value}".encode()) % NAMES if at is None else at


def measured(docs: DataFrame, own: dict[tuple[str, str | None], int]) -> DataFrame:
    """doc_id, content (array of floats), lang and source (columns of names) and size (log of the declared length)."""
    names = ["doc_id", "content", "lang", "source", "size"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bytes_ = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(np.diff(np.cumsum(bytes_, dtype=np.int64) // BLOCK_BYTES)) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows]):
                part = batch.slice(a, b - a)
                one = np.array([content(t.as_py()) for t in part.column(1)], np.float32).reshape(-1, CONTENT)
                columns = [pa.array([name_column(kind, v, own) for v in part.column(i).to_pylist()], pa.int32()) for kind, i in (("lang", 2), ("source", 3))]
                size = np.log1p(np.maximum(0.0, np.nan_to_num(part.column(4).to_numpy(zero_copy_only=False).astype(float)))).astype(np.float32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(one), pa.list_(pa.float32())), *columns, pa.array(size)], names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    told = docs.select("doc_id", "text", F.col("lang").cast("string"), F.col("source").cast("string"), F.coalesce(F.col("n_chars").cast("double"), F.lit(0.0)).alias("n_chars"))
    return told.mapInArrow(work, f"doc_id {kind}, content array<float>, lang int, source int, size float")


def views(batch: pa.RecordBatch, names: int = NAMES) -> list[np.ndarray]:
    """Both views of the rows of a batch with the columns of :func:`measured`, of which so many are names."""
    one = batch.column("content").flatten().to_numpy(zero_copy_only=False).reshape(-1, CONTENT).astype(float)
    two = np.zeros((batch.num_rows, names + 2))
    at = np.arange(batch.num_rows)
    for c in ("lang", "source"):
        two[at, batch.column(c).to_numpy()] += 1
    size = batch.column("size").to_numpy().astype(float)
    two[:, names], two[:, names + 1] = size, size**2 / 10
    return [one, two]


@dataclass
class CoTrained:
    """Both views' classifiers, what they taught in each round, and the curves that combine them."""

    mean: list[np.ndarray]
    scale: list[np.ndarray]
    weights: list[np.ndarray]
    #: For each round: the weights of both views then, and for each view the log odds from which it labelled 1 and up to which 0.
    taught: list[tuple[list[np.ndarray], list[tuple[float, float]]]] = field(default_factory=list)
    curves: list[tuple[float, float]] = field(default_factory=list)
    both: np.ndarray | None = None

    def columns(self, of: list[np.ndarray]) -> list[np.ndarray]:
        """Standardised, with a column of ones."""
        return [np.column_stack([np.ones(len(x)), np.clip((x - m) / s, -8, 8)]) for x, m, s in zip(of, self.mean, self.scale)]

    def labels_by(self, view: int, z: list[np.ndarray]) -> np.ndarray:
        """What a view has labelled each unlabelled row: 0, 1 or NaN for none."""
        out = np.full(len(z[view]), np.nan)
        for weights, bounds in self.taught:
            odds, (high, low) = log_odds(z[view], weights[view]), bounds[view]
            new = np.isnan(out)
            out[new & (odds >= high)] = 1.0
            out[new & (odds <= low)] = 0.0
        return out

    def score(self, of: list[np.ndarray]) -> np.ndarray:
        odds = [a + b * log_odds(z, w) for z, w, (a, b) in zip(self.columns(of), self.weights, self.curves)]
        return logistic(np.column_stack([np.ones(len(odds[0])), *odds]) @ self.both)


def logistic(odds: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(odds, -MOST_ODDS, MOST_ODDS)))


def log_odds(z: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.clip(z @ w, -MOST_ODDS, MOST_ODDS)


def newton_parts(z: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Gradient and curvature of the rows with a label, in one column."""
    known = ~np.isnan(y)
    z, y = z[known], y[known]
    p = logistic(z @ w)
    return np.concatenate([z.T @ (p - y), ((z * (p * (1 - p) + 1e-6)[:, None]).T @ z).ravel()])


def newton_step(parts: np.ndarray, w: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    k = len(w)
    step = np.linalg.solve(parts[k:].reshape(k, k) + ridge * np.eye(k), parts[:k] + ridge * w)
    return w - step * min(1.0, 10 / max(1e-9, np.abs(step).max()))


def fit_small(z: np.ndarray, y: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    w = np.zeros(z.shape[1])
    for _ in range(25):
        w = newton_step(newton_parts(z, y, w), w, ridge)
    return w


def summed(rows: DataFrame, size: int, of_batch: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """The sum over all batches of a column of so many numbers, in a fixed order."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += of_batch(batch)
        at = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array([at % SLOTS], pa.int32()), pa.array([at], pa.int32()), pa.array([total.tobytes()])], names=["slot", "part", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, slot = np.zeros(size), None
        for batch in batches:
            for s, sums in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                total, slot = total + np.frombuffer(sums), s
        if slot is not None:
            yield pa.RecordBatch.from_arrays([pa.array([slot], pa.int32()), pa.array([total.tobytes()])], names=["slot", "sums"])

    parts = rows.mapInArrow(part, "slot int, part int, sums binary")
    added = parts.repartition("slot").sortWithinPartitions("slot", "part").mapInArrow(add, "slot int, sums binary")
    return sum((np.frombuffer(r["sums"]) for r in sorted(added.collect(), key=lambda r: r["slot"])), np.zeros(size))  # SLOTS rows at most


def label_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The label that is learned from (NaN: none), and whether a row is unlabelled."""
    y = pc.fill_null(batch.column("y"), np.nan).to_numpy(zero_copy_only=False)
    return np.where(batch.column("held").to_numpy(zero_copy_only=False), np.nan, y), np.isnan(y)


def bounds(found: np.ndarray, curve: tuple[float, float], rows: float, prior: float, share: float, sure: float) -> tuple[float, float]:
    """From a histogram of log odds: those from which the surest share is labelled 1, and up to which it is labelled 0, in the classes' proportion, where the curve is sure enough."""
    edges = np.linspace(-MOST_ODDS, MOST_ODDS, BINS + 1)
    least, told = np.log(sure / (1 - sure)), curve[0] + max(0.0, curve[1]) * edges
    above = np.cumsum(found[::-1])[::-1]
    below = np.cumsum(found)
    high = np.flatnonzero((above <= share * rows * prior) & (told[:-1] >= least))
    low = np.flatnonzero((below <= share * rows * (1 - prior)) & (told[1:] <= -least))
    if curve[1] <= 0:
        return np.inf, -np.inf
    return (float(edges[high[0]]) if len(high) else np.inf), (float(edges[low[-1] + 1]) if len(low) else -np.inf)


def fit(rows: DataFrame, rounds: int = ROUNDS, share: float = SHARE, sure: float = SURE, names: int = NAMES) -> CoTrained | None:
    """The classifiers, from a table of :func:`measured` with y and held (for calibration alone); None without both classes."""
    size = [CONTENT, names + 2]

    def moments(batch: pa.RecordBatch) -> np.ndarray:
        y, _ = label_of(batch)
        return np.concatenate([[batch.num_rows, np.nansum(y == 1), np.nansum(y == 0)], *(np.concatenate([x.sum(axis=0), (x**2).sum(axis=0)]) for x in views(batch, names))])

    found = summed(rows, 3 + 2 * sum(size), moments)
    n, good, bad = found[:3]
    if not good or not bad:
        return None
    mean, scale, at = [], [], 3
    for k in size:
        mean.append(found[at : at + k] / n)
        scale.append(np.sqrt(np.maximum(0, found[at + k : at + 2 * k] / n - mean[-1] ** 2)) + 1e-6)
        at += 2 * k
    model = CoTrained(mean, scale, [np.zeros(k + 1) for k in size])
    widths = [(k + 1) * (k + 2) for k in size]

    def step() -> None:
        def parts(batch: pa.RecordBatch) -> np.ndarray:
            z = model.columns(views(batch, names))
            y, free = label_of(batch)
            out = []
            for view in (0, 1):
                from_other = np.where(free, model.labels_by(1 - view, z), np.nan) if model.taught else np.full(len(y), np.nan)
                out.append(newton_parts(z[view], np.where(np.isnan(y), from_other, y), model.weights[view]))
            return np.concatenate(out)

        sums = summed(rows, sum(widths), parts)
        model.weights = [newton_step(sums[: widths[0]], model.weights[0]), newton_step(sums[widths[0] :], model.weights[1])]

    def surest(batch: pa.RecordBatch) -> np.ndarray:
        z = model.columns(views(batch, names))
        _, free = label_of(batch)
        out = [np.array([free.sum()], float)]
        for view in (0, 1):
            open_ = free & np.isnan(model.labels_by(view, z))
            out.append(np.histogram(log_odds(z[view][open_], model.weights[view]), BINS, (-MOST_ODDS, MOST_ODDS))[0].astype(float))
        return np.concatenate(out)

    held, truth = calibration_rows(rows, names)

    def learn() -> None:
        """Both views anew from zero, from where Newton steps do not overshoot."""
        model.weights = [np.zeros(k + 1) for k in size]
        for _ in range(STEPS):
            step()

    learn()
    for _ in range(rounds):
        curves = curves_of(model, held, truth)
        histograms = summed(rows, 1 + 2 * BINS, surest)
        free = histograms[0]
        marks = [bounds(histograms[1 + v * BINS : 1 + (v + 1) * BINS], curves[v], free, good / (good + bad), share, sure) for v in (0, 1)]
        if all(np.isinf(x) for mark in marks for x in mark):
            break  # nothing is sure enough any more
        model.taught.append((list(model.weights), marks))
        learn()
    model.curves = curves_of(model, held, truth)
    told = [a + b * log_odds(z, w) for z, w, (a, b) in zip(model.columns(held), model.weights, model.curves)]
    model.both = fit_small(np.column_stack([np.ones(len(truth)), *told]), truth, 0.1)
    return model


def calibration_rows(rows: DataFrame, names: int = NAMES) -> tuple[list[np.ndarray], np.ndarray]:
    """Views and labels of a bounded sample of the held labelled rows (of all labelled rows where those are of one class)."""
    known = rows.where("y is not null").withColumn("h", F.xxhash64(F.lit("calibration"), F.col("doc_id")))
    for chosen in (known.where("held"), known):
        sample = chosen.orderBy("h", "doc_id", "content", "lang", "source", "size").limit(MOST_CALIBRATION).toArrow()
        y = sample.column("y").to_numpy()
        if len(set(y)) == 2:
            break
    return views(sample.combine_chunks().to_batches()[0], names), y


def curves_of(model: CoTrained, held: list[np.ndarray], truth: np.ndarray) -> list[tuple[float, float]]:
    """For each view, the log odds of label 1 as a line of its own log odds."""
    return [tuple(fit_small(np.column_stack([np.ones(len(truth)), log_odds(z, w)]), truth, 0.1)) for z, w in zip(model.columns(held), model.weights)]


def held_out(doc_id: Column) -> Column:
    """A fifth of the documents, of which no label is read."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5) == 0


def labelled(docs: DataFrame, labels: DataFrame, own: dict[tuple[str, str | None], int]) -> DataFrame:
    """A stored table of all documents' measures with y (0, 1 or null; null where held out) and held (a fifth of the labelled rows, for calibration)."""
    known = labels.where("quality in (0, 1)").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").cast("double").alias("y"))
    joined = measured(docs, own).join(known, "doc_id", "left")
    held = F.col("y").isNotNull() & (F.pmod(F.xxhash64(F.lit("fold"), F.col("doc_id")), F.lit(5)) == 0)
    return stored(joined.withColumn("held", held))


def score(docs: DataFrame, labels: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: better), predicted (1 from 0.5) and kept of every document."""
    own, names = name_columns(docs)
    rows = labelled(docs.select("doc_id", "text", "lang", "source", "n_chars"), labels.select("doc_id", "quality"), own)
    model = fit(rows, rounds, names=names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = model.score(views(batch, names)) if model else np.full(batch.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p)], names=["doc_id", "score"])

    scored = rows.mapInArrow(work, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
    good = F.col("score") >= 0.5
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", good.cast("int").alias("predicted"), good.alias("kept"))
