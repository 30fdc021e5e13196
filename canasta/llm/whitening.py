"""Embedding whitening by hierarchical merging of singular value decompositions.

Entries are put on an integer grid, ``floor(GRID * entry)``. Each task folds its
vectors, block by block, into a summary: how many, their exact sums, the singular
values and the right singular vectors of their deviations from their mean. Two
summaries merge by decomposing both sets of scaled vectors stacked over one row
that corrects for the difference of the means; all dimensions are kept at every
merge, so that nothing but rounding is lost. Merges run in groups of 32
summaries until one is left, whose squared singular values over the count are the
eigenvalues of the covariance. A summary is of the size of the dimensions squared,
whatever the rows, and the vectors themselves never move.

A vector is whitened by projecting its deviation from the mean on the components
and dividing by the root of their eigenvalues. How far the whitened vectors'
covariance is from the identity is measured in a pass of its own, by merging
centred products.

Defined results: vectors that are null, hold a null or an entry that is not
finite are dropped, and so are those of another length than most vectors have
(ties: the longer; empty vectors are of length 0); entries beyond ``MOST_ENTRY``
count as that; repeated rows and rows that share an id count each for itself and
null ids stay; components whose eigenvalue is under ``LEAST_SHARE`` of the trace,
as those of constant dimensions or single vectors, are left out; an exact
deviation that no long holds is null; an empty table gives an empty result; extra
columns stay out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fan_in

GRID = 1024
MOST_ENTRY = float(1 << 40)
#: Vectors folded into a summary at once.
BLOCK = 2_048
LEAST_SHARE = 1e-12


@dataclass
class Summary:
    """How many vectors, their sums, and the scaled right singular vectors of their deviations from the mean."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def decomposed(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Singular values and right singular vectors, all that the rows have."""
    _, values, vectors = np.linalg.svd(rows, full_matrices=False)
    return values, vectors


def summary(x: np.ndarray) -> Summary:
    """The summary of integer vectors."""
    sums = [int(s) for s in x.sum(axis=0, dtype=np.int64)]
    return Summary(len(x), sums, *decomposed(x - np.array([s / len(x) for s in sums])))


def merged(one: Summary | None, other: Summary | None) -> Summary | None:
    """Both summaries as one, with a row that corrects for their means."""
    if one is None or other is None:
        return one or other
    correction = np.sqrt(one.n / (one.n + other.n) * other.n) * (one.mean - other.mean)
    stacked = np.vstack([one.values[:, None] * one.vectors, other.values[:, None] * other.vectors, correction])
    return Summary(one.n + other.n, [a + b for a, b in zip(one.sums, other.sums)], *decomposed(stacked))


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its entries are finite."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return vector.isNotNull() & ~bad


def vectors_of(df: DataFrame, vector: str) -> tuple[DataFrame, int]:
    """The usable vectors of the commonest length, as column ``_v`` of doubles beside the others, and that length."""
    found = df.where(usable(F.col(f"`{vector}`")))
    lengths = found.groupBy(F.size(f"`{vector}`").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    width = lengths[0]["d"] if lengths else 0
    return found.where(F.size(f"`{vector}`") == width).withColumn("_v", F.col(f"`{vector}`").cast("array<double>")), width


def grid(column: pa.Array, width: int) -> np.ndarray:
    """The vectors of a batch on the grid, without the origin."""
    flat = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    return np.floor(np.clip(flat * GRID, -MOST_ENTRY, MOST_ENTRY)).astype(np.int64)


def merged_over(rows: DataFrame, of_batch: Callable[[pa.RecordBatch], object], merge: Callable, pack: Callable[[object], bytes], unpack: Callable[[bytes], object]) -> object | None:
    """What the batches give, merged in each task and then in groups of tasks, in a fixed order; one state reaches the driver."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                state = merge(state, of_batch(batch.slice(at, BLOCK)))
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([pack(state)], pa.binary())], names=["key", "part", "state"])

    states = rows.mapInArrow(part, "key int, part long, state binary")
    found = fan_in(states, rows.rdd.getNumPartitions(), lambda state, data: merge(state, unpack(data)), pack).collect()  # one row
    return unpack(found[0]["state"]) if found else None


def packed(s: Summary) -> bytes:
    import pickle

    return pickle.dumps((s.n, s.sums, s.values.tobytes(), s.vectors.tobytes()))


def unpacked(data: bytes) -> Summary:
    import pickle

    n, sums, values, vectors = pickle.loads(data)
    return Summary(n, sums, np.frombuffer(values), np.frombuffer(vectors).reshape(-1, len(sums)))


@dataclass
class Whitening:
    """Mean, components (rows, by falling eigenvalue), eigenvalues and their sum over all dimensions."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float

    def whiten(self, x: np.ndarray) -> np.ndarray:
        """The whitened rows of integer vectors."""
        mean = np.array([s / self.n for s in self.sums])
        return (x - mean) @ self.components.T / np.sqrt(self.eigenvalues)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The sum over dimensions of (n x - sums) squared, exactly; null beyond a long."""
        least, most = np.array(self.sums, object).min(), np.array(self.sums, object).max()
        bound = self.n * int(np.abs(x).max(initial=0)) + max(abs(least), abs(most))
        if bound * bound * x.shape[1] < 1 << 63:
            return ((x * self.n - np.array(self.sums, np.int64)) ** 2).sum(axis=1).tolist()
        exact = [sum((self.n * v - s) ** 2 for v, s in zip(row, self.sums)) for row in x.tolist()]
        return [e if e < 1 << 63 else None for e in exact]


def fit(df: DataFrame, vector: str = "embedding") -> Whitening | None:
    """The whitening of all usable vectors; None without any of at least one dimension."""
    return fit_vectors(*vectors_of(df, vector))


def fit_vectors(vectors: DataFrame, width: int) -> Whitening | None:
    if not width:
        return None
    whole = merged_over(vectors.select("_v"), lambda batch: summary(grid(batch.column(0), width)), merged, packed, unpacked)
    if whole is None:
        return None
    eigenvalues = whole.values**2 / whole.n
    trace = float(eigenvalues.sum())
    kept = eigenvalues > LEAST_SHARE * trace
    components = whole.vectors[kept]
    largest = components[np.arange(len(components)), np.abs(components).argmax(axis=1)] if len(components) else np.ones(0)
    return Whitening(whole.n, whole.sums, components * np.sign(largest)[:, None], eigenvalues[kept], trace)


def covariance_merged(one: tuple | None, other: tuple | None) -> tuple | None:
    """Counts, means and centred products of both."""
    if one is None or other is None:
        return one or other
    (n, mean, products), (m, of, more) = one, other
    apart = of - mean
    return n + m, mean + apart * (m / (n + m)), products + more + np.outer(apart, apart) * (n / (n + m) * m)


def identity_error(vectors: DataFrame, width: int, model: Whitening, components: int) -> float:
    """The largest entry of the whitened vectors' covariance less the identity."""
    few = Whitening(model.n, model.sums, model.components[:components], model.eigenvalues[:components], model.trace)

    def of_batch(batch: pa.RecordBatch) -> tuple:
        w = few.whiten(grid(batch.column(0), width))
        mean = w.mean(axis=0)
        return len(w), mean, (w - mean).T @ (w - mean)

    def pack(state: tuple) -> bytes:
        return np.concatenate([[state[0]], state[1], state[2].ravel()]).tobytes()

    def unpack(data: bytes) -> tuple:
        found = np.frombuffer(data)
        k = len(few.eigenvalues)
        return int(found[0]), found[1 : k + 1], found[k + 1 :].reshape(k, k)

    n, _, products = merged_over(vectors.select("_v"), of_batch, covariance_merged, pack, unpack)
    return float(np.abs(products / n - np.eye(len(products))).max(initial=0.0))


def whiten(df: DataFrame, model: Whitening, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """key and whitened (array of doubles, by component) of every vector that the model takes."""
    width = len(model.sums)
    rows = df.where(usable(F.col(f"`{vector}`")) & (F.size(f"`{vector}`") == width)).select(F.col(f"`{key}`"), F.col(f"`{vector}`").cast("array<double>").alias("_v"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(at, BLOCK) for at in range(0, batch.num_rows, BLOCK)):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(model.whiten(grid(part.column(1), width))), pa.list_(pa.float64()))], names=[key, "whitened"])

    return rows.mapInArrow(work, f"`{key}` {df.schema[key].dataType.simpleString()}, whitened array<double>")


def report(df: DataFrame, vector: str = "embedding", key: str = "vec_id", components: int = 8) -> DataFrame:
    """A row for each usable vector and leading component: key, component, n, deviation, whitened, explained, identity_error."""
    fields = f"`{key}` {df.schema[key].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    vectors, width = vectors_of(df.select(F.col(f"`{key}`"), F.col(f"`{vector}`")), vector)
    model = fit_vectors(vectors, width)
    k = min(components, len(model.eigenvalues)) if model else 0
    if not k:
        return df.sparkSession.createDataFrame([], fields)
    error = identity_error(vectors, width, model, k)
    explained = model.eigenvalues[:k] / model.trace

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(at, BLOCK) for at in range(0, batch.num_rows, BLOCK)):
                x, rows = grid(part.column(1), width), part.num_rows
                at = np.repeat(np.arange(rows), k)
                deviation = pc.take(pa.array(model.deviations(x), pa.int64()), pa.array(at))
                columns = [pc.take(part.column(0), pa.array(at)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)), pa.array(np.full(rows * k, model.n)), deviation]
                columns += [pa.array(model.whiten(x)[:, :k].ravel()), pa.array(np.tile(explained, rows)), pa.array(np.full(rows * k, error))]
                yield pa.RecordBatch.from_arrays(columns, names=[key, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return vectors.select(F.col(f"`{key}`"), "_v").mapInArrow(work, fields)
