"""Folds of rows in order, one state a key, with bounded memory."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame

#: Rows given out at once.
BATCH = 5_000


def ordered_fold(rows: DataFrame, keys: list[str], order: list[str | Column], start: Callable[[], object], step: Callable[[object, dict], tuple[object, dict | None]], schema: str) -> DataFrame:
    """What a step makes of each row, given the state that the rows of its key before it have left.

    Rows are dealt out by key and sorted by key and order on Spark's side; a task streams through them and holds the
    state of one key and a batch of results, so that a key of any number of rows needs no memory for them. ``step``
    returns the next state and a row of the schema, or None for no row. Keys and order must tell all rows apart, but for
    those alike in all columns.
    """
    names = rows.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state, out = None, None, []
        for batch in batches:
            for row in batch.to_pylist():
                key = tuple(row[k] for k in keys)
                if key != held:
                    held, state = key, start()
                state, made = step(state, row)
                if made is not None:
                    out.append(made)
            while len(out) >= BATCH:
                yield pa.RecordBatch.from_pylist(out[:BATCH], kind)
                out = out[BATCH:]
        yield pa.RecordBatch.from_pylist(out, kind)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    kind = to_arrow_schema(_parse_datatype_string(schema))
    return rows.select(*names).repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(work, schema)
