"""Folds: states that read the rows of each key in order, for what windows can't express.

Rows are dealt by key, sorted, and pass through a task a batch at a time, so a task holds a batch and the states, not a
day. Several states read the same rows in one pass.
"""

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tickforge.functions.frames import DAY
from tickforge.functions.tables import dealt


def _segments(keys: list[list]) -> Iterator[tuple[tuple, int, int]]:
    """(key, begin, end) of the runs of equal keys."""
    rows = list(zip(*keys, strict=True))
    at = 0
    for i in range(1, len(rows) + 1):
        if i == len(rows) or rows[i] != rows[at]:
            yield rows[at], at, i
            at = i


def fold(rows: DataFrame, states: list[Callable], keys: tuple[str, ...] = DAY, order: str = "seq", placed: bool = False) -> DataFrame:
    """The rows with the columns of the states.

    `placed`: rows come out of windows by `keys`, so that those of a key are in one partition. A state is made anew for each key. It has `fields`, its columns, and is called with a batch (and the columns
    of the states before it, by name), giving its columns as Arrow arrays."""
    fields = [f for s in states for f in s.fields]
    names = [*rows.columns, *(f.name for f in fields)]
    schema = T.StructType([*rows.schema.fields, *fields])
    at = [rows.columns.index(k) for k in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for key, a, b in _segments([batch.column(i).to_pylist() for i in at]) if batch.num_rows else ():
                if key != now or not held:
                    now, held = key, [make() for make in states]
                part = batch.slice(a, b - a)
                given = dict(zip(part.schema.names, part.columns, strict=True))
                for state in held:
                    given |= state(given)
                yield pa.RecordBatch.from_arrays([given[n] for n in names], names=names)

    return (rows if placed else dealt(rows, keys)).sortWithinPartitions(*keys, order).mapInArrow(run, schema)
