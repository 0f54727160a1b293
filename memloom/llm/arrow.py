"""Arrow-batched row functions: extra columns computed from one column of each row."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Rows whose values are Python objects at once.
ROWS = 1024
#: Values of one piece of a batch hold this many characters at most (a longer value is a piece of its own).
PIECE_CHARS = 1_000_000


def pieces(values: list, limit: int = PIECE_CHARS) -> Iterator[list]:
    """Cut a list so that each part holds about ``limit`` characters, whatever the row lengths."""
    part, n = [], 0
    for v in values:
        part.append(v)
        n += len(v)
        if n >= limit:
            yield part
            part, n = [], 0
    if part:
        yield part


def with_columns(df: DataFrame, col: str, fields: list[tuple[str, T.DataType]], make: Callable[[], Callable[[list], list[tuple]]], null: object = "", drop: bool = False) -> DataFrame:
    """``df`` plus ``fields``, which a function computes from the values of ``col``.

    ``make()`` runs once for each task and gives the function: a list of values in,
    a list of tuples (one value for each field) out. Nulls in ``col`` are passed as
    ``null``. Columns of ``df`` whose names clash with ``fields`` are replaced;
    ``drop`` leaves ``col`` itself out of the result. No shuffle, no state across tasks.
    """
    names = {n.lower() for n, _ in fields}
    kept = [f for f in df.schema.fields if f.name.lower() not in names and not (drop and f.name == col)]
    at = df.columns.index(col)
    keep = [df.columns.index(f.name) for f in kept]
    schema = T.StructType([*kept, *(T.StructField(n, t) for n, t in fields)])
    types = [to_arrow_type(t) for _, t in fields]
    out_names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for b in batches:
            start = 0
            for first in range(0, len(b), ROWS):
                values = [null if v is None else v for v in b.column(at).slice(first, ROWS).to_pylist()]
                for part in pieces(values):
                    rows = f(part)
                    cols = list(zip(*rows, strict=True)) if rows else [()] * len(types)
                    new = [pa.array(c, type=t) for c, t in zip(cols, types, strict=True)]
                    old = b.slice(start, len(part))
                    yield pa.RecordBatch.from_arrays([*(old.column(i) for i in keep), *new], names=out_names)
                    start += len(part)

    return df.mapInArrow(run, schema)
