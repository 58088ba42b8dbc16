"""Helpers that several operators share."""

from __future__ import annotations

import sys
from collections.abc import Callable, Hashable, Iterator
from types import ModuleType

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

ROWS_AT_ONCE = 256
BYTES_AT_ONCE = 16 << 20


def kept_in_worker(name: Hashable, make: Callable):
    """What ``make`` returns, made once per Python worker and kept for its later tasks.

    Code sent with the plan is new in every task, so the value hangs on a module
    of the process.  It must not depend on the data, or only as a memo.
    """
    memo = sys.modules.setdefault("tallyframe_worker", ModuleType("tallyframe_worker")).__dict__
    if name not in memo:
        memo[name] = make()
    return memo[name]


def slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that a slice holds few rows and, but for one long row, few bytes."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = total = 0
    for row, size in enumerate(sizes):
        if row > start and (row - start >= ROWS_AT_ONCE or total + size > BYTES_AT_ONCE):
            yield batch.slice(start, row - start)
            start, total = row, 0
        total += size
    if batch.num_rows > start:
        yield batch.slice(start)


def map_texts(
    docs: DataFrame, column: str, make: Callable[[], Callable], schema: str, keep: list[str],
) -> DataFrame:
    """Run a function over the texts of each task and append its columns to ``keep``.

    ``make()`` is called once per task and returns a function from a list of
    texts (or nulls) to one list per column of ``schema``.  No other column
    reaches Python, so further columns of ``docs`` may have any name.
    """
    added = StructType.fromDDL(schema)
    types = list(to_arrow_schema(added).types)
    narrow = docs.select(*[docs[c] for c in keep], docs[column].cast("string").alias("__text"))
    result = StructType([*narrow.schema.fields[:-1], *added.fields])

    def run(batches):
        work = make()
        for batch in batches:
            for part in slices(batch, "__text"):
                made = work(part.column("__text").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(i) for i in range(len(keep))]
                    + [pa.array(values, kind) for values, kind in zip(made, types)],
                    names=result.fieldNames(),
                )

    return narrow.mapInArrow(run, result)
