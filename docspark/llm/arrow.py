"""Helpers for ``mapInArrow`` passes: sub-batches of bounded size and column replacement."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import SparkSession

# Workers live on between tasks; the system's allocator gives a batch's buffers back when it is done, Arrow's own keeps them.
pa.set_memory_pool(pa.system_memory_pool())


#: What operators keep between the tasks of a worker: how to free it, by operator.
caches: dict[str, Callable[[], None]] = {}


def pieces(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 1 << 20, keep: str | None = None) -> Iterator[pa.RecordBatch]:
    """Zero-copy slices of the batches whose ``column`` holds at most ``max_bytes`` (or one row).

    A worker that turns to another operator frees the caches of all but ``keep``.
    """
    for name in [x for x in caches if x != keep]:
        caches.pop(name)()
    for batch in batches:
        values = batch.column(column)
        n = batch.num_rows
        if not n or values.nbytes <= max_bytes:
            if n:
                yield batch
            continue
        start = held = 0
        sizes = pa.compute.binary_length(values).fill_null(0).to_pylist()
        for row, size in enumerate(sizes):
            if row > start and held + size > max_bytes:
                yield batch.slice(start, row - start)
                start, held = row, 0
            held += size
        yield batch.slice(start)
    _give_back()


def _give_back() -> None:
    """Hand what the worker has freed back to the system: it may wait long for its next task, beside others."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc
    if trim is not None:
        trim(0)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let Spark send whole texts by ``rows`` at once, unless the session names a number itself: Spark bounds a batch by rows only."""
    if spark.conf.get(_ROWS) == "10000":
        spark.conf.set(_ROWS, str(rows))


_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def put(batch: pa.RecordBatch, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    """``batch`` with ``columns`` added behind; those of the same name are replaced."""
    kept = [n for n in batch.schema.names if n not in columns]
    return pa.RecordBatch.from_arrays([batch.column(n) for n in kept] + list(columns.values()), kept + list(columns))


def extended(df, columns: dict[str, str]) -> str:
    """The DDL schema of ``df`` after :func:`put`."""
    kept = [f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name not in columns]
    return ", ".join(kept + [f"{n} {t}" for n, t in columns.items()])
