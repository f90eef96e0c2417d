"""Writing rows to a store outside, in batches, with retries and a report."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame

REPORT = "first_key string, n_rows int, attempts int, error string"


class Store(Protocol):
    """A store that takes rows by key; writing a row again replaces it, so a batch may be tried again."""

    def upsert(self, rows: list[dict]) -> None: ...


def upsert_batches(rows: DataFrame, key: str, connect: Callable[[], Store], size: int = 64, most: int = 3, wait: float = 0.5) -> DataFrame:
    """Hands rows to a store in batches and tells of each: first_key, n_rows, attempts, error (null if it went through).

    connect is called once a task, on the executor. A batch that fails is tried `most` times, after ever longer waits; what
    fails every time comes out with its error and doesn't stop the others. The report has to be read once, for reading
    it does the writing; a task that is repeated writes its rows again, which replaces them. Null keys are handed on as they are.
    """
    at = rows.columns.index(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = None
        for batch in batches:
            for begin in range(0, batch.num_rows, size):
                part, error = batch.slice(begin, size), None
                for attempt in range(1, most + 1):
                    try:
                        store = store or connect()
                        store.upsert(part.to_pylist())
                        error = None
                        break
                    except Exception as e:  # noqa: BLE001
                        error, store = str(e), None
                        if attempt < most:
                            time.sleep(wait * 2 ** (attempt - 1))
                first = part.column(at)[0].as_py()
                yield pa.RecordBatch.from_arrays([pa.array([None if first is None else str(first)], pa.string()), pa.array([part.num_rows], pa.int32()), pa.array([attempt], pa.int32()), pa.array([error], pa.string())], [c.split()[0] for c in REPORT.split(", ")])

    return rows.mapInArrow(run, REPORT)
