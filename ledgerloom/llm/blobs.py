"""Fixed-size summaries of a whole column (counters, bit filters), added up in a tree of small merges."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..session import staged

#: Arrays that one task of a merging round gets: what a task reads doesn't grow with the number of input tasks.
FAN_IN = 32


def packed(own: np.ndarray) -> bytes:
    return zlib.compress(own.tobytes(), 1)


def merged(parts: DataFrame, join: Callable[[np.ndarray, np.ndarray], np.ndarray], slots: int, kind: type) -> np.ndarray:
    """The arrays of ``parts`` (b binary, one row per task, ``packed``) joined to one, which alone reaches the driver."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for b in batches:
            for x in b.column(0):
                got = np.frombuffer(zlib.decompress(x.as_buffer()), dtype=kind)
                own = got if own is None else join(own, got)
        if own is not None:
            yield pa.RecordBatch.from_arrays([pa.array([packed(own)], pa.binary())], ["b"])

    n = parts.count()
    while n > FAN_IN:
        n = -(-n // FAN_IN)
        parts = parts.repartition(n).mapInArrow(merge, "b binary")
    one = parts.repartition(1).mapInArrow(merge, "b binary").collect()
    return np.frombuffer(zlib.decompress(one[0]["b"]), dtype=kind) if one else np.zeros(slots, dtype=kind)


def ored(df: DataFrame, update: Callable[[np.ndarray, pa.RecordBatch], None], slots: int) -> np.ndarray:
    """A bit filter of ``slots`` int64 words: ``update`` marks each batch in its task's filter, then all are joined bit by bit."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(slots, dtype=np.int64)
        for b in batches:
            update(own, b)
        yield pa.RecordBatch.from_arrays([pa.array([packed(own)], pa.binary())], ["b"])

    return merged(staged(df.mapInArrow(make, "b binary"), "filters"), np.bitwise_or, slots, np.int64)
