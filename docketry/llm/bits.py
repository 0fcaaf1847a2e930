"""A fixed table of bits about a set of 64-bit keys, small enough to be sent to every task.

It tells for sure which keys are not in the set.  Its size is ``1 << BITS`` bits, 4 MB,
whatever the set's; as it fills up it lets more keys pass that the join after it then
drops, so it saves shuffling and never changes a result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from docketry.llm.text import frugal, mix

BITS = 25
_PIECE = 1 << 19


def _place(keys: np.ndarray) -> np.ndarray:
    return (mix(keys.astype(np.int64).view(np.uint64)) >> np.uint64(64 - BITS)).astype(np.int64)


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.record_batch([pa.array(np.unique(_place(batch.column(0).to_numpy())))], names=["place"])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The table of a partition's places, in pieces of 64 kB."""
    table = np.zeros(1 << BITS, dtype=bool)
    for batch in batches:
        table[batch.column(0).to_numpy()] = True
    for k in range(0, 1 << BITS, _PIECE):
        if table[k : k + _PIECE].any():
            yield pa.record_batch([pa.array([k >> 3]), pa.array([np.packbits(table[k : k + _PIECE]).tobytes()], pa.binary())], names=["at", "bits"])


def table_of(keys: DataFrame) -> np.ndarray:
    """The table of a one-column frame of longs without nulls."""
    table = np.zeros(1 << BITS >> 3, dtype=np.uint8)
    # no more places than bits, whatever the keys' number; at most 64 pieces from each of at most 8 partitions
    places = keys.mapInArrow(frugal(_places), "place long").distinct()
    for r in places.coalesce(8).mapInArrow(frugal(_pieces), "at long, bits binary").toLocalIterator():
        part = np.frombuffer(bytes(r["bits"]), np.uint8)
        table[r["at"] : r["at"] + len(part)] |= part
    return table


def may_have(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """False for keys that are not in the set."""
    at = _place(keys)
    return (table[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
