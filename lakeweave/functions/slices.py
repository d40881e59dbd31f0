"""Arrow batches in slices. What Python makes of a page is many times its size: only some pages at a time may lie there, however many a batch has."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

#: Bytes of text, or about as much in nodes, that a slice holds besides its first row; each row counts for ROW more, each element of a list for ELEMENT.
MOST, ROW, ELEMENT = 1 << 19, 64, 64


def _weights(column: pa.Array) -> np.ndarray:
    if pa.types.is_list(column.type):
        return pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64) * ELEMENT
    if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.zeros(len(column), np.int64)


def in_slices(*columns: pa.Array) -> Iterator[tuple[pa.Array, ...]]:
    """The columns, as long as each other, cut into slices of about ``MOST`` bytes with at least a row each."""
    n = len(columns[0])
    part = np.cumsum(sum((_weights(c) for c in columns), np.full(n, ROW, np.int64))) // MOST
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), n]
    for a, b in zip(edges, edges[1:], strict=False):
        if b > a:
            yield tuple(c.slice(a, b - a) for c in columns)


def by_slices(make: Callable[..., pa.Array], kind: object) -> Callable:
    """A column function that makes one array of arrays as long as it, slice by slice."""

    def one(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            for part in in_slices(column):
                yield make(*part)

    def several(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for columns in batches:
            for part in in_slices(*columns):
                yield make(*part)

    return F.arrow_udf(one if make.__code__.co_argcount == 1 else several, kind)
