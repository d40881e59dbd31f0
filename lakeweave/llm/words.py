"""Words of a batch of texts as arrays: each distinct word once, and a code for each occurrence."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


@dataclass
class Words:
    """``distinct[codes[ends[i - 1]:ends[i]]]`` are the words of text i."""

    distinct: list[str]
    codes: np.ndarray
    ends: np.ndarray

    @property
    def starts(self) -> np.ndarray:
        return np.concatenate([[0], self.ends[:-1]]).astype(np.int64)


def split_words(texts: pa.Array, sep: str | None = None) -> Words:
    """Split on runs of Unicode white space, or at every single ``sep``. Null counts as empty."""
    texts = pc.fill_null(texts, "")
    if sep is None:
        parts = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(texts))
        # an empty text splits into one empty word
        parts = pc.if_else(pc.equal(pc.binary_length(pc.utf8_trim_whitespace(texts)), 0), pa.scalar([], parts.type), parts)
    else:
        parts = pc.split_pattern(texts, sep)
    parts = parts.combine_chunks() if isinstance(parts, pa.ChunkedArray) else parts
    coded = pc.dictionary_encode(parts.flatten())
    ends = np.cumsum(pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64))
    return Words(coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False), ends)


def slices(batches: Iterator[pa.RecordBatch], text_col: str = "text", most_bytes: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in pieces of about ``most_bytes`` of text, at least a row each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(text_col)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        share = np.cumsum(size) // most_bytes
        cuts = np.flatnonzero(np.diff(share)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            yield batch.slice(a, b - a)


def span_index(first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The numbers first[0], first[0] + 1, ... of every span, one after another."""
    total = int(length.sum())
    before = np.cumsum(length) - length
    return np.arange(total, dtype=np.int64) + np.repeat(first - before, length)


def sums_by_span(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sum of ``values`` in each of the consecutive spans that end at ``ends``; 0 for empty ones."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64 if values.dtype.kind in "iub" else np.float64)])
    return total[ends] - total[np.concatenate([[0], ends[:-1]]).astype(np.int64)]
