"""Document quality by histogram gradient-boosted trees over statistics of the whole text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeweave.llm.common import column
from lakeweave.llm.learn import Trees, boost, held_out, labelled_sample
from lakeweave.llm.words import Words, slices, split_words, sums_by_span

#: Signs that are counted one by one.
SIGNS = b"\n.,!?;:|#*&$%@<>{}[]()/\\_-+=~^\"'`"
CLASSES = ("lower", "upper", "digit", "space", "high", "control", "other")
FEATURES = (*(f"byte_{c}" for c in CLASSES), *(f"sign_{s}" for s in SIGNS), "log_bytes", "log_words", "word_length", "distinct_words", "top_word", "distinct_pairs", "capital_words", "sign_words", "log_lines", "words_a_line", "distinct_lines", "top_line")


def _byte_classes() -> np.ndarray:
    of = np.full(256, CLASSES.index("other"), np.int64)
    for b in range(256):
        of[b] = CLASSES.index("lower" if 97 <= b < 123 else "upper" if 65 <= b < 91 else "digit" if 48 <= b < 58 else "space" if b == 32 else "high" if b > 127 else "control" if b < 32 or b == 127 else "other")
    for i, s in enumerate(SIGNS):
        of[s] = len(CLASSES) + i
    return of


BYTE_CLASS = _byte_classes()


def _distinct_and_top(w: Words, codes: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Share of distinct codes in each text, and of the most frequent one; 1 and 0 for texts without any."""
    n = np.diff(w.ends, prepend=0)
    text = np.repeat(np.arange(len(n)), n)
    key, times = np.unique(text * span + codes, return_counts=True)
    owner = key // span
    top = np.zeros(len(n))
    np.maximum.at(top, owner, times)
    return np.where(n > 0, np.bincount(owner, minlength=len(n)) / np.maximum(n, 1), 1.0), top / np.maximum(n, 1)


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of ``FEATURES`` for each text, over all of its bytes, words and lines; null counts as empty."""
    texts = pc.fill_null(texts, "")
    size = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    n = len(size)
    data = np.frombuffer(b"".join(x.as_buffer() or b"" for x in texts.cast(pa.binary())), np.uint8)
    k = len(CLASSES) + len(SIGNS)
    counts = np.bincount(np.repeat(np.arange(n) * k, size) + BYTE_CLASS[data], minlength=n * k).reshape(n, k)
    shares = counts / np.maximum(size, 1)[:, None]
    w = split_words(texts)
    words = np.diff(w.ends, prepend=0)
    length = np.array([len(x) for x in w.distinct], np.int64)
    capital = np.array([x.isupper() and len(x) > 1 for x in w.distinct], np.int64)
    signs = np.array([not x[-1].isalnum() for x in w.distinct], np.int64)
    per_word = [sums_by_span(v[w.codes] if len(v) else np.zeros(0, np.int64), w.ends) / np.maximum(words, 1) for v in (length, capital, signs)]
    codes = w.codes.astype(np.int64)
    distinct, top = _distinct_and_top(w, codes, len(w.distinct) + 1)
    follow = np.concatenate([codes[1:], [0]]) if len(codes) else codes
    pairs, _ = _distinct_and_top(w, (codes * 1_000_003 + follow) % 2_147_483_647, 2_147_483_647)
    lines = split_words(texts, "\n")
    n_lines = np.diff(lines.ends, prepend=0)
    line_distinct, line_top = _distinct_and_top(lines, lines.codes.astype(np.int64), len(lines.distinct) + 1)
    rest = [np.log1p(size), np.log1p(words), per_word[0], distinct, top, pairs, per_word[1], per_word[2], np.log1p(n_lines), words / np.maximum(n_lines, 1), line_distinct, line_top]
    return np.concatenate([shares, np.stack(rest, axis=1)], axis=1)


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", modulus: int = 4, remainder: int = 2, most: int = 20_000) -> Trees:
    """Trees fitted on at most ``most`` labelled documents; only their statistics reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most_bytes=4 << 20):
            x = statistics(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "label", "x"])

    got = labelled_sample(docs, labels, label, modulus, remainder, most).mapInArrow(run, "doc_id long, label double, x array<double>").toArrow().sort_by("doc_id")
    x = np.array(got.column("x").to_pylist(), float).reshape(-1, len(FEATURES))
    return boost(x, got.column("label").to_numpy())


def score_quality(docs: DataFrame, trees: Trees, modulus: int = 4, remainder: int = 2, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of every whole text.

    The score uses statistics of the text alone. Null and empty texts have those of no bytes and
    get a score too; without labels of both kinds every score is the share of label 1 (0.5
    without any). Repeated rows give repeated results; an empty table
    gives none; other columns are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most_bytes=4 << 20):
            score = trees.score(statistics(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(column(id_col).cast("long").alias("doc_id"), held_out(id_col, modulus, remainder).alias("held_out"), column(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
