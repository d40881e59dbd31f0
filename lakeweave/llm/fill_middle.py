"""Fill-in-the-middle: two drawn cuts between units of a text, and its three parts put in another order."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeweave.llm.common import column
from lakeweave.llm.words import slices

#: A run of ASCII letters, or any other single sign. Nothing is given back, so a match keeps no states.
UNITS = regex.compile(r"([A-Za-z]++|[^A-Za-z])*+")
LETTERS = regex.compile(r"[A-Za-z]*+")
MARKS = ("<P>", "<S>", "<M>")
#: Texts of more code points are matched a stretch at a time, each of which ends with a unit: a match's list of ends takes some 40 bytes a unit.
STRETCH = 1 << 20


def unit_ends(text: str, stretch: int = STRETCH) -> np.ndarray:
    """Where each unit of the text ends: the repetitions that one full match of ``(unit)*`` has captured."""
    ends, at = [], 0
    while at < len(text):
        stop = LETTERS.match(text, min(at + stretch, len(text))).end()
        ends.append(np.array(UNITS.fullmatch(text, at, stop).ends(1), np.int64))
        at = stop
    return np.concatenate(ends) if ends else np.zeros(0, np.int64)


def draws(doc_id: int | None, seed: int) -> tuple[int, int, int, int]:
    """Four numbers of 32 bits that seed and id decide; a null id counts as the empty text."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))


def moved(text: str, doc_id: int | None, seed: int, plain_share: int, spm_share: int) -> tuple[int, str, int | None, int | None, str]:
    """Number of units, form, code points of prefix and middle (null for plain ones), and the text in its new order."""
    ends = unit_ends(text)
    n = len(ends)
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not text or any(m in text for m in MARKS) or h3 % 100 >= 100 - plain_share:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = (int(ends[k - 1]) if k else 0 for k in (a, b))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    spm = h4 % 100 < spm_share
    out = f"<S>{suffix}<P>{prefix}<M>{middle}" if spm else f"<P>{prefix}<S>{suffix}<M>{middle}"
    return n, "spm" if spm else "psm", a, b - a, out


def fill_in_middle(docs: DataFrame, seed: int = 1, plain_share: int = 10, spm_share: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars and output of every whole text. Map-only.

    Of the texts ``plain_share`` in a hundred stay plain, as do empty ones and those that hold a
    mark; of the others ``spm_share`` in a hundred begin with the suffix. Null text counts as
    empty, a null id as the empty text in the draw. Rows with one id have the same draws; repeated
    rows give repeated results. An empty table gives no rows; other columns are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
        for batch in slices(batches):
            ids = batch.column("doc_id").to_pylist()
            rows = [(i, *moved(t.as_py() or "", i, seed, plain_share, spm_share)) for i, t in zip(ids, batch.column("text"), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    rows = docs.select(column(id_col).cast("long").alias("doc_id"), column(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that ``fill_in_middle`` had, from its output and form alone. Texts that are not plain hold no mark, so the marks found are the three put in."""
    parts = F.split(output, "<[PSM]>", -1)
    return F.when(form == "plain", output).when(form == "psm", F.concat(parts[1], parts[3], parts[2])).when(form == "spm", F.concat(parts[2], parts[3], parts[1]))


def middle_digests(docs: DataFrame, **options: object) -> DataFrame:
    """``fill_in_middle`` with the SHA-256 of output and restored text in place of the text."""
    rows = fill_in_middle(docs, **options)
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))
