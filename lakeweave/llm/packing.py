"""Packing of token documents into sequences: a linear grouping scheme with a final best fit."""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeweave.llm.common import column, gapless_rank, written
from lakeweave.llm.words import slices, span_index, sums_by_span

CAPACITY = 2048
MOST_KEPT = 250_000
#: What the vocabulary's own splitting pattern finds in lower-case ASCII text.
ASCII_UNIT = r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^ a-z0-9]+"
ASCII_BLANK = "[\\t\\n\\v\\f\\r]"
TAIL = re.compile(r"[!-&(-/:-@\[-`{-~]+\Z")


class WordIds:
    """Ids of space-free words by the tokenizers library, which sees each distinct unit once per worker.

    The vocabulary drops white space and never joins across it, so words stand for themselves.
    ASCII words are cut further as the vocabulary's pattern cuts them; of others the signs at the
    end, where what is left is letters only. When the vocabulary is read, cut words of all pairs
    of ASCII signs, with and without an apostrophe between, are compared with whole ones; if any
    differ, no word is cut.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        vocab = self.library.get_vocab()
        self.ends_word = np.zeros(max(vocab.values()) + 1, bool)
        self.ends_word[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.kept: dict[str, bytes] = {}
        self.cuts_hold = True
        signs = [chr(i) for i in range(128) if i != 32]
        probe = [f"{a}{between}{b}" for a in [*signs, "é", "日"] for between in ("", "'") for b in signs]
        ids, ends = self.documents(pa.array(probe), 0)
        whole = self.library.encode_batch_fast(probe, add_special_tokens=False)
        self.cuts_hold = all(ids[a : b - 1].tolist() == e.ids for a, b, e in zip([0, *ends[:-1]], ends, whole, strict=True))
        self.kept.clear()

    def units(self, words: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """The units of all words, and of each word the place of its first one and their number."""
        special = pc.match_substring(words, "<|")
        plain = pc.and_(pc.and_not(pc.string_is_ascii(words), special), self.cuts_hold)
        easy = pc.replace_substring_regex(pc.ascii_lower(words.filter(plain)), ASCII_BLANK, " ")
        parts = pc.split_pattern(pc.replace_substring_regex(easy, ASCII_UNIT, r"\0 "), " ")
        flat = parts.flatten()
        there = pc.greater(pc.binary_length(flat), 0)
        ends = np.cumsum(pc.list_value_length(parts).to_numpy(zero_copy_only=False))
        before = np.concatenate([[0], np.cumsum(there.to_numpy(zero_copy_only=False))])
        first, last = before[np.concatenate([[0], ends[:-1]]).astype(np.int64)], before[ends]
        odd: list[str] = []
        odd_counts: list[int] = []
        for word in words.filter(pc.invert(plain)).to_pylist():
            tail = TAIL.search(word) if self.cuts_hold else None
            # what the vocabulary makes of the head must be letters only: a mark would join the signs
            if tail and not word.isascii() and "<|" not in word and unicodedata.normalize("NFC", head := word[: tail.start()]).lower().isalpha():
                odd += [head, tail[0]]
                odd_counts.append(2)
            else:
                odd.append(word)
                odd_counts.append(1)
        flat = pa.concat_arrays([flat.filter(there), pa.array(odd, pa.string())])
        is_plain = plain.to_numpy(zero_copy_only=False)
        begin, count = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        begin[is_plain], count[is_plain] = first, last - first
        count[~is_plain] = odd_counts
        begin[~is_plain] = before[-1] + np.cumsum(odd_counts) - odd_counts
        return flat, begin, count

    def learn(self, units: list[str]) -> None:
        easy = [u for u in units if u.isalpha() or (u.isascii() and "<|" not in u)]  # one word for the vocabulary, with a single end mark
        for a in range(0, len(easy), 2000):
            some = easy[a : a + 2000]
            ids = np.array(self.library.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) == len(some):
                raw, cuts = ids.tobytes(), (4 * ends).tolist()
                self.kept.update(zip(some, map(raw.__getitem__, map(slice, [0, *cuts[:-1]], cuts)), strict=True))
        hard = [u for u in units if u not in self.kept]
        for u, e in zip(hard, self.library.encode_batch_fast(hard, add_special_tokens=False), strict=True):
            self.kept[u] = np.array(e.ids, "<u4").tobytes()

    def documents(self, texts: pa.Array, last_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, each text's followed by ``last_id``, and where each text ends."""
        if len(self.kept) > MOST_KEPT:
            self.kept.clear()
        parts = pc.split_pattern(pc.fill_null(texts, ""), " ")
        coded = pc.dictionary_encode(parts.flatten())
        words = coded.indices.to_numpy(zero_copy_only=False)
        ends = np.cumsum(pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64))
        flat, begin, count = self.units(coded.dictionary)
        unit = pc.dictionary_encode(flat)
        distinct = unit.dictionary.to_pylist()
        new = [u for u in distinct if u not in self.kept]
        if new:
            self.learn(new)
        table = pa.array([*map(self.kept.__getitem__, distinct), np.array([last_id], "<u4").tobytes()], pa.binary())
        length = pc.binary_length(table).to_numpy() // 4
        codes = unit.indices.to_numpy(zero_copy_only=False)[span_index(begin[words], count[words])]
        ends = np.concatenate([[0], np.cumsum(count[words])])[ends]
        codes = np.insert(codes, ends, len(table) - 1)
        ends = ends + np.arange(1, len(ends) + 1)
        ids = np.frombuffer(table.take(pa.array(codes)).buffers()[2], "<u4")
        return ids, np.cumsum(sums_by_span(length[codes], ends))


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, last_id: int = 0, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenize and cut: rows doc_id, piece, start, length, ids_crc32 and, if asked for, ids (little-endian unsigned 32-bit)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most_bytes=8 << 20):
            ids, ends = word_ids(tokenizer_path).documents(batch.column("text"), last_id)
            n = np.diff(ends, prepend=0)
            pieces = -(-n // capacity)
            row = np.repeat(np.arange(len(n)), pieces)
            piece = span_index(np.zeros(len(n), np.int64), pieces)
            start = piece * capacity
            length = np.minimum(n[row] - start, capacity)
            a = (ends - n)[row] + start
            data = memoryview(ids).cast("B")
            cuts = [data[4 * i : 4 * j] for i, j in zip(a.tolist(), (a + length).tolist(), strict=True)]
            columns = [batch.column("doc_id").take(pa.array(row)), pa.array(piece.astype("int32")), pa.array(start), pa.array(length), pa.array([zlib.crc32(x) for x in cuts], pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, *([pa.array(cuts, pa.binary())] if with_ids else [])], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids])

    rows = docs.select(column(id_col).cast("long").alias("doc_id"), column(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def _best_configurations(sizes: list[int], demand: list[int], capacity: int, most_steps: int = 600) -> list[tuple[int, dict[int, int]]]:
    """Whole numbers of bins of each configuration that cover at most the demand of a few sizes.

    The linear relaxation is solved by column generation: a bin's content that is worth most at
    the present prices, found by dynamic programming, enters the basis until none improves it.
    """
    k = len(sizes)
    columns = [np.eye(k)[i] * (capacity // sizes[i]) for i in range(k)]
    need = np.array(demand, float)
    for _ in range(most_steps):
        basis = np.array(columns).T
        price = np.linalg.solve(basis.T, np.ones(k))
        worth, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        for c in range(1, capacity + 1):  # the best content of c tokens
            worth[c], choice[c] = worth[c - 1], -1
            for i, s in enumerate(sizes):
                if s <= c and worth[c - s] + price[i] > worth[c] + 1e-12:
                    worth[c], choice[c] = worth[c - s] + price[i], i
        if worth[capacity] <= 1 + 1e-7:
            break
        column, c = np.zeros(k), capacity
        while c > 0:
            if choice[c] >= 0:
                column[choice[c]] += 1
                c -= sizes[choice[c]]
            else:
                c -= 1
        x, d = np.linalg.solve(basis, need), np.linalg.solve(basis, column)
        ratio = np.where(d > 1e-9, x / np.where(d > 1e-9, d, 1), np.inf)
        if not np.isfinite(ratio).any():
            break
        columns[int(ratio.argmin())] = column
    x = np.maximum(np.linalg.solve(np.array(columns).T, need), 0)
    return [(int(n + 1e-6), {i: int(a) for i, a in enumerate(col) if a > 0}) for n, col in zip(x, columns, strict=True) if int(n + 1e-6) > 0]


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY, n_groups: int = 48, small: float = 0.45) -> list[tuple[int, list[int]]]:
    """Bins for ``counts`` items of each length: (how many bins, lengths in each of them).

    Items over ``small`` of the capacity are dealt by size into groups of equal cardinality and
    rounded up to their group's largest; configurations of these few sizes are optimised; actual
    items take the places, largest first, so that each fits; what the whole numbers of bins leave
    over and the small items go, largest first, to the fullest bin that has room. Works on counts
    of lengths only, which ``capacity`` bounds whatever the number of documents.
    """
    counts = {s: n for s, n in counts.items() if n > 0}
    bins: list[tuple[int, list[int]]] = [(counts.pop(capacity), [capacity])] if capacity in counts else []
    large = sorted((s for s in counts if s > small * capacity), reverse=True)
    left = {s: n for s, n in counts.items() if s <= small * capacity}
    groups: list[list[list[int]]] = []  # of each group its [length, count] runs, largest first
    share = max(1, math.ceil(sum(counts[s] for s in large) / n_groups))
    room = 0
    for s in large:
        n = counts[s]
        while n:
            if not room:
                groups.append([])
                room = share
            m = min(n, room)
            groups[-1].append([s, m])
            room, n = room - m, n - m
    if groups:
        sizes = [g[0][0] for g in groups]
        merged: dict[int, list[list[int]]] = defaultdict(list)
        for g in groups:  # groups of one rounded size are one
            merged[g[0][0]] += g
        sizes = list(merged)
        runs = list(merged.values())
        for n_bins, content in _best_configurations(sizes, [sum(n for _, n in r) for r in runs], capacity):
            slots = [i for i, a in content.items() for _ in range(a)]
            while n_bins > 0:
                # the next stretch of bins whose places all get the same lengths
                used: dict[int, int] = defaultdict(int)
                lengths: list[int] = []
                for i in slots:
                    if not runs[i]:
                        continue
                    lengths.append(runs[i][0][0])
                    used[i] += 1
                if not lengths:
                    break
                m = min([n_bins, *(runs[i][0][1] // a for i, a in used.items())])
                if m == 0:  # a run too short for all of its places in one bin: fill this bin item by item
                    m, lengths = 1, []
                    for i in slots:
                        if runs[i]:
                            lengths.append(runs[i][0][0])
                            runs[i][0][1] -= 1
                            if not runs[i][0][1]:
                                runs[i].pop(0)
                else:
                    for i, a in used.items():
                        runs[i][0][1] -= m * a
                        if not runs[i][0][1]:
                            runs[i].pop(0)
                bins.append((m, lengths))
                n_bins -= m
        for r in runs:
            for s, n in r:
                left[s] = left.get(s, 0) + n
    # best fit of the rest, many equal bins at a time
    open_: dict[int, list[tuple[int, list[int]]]] = defaultdict(list)
    done = []
    for n, lengths in bins:
        open_[capacity - sum(lengths)].append((n, lengths))
    done += open_.pop(0, [])
    rooms = sorted(open_)
    for s in sorted(left, reverse=True):
        n = left[s]
        while n:
            at = next((r for r in rooms if r >= s and open_[r]), capacity)
            b, lengths = open_[at].pop() if open_[at] else (n, [])
            each = min(at // s, n)
            m = min(b, n // each)
            if b > m and lengths:
                open_[at].append((b - m, lengths))
            n -= m * each
            rest = at - each * s
            if rest:
                if rest not in rooms:
                    rooms = sorted([*rooms, rest])
                open_[rest].append((m, lengths + [s] * each))
            else:
                done.append((m, lengths + [s] * each))
    return done + [x for v in open_.values() for x in v]


def _places(bins: list[tuple[int, list[int]]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, rank after the last, first sequence, pieces in a sequence, first offset) of each stretch."""
    taken: dict[int, int] = defaultdict(int)
    out, sequence = [], 0
    for m, lengths in bins:
        offset = 0
        for s in dict.fromkeys(lengths):
            each = lengths.count(s)
            out.append((s, taken[s], taken[s] + m * each, sequence, each, offset))
            taken[s] += m * each
            offset += each * s
        sequence += m
    return out


def place_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to rows with a column length (1 to ``capacity``) and columns doc_id and piece.

    Only the counts of the at most ``capacity`` lengths reach the driver, and only the plan made
    from them is broadcast: its stretches are bounded by the capacity, not by the documents.
    Pieces of a length are numbered by salted ranks and find their places by number.
    """
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = spark.createDataFrame(_places(plan_bins(counts, capacity)), "length long, a long, b long, sequence long, each int, first_offset long")
    ranked = gapless_rank(pieces, ["length"], ["doc_id", "piece"], sum(counts.values()), "rank", per_task=100_000)
    p = F.broadcast(plan.withColumnRenamed("length", "of"))
    found = ranked.join(p, (F.col("length") == F.col("of")) & (F.col("rank") >= F.col("a")) & (F.col("rank") < F.col("b")))
    k = F.col("rank") - F.col("a")
    return found.withColumn("sequence_id", F.col("sequence") + F.floor(k / F.col("each"))).withColumn("offset", F.col("first_offset") + k % F.col("each") * F.col("length")).drop("of", "a", "b", "sequence", "each", "first_offset", "rank")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, last_id: int = 0, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack all documents into as few sequences of at most ``capacity`` tokens as the scheme finds.

    Returns per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and the ids
    themselves if asked for. Only documents over the capacity are cut. Null and empty texts are
    the single ``last_id``; repeated rows are packed each; an empty table gives no rows; other
    columns are not looked at.
    """
    pieces = written(token_pieces(docs, tokenizer_path, capacity, last_id, with_ids, id_col, text_col), "pieces")
    placed = place_pieces(pieces, capacity)
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *(["ids"] if with_ids else []))
