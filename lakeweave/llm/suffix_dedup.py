"""Removal of byte strings that occur twice, found by merging Burrows-Wheeler transforms of shards."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeweave.llm.common import column, row_id, text_or_empty, written
from lakeweave.llm.words import slices

WINDOW, GRAM = 200, 64
#: Most bytes to a symbol of the transforms, and bytes that the first sort of prefixes looks at.
STEP, FIRST = 40, 5
LONGEST_RUN = 4096
#: Bytes that UTF-8 never has, between the strings of a shard.
GAP = b"\xff"

_BASE = np.uint64(0x9E3779B97F4A7C15)
_TABLE = np.random.default_rng(7).integers(0, 2**64, 256, np.uint64)


# --- transforms of shards and their merging -------------------------------------------------


def _sorted(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Stable order of keys of at most ``bits`` bits, and the keys in it."""
    low = max(1, int(len(key) - 1).bit_length())
    if bits + low > 63:
        order = np.argsort(key, kind="stable")
        return order, key[order]
    both = np.sort((key << np.int64(low)) | np.arange(len(key)))
    return both & np.int64((1 << low) - 1), both >> np.int64(low)


def _run_starts(*keys: np.ndarray) -> np.ndarray:
    """Where a new run of equal keys begins."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def _settled(new: np.ndarray) -> np.ndarray:
    """Which items are runs by themselves."""
    return new & np.append(new[1:], True)


def _doubled(order: np.ndarray, rank: np.ndarray, live: np.ndarray, ahead: Callable[[np.ndarray, int], np.ndarray], h: int, depth: int) -> None:
    """Carry an order by ``h`` leading bytes on to ``depth`` by prefix doubling, in place.

    A position's rank is the place in the order of the first position with equal bytes; ``live``
    are, in order, those that share theirs. Positions that no other one is equal to any more
    leave the doubling.
    """
    bits = max(1, int(len(rank) - 1).bit_length())
    while h < depth and len(live):
        step = min(h, depth - h)  # prefixes may overlap
        nth, key = _sorted((rank[live].astype(np.int64) << np.int64(bits)) | rank[ahead(live, step)], 2 * bits)
        live = live[nth]
        group = (key >> np.int64(bits)).astype(np.int32)
        count = np.arange(len(live), dtype=np.int32)
        slot = group + count - np.maximum.accumulate(np.where(_run_starts(group), count, 0))
        order[slot] = live
        new = _run_starts(key)
        rank[live] = slot[np.maximum.accumulate(np.where(new, count, 0))]
        live = live[~_settled(new)]
        h += step


def _ranked(order: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of positions in the order of their keys, and those that share theirs."""
    new = _run_starts(key)
    rank = np.empty(len(order), np.int32)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(len(order), dtype=np.int32), 0))
    return rank, order[~_settled(new)]


def symbols(text: np.ndarray, size: np.ndarray, step: int) -> np.ndarray:
    """Ranks of the ``step`` bytes from each position on, by byte order; ``text`` is made of circular shards of ``size`` bytes."""
    ends = np.cumsum(size)

    def ahead(x: np.ndarray, h: int) -> np.ndarray:
        y = x + h
        if len(ends) == 1:
            over = np.flatnonzero(y >= ends[0])
            of = np.zeros(len(over), np.int64)
        else:
            of = np.searchsorted(ends, x, side="right")
            over = np.flatnonzero(y >= ends[of])
            of = of[over]
        y[over] -= -(-(y[over] - ends[of] + 1) // size[of]) * size[of]
        return y

    h = min(FIRST, step)
    key = np.ndarray(len(text), ">u8", text.tobytes() + bytes(8), strides=(1,)).astype(np.int64) >> np.int64(8 * (8 - h))
    key &= np.int64((1 << 8 * h) - 1)
    tail = np.unique(np.concatenate([np.arange(max(e - n, e - h + 1), e) for e, n in zip(ends.tolist(), size.tolist(), strict=True)]).astype(np.int64))
    around = np.zeros(len(tail), np.int64)
    for j in range(h):
        around = (around << np.int64(8)) | text[ahead(tail, j)]
    key[tail] = around
    order, key = _sorted(key, 8 * h)
    rank, live = _ranked(order, key)
    _doubled(order, rank, live, ahead, h, step)
    return rank


def transform(symbol: np.ndarray, depth: int, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Of a shard whose positions' first ``step`` bytes are given as symbols: its suffixes in order, to ``depth`` bytes, and for each the place in that order of the suffix that begins ``step`` bytes earlier."""
    n = len(symbol)

    def ahead(x: np.ndarray, h: int) -> np.ndarray:
        y = x + h % n
        y[y >= n] -= n
        return y

    order, key = _sorted(symbol.astype(np.int64), max(1, int(symbol.max()).bit_length()))
    rank, live = _ranked(order, key)
    _doubled(order, rank, live, ahead, step, depth)
    place = np.empty(n, np.int32)
    place[order] = np.arange(n, dtype=np.int32)
    return order, place[ahead(order, -step)]


def merge(shard: np.ndarray, symbol: np.ndarray, earlier: np.ndarray, block: np.ndarray, interleave: np.ndarray, passes: int) -> np.ndarray:
    """Merge shards' transforms by refining their interleave; which suffixes share all their leading bytes with another.

    Suffixes are numbered shard by shard, in each shard's own order. ``symbol`` holds the bytes
    before each (as a rank), ``earlier`` the suffix that begins with these. The interleave says
    which shard each slot of the merged order comes from, ``block`` which slots share the bytes
    seen so far. A pass hands every slot its symbol, in the shard's own order, and sorts the
    slots stably by symbol: the interleave is then right to one symbol more, and block bounds are
    where common prefixes end. Slots alone in their block are settled and leave the passes. No
    suffixes are compared or sorted anew.
    """
    bits = max(1, int(len(shard)).bit_length())
    live = np.arange(len(shard))

    def drop(new: np.ndarray, live: np.ndarray, block: np.ndarray, interleave: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        stays = ~_settled(new)
        of_shard = np.argsort(interleave, kind="stable")
        return live[stays[of_shard]], block[stays], interleave[stays]

    live, block, interleave = drop(_run_starts(block), live, block, interleave)
    for _ in range(passes):
        if not len(live):
            break
        handed = np.empty(len(live), np.int64)
        handed[np.argsort(interleave, kind="stable")] = symbol[live]
        moved, head = _sorted(handed, bits)
        new = _run_starts(head, block[moved])
        mark = np.zeros(len(shard), bool)
        mark[earlier[live]] = True
        live, block, interleave = drop(new, np.flatnonzero(mark), np.cumsum(new), interleave[moved])
    found = np.zeros(len(shard), bool)
    found[live] = True
    return found


def repeated_starts(strings: list[bytes], window: int = WINDOW, shard_bytes: int = 1 << 19) -> tuple[np.ndarray, np.ndarray]:
    """For every byte of the strings, one after another with a gap behind each, whether the ``window`` bytes from there also start elsewhere in any string; and where each string begins.

    Flags of a string's last ``window`` - 1 bytes say nothing. Strings are dealt to shards of
    about ``shard_bytes``, at most 255; each is transformed by itself and the transforms are merged.
    """
    step = next(s for s in range(min(STEP, window), 0, -1) if window % s == 0)
    size = np.array([len(s) + 1 for s in strings], np.int64)
    share = np.cumsum(size) - size
    shard_bytes = max(shard_bytes, -(-int(size.sum()) // 200))
    cuts = [0, *(np.flatnonzero(np.diff(share // shard_bytes)) + 1).tolist(), len(strings)]
    text = np.frombuffer(GAP.join([*strings, b""]), np.uint8)
    bounds = [*share[cuts[:-1]].tolist(), len(text)]
    length = np.diff(bounds)
    symbol = symbols(text, length, step)
    orders, before = [], []
    for a, b in zip(bounds, bounds[1:], strict=False):
        order, earlier = transform(symbol[a:b], window, step)
        orders.append(order + a)
        before.append(earlier + a)
    order, earlier = np.concatenate(orders), np.concatenate(before)
    shard = np.repeat(np.arange(len(length), dtype=np.uint8), length)
    head = symbol[order]
    first, key = _sorted(head.astype(np.int64), max(1, int(len(text)).bit_length()))
    live = merge(shard, head[earlier], earlier, np.cumsum(_run_starts(key)), shard[first], window // step - 1)
    found = np.zeros(len(text), bool)
    found[order[live]] = True
    return found, share


# --- runs of windows with one minimizer -----------------------------------------------------


def _powers(base: int, n: int) -> np.ndarray:
    """base**0, base**1, ... modulo 2**64."""
    out = np.full(n, np.uint64(base))
    out[0] = 1
    return np.multiply.accumulate(out)


def minimizer_runs(data: np.ndarray, ends: np.ndarray, window: int = WINDOW, gram: int = GRAM, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Cut the windows of texts (``data``, each ending at ``ends``) into runs that share the least gram hash; each ``seed`` has its own order of hashes.

    Returns start, number of windows, 40-bit minimizer, and whether the minimizer occurs more
    than once in the run. Equal windows have the same minimizer wherever they are. ``data`` has
    less than 2**24 bytes.
    """
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < window:
        return none, none, none, none.astype(bool)
    base = int(_BASE)
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_TABLE[data] * _powers(base, n))])
    hashed = (prefix[gram:] - prefix[:-gram]) * _powers(pow(base, -1, 2**64), n - gram + 1)
    hashed ^= (hashed >> np.uint64(29)) ^ np.uint64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    hashed *= np.uint64(0xBF58476D1CE4E5B9)
    hashed ^= hashed >> np.uint64(32)
    least = (hashed & ~np.uint64(0xFFFFFF)) | np.arange(len(hashed), dtype=np.uint64)  # leftmost of equal hashes
    width, have = window - gram + 1, 1
    while have < width:  # the least of the `have` from each position on
        more = min(have, width - have)
        least = np.minimum(least[:-more], least[more:])
        have += more
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    valid = np.zeros(n + 1, np.int32)
    long = ends - starts >= window
    np.add.at(valid, starts[long], 1)
    np.add.at(valid, ends[long] - window + 1, -1)
    valid = np.cumsum(valid)[: len(least)] > 0
    value = least >> np.uint64(24)
    first = valid.copy()
    first[1:] &= ~valid[:-1] | (value[1:] != value[:-1])
    first[starts[long]] = True
    at = np.flatnonzero(first)
    if not len(at):
        return none, none, none, none.astype(bool)
    last = valid.copy()
    last[:-1] &= ~valid[1:] | first[1:]
    count = np.flatnonzero(last) - at + 1
    moved = np.concatenate([[0], np.cumsum(least[1:] != least[:-1])])
    again = moved[at + count - 1] > moved[at]
    parts = -(-count // LONGEST_RUN)
    if (parts > 1).any():
        k = np.concatenate([np.arange(p) for p in parts]) * LONGEST_RUN
        count = np.minimum(np.repeat(count, parts) - k, LONGEST_RUN)
        at, again = np.repeat(at, parts) + k, np.repeat(again, parts)
    return at, count, value[at].astype(np.int64), again


RUN = "m long, c long, h long, g int, doc long, start long, n long, copies long, again boolean"
#: ``pieces`` are the runs that a string answers for, with the place of their first window in it as first cut; strings that don't ask have none.
CUT = "key long, c long, off long, times int, asks boolean, again boolean, pieces array<struct<m:long,c:long,at:long>>, bytes binary"
SPAN = "m long, c long, start long, n long"


def _batch(schema: str, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], [x.split()[0] for x in schema.split(", ")])


def _runs(window: int):
    """Map texts to rows of their runs; a text that is there several times in a batch gives its rows once, with its number."""
    limit = 1 << 20

    def flush(keys: list[tuple], texts: list[bytes]) -> pa.RecordBatch | None:
        ends = np.cumsum([len(t) for t in texts])
        whole = b"".join(texts)
        at, n, least, again = minimizer_runs(np.frombuffer(whole, np.uint8), ends, window)
        if not len(at):
            return None
        text = np.searchsorted(ends, at, side="right")
        view = memoryview(whole)
        digest = [xxhash.xxh3_64_intdigest(view[a:b]) for a, b in zip(at.tolist(), (at + n + window - 1).tolist(), strict=True)]
        h, g, doc, copies, offset = (np.array(c)[text] for c in zip(*keys, strict=True))
        start = at - np.concatenate([[0], ends[:-1]])[text] + offset
        return _batch(RUN, [least, np.array(digest, np.uint64).astype(np.int64), h, g.astype(np.int32), doc, start, n, copies, again])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most_bytes=4 << 20):
            h, g, doc = (batch.column(c).to_pylist() for c in ("h", "g", "doc"))
            met: dict[bytes, list[int]] = {}
            for i, t in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
                if len(t) >= window:
                    met.setdefault(t, []).append(i)
            keys, kept, size = [], [], 0
            for t, rows in met.items():
                for a in range(0, len(t) - window + 1, limit):  # very long texts in overlapping stretches
                    part = t[a : a + limit + window - 1]
                    keys.append((h[rows[0]], g[rows[0]], doc[rows[0]], len(rows), a))
                    kept.append(part)
                    size += len(part)
                    if size > limit:
                        if (out := flush(keys, kept)) is not None:
                            yield out
                        keys, kept, size = [], [], 0
            if kept and (out := flush(keys, kept)) is not None:
                yield out

    return run


def _cut_out(window: int, most: int):
    """Map rows of (text, runs) to strings: runs with one ``link`` that follow each other are a chain of about ``most`` windows and have their bytes in one string, others in one each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most_bytes=4 << 20):
            texts = batch.column("text").cast(pa.binary())
            runs = batch.column("runs")
            flat = runs.flatten()
            row = np.repeat(np.arange(len(runs)), pc.list_value_length(runs).to_numpy(zero_copy_only=False))
            m, c, start, n, times, asks, again = (flat.field(x).to_numpy(zero_copy_only=False) for x in ("m", "c", "start", "n", "times", "asks", "again"))
            linked = pc.is_valid(flat.field("link")).to_numpy(zero_copy_only=False)
            link = pc.fill_null(flat.field("link"), 0).to_numpy(zero_copy_only=False)
            order = np.lexsort((start, asks, row))
            row, m, c, start, n, times, asks, again, linked, link = (x[order] for x in (row, m, c, start, n, times, asks, again, linked, link))
            new = _run_starts(row, asks, link) | ~linked
            new[1:] |= start[1:] != start[:-1] + n[:-1]
            head = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
            new |= _run_starts(head, (start - start[head]) // most)
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(new))
            at = start - start[first][np.cumsum(new) - 1]
            size = start[last - 1] + n[last - 1] - start[first] + window - 1
            told = np.concatenate([[0], np.cumsum(np.where(asks, 1, 0))])
            pieces = pa.StructArray.from_arrays([pa.array(x[asks]) for x in (m, c, at)], ["m", "c", "at"])
            part = np.cumsum(size) // (4 << 20)
            edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(first)]
            for i, j in zip(edges, edges[1:], strict=False):
                own = first[i:j]
                listed = pa.ListArray.from_arrays(pa.array(told[np.append(own, last[j - 1])].astype(np.int32)), pieces)
                data = [texts[r].as_buffer().slice(a, k).to_pybytes() for r, a, k in zip(row[own].tolist(), start[own].tolist(), size[i:j].tolist(), strict=True)]
                yield _batch(CUT, [m[own], c[own], np.zeros(len(own), np.int64), times[own].astype(np.int32), asks[own], again[own], listed, pa.array(data, pa.binary())])

    return run


def _cut_again(window: int, seed: int):
    """Map strings to those of their runs under another order of gram hashes: a string's windows part where the new minimizer changes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "bytes", most_bytes=1 << 20):
            strings = batch.column("bytes").to_pylist()
            ends = np.cumsum([len(x) for x in strings])
            whole = b"".join(strings)
            at, n, least, again = minimizer_runs(np.frombuffer(whole, np.uint8), ends, window, seed=seed)
            row = np.searchsorted(ends, at, side="right")
            key, c, off, times, asks = (batch.column(x).to_numpy(zero_copy_only=False)[row] for x in ("key", "c", "off", "times", "asks"))
            with np.errstate(over="ignore"):
                key = (key * np.int64(0x2545F4914F6CDD1D)) ^ least
            off = off + at - (ends - np.diff(ends, prepend=0))[row]
            parts = [whole[a:b] for a, b in zip(at.tolist(), (at + n + window - 1).tolist(), strict=True)]
            yield _batch(CUT, [key, c, off, times.astype(np.int32), asks.astype(bool), again, batch.column("pieces").take(pa.array(row)), pa.array(parts, pa.binary())])

    return run


def _marked(window: int):
    """Of a bucket's strings: the stretches of starts whose windows occur twice in the bucket, as stretches of their runs."""

    def run(table: pa.Table) -> pa.Table:
        # a string that is there twice follows itself
        row = np.repeat(np.arange(table.num_rows), table.column("times").to_numpy())
        strings = table.column("bytes").take(pa.array(row)).to_pylist()
        found, share = repeated_starts(strings, window)
        size = np.array([len(x) for x in strings], np.int64)
        asks = table.column("asks").to_numpy(zero_copy_only=False).astype(bool)[row] & (np.diff(row, prepend=-1) > 0)
        valid = np.zeros(len(found) + 1, np.int32)
        np.add.at(valid, share[asks], 1)
        np.add.at(valid, (share + size - window + 1)[asks], -1)
        edge = np.diff(np.concatenate([[0], (found & (np.cumsum(valid)[:-1] > 0)).view(np.int8), [0]]))
        a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        of = np.searchsorted(share, a, side="right") - 1
        own = row[of].astype(np.int64)
        begin = (own << np.int64(32)) + table.column("off").to_numpy()[own] + a - share[of]
        pieces = table.column("pieces").combine_chunks()
        flat = pieces.flatten()
        m, c, at = (flat.field(x).to_numpy(zero_copy_only=False) for x in ("m", "c", "at"))
        at = at + (np.repeat(np.arange(len(pieces)), pc.list_value_length(pieces).to_numpy(zero_copy_only=False)) << np.int64(32))
        # a stretch goes to each piece that it meets
        i, j = (np.searchsorted(at, x, side="right") - 1 for x in (begin, begin + (b - a) - 1))
        met = j - i + 1
        piece = np.repeat(i - np.cumsum(met) + met, met) + np.arange(met.sum())
        until = np.minimum(np.repeat(begin + (b - a), met), np.append(at[1:], np.iinfo(np.int64).max)[piece])
        since = np.maximum(np.repeat(begin, met), at[piece])
        return pa.table({"m": m[piece], "c": c[piece], "start": since - at[piece], "n": until - since})

    return run


# --- the operator ---------------------------------------------------------------------------


def _text_key(t: Column) -> list[Column]:
    """96 bits that stand for a text."""
    return [F.xxhash64(t).alias("h"), F.hash(t).alias("g")]


def repeated_spans(docs: DataFrame, window: int = WINDOW, bucket_bytes: int = 1 << 20, rounds: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stretches of window starts that occur twice: rows h, g (see ``_text_key``), start, n.

    1. Each text's windows are cut into runs that share a minimizer, the least hash of the grams
       inside a window: equal windows meet under the same one. Runs are rows of a few numbers;
       those whose minimizer is nowhere else can't repeat and go no further.
    2. Of runs with the same minimizer and digest (104 bits together) two go on with their bytes,
       or one where there is only one; what is found for them holds for all. Runs that follow each
       other in both their texts go on as one string, where no other run has their minimizers: they
       would share all but a run's length of each string's bytes with the next.
    3. These are dealt by minimizer into buckets of about ``bucket_bytes``. In a bucket, shards
       are transformed and the transforms merged; windows whose block has two or more repeat.
    4. Strings of a minimizer that would overfill a bucket are cut again, by a second minimizer,
       and so on for ``rounds`` rounds; where that does not part them (they differ in few places),
       they are dealt to blocks, and each pair of blocks is merged in a task of its own.
    """
    t = text_or_empty(text_col)
    keyed = docs.select(*_text_key(t), row_id(id_col).alias("doc"), t.alias("text"))
    runs = written(keyed.mapInArrow(_runs(window), RUN), "runs")
    shared = runs.groupBy("m").agg(F.sum("copies").alias("copies"), F.max("again").alias("again"), (F.min("c") == F.max("c")).alias("pure")).where("copies > 1 or again").select("m", "pure")
    found = written(runs.join(written(shared, "minimizers").hint("merge"), "m"), "found")

    at = F.struct("h", "g", "doc", "start")
    strings = found.groupBy("m", "c").agg(F.min(at).alias("a"), F.max(at).alias("z"), F.sum("copies").alias("copies"), F.max("n").alias("n"), F.max("again").alias("again"), F.max("pure").alias("pure"))
    alone = F.col("a") == F.col("z")
    # equal for runs whose other string is in one text and as far away there
    link = lambda other: F.when(F.col("pure") & (F.col("copies") > 1) & ~F.col("again"), F.xxhash64(f"{other}.h", f"{other}.g", f"{other}.doc", F.col("z.start") - F.col("a.start"))).alias("link")
    first = F.struct("a.*", F.when(alone & (F.col("copies") > 1), 2).otherwise(1).alias("times"), F.lit(True).alias("asks"), link("z"))
    last = F.struct("z.*", F.lit(1).alias("times"), F.lit(False).alias("asks"), link("a"))
    taken = strings.select("m", "c", "n", "again", F.explode(F.when(alone, F.array(first)).otherwise(F.array(first, last))).alias("one"))
    wanted = taken.groupBy("one.h", "one.g", "one.doc").agg(F.collect_list(F.struct("m", "c", "one.start", "n", "one.times", "one.asks", "again", "one.link")).alias("runs"))
    texts = keyed.join(written(wanted, "wanted").hint("merge"), ["h", "g", "doc"]).dropDuplicates(["h", "g", "doc"]).select("text", "runs")
    cut = written(texts.mapInArrow(_cut_out(window, max(1, bucket_bytes // 8)), CUT), "bytes", "zstd")

    usual, blocks = None, None
    for seed in range(1, rounds + 2):
        load = cut.groupBy("key").agg(F.sum("times").alias("k"), F.max("again").alias("again"), F.sum(F.octet_length("bytes") * F.col("times")).alias("load"))
        load = written(load.where("k > 1 or again").select("key", F.ceil(F.col("load") / bucket_bytes).cast("int").alias("parts"), "load"), "load")
        part = cut.join(load.where("parts = 1").select("key").hint("merge"), "key", "left_semi")
        usual = part if usual is None else usual.unionByName(part)
        hot = load.where("parts > 1")
        if hot.isEmpty():
            break
        if seed > rounds:
            mine = F.pmod(F.xxhash64("c", "off", "asks"), F.col("parts")).cast("int")
            other = F.explode(F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda i: i != F.col("mine")))
            dealt = cut.join(hot.select("key", "parts").hint("merge"), "key").withColumn("mine", mine).withColumn("other", other)
            blocks = dealt.select(F.col("key").alias("bucket"), F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), *cut.columns)
        else:
            cut = written(cut.join(hot.select("key").hint("merge"), "key", "left_semi").mapInArrow(_cut_again(window, seed), CUT), "bytes")
    total = usual.agg(F.sum(F.octet_length("bytes") * F.col("times"))).first()[0] or 0
    buckets = max(1, math.ceil(total / bucket_bytes))
    grouped = usual.select(F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket"), F.lit(0).alias("lo"), F.lit(0).alias("hi"), *cut.columns)
    if blocks is not None:
        grouped = grouped.unionByName(blocks)
    marked = written(grouped.groupBy("bucket", "lo", "hi").applyInArrow(_marked(window), SPAN), "marked")
    own = marked.select("m", "c", F.col("start").alias("off"), F.col("n").alias("length"))
    return written(found.join(own.hint("merge"), ["m", "c"]).select("h", "g", (F.col("start") + F.col("off")).alias("start"), F.col("length").alias("n")), "spans")


def merged_spans(spans: list[dict] | None, window: int, most: int) -> list[tuple[int, int]]:
    """Byte stretches (from, to) that the windows cover, apart and in order."""
    out: list[list[int]] = []
    for a, n in sorted((s["start"], s["n"]) for s in spans or ()):
        b = min(a + n - 1 + window, most)
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def without(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    return b"".join(data[a:b] for a, b in zip([0, *(b for _, b in spans)], [*(a for a, _ in spans), len(data)], strict=True))


def _with_spans(docs: DataFrame, window: int, id_col: str, text_col: str, others: list[str] = ()) -> DataFrame:
    """__id, text, spans, and the columns ``others`` as __0, __1, ..."""
    spans = repeated_spans(docs, window, id_col=id_col, text_col=text_col)
    listed = written(spans.distinct().groupBy("h", "g").agg(F.collect_list(F.struct("start", "n")).alias("spans")), "listed")
    t = text_or_empty(text_col)
    rows = docs.select(column(id_col).cast("long").alias("__id"), *_text_key(t), t.alias("text"), *(column(c).alias(f"__{i}") for i, c in enumerate(others)))
    return rows.join(listed.hint("merge"), ["h", "g"], "left")


def removal_digests(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Every byte is removed that a ``window``-byte string covers which also starts anywhere else in
    the table, the same text included; all strings are judged on the input. Null text is empty.
    Repeated rows are each other's copies and lose all bytes, if they have ``window`` or more. An
    empty table gives no rows. Other columns are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most_bytes=4 << 20):
            out = []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                data = text.encode()
                cut = merged_spans(spans, window, len(data))
                out.append((len(data), sum(b - a for a, b in cut), len(cut), hashlib.sha256(without(data, cut)).hexdigest()))
            yield pa.RecordBatch.from_arrays([batch.column("__id"), *(pa.array(c) for c in zip(*out, strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    rows = _with_spans(docs, window, id_col, text_col).select("__id", "text", "spans")
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def inner_characters(data: bytes, a: int, b: int) -> tuple[int, int]:
    """The stretch without the parts of characters at its ends."""
    while a < b and data[a] & 0xC0 == 0x80:
        a += 1
    while b > a and b < len(data) and data[b] & 0xC0 == 0x80:
        b -= 1
    return a, b


def cut_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the repeated stretches cut out of the text; characters are cut whole or not at all.

    All other columns stay, whatever their names. A null text becomes empty; null and repeated
    ids play no part, rows of one text are cut alike, and repeated rows of ``window`` bytes or
    more lose all of them. An empty table gives no rows.
    """
    others = [c for c in docs.columns if c != text_col]

    def run(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for text, found in zip(texts, spans, strict=True):
            if found is None or not len(found):
                out.append(text)
                continue
            data = text.encode()
            out.append(without(data, [inner_characters(data, a, b) for a, b in merged_spans(list(found), window, len(data))]).decode())
        return pd.Series(out)

    cut = F.pandas_udf(run, "string")
    rows = _with_spans(docs, window, id_col, text_col, others)
    names = {c: f"__{i}" for i, c in enumerate(others)}
    return rows.select(*((cut("text", "spans") if c == text_col else F.col(names[c])).alias(c) for c in docs.columns))
