"""How far the sources of a language diverge in their words: exact prices of pairs of sources, and each source's telling terms."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeweave.llm.common import column, gapless_rank, written
from lakeweave.llm.words import slices

#: Bytes that belong to terms (letters and all beyond ASCII), and every byte's lower case.
INSIDE = np.array([chr(b).isalpha() if b < 128 else True for b in range(256)], bool)
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
#: Terms in a block, and sources in a band: what one task of pairs holds of either side is their product at most.
BLOCK, BAND = 1 << 14, 32
PRICED = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())


def terms(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct terms of the texts (no nulls), the code of each occurrence, and the text that it is in."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    inside = INSIDE[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    at = offsets[:-1][offsets[:-1] < len(raw)]
    first[at] = inside[at]  # a text begins anew
    place = np.flatnonzero(inside)
    begins = np.flatnonzero(first[place])
    letters = LOWER[raw[place]]
    ends = np.append(begins, len(letters)).astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(begins), pa.py_buffer(ends), pa.py_buffer(letters)).dictionary_encode()
    text = np.searchsorted(offsets, place[begins], side="right") - 1
    return words.dictionary, words.indices.to_numpy(zero_copy_only=False).astype(np.int64), text


def term_counts(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """lang, source, term, count (occurrences) and docs (documents with the term); each group has a row without a term too.

    Null lang, source and text are empty. Tasks count each slice of texts by themselves, Spark adds
    that up before the shuffle and after it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most_bytes=4 << 20):
            langs, sources = (batch.column(c).dictionary_encode() for c in ("lang", "source"))
            lang, source = (x.indices.to_numpy(zero_copy_only=False).astype(np.int64) for x in (langs, sources))
            groups, group = np.unique(lang << 32 | source, return_inverse=True)
            words, code, text = terms(batch.column("text"))
            size = max(1, len(words))
            at, count = np.unique(group[text] * size + code, return_counts=True)
            once = np.unique(text * size + code)
            _, n_docs = np.unique(group[once // size] * size + once % size, return_counts=True)  # in the order of ``at``
            of, none = np.concatenate([groups[at // size], groups]), np.zeros(len(groups), np.int64)
            term = pa.chunked_array([words.take(pa.array(at % size)).cast(pa.string()), pa.nulls(len(groups), pa.string())]).combine_chunks()
            columns = [langs.dictionary.take(pa.array(of >> 32)), sources.dictionary.take(pa.array(of & 0xFFFFFFFF)), term, pa.array(np.concatenate([count, none])), pa.array(np.concatenate([n_docs, none]))]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "count", "docs"])

    rows = docs.select(*(F.coalesce(column(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    found = rows.mapInArrow(run, "lang string, source string, term string, count long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10^9 (count + 5) / (total + 5 kept)), exactly."""
    over = (F.lit(1_000_000_000).cast("decimal(10,0)") * (count + 5).cast("decimal(20,0)")).cast("decimal(38,0)")
    return F.call_function("div", over, (total + 5 * kept).cast("decimal(20,0)")) + 1


def shares(count: np.ndarray, total: int, kept: int) -> np.ndarray:
    """``share`` of many counts: a division of long numbers, three digits at a time, so that nothing overflows."""
    by = total + 5 * kept
    out, rest = np.divmod(count + 5, by)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, by)
        out = out * 1000 + digit
    return out + 1


def gallop(b: np.ndarray, at: int, x: int) -> int:
    """First place from ``at`` on whose number is ``x`` or more: steps double until one has gone past, the rest is halved."""
    step, low = 1, at
    while at < len(b) and b[at] < x:
        low, at, step = at + 1, at + step, 2 * step
    high = min(at, len(b))
    return low + int(np.searchsorted(b[low:high], x))


def common_places(a: np.ndarray, b: np.ndarray, run: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Places in two sorted arrays of the numbers that are in both. A run of the shorter array gallops through the longer one from where the last run ended; its numbers are then looked up in the stretch between."""
    if len(a) > len(b):
        at_b, at_a = common_places(b, a, run)
        return at_a, at_b
    found_a, found_b, end = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    for i in range(0, len(a), run):
        part = a[i : i + run]
        begin = gallop(b, end, part[0])
        end = gallop(b, begin, part[-1] + 1)
        where = np.searchsorted(b[begin:end], part)
        hit = np.flatnonzero(where < end - begin)
        hit = hit[b[begin + where[hit]] == part[hit]]
        found_a.append(i + hit)
        found_b.append(begin + where[hit])
    return np.concatenate(found_a), np.concatenate(found_b)


def merged_price(a: tuple, b: tuple) -> tuple[int, int]:
    """Sum of the differences of two sources' shares over the terms that either has, and the number of these. A source is (term ids, shares, share of an absent term)."""
    (id_a, p_a, none_a), (id_b, p_b, none_b) = a, b
    at_a, at_b = common_places(id_a, id_b)
    both = np.abs(p_a[at_a] - p_b[at_b]).sum()
    one_a = np.abs(p_a - none_b).sum() - np.abs(p_a[at_a] - none_b).sum()
    one_b = np.abs(p_b - none_a).sum() - np.abs(p_b[at_b] - none_a).sum()
    return int(both + one_a + one_b), len(id_a) + len(id_b) - len(at_a)


def pair_prices(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item and value of every ordered pair of sources of a language.

    ``kept`` has lang, source, id (from 0 in each language) and count, ``groups`` lang, source,
    band (``BAND`` sources each), bands, total and kept. Each source's sorted counts are cut into blocks
    of ``BLOCK`` ids; per language, block and two bands, the two sides' arrays are co-grouped, and
    each unordered pair is merged once. The terms that neither side has are priced from how many
    they are, for all blocks at once.
    """
    block = F.floor(F.col("id") / BLOCK).cast("int")
    arrays = kept.groupBy("lang", "source", block.alias("block")).agg(F.array_sort(F.collect_list(F.struct(F.col("id"), F.col("count")))).alias("c"))
    # every group has every block of its language, be it empty: what only the other side has is priced too
    blocks = groups.where("kept > 0").withColumn("block", F.explode(F.sequence(F.lit(0), F.floor((F.col("kept") - 1) / BLOCK).cast("int"))))
    arrays = blocks.join(arrays, ["lang", "source", "block"], "left")
    none = F.array().cast("array<long>")
    arrays = arrays.select("lang", "block", "source", "band", "bands", "total", "kept", F.coalesce("c.id", none).alias("ids"), F.coalesce("c.count", none).alias("counts"))
    arrays = written(arrays, "arrays")
    # a band meets itself and all later ones from the left, itself and all earlier ones from the right
    left = arrays.withColumn("band_a", F.col("band")).withColumn("band_b", F.explode(F.sequence(F.col("band"), F.col("bands") - 1)))
    right = arrays.select(*(F.col(c).alias(c) for c in arrays.columns)).withColumn("band_b", F.col("band")).withColumn("band_a", F.explode(F.sequence(F.lit(0), F.col("band"))))
    keys, own = ["lang", "block", "band_a", "band_b"], ["source", "total", "kept", "ids", "counts"]

    def side(rows: pa.Table) -> list[tuple]:
        out = []
        for source, total, n, ids, counts in zip(*(rows.column(c) for c in own), strict=True):
            ids, counts = (x.values.to_numpy(zero_copy_only=False).astype(np.int64) for x in (ids, counts))
            total, n = total.as_py(), n.as_py()
            out.append((source.as_py(), (ids, shares(counts, total, n), int(shares(np.zeros(1, np.int64), total, n)[0])), n))
        return out

    def price(a: pa.Table, b: pa.Table) -> pa.Table:
        rows = []
        if len(a) and len(b):
            lang, band_a, band_b = (a.column(c)[0].as_py() for c in ("lang", "band_a", "band_b"))
            others = side(b)
            for x, at_x, _ in side(a):
                rows += [(lang, x, y, *merged_price(at_x, at_y)) for y, at_y, _ in others if band_a < band_b or x < y]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, PRICED, strict=True)], ["lang", "source", "item", "value", "seen"])

    priced = left.select(*keys, *own).groupBy(*keys).cogroup(right.select(*keys, *own).groupBy(*keys)).applyInArrow(price, "lang string, source string, item string, value long, seen long")
    priced = priced.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"))
    ways = F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))
    return priced.select("lang", "value", "seen", F.explode(ways).alias("w")).select("lang", "w.source", "w.item", "value", "seen")


def source_divergence(docs: DataFrame, least_docs: int = 30, top: int = 50, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """lang, source, part, item, value, rank: every other source of the language by how far the shares of its terms are from the source's (part 'pair'), and the ``top`` terms that the source uses more than its language does (part 'term').

    Terms are runs of letters and of signs beyond ASCII, A-Z lower-cased; a language keeps those
    in ``least_docs`` of its documents. A term's share in a group is 1 + floor(10^9 (count + 5) /
    (total + 5 terms)), in whole numbers throughout. Ranks are by value, then item by its bytes.

    Null lang, source and text count as ''. A group whose texts have no kept term, or none at all,
    is priced like any other; a language without kept terms has pairs of value 0. Repeated rows
    count each. An empty table gives no rows; columns other than the three are not looked at.
    """
    counts = written(term_counts(docs, lang_col, source_col, text_col), "counts")
    words = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("count").alias("lang_count")).where(F.col("docs") >= least_docs)
    words = written(words.select("lang", "term", "lang_count"), "words")
    words = gapless_rank(words, ["lang"], ["term"], words.count(), "id")
    kept = written(counts.where("term is not null").join(words, ["lang", "term"]).select("lang", "source", "term", "id", "count", "lang_count"), "kept")
    groups = _groups(counts, kept)
    return _rank(_pairs(kept, groups), "pair").unionByName(_rank(_telling(kept, groups), "term", top))


def _groups(counts: DataFrame, kept: DataFrame) -> DataFrame:
    """lang, source, total, lang_total, kept (terms), band and bands of every group."""
    own = kept.groupBy("lang", "source").agg(F.sum("count").alias("total"))
    once = kept.groupBy("lang", "id").agg(F.min("lang_count").alias("n"))
    langs = once.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count(F.lit(1)).alias("kept"))
    groups = written(counts.where("term is null").select("lang", "source"), "groups")
    banded = gapless_rank(groups, ["lang"], ["source"], groups.count(), "place").withColumn("band", F.floor(F.col("place") / BAND).cast("int")).drop("place")
    bands = banded.groupBy("lang").agg((F.max("band") + 1).alias("bands"))
    every = banded.join(bands, "lang").join(own, ["lang", "source"], "left").join(langs, "lang", "left")
    return written(every.fillna(0, ["total", "lang_total", "kept"]), "groups")


def _pairs(kept: DataFrame, groups: DataFrame) -> DataFrame:
    none = F.when(F.col("kept") > 0, share(F.lit(0).cast("long"), F.col("total"), F.col("kept"))).otherwise(0)
    own = groups.select("lang", "source", "kept", none.alias("none"))
    others = groups.select("lang", F.col("source").alias("item"), none.alias("none_item"))
    pairs = own.join(others, "lang").where("source <> item")
    absent = (F.col("kept") - F.coalesce("seen", F.lit(0))) * F.abs(F.col("none") - F.col("none_item"))
    return pairs.join(pair_prices(kept, groups), ["lang", "source", "item"], "left").select("lang", "source", "item", (F.coalesce("value", F.lit(0)) + absent).alias("value"))


def _telling(kept: DataFrame, groups: DataFrame) -> DataFrame:
    told = kept.join(groups.select("lang", "source", "total", "lang_total", "kept"), ["lang", "source"])
    more = share(F.col("count"), F.col("total"), F.col("kept")) - share(F.col("lang_count"), F.col("lang_total"), F.col("kept"))
    return told.select("lang", "source", F.col("term").alias("item"), more.alias("value")).where("value > 0")


def _rank(rows: DataFrame, part: str, most: int | None = None) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    ranked = rows.withColumn("rank", rank)
    ranked = ranked if most is None else ranked.where(F.col("rank") <= most)
    return ranked.select("lang", "source", F.lit(part).alias("part"), "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank"))
