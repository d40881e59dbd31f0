"""Similarity join of documents on word n-grams: MinHash bands find pairs, full n-gram sets verify them."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeweave.llm.common import column, components, fresh, row_name, text_or_empty, written
from lakeweave.llm.words import Words, slices, span_index, split_words

MIX = np.uint64(0x9E3779B97F4A7C15)


def choose_bands(threshold: float, recall: float, most_hashes: int = 320) -> tuple[int, int]:
    """(bands, rows): the most rows to a band, for the fewest false candidates, with which a pair at the threshold meets with at least ``recall``."""
    for rows in range(32, 0, -1):
        p = threshold**rows
        bands = math.ceil(math.log(1 - recall) / math.log1p(-p)) if p < 1 else 1
        if bands * rows <= most_hashes:
            return bands, rows
    raise ValueError("more hashes are needed for this recall")


def gram_hashes(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the distinct n-grams of each text, sorted, and where each text's end. A text of fewer words has one gram, of all of them; one without words none."""
    word = np.array([xxhash.xxh3_64_intdigest(x) for x in w.distinct], np.uint64)
    codes = word[w.codes] if len(w.codes) else np.zeros(0, np.uint64)
    starts, size = w.starts, w.ends - w.starts
    padded = np.concatenate([codes, np.zeros(n, np.uint64)])
    full = np.maximum(size - n + 1, 0)
    grams = np.where(size > 0, np.maximum(full, 1), 0)
    at = span_index(starts, grams)
    short = np.repeat(np.where((size > 0) & (size < n), size, n), grams)
    h = np.zeros(len(at), np.uint64)
    for j in range(n):
        h = np.where(j < short, (h ^ padded[at + j]) * MIX, h)
        h ^= h >> np.uint64(32)
    text = np.repeat(np.arange(len(size)), grams)
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    h, text = h[new], text[new]
    return h, np.cumsum(np.bincount(text, minlength=len(size)))


def band_keys(h: np.ndarray, ends: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A row of band keys for each text with grams; keys of different bands differ."""
    counts = np.diff(ends, prepend=0)
    first = (ends - counts)[counts > 0]
    rng = np.random.default_rng(11)
    mult = rng.integers(1, 2**32, bands * rows, np.uint32) | np.uint32(1)
    plus = rng.integers(0, 2**32, bands * rows, np.uint32)
    low = (h ^ (h >> np.uint64(32))).astype(np.uint32)
    keys = np.empty((len(first), bands), np.uint64)
    if not len(first):
        return keys
    for b in range(bands):
        key = np.full(len(first), b + 1, np.uint64) * MIX
        for r in range(b * rows, (b + 1) * rows):
            x = low * mult[r] + plus[r]
            x ^= x >> np.uint32(15)
            x *= np.uint32(0x2C1B3C6D)
            key = (key ^ np.minimum.reduceat(x, first)) * MIX
            key ^= key >> np.uint64(29)
        keys[:, b] = key
    return keys


def _signatures(n: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most_bytes=4 << 20):
            h, ends = gram_hashes(split_words(batch.column("text")), n)
            counts = np.diff(ends, prepend=0)
            keys = band_keys(h, ends, bands, rows).view(np.int64)
            full = np.flatnonzero(counts)
            offsets = np.zeros(len(counts) + 1, np.int32)
            offsets[1:] = np.cumsum(np.where(counts > 0, bands, 0))
            view = memoryview(h.tobytes())
            same = [None] * len(counts)
            for i, a, b in zip(full.tolist(), (ends - counts)[full].tolist(), ends[full].tolist(), strict=True):
                same[i] = xxhash.xxh3_128_digest(view[8 * a : 8 * b])
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("h"), pa.array(same, pa.binary()), pa.array(counts), pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel()))], ["doc", "h", "same", "grams", "bands"])

    return run


def _gram_sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most_bytes=4 << 20):
            h, ends = gram_hashes(split_words(batch.column("text")), n)
            yield pa.RecordBatch.from_arrays([batch.column("cid"), batch.column("bands"), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(h.view(np.int64)))], ["cid", "bands", "grams"])

    return run


def linked(grams: list[np.ndarray], cross: np.ndarray | None, threshold: float) -> np.ndarray:
    """Matrix of the pairs of gram sets whose Jaccard similarity is at least the threshold; with ``cross``, only of pairs on two sides.

    Counts of common grams are products of the 0/1 matrix of sets and of the grams that occur twice.
    """
    g = len(grams)
    size = np.array([len(x) for x in grams], np.int64)
    _, gram, times = np.unique(np.concatenate(grams), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(g), size)
    shared = times[gram] > 1
    _, gram = np.unique(gram[shared], return_inverse=True)
    row = row[shared]
    order = np.argsort(gram, kind="stable")
    gram, row = gram[order], row[order]
    common = np.zeros((g, g), np.float32)
    for a in range(0, int(gram[-1]) + 1 if len(gram) else 0, 4096):
        i, j = np.searchsorted(gram, [a, a + 4096])
        x = np.zeros((g, 4096), np.float32)
        x[row[i:j], gram[i:j] - a] = 1
        common += x @ x.T
    either = size[:, None] + size[None, :] - common
    hit = common >= threshold * either - 1e-6
    np.fill_diagonal(hit, False)
    if cross is not None:
        hit &= cross[:, None] != cross[None, :]
    return hit


def _roots(hit: np.ndarray) -> np.ndarray:
    """Least index that each row reaches."""
    root = np.arange(len(hit))
    while True:
        near = np.where(hit, root[None, :], len(hit)).min(axis=1)
        new = np.minimum(root, near)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _verify(threshold: float):
    """Of a bundle of blocks: for each set with links there, how many documents they lead to and a peer that is reached.

    Only pairs that share a bucket count; where the group is a bucket itself, only in the first bucket that they share.
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("grp", "ascending"), ("lo", "ascending"), ("hi", "ascending"), ("cid", "ascending")])
        grp, lo, hi, mine, size, cid = (table.column(c).to_numpy() for c in ("grp", "lo", "hi", "mine", "size", "cid"))
        bucket = table.column("bucket").to_numpy(zero_copy_only=False)
        cells = table.column("grams").combine_chunks()
        flat, at = cells.flatten().to_numpy(), np.concatenate([[0], np.cumsum(cells.value_lengths().to_numpy())])
        bands = table.column("bands").combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1)
        cuts = np.flatnonzero((grp[1:] != grp[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])) + 1
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(grp)], strict=True):
            if b - a < 2:
                continue
            hit = linked([flat[at[i] : at[i + 1]] for i in range(a, b)], mine[a:b] if lo[a] != hi[a] else None, threshold)
            i, j = np.nonzero(np.triu(hit))
            for c in range(0, len(i), 1 << 14):
                one, two = i[c : c + (1 << 14)], j[c : c + (1 << 14)]
                same = bands[a + one] == bands[a + two]
                counts = same.any(axis=1)
                if bucket[a]:
                    counts &= bands[a + one, same.argmax(axis=1)] == grp[a]
                hit[one[~counts], two[~counts]] = hit[two[~counts], one[~counts]] = False
            some = np.flatnonzero(hit.any(axis=1))
            out.append((cid[a:b][some], (hit @ size[a:b])[some], cid[a:b][_roots(hit)[some]]))
        cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3
        return pa.table(dict(zip(("cid", "links", "peer"), (pa.array(c.astype(np.int64)) for c in cols), strict=True)))

    return run


DEALT = ["cid", "size", "bytes", "grp", "bucket", "mine", "lo", "hi"]


def _pair_of_blocks(rows: DataFrame) -> DataFrame:
    return rows.withColumn("lo", F.least("mine", "other")).withColumn("hi", F.greatest("mine", "other")).select(*DEALT)


def _dealt_groups(ways: DataFrame, met: DataFrame, block: int, bundle_bytes: int) -> DataFrame:
    """Deal the classes of whole groups to pairs of blocks.

    Classes with one head share a bucket and stay together: heads of few classes fill blocks of
    ``block`` classes or half of ``bundle_bytes`` in order, those of many are dealt to blocks of their
    own. Only counts of heads are put in order, so that no task holds a large group. A class goes
    to the pairs of its own block with those that hold a class of one of its buckets, and to no
    other: what moves grows with the pairs that share buckets, not with the group's square.
    """
    weight = F.greatest(F.lit(1.0 / block), F.col("bytes") * 2.0 / bundle_bytes)
    heads = written(ways.groupBy("grp", "head").agg(F.sum(weight).alias("weight")), "weights")
    # in halves of blocks: a block that a head overruns is then full at most
    many_of = F.col("weight") > 0.5
    taken = F.when(many_of, F.ceil("weight") + 1.0).otherwise(F.col("weight") * 2)
    before = F.coalesce(F.sum(taken).over(Window.partitionBy("grp").orderBy("head").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    several = F.sum(taken).over(Window.partitionBy("grp")) > 1
    heads = written(heads.select("grp", "head", F.floor(before + 1e-9).cast("int").alias("start"), F.when(many_of, F.ceil("weight")).otherwise(0).cast("int").alias("own"), several.alias("several")), "starts")
    mine = F.when(F.col("own") > 0, F.col("start") + 1 + F.pmod(F.xxhash64("cid"), F.col("own"))).otherwise(F.col("start")).cast("int")
    placed = written(ways.join(heads.hint("merge"), ["grp", "head"]).select("cid", "size", "bytes", "grp", F.lit(False).alias("bucket"), mine.alias("mine"), "several"), "placed")
    single, many = placed.where("not several").withColumn("other", F.col("mine")), placed.where("several")
    at = written(met.select("cid", F.col("bucket").alias("key")).join(many.select("cid", "mine").hint("merge"), "cid"), "placed_in")
    # buckets of one group mostly lie in the same few blocks: sets of sets stay short
    held = written(at.groupBy("key").agg(F.sort_array(F.collect_set("mine")).alias("held")), "held")
    others = at.select("cid", "key").join(held.hint("merge"), "key").groupBy("cid").agg(F.collect_set("held").alias("held"))
    others = others.select("cid", F.explode(F.array_distinct(F.flatten("held"))).alias("other"))
    return _pair_of_blocks(single).unionByName(_pair_of_blocks(many.join(others.hint("merge"), "cid")))


def _dealt_buckets(ways: DataFrame, met: DataFrame, block: int, bundle_bytes: int) -> DataFrame:
    """Deal the classes of very large groups bucket by bucket to pairs of blocks: in a bucket all pairs are candidates."""
    per = met.select("cid", F.col("bucket").alias("grp")).join(ways.select("cid", "size", "bytes").hint("merge"), "cid")
    parts = F.ceil(F.greatest(F.count(F.lit(1)) / block, F.sum("bytes") * 2 / bundle_bytes)).cast("int").alias("parts")
    per = per.join(per.groupBy("grp").agg(parts).hint("merge"), "grp").withColumn("bucket", F.lit(True)).withColumn("mine", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int"))
    return _pair_of_blocks(per.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))))


def near_duplicates(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.9999, block: int = 256, giant: int = 20_000, bundle_bytes: int = 2 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Join documents whose sets of word ``n``-grams have a Jaccard similarity of ``threshold`` or more.

    Returns one row per row of ``docs``: doc_id; class_id, the smallest doc_id with the same
    n-gram set; n_links, the number of other documents linked directly; component_id, the
    smallest doc_id that links lead to; kept (doc_id = component_id).

    1. Texts with equal sets make one class. A class's MinHash signature gives band keys; their
       number and length are chosen so that a pair at the threshold shares one with at least the
       probability ``recall``.
    2. Classes are shuffled on band keys. Pairs in one bucket are candidates and are verified on
       the full sets. So that a set moves once and not for each of its buckets, buckets that share
       classes, directly or through others, make a group, found by edges to each bucket's least
       member; groups of over ``giant`` classes go bucket by bucket instead. Both ways verify the
       same pairs: those that share a bucket.
    3. Groups are cut into blocks of at most ``block`` classes, fewer where these are long; a class
       goes to the pairs of blocks in which it shares a bucket (``_dealt_groups``), and these go
       to tasks by their bytes. No pair is a row.

    Words are what white space parts. A text of fewer than ``n`` words is one gram; null, empty
    and blank texts have none and link with nothing. Repeated rows of one id and text link with
    each other. A null id names a class or component only where no other does; of rows with the
    component's id, or none, those with a single text stay. An empty table gives no rows. Other
    columns are not looked at.
    """
    return _near_rows(docs, n, threshold, recall, block, giant, bundle_bytes, id_col, text_col).drop("h")


def _near_rows(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.9999, block: int = 256, giant: int = 20_000, bundle_bytes: int = 2 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``near_duplicates`` with h, the hash of each row's text."""
    bands, rows = choose_bands(threshold, recall)
    t = text_or_empty(text_col)
    keyed = docs.select(column(id_col).cast("long").alias("doc"), F.xxhash64(t).alias("h"), t.alias("text"))
    signed = written(keyed.mapInArrow(_signatures(n, bands, rows), "doc long, h long, same binary, grams long, bands array<long>"), "signatures")
    classes = signed.where("same is not null").groupBy("same").agg(F.min(F.struct(F.isnull("doc").alias("none"), "doc", "h")).alias("r"), F.count(F.lit(1)).alias("size"), F.max("grams").alias("grams"), F.any_value("bands").alias("bands"))
    classes = written(classes.select("same", F.col("r.doc").alias("doc"), F.col("r.h").alias("h"), "size", "grams", "bands", F.monotonically_increasing_id().alias("cid")), "classes")

    spread = classes.select("cid", F.explode("bands").alias("bucket"))
    full = spread.groupBy("bucket").agg(F.min("cid").alias("a"), F.max("cid").alias("z")).where("a < z").select("bucket", "a")
    full = written(full, "buckets")
    met = written(spread.join(full.hint("merge"), "bucket"), "met")
    # a class is in the group of the least head of its buckets; edges between heads, few to a group, join the groups
    headed = written(met.select("cid", "a", F.min("a").over(Window.partitionBy("cid")).alias("head")), "heads")
    reach = components(headed.select("a", F.col("head").alias("b")))
    groups = headed.groupBy("cid").agg(F.min("head").alias("head")).join(reach.withColumnRenamed("id", "head").hint("merge"), "head", "left")
    groups = written(groups.select("cid", "head", F.coalesce("component", "head").alias("grp")), "groups")
    candidates = written(classes.select("cid", "doc", "h", "size", "bands", (F.col("grams") * 8 + 400).alias("bytes")).join(groups.hint("merge"), "cid"), "candidates")
    members = F.count(F.lit(1)).alias("members")
    sized = written(candidates.groupBy("grp").agg(members), "members")

    wanted = candidates.select("doc", "h", "cid", "bands").where("doc is not null")
    text_of = keyed.join(wanted.hint("merge"), ["doc", "h"]).dropDuplicates(["cid"]).select("cid", "bands", "text")
    alone = candidates.where("doc is null").select("h", "cid", "bands")
    text_of = text_of.unionByName(keyed.where("doc is null").join(alone.hint("merge"), "h").dropDuplicates(["cid"]).select("cid", "bands", "text"))
    sets = text_of.mapInArrow(_gram_sets(n), "cid long, bands array<long>, grams array<long>")

    ways = written(candidates.select("cid", "size", "bytes", "head", "grp").join(sized.hint("merge"), "grp"), "ways")
    dealt = written(_dealt_groups(ways.where(F.col("members") <= giant), met, block, bundle_bytes).unionByName(_dealt_buckets(ways.where(F.col("members") > giant), met, block, bundle_bytes)), "dealt")
    load = dealt.agg(F.sum("bytes")).first()[0] or 0
    bundle = F.pmod(F.xxhash64("grp", "bucket", "lo", "hi"), F.lit(max(1, math.ceil(load / bundle_bytes))))
    loaded = dealt.join(sets.hint("merge"), "cid").withColumn("bundle", bundle)
    links = written(loaded.groupBy("bundle").applyInArrow(_verify(threshold), "cid long, links long, peer long"), "links")

    total = links.groupBy("cid").agg(F.sum("links").alias("links"))
    reach = components(links.where("cid <> peer").select(F.col("cid").alias("a"), F.col("peer").alias("b")).distinct())
    known = classes.select("same", "cid", F.col("doc").alias("class_id"), "h", "size")
    known = known.join(total.hint("merge"), "cid", "left").join(reach.withColumnRenamed("id", "cid").hint("merge"), "cid", "left")
    known = written(known.select("same", "class_id", "h", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("links"), F.coalesce("component", "cid").alias("root")), "known")
    # of classes and components the row with the least id, and hash of text, is the one that stays
    first = F.min(F.struct(F.isnull("class_id").alias("none"), F.col("class_id").alias("doc"), "h"))
    roots = written(known.groupBy("root").agg(first.alias("first")), "roots")
    told = known.drop("h").join(roots.hint("merge"), "root").select("same", "class_id", "links", F.col("first.doc").alias("component"), F.col("first.h").alias("kept_h"))
    out = signed.join(told.hint("merge"), "same", "left")
    linked = F.col("links").isNotNull()
    stays = ~linked | (F.col("doc").eqNullSafe(F.col("component")) & (F.col("h") == F.col("kept_h")))
    name = lambda c: F.when(linked, F.col(c)).otherwise(F.col("doc")).alias
    return out.select(F.col("doc").alias("doc_id"), name("class_id")("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), name("component")("component_id"), stays.alias("kept"), "h")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: object) -> DataFrame:
    """``docs`` with the document of the smallest id of every near-duplicate component, and all documents without links; all columns, whatever their names, stay as they are.

    Rows are told apart by id and text; of rows with one id and text one stays. Null, empty and
    blank texts have no links. A null id stays only where no row of its component has another. An
    empty table gives no rows.
    """
    own, text = fresh(docs, "id", "hash")
    stays = _near_rows(docs, id_col=id_col, text_col=text_col, **options).where("kept").select(row_name(F.col("doc_id")).alias(own), F.col("h").alias(text)).distinct()
    named = docs.withColumns({own: row_name(column(id_col).cast("long")), text: F.xxhash64(text_or_empty(text_col))})
    return named.join(stays.hint("merge"), [own, text], "left_semi").dropDuplicates([own, text]).select(*map(column, docs.columns))
