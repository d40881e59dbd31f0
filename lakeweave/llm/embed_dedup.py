"""Near-duplicate vectors by a pivot-permutation index."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeweave.llm.common import column, components, low_hashes, written

#: Reference points grow with the root of the number of vectors up to so many; a list then holds about as many vectors at every size.
LEAST_PIVOTS, MOST_PIVOTS = 64, 8192
#: Lengths of permutation prefixes to choose from, and the recall that the choice has to reach on the sample.
PREFIXES, RECALL = (6, 8, 10, 12, 14, 16), 0.997
#: Groups of at most so many entries are paired by offsets, larger ones by matrices.
FEW = 32


# --- the index --------------------------------------------------------------------------------


@dataclass
class Index:
    """Reference points around the middle of the data, how many of the nearest describe a vector, and how many of these candidates share."""

    middle: np.ndarray
    pivots: np.ndarray
    prefix: int
    least: int

    def nearest(self, unit: np.ndarray, k: int | None = None) -> np.ndarray:
        """Numbers of the ``k`` nearest pivots of each unit vector, nearest first; of equally near ones any."""
        k = min(k or self.prefix, len(self.pivots))
        out = np.empty((len(unit), k), np.int16)
        for a in range(0, len(unit), 1024):
            like = (unit[a : a + 1024] - self.middle) @ self.pivots.T
            top = np.argpartition(-like, k - 1, axis=1)[:, :k]
            out[a : a + 1024] = np.take_along_axis(top, np.argsort(-np.take_along_axis(like, top, 1), axis=1, kind="stable"), 1)
        return out


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Directions between random pairs of the sample: they lie as the data do, whatever it has in common, and a tight group is crossed in all directions."""
    rng = np.random.default_rng(5)
    a, b = (rng.integers(0, len(sample), n) for _ in range(2))
    way = sample[a] - sample[b]
    size = np.linalg.norm(way, axis=1)
    none = size < 1e-9
    way[none] = rng.normal(size=(int(none.sum()), sample.shape[1]))
    return way / np.linalg.norm(way, axis=1, keepdims=True)


def fit_index(sample: np.ndarray, n_pivots: int, threshold: float) -> Index:
    """Fit the index on unit vectors.

    Each of (at most 1024 of) the sample is turned towards another one until their cosine is the
    threshold: the hardest pairs that have to be found. The prefix is the shortest with which
    ``RECALL`` of them share two pivots or more, and candidates have to share as many as that
    recall allows. Where no prefix is long enough, fewer pivots, whose order is the steadier, are
    tried, half as many each time. Where even the least number doesn't do, there is one list for
    each label, so that all its pairs are verified, in blocks: slow, but whole.
    """
    middle, pivots = sample.mean(axis=0), choose_pivots(sample, n_pivots)
    one = sample[:1024]
    rng = np.random.default_rng(6)
    other = sample[rng.permutation(len(sample))[: len(one)]] + 1e-6 * rng.normal(size=one.shape)
    across = other - (other * one).sum(axis=1, keepdims=True) * one
    across /= np.maximum(np.linalg.norm(across, axis=1, keepdims=True), 1e-300)
    turned = threshold * one + math.sqrt(max(0.0, 1 - threshold**2)) * across
    while True:
        index = Index(middle, pivots, max(PREFIXES), 2)
        near, far = index.nearest(one), index.nearest(turned)
        for p in PREFIXES:
            shared = (near[:, :p, None] == far[:, None, :p]).sum(axis=(1, 2))
            enough = [s for s in range(2, p) if (shared >= s).mean() >= RECALL]
            if enough:
                return Index(middle, pivots, p, max(enough))
        if len(pivots) <= LEAST_PIVOTS:
            return Index(middle, pivots[:1], 1, 1)  # all stand in one list
        pivots = pivots[: len(pivots) // 2]


# --- vectors in batches -----------------------------------------------------------------------


def matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """Rows of an array of lists without nulls, cut or filled with zeros to ``width``."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    size = pc.list_value_length(vectors).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    if (size == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(size), width))
    row = np.repeat(np.arange(len(size)), size)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    inside = at < width
    out[row[inside], at[inside]] = flat[inside]
    return out


def _identities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each usable vector the unit vector, and a 128-bit hash of its label and components."""
    for batch in batches:
        vectors, labels = batch.column("vector"), batch.column("label")
        size = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = pc.fill_null(vectors.flatten(), float("nan")).to_numpy(zero_copy_only=False) + 0.0
        ends = np.cumsum(size)
        row = np.repeat(np.arange(len(size)), size)
        odd = np.bincount(row, ~np.isfinite(flat), len(size)) > 0
        largest = np.zeros(len(size))
        np.maximum.at(largest, row, np.where(np.isfinite(flat), np.abs(flat), 0))
        good = ~odd & (largest > 0) & pc.is_valid(labels).to_numpy(zero_copy_only=False)
        _, power = np.frexp(np.where(good, largest, 1.0))
        # by powers of two, which round nothing: squares of any finite components then stay in range
        unit = np.ldexp(np.where(good[row], flat, 0.0), -power[row])
        unit = unit / np.sqrt(np.maximum(np.bincount(row, unit * unit, len(size)), 1e-300))[row]
        view = memoryview(flat.tobytes())
        same: list[bytes | None] = [None] * len(size)
        for i, a, b, label in zip(np.flatnonzero(good).tolist(), (8 * (ends - size)[good]).tolist(), (8 * ends[good]).tolist(), labels.filter(pa.array(good)).to_pylist(), strict=True):
            same[i] = xxhash.xxh3_128_digest(f"{len(label)}:{label}".encode() + view[a:b])
        kept = np.where(good, size, 0)
        offsets = pa.array(np.concatenate([[0], np.cumsum(kept)]).astype(np.int32))
        yield pa.RecordBatch.from_arrays([batch.column("id"), labels, pa.ListArray.from_arrays(offsets, pa.array(unit[good[row]])), pa.array(same, pa.binary())], ["id", "label", "unit", "same"])


POSTING = "list long, a short, b short, cid long, space long, near array<short>"
DEALT = POSTING + ", mine int, lo int, hi int"


def _postings(index: Index):
    """A row for each pair of a vector's nearest pivots: the inverted lists that the vector stands in."""
    width = index.pivots.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = np.sort(index.nearest(matrix(batch.column("unit"), width)), axis=1)
            n, p = near.shape
            space = batch.column("space").to_numpy()
            listed = pa.FixedSizeListArray.from_arrays(pa.array(near.ravel()), p).cast(pa.list_(pa.int16()))
            for i, j in combinations(range(p), 2) if p > 1 else [(0, 0)]:
                with np.errstate(over="ignore"):
                    key = (space * np.int64(1_000_003) + near[:, i]) * np.int64(1_000_003) + near[:, j]
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(near[:, i]), pa.array(near[:, j]), batch.column("cid"), pa.array(space), listed], [x.split()[0] for x in POSTING.split(", ")])

    return run


# --- candidates and their verification --------------------------------------------------------


def _owned(near_i: np.ndarray, near_j: np.ndarray, a: np.ndarray, b: np.ndarray, least: int) -> np.ndarray:
    """Pairs that share ``least`` pivots or more and whose first two shared ones are the list's own, so that each pair counts in one list."""
    met = (near_i[:, :, None] == near_j[:, None, :]).any(axis=2)
    rows = np.arange(len(met))
    first = met.argmax(axis=1)
    count = met.sum(axis=1)
    met[rows, first] = False
    second = np.where(count > 1, met.argmax(axis=1), first)
    return (count >= min(least, near_i.shape[1])) & (near_i[rows, first] == a) & (near_i[rows, second] == b)


def candidates(table: pa.Table, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers (i, j) of the rows of candidate pairs, i before j. Rows are sorted by list and block."""
    listed, lo, hi, mine, space, a, b = (table.column(c).to_numpy() for c in ("list", "lo", "hi", "mine", "space", "a", "b"))
    near = matrix(table.column("near"), len(table.column("near")[0]) if table.num_rows else 1).astype(np.int16)
    new = np.zeros(len(listed), bool)
    new[:1] = True
    for c in (listed, lo, hi):
        new[1:] |= c[1:] != c[:-1]
    begin = np.flatnonzero(new)
    size = np.diff(np.append(begin, len(listed)))
    group = np.repeat(np.arange(len(begin)), size)

    def kept(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ok = (space[i] == space[j]) & (a[i] == a[j]) & (b[i] == b[j]) & ((lo[i] == hi[i]) | (mine[i] != mine[j]))
        i, j = i[ok], j[ok]
        ok = _owned(near[i], near[j], a[i], b[i], least)
        return i[ok], j[ok]

    few = np.flatnonzero((size <= FEW)[group])
    for k in range(1, int(size[size <= FEW].max(initial=1))):
        i = few[(few + k < len(listed))]
        i = i[group[i + k] == group[i]]
        for c in range(0, len(i), 1 << 16):
            yield kept(i[c : c + (1 << 16)], i[c : c + (1 << 16)] + k)
    for g in np.flatnonzero(size > FEW).tolist():
        rows = np.arange(begin[g], begin[g] + size[g])
        _, local = np.unique(near[rows], return_inverse=True)
        has = np.zeros((len(rows), int(local.max()) + 1), np.float32)
        np.put_along_axis(has, local.reshape(len(rows), -1), 1, axis=1)
        for c in range(0, len(rows), 256):
            shared = has[c : c + 256] @ has.T
            i, j = np.nonzero(shared >= min(least, near.shape[1]))
            later = j > i + c
            i, j = rows[i[later] + c], rows[j[later]]
            for d in range(0, len(i), 1 << 16):
                yield kept(i[d : d + (1 << 16)], j[d : d + (1 << 16)])


def _sorted(table: pa.Table) -> pa.Table:
    return table.sort_by([("list", "ascending"), ("lo", "ascending"), ("hi", "ascending"), ("cid", "ascending")])


def _with_candidates(least: int):
    """Of a bundle of list blocks, from postings alone: the rows that have a candidate there."""

    def run(table: pa.Table) -> pa.Table:
        table = _sorted(table)
        some = np.zeros(table.num_rows, bool)
        for i, j in candidates(table, least):
            some[i] = some[j] = True
        return table.filter(pa.array(some)).select([x.split()[0] for x in DEALT.split(", ")])

    return run


def _joined(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Roots after joining rows i with rows j."""
    while len(i):
        a, b = root[i], root[j]
        apart = a != b
        if not apart.any():
            break
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        least = np.minimum(a, b)
        np.minimum.at(root, a, least)
        np.minimum.at(root, b, least)
        while (root[root] != root).any():
            root = root[root]
    return root


def _verify(least: int, threshold: float):
    """Of a bundle of list blocks with vectors: each one's number of links there and a vector that they lead to."""

    def run(table: pa.Table) -> pa.Table:
        table = _sorted(table)
        cid, size = (table.column(c).to_numpy() for c in ("cid", "size"))
        unit = matrix(table.column("unit"), int(pc.max(pc.list_value_length(table.column("unit"))).as_py()))
        links, root = np.zeros(len(cid), np.int64), np.arange(len(cid))
        for i, j in candidates(table, least):
            for c in range(0, len(i), 1 << 14):
                one, two = i[c : c + (1 << 14)], j[c : c + (1 << 14)]
                hit = np.einsum("ij,ij->i", unit[one], unit[two]) >= threshold
                one, two = one[hit], two[hit]
                np.add.at(links, one, size[two])
                np.add.at(links, two, size[one])
                root = _joined(root, one, two)
        some = np.flatnonzero(links)
        return pa.table({"cid": cid[some], "links": links[some], "peer": cid[root[some]]})

    return run


def near_vectors(vectors: DataFrame, threshold: float = 0.98, block: int = 1024, bundle_bytes: int = 8 << 20, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Link vectors of equal label whose cosine, in double precision, is at least ``threshold``.

    Returns one row per row: vec_id, n_links (other vectors linked directly), component_id (the
    smallest vec_id that links lead to, itself included), kept (vec_id = component_id).

    1. Reference points are directions between vectors of a sample, seen from its mean. Their
       number grows with the root of the number of vectors, from 64 to 8,192; the sample has
       about two vectors for each, so some 16,384 at most. See ``fit_index`` for the other choices.
    2. A vector is described by its nearest reference points and stands in the inverted list of
       each pair of these. On the lists' numbers alone, shared pivots are counted and rows without
       a candidate go. Long lists are dealt to pairs of blocks of ``block`` entries.
    3. Vectors are fetched for the rows left and verified. Each pair counts in the first list that
       it shares; equal vectors are one entry with a weight; no pair of vectors is ever a row.

    On the given tables all links that brute force finds were found.

    Null, empty and zero vectors, vectors with null or non-finite components, and rows without a
    label link with nothing; vectors of different lengths don't either. Repeated rows link with
    each other. A null id names no component, unless its vectors have no other. An empty table
    gives no rows. Other columns are not looked at.
    """
    base = vectors.select(column(id_col).cast("long").alias("id"), column(label_col).cast("string").alias("label"), column(vector_col).cast("array<double>").alias("vector"))
    known = written(base.mapInArrow(_identities, "id long, label string, unit array<double>, same binary"), "vectors")
    classes = known.where("same is not null").groupBy("same").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("size"), F.any_value("label").alias("label"), F.any_value("unit").alias("unit"))
    classes = written(classes.select("same", "rep", "size", "unit", F.xxhash64("label", F.size("unit")).alias("space"), F.monotonically_increasing_id().alias("cid")), "classes")
    n = classes.count()
    if not n:
        return known.select(F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    n_pivots = min(MOST_PIVOTS, max(LEAST_PIVOTS, 1 << math.ceil(math.log2(4 * math.sqrt(n)))))
    sample = low_hashes(classes, F.xxhash64("same"), 2 * n_pivots / n).select("same", "unit").toArrow().sort_by("same").column("unit")
    width = int(pc.max(pc.list_value_length(sample)).as_py())
    index = fit_index(matrix(sample, width), n_pivots, threshold)

    postings = written(classes.select("cid", "space", "unit").mapInArrow(_postings(index), POSTING), "postings")
    long = written(postings.groupBy("list").agg(F.count(F.lit(1)).alias("members")).where("members > 1"), "lists")
    parts = F.ceil(F.col("members") / block).cast("int")
    dealt = postings.join(long.hint("merge"), "list").withColumn("parts", parts).withColumn("mine", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(*[x.split()[0] for x in POSTING.split(", ")], "mine", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"))
    dealt = written(dealt, "dealt")

    def bundles(rows: int, row_bytes: int) -> Column:
        return F.pmod(F.xxhash64("list", "lo", "hi"), F.lit(max(1, math.ceil(rows * row_bytes / bundle_bytes)))).alias("bundle")

    some = dealt.select("*", bundles(dealt.count(), 80)).groupBy("bundle").applyInArrow(_with_candidates(index.least), DEALT)
    some = written(some, "candidates")
    loaded = some.join(classes.select("cid", "size", "unit").hint("merge"), "cid").select("*", bundles(some.count(), 80 + 8 * width))
    links = written(loaded.groupBy("bundle").applyInArrow(_verify(index.least, threshold), "cid long, links long, peer long"), "links")

    reach = components(links.where("cid <> peer").select(F.col("cid").alias("a"), F.col("peer").alias("b")))
    total = links.groupBy("cid").agg(F.sum("links").alias("links"))
    told = classes.select("same", "cid", "rep", "size").join(total.hint("merge"), "cid", "left").join(reach.withColumnRenamed("id", "cid").hint("merge"), "cid", "left")
    told = written(told.select("same", "rep", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("links"), F.coalesce("component", "cid").alias("group")), "told")
    # tables of their own: Spark splits a hot key only where plain rows, not aggregates, meet
    name = written(told.groupBy("group").agg(F.min("rep").alias("component")), "names")
    named = written(told.join(name.hint("merge"), "group").select("same", "links", "component"), "named")
    component = F.coalesce("component", "id")
    return known.select("id", "same").join(named.hint("merge"), "same", "left").select(F.col("id").alias("vec_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
