"""Shards of near-equal bytes for indivisible groups, by multiway Karmarkar-Karp differencing."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeweave.llm.common import column, counted, gapless_rank, text_or_empty, written


def difference(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Combine partial partitions (rows of k sums) into one.

    The two with the largest spread are combined again and again, one in ascending and one in
    descending order, until one is left. Returns where[i, j], the final slot of slot j of
    partition i, and the final sums.
    """
    k = len(parts[0])
    sums, order, sons = [], [], []
    for p in parts:
        o = np.argsort(p, kind="stable")
        order.append(o)
        sums.append(p[o])
        sons.append(None)
    heap = [(float(s[0] - s[-1]), i) for i, s in enumerate(sums)]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        total = sums[a] + sums[b][::-1]
        o = np.argsort(total, kind="stable")
        to = np.empty(k, np.int64)
        to[o] = np.arange(k)
        sums[a] = sums[b] = None
        sums.append(total[o])
        sons.append((a, b, to))
        heapq.heappush(heap, (float(total[o[0]] - total[o[-1]]), len(sums) - 1))
    root = heap[0][1]
    slots: dict[int, np.ndarray] = {root: np.arange(k)}
    where = np.empty((len(parts), k), np.int64)
    for i in range(root, -1, -1):
        mine = slots.pop(i)
        if sons[i] is None:
            where[i, order[i]] = mine
        else:
            a, b, to = sons[i]
            slots[a] = mine[to]
            slots[b] = mine[to][::-1]
    return where, sums[root]


def _difference_items(k: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["weight", "key"], kind="stable")
        parts = np.zeros((len(pdf), k))
        parts[:, -1] = pdf["weight"].to_numpy()
        where, _ = difference(list(parts))
        return pd.DataFrame({"block": pdf["block"].to_numpy(), "key": pdf["key"].to_numpy(), "weight": pdf["weight"].to_numpy(), "part": where[:, -1].astype("int32")})

    return run


def _difference_blocks(k: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block", kind="stable")
        where, sums = difference([np.asarray(x, float) for x in pdf["sums"]])
        return pd.DataFrame({"block": pdf["block"].to_numpy(), "above": pdf["above"].to_numpy(), "slots": list(where.astype("int32")), "sums": [sums] * len(pdf)})

    return run


def balance(groups: DataFrame, n_shards: int, per_block: int = 20_000, fan_in: int = 64) -> DataFrame:
    """Assign the rows of ``groups`` (key, weight) to ``n_shards`` shards: rows (key, shard).

    Blocks of about ``per_block`` groups are differenced in tasks of their own. Each leaves one
    partial partition of ``n_shards`` sums; ``fan_in`` of these are differenced at a time, level
    by level, until one is left. No task sees more than a block or ``fan_in`` partial partitions.
    """
    spark = groups.sparkSession
    groups, n = counted(groups.select("key", "weight"), "groups")
    n_blocks = max(1, math.ceil(n / per_block))
    dealt = groups.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(n_blocks)))
    items = written(dealt.groupBy("block").applyInPandas(_difference_items(n_shards), "block long, key binary, weight double, part int"), "items")
    # sums as an array of all parts, empty ones too
    sums = items.groupBy("block", "part").agg(F.sum("weight").alias("w")).groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("part", "w"))).alias("m"))
    sums = sums.select("block", F.transform(F.sequence(F.lit(0), F.lit(n_shards - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("sums"))
    slots = None  # block -> shard of each of its parts
    level = written(sums, "level")
    for _ in range(max(1, math.ceil(math.log(max(2, n_blocks), fan_in)))):
        merged = written(level.withColumn("above", F.floor(F.col("block") / fan_in)).groupBy("above").applyInPandas(_difference_blocks(n_shards), "block long, above long, slots array<int>, sums array<double>"), "merged")
        if slots is None:
            slots = merged.select(F.col("block").alias("leaf"), "above", "slots")
        else:
            up = merged.select(F.col("block").alias("above"), F.col("above").alias("next"), F.col("slots").alias("higher"))
            slots = slots.join(up, "above").select("leaf", F.col("next").alias("above"), F.transform("slots", lambda s: F.element_at("higher", s + 1)).alias("slots"))
        level = merged.groupBy(F.col("above").alias("block")).agg(F.any_value("sums").alias("sums"))
    if slots is None:
        return spark.createDataFrame([], "key binary, shard int")
    return items.join(slots.withColumnRenamed("leaf", "block"), "block").select("key", F.element_at("slots", F.col("part") + 1).alias("shard"))


def shard_documents(docs: DataFrame, n_shards: int = 40, overhead: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Put every document into one of ``n_shards`` shards of near-equal bytes; equal texts stay together.

    Returns doc_id, size, text_crc32, law ('bytes'), shard, slot (from 0 without gaps in each
    shard, by salted ranks) and grown_shard (null: the law is not 'key').

    size is the UTF-8 length plus ``overhead``; null text has no bytes and goes with the empty
    texts. Repeated rows each get a slot. A group larger than a shard's share fills one shard
    alone. An empty table gives no rows. Other columns are not looked at.
    """
    t = text_or_empty(text_col)
    rows = docs.select(column(id_col).alias("doc_id"), (F.octet_length(t) + overhead).cast("long").alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(t.cast("binary"), 256)).alias("key"))
    rows, n = counted(rows, "sizes")
    shards = balance(rows.groupBy("key").agg(F.sum("size").cast("double").alias("weight")), n_shards)
    placed = written(rows.join(shards, "key").select("doc_id", "size", "text_crc32", "shard"), "placed")
    placed = gapless_rank(placed, ["shard"], ["doc_id", "size", "text_crc32"], n, "slot", per_task=20_000 * 8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
