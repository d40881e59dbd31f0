"""Exact deduplication by 128-bit content hash with a byte comparison inside groups. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeweave.llm.common import column, fresh, row_name, text_or_empty, written


def content_hash(text: Column) -> Column:
    """128 bits of the UTF-8 bytes."""
    return F.unhex(F.md5(text.cast("binary")))


def exact_groups(docs: DataFrame, keep: str = "largest", id_col: str = "doc_id", text_col: str = "text", hash_of: Callable[[Column], Column] = content_hash) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Rows are grouped by ``hash_of`` the text; of each group the row with the largest (or
    smallest) id stays. Inside groups of two or more the bytes are compared with those of the
    row that stays; texts that only collide are grouped anew by (hash, text). Partial
    aggregation shrinks hot groups before the shuffle, and texts meet only in plain joins,
    whose skewed partitions Spark splits.

    Null text counts as empty. Rows that repeat an id and its text count in group_size and
    share keep_id and kept. A null id stays only where the group has no other. An empty table
    gives no rows. Other columns are not looked at.
    """
    best = {"largest": F.max, "smallest": F.min}[keep]
    base = docs.select(column(id_col).alias("doc_id"), text_or_empty(text_col).alias("t"))
    hashed = base.select("doc_id", hash_of(F.col("t")).alias("h"), "t")
    groups = written(hashed.groupBy("h").agg(best("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n")).where("n > 1"), "groups")

    sha = F.sha2(F.col("t").cast("binary"), 256).alias("text_sha256")
    alone = hashed.select("doc_id", "h", sha).join(groups.select("h").hint("merge"), "h", "left_anti").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")

    members = written(hashed.select("doc_id", "h", "t", sha).join(groups.hint("merge"), "h"), "members")
    # tables of their own: Spark splits a hot key only where plain rows, not aggregates, meet
    stays = written(members.where(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy("h").agg(F.min("t").alias("kept_text")), "stays")
    met = members.join(stays.hint("merge"), "h").withColumn("same", F.col("t") == F.col("kept_text"))
    met = written(met.select("doc_id", "h", "keep_id", "text_sha256", "same", F.when(~F.col("same"), F.col("t")).alias("t")), "compared")

    size = written(met.where("same").groupBy("h").agg(F.count(F.lit(1)).alias("group_size")), "sizes")
    equal = met.where("same").join(size.hint("merge"), "h").select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")

    collided = met.where("not same").select("doc_id", "h", "t", "text_sha256")
    own = collided.groupBy("h", "t").agg(best("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    apart = collided.join(own, ["h", "t"]).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
    return alone.unionByName(equal).unionByName(apart)


def drop_copies(docs: DataFrame, keep: str = "largest", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose text another row has too; all columns, whatever their names, stay as they are.

    Rows are told apart by id and text, so that different texts under one id, or none, all stay;
    of rows with one id and text one stays. Null text counts as empty. A null id stays only where
    no other row has the text. An empty table gives no rows.
    """
    own, text = fresh(docs, "id", "sha")
    groups = exact_groups(docs, keep, id_col, text_col).where("kept")
    stays = groups.select(row_name(F.col("doc_id")).alias(own), F.col("text_sha256").alias(text)).distinct()
    named = docs.withColumns({own: row_name(column(id_col)), text: F.sha2(text_or_empty(text_col).cast("binary"), 256)})
    return named.join(stays, [own, text], "left_semi").dropDuplicates([own, text]).select(*map(column, docs.columns))
