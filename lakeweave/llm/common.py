"""Helpers shared by the corpus operators: scratch tables, gapless ranks, connected components."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeweave.scratch import counted, scratch_dir, written

__all__ = ["column", "components", "counted", "fresh", "gapless_rank", "low_hashes", "row_id", "row_name", "scratch_dir", "text_or_empty", "written"]


def column(name: str) -> Column:
    """The column of just this name, whatever signs are in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before them as long as ``df`` has columns of these names."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def text_or_empty(text_col: str = "text") -> Column:
    return F.coalesce(column(text_col), F.lit(""))


def row_id(id_col: str = "doc_id") -> Column:
    """The id as a long; a null id is taken as the least long."""
    return F.coalesce(column(id_col).cast("long"), F.lit(-(2**63)))


def row_name(row_id: Column) -> Column:
    """The id as text that is never null."""
    return F.coalesce(F.concat(F.lit("="), row_id.cast("string")), F.lit(""))


def low_hashes(df: DataFrame, hashed: Column, share: float) -> DataFrame:
    """About that share of the rows, those with the least 64-bit hashes; all where it is 1 or more. Without a shuffle."""
    return df if share >= 1 else df.where(hashed < F.lit(min(2**63 - 1, int(-(2**63) + share * 2**64))))


def gapless_rank(df: DataFrame, keys: list[str], order: list[str], rows: int, out: str = "rank", per_task: int = 20_000) -> DataFrame:
    """Number the rows of each key from 0 without gaps, though one key may hold most rows.

    Rows are dealt to (key, salt) groups by a hash of ``order``; counts of the groups give
    each one's first number. ``rows`` is the row count of ``df``: it sets the number of salts.
    """
    salts = max(4, math.ceil(rows / per_task))
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    at = [*keys, "__salt"]
    first = (
        salted.groupBy(*at)
        .agg(F.count(F.lit(1)).alias("__n"))
        .withColumn("__first", F.coalesce(F.sum("__n").over(Window.partitionBy(*keys).orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .drop("__n")
    )
    own = F.row_number().over(Window.partitionBy(*at).orderBy(*order)) - 1
    return salted.join(first, at).withColumn(out, F.col("__first") + own).drop("__salt", "__first")


def components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """Connected components of ``edges`` (a, b): rows (id, component), component the smallest id reachable.

    Each round joins every vertex with its neighbours' labels and then with its label's own
    label, so that the number of rounds grows with the logarithm of the longest chain. Vertices
    without edges don't occur. Labels stay distributed; a round's result is a written table.
    """
    both = written(edges.select(F.col("a").alias("id"), F.col("b").alias("to")).union(edges.select("b", "a")).where("id <> to").distinct(), "edges")
    labels = written(both.groupBy("id").agg(F.least(F.min("to"), F.col("id")).alias("component")), "labels")
    for _ in range(max_rounds):
        near = both.join(labels.withColumnRenamed("id", "to"), "to").groupBy("id").agg(F.min("component").alias("near"))
        step = labels.join(near, "id", "left").select("id", F.col("component").alias("was"), F.least("component", F.coalesce("near", "component")).alias("component"))
        # the vertex whose id was the label passes its smaller label on to all that bore it
        hop = step.groupBy(F.col("was").alias("root")).agg(F.min("component").alias("hop"))
        root = step.select(F.col("id").alias("root"), F.col("component").alias("own"))
        jump = hop.join(root, "root", "left").select(F.col("root").alias("was"), F.least("hop", F.coalesce("own", "hop")).alias("hop"))
        new = written(step.join(jump, "was").select("id", "was", F.least("component", "hop").alias("component")), "labels")
        changed = new.where("component <> was").limit(1).count()
        labels = new.select("id", "component")
        if not changed:
            return labels
    raise RuntimeError("components: more rounds needed than max_rounds")
