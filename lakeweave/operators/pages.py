"""Jobs over captured pages: settled snapshots, best frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeweave.scratch import counted, written


def settled_snapshot(snapshots: DataFrame, archived: bool = False) -> DataFrame:
    """For each page its first snapshot (page_id, snap_ts, size, ready) after two stable steps in a row, or its last one, with settled false.

    A step is stable if the page is ready before and after it and the size moved by at most a
    hundredth of the previous size, or 256. With ``archived``, ready need only hold afterwards
    and the size must be over 5000.
    """
    w = Window.partitionBy("page_id").orderBy("snap_ts")
    was = F.lag("size").over(w)
    calm = F.abs(F.col("size") - was) <= F.greatest(F.lit(256), F.floor(was / 100))
    ready = F.col("ready") & (F.col("size") > 5000) if archived else F.col("ready") & F.lag("ready").over(w)
    steps = snapshots.withColumn("stable", F.coalesce(calm & ready, F.lit(False)))
    steps = steps.withColumn("twice", F.col("stable") & F.coalesce(F.lag("stable").over(w), F.lit(False)))
    out = steps.groupBy("page_id").agg(F.min_by(F.struct("snap_ts", "size"), F.when(F.col("twice"), F.col("snap_ts"))).alias("first"), F.max_by(F.struct("snap_ts", "size"), F.col("snap_ts")).alias("last"))
    pick = F.coalesce("first", "last")
    return out.select("page_id", pick["snap_ts"].alias("snap_ts"), pick["size"].alias("size"), F.col("first").isNotNull().alias("settled"))


def media_score(photo_wraps: Column, videos: Column, images: Column, url: Column) -> Column:
    """10 for each photo wrap and video source, up to 3 for images, 5 for an embedding URL."""
    return 10 * photo_wraps + 10 * videos + F.least(images, F.lit(3)) + F.when(url.contains("embed=1"), 5).otherwise(0)


def best_frame(frames: DataFrame, roots: DataFrame) -> DataFrame:
    """Of each root (page_id, frame_id) and its descendants the frame with the highest score; the root wins ties, then the lowest index.

    Descendants are found at any depth, by joins with ancestors twice as far each round, until no
    frame has any so far or none meets a further root; each round's result is a written table,
    counted as it is written.
    """
    at = ["page_id", "frame_id"]
    under = written(roots.select(*at, F.col("frame_id").alias("root_id")).distinct(), "under")
    up, n_up = counted(frames.where("page_id is not null and parent_id is not null").select(*at, F.col("parent_id").alias("far_id")).distinct(), "up")
    n = None
    while n_up:
        far = under.withColumnRenamed("frame_id", "far_id")
        under, more = counted(under.unionByName(up.join(far, ["page_id", "far_id"]).select(*at, "root_id")).distinct(), "under")
        if more == n:
            break
        n = more
        up, n_up = counted(up.join(up.select("page_id", F.col("frame_id").alias("far_id"), F.col("far_id").alias("farther")), ["page_id", "far_id"]).select(*at, F.col("farther").alias("far_id")).distinct(), "up")
    found = under.join(frames.select(*at, "score", "frame_idx"), at).withColumn("is_root", F.col("frame_id") == F.col("root_id"))
    best = F.max_by("frame_id", F.struct(F.col("score"), F.col("is_root"), -F.col("frame_idx"), -F.col("frame_id")))
    return found.groupBy("page_id", "root_id").agg(best.alias("best_frame_id"), F.max("score").alias("score"), F.count(F.lit(1)).alias("candidates"))
