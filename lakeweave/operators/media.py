"""Jobs over media tables: playlists, segments, albums, caps."""

from __future__ import annotations

from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeweave.functions.media import image_dims, image_keep, over_cap, video_fetch_mode


@F.pandas_udf(T.StringType())
def join_url(base: pd.Series, uri: pd.Series) -> pd.Series:
    return pd.Series([None if b is None or u is None else urljoin(b, u) for b, u in zip(base, uri, strict=True)])


def parse_playlist(playlists: DataFrame) -> DataFrame:
    """Rows url, is_master, is_cmaf, idx, target of HLS playlists (url, text).

    A master gives its last variant only; a media playlist its segments in order. Relative
    targets are joined to the playlist's URL.
    """
    lines = F.filter(F.transform(F.split("text", r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    named = playlists.select("url", "text", lines.alias("lines"))
    named = named.withColumn("is_master", F.exists("lines", lambda x: x.startswith("#EXT-X-STREAM-INF"))).withColumn("targets", F.filter("lines", lambda x: ~x.startswith("#")))
    cmaf = F.contains("text", F.lit("#EXT-X-MAP")) | F.exists("targets", lambda x: F.lower(x).rlike(r"\.(m4s|mp4|cmfv)$"))
    named = named.withColumn("is_cmaf", ~F.col("is_master") & cmaf).withColumn("targets", F.when(F.col("is_master"), F.slice("targets", F.greatest(F.size("targets"), F.lit(1)), 1)).otherwise(F.col("targets")))
    rows = named.select("url", "is_master", "is_cmaf", F.posexplode("targets").alias("idx", "raw"))
    whole = F.col("raw").rlike("^https?://")
    joined = F.when(whole, F.col("raw")).otherwise(join_url("url", F.when(~whole, F.col("raw"))))
    return rows.select("url", "is_master", "is_cmaf", "idx", joined.alias("target"))


def assemble_segments(segments: DataFrame, most_bytes: int = 1 << 30) -> DataFrame:
    """Content of each playlist from its segments in order, missing ones skipped; null without any.

    Rows playlist_url, part, size, content. A playlist over ``most_bytes``, which one row couldn't
    hold, comes in parts from 0 on: each begins with the first segment behind a multiple of it.
    One shuffle by playlist serves the running size and the parts.
    """
    before = F.sum(F.octet_length("content")).over(Window.partitionBy("playlist_url").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1))
    dealt = segments.withColumn("part", F.floor(F.coalesce(before, F.lit(0)) / most_bytes).cast("int"))
    return dealt.groupBy("playlist_url", "part").agg(F.sum(F.octet_length("content")).alias("size"), F.expr("listagg(content) within group (order by idx)").alias("content"))


def cap_media_size(media: DataFrame, thumbnails: bool = False) -> DataFrame:
    """Drop videos (kind, size, max_video_size) over the cap; with ``thumbnails``, the thumbnail takes the place of one that is absent or dropped."""
    over = (F.col("kind") == "video") & over_cap(F.col("size"), F.col("max_video_size"))
    if not thumbnails:
        return media.where(~F.coalesce(over, F.lit(False)))
    gone = F.coalesce(over, F.lit(False)) | F.col("url").isNull()
    swapped = {"kind": F.when(gone & F.col("thumbnail").isNotNull(), "image").otherwise(F.col("kind")), "url": F.when(gone, F.col("thumbnail")).otherwise(F.col("url"))}
    return media.withColumns(swapped).where("url is not null")


def assemble_album(posts: DataFrame, anchors: DataFrame, reach: int = 10) -> DataFrame:
    """For each anchor (channel, post_id) the posts with media of its upload: equal grouped_id, at most ``reach`` ids away, in order of id.

    An anchor without a group has itself only; such rows don't enter the join, where their null
    key would meet nothing.
    """
    at = anchors.select("channel", F.col("post_id").alias("anchor_id")).join(posts.select("channel", F.col("post_id").alias("anchor_id"), "grouped_id", "media_type"), ["channel", "anchor_id"])
    own = posts.where("grouped_id is not null and media_type is not null").select("channel", "grouped_id", "post_id", F.col("media_type").alias("kind"))
    near = at.where("grouped_id is not null").drop("media_type").join(own, ["channel", "grouped_id"]).where(F.abs(F.col("post_id") - F.col("anchor_id")) <= reach)
    single = at.where("grouped_id is null and media_type is not null").select("channel", "grouped_id", "anchor_id", F.col("anchor_id").alias("post_id"), F.col("media_type").alias("kind"))
    rows = near.unionByName(single)
    return rows.groupBy("channel", "anchor_id").agg(F.array_sort(F.collect_list(F.struct("post_id", "kind"))).alias("items"))


def attach_media(elements: DataFrame, blobs: DataFrame, ignore_small: bool = True, page: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """Add media_id, media_kind, width and height to elements (``page`` columns, ordinal, kind, uri, origin), from media metadata (url, media_id, kind, width, height, and fetched_at if there is one). What fails the size test has none.

    On a page every element with a URI gets the same medium: that of the kind which the URI's
    first element asks for, so that an image address that holds a video gives nothing. A URL that
    was fetched several times counts as last fetched, or has the largest media_id of equal ones.
    """
    order = [F.col(c) for c in ("fetched_at", "media_id") if c in blobs.columns]
    latest = blobs.groupBy("url", "kind").agg(F.max_by(F.struct("media_id", "width", "height"), F.struct(*order)).alias("m"))
    meta = latest.select(F.col("url").alias("uri"), F.col("kind").alias("asked"), F.col("m.media_id").alias("media_id"), F.col("kind").alias("media_kind"), F.col("m.width").alias("width"), F.col("m.height").alias("height"))
    first = F.min_by("kind", "ordinal").over(Window.partitionBy(*page, "uri"))
    # media grow with the table: broadcast, they would lie whole in each task's memory
    joined = elements.withColumn("asked", first).join(meta.hint("merge"), ["uri", "asked"], "left").drop("asked")
    keep = F.coalesce((F.col("media_kind") == "video") | image_keep(F.col("width"), F.col("height"), F.col("origin"), ignore_small), F.lit(False))
    return joined.withColumn("media_id", F.when(keep, F.col("media_id"))).withColumn("media_kind", F.when(keep, F.col("media_kind")))


def media_catalogue(blobs: DataFrame) -> DataFrame:
    """url, kind, media_id, format, width, height, size and fetched_at of what can serve as a medium, from media blobs (url, content_type, content_length, content, and fetched_at if there is one).

    ``media_id`` is the SHA-256 of the content: blobs of one content are one medium. A URL counts
    as last fetched (where that is equal or unknown, as the largest media_id), its empty and null
    contents as not fetched. It gives an image where the content's header is an image's, whatever
    type was announced, and a video where type or address are a video's or a playlist's; some URLs
    give both. What gives neither has no row.

    Contents are hashed and headers read where the blobs lie: only a short row a blob is shuffled.
    """
    fetched = F.col("fetched_at") if "fetched_at" in blobs.columns else F.lit(None).cast("timestamp")
    rows = blobs.where(F.octet_length("content") > 0).select(
        "url", fetched.alias("fetched_at"), F.sha2("content", 256).alias("media_id"), F.octet_length("content").cast("long").alias("size"),
        image_dims(F.col("content")).alias("d"), (video_fetch_mode(F.col("content_type"), F.col("url")) != "unsupported").alias("video"),
    )
    rest = F.struct("media_id", "size", "d", "video", "fetched_at")
    latest = rows.groupBy("url").agg(F.max_by(rest, F.struct("fetched_at", "media_id")).alias("m")).select("url", "m.*")
    kinds = F.filter(F.array(F.when(F.col("d.format").isNotNull(), "image"), F.when(F.col("video"), "video")), lambda k: k.isNotNull())
    side = lambda c: F.when(F.col("kind") == "image", F.col(f"d.{c}")).alias(c)
    return latest.withColumn("kind", F.explode(kinds)).select("url", "kind", "media_id", side("format"), side("width"), side("height"), "size", "fetched_at")


def media_store(blobs: DataFrame) -> DataFrame:
    """media_id, size, content and uses (blobs) of each distinct content; the bytes of one blob a content are moved, and only where a content occurs more than once."""
    named = blobs.where(F.octet_length("content") > 0).select(F.sha2("content", 256).alias("media_id"), "url", "content")
    counts = named.groupBy("media_id").agg(F.count(F.lit(1)).alias("uses"), F.min("url").alias("url"))
    one = named.join(counts, ["media_id", "url"], "left_semi").groupBy("media_id").agg(F.first("content").alias("content"))
    return one.join(counts.select("media_id", "uses"), "media_id").select("media_id", F.octet_length("content").cast("long").alias("size"), "uses", "content")


def unique_media_urls(elements: DataFrame, per_page: bool = True) -> DataFrame:
    """Distinct fetchable URIs with the kind of their first occurrence, in each page or in all."""
    where = ["page_id", "uri"] if per_page else ["uri"]
    first = F.min_by("kind", F.struct("page_id", "ordinal")).alias("kind")
    return elements.where("uri is not null").groupBy(*where).agg(first, F.count(F.lit(1)).alias("uses"))
