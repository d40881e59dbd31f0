"""Following addresses through tables until nothing is new: links behind redirects and wrappers, playlists behind playlists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeweave.functions.urls import classify_link, is_short, redirected, unwrapped
from lakeweave.operators.media import assemble_segments, parse_playlist
from lakeweave.scratch import written


def follow(starts: DataFrame, step: Callable[[DataFrame], DataFrame], most_rounds: int = 1000) -> DataFrame:
    """url, final_url, hops and looped of each distinct address in ``starts`` (url).

    ``step`` adds ``next`` to rows with ``at``: where the address leads, null where it ends. A
    round moves only the addresses that still lead on; those that ended stay in the table of their
    round. An address that leads to one on its own way ends there, with ``looped``; as a way never
    holds an address twice, rounds end.
    """
    ways = starts.where("url is not null").select("url").distinct().select("url", F.col("url").alias("at"), F.array("url").alias("way"), F.lit(False).alias("looped"))
    ended: list[DataFrame] = []
    for _ in range(most_rounds):
        moved = written(step(ways), "ways")
        open_ = F.col("next").isNotNull() & ~F.array_contains("way", F.col("next"))
        ended.append(moved.where(~F.coalesce(open_, F.lit(False))).select("url", F.col("at").alias("final_url"), (F.size("way") - 1).alias("hops"), F.col("next").isNotNull().alias("looped")))
        ways = moved.where(open_).select("url", F.col("next").alias("at"), F.concat("way", F.array("next")).alias("way"), "looped")
        if ways.isEmpty():
            out = ended[0]
            for more in ended[1:]:
                out = out.unionByName(more)
            return out
    raise RuntimeError("follow: more rounds needed than most_rounds")


def normal_links(links: DataFrame, redirects: DataFrame) -> DataFrame:
    """url, final_url, hops and status of each distinct cleaned address (url): publishing, login and embedding addresses give way to what they carry, short ones to where their redirect (short_url, final_url, body) leads, to a fixed point.

    Status: 'ok', 'unavailable' where a short address has no redirect that leads elsewhere, or
    'loop'. Only short addresses meet the redirects.
    """
    told = redirects.groupBy("short_url").agg(F.min(redirected()).alias("long"))

    def step(ways: DataFrame) -> DataFrame:
        short = F.when(is_short(F.col("at")), F.col("at"))
        return ways.withColumn("short", short).join(told.withColumnRenamed("short_url", "short"), "short", "left").withColumn("next", F.coalesce("long", unwrapped(F.col("at")))).drop("short", "long")

    found = follow(links, step)
    status = F.when(F.col("looped"), "loop").when(is_short(F.col("final_url")), "unavailable").otherwise("ok")
    return found.select("url", "final_url", "hops", status.alias("status"))


def classified_links(links: DataFrame, redirects: DataFrame) -> DataFrame:
    """``normal_links`` with ``link``, the class of the address each one stands for; null where that isn't known."""
    found = normal_links(links, redirects)
    return found.withColumn("link", F.when(F.col("status") == "ok", classify_link(F.col("final_url"))))


def follow_playlists(starts: DataFrame, playlists: DataFrame) -> DataFrame:
    """url, playlist_url, hops, status and is_cmaf of each distinct playlist address (url): masters give way to their last variant, until one has segments.

    ``playlists`` has url and text; of several texts of an address the largest counts. Status:
    'media', 'cmaf' (segments that have to be remuxed), 'empty', 'missing' (no text) or 'loop'.
    """
    one = playlists.where("text is not null").groupBy("url").agg(F.max("text").alias("text"))
    lists = written(parse_playlist(one), "lists")
    onward = lists.where("is_master").select(F.col("url").alias("at"), F.col("target").alias("next"))
    found = follow(starts, lambda ways: ways.join(onward, "at", "left"))
    known = one.select(F.col("url").alias("final_url"), F.lit(True).alias("known"))
    sort = lists.where("not is_master").groupBy(F.col("url").alias("final_url")).agg(F.max("is_cmaf").alias("is_cmaf"))
    status = F.when(F.col("looped"), "loop").when(F.col("known").isNull(), "missing").when(F.col("is_cmaf").isNull(), "empty").when(F.col("is_cmaf"), "cmaf").otherwise("media")
    return found.join(known, "final_url", "left").join(sort, "final_url", "left").select("url", F.col("final_url").alias("playlist_url"), "hops", status.alias("status"), F.coalesce("is_cmaf", F.lit(False)).alias("is_cmaf"))


def playlist_contents(followed: DataFrame, playlists: DataFrame, blobs: DataFrame, most_bytes: int = 1 << 30) -> DataFrame:
    """playlist_url, part, size and content of each playlist that ``follow_playlists`` ended at with status 'media': its segments' bytes (blobs: url, content) in order, missing ones skipped; playlists without any have no row.

    Of several blobs of an address the largest content counts. However many addresses lead to a
    playlist, its bytes are put together once.
    """
    one = playlists.where("text is not null").groupBy("url").agg(F.max("text").alias("text"))
    wanted = followed.where("status = 'media'").select(F.col("playlist_url").alias("url")).distinct()
    parts = parse_playlist(one.join(wanted, "url", "left_semi")).select(F.col("url").alias("playlist_url"), "idx", F.col("target").alias("segment_url"))
    have = blobs.where(F.octet_length("content") > 0).select(F.col("url").alias("segment_url"), "content")
    have = have.join(parts.select("segment_url").distinct(), "segment_url", "left_semi").groupBy("segment_url").agg(F.max("content").alias("content"))
    return assemble_segments(parts.join(have, "segment_url").select("playlist_url", "idx", "content"), most_bytes)
