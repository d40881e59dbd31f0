"""Registered queries whose inputs vary with the tables' values, so that every outcome of an operator occurs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeweave.functions import cards as C
from lakeweave.functions import urls as U
from lakeweave.operators import html as H
from lakeweave.operators import media as J
from lakeweave.operators import pages as P
from lakeweave.plans import requests as R
from lakeweave.queries import query, table
from lakeweave.queries_content import _ran, in_parts
from lakeweave.scratch import scratch_dir
from lakeweave.sources import io
from lakeweave.streaming import streams as S


def _text(*parts):
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


# --- links and plans --------------------------------------------------------------------------

_USER, _ID = "'u' || page_id || 'name'", "(7000000000000 + page_id)"


@query(f"""WITH p AS (SELECT page_id, page_id % 12 AS k, {_USER} AS u, {_ID}::VARCHAR AS i FROM pages)
    SELECT page_id, CASE WHEN k < 3 THEN 'x' WHEN k < 5 THEN 'tiktok' WHEN k = 5 THEN 'facebook' WHEN k < 8 THEN 'instagram' WHEN k < 10 THEN 'telegram' ELSE 'bluesky' END AS platform,
    CASE k WHEN 0 THEN 'post' WHEN 1 THEN 'post' WHEN 2 THEN 'profile' WHEN 3 THEN 'video' WHEN 4 THEN 'profile' WHEN 5 THEN 'video' WHEN 6 THEN 'video' WHEN 7 THEN 'profile' WHEN 8 THEN 'post' WHEN 9 THEN 'invalid' WHEN 10 THEN 'post' ELSE 'profile' END AS kind,
    CASE WHEN k IN (0, 1, 3, 5, 8, 10) THEN i END AS id, CASE WHEN k IN (2, 3, 4, 7, 8, 10, 11) THEN u END AS username, CASE WHEN k = 1 THEN (page_id % 4 + 1)::INT END AS media_number FROM p""")
def classify_link_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names, ids and media numbers come from the pages."""
    i = F.col("page_id")
    u, n = _text("u", i, "name"), (7000000000000 + i).cast("string")
    links = [
        _text("https://x.com/", u, "/status/", n), _text("https://twitter.com/", u, "/status/", n, "/photo/", i % 4 + 1), _text("https://x.com/", u), _text("https://www.tiktok.com/@", u, "/video/", n), _text("https://www.tiktok.com/@", u),
        _text("https://www.facebook.com/watch/?v=", n), _text("https://www.instagram.com/reel/", n, "/"), _text("https://www.instagram.com/", u, "/"), _text("https://t.me/", u, "/", n), _text("https://t.me/", u),
        _text("https://bsky.app/profile/", u, "/post/", n), _text("https://bsky.app/profile/", u),
    ]
    link = U.classify_link(F.element_at(F.array(*links), (i % len(links) + 1).cast("int")))
    return table(spark, sf_dir, "pages").select("page_id", link.alias("l")).select("page_id", "l.platform", "l.kind", "l.id", "l.username", "l.media_number")


@query("""SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'image' WHEN 1 THEN 'video' END AS direct_kind, page_id % 3 < 2 AND page_id % 5 > 1 AS direct_ok, CASE WHEN page_id % 3 < 2 AND page_id % 5 > 1 THEN 'Direct download' END AS method FROM pages""")
def direct_media_downloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fifth of the files can't be had, another gives a medium of another kind: both fall through to the steps."""
    i = F.col("page_id")
    url = _text("https://f.example.org/", i, F.when(i % 3 == 0, ".jpg").when(i % 3 == 1, ".mp4").otherwise(".html"))
    pages = table(spark, sf_dir, "pages").select("page_id", url.alias("clean_url"), F.lit("markdown").alias("format"), F.lit(True).alias("include_media"))
    kind = F.when((i % 3 == 0) != (i % 5 == 1), "image").otherwise("video")
    blobs = pages.where("page_id % 5 > 0").select(F.col("clean_url").alias("url"), kind.alias("kind"))
    return R.direct_media_shortcut(pages, blobs.union(blobs)).select("page_id", "direct_kind", "direct_ok", "method")


# --- pages and media --------------------------------------------------------------------------


@query("""WITH m AS (SELECT 'https://m.example.org/' || l_partkey AS uri, l_orderkey, l_linenumber, CASE WHEN l_suppkey % 2 = 0 THEN 'video' ELSE 'image' END AS kind FROM lineitem WHERE l_quantity < 40)
    SELECT uri, arg_min(kind, (l_orderkey, l_linenumber)) AS kind, count(*) AS uses FROM m GROUP BY uri""")
def unique_media_urls_of_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    elements = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page_id"), F.col("l_linenumber").alias("ordinal"), F.when(F.col("l_suppkey") % 2 == 0, "video").otherwise("image").alias("kind"), F.when(F.col("l_quantity") < 40, _text("https://m.example.org/", F.col("l_partkey"))).alias("uri"))
    return J.unique_media_urls(elements, per_page=False)


@query("""SELECT page_id // 50 AS k, sum(strlen(html) + 1) AS content_length, sha256(string_agg(html || chr(10), '' ORDER BY page_id)) AS media_id FROM pages GROUP BY 1""")
def read_media_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blobs as a folder of files, one for every 50 pages."""
    path = scratch_dir(spark)
    rows = table(spark, sf_dir, "pages").select("page_id", F.floor(F.col("page_id") / 50).alias("k"), F.col("html").alias("value"))
    rows.repartition("k").sortWithinPartitions("k", "page_id").select("k", "value").write.partitionBy("k").text(path)
    got = io.read_media_blobs(spark, f"{path}/*/*.txt", files=True)
    return got.select(F.regexp_extract("url", r"k=(\d+)", 1).cast("long").alias("k"), "content_length", F.sha2("content", 256).alias("media_id"))


_ESCAPED = "replace(url, '&', '&amp;')"


@query(f"""SELECT page_id, '<p>' || {_ESCAPED} || '</p>' || CASE WHEN page_id % 2 = 0 THEN '&lt;image:' || substr(sha256(page_id::VARCHAR), 1, 32) || '&gt;' ELSE '' END || '<div style="color:red"><b>' || page_id || '</b></div><img src="/' || page_id || '.svg">'
    || CASE WHEN page_id % 2 = 0 THEN '&lt;video:' || substr(sha256(page_id::VARCHAR), 1, 32) || '&gt;' ELSE '' END || 'end' AS html FROM pages""")
def rewrite_media_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole pages: an image, a styled block that stays, a vector graphic that stays, a video."""
    i = F.col("page_id")
    html = _text("<p>", F.replace("url", F.lit("&"), F.lit("&amp;")), '</p><img src="/', i, '.jpg"><div style="background-image:url(https://cdn.example.org/', i, '.png);color:red"><b>', i, '</b></div><img src="/', i, '.svg"><video src="/', i, '.mp4"></video>end')
    at = F.explode(F.array(F.struct(F.lit(0).alias("ordinal"), F.lit("image").alias("media_kind")), F.struct(F.lit(2).alias("ordinal"), F.lit("video").alias("media_kind"))))
    attached = table(spark, sf_dir, "pages").where("page_id % 2 = 0").select("page_id", at.alias("a"), F.sha2(i.cast("string"), 256).alias("media_id")).select("page_id", "a.*", "media_id")
    return H.rewrite_media(table(spark, sf_dir, "pages").select("page_id", "url", html.alias("html")), attached).select("page_id", "html")


_SIZES = "page_id % 50 AS n, page_id % 4 AS wraps, page_id % 3 AS videos, page_id % 6 AS images, page_id % 2 AS bare, page_id % 7 = 0 AS framed, page_id % 11 = 0 AS archived"


@query(f"""WITH p AS (SELECT page_id, {_SIZES}, length(left(url, page_id % 50)) AS said FROM pages)
    SELECT page_id, said AS text_length, said > 40 OR wraps > 0 OR bare > 0 OR videos > 0 OR framed AS ready_perma, said > 40 OR videos > 0 OR 1 + wraps + videos + images + 2 * bare + framed::INT + archived::INT > 3 AS ready_wayback, archived,
    10 * wraps + 10 * videos + least(images, 3) + CASE WHEN page_id % 5 = 0 THEN 5 ELSE 0 END AS score FROM p""")
def readiness_and_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small pages whose features all vary; the score is of the features found."""
    i = F.col("page_id")
    html = F.concat(
        _text("<html><body><p>", F.expr("left(url, cast(page_id % 50 as int))"), "</p>"), F.repeat(F.lit('<a class="tgme_widget_message_photo_wrap" style="background-image:url(/b.jpg)"></a>'), (i % 4).cast("int")), F.repeat(F.lit('<a class="tgme_widget_message_photo_wrap"></a>'), (i % 2).cast("int")), F.repeat(F.lit('<video src="v"></video>'), (i % 3).cast("int")), F.repeat(F.lit("<img>"), (i % 2).cast("int")), F.repeat(F.lit('<img src="">'), (i % 6).cast("int")),
        F.when(i % 7 == 0, "<iframe></iframe>").otherwise(""), F.when(i % 11 == 0, '<a href="https://g.example.org/_/http://a.example"></a>').otherwise(""), F.lit("</body></html>"),
    )
    pages = table(spark, sf_dir, "pages").select("page_id", html.alias("html"))
    url = F.when(i % 5 == 0, "https://t.me/a/1?embed=1").otherwise("https://t.me/a/1")
    return H.page_readiness(pages).select("page_id", "text_length", "ready_perma", "ready_wayback", "archived", P.media_score(F.col("photo_wraps"), F.col("videos"), F.col("images"), url).alias("score"))


@query("""WITH o AS (SELECT o_orderkey, o_custkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS parent FROM orders)
    SELECT o_orderkey, CASE WHEN parent IS NULL THEN NULL WHEN parent % 3 > 0 THEN 'h' || parent END AS parent_handle, CASE WHEN parent % 3 > 0 THEN 'Reply to: https://bsky.app/profile/h' || parent || '/post/' || parent ELSE '' END AS reply, 'did:' || o_custkey AS mentions FROM o""")
def bluesky_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order replies to its customer's order before; posts without a handle name no author."""
    k = F.col("o_orderkey")
    parent = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    uri = lambda x: F.concat(F.lit("at://d/app.bsky.feed.post/"), x.cast("string"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", parent.alias("parent"))
    author = F.struct(F.when(k % 3 > 0, _text("h", k)).alias("handle"))
    feature = F.struct(F.lit("app.bsky.richtext.facet#mention").alias("$type"), _text("did:", F.col("o_custkey")).alias("did"))
    reply = F.when(F.col("parent").isNotNull(), F.struct(F.struct(uri(F.col("parent")).alias("uri")).alias("parent")))
    record = F.struct(F.lit("t").alias("text"), F.array(F.struct(F.array(feature).alias("features"))).alias("facets"), reply.alias("reply"))
    posts = rows.select("o_orderkey", uri(k).alias("uri"), F.to_json(F.struct(F.struct(author.alias("author"), record.alias("record")).alias("post"))).alias("payload"))
    got = C.with_reply_authors(posts)
    card = C.bluesky_post_card(F.col("payload"), F.col("parent_handle"))
    return got.select("o_orderkey", "parent_handle", F.element_at(F.split(card["text"], "\n"), 5).alias("reply"), F.array_join(C.bluesky_facets(F.col("payload"))["mentions"], " ").alias("mentions"))


# --- streams ----------------------------------------------------------------------------------


@query("SELECT 'https://example.org/' || user_id AS url, min(event_id) AS event_id, arg_min(event_type, event_id) AS kind FROM events GROUP BY 1")
def stream_first_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first request of each URL comes in the first batch, all others in later ones and go."""
    nth = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    rows = table(spark, sf_dir, "events").select(F.concat(F.lit("https://example.org/"), F.col("user_id").cast("string")).alias("url"), F.col("ts").cast("timestamp").alias("ts"), "event_id", F.col("event_type").alias("kind"), nth.alias("nth"))
    feed = in_parts(spark, rows, F.least("nth", F.lit(3))).drop("nth")
    return _ran(S.stream_dedupe_requests(feed, "400 days")).select("url", "event_id", "kind")


@query("""WITH e AS (SELECT *, date_trunc('day', ts) AS d FROM events), m AS (SELECT max(ts) - INTERVAL 2 DAY AS mark FROM events)
    SELECT d::TIMESTAMP AS window_start, event_type AS method, count(*) AS n, round(avg(value), 6) AS avg_time, event_type = 'view' AND count(*) > 40 AS over_budget FROM e, m WHERE d + INTERVAL 1 DAY <= mark GROUP BY 1, 2""")
def stream_closed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Append mode: a window is written once, when the watermark has passed its end."""
    path = scratch_dir(spark)
    rows = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("method"), F.col("value").alias("elapsed"))
    rows.repartitionByRange(4, "ts").sortWithinPartitions("ts").write.parquet(path)
    feed = spark.readStream.schema(rows.schema).parquet(path)
    got = _ran(S.stream_method_stats(feed, {"view": 40}, "1 day", "2 days"))
    return got.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "method", "n", F.round("avg_time", 6).alias("avg_time"), "over_budget")
