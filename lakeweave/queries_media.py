"""Registered queries from stored blobs to documents, over parsed pages, and of what follows addresses through tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeweave.operators import follow as L
from lakeweave.operators import html as H
from lakeweave.operators import media as J
from lakeweave.operators import nodes as N
from lakeweave.queries import query, table
from lakeweave.scratch import scratch_dir
from lakeweave.sources import io


def _text(*parts: str | Column) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def _day(day: int | Column) -> Column:
    return F.make_timestamp(F.lit(2024), F.lit(1), F.lit(day) if isinstance(day, int) else day, F.lit(0), F.lit(0), F.lit(0))


# --- from blobs to documents ------------------------------------------------------------------

#: Bytes before the sides in a PNG's header.
PNG = "89504E470D0A1A0A0000000D49484452"


def _png(width: Column, height: Column, more: Column) -> Column:
    side = lambda c: F.unhex(F.lpad(F.hex(c.cast("long")), 8, "0"))
    return F.concat(F.unhex(F.lit(PNG)), side(width), side(height), more.cast("binary"))


def _png_sql(width: str, height: str, more: str) -> str:
    return f"unhex('{PNG}' || printf('%08X', {width}) || printf('%08X', {height}) || hex(encode({more})))"


def _blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blobs table: of each page's addresses one is fetched twice, two hold one content, one announces an image and holds text, one holds nothing, one holds a picture that is announced as a video."""
    i = F.col("page_id")
    at = lambda name: _text("https://a.example.org/", i, "/", name)
    one = _png(300 + i % 900, 200 + i % 333, F.col("html"))
    row = lambda url, kind, day, content: F.struct(url.alias("url"), F.lit(kind).alias("content_type"), F.octet_length(content).cast("long").alias("content_length"), content.alias("content"), _day(day).alias("fetched_at"))
    rows = [
        row(at("1.png"), "image/png", 1, F.concat(F.lit("GIF89a").cast("binary"), F.unhex(F.lit("E803E803")))), row(at("1.png"), "image/png", 3, one), row(at("1.png"), "image/png", 2, F.lit("error").cast("binary")),
        row(at("2.jpg"), "application/octet-stream", 1, one), row(at("v.mp4"), "video/mp4", 1, _text("v", i).cast("binary")), row(at("w"), "Video/webm; x=1", 1, _text("w", i).cast("binary")),
        row(at("3.png"), "image/png", 1, F.lit("<html>").cast("binary")), row(at("4.png"), "image/png", 1, F.lit("").cast("binary")), row(at("5"), "video/mp4", 1, _png(F.lit(257), F.lit(2000), _text(i))),
    ]
    path = scratch_dir(spark)
    table(spark, sf_dir, "pages").select(F.explode(F.array(*rows)).alias("b")).select("b.*").write.parquet(path)
    return io.read_media_blobs(spark, path, fetched=True)


_AT = "'https://a.example.org/' || page_id || '/"
_ONE, _FIVE = _png_sql("300 + page_id % 900", "200 + page_id % 333", "html"), _png_sql("257", "2000", "page_id::VARCHAR")
_CATALOGUE = f"""c AS (SELECT page_id, unnest([
    struct_pack(url := {_AT}1.png', kind := 'image', media_id := sha256({_ONE}), width := 300 + page_id % 900, height := 200 + page_id % 333, size := octet_length({_ONE})),
    struct_pack(url := {_AT}2.jpg', kind := 'image', media_id := sha256({_ONE}), width := 300 + page_id % 900, height := 200 + page_id % 333, size := octet_length({_ONE})),
    struct_pack(url := {_AT}v.mp4', kind := 'video', media_id := sha256('v' || page_id), width := NULL, height := NULL, size := strlen('v' || page_id)),
    struct_pack(url := {_AT}w', kind := 'video', media_id := sha256('w' || page_id), width := NULL, height := NULL, size := strlen('w' || page_id)),
    struct_pack(url := {_AT}5', kind := 'image', media_id := sha256({_FIVE}), width := 257, height := 2000, size := octet_length({_FIVE})),
    struct_pack(url := {_AT}5', kind := 'video', media_id := sha256({_FIVE}), width := NULL, height := NULL, size := octet_length({_FIVE}))], recursive := true) FROM pages)"""


@query(f"WITH {_CATALOGUE} SELECT url, kind, media_id, CASE kind WHEN 'image' THEN 'png' END AS format, width, height, size, CASE WHEN url LIKE '%/1.png' THEN 3 ELSE 1 END AS day FROM c")
def media_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.media_catalogue(_blobs(spark, sf_dir)).withColumn("day", F.day("fetched_at")).drop("fetched_at")


@query(f"""WITH b AS (SELECT unhex('474946383961E803E803') AS content FROM pages UNION ALL SELECT {_ONE} FROM pages UNION ALL SELECT {_ONE} FROM pages UNION ALL SELECT encode('error') FROM pages UNION ALL SELECT encode('v' || page_id) FROM pages
    UNION ALL SELECT encode('w' || page_id) FROM pages UNION ALL SELECT encode('<html>') FROM pages UNION ALL SELECT {_FIVE} FROM pages)
    SELECT sha256(content) AS media_id, octet_length(any_value(content)) AS size, count(*) AS uses, sha256(any_value(content)) AS content_sha256 FROM b GROUP BY 1""")
def media_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.media_store(_blobs(spark, sf_dir)).select("media_id", "size", "uses", F.sha2("content", 256).alias("content_sha256"))


@query(f"""WITH p AS (SELECT page_id, '<image:' || substr(sha256({_ONE}), 1, 32) || '>' AS one, '<video:' || substr(sha256('w' || page_id), 1, 32) || '>' AS w, '<image:' || substr(sha256({_FIVE}), 1, 32) || '>' AS five, 200 + page_id % 333 > 256 AS keep FROM pages)
    SELECT page_id, 'https://a.example.org/' || page_id AS url, CASE WHEN keep THEN 'a ' || one || ' ' || one ELSE 'a' END || ' c ' || w || ' d ' || five || five || CASE WHEN keep THEN ' ' || one ELSE '' END || ' e' AS text, CASE WHEN keep THEN 6 ELSE 3 END AS n_items FROM p
    UNION ALL SELECT page_id, 'https://b.example.org/' || page_id, 'b ' || CASE WHEN keep THEN one || ' ' ELSE '' END || 'f', CASE WHEN keep THEN 1 ELSE 0 END FROM p""")
def documents_of_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the blobs table to documents: addresses fetched twice, one content at two addresses, page ids that two pages share, an image's address that holds a video."""
    i = F.col("page_id")
    img = lambda name: _text('<img src="/', i, "/", name, '">')
    first = _text("a ", img("1.png"), " ", img("2.jpg"), " ", img("v.mp4"), '<video src="/', i, '/v.mp4"></video> c <video src="/', i, '/w"></video> ', img("3.png"), img("4.png"), "d ", img("5"), '<video src="/', i, '/5"></video>', " ", img("1.png"), " e")
    other = _text('b <img src="https://a.example.org/', i, '/1.png"> ', img("1.png"), "f")
    both = F.explode(F.array(F.struct(_text("https://a.example.org/", i).alias("url"), first.alias("html")), F.struct(_text("https://b.example.org/", i).alias("url"), other.alias("html"))))
    pages = table(spark, sf_dir, "pages").select("page_id", both.alias("p")).select("page_id", "p.*")
    return H.to_documents(pages, J.media_catalogue(_blobs(spark, sf_dir))).select("page_id", "url", "text", F.size("items").alias("n_items"))


# --- parsed pages -----------------------------------------------------------------------------


@query(r"""WITH a AS (SELECT *, regexp_extract(html, '<article>(.*?)</article>', 1, 's') AS art FROM pages)
    SELECT page_id, len(regexp_extract_all(html, '<p>')) AS paragraphs, len(regexp_extract_all(html, '<a href')) AS links, len(regexp_extract_all(html, '<div class="ad">')) AS ads,
    trim(regexp_replace(replace(replace(regexp_replace(regexp_replace(art, '<h1>.*?</h1>', '', 's'), '<[^>]*>', ' ', 'g'), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g')) AS text FROM a""")
def parsed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, a subtree and its text without the heading: one parse a page, all else is work on its nodes."""
    pages = N.parsed(table(spark, sf_dir, "pages").select("page_id", "html"))
    n = F.col("nodes")
    return pages.select("page_id", N.count_nodes(n, N.of_tag("p")).alias("paragraphs"), N.count_nodes(n, N.of_tag("a")).alias("links"), N.count_nodes(n, N.has_class("ad")).alias("ads"), N.node_text(N.without(N.subtree(n, N.of_tag("article")), "h1")).alias("text"))


@query("""SELECT page_id, CASE page_id % 3 WHEN 0 THEN replace(html, '<p>', '<p>!') WHEN 1 THEN '<p>' || strlen(html) || '</p>' ELSE html END AS html FROM pages""")
def post_process(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two registered rules; pages of other domains stay as they are."""
    i = F.col("page_id")
    url = F.when(i % 3 == 0, _text("https://www.loud.test/", i)).when(i % 3 == 1, _text("https://a.short.test/", i)).otherwise(_text("https://plain.example/", i))
    rules = {"loud.test": lambda h: h.replace("<p>", "<p>!"), "short.test": lambda h: f"<p>{len(h.encode())}</p>"}
    return H.post_process(table(spark, sf_dir, "pages").select("page_id", url.alias("url"), "html"), rules).select("page_id", "html")


# --- following addresses ----------------------------------------------------------------------


@query("""WITH p AS (SELECT page_id, page_id % 7 AS k FROM pages)
    SELECT page_id, CASE k WHEN 0 THEN 'ok' WHEN 1 THEN 'loop' WHEN 2 THEN 'unavailable' WHEN 3 THEN 'ok' WHEN 4 THEN 'ok' WHEN 5 THEN 'ok' ELSE 'ok' END AS status, CASE k WHEN 0 THEN 3 WHEN 1 THEN 1 WHEN 2 THEN 0 WHEN 3 THEN 1 WHEN 4 THEN 2 WHEN 5 THEN 0 ELSE 3 END AS hops,
    CASE WHEN k IN (0, 5) THEN 'x' WHEN k IN (3, 6) THEN 'facebook' WHEN k = 4 THEN 'tiktok' END AS platform, CASE k WHEN 0 THEN 'post' WHEN 3 THEN 'video' WHEN 4 THEN 'video' WHEN 5 THEN 'profile' WHEN 6 THEN 'post' END AS kind,
    CASE WHEN k IN (0, 4) THEN (7000000000000 + page_id)::VARCHAR END AS id FROM p""")
def classified_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short links to short links to publishing links to posts, logins, refreshes, links that go round, and dead ones."""
    i = F.col("page_id")
    n, k = (7000000000000 + i).cast("string"), i % 7
    encoded = lambda *parts: F.url_encode(_text(*parts))
    short = _text("https://t.co/a", i)
    post = _text("https://x.com/me/status/", n)
    login = _text("https://www.facebook.com/login/?next=", encoded("https://www.facebook.com/reel/", i))
    url = F.when(k.isin(0, 1, 2, 4, 6), short).when(k == 3, login).otherwise(_text("https://x.com/u", i, "name"))
    publish = _text("https://publish.twitter.com/?query=", F.url_encode(post))
    embed = _text("https://www.facebook.com/plugins/post.php?href=", encoded("https://www.facebook.com/a/posts/", i))
    hop = lambda at, to, body=None: F.struct(at.alias("short_url"), to.alias("final_url"), F.lit(body).cast("string").alias("body") if not isinstance(body, Column) else body.alias("body"))
    none = F.array().cast("array<struct<short_url:string,final_url:string,body:string>>")
    second = _text("https://t.co/b", i)
    hops = (
        F.when(k == 0, F.array(hop(short, second), hop(second, publish)))
        .when(k == 1, F.array(hop(short, second), hop(second, F.concat(short, F.lit("")))))
        .when(k == 2, F.array(hop(short, F.concat(short, F.lit("/")))))
        .when(k == 4, F.array(hop(short, short, _text('<meta content="0;URL=https://t.co/b', i, '">')), hop(second, _text("https://www.tiktok.com/@me/video/", n))))
        .when(k == 6, F.array(hop(short, _text("https://www.facebook.com/login/?next=", F.url_encode(embed)))))
        .otherwise(none)
    )
    pages = table(spark, sf_dir, "pages").select("page_id", url.alias("url"), hops.alias("hops"))
    redirects = pages.select(F.explode("hops").alias("h")).select("h.*")
    got = L.classified_links(pages, redirects.unionByName(redirects))
    return pages.select("page_id", "url").join(got, "url").select("page_id", "status", "hops", "link.platform", "link.kind", "link.id")


@query("""WITH p AS (SELECT *, page_id % 5 AS k FROM pages)
    SELECT page_id, CASE k WHEN 0 THEN 'media' WHEN 1 THEN 'media' WHEN 2 THEN 'loop' WHEN 3 THEN 'missing' ELSE 'cmaf' END AS status, CASE k WHEN 0 THEN 2 WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 1 ELSE 0 END AS hops,
    CASE k WHEN 0 THEN sha256(html || url) WHEN 1 THEN sha256(html || 'x') END AS content_sha256 FROM p""")
def followed_playlists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the address of a master by way of variants to the assembled bytes; masters that go round, missing ones, fragmented ones."""
    i = F.col("page_id")
    k, root = i % 5, _text("https://h.example.org/", i, "/")
    master = lambda *targets: F.concat(F.lit("#EXTM3U\n"), *(_text("#EXT-X-STREAM-INF:BANDWIDTH=1\n", t, "\n") for t in targets))
    media = lambda *targets: F.concat(F.lit("#EXTM3U\n"), *(_text("#EXTINF:4,\n", t, "\n") for t in targets))
    one = lambda name, text: F.struct(_text(root, name).alias("url"), text.alias("text"))
    lists = (
        F.when(k == 0, F.array(one("start.m3u8", master("low/list.m3u8", "hi/list.m3u8")), one("hi/list.m3u8", master("../all.m3u8")), one("all.m3u8", media("1.ts", "gone.ts", "2.ts"))))
        .when(k == 1, F.array(one("start.m3u8", media("1.ts", _text("https://cdn.example.org/", i, ".ts")))))
        .when(k == 2, F.array(one("start.m3u8", master("round.m3u8")), one("round.m3u8", master("start.m3u8"))))
        .when(k == 3, F.array(one("start.m3u8", master("nowhere.m3u8"))))
        .otherwise(F.array(one("start.m3u8", F.concat(F.lit('#EXT-X-MAP:URI="i.mp4"\n'), media("1.ts")))))
    )
    pages = table(spark, sf_dir, "pages")
    playlists = pages.select(F.explode(lists).alias("l")).select("l.*")
    bytes_of = lambda url, content: F.struct(url.alias("url"), content.cast("binary").alias("content"))
    second = F.when(k == 0, bytes_of(_text(root, "2.ts"), F.col("url"))).otherwise(bytes_of(_text("https://cdn.example.org/", i, ".ts"), F.lit("x")))
    blobs = pages.where("page_id % 5 < 2").select(F.explode(F.array(bytes_of(_text(root, "1.ts"), F.col("html")), second)).alias("b")).select("b.*")
    starts = pages.select("page_id", _text(root, "start.m3u8").alias("url"))
    found = L.follow_playlists(starts, playlists)
    contents = L.playlist_contents(found, playlists, blobs).select("playlist_url", F.sha2("content", 256).alias("content_sha256"))
    return starts.join(found, "url").join(contents, "playlist_url", "left").select("page_id", "status", "hops", "content_sha256")
