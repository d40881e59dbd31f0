"""Cases of the quirks that the web-capture functions keep, and properties against the standard library."""

from __future__ import annotations

import base64
import json
import re
import struct
from pathlib import Path
from urllib.parse import unquote

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lakeweave.functions import cards, dom, media, text, urls
from lakeweave.operators import html as H
from lakeweave.operators import media as J
from lakeweave.operators import pages as P
from lakeweave.plans import attempts as A
from lakeweave.plans import requests as R
from lakeweave.sources import policy


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v")).alias("x")).collect()]


def strip(s):
    return re.sub(r"^[\s]+|[\s]+$", "", s)


def test_clean_url(spark):
    given_urls = ["x+y%20z", "100%zz", "a%C2%A0", "%FF", None, "", "  b "]
    assert column(spark, given_urls, urls.clean_url) == ["x+y z", "100%zz", "a", "�", None, "", "b"]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="ab+%20CéA  \t/", max_size=12), min_size=1, max_size=20))
def test_clean_url_is_unquote_and_strip(spark, values):
    assert column(spark, values, urls.clean_url) == [strip(unquote(v)) for v in values]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="a \n\t", max_size=14), min_size=1, max_size=20))
def test_tidy_markdown(spark, values):
    def plain(s):
        return strip(re.sub(r"(?:\n *){3,}", "\n\n", re.sub(" +", " ", s))).replace("\0", "")

    assert column(spark, values, text.tidy_markdown) == [plain(v) for v in values]


def test_url_domain_keeps_its_quirks(spark):
    assert column(spark, ["www.bbc.co.uk", "HTTPS://WWW.X.COM", "x.photography", "none"], urls.url_domain) == ["co.uk", "WWW.X.COM".split(".", 1)[1], "x.photog", None]


def test_links_of_platforms(spark):
    got = column(spark, ["https://t.me/durov/7 ".strip(), "https://www.facebook.com/plugins/post.php?href=https%3A%2F%2Fwww.facebook.com%2F1%2Fvideos%2F2%2F", "https://x.com/a/status/9/video/1"], urls.classify_link)
    assert [(g.platform, g.kind, g.id, g.media_number) for g in got] == [("telegram", "post", "7", None), ("facebook", "video", None, None), ("x", "post", "9", 1)]


def test_markdown_link_with_text_in_its_title(spark):
    got = column(spark, ['![alt](https://e.org/a.png "a (title) here") x'], text.markdown_links)[0]
    assert [(g.hypertext, g.url) for g in got] == [("alt", "https://e.org/a.png")]


def test_text_data_uris(spark):
    good = "data:text/plain;base64," + base64.b64encode("grüß".encode()).decode()
    got = column(spark, [f"a {good} b {good}", "data:text/plain;base64,/w==", "data:text/plain;base64,aGk", None, ""], text.inline_text_data_uris)
    assert got == ["a grüß b grüß", "data:text/plain;base64,/w==", "data:text/plain;base64,aGk", None, ""]


def test_image_sizes_at_the_bounds(spark):
    rows = [(256, 256, "download"), (256, 256, "data_uri"), (257, 257, "download"), (4096, 300, "download"), (2049, 2049, "download")]
    df = spark.createDataFrame(rows, "w int, h int, o string")
    assert [r[0] for r in df.select(media.image_keep(F.col("w"), F.col("h"), F.col("o"))).collect()] == [False, True, True, False, True]


def test_image_headers(spark):
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08" + struct.pack(">HH", 30, 40) + bytes(9)
    webp = b"RIFF\0\0\0\0WEBPVP8X\0\0\0\0\0\0\0\0" + (9).to_bytes(3, "little") + (19).to_bytes(3, "little")
    bmp = b"BM" + bytes(16) + struct.pack("<ii", 5, -6)
    got = column(spark, [bytearray(jpeg), bytearray(webp), bytearray(bmp), bytearray(b"\x89PNG"), None], media.image_dims, "binary")
    assert [(g.format, g.width, g.height) for g in got] == [("jpeg", 40, 30), ("webp", 10, 20), ("bmp", 5, 6), (None, None, None), (None, None, None)]


def test_sizes_after_long_segments(spark):
    app = b"\xff\xe1\xff\xfe" + bytes(65_532)
    jpeg = b"\xff\xd8" + 3 * app + b"\xff\xe1\x0c\x02" + bytes(3_072) + b"\xff\xc0\x00\x11\x08" + struct.pack(">HH", 600, 800) + bytes(9)
    cut = [jpeg[: 2 + k] for k in (65_530, 65_534, 65_540)]
    got = column(spark, [bytearray(x) for x in (jpeg, *cut, b"x" * 70_000)], media.image_dims, "binary")
    assert len(jpeg) > 199_000 and [(g.format, g.width, g.height) for g in got] == [("jpeg", 800, 600), *[(None, None, None)] * 4]


def test_variants_and_streams(spark):
    v = "array<struct<content_type:string,bit_rate:long,url:string>>"
    assert column(spark, [[("video/mp4", 5, "a"), ("video/mp4", 5, "b")], [("application/x", 9, "c")], []], media.best_video_variant, v) == ["a", None, None]
    s = "array<struct<codec_type:string,codec_name:string,pix_fmt:string,profile:string>>"
    plain, audio = ("video", "h264", "yuv420p", "High"), ("audio", "aac", None, None)
    assert column(spark, [[plain, audio], [plain], [plain, ("video", "hevc", "yuv420p", None), audio], [("video", "h264", "yuv420p", "High 10"), audio], []], media.browser_safe, s) == [True, False, False, False, False]


def test_background_hosts_and_rewriting(spark):
    page = '<div style="background-image:url(\'https://cdn.e.org/a.jpg\');color:red"><p>t</p></div><img src="/s.svg"><img><a style="background-image:url(//telegram.org/img/emoji/1.png)">e</a><video><source src="/v.mp4"></video>'
    pages = spark.createDataFrame([(1, "https://e.org/x", page), (2, "https://e.org/y", "<p>plain"), (3, None, None)], "page_id long, url string, html string")
    got = [tuple(r) for r in H.media_elements(pages).orderBy("page_id", "ordinal").collect()]
    assert got == [(1, 0, "img", "image", None, False), (1, 1, "div", "image", "https://cdn.e.org/a.jpg", True), (1, 2, "source", "video", "/v.mp4", False)]
    attached = spark.createDataFrame([(1, 1, "image", "ab" * 32)], "page_id long, ordinal int, media_kind string, media_id string")
    out = {r.page_id: r.html for r in H.rewrite_media(pages, attached).collect()}
    assert out[1] == '&lt;image:abababababababababababababababab&gt;<div style="color:red"><p>t</p></div><img src="/s.svg"><a style="background-image:url(//telegram.org/img/emoji/1.png)">e</a>'
    assert out[2] == "<p>plain" and out[3] is None


def test_markdown_of_broken_and_deep_pages():
    assert text_of("<h2>A &amp; <b>b</b></h2><ul><li>x</li><li>y<ol start=3><li>z</li></ol></ul>") == "## A & **b**\n\n* x\n* y\n  3. z"
    assert text_of("<p>b<br>c<script>x</script>") == "b  \nc"
    assert text_of("<p><b>T.<br><p>A</p><p>B</p></article>") == "**T.  \n\nA\n\nB**"  # an element ends at no other's start
    assert text_of("<ul><li>a<li>b</ul>") == "* a* b"
    assert text_of("<div>" * 20000 + "deep") == "deep"
    assert text_of("") == ""


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<p>a_b *c* <code>d_e</code></p>", "a\\_b \\*c\\* `d_e`"),
        ('<a href="http://e.org/a_b">http://e.org/a_b</a>', "<http://e.org/a_b>"),
        ('<a href="/x" title="t&quot;q">x <b>y</b> </a>z', '[x **y**](/x "t\\"q") z'),
        ('<a href="/x"> </a><a>plain</a>', "plain"),
        ("<ul><li>a<ul><li>b<ul><li>c</li></ul></li></ul></li><li>d</li></ul><p>e", "* a\n  + b\n    - c\n* d\n\ne"),
        ("<ol start=3><li>x<p>y</p></li>\n<li>z</li></ol>", "3. x\n\n   y\n4. z"),
        ("<table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td colspan=2>2<br>3</td></tr></table>", "| a | b |\n| --- | --- |\n| 1 | 2 3 | |"),
        ("<table><tbody><tr><td>1</td></tr></tbody></table>", "|  |\n| --- |\n| 1 |"),
        ("<table><thead><tr><td>a</td></tr></thead><tbody><tr><td>1</td></tr></tbody></table>", "| a |\n| --- |\n| 1 |"),
        ("<h1> a\n <i>b</i> <img src=x alt=al> </h1>", "# a *b* al"),
        ("<pre>\n x_y\n  z </pre>", "```\n x_y\n  z\n```"),
        ("<code>a`b</code> <del>d</del> <q>e</q>", '`` a`b `` ~~d~~ "e"'),
        ("<blockquote><p>q</p>\n\n<p>r</p></blockquote>", "> q\n>\n> r"),
        ("<dl><dt>a</dt><dd>b</dd></dl>", "a\n:   b"),
        ("<video src=v poster=p></video><video><source src=s>t</video><img src=i title=j>", '[![](p)](v)[t](s)![](i "j")'),
        ("<div> a <!-- c --> b </div>c", "a  b\n\nc"),
    ],
)
def test_markdown_of_elements(page, want):
    assert text_of(page) == want


def test_cards_parse_their_payload_once(spark):

    df = spark.createDataFrame([("{}", "u")], "p string, u string")
    p, u = F.col("p"), F.col("u")
    for card in (cards.x_post_card(p), cards.x_profile_card(p), cards.bluesky_post_card(p), cards.bluesky_profile_card(p, u), cards.tiktok_video_card(p), cards.tiktok_profile_card(p, u, u), cards.generic_video_card(p, u, F.lit(9)), cards.telegram_post_card(p)):
        plan = df.select(card.alias("c")).select("c.text", "c.media")._jdf.queryExecution().optimizedPlan().toString().lower()
        assert plan.count("from_json(") + plan.count("jsontostructs") + plan.count("parse_json(") <= 1 or plan.count("invoke(") == 1, plan


def test_reply_authors_and_facets(spark):

    post = lambda uri, handle, parent=None: json.dumps({"$type": "x", "post": {"uri": uri, "author": {"handle": handle}, "record": {"text": "t", "reply": parent and {"parent": {"uri": parent}}, "facets": [{"features": [{"$type": "app.bsky.richtext.facet#mention", "did": "did:1"}, {"$type": "app.bsky.richtext.facet#tag"}]}]}}})
    rows = [("at://a/1", post("at://a/1", "ann")), ("at://b/2", post("at://b/2", "bob", "at://a/1")), ("at://c/3", post("at://c/3", "cat", "at://gone/9"))]
    got = cards.with_reply_authors(spark.createDataFrame(rows, "uri string, payload string"))
    got = got.select("uri", "parent_handle", cards.bluesky_post_card(F.col("payload"), F.col("parent_handle"))["text"].alias("t"), cards.bluesky_facets(F.col("payload")).alias("f"))
    got = {r.uri: r for r in got.collect()}
    assert {u: r.parent_handle for u, r in got.items()} == {"at://a/1": None, "at://b/2": "ann", "at://c/3": None}
    assert "Reply to: https://bsky.app/profile/ann/post/1" in got["at://b/2"].t and "Reply to" not in got["at://c/3"].t
    assert all((r.f.mentions, r.f.hashtags, r.f.links) == (["did:1"], [""], []) for r in got.values())


def test_documents_of_captures(spark, tmp_path):
    from lakeweave.sources import io

    rows = [("u", "a", 1, 200, "<p>old</p>"), ("u", "a", 2, None, "<p>new_</p>"), ("u", "b", 3, 500, "<p>bad</p>"), ("u", "b", 4, 200, None), ("v", "a", None, 200, "<b>v</b>"), (None, "a", 1, 200, "x")]
    df = spark.createDataFrame(rows, "url string, method string, t int, status int, html string").withColumn("fetched_at", F.timestamp_seconds("t"))
    df.select("url", "method", "fetched_at", "status", "html").write.parquet(f"{tmp_path}/c")
    captures = io.read_captures(spark, f"{tmp_path}/c")
    text = lambda **o: sorted((r.url, r.text) for r in H.captured_documents(captures, **o).collect())
    assert text() == [("u", "new\\_"), ("v", "**v**")] == text(include_media=False)
    assert text(format="html") == [("u", "<p>new_</p>"), ("v", "<b>v</b>")]
    with pytest.raises(ValueError):
        text(format="pdf")


def test_segments_of_large_playlists_come_in_parts(spark):
    rows = [("a", i, bytearray(b"x%d" % i * 3)) for i in range(6)] + [("b", 0, None), ("c", 0, bytearray(b"y")), ("c", 1, None)]
    df = spark.createDataFrame(rows, "playlist_url string, idx int, content binary")
    got = sorted((r.playlist_url, r.part, r.content and bytes(r.content)) for r in J.assemble_segments(df, most_bytes=12).collect())
    assert got == [("a", 0, b"x0x0x0x1x1x1"), ("a", 1, b"x2x2x2x3x3x3"), ("a", 2, b"x4x4x4x5x5x5"), ("b", 0, None), ("c", 0, b"y")]
    assert [bytes(r.content) for r in J.assemble_segments(df).where("playlist_url = 'a'").collect()] == [b"".join(bytes(c) for u, _, c in rows if u == "a")]


def test_short_urls_with_several_redirects(spark):
    short = spark.createDataFrame([("https://t.co/a", 1), ("https://t.co/b", 2), ("https://t.co/c", 3)], "short_url string, k int")
    redirects = spark.createDataFrame([("https://t.co/a", "https://e.org/2", ""), ("https://t.co/a", "https://e.org/1", ""), ("https://t.co/a", "https://t.co/a/", ""), ("https://t.co/b", "https://t.co/b", "")], "short_url string, final_url string, body string")
    assert sorted(tuple(r) for r in urls.expand_short_urls(short, redirects).collect()) == [("https://t.co/a", 1, "https://e.org/1"), ("https://t.co/b", 2, None), ("https://t.co/c", 3, None)]


def test_scratch_folders(spark):
    from lakeweave import scratch

    path = scratch.written(spark.range(3)).inputFiles()[0]
    assert scratch.clear_scratch(spark) > 0 and not Path(path.removeprefix("file://")).exists()


def text_of(page):
    return re.sub(r"\n{3,}", "\n\n", dom.markdown(dom.parse(page))).strip()


def attempts(spark, rows):
    full = [(u, s, m, None, None, c, None, e, 1.0) for u, s, m, c, e in rows]
    return spark.createDataFrame(full, "url string, step int, method string, ts timestamp, status int, content string, error_class string, error_message string, elapsed double")


def test_first_success(spark):
    log = attempts(spark, [("a", 0, "x", None, "no"), ("a", 1, "y", "", None), ("a", 2, "z", "late", None), ("b", 0, "x", None, "p"), ("b", 1, "x", None, None), ("c", 0, "x", "ok", None)])
    got = {r.url: r for r in A.first_success(log).collect()}
    assert (got["a"].content, got["a"].method, {k: v.message for k, v in got["a"].errors.items()}) == ("", "y", {"x": "no"})
    assert (got["b"].content, got["b"].successful, {k: v.message for k, v in got["b"].errors.items()}) == (None, False, {"x": "Method x returned no content."})
    assert got["c"].errors == {}


def test_requests_and_routes(spark):
    rows = [(1, "https://reddit.com/a", ["decodo"], "markdown"), (2, "https://reddit.com/a", None, "markdown"), (3, "https://ghostarchive.org/x", None, "html"), (4, "https://truthsocial.com/x", None, "html")]
    req = spark.createDataFrame(rows, "pos long, url string, methods array<string>, format string")
    plan = R.validate_plan(R.route_methods(R.dedupe_requests(req), policy.load_domain_policy(spark)))
    got = {r.url.split("/")[2]: (r.steps, r.status) for r in plan.collect()}
    assert got == {"reddit.com": ([], "no_methods"), "ghostarchive.org": (["Ghostarchive", "firecrawl", "decodo"], "html_needs_scraper"), "truthsocial.com": (["firecrawl"], "ok")}


def test_albums(spark):
    posts = spark.createDataFrame([("c", 1, 5, "photo"), ("c", 11, 5, "photo"), ("c", 12, 5, "photo"), ("c", 13, None, "video"), ("c", 2, None, None)], "channel string, post_id long, grouped_id long, media_type string")
    got = {r.anchor_id: [i.post_id for i in r["items"]] for r in J.assemble_album(posts, posts.select("channel", "post_id")).collect()}
    assert got == {1: [1, 11], 11: [1, 11, 12], 12: [11, 12], 13: [13]}


def test_best_frame_ties_and_strangers(spark):
    frames = spark.createDataFrame([(1, 10, None, 0, 3), (1, 11, 10, 1, 3), (1, 12, 11, 2, 9), (1, 13, None, 3, 99)], "page_id long, frame_id long, parent_id long, frame_idx int, score int")
    roots = spark.createDataFrame([(1, 10), (1, 13)], "page_id long, frame_id long")
    assert {r.root_id: r.best_frame_id for r in P.best_frame(frames, roots).collect()} == {10: 12, 13: 13}
    assert P.best_frame(frames.where("frame_id < 12"), roots.where("frame_id = 10")).first().best_frame_id == 10


def test_counts_missing_null_and_odd(spark):
    payloads = ['{"upload_date":"20240231"}', '{"view_count":null}', '{"view_count":1.5}', '{"view_count":1234567}', "no json"]
    got = column(spark, payloads, lambda c: cards.generic_video_card(c, F.lit("Site")))
    assert [g and re.search(r"Views: (\S+)", g.text)[1] for g in got] == ["0", "Unknown", "Unknown", "1,234,567", None]
    assert "Posted: 20240231" in got[0].text


def test_oversize_video_gives_way_to_its_thumbnail(spark):
    rows = [("video", 10, 0, "v", "t"), ("video", 10, 9, "v", "t"), ("video", 9, 9, "v", None), ("video", 10, 9, "v", None), ("video", None, 9, None, "t")]
    df = spark.createDataFrame(rows, "kind string, size long, max_video_size long, url string, thumbnail string")
    assert [(r.kind, r.url) for r in J.cap_media_size(df, thumbnails=True).collect()] == [("video", "v"), ("image", "t"), ("video", "v"), ("image", "t")]


def test_first_success_across_batches(spark, tmp_path):
    from lakeweave.streaming import streams as S

    rows = [("a", 0, None), ("b", 0, "x"), ("c", 0, None), ("a", 1, "y"), ("b", 1, "z"), ("c", 1, None), ("a", 2, "w"), ("b", 2, None), ("c", 2, "late")]
    kind = "url string, step int, content string, method string, ts timestamp, error_message string"
    for cuts in ([0, 9], [0, 3, 6, 9], list(range(10))):
        path = tmp_path / str(len(cuts))
        for i, j in zip(cuts, cuts[1:], strict=False):
            spark.createDataFrame(rows[i:j], "url string, step int, content string").selectExpr("*", "'m' AS method", "timestamp'2024-01-01' AS ts", "cast(null AS string) AS error_message").coalesce(1).write.mode("append").parquet(f"{path}/log")
        feed = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{path}/log")
        S.stream_first_success(feed, last_step=1).writeStream.format("parquet").option("checkpointLocation", f"{path}/state").option("path", f"{path}/rows").trigger(availableNow=True).start().awaitTermination()
        got = spark.read.parquet(f"{path}/rows").collect()
        assert sorted((r.url, r.content or "", r.successful) for r in got) == [("a", "y", True), ("b", "x", True), ("c", "", False)], cuts


def test_best_frame_at_any_depth(spark):
    rows = [(1, i, i - 1 if i else None, i, i // 99) for i in range(100)] + [(2, 0, 2, 0, 1), (2, 1, 0, 1, 5), (2, 2, 1, 2, 3)]
    frames = spark.createDataFrame(rows, "page_id long, frame_id long, parent_id long, frame_idx long, score long")
    roots = spark.createDataFrame([(1, 0), (1, 50), (2, 0)], "page_id long, frame_id long")
    got = {(r.page_id, r.root_id): (r.best_frame_id, r.score, r.candidates) for r in P.best_frame(frames, roots).collect()}
    assert got == {(1, 0): (99, 1, 100), (1, 50): (99, 1, 50), (2, 0): (1, 5, 3)}
