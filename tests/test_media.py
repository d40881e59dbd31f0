"""Media catalogue, parsed pages, and following of links and playlists on odd rows."""

from __future__ import annotations

import hashlib
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lakeweave.functions import dom, urls
from lakeweave.operators import follow as L
from lakeweave.operators import html as H
from lakeweave.operators import media as J
from lakeweave.operators import nodes as N

BLOB = "url string, content_type string, content_length long, content binary"


def png(w, h, more=b""):
    return b"\x89PNG\r\n\x1a\n\0\0\0\x0dIHDR" + struct.pack(">II", w, h) + more


def test_catalogue_of_odd_blobs(spark):
    one, two = png(300, 400), png(300, 400, b"x")
    rows = [("a", None, None, bytearray(one)), ("a", "image/png", 1, bytearray(two)), ("b", "video/mp4", 1, None), ("c", "video/mp4", 1, bytearray()), ("d.mp4", None, None, bytearray(b"v")), (None, "image/png", 1, bytearray(one)), ("e", "application/x-mpegURL", 1, bytearray(b"#EXTM3U"))]
    got = {(r.url, r.kind, r.media_id, r.width) for r in J.media_catalogue(spark.createDataFrame(rows, BLOB)).collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert got == {("a", "image", max(sha(one), sha(two)), 300), ("d.mp4", "video", sha(b"v"), None), (None, "image", sha(one), 300), ("e", "video", sha(b"#EXTM3U"), None)}
    store = {r.media_id: (r.uses, bytes(r.content)) for r in J.media_store(spark.createDataFrame([*rows[:2], ("x", None, 1, bytearray(two)), ("x", None, 1, bytearray(two))], BLOB)).collect()}
    assert store == {sha(one): (1, one), sha(two): (3, two)}
    assert J.media_catalogue(spark.createDataFrame([], BLOB)).count() == 0


def test_catalogue_moves_no_bytes(spark):
    plan = J.media_catalogue(spark.createDataFrame([("a", None, 1, bytearray(b"x"))], BLOB))._jdf.queryExecution().executedPlan().toString()
    below = [line for line in plan.split("\n") if "Exchange" in line]
    assert below and all("content#" not in line for line in below)


def test_pages_that_share_id_and_address(spark):
    """Three rows of one page id, two of them with one address too, keep their own media."""
    html = '<p>{}</p><img src="/{}.png">'
    pages = [(1, "http://x.org/1", html.format("a", 1)), (1, "http://y.org/1", html.format("b", 1)), (1, "http://x.org/1", html.format("c", 2)), (None, None, html.format("d", 1)), (2, "http://x.org/2", None)]
    blobs = [("http://x.org/1.png", "image/png", 1, bytearray(png(300, 300))), ("http://x.org/2.png", "image/png", 1, bytearray(png(301, 300)))]
    got = H.to_documents(spark.createDataFrame(pages, "page_id long, url string, html string"), J.media_catalogue(spark.createDataFrame(blobs, BLOB))).collect()
    ref = lambda w: "<image:" + hashlib.sha256(png(w, 300)).hexdigest()[:32] + ">"
    assert sorted((str(r.page_id), str(r.text), len(r["items"])) for r in got) == sorted([("1", "a\n\n" + ref(300), 1), ("1", "b", 0), ("1", "c\n\n" + ref(301), 1), ("None", "d", 0), ("2", "None", 0)])


def test_the_first_element_decides_the_kind(spark):
    """Images come before videos in the list of a page's elements, wherever they stand."""
    page = '<video src="/w"></video><video src="/w"></video><video src="/v"></video><img src="/v">'
    blobs = [("http://x.org/v", "video/mp4", 1, bytearray(b"v")), ("http://x.org/w", "video/mp4", 1, bytearray(b"w"))]
    got = H.to_documents(spark.createDataFrame([(1, "http://x.org/p", page)], "page_id long, url string, html string"), J.media_catalogue(spark.createDataFrame(blobs, BLOB))).first()
    ref = "<video:" + hashlib.sha256(b"w").hexdigest()[:32] + ">"
    assert got.text == ref + ref and [i.token for i in got["items"]] == [ref, ref]


def test_a_page_is_parsed_once(spark, monkeypatch):
    pages = spark.createDataFrame([(1, "http://x.org/p", "<p>x<img src='/a.png'></p>")], "page_id long, url string, html string")
    plan = H.to_documents(pages, J.media_catalogue(spark.createDataFrame([], BLOB)))._jdf.queryExecution().executedPlan().toString()
    assert "html#" not in plan and "parse" not in plan.lower().replace("parsed", "")


MARKUP = st.lists(st.sampled_from(["<p>", "</p>", "<div class='a b'>", "</div>", "<b>", "</b>", "text", " &amp; ", "<br>", "<img src=x>", "<!-- c -->", "<script>1<2</script>", "<a href>", "</a>", "<h1>", "</h1>", "é"]), max_size=25).map("".join)


@settings(max_examples=150, deadline=None)
@given(MARKUP)
def test_nodes_are_the_tree(page):
    root = dom.parse(page)
    lists, nodes = N.flat(root)
    assert all(lists[1][i] == i + len(n.walk()) for i, n in enumerate(nodes))
    again = N.tree(*next(N.page_nodes(N.node_array([lists]))))[0]
    assert dom.serialize(again) == dom.serialize(root) and dom.markdown(again) == dom.markdown(dom.parse(page))


def test_work_on_nodes(spark):
    html = ["<p>a</p><div id=x><p>b<i>c</i></p><script>no</script>d</div><p>e</p>", "<div></div>", "", None, "<p>" * 5000 + "deep"]
    df = N.parsed(spark.createDataFrame(list(enumerate(html)), "k int, html string"))
    n = F.col("nodes")
    got = df.orderBy("k").select(N.count_nodes(n, N.of_tag("p", "div")), N.node_html(N.subtree(n, N.of_tag("div"))), N.node_html(N.without(n, "script", "div")), N.node_text(n)).collect()
    assert [r[0] for r in got[:3]] == [4, 1, 0] and got[4][0] == 5000
    assert [r[1] for r in got] == ['<div id="x"><p>b<i>c</i></p><script>no</script>d</div>', "<div></div>", None, None, None]
    assert [r[2] for r in got][:4] == ["<p>a</p><p>e</p>", "", "", None]
    assert [r[3] for r in got] == ["a b c d e", "", "", None, "deep"]


@pytest.mark.parametrize("url", ["https://a.svg", "https://a.example/x.JPG?w=1", "http://x/y.png;v=1", "//c.example/a.b/c", "a.webp#x", "/a/b.SVG?c.png", "https://u.example/é.jpg", "", "x.jpg/", "https://h.example.png", "data:image/x.png"])
def test_suffixes_are_told_alike(spark, url):
    kind = spark.range(1).select(urls.url_media_class(F.lit(url))).first()[0]
    assert (H._suffix(url) in urls.PIXEL, H._suffix(url) in urls.VECTOR) == (kind == "image", kind == "vector")
    style = f"background-image:url({url})"
    assert H._background(style) == spark.range(1).select(urls.background_image_url(F.lit(style))).first()[0]


def test_ways_of_links(spark):
    hops = [("https://t.co/1", "https://t.co/2", None), ("https://t.co/2", "https://t.co/3", None), ("https://t.co/3", "https://t.co/1", None), ("https://t.co/4", "https://t.co/4/", None), ("https://t.co/5", "https://t.co/6", None), ("https://t.co/6", "https://example.org/", None), ("https://t.co/6", None, None)]
    links = [(f"https://t.co/{k}",) for k in range(1, 8)] + [("https://t.co/5",), (None,), ("https://publish.twitter.com/?query=",), ("https://x.com/a",), ("https://publish.twitter.com/?query=https%3A%2F%2Fpublish.twitter.com%2F%3Fquery%3Dhttps%253A%252F%252Fx.com%252Fyou",)]
    got = {r.url: (r.final_url, r.hops, r.status) for r in L.normal_links(spark.createDataFrame(links, "url string"), spark.createDataFrame(hops, "short_url string, final_url string, body string")).collect()}
    assert len(got) == 10
    assert got["https://t.co/1"] == ("https://t.co/3", 2, "loop") and got["https://t.co/2"] == ("https://t.co/1", 2, "loop")
    assert got["https://t.co/4"] == ("https://t.co/4", 0, "unavailable") and got["https://t.co/7"][2] == "unavailable"
    assert got["https://t.co/5"] == ("https://example.org/", 2, "ok") and got[links[-1][0]] == ("https://x.com/you", 2, "ok")
    assert got["https://publish.twitter.com/?query="] == ("https://publish.twitter.com/?query=", 0, "ok")
    assert L.normal_links(spark.createDataFrame([], "url string"), spark.createDataFrame(hops, "short_url string, final_url string, body string")).count() == 0


def test_playlists_of_all_sorts(spark):
    lists = [("http://h/m", "#EXTM3U\n#EXT-X-STREAM-INF:X\nlow\n#EXT-X-STREAM-INF:X\nhi"), ("http://h/hi", "#EXTM3U\n1.ts\n2.ts"), ("http://h/self", "#EXT-X-STREAM-INF:X\nself"), ("http://h/empty", "#EXTM3U\n"), ("http://h/null", None), ("http://h/frag", "#EXTM3U\na.m4s"), ("http://h/frag2", "#EXTM3U\na.m4s?x"), ("http://h/bare", "#EXT-X-STREAM-INF:X\n")]
    starts = [(f"http://h/{n}",) for n in ("m", "hi", "m", "self", "empty", "null", "frag", "frag2", "bare", "none")]
    playlists = spark.createDataFrame(lists, "url string, text string")
    found = L.follow_playlists(spark.createDataFrame(starts, "url string"), playlists)
    got = {r.url[9:]: (r.playlist_url[9:], r.hops, r.status) for r in found.collect()}
    assert got == {"m": ("hi", 1, "media"), "hi": ("hi", 0, "media"), "self": ("self", 0, "loop"), "empty": ("empty", 0, "empty"), "null": ("null", 0, "missing"), "frag": ("frag", 0, "cmaf"), "frag2": ("frag2", 0, "media"), "bare": ("bare", 0, "empty"), "none": ("none", 0, "missing")}
    blobs = spark.createDataFrame([("http://h/1.ts", bytearray(b"a")), ("http://h/1.ts", bytearray(b"A")), ("http://h/2.ts", None)], "url string, content binary")
    assert [(r.playlist_url, bytes(r.content)) for r in L.playlist_contents(found, playlists, blobs).collect()] == [("http://h/hi", b"a")]


def test_rules_by_domain(spark):
    seen = spark.sparkContext.accumulator(0)

    def rule(h):
        seen.add(1)
        return None if h == "keep" else h + "!"

    pages = [(1, "http://www.a.org/x", "p"), (2, "http://a.org/", "keep"), (3, "http://b.org/", "q"), (4, "http://a.org/", None), (5, None, "r")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    assert {r.page_id: r.html for r in H.post_process(df, {"a.org": rule}).collect()} == {1: "p!", 2: "keep", 3: "q", 4: None, 5: "r"}
    assert seen.value == 2
    assert H.post_process(df, {}).count() == 5


def tiff(order, w, h, kind, far=0):
    num = lambda v, n: v.to_bytes(n, order)
    entry = lambda tag, v: num(tag, 2) + num(kind, 2) + num(1, 4) + (num(v, 2) + b"\0\0" if kind == 3 else num(v, 4))
    return (b"II*\0" if order == "little" else b"MM\0*") + num(8 + far, 4) + bytes(far) + num(3, 2) + entry(254, 0) + entry(256, w) + entry(257, h)


def box(kind, *parts):
    body = b"".join(parts)
    return (8 + len(body)).to_bytes(4, "big") + kind + body


def avif(w, h, wide=False, primary=True):
    ispe = lambda a, b: box(b"ispe", bytes(4), struct.pack(">II", a, b))
    own = (b"\0\0\0\1" + struct.pack(">I", 2) + struct.pack(">HBH", 1, 1, 1) + struct.pack(">HBHH", 7, 2, 3, 0x8002)) if wide else (bytes(4) + struct.pack(">I", 2) + struct.pack(">HBB", 1, 1, 1) + struct.pack(">HBBB", 7, 2, 3, 0x82))
    props = box(b"iprp", box(b"ipco", ispe(4000, 4000), ispe(w, h), box(b"pixi", bytes(8))), *([box(b"ipma", own)] if primary else []))
    return box(b"ftyp", b"avif", bytes(4), b"mif1") + box(b"free", bytes(3)) + box(b"meta", bytes(4), box(b"hdlr", bytes(20)), *([box(b"pitm", bytes(4), struct.pack(">H", 7))] if primary else []), props)


def test_image_containers(spark):
    from lakeweave.functions import media

    ico = b"\0\0\1\0\2\0" + bytes([16, 16]) + bytes(14) + bytes([0, 64]) + bytes(14)
    old_bmp = b"BM" + bytes(12) + struct.pack("<IHH", 12, 300, 200) + bytes(4)
    bmp = b"BM" + bytes(12) + struct.pack("<Iii", 40, 301, -201)
    files = {"ico": ico, "old": old_bmp, "bmp": bmp, "far": tiff("little", 310, 210, 4, 200_000), "t3": tiff("big", 65_000, 2, 3), "a1": avif(640, 480), "a2": avif(641, 481, wide=True), "a3": avif(1, 2, primary=False), "cut": avif(640, 480)[:60], "t0": b"II*\0" + bytes(4), "heic": box(b"ftyp", b"heic", bytes(4), b"mif1") + bytes(99), "i0": b"\0\0\1\0" + bytes(20)}
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in files.items()], "k string, content binary")
    got = {r.k: (r.d.format, r.d.width, r.d.height) for r in df.select("k", media.image_dims(F.col("content")).alias("d")).collect()}
    none = (None, None, None)
    assert got == {"ico": ("ico", 256, 64), "old": ("bmp", 300, 200), "bmp": ("bmp", 301, 201), "far": ("tiff", 310, 210), "t3": ("tiff", 65_000, 2), "a1": ("avif", 640, 480), "a2": ("avif", 641, 481), "a3": ("avif", 4000, 4000), "cut": none, "t0": none, "heic": none, "i0": none}


@settings(max_examples=300, deadline=None)
@given(st.sampled_from([b"II*\0", b"MM\0*", b"\0\0\1\0", b"BM", b"\0\0\0\x18ftypavif"]), st.binary(max_size=200))
def test_headers_of_any_bytes(start, rest):
    from lakeweave.functions import media

    assert len(media.header(start + rest)) == 3
