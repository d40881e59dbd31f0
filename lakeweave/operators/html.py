"""Jobs over HTML: media elements, rewriting with media references, Markdown documents, page features."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from urllib.parse import urljoin

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeweave.functions import dom
from lakeweave.functions.media import decode_data_uri_media, header, is_streaming
from lakeweave.functions.slices import by_slices, in_slices
from lakeweave.functions.text import inline_text_data_uris, tidy_markdown
from lakeweave.functions.urls import BACKGROUND, PATH, PIXEL, VECTOR, let, resolve_media_url, url_domain
from lakeweave.operators.media import attach_media
from lakeweave.operators.nodes import page_nodes, parsed, tree
from lakeweave.scratch import written

DROPPED = ("script", "style", "noscript", "footer", "aside")
ELEMENTS = "ordinal int, tag string, kind string, raw_uri string, has_child_tags boolean"
ELEMENT = pa.schema([("ordinal", pa.int32()), ("tag", pa.string()), ("kind", pa.string()), ("raw_uri", pa.string()), ("has_child_tags", pa.bool_())])
_BACKGROUND, _PATH = re.compile(BACKGROUND), re.compile(PATH)


def _suffix(url: str) -> str:
    """Suffix of the path, as ``url_media_class`` sees it; a bare host has none."""
    path = _PATH.match(re.sub(r"[?#].*$", "", url))[1]
    return re.sub(r";[^/]*$", "", path).rpartition("/")[2].rpartition(".")[2].lower() if "." in path else ""


def _background(style: str | None) -> str | None:
    found = _BACKGROUND.search(style or "")
    if not found:
        return None
    url = "https:" + found[1] if found[1].startswith("//") else found[1]
    low = url.lower()
    if low.startswith("data:") or "/emoji/" in low or "/emojis/" in low or _suffix(url) in VECTOR:
        return None
    return url if _suffix(url) in PIXEL or "telegram-cdn.org/file/" in low or ("/file/" in low and "cdn" in low) else None


def _candidates(root: dom.Node) -> list[tuple[dom.Node, str, str | None]]:
    """(node, kind, uri) of images, then background hosts, then videos; a video without src gives way to its first source in the tree."""
    out = [(n, "image", n.attrs.get("src") or None) for n in root.all("img") if _suffix(n.attrs.get("src") or "") not in VECTOR]
    for n in root.walk():
        if n.tag and n.tag not in ("img", "video", "source") and (url := _background(n.attrs.get("style"))):
            out.append((n, "image", n.attrs.get("src") or url))
    for n in root.all("video"):
        if "src" in n.attrs:
            out.append((n, "video", n.attrs["src"] or None))
        elif sources := n.all("source"):
            n.put(sources[0])
            out.append((sources[0], "video", sources[0].attrs.get("src") or None))
    return out


def _browser_candidates(root: dom.Node, base: str) -> list[tuple[dom.Node, str, str | None]]:
    """As a browser would load them: src or the first of srcset, background hosts, posters, videos and all their sources; clear videos before blurred twins."""
    out: list[tuple[dom.Node, str, str | None]] = []
    for n in root.all("img"):
        url = n.attrs.get("src") or ((n.attrs.get("srcset") or "").split(",")[0].split() or [None])[0]
        out += [(n, "image", url)] * bool(url)
    for n in root.walk():
        if n.tag and n.tag not in ("img", "video", "source") and (url := _background(n.attrs.get("style"))):
            out.append((n, "image", url))
    videos = root.all("video")
    out += [(n, "image", n.attrs["poster"]) for n in videos if n.attrs.get("poster")]
    of = lambda c: [n for n in videos if {"tgme_widget_message_video", c} <= set(n.classes) and n.attrs.get("src")]
    clear, blurred = of("js-message_video"), of("js-message_video_blured")
    if clear and blurred:
        blurred[0].put()
    videos = root.all("video")
    out += [(n, "video", n.attrs["src"]) for n in videos if n.attrs.get("src")]
    out += [(s, "video", s.attrs["src"]) for n in videos for s in n.all("source") if s.attrs.get("src")]
    return [(n, k, urljoin(base, u)) for n, k, u in out]


def media_elements(pages: DataFrame, mode: str = "page", most: int | None = None, keep_url: bool = False) -> DataFrame:
    """One row per media candidate of each page (page_id, url, html): ordinal, tag, kind, raw_uri, has_child_tags.

    Mode 'page' groups images, background hosts and videos; 'browser' gives absolute URIs of all
    that a browser would load. ``most`` keeps the first so many of a page. Rows carry no HTML, and
    the page's url only with ``keep_url``.
    """
    keys = ["page_id", "url"] if keep_url else ["page_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (part for batch in batches for part in in_slices(*batch.columns)):
            at, rows = [], []
            for nth, (url, html) in enumerate(zip(part[1].to_pylist(), part[2].to_pylist(), strict=True)):
                root = dom.parse(html)
                found = _browser_candidates(root, url or "") if mode == "browser" else _candidates(root)
                rows += [(i, n.tag, kind, uri, any(k.tag for k in n.kids)) for i, (n, kind, uri) in enumerate(found[:most])]
                at += [nth] * (len(rows) - len(at))
            own = [column.take(pa.array(at, pa.int64())) for column in part[: len(keys)]]
            yield pa.RecordBatch.from_arrays([*own, *(pa.array([r[k] for r in rows], f.type) for k, f in enumerate(ELEMENT))], [*keys, *(f.name for f in ELEMENT)])

    typed = ", ".join(f"`{k}` {pages.schema[k].dataType.simpleString()}" for k in keys)
    return pages.select("page_id", "url", "html").mapInArrow(run, f"{typed}, {ELEMENTS}")


def inline_candidates(pages: DataFrame) -> DataFrame:
    """``media_elements`` as a browser sees them."""
    return media_elements(pages, mode="browser")


def _texts(make: Callable[[str], str]) -> Callable[[Column], Column]:
    """What is made of each text; null stays null."""

    def run(html: pa.Array) -> pa.Array:
        return pa.array([None if p is None else make(p) for p in html.to_pylist()], pa.string())

    return by_slices(run, T.StringType())


def drop_tags(html: Column, tags: tuple[str, ...] = DROPPED) -> Column:
    """HTML without the subtrees of the tags."""

    return _texts(lambda p: dom.serialize(dom.drop(dom.parse(p), tags)))(html)


def _selected(pages: pa.Array, selectors: pa.Array) -> pa.Array:
    """First match of ``tag#id`` or ``tag.class`` alternatives; an id gives its inner HTML, a class the element."""

    def one(page: str | None, selector: str | None) -> str | None:
        if page is None or not selector:
            return page
        wanted = [re.match(r"(\w+)([#.])([\w-]+)", s.strip()).groups() for s in selector.split(",")]
        for n in dom.parse(page).walk():
            for tag, sort, name in wanted:
                if n.tag == tag and (n.attrs.get("id") == name if sort == "#" else name in n.classes):
                    return dom.serialize(n, inner=sort == "#")
        return page

    return pa.array([one(p, s) for p, s in zip(pages.to_pylist(), selectors.to_pylist(), strict=True)], pa.string())


_select = by_slices(_selected, T.StringType())


def select_content_root(pages: DataFrame, policy: DataFrame) -> DataFrame:
    """Narrow html to the part that the policy's selector names for the URL's domain; pages of other domains pass untouched and unparsed."""
    own = policy.where("content_selector is not null").select(F.col("domain").alias("__domain"), "content_selector")
    joined = pages.join(F.broadcast(own), url_domain(F.col("url")) == F.col("__domain"), "left")
    narrowed = _select(F.when(F.col("content_selector").isNotNull(), F.col("html")), F.col("content_selector"))
    return joined.withColumn("html", F.when(F.col("content_selector").isNotNull(), narrowed).otherwise(F.col("html"))).drop("__domain", "content_selector")


def _plain(style: str | None) -> str | None:
    left = re.sub(r";\s*;", ";", _BACKGROUND.sub("", style or "")).strip(" ;")
    return left or None


def rewritten(html: str, media: dict[int, str]) -> dom.Node | None:
    """The page's tree with candidates replaced by references (ordinal -> token); None if it has no candidates."""
    root = dom.parse(html)
    found = [n for n, _, _ in _candidates(root)]
    if not found:
        return None
    place(found, media)
    return root


def place(found: list[dom.Node], media: dict[int, str]) -> None:
    """Put the tokens (ordinal -> token) in the place of the nodes found in a tree. Wrappers stay behind their token, without the background; other nodes go."""
    for i, n in enumerate(found):
        if n.parent is None:
            continue
        wrapper = any(k.tag for k in n.kids)
        token = [dom.Node(None, text=media[i])] if i in media else []
        if wrapper:
            style = _plain(n.attrs.get("style"))
            if style is None:
                n.attrs.pop("style", None)
            else:
                n.attrs["style"] = style
            if token:
                n.put(*token, n)
        else:
            n.put(*token)


def _rewritten(html: pa.Array, media: pa.Array) -> pa.Array:
    def one(page: str | None, found: list[dict] | None) -> str | None:
        root = rewritten(page, {m["ordinal"]: m["token"] for m in found or []}) if page is not None else None
        return page if root is None else dom.serialize(root)

    return pa.array([one(p, m) for p, m in zip(html.to_pylist(), media.to_pylist(), strict=True)], pa.string())


_rewrite = by_slices(_rewritten, T.StringType())


def _documents_of(nodes: pa.Array, found: pa.Array, media: pa.Array) -> pa.Array:
    """Markdown of parsed pages with the tokens (ordinal, token) in the places of what was found."""
    out = []
    for page, places, tokens in zip(page_nodes(nodes), found, media, strict=True):
        if page is None:
            out.append(None)
            continue
        at = tree(*page)
        seen = [at[f["node"].as_py()] if f["node"].as_py() >= 0 else dom.Node("") for f in places]
        place(seen, {t["ordinal"].as_py(): t["token"].as_py() for t in tokens} if tokens.is_valid else {})
        out.append(dom.markdown(at[0]))
    return pa.array(out, pa.string())


_documents = by_slices(_documents_of, T.StringType())
_markdown = _texts(lambda p: dom.markdown(dom.parse(p)))


def html_to_markdown(html: Column) -> Column:
    """Tidy Markdown of HTML."""
    return tidy_markdown(_markdown(html))


def reference(kind: Column, media_id: Column) -> Column:
    return F.concat(F.lit("<"), kind, F.lit(":"), F.substring(media_id, 1, 32), F.lit(">"))


def _tokens(attached: DataFrame, *keys: str) -> DataFrame:
    token = F.struct("ordinal", reference(F.col("media_kind"), F.col("media_id")).alias("token"))
    return attached.where("media_id is not null").groupBy(*keys).agg(F.array_sort(F.collect_list(token)).alias("media"))


def rewrite_media(pages: DataFrame, attached: DataFrame) -> DataFrame:
    """Replace or remove each page's media candidates; ``attached`` has page_id, ordinal, media_kind, media_id, and the page's url where page_id alone doesn't tell pages apart."""
    keys = ["page_id", "url"] if "url" in attached.columns else ["page_id"]
    return pages.join(_tokens(attached, *keys), keys, "left").withColumn("html", _rewrite("html", "media")).drop("media")


@F.pandas_udf(T.StructType().add("width", "integer").add("height", "integer"))
def _size(content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([header(b)[1:] for b in content], columns=["width", "height"]).astype("Int32")


ITEMS = "array<struct<ordinal:int,token:string>>"


def to_documents(captures: DataFrame, blobs: DataFrame | None = None, include_media: bool = True, format: str = "multimodal_sequence", policy: DataFrame | None = None) -> DataFrame:
    """Documents (page_id, url, text, items) of captures (page_id, url, html).

    Format 'multimodal_sequence' gives Markdown with media references, 'html' the raw HTML without
    items. With a policy, Markdown is made of the part of the page that its selector names.

    With media, each page is parsed once, into a written table of nodes (``operators.nodes``) in
    which every row has a number of its own: pages may share page_id and url. The elements found
    are a few short columns of it; their URIs are resolved and joined with the blobs' metadata (as
    of ``media_catalogue``), data URIs decoded in place. What passes the size test goes back to its
    page as a short array, and one pass over the nodes makes Markdown. Without media it is one
    map-only pass.
    """
    if format == "html":
        return captures.select("page_id", "url", F.col("html").alias("text"), F.array().cast(ITEMS).alias("items"))
    if format != "multimodal_sequence":
        raise ValueError(f"unknown format {format!r}")
    pages = (captures if policy is None else select_content_root(captures, policy)).select("page_id", "url", "html")
    if not include_media:
        return pages.select("page_id", "url", html_to_markdown(F.col("html")).alias("text"), F.array().cast(ITEMS).alias("items"))
    pages = parsed(pages.withColumn("html", inline_text_data_uris(F.col("html"))), _candidates).withColumn("row", F.monotonically_increasing_id())
    pages = written(pages, "parsed")
    elements = pages.select("row", "url", F.explode("found").alias("f")).select("row", "url", "f.ordinal", "f.kind", "f.raw_uri")
    elements = elements.withColumn("inline", decode_data_uri_media(F.col("raw_uri")))
    size = _size("inline.content")
    own = elements.where("inline is not null").select("row", "ordinal", F.col("inline.kind").alias("media_kind"), F.sha2("inline.content", 256).alias("media_id"), size.alias("s"))
    parts = own.where("media_kind = 'video' or (s.width >= 256 and s.height >= 256)").select("row", "ordinal", "media_kind", "media_id")
    if blobs is not None:
        fetched = elements.where("inline is null").select("row", "ordinal", "kind", resolve_media_url(F.col("raw_uri"), F.col("url")).alias("uri"), F.lit("download").alias("origin")).where("uri is not null")
        parts = parts.unionByName(attach_media(fetched, blobs, page=("row",)).where("media_id is not null").select("row", "ordinal", "media_kind", "media_id"))
    joined = pages.join(_tokens(parts, "row"), "row", "left")
    return joined.select("page_id", "url", tidy_markdown(_documents("nodes", "found", "media")).alias("text"), F.coalesce("media", F.array().cast(ITEMS)).alias("items"))


def captured_documents(captures: DataFrame, blobs: DataFrame | None = None, **options: object) -> DataFrame:
    """``to_documents`` of successful rows of the captures table, the last capture of each URL: url, text, items.

    A capture succeeds with HTML and a status below 400, or none. Of several at one time, that of
    the last method and then of the largest HTML counts. HTML moves once, after each task has kept
    the last of its own captures of a URL.
    """
    good = captures.where("html is not null and coalesce(status, 200) < 400 and url is not null")
    pages = good.groupBy("url").agg(F.max(F.struct("fetched_at", "method", "html")).alias("last")).select("url", "last.html", F.col("url").alias("page_id"))
    return to_documents(pages, blobs, **options).select("url", "text", "items")


FEATURES = {"size": "integer", "text_length": "integer", "has_media": "boolean", "has_wayback": "boolean", "has_ghost": "boolean", "has_nested": "boolean", "body_children": "integer", "photo_wraps": "integer", "videos": "integer", "images": "integer"}


def _struct(fields: dict[str, str]) -> T.StructType:
    out = T.StructType()
    for name, kind in fields.items():
        out = out.add(name, kind)
    return out


def _features_of(html: pa.Array) -> pa.Array:
    rows = []
    for page in html.to_pylist():
        root = dom.parse(page)
        nodes = root.walk()
        srcs = [n.attrs.get("src") or "" for n in nodes if n.tag in ("img", "video", "source")]
        hrefs = [n.attrs.get("href") or "" for n in nodes if n.tag == "a"]
        src = [n for n in nodes if n.tag in ("img", "video", "source") and n.attrs.get("src")]
        body = next((n for n in nodes if n.tag == "body"), root)
        wraps = sum("tgme_widget_message_photo_wrap" in n.classes for n in nodes)
        shown = sum("tgme_widget_message_photo_wrap" in n.classes and "background-image" in (n.attrs.get("style") or "") for n in nodes)
        content = any(n.tag in ("article", "main") or n.attrs.get("role") == "main" for n in nodes)
        media = bool(src) or wraps > 0 or any("background-image" in (n.attrs.get("style") or "") or "tgme_widget_message_video" in n.classes for n in nodes)
        rows.append((len(page or ""), len(dom.text_of(root)), media, any("/web/" in u for u in srcs + hrefs) or bool(src) or content, any("_/http" in u for u in srcs + hrefs), any(n.tag == "iframe" for n in nodes), sum(k.tag is not None for k in body.kids), shown, sum(n.tag == "video" and "src" in n.attrs for n in nodes), sum(n.tag == "img" and "src" in n.attrs for n in nodes)))
    kinds = {"integer": pa.int32(), "boolean": pa.bool_()}
    return pa.StructArray.from_arrays([pa.array([r[k] for r in rows], kinds[kind]) for k, kind in enumerate(FEATURES.values())], list(FEATURES))


_features = by_slices(_features_of, _struct(FEATURES))


def page_readiness(pages: DataFrame) -> DataFrame:
    """Add features of html and the tests on them: ready_perma, ready_wayback, archived. Of photo wraps those with a background image count, of videos and images those with a src."""
    f = pages.withColumn("f", _features("html"))
    return f.select(
        *pages.columns, "f.*",
        (F.col("f.size") > 1000).alias("__big"),
    ).withColumn("ready_perma", F.col("__big") | (F.col("text_length") > 40) | F.col("has_media") | F.col("has_nested")).withColumn(
        "ready_wayback", F.col("has_wayback") | (F.col("text_length") > 40) | (F.col("body_children") > 3)
    ).withColumn("archived", F.col("has_ghost")).drop("__big")


def tiktok_video_candidates(html: Column) -> Column:
    """Distinct video URLs of a page's hydration data, play address first, then download, then bit rates; no HLS."""
    script = F.regexp_extract(html, r'(?s)<script[^>]*id="__UNIVERSAL_DATA_FOR_REHYDRATION__"[^>]*>(.*?)</script>', 1)
    schema = "struct<`__DEFAULT_SCOPE__`: struct<`webapp.video-detail`: struct<itemInfo: struct<itemStruct: struct<video: struct<playAddr: string, downloadAddr: string, bitrateInfo: array<struct<PlayAddr: struct<UrlList: array<string>>>>>>>>>>"
    video = F.from_json(F.nullif(script, F.lit("")), schema)["__DEFAULT_SCOPE__"]["webapp.video-detail"]["itemInfo"]["itemStruct"]["video"]
    return let(video, _video_urls)


def _video_urls(video: Column) -> Column:
    none = F.array().cast("array<string>")
    rates = F.coalesce(F.flatten(F.transform(video["bitrateInfo"], lambda b: F.coalesce(b["PlayAddr"]["UrlList"], none))), none)
    urls = F.concat(F.array(video["playAddr"], video["downloadAddr"]), rates)
    return F.array_distinct(F.filter(urls, lambda u: u.isNotNull() & (u != "") & ~is_streaming(u, F.lit(None).cast("string"))))


def post_process(pages: DataFrame, rules: dict[str, Callable[[str], str]]) -> DataFrame:
    """Pages (url, html) with the html of domains that have a rule as their rule returns it.

    Rules are functions of the HTML, registered by the URL's domain (``functions.urls.url_domain``). Other
    domains' pages aren't sent to Python; null html stays null, and a rule that returns None
    leaves its page as it was.
    """

    def run(domains: pa.Array, html: pa.Array) -> pa.Array:
        return pa.array([None if h is None else rules[d](h) for d, h in zip(domains.to_pylist(), html.to_pylist(), strict=True)], pa.string())

    domain = F.col("__domain")
    ruled = domain.isin(*rules) if rules else F.lit(False)
    changed = by_slices(run, "string")(F.when(ruled, domain), F.when(ruled, F.col("html")))
    return pages.withColumn("__domain", url_domain(F.col("url"))).withColumn("html", F.when(ruled, F.coalesce(changed, F.col("html"))).otherwise(F.col("html"))).drop("__domain")
