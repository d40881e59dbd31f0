"""URL columns: cleaning, parts, classes, and platform links. Built-in expressions; one helper for malformed escapes."""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Patterns and suffixes that decide which URLs match.
DOMAIN = r"(?:https?:\/\/)?(?:www\.)?([-a-zA-Z0-9@:%._\+~#=]{1,256}\.[a-zA-Z0-9()]{1,6})/?"
URL = r"^https?:\/\/(?:www\.)?[-a-zA-Z0-9@:%._\+~#=]{1,256}\.[a-zA-Z0-9()]{1,6}\b(?:[-a-zA-Z0-9@:%_\+.~#?&//=]*)"
PATH = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/]*)?(.*)$"
ROOT = r"^(:?https?://)?([^/]+)"
DATA_URI = r"^data:([\w/+.-]+/[\w.+-]+);base64,([A-Za-z0-9+/=]+)"
BACKGROUND = r"""(?i)background-image\s*:\s*url\(\s*['"]?([^'")\s]+)['"]?\s*\)"""
META_REFRESH = r"""(?i)URL=(https?://[^"'>\s]+)"""
X_POST = r"^/[^/]+/status/(\d+)(?:/(?:photo|video)/(\d+))?/?$"
FACEBOOK_VIDEO = r"facebook\.com/\d+/videos/\d+/?"
PIXEL = ("jpg", "jpeg", "png", "gif", "webp", "bmp")
VECTOR = ("svg", "svgz", "eps")
VIDEO = ("mp4", "webm", "mov", "m4v", "mkv", "avi", "flv", "wmv", "ts")
HLS = ("m3u8",)


@F.pandas_udf(T.StringType())
def _lenient_decode(url: pd.Series) -> pd.Series:
    return url.map(lambda u: None if u is None else unquote(u))


def clean_url(url: Column) -> Column:
    """Percent-decode, keeping ``+`` and malformed escapes, then strip white space of any kind. Only malformed URLs go through Python."""
    fast = F.try_url_decode(F.replace(url, F.lit("+"), F.lit("%2B")))
    odd = url.isNotNull() & (fast.isNull() | fast.contains("�"))
    decoded = F.when(odd, _lenient_decode(F.when(odd, url))).otherwise(fast)
    return F.regexp_replace(decoded, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def url_domain(url: Column, keep_subdomain: bool = False) -> Column:
    """The first thing that looks like a host, without ``www.``; its last two labels unless ``keep_subdomain``; null if there is none. Case stays; ``bbc.co.uk`` gives ``co.uk``."""
    host = F.nullif(F.regexp_extract(url, DOMAIN, 1), F.lit(""))
    return host if keep_subdomain else F.substring_index(host, ".", -2)


def url_root(url: Column) -> Column:
    """Scheme and host, as far as the first single slash; empty if there is none."""
    return F.regexp_extract(url, ROOT, 0)


def url_kind_flags(url: Column) -> Column:
    """Struct of is_url, is_root_relative, is_data_uri."""
    return F.struct(url.rlike(URL).alias("is_url"), url.startswith("/").alias("is_root_relative"), url.rlike(DATA_URI).alias("is_data_uri"))


def url_path(url: Column) -> Column:
    """Path without query, fragment and ``;params``."""
    bare = F.regexp_replace(url, r"[?#].*$", "")
    path = F.regexp_extract(bare, PATH, 1)
    return F.regexp_replace(path, r";[^/]*$", "")


def _ends(path: Column, suffixes: tuple[str, ...]) -> Column:
    return path.rlike(r"\.(?:" + "|".join(suffixes) + r")$")


def url_media_class(url: Column) -> Column:
    """image, vector, video, hls or none, by the suffix of the path."""
    path = F.lower(url_path(url))
    return F.when(_ends(path, PIXEL), "image").when(_ends(path, VECTOR), "vector").when(_ends(path, VIDEO), "video").when(_ends(path, HLS), "hls").otherwise("none")


def resolve_media_url(uri: Column, page_url: Column) -> Column:
    """Root-relative URIs get the page's root before them, ``//host`` ones too; what is no http URL then is null."""
    full = F.when(uri.startswith("/"), F.concat(url_root(page_url), uri)).otherwise(uri)
    return F.when(full.rlike(URL), full)


def background_image_url(style: Column) -> Column:
    """URL of an inline style's first background image, if it is a content image; null else."""
    raw = F.nullif(F.regexp_extract(style, BACKGROUND, 1), F.lit(""))
    url = F.when(raw.startswith("//"), F.concat(F.lit("https:"), raw)).otherwise(raw)
    low = F.lower(url)
    path = F.lower(url_path(url))
    reject = low.startswith("data:") | low.contains("/emoji/") | low.contains("/emojis/") | _ends(path, VECTOR)
    accept = _ends(path, PIXEL) | low.contains("telegram-cdn.org/file/") | (low.contains("/file/") & low.contains("cdn"))
    return F.when(~reject & accept, url)


def redirected() -> Column:
    """Where a row of redirects (short_url, final_url, body) leads, if elsewhere; else the target of a refresh in its body."""
    moved = F.rtrim(F.col("final_url"), F.lit("/")) != F.rtrim(F.col("short_url"), F.lit("/"))
    return F.coalesce(F.when(moved, F.col("final_url")), F.nullif(F.regexp_extract("body", META_REFRESH, 1), F.lit("")))


def expand_short_urls(urls, redirects):
    """``urls`` (short_url) with long_url, where its redirect leads (``redirected``); null if nowhere. Of several redirects of one URL the least that leads anywhere counts."""
    found = redirects.groupBy("short_url").agg(F.min(redirected()).alias("long_url"))
    return urls.join(found, "short_url", "left").select(urls["*"], found["long_url"])


# --- platform links -------------------------------------------------------------------------


def query_value(url: Column, name: str) -> Column:
    """Decoded value of a query parameter; null if it isn't there."""
    raw = F.nullif(F.regexp_extract(url, rf"[?&]{name}=([^&#]*)", 1), F.lit(""))
    return F.coalesce(F.try_url_decode(raw), raw)


def _parts(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda p: p != "")


def _first(parts: Column) -> Column:
    return F.try_element_at(parts, F.lit(1))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


# Beginnings of addresses that carry another one.
PUBLISH = "https://publish.twitter.com/?query="
LOGIN, EMBED = "https://www.facebook.com/login/?next=", "https://www.facebook.com/plugins/post.php?href="
SHORTENER = "t.co"


def _unwrapped_x(url: Column) -> Column:
    return F.when(url.startswith(PUBLISH), query_value(url, "query"))


def _unwrapped_facebook(url: Column) -> Column:
    return F.when(url.startswith(LOGIN), query_value(url, "next")).when(url.startswith(EMBED), query_value(url, "href"))


def unwrapped(url: Column) -> Column:
    """The address that a publishing, login or embedding address carries; null if it is none of these."""
    return F.coalesce(_unwrapped_x(url), _unwrapped_facebook(url))


def is_short(url: Column) -> Column:
    """Whether an address is one of the shortener's, which only a redirect tells."""
    return F.regexp_extract(url, r"^https?://([^/?#]+)", 1) == SHORTENER


def _link(platform: str, kind: Column, ident: Column | None = None, username: Column | None = None, number: Column | None = None, url: Column | None = None) -> Column:
    ident, username, url = (F.lit(None).cast("string") if x is None else x for x in (ident, username, url))
    number = F.lit(None).cast("int") if number is None else number
    return F.struct(F.lit(platform).alias("platform"), kind.alias("kind"), ident.alias("id"), username.alias("username"), number.alias("media_number"), url.alias("normalized_url"))


def _x(url: Column) -> Column:
    return let(F.coalesce(_unwrapped_x(url), url), lambda u: let(url_path(u), lambda path: _x_parts(u, path)))


def _x_parts(url: Column, path: Column) -> Column:
    post = path.rlike(X_POST)
    first = _first(_parts(path))
    name = F.when(F.length(first) >= 3, first)
    kind = F.when(is_short(url), "short").when(post, "post").when(path.startswith("/search"), "unsupported").when(name.isNotNull(), "profile").otherwise("unsupported")
    number = F.nullif(F.regexp_extract(path, X_POST, 2), F.lit("")).try_cast("int")
    return _link("x", kind, F.when(post, F.regexp_extract(path, X_POST, 1)), F.when(kind == "profile", name), F.when(post, number), url)


def _tiktok(url: Column) -> Column:
    return let(_parts(url_path(url)), lambda parts: _tiktok_parts(url, parts))


def _tiktok_parts(url: Column, parts: Column) -> Column:
    moving = url.contains("vm.tiktok.com")
    video = url.contains("/video/") | moving | url.rlike(r"/\d{10,}")
    digits = F.try_element_at(F.filter(parts, lambda p: p.rlike(r"^\d{10,}$")), F.lit(-1))
    ident = F.when(moving, _first(parts)).otherwise(F.coalesce(F.nullif(F.regexp_extract(url, r"/video/(\d+)", 1), F.lit("")), digits))
    named = F.nullif(F.regexp_extract(url, r"/@([^/?]+)", 1), F.lit(""))
    other = _first(F.filter(F.transform(F.filter(parts, lambda p: ~p.startswith("video") & ~p.rlike(r"^\d+$")), lambda p: F.ltrim(p, F.lit("@"))), lambda p: p != ""))
    return _link("tiktok", F.when(video, "video").otherwise("profile"), F.when(video, ident), F.coalesce(named, other), url=url)


def _facebook(url: Column) -> Column:
    return let(F.coalesce(_unwrapped_facebook(url), url), _facebook_parts)


def _facebook_parts(url: Column) -> Column:
    parts = _parts(url_path(url))
    video = url.contains("facebook.com/watch") | url.contains("facebook.com/reel") | url.rlike(FACEBOOK_VIDEO) | url.contains("fb.watch") | url.contains("/videos/")
    kind = F.when(video, "video").when(url.contains("facebook.com/photo"), "photo").when(url.rlike(r"facebook\.com/.+/posts/.+"), "post").when(_first(parts) == "profile.php", "profile").otherwise("other")
    return _link("facebook", kind, query_value(url, "v"), url=url)


def _instagram(url: Column) -> Column:
    kind = F.when(url.contains("instagram.com/reels") | url.contains("instagram.com/reel/"), "video").when(url.contains("instagram.com/p/"), "photo_or_reel").otherwise("profile")
    return _link("instagram", kind, username=F.when(kind == "profile", _first(_parts(url_path(url)))), url=url)


def _telegram(url: Column) -> Column:
    return let(_parts(url_path(url)), lambda parts: _telegram_parts(url, parts))


def _telegram_parts(url: Column, parts: Column) -> Column:
    ident = F.try_element_at(parts, F.lit(2))
    good = F.coalesce(ident.rlike(r"^\d+$"), F.lit(False))
    return _link("telegram", F.when(good, "post").otherwise("invalid"), F.when(good, ident), F.when(good, _first(parts)), url=url)


def _bluesky(url: Column) -> Column:
    parts = F.split(F.regexp_replace(url, r"[?#].*$", ""), "/")
    post = url.contains("post")
    at = F.array_position(parts, "profile").cast("int")
    named = lambda k: F.when(at > 0, F.try_element_at(parts, at + k))
    return _link("bluesky", F.when(post, "post").otherwise("profile"), F.when(post, named(3)), F.when(post, named(1)).otherwise(F.try_element_at(parts, F.lit(-1))), url=url)


def classify_link(url: Column) -> Column:
    """Struct of platform, kind, id, username, media_number and normalized_url of a cleaned URL; null for other sites."""
    return let(url_domain(url), lambda domain: _by_domain(url, domain))


def _by_domain(url: Column, domain: Column) -> Column:
    return (
        F.when(domain.isin("x.com", "twitter.com", "t.co"), _x(url))
        .when(domain == "tiktok.com", _tiktok(url))
        .when(domain.isin("facebook.com", "fb.watch"), _facebook(url))
        .when(domain == "instagram.com", _instagram(url))
        .when(domain.isin("t.me", "telegram.me"), _telegram(url))
        .when(domain == "bsky.app", _bluesky(url))
    )
