"""Columns that decide on media: kinds, sizes, variants, codecs."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeweave.functions.text import strict_base64
from lakeweave.functions.urls import DATA_URI, url_media_class

MB = 1024 * 1024
SIDE, SMALL = 2048, 256


def decode_data_uri_media(uri: Column) -> Column:
    """Struct of kind and content of an image or video data URI; null for SVG, other types and bad base64."""
    mime = F.regexp_extract(uri, DATA_URI, 1)
    kind = F.when(mime.contains("svg"), None).when(mime.startswith("image/"), "image").when(mime.startswith("video/"), "video")
    content = strict_base64(F.nullif(F.regexp_extract(uri, DATA_URI, 2), F.lit("")))
    return F.when(kind.isNotNull() & content.isNotNull(), F.struct(kind.alias("kind"), content.alias("content")))


def fitted(width: Column, height: Column) -> Column:
    """Struct of width and height after fitting into the largest side, aspect kept."""
    scale = F.least(F.lit(SIDE) / width, F.lit(SIDE) / height)
    over = (width > SIDE) | (height > SIDE)
    fit = lambda x: F.when(over, F.greatest(F.lit(1), F.floor(x * scale + 1e-9))).otherwise(x).cast("int")
    return F.struct(fit(width).alias("width"), fit(height).alias("height"))


def image_keep(width: Column, height: Column, origin: Column, ignore_small: bool = True) -> Column:
    """Whether an image is large enough: downloaded ones fitted and over 256 both ways, those of data URIs 256 or more."""
    fit = fitted(width, height)
    downloaded = (fit["width"] > SMALL) & (fit["height"] > SMALL) if ignore_small else F.lit(True)
    return F.when(origin == "data_uri", (width >= SMALL) & (height >= SMALL)).otherwise(downloaded)


def classify_medium(content_type: Column, url: Column) -> Column:
    """image, video or null; image comes first, and octet streams go by the URL's suffix."""
    by_url = url_media_class(url)
    octets = content_type == "binary/octet-stream"
    image = (content_type.startswith("image/") & ~content_type.contains("svg") & ~content_type.contains("eps")) | (octets & (by_url == "image"))
    video = content_type.startswith("video/") | (content_type == "application/vnd.apple.mpegurl") | (octets & by_url.isin("video", "hls"))
    return F.when(image, "image").when(video, "video")


def video_fetch_mode(content_type: Column, url: Column) -> Column:
    """file, hls or unsupported."""
    kind = F.coalesce(F.lower(F.trim(F.substring_index(content_type, ";", 1))), F.lit(""))
    by_url = url_media_class(url)
    return F.when(kind.startswith("video/") | (by_url == "video"), "file").when(kind.contains("mpegurl") | (by_url == "hls"), "hls").otherwise("unsupported")


def over_cap(size: Column, cap: Column) -> Column:
    """Whether a video is over the cap; a null cap or one of 0 means no limit."""
    return F.coalesce((cap > 0) & (size > cap), F.lit(False))


def is_streaming(url: Column, content_type: Column) -> Column:
    """Whether an address, or the type of what it gives, is a playlist's. Without an address nothing is."""
    return F.coalesce(url != "", F.lit(False)) & (F.lower(url).contains("m3u8") | F.coalesce(F.lower(content_type).contains("mpegurl"), F.lit(False)))


def inline_size_gate(kind: Column, url: Column, content_type: Column, content_length: Column, blob_size: Column) -> Column:
    """Why a medium isn't inlined: too_large_precheck (announced), streaming (see ``is_streaming``), too_large (fetched); null if it is."""
    cap = F.when(kind == "image", 50 * MB).otherwise(250 * MB)
    return F.when(content_length > cap, "too_large_precheck").when(is_streaming(url, content_type), "streaming").when(blob_size > cap, "too_large")


def best_video_variant(variants: Column) -> Column:
    """URL of the ``video/*`` variant with the highest bit_rate; of equal ones the first; null if there is none."""
    rated = F.transform(variants, lambda v, i: F.struct(v["content_type"].alias("t"), v["bit_rate"].alias("r"), (-i).alias("i"), v["url"].alias("url")))
    able = F.filter(rated, lambda v: v["t"].startswith("video/") & (v["r"] >= 0))
    return F.array_max(F.transform(able, lambda v: F.struct(v["r"].alias("r"), v["i"].alias("i"), v["url"].alias("url"))))["url"]


def browser_safe(streams: Column) -> Column:
    """Whether the last video stream is plain h264 and the last audio stream aac or mp3; false without either."""
    last = lambda kind: F.try_element_at(F.filter(streams, lambda s: s["codec_type"] == kind), F.lit(-1))
    video, audio = last("video"), last("audio")
    plain = (video["codec_name"] == "h264") & (video["pix_fmt"] == "yuv420p") & ~F.coalesce(video["profile"], F.lit("")).contains("High 10")
    return F.coalesce(plain & audio["codec_name"].isin("aac", "mp3"), F.lit(False))


def _jpeg(b: bytes) -> tuple[int, int] | None:
    at = 2
    while at + 9 < len(b):
        if b[at] != 0xFF:
            return None
        mark = b[at + 1]
        if mark == 0xFF:
            at += 1
        elif 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            h, w = struct.unpack(">HH", b[at + 5 : at + 9])
            return w, h
        else:
            at += 2 if mark == 1 or 0xD0 <= mark <= 0xD8 else 2 + int.from_bytes(b[at + 2 : at + 4], "big")
    return None


def _webp(b: bytes) -> tuple[int, int] | None:
    form = b[12:16]
    if form == b"VP8X" and len(b) >= 30:
        return 1 + int.from_bytes(b[24:27], "little"), 1 + int.from_bytes(b[27:30], "little")
    if form == b"VP8L" and len(b) >= 25:
        bits = int.from_bytes(b[21:25], "little")
        return 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
    if form == b"VP8 " and len(b) >= 30:
        w, h = struct.unpack("<HH", b[26:30])
        return w & 0x3FFF, h & 0x3FFF
    return None


def _bmp(b: bytes) -> tuple[int, int] | None:
    if int.from_bytes(b[14:18], "little") == 12:  # the first kind of header has short numbers
        return struct.unpack("<HH", b[18:22])
    w, h = struct.unpack("<ii", b[18:26])
    return w, abs(h)


def _ico(b: bytes) -> tuple[int, int] | None:
    """The largest of the pictures listed; a side of 0 means 256."""
    listed = [(b[at] or 256, b[at + 1] or 256) for at in range(6, min(len(b), 6 + 16 * int.from_bytes(b[4:6], "little")) - 15, 16)]
    return max(listed, key=lambda s: s[0] * s[1], default=None)


def _tiff(b: bytes) -> tuple[int, int] | None:
    """Width and height in the first directory, which may lie anywhere."""
    order = "little" if b[:2] == b"II" else "big"
    num = lambda at, n: int.from_bytes(b[at : at + n], order)
    at, sides = num(4, 4), {}
    for entry in range(at + 2, min(len(b) - 11, at + 2 + 12 * num(at, 2)), 12):
        if num(entry, 2) in (256, 257):
            sides[num(entry, 2)] = num(entry + 8, 2 if num(entry + 2, 2) == 3 else 4)
    return (sides[256], sides[257]) if len(sides) == 2 else None


def _boxes(b: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """Kind, begin and end of what is in each box of a stretch."""
    while at + 8 <= end:
        size, head = int.from_bytes(b[at : at + 4], "big"), 8
        if size == 1:
            size, head = int.from_bytes(b[at + 8 : at + 16], "big"), 16
        size = size or end - at
        if size < head or at + size > end:
            return
        yield b[at + 4 : at + 8], at + head, at + size
        at += size


def _avif(b: bytes) -> tuple[int, int] | None:
    """Extent of the primary item, or the largest extent where none is named."""
    meta = next(((x, y) for kind, x, y in _boxes(b, 0, len(b)) if kind == b"meta"), None)
    if meta is None:
        return None
    inside = {kind: (x, y) for kind, x, y in _boxes(b, meta[0] + 4, meta[1])}
    listed = {kind: (x, y) for kind, x, y in _boxes(b, *inside.get(b"iprp", (0, 0)))}
    props = [struct.unpack(">II", b[x + 4 : x + 12]) if kind == b"ispe" and y - x >= 12 else None for kind, x, y in _boxes(b, *listed.get(b"ipco", (0, 0)))]
    sizes = [p for p in props if p]
    if b"pitm" in inside and b"ipma" in listed:
        own = _properties_of(b, int.from_bytes(b[inside[b"pitm"][0] + 4 : inside[b"pitm"][1]], "big"), *listed[b"ipma"])
        sizes = [props[i - 1] for i in own if 0 < i <= len(props) and props[i - 1]] or sizes
    return max(sizes, key=lambda s: s[0] * s[1], default=None)


def _properties_of(b: bytes, item: int, at: int, end: int) -> list[int]:
    """Numbers of the properties that an association box gives to an item."""
    wide_id, wide = 4 if b[at] else 2, 2 if b[at + 3] & 1 else 1
    at += 8
    while at + wide_id < end:
        own, n = int.from_bytes(b[at : at + wide_id], "big"), b[at + wide_id]
        first = at + wide_id + 1
        at = first + wide * n
        if own == item:
            return [int.from_bytes(b[k : k + wide], "big") & (0x7FFF if wide == 2 else 0x7F) for k in range(first, min(at, end), wide)]
    return []


def header(b: bytes | None) -> tuple[str, int, int] | tuple[None, None, None]:
    """Format, width and height that the first bytes of an image state."""
    size, form = None, None
    if b and b[:8] == b"\x89PNG\r\n\x1a\n" and len(b) >= 24:
        form, size = "png", struct.unpack(">II", b[16:24])
    elif b and b[:6] in (b"GIF87a", b"GIF89a") and len(b) >= 10:
        form, size = "gif", struct.unpack("<HH", b[6:10])
    elif b and b[:2] == b"\xff\xd8":
        form, size = "jpeg", _jpeg(b)
    elif b and b[:4] == b"RIFF" and b[8:12] == b"WEBP":
        form, size = "webp", _webp(b)
    elif b and b[:2] == b"BM" and len(b) >= 26:
        form, size = "bmp", _bmp(b)
    elif b and b[:4] in (b"II*\0", b"MM\0*") and len(b) >= 8:
        form, size = "tiff", _tiff(b)
    elif b and b[:4] == b"\0\0\1\0" and len(b) >= 22:
        form, size = "ico", _ico(b)
    elif b and b[4:8] == b"ftyp" and b[8:12] in (b"avif", b"avis", b"mif1") and b"avi" in b[8 : int.from_bytes(b[:4], "big")]:
        form, size = "avif", _avif(b)
    return (form, *size) if size else (None, None, None)


@F.pandas_udf(T.StructType().add("format", "string").add("width", "integer").add("height", "integer"))
def _dims(content: pd.Series) -> pd.DataFrame:
    rows = pd.DataFrame([header(b) for b in content], columns=["format", "width", "height"])
    return rows.astype({"width": "Int32", "height": "Int32"})


def image_dims(content: Column, first: int = 65_536) -> Column:
    """Struct of format, width, height from an image's header; null fields if unreadable. Where the ``first`` bytes don't state them, as in large JPEGs, the whole image is looked at."""
    near = _dims(F.substring(content, 1, first))
    whole = _dims(F.when(near["format"].isNull() & (F.octet_length(content) > first), content))
    return F.when(near["format"].isNotNull(), near).otherwise(whole)
