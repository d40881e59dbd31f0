"""Columns over HTML and Markdown text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns that decide what matches.
DATA_URI = r"data:([\w/+.-]+/[\w.+-]+);base64,([A-Za-z0-9+/=]+)"
MARKDOWN_LINK = r'(?s)(!?\[([^\]\^\[]*)\]\((.*?)(?: "[^"]*")?\))'
FACEBOOK_PHOTO = r'href="(https://www\.facebook\.com/photo/[^"]*)"'
FACEBOOK_SVG = r"""['"]?%[0-9A-Fa-f]{2}.*?(?:%3C/svg%3E|%3C%2Fsvg%3E)['"]?"""


def strict_base64(data: Column) -> Column:
    """Bytes of padded base64; null for anything else."""
    return F.when(F.length(data) % 4 == 0, F.try_to_binary(data, F.lit("base64")))


def inline_text_data_uris(html: Column) -> Column:
    """Replace base64 data URIs of text by their text. Bad base64 or UTF-8, and surplus padding, stay as they are."""

    def step(acc: Column, uri: Column) -> Column:
        data = strict_base64(F.regexp_extract(uri, DATA_URI, 2))
        text = F.try_validate_utf8(data.cast("string"))
        good = F.regexp_extract(uri, DATA_URI, 1).startswith("text/") & text.isNotNull()
        return F.when(good, F.replace(acc, uri, text)).otherwise(acc)

    found = F.array_distinct(F.regexp_extract_all(html, F.lit(DATA_URI), F.lit(0)))
    return F.aggregate(found, html, step)


def tidy_markdown(text: Column) -> Column:
    """One space for runs of spaces, at most one blank line, no NUL, no white space around."""
    t = F.regexp_replace(text, " +", " ")
    t = F.regexp_replace(t, r"(?:\n *){3,}", "\n\n")
    t = F.regexp_replace(t, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")
    return F.regexp_replace(t, "\x00", "")


def markdown_links(text: Column) -> Column:
    """Array of structs full, hypertext, url of all links and images, in order."""
    parts = [F.regexp_extract_all(text, F.lit(MARKDOWN_LINK), F.lit(i)) for i in (1, 2, 3)]
    return F.transform(F.arrays_zip(*(p.alias(n) for p, n in zip(parts, ("full", "hypertext", "url"), strict=True))), lambda s: F.struct(s["full"].alias("full"), s["hypertext"].alias("hypertext"), s["url"].alias("url")))


def photo_links(html: Column) -> Column:
    """All photo hrefs of a post page, in order."""
    return F.regexp_extract_all(html, F.lit(FACEBOOK_PHOTO), F.lit(1))


def strip_svg_blobs(text: Column) -> Column:
    """Remove percent-encoded SVG icons."""
    return F.regexp_replace(text, FACEBOOK_SVG, "")
