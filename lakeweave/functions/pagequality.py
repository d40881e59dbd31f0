"""Columns that tell block pages and classify errors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Phrases of walls and errors.
WALL = ("security check", "captcha", "just a moment", "performing security verification")
CHALLENGE = ("Just a moment", "Performing security verification")
UNAVAILABLE = "503 service unavailable"
MISSING = "not found (yet?)"
#: Phrase, class, and the source whose phrase it is (None: any that downloads videos).
MESSAGES = (
    ("Your IP address is blocked from accessing this post", "IPBanned", "tiktok"),
    ("This post may not be comfortable for some audiences", "ContentBlocked", "tiktok"),
    ("No video formats found", "ContentBlocked", "facebook"),
    ("This video is only available for registered users", "RateLimit", "facebook"),
    ("rate-limit reached", "RateLimit", "instagram"),
    ("This content isn't available to everyone", "ContentBlocked", None),
    ("Video unavailable", "TargetUnavailable", None),
    ("HTTP Error 404: Not Found", "TargetUnavailable", None),
    ("Cannot parse data; please report this issue", "RetrievalFailed", None),
)


def block_page_reason(text: Column, final_url: Column) -> Column:
    """capture_missing, captcha, challenge, service_503, bare_host or null, in this order."""
    low = F.lower(text)
    path = F.regexp_extract(F.regexp_replace(final_url, r"[?#].*$", ""), r"^https?://[^/]+(.*)$", 1)
    wall = F.lit(False)
    for phrase in WALL:
        wall = wall | low.contains(phrase)
    challenge = text.contains(CHALLENGE[0]) | text.contains(CHALLENGE[1])
    return (
        F.when(text.contains(MISSING), "capture_missing")
        .when(challenge, "challenge")
        .when(wall, "captcha")
        .when(low.contains(UNAVAILABLE), "service_503")
        .when(path.isin("", "/") & final_url.isNotNull(), "bare_host")
    )


def classify_error(source: Column, message: Column, status: Column) -> Column:
    """Class of an error by its message, where the phrase is one of its source's, then by the source (x, scraping_api, target, head, bluesky, telegram, facebook, instagram, tiktok) and status."""
    by_message = F.lit(None).cast("string")
    for phrase, name, of in reversed(MESSAGES):
        said = message.contains(phrase)
        by_message = F.when(said if of is None else said & (source == of), name).otherwise(by_message)
    by_status = (
        F.when((source == "x") & (status == 429), "RateLimit")
        .when((source == "x") & (status == 402), "QuotaExceeded")
        .when((source == "scraping_api") & (status == 429), "RateLimit")
        .when((source == "target") & (status >= 400), "RetrievalFailed")
        .when((source == "head") & (status >= 400), "TargetUnavailable")
        .when((source == "head") & status.isNull(), "Unknown")
        .when((source == "bluesky") & status.isin(400, 404), "TargetUnavailable")
        .when((source == "telegram") & message.contains("flood"), "RateLimit")
        .when(message.contains(MISSING), "TargetUnavailable")
    )
    return F.coalesce(by_message, by_status, F.lit("Runtime"))
