"""The domain policy: which methods, integrations and settings a domain gets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Methods by domain, domains of integrations, and lists of domains.
DEFAULT_METHODS = ["integrations", "firecrawl", "decodo"]
METHODS = {
    "instagram.com": ["integrations", "decodo"],
    "facebook.com": ["integrations"],
    "fb.watch": ["integrations"],
    "x.com": ["integrations"],
    "twitter.com": ["integrations"],
    "t.co": ["integrations"],
    "t.me": ["integrations"],
    "tiktok.com": ["integrations"],
    "telegram.me": ["integrations"],
    "bsky.app": ["integrations"],
    "truthsocial.com": ["firecrawl"],
    "reddit.com": ["integrations"],
    "youtube.com": ["integrations"],
    "youtu.be": ["integrations"],
    "archive.today": ["integrations"],
    "archive.is": ["integrations"],
    "archive.ph": ["integrations"],
    "archive.vn": ["integrations"],
    "archive.li": ["integrations"],
    "archive.fo": ["integrations"],
    "archive.md": ["integrations"],
    "perma.cc": ["integrations"],
    "archive.org": ["integrations"],
    "mvau.lt": ["integrations"],
    "awesomescreenshot.com": ["integrations"],
    "washingtonpost.com": ["decodo"],
    "verafiles.org": ["decodo", "firecrawl"],
    "youturn.in": ["decodo"],
}
ARCHIVE_TODAY = ["archive.today", "archive.is", "archive.ph", "archive.vn", "archive.li", "archive.fo", "archive.md"]
INTEGRATIONS = {
    "X (Twitter)": ["twitter.com", "x.com", "t.co"],
    "Telegram": ["t.me", "telegram.me"],
    "Bluesky": ["bsky.app"],
    "TikTok": ["tiktok.com"],
    "Instagram": ["instagram.com"],
    "Facebook": ["facebook.com", "fb.watch"],
    "YouTube": ["youtube.com", "youtu.be"],
    "Perma.cc": ["perma.cc"],
    "Archive.today": ARCHIVE_TODAY,
    "Internet Archive": ["archive.org"],
    "Headed Browser": ["mvau.lt"],
    "Ghostarchive": ["ghostarchive.org"],
    "AwesomeScreenshot": ["awesomescreenshot.com"],
}
NO_BOT = ["facebook.com", "instagram.com", "youtube.com", "tiktok.com", "reddit.com", "ebay.com", "microsoft.com", "researchhub.com", "pinterest.com", "irs.gov", "t.me", "telegram.me", "twitter.com", "x.com", "t.co", "perma.cc", "washingtonpost.com", "indiatoday.in"]
PREMIUM_PROXY = ["snopes.com"]
NO_AD_BLOCK = ["snopes.com"]
SELECTORS = {**dict.fromkeys(ARCHIVE_TODAY, "div#CONTENT"), "awesomescreenshot.com": "div.img-wrapper, div.video-box"}

SCHEMA = "domain string, methods array<string>, integrations array<string>, no_bot boolean, premium_proxy boolean, no_ad_block boolean, relaxed_ssl boolean, content_selector string"


def load_domain_policy(spark: SparkSession, more: dict[str, list[str]] | None = None) -> DataFrame:
    """One row per known domain. A fixed, small table: joins broadcast it. ``more`` adds or replaces methods by domain."""
    methods = {**METHODS, **(more or {})}
    owners: dict[str, list[str]] = {}
    for name, domains in INTEGRATIONS.items():
        for d in domains:
            owners.setdefault(d, []).append(name)
    known = sorted({*methods, *owners, *NO_BOT, *PREMIUM_PROXY, *NO_AD_BLOCK, *SELECTORS})
    rows = [(d, methods.get(d), owners.get(d, []), d in NO_BOT, d in PREMIUM_PROXY, d in NO_AD_BLOCK, d in ARCHIVE_TODAY, SELECTORS.get(d)) for d in known]
    return spark.createDataFrame(rows, SCHEMA)
