"""From URL requests to planned steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeweave.functions.urls import clean_url, url_domain, url_media_class
from lakeweave.sources.policy import DEFAULT_METHODS, INTEGRATIONS

KNOWN = [*DEFAULT_METHODS, *INTEGRATIONS]


def dedupe_requests(requests: DataFrame) -> DataFrame:
    """One row per raw URL; of several the one last in position decides, its null methods (auto) too."""
    rest = [c for c in requests.columns if c not in ("url", "pos")]
    last = F.max_by(F.struct(*rest), F.col("pos")).alias("r")
    return requests.groupBy("url").agg(F.max("pos").alias("pos"), last).select("pos", "url", *(F.col(f"r.{c}") for c in rest))


def fan_out_results(requests: DataFrame, responses: DataFrame, ordered: bool = False) -> DataFrame:
    """A result for every request row, repeated URLs too; ``ordered`` sorts by position, for a sink that needs it."""
    out = requests.select("pos", "url").join(responses, "url", "left")
    return out.orderBy("pos") if ordered else out


def route_methods(requests: DataFrame, policy: DataFrame) -> DataFrame:
    """Add clean_url, domain and steps, the methods in order.

    Automatic requests get their domain's methods, or the default ones; explicit lists stay.
    'integrations' is replaced in place by those that own the domain. The policy is a fixed list
    of some dozens of domains, so that it is broadcast.
    """
    own = policy.select(F.col("domain").alias("__domain"), F.col("methods").alias("__methods"), F.col("integrations").alias("__owners"))
    at = requests.withColumn("clean_url", clean_url(F.col("url"))).withColumn("domain", url_domain(F.col("clean_url")))
    joined = at.join(F.broadcast(own), F.col("domain") == F.col("__domain"), "left")
    default = F.array(*map(F.lit, DEFAULT_METHODS))
    listed = F.coalesce("methods", "__methods", default)
    owners = F.coalesce("__owners", F.array().cast("array<string>"))
    steps = F.flatten(F.transform(listed, lambda m: F.when(m == "integrations", owners).otherwise(F.array(m))))
    return joined.withColumn("steps", steps).drop("__domain", "__methods", "__owners")


def validate_plan(plan: DataFrame, unsupported: tuple[str, ...] = ()) -> DataFrame:
    """Add status: ok, unsupported_domain, no_methods, unknown_method or html_needs_scraper. Nothing is raised: bad rows stay as rows."""
    known = F.array(*map(F.lit, KNOWN))
    status = (
        F.when(F.col("domain").isin(*unsupported) if unsupported else F.lit(False), "unsupported_domain")
        .when(F.size("steps") == 0, "no_methods")
        .when(F.exists("steps", lambda m: ~F.array_contains(known, m)), "unknown_method")
        .when((F.col("format") == "html") & F.exists("steps", lambda m: ~m.isin("firecrawl", "decodo")), "html_needs_scraper")
    )
    return plan.withColumn("status", F.coalesce(status, F.lit("ok")))


def direct_media_shortcut(plan: DataFrame, blobs: DataFrame | None = None) -> DataFrame:
    """Add direct_kind (image or video by suffix, unless html is asked for or media aren't) and, given blobs, direct_ok and method. A failed download falls through to the steps; where blobs have kinds (as of ``media_catalogue``), so does one of another kind."""
    by_url = url_media_class(F.col("clean_url"))
    asked = (F.coalesce("format", F.lit("")) != "html") & F.col("include_media")
    plan = plan.withColumn("direct_kind", F.when(asked, F.when(by_url == "image", "image").when(by_url.isin("video", "hls"), "video")))
    if blobs is None:
        return plan
    have = blobs.select(F.col("url").alias("__blob"), *([F.col("kind").alias("__kind")] if "kind" in blobs.columns else [])).distinct()
    on = F.when(F.col("direct_kind").isNotNull(), F.col("clean_url")) == F.col("__blob")
    joined = plan.join(have, on & (F.col("direct_kind") == F.col("__kind")) if "kind" in blobs.columns else on, "left").drop("__kind")
    ok = F.col("__blob").isNotNull()
    return joined.withColumn("direct_ok", ok).withColumn("method", F.when(ok, "Direct download")).drop("__blob")


def explode_plan(plan: DataFrame, policy: DataFrame) -> DataFrame:
    """One row per URL and step, with the settings that hold there. Requests that don't say are for completeness."""
    own = policy.select(F.col("domain").alias("__domain"), "no_bot", "premium_proxy", "no_ad_block")
    rows = plan.select("*", F.posexplode("steps").alias("step", "step_method")).join(F.broadcast(own), F.col("domain") == F.col("__domain"), "left").drop("__domain")
    speed = F.coalesce("prioritize", F.lit("completeness")) == "speed"
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    return rows.select(
        "url", "clean_url", "domain", "step", F.col("step_method").alias("method"),
        F.when(speed, 15).otherwise(60).alias("timeout_s"), F.when(speed, 1).otherwise(5).alias("max_retries"),
        flag("premium_proxy").alias("premium_proxy"), (~flag("no_ad_block")).alias("ad_block"),
        (flag("no_bot") & (F.col("step_method") == "firecrawl")).alias("blocked"),
    )


def exclude_no_bot(urls: DataFrame, policy: DataFrame, domain_col: str = "domain") -> DataFrame:
    """URLs whose domain lets bots in, or has no entry."""
    closed = policy.where("no_bot").select(F.col("domain").alias("__domain"))
    return urls.join(F.broadcast(closed), F.col(domain_col) == F.col("__domain"), "left_anti")


def only_no_bot(urls: DataFrame, policy: DataFrame, domain_col: str = "domain") -> DataFrame:
    closed = policy.where("no_bot").select(F.col("domain").alias("__domain"))
    return urls.join(F.broadcast(closed), F.col(domain_col) == F.col("__domain"), "left_semi")
