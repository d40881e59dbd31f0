"""Registered queries of the web-capture operators over the given tables, each with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeweave.functions import pagequality as Q
from lakeweave.functions import urls as U
from lakeweave.plans import attempts as A
from lakeweave.plans import requests as R
from lakeweave.sources import io
from lakeweave.sources import policy as policies

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return io.spread(df) if name in ("pages", "documents", "orders") else df


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def pick(values: list[str], by: str = "page_id") -> Column:
    """The value at ``by`` modulo their number."""
    return F.element_at(F.array(*map(F.lit, values)), (F.col(by) % len(values) + 1).cast("int"))


def pick_sql(values: list[str], by: str = "page_id") -> str:
    return f"([{', '.join(map(quoted, values))}])[({by} % {len(values)} + 1)::INT]"


def variants(spark: SparkSession, sf_dir: str, values: list[str]) -> DataFrame:
    """pages with u: one of the values, '{u}' in it replaced by the page's URL."""
    return table(spark, sf_dir, "pages").select("page_id", "url", F.replace(pick(values), F.lit("{u}"), F.col("url")).alias("u"))


def variants_sql(values: list[str]) -> str:
    return f"(SELECT page_id, url, replace({pick_sql(values)}, '{{u}}', url) AS u FROM pages)"


# --- URLs -----------------------------------------------------------------------------------

DIRTY = ["{u}", "  {u}\t", "{u}&q=a%20b", "{u}&q=a+b%2Fc", "%C2%A0{u}%C2%A0%20", "{u}#%E2%82%AC\n", "{u}%26x=1", ""]


@query(f"SELECT page_id, regexp_replace(url_decode(u), '^[\\s\\x{{A0}}]+|[\\s\\x{{A0}}]+$', '', 'g') AS clean_url FROM {variants_sql(DIRTY)}")
def clean_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(spark, sf_dir, DIRTY).select("page_id", U.clean_url(F.col("u")).alias("clean_url"))


HOSTS = ["{u}", "https://www.bbc.co.uk/news", "HTTPS://WWW.X.COM/a", "x.photography/1", "nothing here", "see {u} there", "http://a.b.example.org"]
RE_DOMAIN = quoted(U.DOMAIN)


@query(
    f"""WITH d AS (SELECT page_id, nullif(regexp_extract(u, {RE_DOMAIN}, 1), '') AS h FROM {variants_sql(HOSTS)}), l AS (SELECT *, string_split(h, '.') AS p FROM d)
    SELECT page_id, h AS host, array_to_string(p[-2:], '.') AS domain FROM l"""
)
def url_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(spark, sf_dir, HOSTS).select("page_id", U.url_domain(F.col("u"), True).alias("host"), U.url_domain(F.col("u")).alias("domain"))


ROOTS = ["{u}", "/just/a/path", ":https://odd.example/a/b", "ftp.example.net", "https://a.example?x=/y"]


@query(f"SELECT page_id, regexp_extract(u, {quoted(U.ROOT)}, 0) AS root FROM {variants_sql(ROOTS)}")
def url_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(spark, sf_dir, ROOTS).select("page_id", U.url_root(F.col("u")).alias("root"))


KINDS = ["{u}", "/a.jpg", "data:image/png;base64,AAAA", "data:text/plain;charset=utf-8;base64,AAAA", "mailto:x@example.org", "//cdn.example.org/a.png"]


@query(f"SELECT page_id, regexp_matches(u, {quoted(U.URL)}) AS is_url, starts_with(u, '/') AS is_root_relative, regexp_matches(u, {quoted(U.DATA_URI)}) AS is_data_uri FROM {variants_sql(KINDS)}")
def url_kind_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(spark, sf_dir, KINDS).select("page_id", U.url_kind_flags(F.col("u")).alias("f")).select("page_id", "f.*")


FILES = ["{u}", "https://a.example/x.JPG?w=1", "https://a.example/x.svg#t", "https://a.example/v.mp4;s=1", "https://a.example/live.m3u8?t=.jpg", "https://a.example/a.jpg/b", "/pic.webp", "https://a.example.ts", "https://a.example/clip.ts"]
PATH_SQL = r"regexp_replace(regexp_extract(regexp_replace(u, '[?#].*$', ''), '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/]*)?(.*)$', 1), ';[^/]*$', '')"


def media_class_sql(path: str = "p") -> str:
    test = lambda s: f"regexp_matches({path}, '\\.({'|'.join(s)})$')"
    return f"CASE WHEN {test(U.PIXEL)} THEN 'image' WHEN {test(U.VECTOR)} THEN 'vector' WHEN {test(U.VIDEO)} THEN 'video' WHEN {test(U.HLS)} THEN 'hls' ELSE 'none' END"


@query(f"SELECT page_id, {media_class_sql()} AS media_class FROM (SELECT page_id, lower({PATH_SQL}) AS p FROM {variants_sql(FILES)})")
def url_media_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(spark, sf_dir, FILES).select("page_id", U.url_media_class(F.col("u")).alias("media_class"))


RELATIVE = ["/img/a.png", "img/a.png", "//cdn.example.org/a.png", "https://b.example.org/c.gif", "data:image/png;base64,AAAA", "#x"]


@query(
    f"""SELECT page_id, CASE WHEN regexp_matches(f, {quoted(U.URL)}) THEN f END AS resolved FROM
    (SELECT page_id, CASE WHEN starts_with(u, '/') THEN regexp_extract(url, {quoted(U.ROOT)}, 0) || u ELSE u END AS f FROM {variants_sql(RELATIVE)})"""
)
def resolve_media_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(spark, sf_dir, RELATIVE).select("page_id", U.resolve_media_url(F.col("u"), F.col("url")).alias("resolved"))


STYLES = ["color:red", "background-image:url('https://cdn.example.org/a.jpg')", "BACKGROUND-IMAGE : url( //x.example/b.PNG?c=1 )", "background-image:url(https://t.example/emoji/a.png)", "background-image:url(data:image/png;base64,AA)", "background-image:url(https://cdn4.telegram-cdn.org/file/abc)", "background-image:url(https://cdn.example/file/abc)", "background-image:url(https://x.example/file/abc)", "background-image:url(a.svg)", "background-image:url()"]


@query(
    f"""WITH a AS (SELECT page_id, nullif(regexp_extract(u, {quoted(U.BACKGROUND)}, 1), '') AS r FROM {variants_sql(STYLES)}),
    b AS (SELECT page_id, CASE WHEN starts_with(r, '//') THEN 'https:' || r ELSE r END AS u FROM a), c AS (SELECT page_id, u, lower(u) AS l, lower({PATH_SQL}) AS p FROM b)
    SELECT page_id, CASE WHEN NOT (starts_with(l, 'data:') OR contains(l, '/emoji/') OR contains(l, '/emojis/') OR {media_class_sql()} = 'vector')
      AND ({media_class_sql()} = 'image' OR contains(l, 'telegram-cdn.org/file/') OR (contains(l, '/file/') AND contains(l, 'cdn'))) THEN u END AS background FROM c"""
)
def background_image_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(spark, sf_dir, STYLES).select("page_id", U.background_image_url(F.col("u")).alias("background"))


LINKS = [
    ("https://x.com/someone/status/123", "x", "post", "123", None, None), ("https://twitter.com/someone/status/123/photo/2", "x", "post", "123", None, 2), ("https://x.com/search?q=a", "x", "unsupported", None, None, None),
    ("https://x.com/someone", "x", "profile", None, "someone", None), ("https://t.co/abc", "x", "short", None, None, None), ("https://www.tiktok.com/@me/video/7123456789012", "tiktok", "video", "7123456789012", "me", None),
    ("https://vm.tiktok.com/ZMabc/", "tiktok", "video", "ZMabc", "ZMabc", None), ("https://www.tiktok.com/@me", "tiktok", "profile", None, "me", None), ("https://www.facebook.com/watch/?v=42", "facebook", "video", "42", None, None),
    ("https://www.facebook.com/photo/?fbid=1", "facebook", "photo", None, None, None), ("https://www.facebook.com/login/?next=https%3A%2F%2Fwww.facebook.com%2Freel%2F9", "facebook", "video", None, None, None),
    ("https://www.facebook.com/page/posts/pfbid1", "facebook", "post", None, None, None), ("https://www.instagram.com/reel/abc/", "instagram", "video", None, None, None), ("https://www.instagram.com/p/abc/", "instagram", "photo_or_reel", None, None, None),
    ("https://www.instagram.com/someone/", "instagram", "profile", None, "someone", None), ("https://t.me/channel/77", "telegram", "post", "77", "channel", None), ("https://t.me/channel", "telegram", "invalid", None, None, None),
    ("https://bsky.app/profile/a.example.org/post/3k", "bluesky", "post", "3k", "a.example.org", None), ("https://bsky.app/profile/a.example.org", "bluesky", "profile", None, "a.example.org", None), ("https://example.org/", None, None, None, None, None),
    ("https://x.com/i/bookmarks", "x", "unsupported", None, None, None), ("https://www.instagram.com/someone/reels/", "instagram", "profile", None, "someone", None), ("https://www.instagram.com/someone/p/ABC/", "instagram", "profile", None, "someone", None),
    ("https://www.facebook.com/some/watchparty", "facebook", "other", None, None, None), ("https://www.facebook.com/page/reel_fans", "facebook", "other", None, None, None), ("https://www.tiktok.com/video/name", "tiktok", "video", None, "name", None),
    ("https://www.facebook.com/a/login?next=https%3A%2F%2Fwww.facebook.com%2Freel%2F9", "facebook", "other", None, None, None), ("https://m.facebook.com/plugins/x.php?href=https%3A%2F%2Fwww.facebook.com%2Fa%2Fposts%2F1", "facebook", "other", None, None, None),
    ("https://www.facebook.com/plugins/post.php?href=https%3A%2F%2Fwww.facebook.com%2Fa%2Fposts%2F1", "facebook", "post", None, None, None), ("https://publish.twitter.com/?query=https%3A%2F%2Fx.com%2Fme%2Fstatus%2F5", "x", "post", "5", None, None), ("https://www.tiktok.com/12/@/who", "tiktok", "profile", None, "who", None),
]


def _row(values: tuple) -> str:
    return "(" + ", ".join("NULL" if v is None else quoted(v) if isinstance(v, str) else str(v) for v in values) + ")"


@query(f"SELECT page_id, platform, kind, id, username, media_number FROM pages JOIN (VALUES {', '.join(_row((i, *r)) for i, r in enumerate(LINKS))}) v(k, link, platform, kind, id, username, media_number) ON page_id % {len(LINKS)} = k")
def classify_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = pick([r[0] for r in LINKS])
    return table(spark, sf_dir, "pages").select("page_id", U.classify_link(u).alias("l")).select("page_id", "l.platform", "l.kind", "l.id", "l.username", "l.media_number")


@query(
    """SELECT page_id, CASE page_id % 4 WHEN 0 THEN url WHEN 2 THEN 'https://' || page_id || '.example.org/x' END AS long_url FROM pages"""
)
def expand_short_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    short = F.concat(F.lit("https://t.co/"), F.col("page_id").cast("string"))
    kind = F.col("page_id") % 4
    redirects = pages.where(kind < 3).select(short.alias("short_url"), F.when(kind == 0, F.col("url")).otherwise(F.concat(short, F.lit("/"))).alias("final_url"), F.when(kind == 2, F.concat(F.lit('<meta content="0;url=https://'), F.col("page_id").cast("string"), F.lit('.example.org/x">'))).otherwise("").alias("body"))
    return U.expand_short_urls(pages.select("page_id", short.alias("short_url")), redirects).select("page_id", "long_url")


# --- planning -------------------------------------------------------------------------------

SITES = ["https://x.com/a/status/1", "https://www.reddit.com/r/a", "https://ghostarchive.org/a", "https://truthsocial.com/@a", "https://www.instagram.com/p/a", "https://verafiles.org/a", "https://example.com/a.jpg", "https://bsky.app/profile/a", "https://example.org/v.mp4", "https://perma.cc/a", "https://snopes.com/x"]


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests derived from events: sites in turn, some with a method list, some for html."""
    e = table(spark, sf_dir, "events")
    site = pick(SITES, "user_id")
    methods = F.when(F.col("event_id") % 7 == 0, F.array(F.lit("decodo"))).when(F.col("event_id") % 11 == 0, F.array(F.lit("firecrawl"), F.lit("nope"))).when(F.col("event_id") % 13 == 0, F.array().cast("array<string>"))
    return e.select(F.col("event_id").alias("pos"), F.concat(site, F.lit("?u="), F.col("user_id").cast("string")).alias("url"), methods.alias("methods"), F.when(F.col("event_id") % 5 == 0, "html").otherwise("markdown").alias("format"), (F.col("event_id") % 3 != 0).alias("include_media"), F.lit(None).cast("long").alias("max_video_size"), F.when(F.col("event_id") % 3 == 0, "speed").when(F.col("event_id") % 3 == 1, "completeness").alias("prioritize"))


REQUESTS_SQL = f"""requests AS (SELECT event_id AS pos, {pick_sql(SITES, "user_id")} || '?u=' || user_id AS url,
    CASE WHEN event_id % 7 = 0 THEN ['decodo'] WHEN event_id % 11 = 0 THEN ['firecrawl', 'nope'] WHEN event_id % 13 = 0 THEN [] END AS methods,
    CASE WHEN event_id % 5 = 0 THEN 'html' ELSE 'markdown' END AS format, event_id % 3 <> 0 AS include_media, CASE event_id % 3 WHEN 0 THEN 'speed' WHEN 1 THEN 'completeness' END AS prioritize FROM events)"""
_policy_rows = sorted({*policies.METHODS, *(d for ds in policies.INTEGRATIONS.values() for d in ds), *policies.NO_BOT, *policies.PREMIUM_PROXY})
_list = lambda v: "NULL" if v is None else "[" + ", ".join(map(quoted, v)) + "]::VARCHAR[]"
POLICY_SQL = "policy(domain, p_methods, owners, no_bot, premium, no_ad) AS (VALUES " + ", ".join(f"({quoted(d)}, {_list(policies.METHODS.get(d))}, {_list([n for n, ds in policies.INTEGRATIONS.items() if d in ds])}, {str(d in policies.NO_BOT).lower()}, {str(d in policies.PREMIUM_PROXY).lower()}, {str(d in policies.NO_AD_BLOCK).lower()})" for d in _policy_rows) + ")"
DEDUPED_SQL = "deduped AS (SELECT url, max(pos) AS pos, arg_max(struct_pack(m := methods), pos).m AS methods, arg_max(format, pos) AS format, arg_max(include_media, pos) AS include_media, arg_max(struct_pack(p := prioritize), pos).p AS prioritize FROM requests GROUP BY url)"
ROUTED_SQL = f"""named AS (SELECT *, array_to_string(string_split(nullif(regexp_extract(url, {RE_DOMAIN}, 1), ''), '.')[-2:], '.') AS domain FROM deduped),
    routed AS (SELECT n.*, coalesce(p.no_bot, false) AS no_bot, coalesce(premium, false) AS premium, coalesce(no_ad, false) AS no_ad,
      flatten(list_transform(coalesce(methods, p_methods, {_list(policies.DEFAULT_METHODS)}), lambda m: CASE WHEN m = 'integrations' THEN coalesce(owners, []) ELSE [m] END)) AS steps FROM named n LEFT JOIN policy p ON p.domain = n.domain)"""
PLAN_SQL = f"WITH {REQUESTS_SQL}, {POLICY_SQL}, {DEDUPED_SQL}, {ROUTED_SQL}"


def _routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.route_methods(R.dedupe_requests(requests(spark, sf_dir)), policies.load_domain_policy(spark))


@query(f"WITH {REQUESTS_SQL}, {DEDUPED_SQL} SELECT url, pos, array_to_string(methods, ',') AS methods, format FROM deduped")
def dedupe_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.dedupe_requests(requests(spark, sf_dir)).select("url", "pos", F.array_join("methods", ",").alias("methods"), "format")


@query(f"{PLAN_SQL} SELECT url, domain, array_to_string(steps, ',') AS steps FROM routed")
def route_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _routed(spark, sf_dir).select("url", "domain", F.array_join("steps", ",").alias("steps"))


@query(
    f"""{PLAN_SQL} SELECT url, CASE WHEN len(steps) = 0 THEN 'no_methods' WHEN len(list_filter(steps, lambda m: NOT list_contains({_list(R.KNOWN)}, m))) > 0 THEN 'unknown_method'
    WHEN format = 'html' AND len(list_filter(steps, lambda m: m NOT IN ('firecrawl', 'decodo'))) > 0 THEN 'html_needs_scraper' ELSE 'ok' END AS status FROM routed"""
)
def validate_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.validate_plan(_routed(spark, sf_dir)).select("url", "status")


@query(f"""{PLAN_SQL}, c AS (SELECT *, lower({PATH_SQL.replace("(u,", "(url,")}) AS p FROM routed) SELECT url, CASE WHEN format <> 'html' AND include_media THEN CASE {media_class_sql()} WHEN 'image' THEN 'image' WHEN 'video' THEN 'video' WHEN 'hls' THEN 'video' END END AS direct_kind FROM c""")
def direct_media_shortcut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.direct_media_shortcut(_routed(spark, sf_dir)).select("url", "direct_kind")


@query(
    f"""{PLAN_SQL} SELECT url, step - 1 AS step, steps[step] AS method, CASE WHEN prioritize = 'speed' THEN 15 ELSE 60 END AS timeout_s, CASE WHEN prioritize = 'speed' THEN 1 ELSE 5 END AS max_retries,
    premium AS premium_proxy, NOT no_ad AS ad_block, no_bot AND steps[step] = 'firecrawl' AS blocked FROM routed, (SELECT unnest(generate_series(1, 8)) AS step) WHERE step <= len(steps)"""
)
def explode_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.explode_plan(_routed(spark, sf_dir), policies.load_domain_policy(spark)).select("url", "step", "method", "timeout_s", "max_retries", "premium_proxy", "ad_block", "blocked")


@query(f"{PLAN_SQL} SELECT url FROM routed WHERE NOT no_bot")
def exclude_no_bot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.exclude_no_bot(_routed(spark, sf_dir), policies.load_domain_policy(spark)).select("url")


@query(f"{PLAN_SQL} SELECT url FROM routed WHERE no_bot")
def only_no_bot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.only_no_bot(_routed(spark, sf_dir), policies.load_domain_policy(spark)).select("url")


@query(f"WITH {POLICY_SQL} SELECT page_id, d.domain, array_to_string(p_methods, ',') AS methods, array_to_string(owners, ',') AS integrations, no_bot FROM pages, (SELECT *, row_number() OVER (ORDER BY domain) - 1 AS k FROM policy) d WHERE page_id % (SELECT count(*) FROM policy) = k")
def load_domain_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    policy = policies.load_domain_policy(spark)
    n = len({*policies.METHODS, *(d for ds in policies.INTEGRATIONS.values() for d in ds), *policies.NO_BOT, *policies.PREMIUM_PROXY, *policies.NO_AD_BLOCK, *policies.SELECTORS})
    numbered = policy.withColumn("k", F.row_number().over(Window.orderBy("domain")) - 1)
    return table(spark, sf_dir, "pages").withColumn("k", F.col("page_id") % n).join(F.broadcast(numbered), "k").select("page_id", "domain", F.array_join("methods", ",").alias("methods"), F.array_join("integrations", ",").alias("integrations"), "no_bot")


# --- attempts -------------------------------------------------------------------------------


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts derived from events: a URL for each user and day, steps in order of event_id."""
    e = table(spark, sf_dir, "events")
    good = F.col("event_id") % 4 == 0
    method = pick(["integrations", "firecrawl", "decodo"], "event_id")
    return e.select(
        F.concat(F.lit("https://example.org/"), F.col("user_id").cast("string"), F.lit("/"), (F.col("event_id") % 97).cast("string")).alias("url"), F.col("event_id").cast("int").alias("step"), method.alias("method"), "ts",
        F.when(F.col("event_id") % 3 == 0, 429).when(F.col("event_id") % 5 == 0, 500).when(F.col("event_id") % 7 == 0, 502).otherwise(200).alias("status"),
        F.when(good, F.when(F.col("event_id") % 8 == 0, "").otherwise(F.col("props"))).alias("content"), F.lit(None).cast("string").alias("error_class"),
        F.when(~good & (F.col("event_id") % 2 == 0), F.concat(F.lit("failed "), F.col("event_type"))).alias("error_message"), F.col("value").alias("elapsed"),
    )


ATTEMPTS_SQL = f"""attempts AS (SELECT 'https://example.org/' || user_id || '/' || (event_id % 97) AS url, event_id AS step, {pick_sql(["integrations", "firecrawl", "decodo"], "event_id")} AS method, ts,
    CASE WHEN event_id % 3 = 0 THEN 429 WHEN event_id % 5 = 0 THEN 500 WHEN event_id % 7 = 0 THEN 502 ELSE 200 END AS status,
    CASE WHEN event_id % 4 = 0 THEN CASE WHEN event_id % 8 = 0 THEN '' ELSE props END END AS content,
    CASE WHEN event_id % 4 <> 0 AND event_id % 2 = 0 THEN 'failed ' || event_type END AS error_message, value AS elapsed FROM events)"""
RESPONSES_SQL = f"""{ATTEMPTS_SQL}, w AS (SELECT url, min(step) FILTER (WHERE content IS NOT NULL) AS win FROM attempts GROUP BY url),
    f AS (SELECT a.url, a.method, arg_max(coalesce(error_message, 'Method ' || method || ' returned no content.'), step) AS message, max(step) AS last FROM attempts a JOIN w USING (url) WHERE a.content IS NULL AND (win IS NULL OR a.step < win) GROUP BY 1, 2),
    errs AS (SELECT url, string_agg(method || ': ' || message, '; ' ORDER BY last) AS errors FROM f GROUP BY url),
    responses AS (SELECT w.url, a.method, a.step, a.elapsed AS retrieval_time, win IS NOT NULL AS successful, coalesce(errors, '') AS errors, a.content FROM w LEFT JOIN attempts a ON a.url = w.url AND a.step = win LEFT JOIN errs ON errs.url = w.url)"""


@query(f"WITH {RESPONSES_SQL} SELECT url, method, step, retrieval_time, successful, errors, content FROM responses")
def first_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.array_join(F.transform(F.map_entries("errors"), lambda e: F.concat_ws(": ", e["key"], e["value"]["message"])), "; ")
    return A.first_success(attempts(spark, sf_dir)).select("url", "method", "step", "retrieval_time", "successful", line.alias("errors"), "content")


@query(f"WITH {RESPONSES_SQL} SELECT a.step AS pos, r.url, r.method, r.successful FROM attempts a JOIN responses r USING (url)")
def fan_out_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = attempts(spark, sf_dir)
    return R.fan_out_results(log.select(F.col("step").alias("pos"), "url"), A.first_success(log, with_content=False)).select("pos", "url", "method", "successful")


@query(
    f"""WITH {ATTEMPTS_SQL}, n AS (SELECT url, method, step, ts, status, row_number() OVER (PARTITION BY url, method ORDER BY ts) - 1 AS attempt FROM attempts),
    o AS (SELECT *, CASE WHEN status = 200 THEN 'ok' WHEN status IN (429, 613, 502) THEN CASE WHEN attempt >= 1 THEN 'exhausted' ELSE 'retry' END ELSE 'terminal' END AS outcome FROM n)
    SELECT step, attempt, outcome, CASE WHEN outcome = 'retry' THEN pow(2.0, attempt) END AS wait_s, CASE WHEN outcome = 'retry' THEN (epoch_us(ts) + (pow(2, attempt) * 1000000)::BIGINT) END AS next_us FROM o"""
)
def retry_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.retry_plan(attempts(spark, sf_dir), 1).select("step", "attempt", "outcome", "wait_s", F.unix_micros(F.col("next_ts").cast("timestamp")).alias("next_us"))


def _responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.first_success(attempts(spark, sf_dir), with_content=False)


@query(f"WITH {RESPONSES_SQL} SELECT count(*) AS total, count(*) FILTER (WHERE successful) AS successful, round(avg(retrieval_time), 6) AS avg_time, max(retrieval_time) AS max_time FROM responses")
def crawl_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.crawl_summary(_responses(spark, sf_dir)).withColumn("avg_time", F.round("avg_time", 6))


@query(f"WITH {RESPONSES_SQL} SELECT coalesce(method, 'N/A') AS method, round(avg(retrieval_time), 6) AS avg_time, count(*) AS n FROM responses GROUP BY 1")
def method_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.method_summary(_responses(spark, sf_dir)).withColumn("avg_time", F.round("avg_time", 6))


@query(f"WITH {RESPONSES_SQL} SELECT url, method, CASE WHEN successful THEN 'OK' ELSE 'FAIL' END AS status, retrieval_time, errors FROM responses ORDER BY retrieval_time DESC NULLS LAST, url LIMIT 50")
def slowest_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.slowest_urls(_responses(spark, sf_dir), 50)


@query("""WITH i AS (SELECT orderkey, kind, count(*) AS found FROM (SELECT l_orderkey AS orderkey, CASE WHEN l_linenumber % 3 = 0 THEN 'video' ELSE 'image' END AS kind FROM lineitem) GROUP BY 1, 2),
    e AS (SELECT o_orderkey AS orderkey, 'image' AS kind, 3 AS min_count FROM orders UNION ALL SELECT o_orderkey, 'video', 1 FROM orders)
    SELECT e.orderkey::VARCHAR AS url, e.kind, min_count, coalesce(found, 0) AS found FROM e LEFT JOIN i ON i.orderkey = e.orderkey AND i.kind = e.kind WHERE coalesce(found, 0) < min_count""")
def expect_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("url")).agg(F.collect_list(F.struct(F.when(F.col("l_linenumber") % 3 == 0, "video").otherwise("image").alias("kind"))).alias("items"))
    want = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("url"), F.explode(F.array(F.struct(F.lit("image").alias("kind"), F.lit(3).alias("min_count")), F.struct(F.lit("video").alias("kind"), F.lit(1).alias("min_count")))).alias("e")).select("url", "e.*")
    return A.expect_media(items, want)


SAID = ["HTTP Error 404: Not Found", "rate-limit reached for you", "No video formats found!", "something", "Video unavailable", "flood wait of 5", "Cannot parse data; please report this issue"]
SOURCES = ["x", "scraping_api", "target", "bluesky", "telegram", "facebook", "instagram"]


@query(
    f"""SELECT event_id, CASE WHEN m LIKE '%404: Not Found%' OR m LIKE 'Video un%' THEN 'TargetUnavailable' WHEN m LIKE 'rate-limit%' AND s = 'instagram' THEN 'RateLimit' WHEN m LIKE 'No video%' AND s = 'facebook' THEN 'ContentBlocked' WHEN m LIKE 'Cannot%' THEN 'RetrievalFailed'
    WHEN s = 'x' AND c = 429 THEN 'RateLimit' WHEN s = 'x' AND c = 402 THEN 'QuotaExceeded' WHEN s = 'scraping_api' AND c = 429 THEN 'RateLimit' WHEN s = 'target' AND c >= 400 THEN 'RetrievalFailed'
    WHEN s = 'bluesky' AND c IN (400, 404) THEN 'TargetUnavailable' WHEN s = 'telegram' AND m LIKE 'flood%' THEN 'RateLimit' ELSE 'Runtime' END AS cls
    FROM (SELECT event_id, {pick_sql(SAID, "event_id")} AS m, {pick_sql(SOURCES, "user_id")} AS s, ([200, 402, 404, 429])[(event_id // 7 % 4 + 1)::INT] AS c FROM events)"""
)
def classify_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.element_at(F.array(*map(F.lit, (200, 402, 404, 429))), (F.floor(F.col("event_id") / 7) % 4 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", Q.classify_error(pick(SOURCES, "user_id"), pick(SAID, "event_id"), status).alias("cls"))


@query("""SELECT event_id, CASE WHEN event_id % 4 = 2 AND event_id % 3 <> 0 THEN NULL WHEN event_id % 4 = 2 THEN '<p>' || event_id || '</p>' END AS html,
    CASE event_id % 4 WHEN 0 THEN 'Runtime' WHEN 1 THEN 'RetrievalFailed' WHEN 2 THEN CASE WHEN event_id % 3 <> 0 THEN 'RetrievalFailed' END ELSE 'RetrievalFailed' END AS cls FROM events""")
def parse_scrape_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 4
    content = F.when(F.col("event_id") % 3 != 0, "").otherwise(F.concat(F.lit("<p>"), F.col("event_id").cast("string"), F.lit("</p>")))
    one = F.array(F.struct(content.alias("content"), F.when(k == 1, 404).otherwise(200).alias("status_code")))
    reply = F.struct(F.when(k == 0, "failed").otherwise("done").alias("status"), F.lit(613).alias("status_code"), F.lit("no").alias("message"), F.when(k == 3, F.slice(one, 1, 0)).otherwise(one).alias("results"))
    out = io.parse_scrape_envelope(table(spark, sf_dir, "events").select("event_id", F.to_json(reply).alias("json")), "json")
    return out.select("event_id", "html", F.col("error.cls").alias("cls"))
