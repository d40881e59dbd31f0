"""Registered query of the whole way of a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeweave.functions import urls as U
from lakeweave.plans import requests as R
from lakeweave.plans.retrieve import SCRAPERS
from lakeweave.plans.retrieve import retrieve as answer
from lakeweave.queries import PATH_SQL, PLAN_SQL, _list, _routed, media_class_sql, query, quoted, requests
from lakeweave.sources import policy as policies

_SAID = "CASE WHEN steps[k] IN ('firecrawl', 'decodo') THEN '<h1>' || steps[k] || '</h1><p>' || e.url || '</p><img src=\"/pic.png\">' ELSE 'card of ' || steps[k] || ' for ' || e.url END"


@query(
    f"""{PLAN_SQL}, c AS (SELECT *, lower({PATH_SQL.replace("(u,", "(url,")}) AS p, regexp_extract(url, 'u=(\\d+)$', 1)::BIGINT AS person, regexp_extract(url, {quoted(U.ROOT)}, 0) AS root FROM routed),
    st AS (SELECT *, CASE WHEN len(steps) = 0 THEN 'no_methods' WHEN len(list_filter(steps, lambda m: NOT list_contains({_list(R.KNOWN)}, m))) > 0 THEN 'unknown_method'
           WHEN format = 'html' AND len(list_filter(steps, lambda m: m NOT IN ('firecrawl', 'decodo'))) > 0 THEN 'html_needs_scraper' ELSE 'ok' END AS status,
           CASE WHEN format <> 'html' AND include_media THEN CASE {media_class_sql()} WHEN 'image' THEN 'image' WHEN 'video' THEN 'video' WHEN 'hls' THEN 'video' END END AS dk FROM c),
    d AS (SELECT *, status = 'ok' AND dk IS NOT NULL AND person % 2 = 0 AS direct FROM st),
    e AS (SELECT *, unnest(generate_series(1, len(steps))) AS k FROM d WHERE status = 'ok' AND NOT direct),
    w AS (SELECT url, min(k) FILTER (WHERE (length(url) + k) % 3 = 0) AS w FROM e GROUP BY url),
    f AS (SELECT e.url, array_to_string(list_sort(list(steps[k] || ': ' || CASE WHEN k % 2 = 0 THEN 'E' || k ELSE 'Method ' || steps[k] || ' returned no content.' END)), '; ') AS errors FROM e JOIN w USING (url) WHERE w IS NULL OR k < w GROUP BY 1),
    a AS (SELECT e.url, steps[k] AS method, k - 1 + 0.5 AS retrieval_time, CASE WHEN format = 'html' OR steps[k] NOT IN ('firecrawl', 'decodo') THEN {_SAID} ELSE '# ' || steps[k] || E'\n\n' || e.url || E'\n\n' || CASE WHEN include_media THEN '<image:' || substr(sha256(root), 1, 32) || '>' ELSE '![](/pic.png)' END END AS text,
          CASE WHEN format <> 'html' AND include_media AND steps[k] IN ('firecrawl', 'decodo') THEN 1 ELSE 0 END AS n_items FROM e JOIN w ON w.url = e.url AND k = w),
    r AS (SELECT d.url, coalesce(a.method, CASE WHEN direct THEN 'Direct download' END) AS method, a.retrieval_time, direct OR a.url IS NOT NULL AS successful, CASE WHEN status <> 'ok' THEN 'plan: ' || status ELSE coalesce(f.errors, '') END AS errors,
          CASE WHEN direct THEN '<' || dk || ':' || substr(sha256(d.url), 1, 32) || '>' ELSE a.text END AS text, CASE WHEN direct THEN 1 ELSE coalesce(n_items, 0) END AS n_items FROM d LEFT JOIN a USING (url) LEFT JOIN f USING (url))
    SELECT q.pos, r.* FROM requests q JOIN r USING (url)"""
)
def retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests, a log with failures, retries, methods nobody planned and attempts that broke later, and media: a response for every request."""
    plan = _routed(spark, sf_dir)
    k, url, method = F.col("k") + 1, F.col("clean_url"), F.col("method")
    said = F.when(method.isin(*SCRAPERS), F.concat(F.lit("<h1>"), method, F.lit("</h1><p>"), url, F.lit('</p><img src="/pic.png">'))).otherwise(F.concat(F.lit("card of "), method, F.lit(" for "), url))
    good = (F.length(url) + k) % 3 == 0
    day = lambda d: F.make_timestamp(F.lit(2024), F.lit(1), F.lit(d), F.lit(0), F.lit(0), F.lit(0))
    take = lambda d, name, content, message: F.struct(day(d).alias("ts"), name.alias("method"), content.cast("string").alias("content"), F.when(message.isNotNull(), "Runtime").alias("error_class"), message.cast("string").alias("error_message"), (F.col("k") + 0.5).cast("double").alias("elapsed"))
    none = F.lit(None)
    takes = F.array(take(1, method, F.when(~good, said), F.when(good, "early")), take(2, method, F.when(good, said), F.when(~good & (k % 2 == 0), F.concat(F.lit("E"), k.cast("string")))), take(3, F.lit("other"), F.lit("not planned"), none.cast("string")))
    log = plan.select("clean_url", F.posexplode("steps").alias("k", "method")).select("clean_url", F.explode(takes).alias("t")).select(F.col("clean_url").alias("url"), "t.*")
    medium = lambda at, kind: F.struct(at.alias("url"), F.lit(kind).alias("kind"), F.sha2(at, 256).alias("media_id"), F.lit(640).alias("width"), F.lit(480).alias("height"))
    mine = F.regexp_extract("clean_url", r"u=(\d+)$", 1).cast("long") % 2 == 0
    blobs = plan.select(F.explode(F.filter(F.array(medium(F.concat(U.url_root(url), F.lit("/pic.png")), "image"), F.when(mine, medium(url, "image")), F.when(mine, medium(url, "video"))), lambda m: m.isNotNull())).alias("m")).select("m.*")
    blobs = blobs.withColumn("media_id", F.when(F.col("url").endswith("/pic.png"), F.sha2(U.url_root(F.col("url")), 256)).otherwise(F.col("media_id"))).distinct()
    got = answer(requests(spark, sf_dir), log, policies.load_domain_policy(spark), blobs)
    line = F.array_join(F.array_sort(F.transform(F.map_entries("errors"), lambda e: F.concat_ws(": ", e["key"], e["value"]["message"]))), "; ")
    return got.select("pos", "url", "method", "retrieval_time", "successful", line.alias("errors"), "text", F.size("items").alias("n_items"))
