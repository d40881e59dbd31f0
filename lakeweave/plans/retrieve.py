"""The whole way of a batch: requests, a log of what was fetched for them, and media in; one response for each request out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeweave.operators.html import ITEMS, reference, to_documents
from lakeweave.plans.attempts import first_success
from lakeweave.plans.requests import dedupe_requests, direct_media_shortcut, fan_out_results, route_methods, validate_plan
from lakeweave.scratch import written
from lakeweave.sources.policy import DEFAULT_METHODS

#: Methods that give HTML; all others give text.
SCRAPERS = [m for m in DEFAULT_METHODS if m != "integrations"]
ERRORS = "map<string,struct<cls:string,message:string>>"


def retrieve(requests: DataFrame, log: DataFrame, policy: DataFrame, blobs: DataFrame | None = None) -> DataFrame:
    """pos, url, clean_url, method, step, retrieval_time, successful, errors, text and items of every request, repeated ones too.

    ``requests`` (url, pos, methods, format, include_media and others) are made unique, routed by
    the policy and checked; what can't be carried out has the reason as its only error, under 'plan'. An
    address of a medium is answered by that medium, if ``blobs`` (as of ``media_catalogue``) have it. Else the
    first planned method counts for which ``log`` (cleaned url, method, ts, content, error_class,
    error_message, elapsed) holds content in its last attempt; methods before it leave their errors, and one that is
    not in the log has returned no content. HTML of scrapers becomes a document with media, without where
    the request wants none, or stays as it is for format 'html'; other methods' content is text.

    Plans and attempts are narrow rows; content moves once to its winner, after the choice.
    """
    plan = validate_plan(route_methods(dedupe_requests(requests), policy))
    plan = direct_media_shortcut(plan, blobs)
    direct = F.coalesce("direct_ok", F.lit(False)) if blobs is not None else F.lit(False)
    plan = written(plan.select("url", "clean_url", "status", "steps", "format", F.coalesce("include_media", F.lit(True)).alias("include_media"), "direct_kind", (direct & (F.col("status") == "ok")).alias("direct")), "plan")

    last = F.max_by(F.struct("ts", "error_class", "error_message", "elapsed", F.col("content").isNotNull().alias("ok")), "ts").alias("a")
    tried = log.groupBy(F.col("url").alias("clean_url"), "method").agg(last)
    steps = plan.where("status = 'ok' and not direct").select("url", "clean_url", F.posexplode("steps").alias("step", "method"))
    marked = steps.join(tried, ["clean_url", "method"], "left").select("url", "clean_url", "step", "method", "a.ts", "a.error_class", "a.error_message", "a.elapsed", F.when(F.col("a.ok"), "").alias("content"))
    marked = written(marked, "attempts")
    chosen = first_success(marked, with_content=False)

    won = chosen.where("successful").join(marked.select("url", "clean_url", "step", "ts"), ["url", "step"]).join(plan.select("url", "format", "include_media"), "url")
    wanted = won.select(F.col("url").alias("page_id"), F.col("clean_url").alias("url"), "method", "ts", "format", "include_media")
    found = written(wanted.join(log.where("content is not null").select("url", "method", "ts", F.col("content").alias("html")), ["url", "method", "ts"]).dropDuplicates(["page_id"]), "content")
    html = F.col("method").isin(*SCRAPERS)
    pages = found.where(html & (F.coalesce("format", F.lit("")) != "html"))
    texts = to_documents(pages.where("include_media"), blobs).unionByName(to_documents(pages.where("not include_media"), include_media=False))
    plain = found.where(~html | (F.coalesce("format", F.lit("")) == "html")).select("page_id", "url", F.col("html").alias("text"), F.array().cast(ITEMS).alias("items"))
    texts = texts.unionByName(plain).select(F.col("page_id").alias("url"), "text", "items")

    none = F.array().cast(ITEMS)
    tried_all = plan.where("status = 'ok' and not direct").select("url", "clean_url").join(chosen, "url", "left").join(texts, "url", "left")
    no_errors = F.create_map().cast(ERRORS)
    tried_all = tried_all.select("url", "clean_url", "method", "step", "retrieval_time", F.coalesce("successful", F.lit(False)).alias("successful"), F.coalesce(F.col("errors").cast(ERRORS), no_errors).alias("errors"), "text", F.coalesce("items", none).alias("items"))
    nothing = {"method": F.lit(None).cast("string"), "step": F.lit(None).cast("int"), "retrieval_time": F.lit(None).cast("double")}
    refused = plan.where("status <> 'ok'").select("url", "clean_url", *(c.alias(n) for n, c in nothing.items()), F.lit(False).alias("successful"), F.create_map(F.lit("plan"), F.struct(F.lit("ValueError").alias("cls"), F.col("status").alias("message"))).cast(ERRORS).alias("errors"), F.lit(None).cast("string").alias("text"), none.alias("items"))
    out = tried_all.unionByName(refused)
    if blobs is not None:
        media = blobs.groupBy(F.col("url").alias("clean_url"), F.col("kind").alias("direct_kind")).agg(F.max("media_id").alias("media_id"))
        token = reference(F.col("direct_kind"), F.col("media_id"))
        direct_ones = plan.where("direct").join(media, ["clean_url", "direct_kind"])
        item = F.array(F.struct(F.lit(0).alias("ordinal"), token.alias("token"))).cast(ITEMS)
        out = out.unionByName(direct_ones.select("url", "clean_url", F.lit("Direct download").alias("method"), nothing["step"].alias("step"), nothing["retrieval_time"].alias("retrieval_time"), F.lit(True).alias("successful"), no_errors.alias("errors"), token.alias("text"), item.alias("items")))
    return fan_out_results(requests, out)
