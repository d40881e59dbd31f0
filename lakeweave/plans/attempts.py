"""From logged attempts to responses and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

NO_METHOD = "N/A"


def first_success(attempts: DataFrame, with_content: bool = True) -> DataFrame:
    """Collapse the attempts of each URL: content, method, step, elapsed of the first with content; errors of the steps before it.

    An empty string counts as content. Without any success all errors stay and content and
    method are null. An attempt without content or error is a RetrievalFailed. If a method
    failed twice its later error stays. One shuffle on url carries no content: the winners'
    content is joined afterwards, unless ``with_content`` is false.
    """
    message = F.coalesce("error_message", F.concat(F.lit("Method "), F.col("method"), F.lit(" returned no content.")))
    error = F.struct(F.coalesce("error_class", F.lit("RetrievalFailed")).alias("cls"), message.alias("message"))
    rows = attempts.select("url", "step", "method", "elapsed", F.col("content").isNotNull().alias("ok"), F.when(F.col("content").isNull(), error).alias("error"))
    win = F.min_by(F.when(F.col("ok"), F.struct("step", "method", "elapsed")), F.when(F.col("ok"), F.col("step")))
    grouped = rows.groupBy("url").agg(win.alias("win"), F.collect_list(F.when(~F.col("ok"), F.struct("step", "method", "error"))).alias("failed"))
    before = F.filter(F.array_sort("failed"), lambda f: F.col("win.step").isNull() | (f["step"] < F.col("win.step")))
    last = lambda a: F.filter(a, lambda f, i: ~F.exists(F.slice(a, i + 2, F.size(a)), lambda g: g["method"] == f["method"]))
    out = grouped.select("url", "win", before.alias("before")).select("url", "win", last(F.col("before")).alias("before"))
    errors = F.map_from_entries(F.transform("before", lambda f: F.struct(f["method"], f["error"])))
    out = out.select("url", F.col("win.method").alias("method"), F.col("win.step").alias("step"), F.col("win.elapsed").alias("retrieval_time"), F.col("win").isNotNull().alias("successful"), errors.alias("errors"))
    if not with_content:
        return out
    content = attempts.where("content is not null").select("url", "step", "content")
    return out.join(content, ["url", "step"], "left")


def retry_plan(attempt_log: DataFrame, max_retries: int) -> DataFrame:
    """Number the attempts of each URL and method by time; add outcome (ok, retry, exhausted, terminal), wait_s and next_ts."""
    n = F.row_number().over(Window.partitionBy("url", "method").orderBy("ts")) - 1
    log = attempt_log.withColumn("attempt", n)
    again = F.col("status").isin(429, 613, 502) | (F.coalesce("error_class", F.lit("")) == "ConnectionError")
    outcome = F.when(F.col("status") == 200, "ok").when(again, F.when(F.col("attempt") >= max_retries, "exhausted").otherwise("retry")).otherwise("terminal")
    wait = F.when(F.col("outcome") == "retry", F.pow(F.lit(2.0), F.col("attempt")))
    log = log.withColumn("outcome", outcome).withColumn("wait_s", wait)
    return log.withColumn("next_ts", F.col("ts") + F.make_dt_interval(secs=F.col("wait_s").cast("decimal(18,6)")))


def crawl_summary(responses: DataFrame) -> DataFrame:
    """One row: total, successful, and average and longest retrieval_time."""
    return responses.agg(F.count(F.lit(1)).alias("total"), F.count_if("successful").alias("successful"), F.avg("retrieval_time").alias("avg_time"), F.max("retrieval_time").alias("max_time"))


def method_summary(responses: DataFrame) -> DataFrame:
    """Average time and count by method, in order of method."""
    by = F.coalesce("method", F.lit(NO_METHOD)).alias("method")
    return responses.groupBy(by).agg(F.avg("retrieval_time").alias("avg_time"), F.count(F.lit(1)).alias("n")).orderBy("method")


def slowest_urls(responses: DataFrame, k: int | None = None) -> DataFrame:
    """URLs by time, longest first, with OK or FAIL and the errors in a line; the k longest only, if k is given."""
    line = F.array_join(F.transform(F.map_entries("errors"), lambda e: F.concat_ws(": ", e["key"], e["value"]["message"])), "; ")
    out = responses.select("url", "method", F.when(F.col("successful"), "OK").otherwise("FAIL").alias("status"), "retrieval_time", line.alias("errors")).orderBy(F.desc_nulls_last("retrieval_time"), "url")
    return out if k is None else out.limit(k)


def expect_media(responses: DataFrame, expectations: DataFrame) -> DataFrame:
    """Expectations (url, kind, min_count) that a response's items (array of structs with kind) don't meet, with what was found."""
    found = responses.select("url", F.explode("items.kind").alias("kind")).groupBy("url", "kind").agg(F.count(F.lit(1)).alias("found"))
    joined = expectations.join(found, ["url", "kind"], "left").withColumn("found", F.coalesce("found", F.lit(0)))
    return joined.where("found < min_count")
