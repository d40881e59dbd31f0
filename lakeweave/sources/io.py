"""Tables in and out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeweave.functions.urls import let

REQUESTS = "pos long, url string, methods array<string>, format string, include_media boolean, max_video_size long, prioritize string"
ATTEMPTS = "url string, step int, method string, ts timestamp, status int, content string, error_class string, error_message string, elapsed double"
CAPTURES = "url string, method string, fetched_at timestamp, status int, html string"
BLOBS = "url string, content_type string, content_length long, content binary"
#: The same with the time of the fetch, which tells the latest of several.
FETCHED_BLOBS = BLOBS + ", fetched_at timestamp"
ENVELOPE = "status string, status_code int, message string, results array<struct<content: string, status_code: int, url: string>>"


def spread(df: DataFrame) -> DataFrame:
    """A table as read from files, dealt to as many partitions as there are cores where it has fewer: few splits mean little data, and work on each row would leave cores idle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def read_url_list(spark: SparkSession, path: str, ordered: bool = False) -> DataFrame:
    """One URL a line, blank lines dropped; with ``ordered``, pos follows the lines of each file."""
    lines = spark.read.text(path).select(F.regexp_replace("value", r"(?U)^\s+|\s+$", "").alias("url"))
    lines = lines.withColumn("pos", F.monotonically_increasing_id()) if ordered else lines
    return lines.where("url <> ''")


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CAPTURES).parquet(path)


def read_media_blobs(spark: SparkSession, path: str, files: bool = False, fetched: bool = False) -> DataFrame:
    """Media bytes with URL and type: a Parquet table (with ``fetched`` one that has fetched_at), or a folder of files whose path stands for the URL. ``operators.media.media_catalogue`` makes of them what documents refer to."""
    if not files:
        return spark.read.schema(FETCHED_BLOBS if fetched else BLOBS).parquet(path)
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("url"), F.lit(None).cast("string").alias("content_type"), F.col("length").alias("content_length"), "content")


def write_documents(docs: DataFrame, path: str, date_col: str = "crawl_date", files_a_date: int = 0) -> None:
    """Write by crawl date. With ``files_a_date``, rows are dealt so that each date gets about that many files, whatever a host's share."""
    if files_a_date:
        docs = docs.withColumn("__part", F.pmod(F.xxhash64(*[c for c in ("page_id", "url") if c in docs.columns]), F.lit(files_a_date))).repartition(date_col, "__part").drop("__part")
    docs.write.partitionBy(date_col).parquet(path)


def parse_scrape_envelope(df: DataFrame, json_col: str) -> DataFrame:
    """Add html and error (struct of cls, message) from a scraping API's JSON reply; exactly one of the two is set."""
    reply = df.withColumn("__reply", let(F.from_json(F.col(json_col), ENVELOPE), _unwrapped))
    return reply.withColumn("error", F.col("__reply.error")).withColumn("html", F.col("__reply.html")).drop("__reply")


def _unwrapped(r: Column) -> Column:
    first = F.try_element_at(r["results"], F.lit(1))
    error = lambda cls, message: F.struct(F.lit(cls).alias("cls"), message.alias("message"))
    code = lambda x: F.coalesce(x.cast("string"), F.lit("unknown"))
    failed = (
        F.when(r["status"] == "failed", error("Runtime", F.concat_ws(": ", code(r["status_code"]), r["message"])))
        .when(first.isNull(), error("RetrievalFailed", F.lit("no results")))
        .when(first["status_code"] >= 400, error("RetrievalFailed", F.concat(F.lit("target returned "), code(first["status_code"]))))
        .when(F.coalesce(first["content"], F.lit("")) == "", error("RetrievalFailed", F.lit("empty content")))
    )
    return F.struct(failed.alias("error"), F.when(failed.isNull(), first["content"]).alias("html"))
