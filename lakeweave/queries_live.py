"""Registered queries of schedules within budgets, image containers and the live operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeweave.functions import media as M
from lakeweave.operators import html as H
from lakeweave.plans.schedule import budgeted_schedule as schedule
from lakeweave.queries import query, table
from lakeweave.queries_content import _MARKDOWN, _ran, _settled_sql, in_parts
from lakeweave.scratch import scratch_dir, written
from lakeweave.streaming import streams as S


@query("""WITH s AS (SELECT event_type AS method, floor(epoch(ts))::BIGINT // 3600 AS slot, event_id, CASE event_type WHEN 'view' THEN 3 ELSE 2 END AS n FROM events WHERE event_type IN ('view', 'click')),
    k AS (SELECT *, row_number() OVER (PARTITION BY method ORDER BY slot, event_id) - 1 AS k FROM s),
    t AS (SELECT method, n, k // n + max(slot - k // n) OVER (PARTITION BY method, k % n ORDER BY k) AS start_hour FROM k)
    SELECT method, start_hour, count(*) AS steps, count(*) > any_value(n) AS over_budget FROM t GROUP BY 1, 2
    UNION ALL SELECT event_type, floor(epoch(ts))::BIGINT // 3600, count(*), false FROM events WHERE event_type NOT IN ('view', 'click') GROUP BY 1, 2""")
def budgeted_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three steps an hour of one method, two of another, no bounds for the rest: how many start in each hour."""
    steps = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("url"), F.col("event_type").alias("method"), F.col("ts").cast("timestamp").alias("ready"))
    placed = schedule(steps, {"view": (3, 3600), "click": (2, 3600)})
    most = F.when(F.col("method") == "view", 3).when(F.col("method") == "click", 2)
    hours = placed.groupBy("method", F.floor(F.unix_seconds("start") / 3600).alias("start_hour")).agg(F.count(F.lit(1)).alias("steps"))
    return hours.withColumn("over_budget", F.coalesce(F.col("steps") > most, F.lit(False)))


@query("""SELECT event_id, CASE event_id % 5 WHEN 4 THEN NULL WHEN 3 THEN 'avif' WHEN 2 THEN 'bmp' ELSE 'tiff' END AS format, CASE WHEN event_id % 5 < 4 THEN event_id % 60000 END AS width, CASE WHEN event_id % 5 < 4 THEN user_id END AS height FROM events""")
def image_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directories of either byte order, bitmap headers, boxes, and boxes of another format. A height of more than 16 bits is a long number in a directory, and takes the newer bitmap header."""
    e, w, h = F.col("event_id"), F.col("event_id") % 60000, F.col("user_id")
    big = lambda c, n: F.lpad(F.hex(c.cast("long")), 2 * n, "0")

    def little(c, n):
        hexed = big(c, n)
        return F.concat(*(F.substring(hexed, 2 * i - 1, 2) for i in range(n, 0, -1)))

    short = h < 65536
    motorola = F.concat(F.lit("4D4D002A00000008" + "0002" + "0100000400000001"), big(w, 4), F.when(short, F.concat(F.lit("0101000300000001"), big(h, 2), F.lit("0000"))).otherwise(F.concat(F.lit("0101000400000001"), big(h, 4))))
    intel = F.concat(F.lit("49492A0008000000" + "0200" + "0001040001000000"), little(w, 4), F.when(short, F.concat(F.lit("0101030001000000"), little(h, 2), F.lit("0000"))).otherwise(F.concat(F.lit("0101040001000000"), little(h, 4))))
    bitmap = F.concat(F.lit("424D" + "00" * 12), F.when(short, F.concat(F.lit("0C000000"), little(w, 2), little(h, 2))).otherwise(F.concat(F.lit("28000000"), little(w, 4), little(h, 4))), F.lit("01001800"))
    boxes = lambda brand: F.concat(F.lit("00000010667479706" + brand + "00000000" + "00000030" + "6D657461" + "00000000" + "00000024" + "69707270" + "0000001C" + "6970636F" + "00000014" + "69737065" + "00000000"), big(w, 4), big(h, 4))
    content = F.unhex(F.when(e % 5 == 0, motorola).when(e % 5 == 1, intel).when(e % 5 == 2, bitmap).when(e % 5 == 3, boxes("1766966")).otherwise(boxes("8656963")))
    return table(spark, sf_dir, "events").select("event_id", M.image_dims(content).alias("d")).select("event_id", "d.*")


def _week(ts="ts"):
    return F.floor(F.unix_seconds(ts) / (8 * 86400))


@query("""SELECT a.event_id AS pos, 'https://example.org/' || a.user_id AS url, b.event_id AS answer FROM events a LEFT JOIN events b ON b.user_id = a.user_id AND b.event_type = 'purchase' AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 1 DAY WHERE a.event_type = 'view'""")
def stream_fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every view with the purchases of its user in the day after it, those without any too."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("url", F.concat(F.lit("https://example.org/"), F.col("user_id").cast("string")))
    far = spark.range(0, 1, 1, 1).select(F.lit(-1).cast("long").alias("id"), F.lit("none").alias("url"), F.timestamp_seconds(F.lit(4_000_000_000)).alias("ts"))
    requests = in_parts(spark, e.where("event_type = 'view'").select(F.col("event_id").alias("pos"), "url", "ts"), _week(), far.withColumnRenamed("id", "pos"))
    responses = in_parts(spark, e.where("event_type = 'purchase'").select("url", F.col("ts").alias("answered_at"), F.col("event_id").alias("answer")), _week("answered_at"), far.select("url", F.col("ts").alias("answered_at"), F.col("id").alias("answer")))
    return _ran(S.stream_fan_out(requests, responses, "1 day")).where("pos >= 0").select("pos", "url", "answer")


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@query(_settled_sql("ready AND before"))
def stream_settled_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As settled_snapshot, live: the first tenth of the log is the state that pages begin with."""
    e = F.col("event_id")
    shots = table(spark, sf_dir, "events").select(F.col("user_id").alias("page_id"), F.timestamp_seconds(e).alias("snap_ts"), F.round(F.col("value") * 100).cast("long").alias("size"), (e % 5 > 0).alias("ready"))
    nth = F.row_number().over(Window.partitionBy("page_id").orderBy("snap_ts"))
    shots = written(shots.withColumn("nth", nth), "shots")
    far = spark.range(0, 1, 1, 1).select(F.lit(-1).cast("long").alias("page_id"), F.timestamp_seconds(F.lit(4_000_000_000)).alias("snap_ts"), F.lit(0).cast("long").alias("size"), F.lit(False).alias("ready"))
    top = table(spark, sf_dir, "events").agg(F.max("event_id")).first()[0] or 0
    feed = in_parts(spark, shots.where("nth > 2").drop("nth"), F.floor(F.unix_seconds("snap_ts") / (top // 4 + 1)), far)
    had = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    try:
        got = _ran(S.stream_settled_snapshots(feed, "3650 days", shots.where("nth <= 2").drop("nth")))
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", had)
    return got.where("page_id >= 0").select("page_id", F.unix_seconds("snap_ts").alias("snap_ts"), "size", "settled")


@query(f"SELECT page_id, url, {_MARKDOWN} AS text FROM pages")
def document_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as a stream of three batches, a file a core each, into documents, run twice: the second time all batches come again and write nothing."""
    path, cores = scratch_dir(spark), spark.sparkContext.defaultParallelism
    pages = table(spark, sf_dir, "pages")
    pages.repartition(3 * cores).write.parquet(f"{path}/pages")
    for k in range(2):
        feed = spark.readStream.schema(pages.schema).option("maxFilesPerTrigger", cores).parquet(f"{path}/pages")
        S.document_sink(feed, f"{path}/documents", f"{path}/state{k}", lambda batch: H.to_documents(batch, include_media=False)).awaitTermination()
    return spark.read.parquet(f"{path}/documents").select("page_id", "url", "text")
