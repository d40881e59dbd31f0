"""Queries on rows that only larger tables have: addresses of several pages, large ids, many pages a task."""

from __future__ import annotations

import datetime
import tempfile

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_queries import rows

from lakeweave import queries, queries_batch, queries_content, queries_live, queries_media, queries_varied  # noqa: F401
from lakeweave.functions import dom
from lakeweave.functions.slices import MOST, in_slices
from lakeweave.operators import html as H
from lakeweave.operators import media as J
from lakeweave.operators import nodes as N
from lakeweave.queries_content import _ran, in_parts
from lakeweave.streaming import streams as S


def check(spark, folder, name, **tables):
    """The query's rows equal its SQL's over the DataFrames."""
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for table, df in tables.items():
        path = f"{folder}/{table}.parquet"
        df.write.parquet(path)
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}/*.parquet')")
    got, want = queries.QUERIES[name](spark, str(folder)).toPandas(), con.execute(queries.SQL[name]).df()
    assert len(got) > 0 and rows(got) == rows(want)


def test_pages_with_one_url(spark, tmp_path):
    """Captures of one time: the order of rows doesn't decide."""
    pages = [(i, f"https://e.example.org/{i % 3}", f"<p>{(i * 7) % 10}</p>") for i in range(30)]
    check(spark, tmp_path, "captured_pages", pages=spark.createDataFrame(pages, "page_id long, url string, html string"))


@pytest.mark.parametrize("name", ["image_containers", "image_dims"])
def test_sides_of_more_than_16_bits(spark, tmp_path, name):
    events = [(i, 5) for i in range(20)] + [(20 + i, user) for i, user in enumerate([65_535, 65_536, 90_000, 131_072, 700_001] * 6)]
    check(spark, tmp_path, name, events=spark.createDataFrame(events, "event_id long, user_id long"))


def test_slices_hold_few_pages():
    """A batch of many pages is worked on in parts, whatever its size; each row comes once, in order."""
    texts = [None if i % 7 == 0 else "x" * (i % 5 * 3000) for i in range(4000)] + ["y" * (2 * MOST), "", None]
    parts = list(in_slices(pa.array(range(len(texts))), pa.array(texts)))
    assert [x for _, p in parts for x in p.to_pylist()] == texts and [x for n, _ in parts for x in n.to_pylist()] == list(range(len(texts)))
    assert all(sum(len(x or "") for x in p.to_pylist()[1:]) <= MOST for _, p in parts)
    nodes = pa.array([["n"] * 500, None, []] * 1000)
    assert max(len(p) for (p,) in in_slices(nodes)) * 500 / 3 * 64 < 2 * MOST
    assert list(in_slices(pa.array([], pa.string()))) == []


@pytest.mark.parametrize("make", [H._markdown, N.node_text, N.node_html, N.node_markdown, H._features])
def test_pages_of_a_batch_are_taken_in_parts(make):
    """No more than some of a batch's pages are trees at a time: their results come before further pages are read."""
    page = "<html><body>" + "<p>a<b>c</b></p>" * 300 + "</body></html>"
    flats = N.node_array([N.flat(dom.parse(page))[0]] * 200)
    batch = flats if make in (N.node_text, N.node_html, N.node_markdown) else pa.array([page] * 200)
    parts = [len(x) for x in make.func(iter([batch]))]
    assert sum(parts) == 200 and max(parts) <= 150


def test_media_are_not_broadcast(spark):
    """However few media the planner expects, none of a task's memory goes by the number of all."""
    elements = spark.createDataFrame([(i // 3, i, "image", f"u{i % 5}", "download") for i in range(30)], "page_id long, ordinal int, kind string, uri string, origin string")
    blobs = spark.createDataFrame([(f"u{i}", f"m{i}", "image", 300, 100 + 100 * i) for i in range(4)], "url string, media_id string, kind string, width int, height int")
    out = J.attach_media(elements, blobs)
    assert [r.media_id for r in out.orderBy("ordinal").collect()] == [f"m{i % 5}" if i % 5 in (2, 3) else None for i in range(30)]
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in plan and "Broadcast" not in plan and "SortMergeJoin" in plan


def test_parts_of_a_stream_are_whole_batches(spark):
    """A part is one batch of several files, with as many rows of each; the closing rows are two more."""
    rows = spark.range(0, 100_000, 1, 7).withColumn("k", F.col("id") % 2)
    stream = in_parts(spark, rows.drop("k"), F.col("id") % 2, spark.range(-1, 0, 1, 1))
    seen = []

    def note(batch, n):
        seen.append((batch.select(F.input_file_name()).distinct().count(), batch.where("id >= 0").count(), [r[0] for r in batch.select(F.pmod("id", F.lit(2))).distinct().collect()]))

    stream.writeStream.option("checkpointLocation", tempfile.mkdtemp()).trigger(availableNow=True).foreachBatch(note).start().awaitTermination()
    assert [s[1:] for s in seen if s[0]] == [(50_000, [0]), (50_000, [1]), (0, [1]), (0, [1])] and {s[0] for s in seen if s[0]} == {4}


def test_quiet_begins_anew_with_each_snapshot(spark, tmp_path):
    """A timer that runs out before the quiet ends answers nothing; the page's state isn't lost by it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", queries_live.ROCKSDB)
    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    steps = [(9, 10_000, 1), (1, 10_100, 1000), (2, 12_000, 1), (1, 13_000, 9000), (2, 14_500, 1), (2, 15_000, 1), (1, 15_500, 100), (3, 90_000, 1), (3, 180_000, 1), (3, 270_000, 1)]
    batches = [[(page, at(s), size, True)] for page, s, size in steps]
    for b in batches:
        spark.createDataFrame(b, "page_id long, snap_ts timestamp, size long, ready boolean").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    feed = spark.readStream.schema("page_id long, snap_ts timestamp, size long, ready boolean").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    try:
        got = _ran(S.stream_settled_snapshots(feed, "1 hour")).where("page_id = 1").collect()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert [(r.size, r.settled) for r in got] == [(100, False)]
