"""Schedules within budgets, live fan-out, state with timers, and a sink that repeats no batch."""

from __future__ import annotations

import collections
import datetime
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from lakeweave.plans.schedule import budgeted_schedule
from lakeweave.streaming import streams as S

EPOCH = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)


def at(seconds):
    return (EPOCH + datetime.timedelta(seconds=seconds)).replace(tzinfo=None)


@pytest.mark.parametrize("per_task", [3, 20_000])
def test_schedule_is_the_earliest_within_budget(spark, per_task):
    """Against a queue that is served one after another."""
    r = random.Random(per_task)
    steps = [(f"u{i}", m, at(r.choice([0, 0, r.randrange(400), 50]))) for i, m in enumerate(r.choices(["A", "B", "free", None], k=400))] + [("x", "A", None)]
    df = spark.createDataFrame([(u, m, t.timestamp() if t else None, "kept") for u, m, t in [(u, m, t and t.replace(tzinfo=datetime.timezone.utc)) for u, m, t in steps]], "url string, method string, s double, other string").withColumn("ready", F.timestamp_seconds("s")).drop("s")
    got = budgeted_schedule(df, {"A": (3, 10), "B": (7, 60)}, per_task).select("url", "method", "other", F.unix_seconds("ready").alias("ready"), F.unix_seconds("start").alias("start")).collect()
    assert len(got) == len(steps) and all(g.other == "kept" for g in got)
    for method, (n, w) in {"A": (3, 10), "B": (7, 60)}.items():
        mine = [g for g in got if g.method == method and g.ready is not None]
        assert all(g.start >= g.ready for g in mine)
        used, want = collections.Counter(), collections.Counter()
        for g in sorted(mine, key=lambda g: g.ready // w):
            slot = g.ready // w
            while used[slot] >= n:
                slot += 1
            used[slot] += 1
            want[slot] += 1
        assert collections.Counter(g.start // w for g in mine) == want and max(want.values()) <= n
    assert all(g.start == g.ready for g in got if g.method in ("free", None) or g.ready is None)


def run(stream, path, mode="append"):
    stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{path}/state").option("path", f"{path}/rows").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")


def feed(spark, path, name, schema, *batches):
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/{name}")
    return spark.readStream.schema(spark.read.parquet(f"{path}/{name}").schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/{name}")


def test_requests_without_a_response_come_out(spark, tmp_path):
    asked = [[(1, "a", at(0)), (2, "a", at(10)), (3, "b", at(0)), (4, "c", at(0))], [(9, "z", at(90_000))], [(9, "z", at(180_000))]]
    told = [[("a", at(60), "ok"), ("c", at(7_000), "late"), ("d", at(1), "nobody")], [("z", at(90_001), "y")], [("z", at(180_000), "y")]]
    requests = feed(spark, tmp_path, "asked", "pos long, url string, ts timestamp", *asked)
    responses = feed(spark, tmp_path, "told", "url string, answered_at timestamp, content string", *told)
    got = run(S.stream_fan_out(requests, responses, "1 hour"), tmp_path / "out").where("pos < 9").collect()
    assert sorted((r.pos, r.url, r.content) for r in got) == [(1, "a", "ok"), (2, "a", "ok"), (3, "b", None), (4, "c", None)]


def test_a_repeated_batch_writes_nothing_twice(spark, tmp_path):
    stream = feed(spark, tmp_path, "in", "k long", [(1,), (2,)], [(3,)])
    calls = []

    def make(batch):
        calls.append(1)
        return batch.withColumn("twice", F.col("k") * 2)

    for _ in range(2):  # the second run has lost its checkpoint, so that all batches come again
        S.document_sink(stream, str(tmp_path / "docs"), tempfile.mkdtemp(dir=tmp_path), make).awaitTermination()
    assert len(calls) == 2
    assert sorted((r.k, r.twice) for r in spark.read.parquet(str(tmp_path / "docs")).collect()) == [(1, 2), (2, 4), (3, 6)]


def test_settled_snapshots_live(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = "page_id long, snap_ts timestamp, size long, ready boolean"
    shots = {1: [1000, 1100, 1200, 9000], 2: [1000, 9000, 100, 5000], 3: [5000, 5010], 4: [10]}
    rows = [(p, at(60 * i), s, True) for p, sizes in shots.items() for i, s in enumerate(sizes)]
    known = spark.createDataFrame([(3, at(-60), 5000, True), (5, at(-60), 1, True)], schema)
    batches = [[r for r in rows if r[1] == at(60 * k)] for k in range(4)] + [[(9, at(90_000), 1, True)], [(9, at(99_000), 1, True)], [(9, at(180_000), 1, True)]]
    path = tmp_path / "live"
    stream = lambda some: S.stream_settled_snapshots(feed(spark, tmp_path, "shots", schema, *some), "1 hour", known)
    try:
        run(stream(batches[:2]), path)
        got = run(stream(batches[2:]), path).where("page_id < 9").collect()  # goes on from its checkpoint
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert sorted((r.page_id, r.size, r.settled) for r in got) == [(1, 1200, True), (2, 5000, False), (3, 5010, True), (4, 10, False)]
