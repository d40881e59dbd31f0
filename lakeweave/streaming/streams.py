"""The crawl feed as streams: unique requests, method statistics, first successes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

RESPONSE = "url string, method string, step int, content string, errors string, successful boolean"
STATE = "errors string, done boolean"


def stream_dedupe_requests(requests: DataFrame, delay: str = "1 hour", time_col: str = "ts") -> DataFrame:
    """The first request of each URL; later ones within the delay are dropped."""
    return requests.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(["url"])


def stream_method_stats(attempts: DataFrame, budgets: dict[str, int] | None = None, window: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Count and average time by method and window, and whether a method's budget for a window was overrun."""
    out = attempts.withWatermark("ts", delay).groupBy(F.window("ts", window).alias("w"), "method").agg(F.count(F.lit(1)).alias("n"), F.avg("elapsed").alias("avg_time"))
    limit = F.lit(None).cast("long")
    for method, n in (budgets or {}).items():
        limit = F.when(F.col("method") == method, n).otherwise(limit)
    return out.select(F.col("w.start").alias("window_start"), "method", "n", "avg_time", F.coalesce(F.col("n") > limit, F.lit(False)).alias("over_budget"))


def stream_first_success(attempts: DataFrame, last_step: int, timeout: str = "1 hour") -> DataFrame:
    """Emit each URL's response at its first attempt with content, at its last step, or when no more comes in event time.

    The state of a URL is its errors so far, and after its response a mark that it is done, so
    that further attempts are dropped however the stream is cut into batches. The mark goes when
    no more comes in event time; attempts after that begin anew.
    """
    wait_ms = int(pd.Timedelta(timeout).total_seconds() * 1000)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        errors, done = state.get if state.exists else ("", False)
        answer = None
        if state.hasTimedOut:
            state.remove()
            if not done:
                yield pd.DataFrame([(key[0], None, None, None, errors, False)], columns=["url", "method", "step", "content", "errors", "successful"])
            return
        rows, newest = [], 0
        for pdf in batches:
            newest = max(newest, int(pdf["ts"].max().timestamp() * 1000))
            if not done:
                rows += zip(pdf["step"], pdf["method"], pdf["content"], pdf["error_message"], strict=True)
        for at, method, content, message in sorted(rows, key=lambda r: r[0]):
            if content is not None and content == content:
                answer, done = (key[0], method, at, content, errors, True), True
                break
            errors = "; ".join(filter(None, [errors, f"{method}: {message or f'Method {method} returned no content.'}"]))
            if at >= last_step:
                answer, done = (key[0], None, None, None, errors, False), True
                break
        state.update(("" if done else errors, done))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), newest) + wait_ms)
        if answer:
            yield pd.DataFrame([answer], columns=["url", "method", "step", "content", "errors", "successful"])

    return attempts.withWatermark("ts", timeout).groupBy("url").applyInPandasWithState(step, RESPONSE, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def stream_fan_out(requests: DataFrame, responses: DataFrame, wait: str = "1 hour") -> DataFrame:
    """Every request (url, ts, and others) with each response to its URL (url, answered_at, and others) that comes within ``wait`` after it, or with nulls once no more can come.

    Both sides have watermarks of ``wait``, so that the state of either is dropped in time.
    """
    asked = requests.withWatermark("ts", wait)
    told = responses.withColumnRenamed("url", "__url").withWatermark("answered_at", wait)
    near = (F.col("url") == F.col("__url")) & (F.col("answered_at") >= F.col("ts")) & (F.col("answered_at") <= F.col("ts") + F.expr(f"INTERVAL {wait}"))
    return asked.join(told, near, "leftOuter").drop("__url")


def document_sink(stream: DataFrame, path: str, checkpoint: str, make: Callable[[DataFrame], DataFrame], trigger: dict | None = None) -> StreamingQuery:
    """Write ``make`` of every batch of a stream (such as ``to_documents`` of captures) below ``path``, a folder ``batch_id=n`` each.

    A batch that comes again after a failure finds its folder complete and writes nothing, or
    writes it whole in place of what a failed attempt left.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        folder = f"{path}/batch_id={batch_id}"
        if not _complete(batch.sparkSession, folder):
            make(batch).write.mode("overwrite").parquet(folder)

    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).foreachBatch(write).start()


def _complete(spark: SparkSession, folder: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


SHOT = "snap_ts: timestamp, size: long, ready: boolean"
SETTLED = "page_id long, snap_ts timestamp, size long, settled boolean"


class _Settling(StatefulProcessor):
    """State of a page in one value, read and written once a call: its last snapshots (three at most), a mark once it has been answered, and when its quiet ends.

    A timer stays as it is when more snapshots come; one that runs out before the quiet ends is set anew.
    """

    def __init__(self, quiet_ms: int) -> None:
        self.quiet_ms = quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.page = handle.getValueState("page", f"done boolean, until long, last array<struct<{SHOT}>>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        done, until, last = self.page.get() or (False, None, [])
        if done:
            return
        seen = [tuple(x) for x in last]
        new = [r for pdf in rows for r in zip((t.to_pydatetime() for t in pdf["snap_ts"]), pdf["size"], pdf["ready"], strict=True)]
        for at, size, ready in sorted(new, key=lambda r: r[0]):
            seen.append((at, int(size), bool(ready)))
            if len(seen) >= 3 and _stable(seen[-3], seen[-2]) and _stable(seen[-2], seen[-1]):
                self._wait(True, until, [], timerValues)
                yield self._row(key, seen[-1], True)
                return
        self._wait(False, until, seen[-3:], timerValues)

    def _wait(self, done: bool, until: int | None, last: list[tuple], timers: object) -> None:
        end = timers.getCurrentWatermarkInMs() + self.quiet_ms
        if until is None:
            self.handle.registerTimer(end)
        self.page.update((done, end, last))

    def _row(self, key: tuple, shot: tuple, settled: bool) -> pd.DataFrame:
        return pd.DataFrame([(int(key[0]), shot[0], shot[1], settled)], columns=["page_id", "snap_ts", "size", "settled"])

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        """No more came: the last snapshot is the answer, unless there was one; the state goes."""
        done, until, last = self.page.get() or (True, None, [])
        if until is not None and until > timerValues.getCurrentWatermarkInMs():
            self.handle.registerTimer(until)
            return
        self.page.clear()
        if not done and last:
            yield self._row(key, tuple(last[-1]), False)

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues: object) -> None:
        self.page.update((False, None, [(r.snap_ts.to_pydatetime(), int(r.size), bool(r.ready)) for r in initialState.sort_values("snap_ts", kind="stable").tail(3).itertuples(index=False)]))

    def close(self) -> None:
        pass


def _stable(before: tuple, after: tuple) -> bool:
    return before[2] and after[2] and abs(after[1] - before[1]) <= max(256, before[1] // 100)


def stream_settled_snapshots(snapshots: DataFrame, quiet: str = "1 hour", known: DataFrame | None = None) -> DataFrame:
    """``operators.pages.settled_snapshot`` live: each page's first snapshot (page_id, snap_ts, size, ready) after two stable steps in a row, as soon as it comes, or its last one, with settled false, when ``quiet`` has passed without more.

    Snapshots of a page have to come in order. ``known``, a table of earlier snapshots, is the
    state that pages begin with. Needs the RocksDB state store.
    """
    rows = snapshots.withWatermark("snap_ts", quiet).groupBy("page_id")
    first = known.groupBy("page_id") if known is not None else None
    quiet_ms = int(pd.Timedelta(quiet).total_seconds() * 1000)
    return rows.transformWithStateInPandas(_Settling(quiet_ms), SETTLED, "append", "EventTime", initialState=first)
