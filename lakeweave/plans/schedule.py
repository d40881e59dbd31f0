"""When each planned step may start, so that no method's budget for a stretch of time is overrun."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeweave.scratch import counted

#: Steps of a method that may start in so many seconds.
BUDGETS = {"YouTube": (333, 3600), "TikTok": (5, 1)}


def budgeted_schedule(steps: DataFrame, budgets: dict[str, tuple[int, int]] | None = None, per_task: int = 20_000) -> DataFrame:
    """``steps`` (url, method, ready, and others) with ``start``: the earliest time at which each may start.

    A method with a budget of n steps in w seconds starts at most n in each stretch of w seconds
    since the epoch; steps wait in the order of the stretches in which they are ready (in any order
    within one). Steps of other methods start when they are ready. A null ready or method never waits.

    The k-th step of a method waits for the one n places before it only, so its stretch is the
    largest of (own stretch) and (those of the steps n, 2n, ... places before it, plus 1, 2, ...): a
    running maximum in each of n residues. Places are gapless ranks that are put together from the
    counts of small groups, so that neither a hot method nor one stretch in which all is ready
    goes to one task.
    """
    budgets = BUDGETS if budgets is None else budgets
    n, w = F.lit(None).cast("long"), F.lit(None).cast("long")
    for method, (most, seconds) in budgets.items():
        n, w = F.when(F.col("method") == method, most).otherwise(n), F.when(F.col("method") == method, seconds).otherwise(w)
    rows, total = counted(steps.withColumns({"__n": n.cast("long"), "__w": w.cast("long")}).withColumn("__slot", F.floor(F.unix_seconds("ready") / F.col("__w"))), "steps")
    at = ["method", "__slot", "__salt"]
    limited = rows.where("__slot is not null").withColumn("__salt", F.pmod(F.xxhash64("url"), F.lit(max(1, math.ceil(total / per_task)))).cast("int"))
    before = F.sum("__count").over(Window.partitionBy("method").orderBy("__slot", "__salt").rowsBetween(Window.unboundedPreceding, -1))
    first = limited.groupBy(*at).agg(F.count(F.lit(1)).alias("__count")).withColumn("__first", F.coalesce(before, F.lit(0))).drop("__count")
    own = F.row_number().over(Window.partitionBy(*at).orderBy("ready", "url")) - 1
    placed = limited.withColumn("__own", own).join(first, at).withColumn("__rank", F.col("__first") + F.col("__own"))
    turn = F.floor(F.col("__rank") / F.col("__n"))
    queue = Window.partitionBy("method", F.col("__rank") % F.col("__n")).orderBy("__rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    slot = turn + F.max(F.col("__slot") - turn).over(queue)
    waited = placed.withColumn("start", F.greatest(F.col("ready"), F.timestamp_seconds(slot * F.col("__w"))))
    return waited.select(*steps.columns, "start").unionByName(rows.where("__slot is null").select(*steps.columns, F.col("ready").alias("start")))
