"""Tables that jobs write between their steps, in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_made: dict[str, list[str]] = {}


def scratch_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``. Where that is unset, a local session (tests) sets one of its own; a cluster has to name it."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-lakeweave-")
        context.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/lakeweave-{uuid.uuid4().hex}"
    _made.setdefault(context.applicationId, []).append(path)
    return path


def clear_scratch(spark: SparkSession) -> int:
    """Delete this application's scratch folders, once its results are written elsewhere; their number."""
    paths = _made.pop(spark.sparkContext.applicationId, [])
    for p in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return len(paths)


def written(df: DataFrame, name: str = "table", compression: str | None = None) -> DataFrame:
    """``df`` written as Parquet to the scratch folder and read again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}"
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def counted(df: DataFrame, name: str = "table") -> tuple[DataFrame, int]:
    """``written``, and the number of rows, counted by the job that writes them."""
    seen = Observation()
    out = written(df.observe(seen, F.count(F.lit(1)).alias("n")), name)
    return out, seen.get["n"]
