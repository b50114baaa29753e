"""Folders that the driver and all executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_MADE: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where it is unset a local master (as in tests) gets one of
    its own; on a cluster that is an error, as no machine sees another one's folders."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        base = spark.conf.get("spark.linkloom.scratch", None)
        if not base:
            if spark.sparkContext.master.split("[")[0] != "local":
                raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="linkloom-")
            spark.conf.set("spark.linkloom.scratch", base)
    return base.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own for what is written and read again; removed when the driver ends."""
    path = f"{shared_folder(spark)}/linkloom-{name}-{uuid.uuid4().hex[:12]}"
    _MADE.append((spark, path))
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written and read again: what is read several times is worked out once, and a lost executor loses nothing."""
    path = new_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _remove() -> None:
    for spark, path in _MADE:
        with contextlib.suppress(Exception):  # the session may have ended
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


atexit.register(_remove)
