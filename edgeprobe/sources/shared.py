"""Frames that are used more than once, written to the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ConfigError


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only a local session without one gets a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ConfigError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="edgeprobe-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def materialised(df: DataFrame, what: str = "frame", paths: list[str] | None = None) -> DataFrame:
    """The frame written as Parquet and read again: its lineage is cut, and each later use scans only the columns it needs.

    ``paths`` gets its path, for :func:`removed`; without it the files go when the program ends, as results may be read from them until then.
    """
    path = f"{shared_dir(df.sparkSession)}/edgeprobe/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    (_left.setdefault(id(df.sparkSession), (df.sparkSession, []))[1] if paths is None else paths).append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fingerprint(df: DataFrame) -> str:
    """What tells a frame's content from another's, whatever the order of its rows: their number and sums of their hashes, by one aggregation."""
    hashes = [F.xxhash64(*df.columns), F.xxhash64(F.lit(1), *df.columns)]
    r = df.agg(F.count("*"), *[F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0)) for h in hashes]).first()
    return "|".join(map(str, r))


_left: dict[int, tuple[SparkSession, list[str]]] = {}


@atexit.register
def _at_end() -> None:
    for spark, paths in _left.values():
        with contextlib.suppress(Exception):  # the session's JVM may be gone, and its folder with it
            removed(spark, paths)


def removed(spark: SparkSession, paths: list[str]) -> None:
    """Delete written frames that nothing reads any more, through Spark's own file system."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    paths.clear()
