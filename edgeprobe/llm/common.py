"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the contracts list it: space and U+0009..U+000D.
SPACE = r"\x20\x09-\x0D"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read through Spark only, so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the one named by ``spark.checkpoint.dir``; only where that is unset in a
    local session, as in tests, a temporary one is chosen.  A cluster without it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        found = spark.sparkContext.getCheckpointDir()
        if found is None:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="edgeprobe-"))
            found = spark.sparkContext.getCheckpointDir()
        root = found
    elif spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def shared_path(spark: SparkSession, what: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/edgeprobe/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, for narrow frames that are read more than once.

    Its files belong to Spark's cleaner (``spark.cleaner.referenceTracking.cleanCheckpoints``).
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, what: str, paths: list[str] | None = None) -> DataFrame:
    """Write a frame as Parquet to the shared folder and read it again (wide frames, read more than once).

    ``paths`` gets its path, for :func:`discard`.
    """
    path = shared_path(df.sparkSession, what)
    df.write.parquet(path)
    if paths is not None:
        paths.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, path: str, buckets: int) -> DataFrame:
    """Append to a table in the shared folder with buckets by chunk, and read it: joined by chunk, it isn't shuffled."""
    df.write.format("parquet").mode("append").bucketBy(buckets, "chunk").option("path", path).option("compression", "zstd").saveAsTable(name)
    return df.sparkSession.table(name)


def by_chunk(chunks: DataFrame, answers: DataFrame, make, schema: str) -> DataFrame:
    """``make`` of each chunk and of the answers that it has got, as Arrow tables."""
    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(make, schema)


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Remove written frames that nothing reads any more, through Spark's own file system, wherever they lie."""
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    for path in paths:
        at = hadoop.Path(path)
        at.getFileSystem(conf).delete(at, True)
    paths.clear()


def freed(spark: SparkSession) -> None:
    """Have Spark's cleaner remove the shuffle files of jobs that nothing refers to any more: it learns that from the driver's garbage collector."""
    spark._jvm.System.gc()


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Meanwhile Spark removes the shuffle files of each frame that is written or checkpointed as that ends, and doesn't wait for
    the driver's garbage collector, which may find them long after."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def text_of(df: DataFrame, column: str = "text"):
    """The text column with null as empty."""
    return F.coalesce(df[column].cast("string"), F.lit(""))


def crc_bucket(column: str, modulus: int):
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


#: Rows and bytes of an Arrow batch, and of what is taken from it as Python objects at once.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def small_batches(spark: SparkSession) -> SparkSession:
    """The session, in which texts go to Python workers in batches of a few megabytes, unless it has been told otherwise."""
    for key, value in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        if spark.conf.get(f"spark.sql.execution.arrow.{key}", None) is None:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(value))
    return spark


def few_at_a_time(batches: Iterable[pa.RecordBatch], column: int, rows: int = 500, size: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``rows`` rows and, but for a longer text by itself, ``size`` bytes of a column."""
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < b.num_rows:
            before = ends[at - 1] if at else 0
            end = min(at + rows, max(at + 1, int(np.searchsorted(ends, before + size, "right"))), b.num_rows)
            yield b.slice(at, end - at)
            at = end
