"""Shared plumbing: shared folder, ordered buckets, Arrow helpers, byte-level words."""

from __future__ import annotations

import contextlib
import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_BUCKETS = 4096
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode a new one."""
    if root := spark.conf.get("spark.checkpoint.dir", None):
        return root.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    root = "file://" + tempfile.mkdtemp(prefix="tidewatch-")
    spark.sparkContext.setCheckpointDir(root)
    return root


def shared_dir(spark: SparkSession, name: str) -> str:
    """A path of its own under the shared folder; nothing is created yet."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The Arrow filesystem and the path in it for a URI or a plain absolute path."""
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), os.path.abspath(uri)
    return pafs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:", "file://", 1))


def materialize(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write to the shared folder and read again: cuts lineage and survives lost executors.

    With `by`, the last column of `df`, a folder for each of its few values, which `drop_kinds` can remove.
    Tables that `df` names as those it `reads`, and that nobody else does, are removed then.
    """
    spark = df.sparkSession
    path = shared_dir(spark, name)
    held = spark.conf.get(CLEAN, "false")
    spark.conf.set(CLEAN, "true")  # else the shuffle files of finished queries stay until the driver collects garbage
    try:
        if by:
            with conf(spark, "spark.sql.maxConcurrentOutputFileWriters", "16"):  # else rows are sorted by `by` first
                # small row groups, as each task holds one for each value
                writer = df.write.option("parquet.block.size", 8 << 20).option("parquet.enable.dictionary", "false").option("compression", "zstd")
                writer.partitionBy(by).parquet(path)
        else:
            df.write.parquet(path)
    finally:
        spark.conf.set(CLEAN, held)
    out = spark.read.schema(df.schema).parquet(path)
    out.held_at = path
    discard(*getattr(df, "reads", ()))
    return out


@contextlib.contextmanager
def conf(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    held = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if held is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, held)


def drop_kinds(df: DataFrame, by: str, *kinds: int) -> None:
    """Removes the rows with these values of a table that `materialize` wrote `by` them; nothing may read them any more."""
    spark = df.sparkSession
    for kind in kinds:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{df.held_at}/{by}={kind}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def discard(*tables: DataFrame) -> None:
    """Removes tables that `materialize` made, once nothing reads them any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.held_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: What long-lived worker processes remember; emptied at the end of each task.
CACHES: list = []


def remembered(cache):
    CACHES.append(cache)
    return cache


def give_back() -> None:
    """Empties the caches of this process and returns free memory to the system."""
    for cache in CACHES:
        cache.clear()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def light(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The function for mapInArrow that also gives back, when a task ends, the memory it took.

    Worker processes live on from task to task and from query to query.
    """

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def binary_values(column: pa.Array) -> Iterator[np.ndarray]:
    """The bytes of each value without a copy; null as empty."""
    column = column.cast(pa.binary())
    ends = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, 4 * column.offset)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    for i, j in zip(ends.tolist(), ends[1:].tolist()):
        yield data[i:j]


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def arrow_map(
    df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str
) -> DataFrame:
    """mapInArrow with a function from batch to batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := fn(batch)) is not None and out.num_rows:
                yield out

    return df.mapInArrow(light(run), schema)


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of every value, null as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def text_strings(column: pa.Array) -> list[str]:
    """Every value, null as empty."""
    return ["" if x is None else x for x in column.to_pylist()]


def words_of(raw: bytes) -> list[bytes]:
    """Lower-cases A-Z and splits on the six ASCII white-space characters, as `[^\\x20\\x09-\\x0D]+` does."""
    return raw.lower().split()


def bucket_bounds(df: DataFrame, key: str, buckets: int) -> list[float]:
    """Ascending inner bounds that deal the rows of `key` out about evenly; at most MAX_BUCKETS - 1."""
    buckets = max(1, min(buckets, MAX_BUCKETS))
    if buckets == 1:
        return []
    shares = ", ".join(repr(i / buckets) for i in range(1, buckets))
    got = df.select(
        F.expr(f"percentile_approx(cast(`{key}` as double), array({shares}), 20000)").alias("b")
    ).first()["b"]
    return sorted({float(x) for x in got or ()})


def with_bucket(df: DataFrame, key: str, bounds: list[float], name: str) -> DataFrame:
    """Adds the long column `name`: the number of bounds not above `key` (0 for null keys).

    Ascending keys have ascending buckets, and equal keys share one.
    """
    from pyspark.ml.feature import Bucketizer

    plain = F.coalesce(F.col(key).cast("double"), F.lit(float("-inf")))
    if not bounds:
        return df.withColumn(name, F.lit(0).cast("long"))
    splits = [float("-inf"), *bounds, float("inf")]
    part = Bucketizer(splits=splits, inputCol="__key", outputCol="__bucket")
    return (
        part.transform(df.withColumn("__key", plain))
        .withColumn(name, F.col("__bucket").cast("long"))
        .drop("__key", "__bucket")
    )


def by_bucket(df: DataFrame, name: str, buckets: int) -> DataFrame:
    """One partition for each bucket."""
    return df.repartitionById(max(1, buckets), F.col(name).cast("int"))
