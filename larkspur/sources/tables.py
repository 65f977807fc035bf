"""Test-table access and intermediate tables that survive lost executors."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of a scale-factor directory (any store Spark can read)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` where set, else a local one.

    Only a session without that setting (tests, local mode) gets a folder of its own,
    which is then also made the session's checkpoint folder.
    """
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not found:
        found = tempfile.mkdtemp(prefix="larkspur-")
        context.setCheckpointDir(found)
    return found


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder; what is written there goes when the driver's interpreter ends."""
    path = f"{shared_dir(spark)}/larkspur-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """What is written meanwhile leaves no shuffle files behind; they would stay until the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and return the written table.

    This cuts lineage without relying on executor-local blocks; parquet keeps it
    compressed and prunable. See :func:`scratch` for how long it stays.
    """
    path = scratch(df.sparkSession)
    with shuffles_freed(df.sparkSession):
        df.write.parquet(path, compression="zstd")
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`materialise` that nothing reads any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _remove(df.sparkSession, path)


def still_there(df: DataFrame) -> bool:
    """Whether the files that ``df`` was read from are all where they were."""
    context = df.sparkSession.sparkContext
    paths = (context._jvm.org.apache.hadoop.fs.Path(f) for f in df.inputFiles())
    return all(p.getFileSystem(context._jsc.hadoopConfiguration()).exists(p) for p in paths)


def version(df: DataFrame) -> tuple[int, int]:
    """What the files of a table read from a store are now: a digest of their paths, sizes and times of change.

    Only their metadata is read. A file that is replaced, added or taken away gives another version.
    """
    file = F.xxhash64("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").alias("file")
    found = df.select(file).distinct().agg(F.count(F.lit(1)), F.bit_xor("file")).first()
    return found[0], found[1] or 0


def _remove(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    if context._jsc is None or context._jsc.sc().isStopped():
        return
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)
