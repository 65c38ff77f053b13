"""Intermediate tables in the folder that all executors share.

Every session has one folder of its own there, so clear() removes what it wrote in one step; loops that replace their
tables give the old ones back with release(), or write them inside passing().
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own_dirs: dict[str, str] = {}
_passing: ContextVar[list[tuple[SparkSession, str]] | None] = ContextVar("passing", default=None)


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset and all runs on this machine (tests), an own temporary folder."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="lexmill-")
        atexit.register(shutil.rmtree, _own_dirs[app], ignore_errors=True)
    return _own_dirs[app]


def _session_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/lexmill-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{_session_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def _shuffles_go(spark: SparkSession) -> Iterator[None]:
    """What is written inside leaves no shuffle files: nothing reads them again, and else they stay until the driver
    happens to collect its garbage."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def materialize(df: DataFrame, name: str, *partition_by: str, pack: bool = False) -> DataFrame:
    """Write to the shared folder and read again: cuts the lineage, and a lost executor loses none of it.

    pack is for narrow rows made in a scan of wide ones: they are put together in few files first, where each of the
    scan's many tasks would else leave a small one.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    schema = df.schema
    with _shuffles_go(spark):
        writer = (df.hint("rebalance") if pack else df).write.option("compression", "zstd")  # most of it is text, read once or twice
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    if (noted := _passing.get()) is not None:
        noted.append((spark, path))
    return spark.read.schema(schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def release(*tables: DataFrame) -> None:
    """Delete tables of materialize() that nothing reads any more."""
    for df in tables:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/lexmill-" in path:
                _delete(df.sparkSession, path)


@contextmanager
def passing() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes at its end what materialize() wrote inside it, but for the tables given to the function it hands out. All
    that still reads the others must be written by then."""
    token = _passing.set(noted := [])
    kept: set[str] = set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(noted[-1][1])
        return df

    try:
        yield keep
    finally:
        _passing.reset(token)
        for spark, path in noted:
            if path not in kept:
                _delete(spark, path)
        if (outer := _passing.get()) is not None:
            outer.extend((spark, path) for spark, path in noted if path in kept)


def clear(spark: SparkSession) -> None:
    """Delete all that this session has materialized; for when its results are written elsewhere."""
    _delete(spark, _session_dir(spark))
