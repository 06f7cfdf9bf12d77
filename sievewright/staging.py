"""Cutting lineage through tables written in the folder that all executors share.

``spark.checkpoint.dir`` names that folder on a cluster. Only where it is unset, as in
tests on one machine, a temporary folder of this machine takes its place.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder. Raises on a cluster that names none: a machine's own folder would not survive there."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is unset; it must name a folder that all executors share")
    at = "file://" + tempfile.mkdtemp(prefix="sievewright-")
    spark.conf.set("spark.checkpoint.dir", at)
    return at


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as parquet in the shared folder and return a frame that reads it back.

    The table outlives any executor; it is removed at the end of a :func:`scope`, by :func:`drop_written`, or when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sievewright/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scope() -> Iterator[None]:
    """Within it, results are used up: the tables written there are deleted at its end, and frames that read them end with it."""
    before = len(_written)
    try:
        yield
    finally:
        drop_written(before)


def drop_written(keep: int = 0) -> None:
    """Delete the tables written so far, but for the first ``keep``. Frames that read them must no longer be used."""
    while len(_written) > keep:
        spark, path = _written.pop()
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session may have ended before
            pass


atexit.register(drop_written)
