"""Session defaults. A cluster's own settings always win; these fill what is unset."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A session on this machine, for tests and the bench; never used on a cluster."""
    b = SparkSession.builder.master(f"local[{cores}]").appName("sievewright")
    for k, v in (DEFAULTS | {"spark.sql.shuffle.partitions": str(shuffle_partitions), "spark.driver.memory": memory} | conf).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def workers_find_package(spark: SparkSession) -> None:
    """Let the Python workers of a session import this package from where the driver has it.

    Needed where the driver was started with another working folder and no PYTHONPATH; a cluster that ships
    the package by itself (``--py-files``) is not disturbed.
    """
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if here not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, here])


def spread(df: DataFrame, *key: str) -> DataFrame:
    """``df`` for a map that costs much more than a shuffle: over all cores, by its key, where it comes in fewer parts than there are cores.

    A table of a few small files comes in as few parts; one that has parts enough stays as it is. The rows are the same either way.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    parts = df._jdf.queryExecution().toRdd().getNumPartitions()
    return df.repartition(cores, *key) if parts < cores else df
