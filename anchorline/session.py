"""Session settings used by the bench and the tests, and staging of shared intermediate tables.

On a cluster the caller's own session is used unchanged."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Scratch folders of local sessions, removed when Python ends.
_SCRATCH: dict[str, str] = {}


def _remove(path: str) -> None:
    shutil.rmtree(path.removeprefix("file:"), ignore_errors=True)


def local_session(app: str = "anchorline", cpus: int | None = None, memory: str = "12g") -> SparkSession:
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the session names in spark.checkpoint.dir.

    Where it is unset, a session on one machine (tests, local bench) gets a folder of its own beside its warehouse; on a cluster that would be a
    folder other machines do not see, so it is refused."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _SCRATCH:
        _SCRATCH[app] = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_staging-{app}-{os.getpid()}"
        atexit.register(_remove, _SCRATCH[app])
    return _SCRATCH[app]


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write a table that several later steps read, and read it back.

    It cuts the lineage at the points where the protocol has a stored table anyway (events, folds, forecasts), survives the loss of
    executors, and keeps column pruning, filters and size statistics, which a row-level checkpoint would not."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/anchorline/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Tasks that list folders. Spark's default gives every folder a task of its own, which costs far more than listing it.
LISTERS = 64


def listed(spark: SparkSession, read: Callable[[], DataFrame]) -> DataFrame:
    """A table of files under very many folders, which are listed when it is made: by LISTERS tasks at most. The session's own setting is put back."""
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    own = spark.conf.get(name)
    spark.conf.set(name, str(min(LISTERS, int(own))))
    try:
        return read()
    finally:
        spark.conf.set(name, own)
