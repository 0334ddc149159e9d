"""Session settings that the library's own entry points use; a given session is never changed."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "metaloom", cpus: str | None = None, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks. On a cluster, pass the cluster's session instead."""
    cpus = cpus or os.environ.get("BENCH_CPUS", "8")
    b = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    settings = {
        "spark.sql.shuffle.partitions": cpus,
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables; only Spark opens the path, so any store that Spark reads will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors reach: spark.checkpoint.dir, or, on a local master alone, a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file://{tempfile.gettempdir()}/metaloom-index"
    return folder.rstrip("/")


def kept(df: DataFrame) -> DataFrame:
    """``df`` checkpointed, so that its lineage ends and it outlives lost executors.

    The folder is that of spark.checkpoint.dir, or one set on the context before; on a local master alone, else, a temporary one.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="metaloom-"))
    return df.checkpoint()


def unsent(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that sorts and merges, so that it is never gathered by the driver to be sent to all.

    Spark takes the size of a checkpointed table from the files that it came from; of exploded or few columns that is far too small.
    """
    return df.hint("merge")
