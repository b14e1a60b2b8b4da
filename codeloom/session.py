"""Session helpers: one place for the Spark configuration the library assumes."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def get_spark(master: str | None = None, app: str = "codeloom", shuffle_partitions: int | None = None) -> SparkSession:
    """Build (or reuse) a session with AQE and skew-join handling switched on.

    Only what is unset is set: the master, shuffle partitions and memory that
    spark-submit or an existing session brings stay.  Without a master the
    session is local with one thread a core.
    """
    from pyspark import SparkConf

    cpus = os.environ.get("BENCH_CPUS") or str(os.cpu_count() or 8)
    given = SparkConf()  # what spark-submit has set
    active = SparkSession.getActiveSession()
    local = active is None and not given.contains("spark.master") and not os.environ.get("SPARK_MASTER")
    options = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    }
    if local:
        options |= {"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": os.environ.get("CODELOOM_DRIVER_MEMORY", "16g")}
    builder = SparkSession.builder.appName(app)
    if master or local:
        builder = builder.master(master or f"local[{cpus}]")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        options.pop("spark.sql.shuffle.partitions", None)
    for key, value in options.items():
        if not given.contains(key) and (active is None or active.conf.get(key, None) is None):
            builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint directory, setting one only when unset.

    The cluster names a shared folder in ``spark.checkpoint.dir``; we use it.
    Only a local-mode session without one (tests, laptops) gets a fresh
    temporary folder; a cluster session without it is a configuration error.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - Spark Connect sessions have no SparkContext
        sc = None
    if sc is None:
        conf_dir = spark.conf.get("spark.checkpoint.dir", None)
        if not conf_dir:
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        return conf_dir
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir() or conf_dir
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder before running iterative operators")
    local = tempfile.mkdtemp(prefix="codeloom-ckpt-")
    sc.setCheckpointDir(local)
    return sc.getCheckpointDir() or local


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one of the driver tables (``<sf_dir>/<name>.parquet``)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
