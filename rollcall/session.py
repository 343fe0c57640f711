"""Session helpers: a local session for tests/bench and the shared scratch folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings a cluster job wants regardless of size. Shuffle width is left to AQE
# (coalesce small partitions, split skewed ones) rather than a fixed count.
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int | None = None,
                  app: str = "rollcall", extra: dict | None = None) -> SparkSession:
    """A local-mode session for tests and the bench (never used on a cluster)."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    conf = dict(BASE_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions or (8 if cores == "*" else int(cores)))
    conf["spark.driver.memory"] = os.environ.get("ROLLCALL_DRIVER_MEMORY", "8g")
    # One listing task per partition folder is right for a cluster; locally it is
    # thousands of tiny tasks, so group folders into a few tasks per core.
    n = os.cpu_count() if cores == "*" else int(cores)
    conf["spark.sql.sources.parallelPartitionDiscovery.parallelism"] = str(4 * (n or 8))
    # file:// paths only (local runs): skip Hadoop's .crc sidecar per file, which
    # doubles the create/rename work of every Parquet file and partition folder.
    conf["spark.hadoop.fs.file.impl"] = "org.apache.hadoop.fs.RawLocalFileSystem"
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark



def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, taken from ``spark.checkpoint.dir``.

    Only a local session without one (tests) gets a private folder, registered as the
    checkpoint dir so that later calls agree on it and removed when Python ends; on a
    cluster, where each machine would have its own, a missing setting is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 -- Spark Connect sessions expose no context
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share") from None
    current = sc.getCheckpointDir()
    if current:
        return current.rstrip("/")
    # spark.checkpoint.dir cannot be changed on a running session; registering the
    # folder on the context is enough for later calls (and for checkpoint()).
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    own = tempfile.mkdtemp(prefix="rollcall-ckpt-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    sc.setCheckpointDir(own)
    return sc.getCheckpointDir().rstrip("/")


_SCRATCH: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder under the shared dir for one run's tables."""
    path = f"{shared_dir(spark)}/rollcall/{name}-{uuid.uuid4().hex[:12]}"
    _SCRATCH.append(path)
    return path


def drop_scratch(spark: SparkSession) -> int:
    """Delete the scratch folders this process made, once results that read them are
    written elsewhere; returns how many were there."""
    jvm, conf, gone = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), 0
    while _SCRATCH:
        path = jvm.org.apache.hadoop.fs.Path(_SCRATCH.pop())
        gone += bool(path.getFileSystem(conf).delete(path, True))
    return gone
