"""Session helpers: a local session for tests/bench and the shared work folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every job of the engine relies on. Applied to a session we build;
# a cluster session keeps its own values.
SESSION_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "ordergate", memory: str = "8g") -> SparkSession:
    """Local session for tests and the bench. Never used on a cluster."""
    builder = (SparkSession.builder.master(f"local[{cores}]").appName(app)
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.driver.memory", memory))
    for key, value in SESSION_DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster the setting points at shared storage and is used as is; unset
    is an error there, since each executor would write to its own disk. Only a
    local master (tests) gets a private folder, once per application.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _LOCAL_DIRS.get(sc.applicationId)
        if base is None:
            base = _LOCAL_DIRS[sc.applicationId] = tempfile.mkdtemp(prefix="ordergate-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(os.path.join(base, "rdd"))
    return base.removeprefix("file:")


_LOCAL_DIRS: dict[str, str] = {}


def work_dir(spark: SparkSession, *parts: str) -> str:
    """A path below the shared checkpoint folder (published tables, staging)."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, "ordergate", *parts) if parts else os.path.join(base, "ordergate")
