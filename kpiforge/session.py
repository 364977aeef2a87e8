"""Session helpers.

The library never creates a session behind the caller's back; operators take
DataFrames.  ``get_session`` is for tests, the benchmark and scripts.
"""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import SparkSession


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "kpiforge", driver_memory: str | None = None) -> SparkSession:
    """Build (or return) a session configured the way the operators expect: UTC
    session time zone (period labels must not depend on the host zone), AQE on,
    Spark UI off.

    Master, shuffle partitions and memory are only set when given, so on a cluster
    what spark-submit says holds; tests and the benchmark pass their own.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if driver_memory:
        builder = builder.config("spark.driver.memory", driver_memory)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint directory the session names; for what writes there.

    The cluster's ``spark.checkpoint.dir`` (a shared folder) is always used
    when set.  Only a local-mode session without one (tests, the benchmark)
    gets a scratch folder; on a cluster a machine-local folder would be wrong,
    so we refuse instead of guessing.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - Spark Connect: the server owns the checkpoint dir
        return spark.conf.get("spark.checkpoint.dir", "")
    current = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not current:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):  # not local-cluster[...]
            raise RuntimeError("set spark.checkpoint.dir to a shared folder "
                               "(operators cut their lineage there)")
        current = tempfile.mkdtemp(prefix="kpiforge-ckpt-")
        spark.conf.set("spark.checkpoint.dir", current)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(current)
    return current
