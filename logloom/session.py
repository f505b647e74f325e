"""Spark session settings logloom relies on."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession

# Settings every logloom job needs: UTC wall time (all log stamps are UTC)
# and adaptive execution, so shuffle sizes and join strategies are chosen
# from runtime statistics instead of guesses.
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, app: str = "logloom") -> SparkSession:
    """Local session for tests and the bench; clusters pass their own session."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("LOGLOOM_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # checkpoint files of rank_within are removed once unreferenced
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for k, v in REQUIRED_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings logloom needs to an existing session."""
    for k, v in REQUIRED_CONF.items():
        spark.conf.set(k, v)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint folder.

    On a cluster the folder named in ``spark.checkpoint.dir`` is shared
    storage and is used as is; without one this is an error, since other
    machines do not see a folder of the driver's own. Only a local master
    (tests, the bench) gets a fresh scratch folder.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect: the server's spark.checkpoint.dir applies
        sc = None
    current = (sc.getCheckpointDir() if sc else None) or spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        if sc is None or not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        current = tempfile.mkdtemp(prefix="logloom-ckpt-")
    if sc and not sc.getCheckpointDir():
        sc.setCheckpointDir(current)
    return current


def write_and_read(spark: SparkSession, df, name: str = "table"):
    """Write ``df`` as a parquet table in the session's checkpoint folder and
    return it read back: several later queries then share one computation
    (and read only the columns they need) instead of recomputing it."""
    import uuid

    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/logloom-tables/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.parquet(path)
