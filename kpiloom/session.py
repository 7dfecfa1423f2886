"""Spark session defaults used by tests, bench and examples.

On a cluster the session is created by the platform; ``configure`` only fills in
settings that are unset, so cluster-wide choices win. The time zone is the exception.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # map-side partial aggregation is what makes hot keys cheap; keep it on
    "spark.sql.aggregate.skipPartialAggregate": "false",
}

# Static settings: only take effect when the session is built.
_STATIC = {
    # per-call Python call-site capture for error messages costs several JVM round trips
    # per DataFrame/Column function; plans are built from many small expressions
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def configure(spark: SparkSession) -> SparkSession:
    """Fill in the settings that the operators rely on where they are unset. The time zone is always UTC, as
    another one would shift days; a session that does not allow that raises."""
    chosen = spark.conf.getAll
    for k, v in _DEFAULTS.items():
        if k == "spark.sql.session.timeZone" or k not in chosen:
            spark.conf.set(k, v)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's checkpoint dir; set a scratch one only when unset in local mode (tests).

    On a cluster a machine-local folder would be lost with its executor, so an unset
    ``spark.checkpoint.dir`` is an error there instead of a silent fallback."""
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is unset: name a shared folder for checkpoints and sinks")
        conf_dir = tempfile.mkdtemp(prefix="kpiloom-ckpt-")
    spark.sparkContext.setCheckpointDir(conf_dir)
    return conf_dir


def local_session(cores: int | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    cores = cores or int(os.environ.get("BENCH_CPUS", "8"))
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("kpiloom")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cores))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in {**_DEFAULTS, **_STATIC}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
