"""Spark session defaults used by tests, the bench and the examples."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Session settings the library relies on.  ANSI mode stays on (Spark 4 default);
# every parser in ``functions`` therefore uses the try_* family.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "128m",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}
# Local runs (tests, bench) only: no web UI, no progress bars.
LOCAL_CONF = {"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "tablewright", driver_memory: str = "16g") -> SparkSession:
    """Build (or reuse) a session with the library's defaults.

    On a cluster pass ``master=None`` and let spark-submit decide; the
    shuffle partition count should then be sized to the data (roughly
    input bytes / 128 MB), which AQE coalesces downwards at run time.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
        builder = builder.config("spark.driver.memory", driver_memory)
        if master.startswith("local"):
            for k, v in LOCAL_CONF.items():
                builder = builder.config(k, v)
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    for k, v in DEFAULT_CONF.items():
        if k.startswith("spark.sql."):
            spark.conf.set(k, v)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and intermediate tables.

    Read from the session (the context's checkpoint dir, else
    ``spark.checkpoint.dir``).  Only a local-mode session without one -- tests,
    a laptop -- gets a private temp folder; on a cluster a machine-local folder
    would be wrong, so a missing setting is an error there.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect: no context; the server owns the setting
        d = spark.conf.get("spark.checkpoint.dir", None)
        if not d:
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        return d
    d = sc.getCheckpointDir()
    if d:
        return d
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir (a shared folder all executors can reach)")
        d = tempfile.mkdtemp(prefix="tablewright-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


def ship_by_value(module) -> None:
    """Pickle functions of ``module`` by value when they are sent to Python
    workers (pandas UDFs), so executors need numpy / pandas but not this
    package."""
    from pyspark import cloudpickle
    cloudpickle.register_pickle_by_value(module)
