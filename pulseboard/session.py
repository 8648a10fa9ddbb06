"""Session helpers: one place for the settings the jobs rely on."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings every job assumes: ANSI stays on (Spark 4 default), dates are
# compared in UTC, AQE re-plans joins and shuffle sizes from runtime stats.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # Wide tab projections generate one big method per stage; HotSpot does not
    # JIT methods over 8000 bytes, so such stages would run interpreted.
    # Above this size Spark splits the stage instead (measured: 3x faster).
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "pulseboard", driver_memory: str | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings of ``BASE_CONF``.

    On a cluster leave ``master`` unset and let the launcher decide.
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    for k, v in BASE_CONF.items():
        b = b.config(k, v)
    if driver_memory:
        b = b.config("spark.driver.memory", driver_memory)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@contextmanager
def wide_writes(spark: SparkSession):
    """Within it, jobs that work out whole wide tabs split their generated methods, in any session: unsplit they run
    interpreted. A setting of the caller's own stays."""
    key = "spark.sql.codegen.hugeMethodLimit"
    old = spark.conf.get(key, None)
    try:
        if old in (None, "65535"):  # Spark's default
            spark.conf.set(key, BASE_CONF[key])
        yield
    finally:
        spark.conf.unset(key) if old is None else spark.conf.set(key, old)


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and written tables.

    Reads ``spark.checkpoint.dir`` from the session. Where it is unset, a local
    master (one machine, as in tests) gets a folder of its own; any other
    master raises, since executors cannot share a machine-local folder.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if d:
        return d
    d = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="pulseboard-ckpt-")
    sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


def new_output_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder for one written table."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
