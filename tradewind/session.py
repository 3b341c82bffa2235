"""Session settings and the shared scratch folder."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Runtime SQL settings the plans rely on. Skewed join keys are split by adaptive execution even
# where the split costs one more shuffle, because one key may hold a third of the rows.
SQL_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else created."""
    for key, value in SQL_CONF.items():
        spark.conf.set(key, value)
    return spark


# For the queries over tables: tasks that stay small as the tables grow. After a shuffle a task takes about 16 MB, and a shuffle is
# dealt finely enough for that; adaptive execution puts small parts together again.
TASK_BYTES = "16m"
LEAST_PARTS = 400


def tune_tables(spark: SparkSession) -> SparkSession:
    """`tune`, and a bound on what one task holds, whatever number of shuffle partitions the session came with."""
    parts = max(LEAST_PARTS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", TASK_BYTES)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(parts))
    return tune(spark)


def local_session(cores: str = "8", app: str = "tradewind") -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cores if cores.isdigit() else "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("TRADEWIND_DRIVER_MEMORY", "8g"))
    )
    spark = tune(builder.getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. A local folder stands in only for a local master."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    return os.path.join(tempfile.gettempdir(), "tradewind-shared")


_made: list[tuple[SparkSession, str]] = []


def run_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared one; every run writes to its own. It is deleted when the driver's program ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def remove_run_paths() -> int:
    """Delete the folders that this program made under the shared one; returns how many there were. Results that were handed out
    lazily read from them, so this is for the end of a program."""
    removed = 0
    while _made:
        spark, path = _made.pop()
        if spark.sparkContext._jsc is None or spark.sparkContext._jsc.sc().isStopped():
            continue  # the session is gone, and its file systems with it
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        removed += at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return removed


atexit.register(remove_run_paths)


def file_states(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """Path, length and time of change of every file at `path`, as the table's own file system lists them."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    listing = at.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(at, True)
    out = []
    while listing.hasNext():
        f = listing.next()
        out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return sorted(out)
