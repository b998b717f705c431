"""Spark session helpers.

Cluster settings (shuffle partitions, checkpoint folder, memory) belong to the
cluster; these helpers only fill in what is unset, which is what tests and the
local bench need.
"""

from __future__ import annotations

import atexit
import os
import tempfile

from py4j.protocol import Py4JError
from pyspark.sql import SparkSession

# Settings every job of this package relies on. They are plan-level switches,
# not sizes, so they are safe to apply to any session.
PLAN_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "ctxrec") -> SparkSession:
    """Local session for tests and the bench (a cluster brings its own)."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in PLAN_SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster.

    Read from ``spark.checkpoint.dir``; only when a local session (a test run)
    has none, a folder of our own is set. On a cluster executors would not see
    such a folder, so there the setting is required.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        current = spark.sparkContext.getCheckpointDir()
    if not current:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        current = tempfile.mkdtemp(prefix="ctxrec-ckpt-")
        spark.sparkContext.setCheckpointDir(current)
        return current
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(current)
    return current


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path for a written intermediate table under the checkpoint folder."""
    base = checkpoint_dir(spark)
    return os.path.join(base, "tables", name)


_TEMPORARY: list[tuple[object, object]] = []


def remove_at_exit(spark: SparkSession, path: str) -> str:
    """Delete ``path`` when the application's Python ends: for intermediate
    tables that a lazily read result may need until then."""
    if not _TEMPORARY:
        atexit.register(_remove_temporary)
    jvm = spark.sparkContext._jvm
    _TEMPORARY.append((jvm.org.apache.hadoop.fs.Path(path), spark.sparkContext._jsc.hadoopConfiguration()))
    return path


def _remove_temporary() -> None:
    for path, conf in _TEMPORARY:
        try:
            path.getFileSystem(conf).delete(path, True)
        except Py4JError:  # the JVM ended first
            return


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``ctxrec`` importable in the Python workers of every executor.

    Operators that run pandas/numpy tasks (``mapInPandas``, cogroups,
    ``applyInPandasWithState``) refer to functions of this package, so the
    package is zipped once per application and added with ``addPyFile``
    (what ``--py-files`` does at submit time).
    """
    import zipfile

    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    out = os.path.join(tempfile.mkdtemp(prefix="ctxrec-pkg-"), "ctxrec.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, _, files in os.walk(pkg_dir):
            if "__pycache__" in dirpath:
                continue
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(out)
    _SHIPPED.add(app)
