"""Spark session construction and the shared checkpoint folder.

On a cluster the session is built by the platform; ``get_spark`` only fills in
settings that are still unset, so cluster-provided values always win.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Defaults used when a setting is absent. Sized for local tests; on a cluster
# the submitter's spark-defaults take precedence (see ``get_spark``).
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, app: str = "consonance",
              shuffle_partitions: int | None = None) -> SparkSession:
    """Return the active session, or build a local one for tests and bench."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    from pyspark import SparkConf

    given = SparkConf()  # spark-submit / spark-defaults values, when present
    builder = SparkSession.builder.appName(app)
    if master and not given.contains("spark.master"):
        builder = builder.master(master)
    wanted = dict(_DEFAULTS)
    if shuffle_partitions:
        wanted["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    wanted["spark.driver.memory"] = os.environ.get("CONSONANCE_DRIVER_MEMORY", "4g")
    for k, v in wanted.items():
        if not given.contains(k):
            builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts, taken from ``spark.checkpoint.dir``.

    A cluster names a shared (distributed) folder there. Only when the setting
    is missing and driver and executors are one process (master ``local`` or
    ``local[...]``), a fresh scratch folder is created and set; elsewhere a
    missing setting is an error, since a machine's own folder would be
    invisible to the others.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir()
    if not d:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"spark.checkpoint.dir is not set; master {master} needs a folder that all executors share")
        d = tempfile.mkdtemp(prefix="consonance-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    spark.sparkContext.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the checkpoint folder for a written table."""
    import uuid

    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the executors' Python workers.

    Zips the package once per application and hands it to
    ``SparkContext.addPyFile``; Spark distributes the file to every executor
    and puts it on the workers' ``sys.path`` (what ``--py-files`` does). The
    zip is only the driver-side source of that distribution.
    """
    import zipfile

    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    out = os.path.join(tempfile.mkdtemp(prefix="consonance-pyfiles-"), "consonance.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for base, _dirs, names in os.walk(pkg_dir):
            for name in names:
                if name.endswith((".py", ".txt")):
                    full = os.path.join(base, name)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(out)
    _SHIPPED.add(app)
