"""Folders that the driver and all executors see."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import SparkSession

_own: dict[str, str] = {}
_used: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application below spark.checkpoint.dir, removed when it ends.

    Driver and executors all see that folder on a cluster, where the setting
    must be there.  In local mode a temporary folder of this machine serves
    without it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = _own.setdefault(app, "file://" + tempfile.mkdtemp(prefix="arborel-"))
    path = f"{base.rstrip('/')}/arborel-{app}"
    if path not in _used:
        _used.add(path)
        atexit.register(remove, spark, path)
    return path


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store, if the session still lives."""
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the gateway may be gone at exit
        pass
