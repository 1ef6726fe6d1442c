"""Scratch folders that the driver and all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import SparkSession

_OWN: dict[str, str] = {}
_MADE: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the session's ``spark.checkpoint.dir``. Only a ``local`` master may go
    without it (tests); a temporary folder of this machine is used there.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder shared by the cluster")
    return _OWN.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="spark-"))


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; what is written there goes when the driver's process ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _MADE.append((spark, path))
    return path


def delete(spark: SparkSession, path: str) -> None:
    """Remove a path through Hadoop's file system API."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _clean() -> None:
    """Remove all scratch paths; those of a session that has ended through pyarrow, if it knows the file system."""
    from pyarrow import fs

    for spark, path in _MADE:
        try:
            if spark.sparkContext._jsc is not None:
                delete(spark, path)
                continue
        except Exception:  # the session has ended
            pass
        try:
            system, place = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
            system.delete_dir(place)
        except Exception:  # not written, or out of reach: other paths are still tried
            pass


atexit.register(_clean)
