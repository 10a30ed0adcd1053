"""The folder that driver and executors share, and what this application has put there."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

_made: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a folder below the warehouse, if that is shared: on a local master, or if its
    path names a file system. Else there is no folder that all executors see, and ValueError says so."""
    if given := spark.conf.get("spark.checkpoint.dir", None):
        return given
    warehouse, master = spark.conf.get("spark.sql.warehouse.dir"), spark.sparkContext.master
    scheme = warehouse.partition(":")[0] if ":" in warehouse else "file"
    if not (master == "local" or master.startswith("local[")) and scheme == "file":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{warehouse}/tamarack_checkpoints"


def new_path(spark: SparkSession, what: str) -> str:
    """A path in it that nothing uses yet."""
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def clear(spark: SparkSession, keep: tuple[str, ...] = ()) -> int:
    """Removes what this application has put into the shared folder, but the paths to keep; how many there were. For the end
    of a run: frames that are not written elsewhere yet read from there."""
    paths = _made.pop(spark.sparkContext.applicationId, [])
    gone = 0
    for path in paths:
        if path in keep:
            _made.setdefault(spark.sparkContext.applicationId, []).append(path)
            continue
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        gone += bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True))
    return gone
