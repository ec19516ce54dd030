"""Names and paths that helpers may take without touching the caller's."""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

#: Folders for the contexts whose sessions name none.
_OWN: WeakKeyDictionary = WeakKeyDictionary()


def free_name(df: DataFrame, name: str, *others: str) -> str:
    """A column name that neither df nor `others` have, whatever the case: name with underscores added as needed."""
    taken = {c.lower() for c in (*df.columns, *others)}
    while name.lower() in taken:
        name += "_"
    return name


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share.

    Where the session names none, a temporary one is made and kept for its context, but only if everything runs in this one
    machine's JVM (master local): on a cluster a folder of the driver's own is of no use to the executors, so that is an error. The
    session's settings stay as they are.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        if spark.sparkContext not in _OWN:
            _OWN[spark.sparkContext] = "file://" + tempfile.mkdtemp(prefix="sampleloom-")
        at = _OWN[spark.sparkContext]
    return at.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver's JVM ends if nobody does it before."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def remove_path(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def move_path(spark: SparkSession, source: str, target: str) -> None:
    """Gives a folder its final name, in one step where the file system can."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(source)
    if not at.getFileSystem(conf).rename(at, jvm.org.apache.hadoop.fs.Path(target)):
        raise OSError(f"{source} can't be moved to {target}")
