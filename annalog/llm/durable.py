"""Tables written to the folder that driver and executors share.

``cut`` ends a lineage by writing a frame as Parquet and reading it back, so a
lost executor costs no more than re-running what comes after. The folder is the
one named by ``spark.checkpoint.dir``; only where that is unset and the driver's machine
is all there is (tests) does this module choose a temporary folder itself. On a cluster
without that setting it refuses: each executor would write to a disk of its own.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared scratch folder of this session."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="annalog-")
        context.setCheckpointDir(named)
    return named.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted by ``release`` or at exit."""
    path = f"{shared_dir(spark)}/annalog/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append((spark, path))
    return path


def cut(frame: DataFrame, name: str = "cut") -> DataFrame:
    """``frame`` as a written table: same rows, no lineage."""
    spark = frame.sparkSession
    path = new_path(spark, name)
    frame.write.parquet(path)
    written = spark.read.schema(frame.schema).parquet(path)
    written._cut_path = path
    return written


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    if jvm is not None:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def discard(written: DataFrame) -> None:
    """Delete the table behind a frame of ``cut`` that nothing will read again."""
    path = written._cut_path
    _WRITTEN.remove((written.sparkSession, path))
    _delete(written.sparkSession, path)


def release() -> None:
    """Delete every table written so far; frames that read them become invalid."""
    while _WRITTEN:
        _delete(*_WRITTEN.pop())


@atexit.register
def _at_exit() -> None:
    try:
        release()
    except Exception:  # the JVM may have gone first; the folder is scratch space
        _WRITTEN.clear()
