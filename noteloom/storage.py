"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a folder of this machine in local mode and an error on a cluster, whose machines share none."""
    context = spark.sparkContext
    held = context._jsc.sc().getCheckpointDir()
    found = spark.conf.get("spark.checkpoint.dir", None) or (held.get() if held.isDefined() else None)
    if not found:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="noteloom-shared-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
    if not held.isDefined():
        context.setCheckpointDir(found)
    return found


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives the executors' Python workers this package, once for each application; local sessions have it."""
    context = spark.sparkContext
    if context.applicationId in _shipped or (context.master.startswith("local") and not context.master.startswith("local-cluster")):
        return
    root = Path(__file__).resolve().parent
    held = Path(tempfile.mkdtemp(prefix="noteloom-core-")) / "noteloom_core.zip"
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as archive:
        for path in sorted(root.rglob("*.py")):
            archive.write(path, path.relative_to(root.parent))
    context.addPyFile(str(held))
    _shipped.add(context.applicationId)


def release(spark: SparkSession) -> None:
    """Lets the context's cleaner see which shuffles and broadcasts no plan needs any more, so that executors' disks follow the step at hand."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def cut(df: DataFrame, name: str) -> DataFrame:
    """df written as a table of its own to the shared folder and read back, so that lost executors cost nothing."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/noteloom-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
