"""Session helpers: shared storage, code shipping, table access and materialisation."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

#: Paths below shared folders that nothing has deleted yet, and local files of this process.
_LIVE: set[str] = set()
_OWN: set[str] = set()

PACKAGE_ROOT = Path(__file__).resolve().parent


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet table ``name`` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can read: ``spark.checkpoint.dir``.

    Only where the session has none and runs in one JVM (``local[...]``) is a
    folder of this machine set; a cluster without the setting is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="dossierflow-")
    _OWN.add(folder)
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def shared_path(spark: SparkSession, name: str) -> str:
    """New, unused path below the shared folder; what is there when the process ends is deleted."""
    path = f"{shared_dir(spark).rstrip('/')}/dossierflow/{name}-{uuid.uuid4().hex}"
    _LIVE.add(path)
    return path


@atexit.register
def _clean() -> None:
    """Delete tables that results were still read from, and local files, at the end of the process."""
    jvm = SparkContext._jvm
    for path in list(_LIVE):
        try:
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(target, True)
        except Exception:  # noqa: BLE001  the JVM or its file system is gone
            break
    for path in _OWN:
        shutil.rmtree(path, ignore_errors=True) if os.path.isdir(path) else Path(path).unlink(missing_ok=True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so that its lineage ends there.

    The files survive the loss of any executor, unlike cached or locally
    checkpointed blocks.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written._dossierflow_path = path
    return written


def discard(*tables: DataFrame) -> None:
    """Delete materialised tables that nothing will read any more."""
    for table in tables:
        drop_path(table.sparkSession, table._dossierflow_path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a path through Hadoop's file system (works for every scheme)."""
    _LIVE.discard(path)
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def list_path(spark: SparkSession, path: str) -> list[str]:
    """Names directly below a path."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return [f.getPath().getName() for f in target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(target)]


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per application.

    Python functions of the operators are then imported there by name, so that
    module-level caches live as long as a worker does. ``addPyFile`` serves the
    archive from the driver; executors read no folder of the driver's machine.
    """
    context = spark.sparkContext
    if getattr(context, "_dossierflow_shipped", False):
        return
    handle, archive = tempfile.mkstemp(prefix="dossierflow-", suffix=".zip")
    os.close(handle)
    _OWN.add(archive)
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as target:
        for source in sorted(PACKAGE_ROOT.rglob("*.py")):
            target.write(source, source.relative_to(PACKAGE_ROOT.parent))
    context.addPyFile(archive)
    context._dossierflow_shipped = True


def size_in_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the size of ``df``; exact file sizes for a scan."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return size if isinstance(size, int) else int(size.toString())
