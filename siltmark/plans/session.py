"""Session set-up shared by tests, the benchmark and the command line."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parents[1]


def local_session(name: str = "siltmark", cores: str = "8", partitions: int = 8) -> SparkSession:
    """A local session with the settings that the tests and the benchmark use."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("SILTMARK_DRIVER_MEMORY", "6g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors once per application.

    Python workers import it from there, so nothing has to be installed on the cluster.
    """
    sc = spark.sparkContext
    if getattr(sc, "_siltmark_shipped", False):
        return
    target = Path(tempfile.mkdtemp(prefix="siltmark-")) / "siltmark_src.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(PACKAGE.rglob("*.py")):
            z.write(p, Path(PACKAGE.name) / p.relative_to(PACKAGE))
    sc.addPyFile(str(target))
    sc._siltmark_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where it is unset a folder of its own is set, which only a local master may do.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    sc = spark.sparkContext
    if not getattr(sc, "_siltmark_shared", None):
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc._siltmark_shared = "file://" + tempfile.mkdtemp(prefix="siltmark-shared-")
        sc.setCheckpointDir(sc._siltmark_shared)
    return sc._siltmark_shared


def new_path(spark: SparkSession, label: str) -> str:
    """A path of its own in the shared folder; what is there goes when the application ends."""
    path = f"{shared_dir(spark)}/siltmark-{label}-{uuid.uuid4().hex}"
    sc = spark.sparkContext
    if not hasattr(sc, "_siltmark_paths"):
        sc._siltmark_paths = []
        atexit.register(_clear, sc._jvm, spark._jsc.hadoopConfiguration(), sc._siltmark_paths)
    sc._siltmark_paths.append(path)
    return path


def _clear(jvm, conf, paths: list[str]) -> None:
    for path in paths:
        with contextlib.suppress(Exception):  # the JVM may be gone, and with it the chance to delete
            _delete(jvm, conf, path)


def _delete(jvm, conf, path: str) -> None:
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(conf).delete(p, True)


@contextlib.contextmanager
def _shuffles_go(spark: SparkSession) -> Iterator[None]:
    """Lets Spark delete the shuffle files of a query as soon as it is over, where its version can; else they wait for a collection of garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    try:
        before = spark.conf.get(name)  # with a default of None, Spark's own default would not be seen
    except PySparkException:
        yield
        return
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def written(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """Writes ``df`` to the shared folder, in a folder for each value of ``by`` if given, and reads it back.

    This cuts the lineage: what was computed once survives the loss of an executor and
    is not computed again by later branches of a plan. Shuffle files of the write go when it is over.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    with _shuffles_go(spark):
        (df.write.partitionBy(by) if by else df.write).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._siltmark_path = path
    return out


def remove(df: DataFrame, folder: str | None = None) -> None:
    """Deletes what ``written`` stored for ``df``, or one ``folder`` of it; for tables that no later plan reads."""
    path = getattr(df, "_siltmark_path", None)
    if path is None:
        return
    spark = df.sparkSession
    _delete(spark._jvm, spark._jsc.hadoopConfiguration(), f"{path}/{folder}" if folder else path)
    if folder:
        return
    with contextlib.suppress(ValueError):
        spark.sparkContext._siltmark_paths.remove(path)
