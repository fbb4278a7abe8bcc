"""Session helpers: a local session for tests, and the shared work folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "corpuscope", cores: str = "*", **conf: str) -> SparkSession:
    """A local session for tests and the benchmark. Clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # Without call-site capture, building a deep Column takes a third of the calls.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_LOCAL_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    A local session that names none (a test) gets one temporary folder for its
    application; the session's settings stay as they are. A cluster must name one:
    each executor's own temporary folder would hold a part that no other can read.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        folder = _LOCAL_DIRS.setdefault(app, None) or tempfile.mkdtemp(prefix="corpuscope-")
        _LOCAL_DIRS[app] = folder
    return folder.rstrip("/")


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors, once per application.

    Functions that run in Python workers name their helpers by module; so an executor
    needs the modules, wherever the driver was started.
    """
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    package = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="corpuscope-"), "corpuscope-package.zip")
    with zipfile.ZipFile(target, "w") as archive:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    archive.write(path, os.path.relpath(path, os.path.dirname(package)))
    spark.sparkContext.addPyFile(target)


_SCRATCH: list[str] = []


def run_dir(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder name (not yet created) below :func:`shared_dir`, or below the
    scratch folder in use.

    Whoever runs the job removes the shared folder's contents after it, as results
    read from these tables may be used for as long as the session lives.
    """
    ship_package(spark)
    parent = _SCRATCH[-1] if _SCRATCH else shared_dir(spark)
    return f"{parent}/{name}-{uuid.uuid4().hex}"


@contextmanager
def scratch(spark: SparkSession, name: str) -> Iterator[str]:
    """While it lasts, every stored table goes into one folder of its own, so that a job
    whose result has been stored elsewhere can be cleaned up at once (:func:`drop`)."""
    folder = run_dir(spark, name)
    _SCRATCH.append(folder)
    try:
        yield folder
    finally:
        _SCRATCH.remove(folder)


def drop(spark: SparkSession, folder: str) -> None:
    """Removes a scratch folder with all its tables."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Several reports read the same derived table. The written copy cuts the
    lineage, lets each reader prune columns, and survives the loss of executors.
    """
    spark = df.sparkSession
    path = run_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(scan: DataFrame) -> DataFrame:
    """Deal the rows of a small scan over all cores; leave a large one alone.

    For a plain scan in front of costly per-row work. A scan with at least one
    split per core, as any large table has, is returned as it is: no shuffle.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(2 * cores)
