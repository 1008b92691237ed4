"""Session helpers: where intermediate tables go and how they are written.

Intermediate tables must outlive executors, so they are written to the shared
folder named by ``spark.checkpoint.dir``.  A private folder is made only when
nothing is configured *and* Spark runs in local mode (tests, laptops).
"""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

_local_roots: dict[str, str] = {}


def build_session(app: str = "stackpool", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the jobs rely on; cluster settings win where given."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in {**defaults, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        b = b.config(key, value)
    return b.getOrCreate()


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application.

    Picture, SVM and streaming jobs run its functions inside tasks; sessions
    that were started with ``--py-files`` need no call.
    """
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="stackpool-package-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    # the driver's copy; Spark distributes the file to the executors
    archive = shutil.make_archive(os.path.join(folder, "stackpool"), "zip", os.path.dirname(package), "stackpool")
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)


def shared_root(spark: SparkSession) -> str:
    """Folder for intermediate tables, taken from ``spark.checkpoint.dir``."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    already_set = spark.sparkContext.getCheckpointDir()
    if already_set:
        return already_set.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _local_roots:
        root = tempfile.mkdtemp(prefix="stackpool-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        _local_roots[app] = root
    return _local_roots[app]


def _hadoop(spark: SparkSession, path: str):
    """(file system, path) of the JVM."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


_owned: set[str] = set()


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A fresh path below the shared folder, in a folder of this application that goes when the application ends."""
    root = f"{shared_root(spark)}/stackpool/{spark.sparkContext.applicationId}"
    if root not in _owned:
        fs, at = _hadoop(spark, root)
        fs.mkdirs(at)
        fs.deleteOnExit(at)
        _owned.add(root)
    return f"{root}/{tag}-{uuid.uuid4().hex}"


def make_folder(spark: SparkSession, path: str) -> None:
    """Make a folder and those above it, where they are not there yet."""
    fs, at = _hadoop(spark, path)
    fs.mkdirs(at)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table of this library's own, if it is there."""
    fs, at = _hadoop(spark, path)
    fs.delete(at, True)


def discard(df: DataFrame) -> None:
    """Delete a table that ``materialise`` wrote and nothing will read again; other frames are left alone."""
    path = df.__dict__.pop("_scratch", None)
    if path:
        remove(df.sparkSession, path)


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Used where later steps need *one* fixed evaluation of a plan, such as row
    positions of a sampled range sort.  Readers prune columns, and a lost
    executor costs only its own tasks.  The table goes with the application, or
    earlier by ``discard``.
    """
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.mode("errorifexists").parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored.__dict__["_scratch"] = path
    return stored


def small_files_session(spark: SparkSession) -> SparkSession:
    """A session beside ``spark``, with its settings, for folders of very many small files.

    Files are listed by a task for each core instead of one for each file, a task
    takes many files, and listings are not kept.
    """
    own = spark.newSession()
    tasks = spark.sparkContext.defaultParallelism
    few = {"spark.sql.sources.parallelPartitionDiscovery.parallelism": str(tasks), "spark.sql.files.openCostInBytes": str(1 << 12),
           "spark.sql.hive.filesourcePartitionFileCacheSize": "0"}
    for key, value in {**spark.conf.getAll, **few}.items():
        if own.conf.isModifiable(key):
            own.conf.set(key, value)
    return own


def materialise_each(spark: SparkSession, parts: list[str], read: Callable[[SparkSession, str], DataFrame], tag: str, together: int = 4) -> DataFrame:
    """``materialise`` of ``read(session, part)`` for every part, as one table, ``together`` parts at a time.

    For folders of very many files: the driver plans a read file by file, and so
    holds the files of these parts only.
    """
    path, own, schemas = scratch_path(spark, tag), small_files_session(spark), []

    def store(k: int) -> None:
        df = read(own, parts[k])
        df.write.parquet(f"{path}/{k}")
        schemas.append(df.schema)

    with ThreadPoolExecutor(together) as pool:
        for k, _ in enumerate(pool.map(inheritable_thread_target(spark)(store), range(len(parts)))):
            if k % together == 0:
                gc.collect()  # read frames are in cycles; until Python drops them, the JVM keeps their listings
    return spark.read.schema(schemas[0]).parquet(*[f"{path}/{k}" for k in range(len(parts))])


def shuffle_partitions(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2)
