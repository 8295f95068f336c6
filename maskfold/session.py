"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings every job of this package assumes.  AQE re-plans joins at runtime
# (small derived tables become broadcast joins only after their real size is
# known) and splits skewed shuffle partitions.
BASE_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
}


def get_spark(cores: int | None = None, shuffle_partitions: int | None = None,
              app: str = "maskfold", extra: dict | None = None) -> SparkSession:
    """Local session for tests and the bench; on a cluster pass the builder's
    existing session to the operators instead."""
    cores = cores or int(os.environ.get("BENCH_CPUS", "8"))
    b = SparkSession.builder.master(f"local[{cores}]").appName(app)
    conf = dict(BASE_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions or cores)
    conf["spark.driver.memory"] = os.environ.get("MASKFOLD_DRIVER_MEMORY", "16g")
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster this setting points at shared storage and is only read here.
    When it is unset, a local session (tests) gets a private folder once; any
    other master is an error, since a folder of one machine would lose data.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        # the setting can't be changed in a running session, so the folder is kept beside it
        sc = spark.sparkContext
        d = sc._maskfold_folder = getattr(sc, "_maskfold_folder", None) or tempfile.mkdtemp(prefix="maskfold-ckpt-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the checkpoint folder for a written table."""
    import uuid
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    for made in getattr(spark.sparkContext, "_maskfold_scopes", []):
        made.append(path)
    return path


@contextmanager
def scratch_scope(spark: SparkSession):
    """Inside, written tables of the package are noted, and deleted at the end: for callers that have written or
    collected what they want of the results.  Results that are still lazy by then can't be read any more."""
    sc = spark.sparkContext
    scopes = sc._maskfold_scopes = getattr(sc, "_maskfold_scopes", [])
    made: list[str] = []
    scopes.append(made)
    try:
        yield
    finally:
        scopes.remove(made)
        for path in made:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def path_kind(spark: SparkSession, path: str) -> str:
    """'file', 'folder' or 'none', asked of the path's own file system."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(where):
        return "none"
    return "folder" if fs.getFileStatus(where).isDirectory() else "file"


def files_of(spark: SparkSession, source: str) -> dict[str, tuple[int, int]]:
    """Name -> (length, time of change in ms) of the data files of a folder, or of a file; a few numbers a file."""
    where = spark._jvm.org.apache.hadoop.fs.Path(source)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.listStatus(where)
    return {s.getPath().getName(): (s.getLen(), s.getModificationTime()) for s in found
            if s.isFile() and not s.getPath().getName().startswith(("_", "."))}


def failure_text(e: Exception) -> str:
    """Kind and first line of a failure; of one inside Spark, of what caused it."""
    java = getattr(e, "java_exception", None)
    if java is None:
        lines = str(e).strip().splitlines()
        return f"{type(e).__name__}: {lines[0] if lines else ''}"
    while java.getCause() is not None:
        java = java.getCause()
    return str(java.toString()).strip().splitlines()[0]


def staged(df, name: str):
    """Write ``df`` once as Parquet to the shared folder and read it back: several branches of a
    plan may read it, nothing stays cached on executors, and a lost one costs a re-read."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize(df):
    """Write ``df`` to the shared checkpoint folder and cut its lineage
    (reliable checkpoint: survives executor loss, unlike a local checkpoint).
    Used for small result tables that several later plans read."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def ship_package(spark: SparkSession) -> None:
    """Make ``maskfold`` importable in Python workers (pandas UDFs pickle
    references to it): zip the package once per SparkContext and hand it to
    ``addPyFile``, which copies it to every executor."""
    import zipfile

    sc = spark.sparkContext
    if getattr(sc, "_maskfold_shipped", False):
        return
    import maskfold
    root = os.path.dirname(os.path.abspath(maskfold.__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="maskfold-pkg-"), "maskfold.zip")
    with zipfile.ZipFile(out, "w") as z:
        for dirpath, _, files in os.walk(root):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(dirpath, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(out)
    sc._maskfold_shipped = True
