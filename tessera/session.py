"""Session construction and the shared scratch location.

On a cluster the scratch location is the shared folder named by ``spark.checkpoint.dir``;
a local temporary folder is created and registered only when that setting is unset
(tests and local runs).
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(master: str | None = None, app_name: str = "tessera", shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    """Session with AQE, skew-join splitting and UTC time; ``master`` only for local runs."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        # HotSpot does not JIT methods over 8000 bytecode bytes: wide projections (70+ cleaned CSV
        # columns) then run interpreted inside whole-stage codegen. At 8000 such a stage falls back
        # to per-expression compiled projections (measured 2x faster on the register import).
        "spark.sql.codegen.hugeMethodLimit": "8000",
    }
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session; set a local one only when none is configured."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current.rstrip("/")
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: intermediates need a folder that driver and executors share")
        configured = tempfile.mkdtemp(prefix="tessera-ckpt-")
        spark.conf.set("spark.checkpoint.dir", configured)
    sc.setCheckpointDir(configured)
    return (sc.getCheckpointDir() or configured).rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, not yet existing folder name under the shared checkpoint root (never reused)."""
    root = checkpoint_root(spark)
    return f"{root}/tessera-scratch/{name}-{uuid.uuid4().hex[:12]}"


def local_path(path: str) -> str:
    """Filesystem path for a ``file:`` URI (used only by task-side writers of small files)."""
    if path.startswith("file://"):
        return path[len("file://"):]
    if path.startswith("file:"):
        return path[len("file:"):]
    return path


def qualified(path: str) -> str:
    """``path`` as Spark resolves it: with the scheme of the default filesystem where it has none (driver only)."""
    spark = SparkSession.getActiveSession()
    if spark is None:
        return path
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return str(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString())


def arrow_fs(path: str):
    """(pyarrow filesystem, path) for task-side reading and writing of files.

    The driver hands tasks ``qualified`` paths; one without a scheme is local here.
    """
    from pyarrow import fs as pafs
    if path.startswith("file:") or "://" not in path:
        return pafs.LocalFileSystem(), local_path(path)
    return pafs.FileSystem.from_uri(path)


def materialize(df, name: str):
    """Write ``df`` as a Parquet table in the shared checkpoint folder and read it back.

    Cuts the lineage (a lost executor re-reads the table instead of replaying the plan), lets two
    consumers share one computation, and gives AQE real sizes and column pruning on read-back.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def drop_table(df) -> None:
    """Delete the folder of a table that ``materialize`` wrote, once all that reads it is done."""
    folder = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    spark = df.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(*folder) if folder else None
    if path and path.getParent().getName() == "tessera-scratch":
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop_scratch(spark: SparkSession) -> bool:
    """Delete this application's ``tessera-scratch`` folder (materialized intermediates, staging).

    Only the folder under the application's own checkpoint subdirectory is removed; call it when
    the run's outputs have been written and no DataFrame of the run is used any more.
    """
    root = spark.sparkContext.getCheckpointDir()
    if not root:
        return False
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/tessera-scratch")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.delete(path, True))


#: Rows of an Arrow batch at most. A batch is held whole outside the heap, by the JVM and by the
#: Python worker, once for each running task; Spark's 10,000 rows are tens of megabytes of text.
BATCH_ROWS = 1_000

#: Bytes of bytecode beyond which HotSpot does not compile a method.
METHOD_BYTES = 8_000


def small_methods(spark: SparkSession) -> None:
    """Let wide projections run compiled, in a session that was not built by ``build_session`` too.

    Whole-stage code of more than ``METHOD_BYTES`` in a method would be interpreted; below that limit such a
    stage runs its expressions in methods of their own. A smaller setting of the session stays.
    """
    key = "spark.sql.codegen.hugeMethodLimit"
    if int(spark.conf.get(key)) > METHOD_BYTES:
        spark.conf.set(key, str(METHOD_BYTES))


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``tessera`` importable in the Python workers of this application (``--py-files``).

    Python tasks (``mapInPandas``) unpickle functions of this package, so the workers must be able
    to import it even when it is not installed on the executors. The package is zipped once per
    application and distributed with ``SparkContext.addPyFile``. Rows go to the workers in batches of
    ``BATCH_ROWS`` at most; a smaller setting of the session stays.
    """
    import shutil

    import tessera
    rows = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    if not 0 < rows <= BATCH_ROWS:  # 0 or less: no limit
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(tessera.__file__))
    out = tempfile.mkdtemp(prefix="tessera-pyfiles-")
    archive = shutil.make_archive(os.path.join(out, "tessera"), "zip", root_dir=os.path.dirname(pkg),
                                  base_dir="tessera")
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(app)
