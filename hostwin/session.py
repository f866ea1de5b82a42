"""Session defaults and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_LOCAL_SCRATCH = "hostwin.local.scratch"
_scope: ContextVar[list[str] | None] = ContextVar("pins of the innermost scratch scope", default=None)


def get_spark(app: str = "hostwin", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators expect; ``conf`` overrides any of them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # Fits that run at the same time share the cluster.
        "spark.scheduler.mode": "FAIR",
        # Call sites in error messages cost a third of the time it takes to build a plan.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        "spark.sql.streaming.stateStore.providerClass":
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        **{k.replace("__", "."): v for k, v in conf.items()},
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, wherever it is installed for the driver.

    Functions that run in tasks are found by the name of their module. On a cluster where every
    machine has the package installed this is not needed.
    """
    if any("hostwin-" in file for file in spark.sparkContext.listFiles):
        return
    root = Path(__file__).resolve().parent
    # A file of the driver, which Spark serves to the workers.
    archive = Path(tempfile.mkdtemp(prefix="hostwin-")) / f"hostwin-{uuid.uuid4().hex}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, file.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(archive))


def checkpoint_root(spark: SparkSession) -> str:
    """The checkpoint folder of the session, which is left as it is.

    A cluster names a shared folder in ``spark.checkpoint.dir``. Only a local session may
    fall back to a temporary folder, since every task then runs on this machine.
    """
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        folder = spark.conf.get(_LOCAL_SCRATCH, None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="hostwin-")
        spark.conf.set(_LOCAL_SCRATCH, folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder, removed with the scope around it if any."""
    path = f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    held = _scope.get()
    if held is not None:
        held.append(path)
    return path


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Remove, at its end, everything that was stored in the shared folder inside.

    Results must be written elsewhere or fetched before the scope ends. Without a scope stored
    tables stay until the folder is cleared.
    """
    token = _scope.set([])
    try:
        yield
    finally:
        held = _scope.get()
        _scope.reset(token)
        for path in held:
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path in any store that Spark reaches."""
    sc = spark.sparkContext
    target = sc._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)


def pin(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Every later use then sees the same rows, no lineage has to be run again when an
    executor is lost, and only the columns in use are read. A result that must outlive the
    scope it is made in takes a ``path`` drawn before that scope.
    """
    path = path or scratch_path(df.sparkSession, "pinned")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
