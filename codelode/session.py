"""Session construction and the shared folder that long plans write to."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "codelode", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are tuned for.

    Nothing here overrides a cluster's own settings: master and memory are only set when asked for.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return ship_package(builder.getOrCreate())


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> SparkSession:
    """Gives every executor this package, once for each application, wherever it was started from.

    The package's source goes through the driver's own file server (under a megabyte); nothing has to be
    installed on the executors, and new executors get it too.
    """
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        root = Path(__file__).resolve().parent
        folder = tempfile.mkdtemp(prefix="codelode-package-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        packed = Path(folder) / "codelode.zip"
        with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as out:
            for path in sorted(root.rglob("*.py")):
                out.write(path, Path(root.name) / path.relative_to(root))
        context.addPyFile(str(packed))
        _SHIPPED.add(context.applicationId)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, from ``spark.checkpoint.dir``.

    Only a local session (tests, a laptop) that names none gets a temporary folder, which is removed when
    Python ends. On a cluster a missing setting is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if named:
        if context._jsc.sc().getCheckpointDir().isEmpty():
            context.setCheckpointDir(named)
        return named
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    own = tempfile.mkdtemp(prefix="codelode-checkpoint-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    context.setCheckpointDir("file://" + os.path.abspath(own))
    return own


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and returns it with its lineage cut (survives lost executors).

    The files are removed with the frame where the session cleans checkpoints up, as ``build_session`` sets.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """df in as many partitions as there are cores, where a scan has fewer (a file in one piece); else as it is.

    For scans whose rows cost much to work on. A table of more pieces than cores is never exchanged.
    """
    plan = df._jdf.queryExecution()
    if "Exchange" in plan.executedPlan().toString():
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if plan.toRdd().getNumPartitions() < cores else df


#: Rows of two numbers or less that may be sent to every executor (16 MB).
SMALL_ROWS = 1_000_000


def sent_if_small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """df, written once, with a broadcast hint if it was counted to have so few (narrow) rows; else without.

    For semi joins that thin out wide rows: broadcast, they need no exchange of the wide side; beyond
    the bound the planner joins as it sees fit.
    """
    kept = cut(df)
    return F.broadcast(kept) if kept.count() <= rows else kept
