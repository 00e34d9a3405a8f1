"""One place that builds the session the way every operator expects it."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import SparkSession


def build_session(app: str = "sparkassay", master: str | None = None, **extra: str) -> SparkSession:
    """A session with UTC time, ANSI mode and adaptive execution.

    On a cluster ``master`` stays None and the launcher decides; tests and the
    bench pass ``local[n]``.  ``extra`` are Spark settings with ``__`` for dots.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        cores = master[6:-1] if master.startswith("local[") else "8"
        cores = str(os.cpu_count()) if cores == "*" else cores
        builder = (
            builder.master(master)
            .config("spark.driver.memory", os.environ.get("SPARKASSAY_DRIVER_MEMORY", "6g"))
            .config("spark.sql.shuffle.partitions", cores)
            .config("spark.ui.enabled", "false")
            .config("spark.ui.showConsoleProgress", "false")
        )
    builder = (
        builder.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package, wherever the driver found it.  Once a context."""
    context = spark.sparkContext
    if getattr(context, "_sparkassay_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    tmp = tempfile.mkdtemp(prefix="sparkassay-ship-")  # the driver serves it until it ends
    atexit.register(shutil.rmtree, tmp, ignore_errors=True)
    archive = os.path.join(tmp, "sparkassay.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.join("sparkassay", os.path.relpath(path, root)))
    context.addPyFile(archive)
    context._sparkassay_shipped = True


_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session, where intermediate tables go.

    Where it is unset, a local session gets a folder of our own that goes with the
    process; on a cluster that is an error, as executors could not read the folder.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="sparkassay-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return _own[app]
