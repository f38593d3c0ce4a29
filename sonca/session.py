"""Sessions that fit these plans, and shipping the package to executors that do not have it."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent


def session(cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session; on a cluster the submitter's own settings hold."""
    b = SparkSession.builder.appName("sonca").master(f"local[{cores}]")
    settings = {"spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.sql.shuffle.partitions": str(cores if isinstance(cores, int) else os.cpu_count()), "spark.driver.memory": "8g"}
    return b.config(map=settings | conf).getOrCreate()


def small_batches(spark: SparkSession, most_bytes: int = 8 << 20) -> None:
    """Bounds the bytes of Arrow batches, where the session has Spark's defaults: ten thousand texts may be large."""
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(rows) == "10000":
        spark.conf.set(size, str(most_bytes))


def ship(spark: SparkSession) -> None:
    """Sends the package to Python workers, unless they find it where the driver does.

    Workers see the driver's PYTHONPATH and, in the local mode, its working directory.
    """
    paths = [os.path.abspath(p or ".") for p in (*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd())]
    context = spark.sparkContext
    if str(ROOT) in paths or "site-packages" in ROOT.parts or getattr(context, "_has_sonca", False):
        return
    folder = tempfile.mkdtemp()  # executors fetch it from the driver at any time
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    context.addPyFile(shutil.make_archive(f"{folder}/sonca-package", "zip", ROOT, "sonca"))
    context._has_sonca = True
