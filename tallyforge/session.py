"""Session factory with the settings the engine relies on."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import SparkSession


def build_session(app: str = "tallyforge", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with AQE; on a cluster, pass no master and let spark-submit decide."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    if master and master.startswith("local"):
        cores = master[6:-1]
        settings["spark.sql.shuffle.partitions"] = cores if cores.isdigit() else str(os.cpu_count() or 8)
        settings["spark.driver.memory"] = os.environ.get("TALLYFORGE_DRIVER_MEMORY", "8g")
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str):
    """One of the input tables, as Spark's own reader sees it."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, label: str) -> str:
    """A path that nothing uses, in the folder that all nodes share.

    That is spark.checkpoint.dir. Where it is unset, a local session takes a temporary folder once, and a cluster raises.
    """
    context = spark.sparkContext
    conf = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not conf:
        if context._jsc.sc().getCheckpointDir().isEmpty():
            if not context._jsc.sc().isLocal():
                raise ValueError("spark.checkpoint.dir has to name a folder that all nodes share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="tallyforge-"))
        conf = context._jsc.sc().getCheckpointDir().get()
    return f"{conf}/{label}-{uuid.uuid4().hex}"


def ship_package(spark: SparkSession) -> None:
    """Gives this package to the session's Python workers, wherever the driver was started; once a context."""
    context = spark.sparkContext
    if getattr(context, "_tallyforge_shipped", False):
        return
    package = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="tallyforge-package-")  # the driver serves the file while it runs
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    shutil.copytree(package, f"{folder}/source/{package.name}", ignore=shutil.ignore_patterns("__pycache__"))
    context.addPyFile(shutil.make_archive(f"{folder}/{package.name}", "zip", f"{folder}/source"))
    context._tallyforge_shipped = True
