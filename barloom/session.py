"""Session settings and the two places where a plan is cut."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(cores: str = "*", partitions: int = 8, app: str = "barloom") -> SparkSession:
    """Session for tests and the local bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers once per application.

    Spark copies the archive to every executor, also to ones that join later.
    """
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    target = os.path.join(tempfile.mkdtemp(prefix="spark-", dir="/tmp"), "barloom")
    spark.sparkContext.addPyFile(shutil.make_archive(target, "zip", root, "barloom"))
    _SHIPPED.add(app)


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder named by the session; a scratch one only for local masters."""
    configured = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(
        CHECKPOINT_KEY, None
    )
    if configured:
        folder = configured
    elif spark.sparkContext.master.startswith("local"):
        folder = spark.sparkContext._jsc.sc().getCheckpointDir()
        if folder.isDefined():
            return folder.get()
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    else:
        raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder shared by all executors")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not current.isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` reliably so that an iterative plan does not grow."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
