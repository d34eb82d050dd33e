"""Session helpers.

Every date bucket in this library is ``to_date(timestamp)``, so the session
time zone is part of the contract: it must be UTC. ``ensure_utc`` pins it on a
session someone else built (the driver's, a notebook's); ``build_session`` is
for our own tests and bench.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def ensure_utc(spark: SparkSession) -> SparkSession:
    if spark.conf.get("spark.sql.session.timeZone", None) != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder.

    On a cluster ``spark.checkpoint.dir`` names a shared (HDFS/S3/...) folder
    and we only read it; a missing setting there is an error, because a
    machine-local folder would not survive the loss of the executor that
    wrote it. Only in local mode (tests, the bench) do we create a scratch
    folder of our own when the setting is absent.
    """
    sc = spark.sparkContext
    current = (sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir", None)
               or spark.conf.get("spark.checkpoint.dir", None))
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return current
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set: point it at a shared folder of the cluster")
    path = tempfile.mkdtemp(prefix="mktpulse-ckpt-")
    sc.setCheckpointDir(path)
    return path


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, app: str = "mktpulse") -> SparkSession:
    spark = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.checkpoint.compress", "true")
        .config("spark.driver.memory", os.environ.get("MKTPULSE_DRIVER_MEM", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def materialize_small(df):
    """Compute a small, aggregated frame once and cut its lineage.

    Operators that need a global total of a frame (budget shares, the funnel
    campaign pick) read it through scalar subqueries; when the frame is an
    expensive rollup, each subquery would re-derive it from the raw scan.
    A reliable checkpoint in the shared checkpoint folder stores it once and
    survives executor loss (never ``localCheckpoint``). Only for frames whose
    size has a bound independent of the data volume: a dimension (channels,
    campaigns), the calendar (cohort x month), or an explicit cap (at most
    ``max_hot_keys`` heavy keys in ``operators.joins``).
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers, wherever the driver was started.

    The package is zipped and handed to ``SparkContext.addPyFile`` once per
    context; a cluster installation or ``--py-files`` makes it redundant but
    harmless.
    """
    import shutil
    from pathlib import Path

    sc = spark.sparkContext
    if getattr(sc, "_mktpulse_shipped", False):
        return
    root = Path(__file__).resolve().parent
    if root.parent.is_dir():  # a plain folder; from a zip (--py-files) it is shipped already
        into = Path(tempfile.mkdtemp(prefix="mktpulse-pkg-"))
        shutil.copytree(root, into / "src" / root.name, ignore=shutil.ignore_patterns("__pycache__"))
        sc.addPyFile(shutil.make_archive(str(into / "mktpulse_pkg"), "zip", into / "src"))
    sc._mktpulse_shipped = True
