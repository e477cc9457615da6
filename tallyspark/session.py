"""Session set-up and the few settings every operator relies on."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, Row, SparkSession


def get_session(app: str = "tallyspark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC times, AQE and Arrow. ``master`` is left to spark-submit when None."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.parquet.filterPushdown": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",  # a checkpoint goes when nothing refers to it any more
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a folder of our own only where it is unset.

    A cluster names a folder that all executors share. In tests (local mode, nothing set) a
    temporary folder is as good as shared, since there is one machine.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if named:
        if context._jsc.sc().getCheckpointDir().isEmpty():
            context.setCheckpointDir(named)
        return named
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tallyspark-"))
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with a reliable checkpoint that survives a lost executor."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One parquet table of a data folder."""
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))


def bounded(df: DataFrame, most: int, what: str) -> list[Row]:
    """The rows of a list that has to be small; a longer one is an error."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} {what} are listed")
    return rows


def spread(df: DataFrame) -> DataFrame:
    """Give CPU-heavy Python work enough tasks: shuffle only where a scan has fewer tasks than there are cores.

    A large input has many splits already and passes through untouched.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df._jdf.rdd().getNumPartitions() >= cores else df.repartition(2 * cores)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, where it is not on their path already."""
    import shutil
    from pathlib import Path

    package = Path(__file__).resolve().parent
    archive = shutil.make_archive(str(Path(tempfile.mkdtemp(prefix="tallyspark-")) / "tallyspark"), "zip", package.parent, package.name)
    spark.sparkContext.addPyFile(archive)


def importable(spark: SparkSession) -> None:
    """Let Python workers find this package where it lies, however the driver was started."""
    from pathlib import Path

    root = str(Path(__file__).resolve().parents[1])
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([root, *paths])
