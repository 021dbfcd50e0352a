"""Session helpers: a tuned builder for tests and benches, table loading, lineage cuts."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "shelfspark") -> SparkSession:
    """A local session with AQE on. On a cluster the caller brings its own session and this is not used."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("SHELFSPARK_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_folder(master: str, named: str | None) -> str:
    """The folder that the session names; a temporary one, removed at exit, only where all runs in one local JVM.

    On a cluster a machine-local folder would lose data with the machine, so there an unset folder is an error.
    """
    if named:
        return named
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="shelfspark-checkpoint-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    return own


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for intermediate results."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(checkpoint_folder(context.master, spark.conf.get("spark.checkpoint.dir", None)))
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and read it back.

    Checkpoint files are on shared storage, so a lost executor costs a re-read, not a re-run.
    """
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have yet (names compare without case, as Spark does)."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name += "_"
    return name
