"""Session defaults and the reliable checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(
    app: str = "wayline", master: str | None = None, shuffle_partitions: int | None = None, driver_memory: str | None = None
) -> SparkSession:
    """A session with adaptive execution and UTC times; cluster settings win over these defaults.

    Checkpoints go when nothing refers to them any more. On a cluster the
    package has to be shipped to the executors (``--py-files`` or ``addPyFile``).
    """
    # local Python workers import the package wherever the program was started
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    known = [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in known:
        os.environ["PYTHONPATH"] = os.pathsep.join([root, *known])
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    if driver_memory:  # takes effect only where this call starts the JVM (local runs)
        builder = builder.config("spark.driver.memory", driver_memory)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Folder for reliable checkpoints: the one the cluster names, or a local one in local mode."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="wayline-checkpoint-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder; survives the loss of executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
