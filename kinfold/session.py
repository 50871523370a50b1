"""Session settings shared by the operators, the tests and the benchmark."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = 8, app: str = "kinfold", memory: str = "12g") -> SparkSession:
    """A local session; a cluster job builds its own and passes it in."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus).replace("*", "8"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's checkpoint folder; fall back to a scratch one if none is set."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    configured = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if configured is None and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="kinfold-checkpoint-"))


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Materialise into the shared checkpoint folder, so lost executors cost no replay."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)
