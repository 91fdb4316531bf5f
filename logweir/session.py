"""Session helpers: settings for local runs and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", name: str = "logweir", **conf: object) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    settings: dict[str, object] = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": 8,
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "12g",
        "spark.driver.host": "127.0.0.1",
        "spark.driver.bindAddress": "127.0.0.1",
        **conf,
    }
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
    for key, value in settings.items():
        builder = builder.config(key, str(value))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for written intermediates and checkpoints.

    The cluster names it in ``spark.checkpoint.dir``.  Only a local session
    with nothing set gets a folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    root = tempfile.mkdtemp(prefix="logweir-")
    spark.sparkContext.setCheckpointDir(root)
    return root


def mounted_path(folder: str) -> str:
    """Path of a shared folder as all tasks mount it; tailing reads files, which no other store offers."""
    path = folder.removeprefix("file://").removeprefix("file:")
    if "://" in path:
        raise ValueError(f"{folder} is not on a mounted file system, which following growing files needs")
    return path.rstrip("/")


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder; nothing is created or removed."""
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """The frame written to the shared folder and read back.

    For a result that several passes need: each then reads only its columns,
    and nothing is computed again when an executor is lost.
    """
    where = scratch_dir(df.sparkSession, name)
    df.write.parquet(where)
    return df.sparkSession.read.parquet(where)
