"""Session and execution helpers shared by every operator."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession


def session(master: str = "local[*]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for: UTC, AQE and ANSI casts."""
    builder = (
        SparkSession.builder.master(master)
        .appName("lexmill")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def read(spark: SparkSession, root: str, table: str) -> DataFrame:
    """The Parquet table ``table`` below ``root``."""
    return spark.read.parquet(f"{root}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``. Where it is unset a local session
    gets one of its own; a cluster is refused, as its machines share no temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if "folder" not in _own:
        _own["folder"] = tempfile.mkdtemp(prefix="lexmill-")
    return _own["folder"]


_own: dict[str, str] = {}


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one, for tables that a query writes and reads again."""
    return f"{shared_folder(spark).rstrip('/')}/lexmill-{name}-{uuid.uuid4().hex}"


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many partitions as the cluster has cores.

    A table in one small file is read by one task; operators that do heavy work per row call this
    first. Inputs that already have enough splits, as all large ones, aren't shuffled.
    """
    width = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() * 2 <= width:
        return df.repartition(width)
    return df


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system that a path or address names, and the path within it."""
    return pafs.FileSystem.from_uri(path if "://" in path else f"file://{path.removeprefix('file:')}")
