"""Session helpers: a local session for tests, and durable cut points."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_MADE: list[str] = []  # folders below the shared one that this process has named


def local_session(cores: str = "*", partitions: int = 8, app: str = "termindex") -> SparkSession:
    """A single-machine session for tests and timings."""
    return (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, taken from ``spark.checkpoint.dir``.

    Without the setting the context's checkpoint folder counts. Only a
    single-machine session may have neither; it gets a folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="termindex-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    """Path of a not yet existing folder below the shared one."""
    folder = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    _MADE.append(folder)
    return folder


def clear_folders(spark: SparkSession) -> int:
    """Delete what ``settled`` and ``new_folder`` made in this session; returns how many folders went.

    For long-lived sessions, after the results that read them are written.
    """
    gone = 0
    while _MADE:
        path = spark._jvm.org.apache.hadoop.fs.Path(_MADE.pop())
        gone += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    return gone


def settled(df: DataFrame, label: str = "settled") -> DataFrame:
    """Compute once and store reliably; later reads never recompute the input.

    Used where a value must not change between two reads of the same rows
    (slice numbers), and for tables that several steps share. Stored as Parquet
    in the shared folder: later reads take only the columns they need, and a
    lost executor loses nothing.
    """
    folder = new_folder(df.sparkSession, label)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
