"""The project registry as a JSON document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "map<string, struct<run: int, extra_dirs: array<string>>>"


def parse_registry(texts: DataFrame, value: str = "value") -> DataFrame:
    """(path, run, extra_dirs); text that is not a registry yields no rows."""
    return (
        texts.select(F.explode(F.from_json(value, SCHEMA)).alias("path", "_entry"))
        .select("path", F.col("_entry.run").alias("run"), F.col("_entry.extra_dirs").alias("extra_dirs"))
    )


def read_registry(spark: SparkSession, path: str, one_per_line: bool = False) -> DataFrame:
    """Load the registry file; a missing or corrupt one counts as empty.

    A large registry can be kept as many documents, one per line.
    """
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        return spark.createDataFrame([], "path string, run int, extra_dirs array<string>")
    return parse_registry(spark.read.text(path, wholetext=not one_per_line))
