"""What the operators of this package share.

Every operator picks the columns it needs by name and gives them names of its
own, so other columns of the input, whatever they are called, never clash.
A null text is an empty text. A null id is treated as the largest id: all rows
without an id are one document that comes last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLANKS = " \t\n\x0b\x0c\r"
BLANK_CLASS = r"[\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LAST_ID = 2**63 - 1


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def texts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, text) of each row, with a null text as an empty one."""
    return docs.select(F.col(id_column).cast("bigint").alias("doc_id"),
                       F.coalesce(F.col(text_column), F.lit("")).alias("text"))


def order_id() -> Column:
    """The id for ordering and comparing: never null."""
    return F.coalesce(F.col("doc_id"), F.lit(LAST_ID))


def ascii_lower(column: Column) -> Column:
    """A-Z in lower case; all other characters stay."""
    return F.translate(column, UPPER, LOWER)


def broadcast_if_small(df: DataFrame, limit: int = 64 * 1024 * 1024, row_bytes: int = 64) -> DataFrame:
    """Mark a stored table of short fixed-width rows for broadcasting if its counted size allows it."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df
