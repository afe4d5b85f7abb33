"""Joins of a large side with a lookup side whose size is measured, not assumed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termindex.session import settled

BROADCAST_BYTES = 64 * 1024 * 1024
HEAVY_ROWS = 1_000_000  # rows of a key that one task may well join


def measured_bytes(df: DataFrame) -> int:
    """Size of a table from its own rows: one aggregate, one row to the driver."""
    width = F.lit(16 * len(df.columns) + 16)
    for name, kind in df.dtypes:
        if kind == "string":
            width = width + F.coalesce(F.octet_length(name), F.lit(0))
        elif kind.startswith(("array", "map", "struct")):
            width = width + F.coalesce(F.octet_length(F.to_json(F.struct(name))), F.lit(0))
    return df.agg(F.sum(width.cast("bigint"))).first()[0] or 0


def lookup(facts: DataFrame, dim: DataFrame, keys: Sequence[str], how: str = "inner",
           salt_by: Column | None = None, limit: int = BROADCAST_BYTES,
           heavy: int = HEAVY_ROWS) -> DataFrame:
    """Join ``facts`` with ``dim`` on ``keys``.

    ``dim`` should be settled: it is measured first. Up to ``limit`` bytes it is
    broadcast. Beyond that both sides are shuffled, and a key of more than
    ``heavy`` rows of ``facts`` is divided over as many tasks as it has parts of
    that size: its rows take a salt from ``salt_by``, and only its rows of
    ``dim`` are repeated. Counting the keys costs one aggregation of ``facts``.
    The result is the same.
    """
    keys = list(keys)
    if measured_bytes(dim) <= limit:
        return facts.join(F.broadcast(dim), keys, how)
    salt_by = salt_by if salt_by is not None else F.xxhash64(*facts.columns)
    # At most one row per ``heavy`` rows of facts.
    parts = settled(facts.groupBy(*keys).count().filter(F.col("count") > heavy).select(
        *keys, F.ceil(F.col("count") / heavy).cast("int").alias("_parts")), "heavy")
    if parts.isEmpty():
        return facts.join(dim.hint("shuffle_merge"), keys, how)
    known = F.broadcast(parts) if measured_bytes(parts) <= limit else parts
    salted = facts.join(known, keys, "left").withColumn(
        "_salt", F.pmod(F.hash(salt_by), F.coalesce("_parts", F.lit(1)))).drop("_parts")
    repeated = dim.join(known, keys, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return salted.join(repeated.hint("shuffle_merge"), [*keys, "_salt"], how).drop("_salt")
