"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

The rows of each input partition are permuted locally; how many of them go to
which block of which shard is drawn beforehand from the multivariate
hypergeometric law, the law of a uniform shuffle given the sizes. Rows then take
their blocks by their local rank, and each block is permuted again. As all block
sizes are known in advance, places in a shard are gapless without counting.
Only the number of rows of each partition reaches the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termindex.llm.common import broadcast_if_small, read, texts
from termindex.session import settled

SHARDS = 8
BLOCK_ROWS = 1 << 20
MATRIX_SIDE = 4096  # most rows and columns of the matrix (128 MB); beyond, partitions and blocks get larger
SEED = 42


def block_sizes(rows: int, shards: int, block_rows: int) -> list[list[int]]:
    """Sizes of the blocks of each shard: shards differ by at most one row, blocks of a shard too."""
    out = []
    for shard in range(shards):
        size = rows // shards + (shard < rows % shards)
        blocks = max(1, -(-size // block_rows))
        out.append([size // blocks + (b < size % blocks) for b in range(blocks)])
    return out


def hypergeometric(draw: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of ``n`` rows drawn without replacement are good ones."""
    if not good or not n:
        return 0
    if not bad or n >= good + bad:
        return min(good, n)
    if good + bad < 10**9:  # the range of numpy's sampler
        return int(draw.hypergeometric(good, bad, n))
    # Inversion around the mode: the law beyond 40 standard deviations is below any float.
    mode = (n + 1) * (good + 1) // (good + bad + 2)
    width = 40 * int((n * (good / (good + bad)) * (bad / (good + bad))) ** 0.5 + 1)
    k = np.arange(max(0, n - bad, mode - width), min(good, n, mode + width), dtype=np.float64)
    steps = np.log((good - k) * (n - k)) - np.log((k + 1) * (bad - n + k + 1))
    weight = np.concatenate([[0.0], np.cumsum(steps)])
    weight = np.cumsum(np.exp(weight - weight.max()))
    return int(max(0, n - bad, mode - width) + np.searchsorted(weight, draw.random() * weight[-1], side="right"))


def dealt(draw: np.random.Generator, rooms: np.ndarray, n: int) -> np.ndarray:
    """How many of ``n`` rows fall into each room: halves of the rooms against each other until numpy's sampler takes them."""
    total = int(rooms.sum())
    if total < 10**9:
        return draw.multivariate_hypergeometric(rooms, n, method="marginals")
    if len(rooms) == 1:
        return np.array([n], dtype=np.int64)
    half = len(rooms) // 2
    good = int(rooms[:half].sum())
    first = hypergeometric(draw, good, total - good, n)
    return np.concatenate([dealt(draw, rooms[:half], first), dealt(draw, rooms[half:], n - first)])


def communication_matrix(counts: list[int], sizes: list[int], seed: int) -> np.ndarray:
    """Rows sent from each partition (down) to each block (across): one partition after the other."""
    draw = np.random.Generator(np.random.PCG64(seed))
    left = np.array(sizes, dtype=np.int64)
    out = np.zeros((len(counts), len(sizes)), dtype=np.int64)
    for p, need in enumerate(counts):
        out[p] = dealt(draw, left, need)
        left -= out[p]
    return out


def matrix_table(spark: SparkSession, parts: list[int], matrix: np.ndarray, starts: np.ndarray) -> DataFrame:
    """(p, ends): where each block ends among the ranks of a partition, a list for each shard. Its numbers stay in arrays."""
    np.cumsum(matrix, axis=1, out=matrix)
    shards, blocks = len(starts) - 1, matrix.shape[1]
    borders = (np.arange(len(parts))[:, None] * blocks + starts[:-1]).ravel()
    of_shards = pa.ListArray.from_arrays(np.append(borders, matrix.size).astype(np.int32), matrix.ravel())
    ends = pa.ListArray.from_arrays(np.arange(len(parts) + 1, dtype=np.int32) * shards, of_shards)
    table = pa.table({"p": pa.array(parts, pa.int32()), "ends": ends})
    return spark.createDataFrame(table, "p int, ends array<array<bigint>>")


def shard_rows(rows: DataFrame, shards: int = SHARDS, seed: int = SEED,
               block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Add ``shard`` and ``slot`` to each row: a uniform random placement.

    Shard sizes differ by at most one; ``slot`` counts from 0 without gaps.
    ``rows`` should be narrow (ids and digests): it is stored once, so that the
    draw and the rows see the same partitions even if executors are lost. Equal
    rows are placed each for itself; nulls are values like others. An empty table
    gives none. Columns named ``shard`` or ``slot`` are replaced.
    """
    data = [c for c in rows.columns if c not in ("shard", "slot")]
    spark = rows.sparkSession
    held = settled(rows.select(
        F.struct(*[F.col(f"`{c}`") for c in data]).alias("row"), F.spark_partition_id().alias("p"),
        F.monotonically_increasing_id().alias("u")), "shards")
    parts = held.agg(F.max("p")).first()[0] or 0
    held = held.withColumn("p", F.expr(f"p div {1 + parts // MATRIX_SIDE}").cast("int"))
    counted = sorted(tuple(r) for r in held.groupBy("p").count().collect())  # one row per partition
    total = sum(n for _, n in counted)
    sizes = block_sizes(total, shards, max(block_rows, -(-total // MATRIX_SIDE)))
    flat = [(s, b, n) for s, of in enumerate(sizes) for b, n in enumerate(of)]
    matrix = communication_matrix([n for _, n in counted], [n for _, _, n in flat], seed)
    first = [len(of) for of in sizes]
    starts = np.concatenate([[0], np.cumsum(first)])
    table = matrix_table(spark, [p for p, _ in counted], matrix, starts)
    begins = F.array(*[F.array(*[F.lit(int(x)) for x in np.concatenate([[0], np.cumsum(of)[:-1]])]) for of in sizes])
    local = Window.partitionBy("p").orderBy(F.xxhash64(F.lit(seed), "u"), "u")
    again = Window.partitionBy("shard", "block").orderBy(F.xxhash64(F.lit(seed + 1), "u"), "u")
    rank = F.col("rank")
    return (
        held.withColumn("rank", F.row_number().over(local) - 1)
        .join(broadcast_if_small(table, row_bytes=8 * len(flat) + 64), "p")
        .withColumn("shard", F.size(F.filter("ends", lambda e: F.element_at(e, -1) <= rank)))
        .withColumn("block", F.size(F.filter(F.element_at("ends", F.col("shard") + 1), lambda e: e <= rank)))
        .withColumn("slot", F.row_number().over(again) - 1)
        .select(*[F.col(f"row.`{c}`").alias(c) for c in data], "shard",
                (F.element_at(F.element_at(begins, F.col("shard") + 1), F.col("block") + 1)
                 + F.col("slot")).cast("bigint").alias("slot"))
    )


def op10_sharding(spark: SparkSession, sf: str) -> DataFrame:
    """The law is ``rows``: a uniform shuffle puts equal texts wherever they fall."""
    rows = texts(read(spark, sf, "documents")).select(
        "doc_id", (F.octet_length("text") + F.lit(1)).cast("bigint").alias("size"),
        F.crc32("text").alias("text_crc32"))
    return shard_rows(rows).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))
