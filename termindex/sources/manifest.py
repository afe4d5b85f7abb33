"""Tag files of a manifest ``(path, codec)`` of any length, as a Python data source.

The manifest stays a table. Tasks look its paths up, leave out what does not exist,
list folders, and cut plain files into byte ranges; the pieces are dealt out to parts
of about equal size by a running sum, and stored as one folder per part. The driver
learns the number of parts only. The reader of a part takes its pieces from that
folder and streams each through its decoder, so no file is ever held whole.

Paths are opened with ``pyarrow.fs``, so they name a store that the executors reach
by it (a shared folder, HDFS, an object store).
"""

from __future__ import annotations

import gzip
import lzma
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from termindex.operators.slices import cut, running_sum
from termindex.session import new_folder, settled

CODECS = ("none", "gzip", "lzma")
PART_BYTES = 128 << 20
OPEN_BYTES = 1 << 20   # opening a file counts as reading so much
STEP_BYTES = 1 << 20
SHOWN_CODECS = 20


def open_store(path: str):
    """(file system, path in it) of a path or URI, also of the short form ``file:/``."""
    import pyarrow.fs as pafs

    if path.startswith("file:/") and not path.startswith("file://"):
        path = path[len("file:"):]
    return pafs.FileSystem.from_uri(path)


def _files(path: str) -> Iterator[tuple[str, int]]:
    """The file, or the files below a folder that are not hidden, with their sizes; nothing if it does not exist."""
    import pyarrow.fs as pafs

    store, inner = open_store(path)
    info = store.get_file_info(inner)
    prefix = path[:len(path) - len(inner)] if path.endswith(inner) else ""
    if info.type == pafs.FileType.File:
        yield path, info.size
    elif info.type == pafs.FileType.Directory:
        for below in store.get_file_info(pafs.FileSelector(inner, recursive=True)):
            parts = below.path[len(inner):].split("/")
            if below.type == pafs.FileType.File and not any(p.startswith(("_", ".")) for p in parts):
                yield prefix + below.path, below.size


def pieces(manifest: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """(path, codec, begin, end, weight): existing files of known codecs, plain ones in ranges of ``part_bytes``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(rows):
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                names=["path", "codec", "begin", "end", "weight"])

        kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        rows = []
        for batch in batches:
            for path, codec in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for file, size in _files(path):
                    step = part_bytes if codec == "none" else max(size, 1)
                    for begin in range(0, size, step):
                        end = min(size, begin + step)
                        rows.append((file, codec, begin, end, min(part_bytes, end - begin + OPEN_BYTES)))
                        if len(rows) >= 10_000:
                            yield packed(rows)
                            rows = []
        if rows:
            yield packed(rows)

    listed = manifest.select(F.col("path").cast("string"), F.col("codec").cast("string")).filter(
        F.col("codec").isin(*CODECS) & F.col("path").isNotNull())
    return listed.mapInArrow(run, "path string, codec string, begin bigint, end bigint, weight bigint")


def _blocks(path: str, codec: str) -> Iterator[bytes]:
    store, inner = open_store(path)
    with store.open_input_stream(inner, compression=None) as raw:
        stream = gzip.GzipFile(fileobj=raw) if codec == "gzip" else lzma.LZMAFile(raw)
        while block := stream.read(STEP_BYTES):
            yield block


def _range(path: str, begin: int, end: int) -> Iterator[bytes]:
    """The lines that begin in a byte range of a plain file, whole, as blocks."""
    store, inner = open_store(path)
    with store.open_input_file(inner) as file:
        at = max(begin - 1, 0)
        file.seek(at)
        skipping = begin > 0  # up to the end of the line that holds the byte before
        while block := file.read(STEP_BYTES):
            if skipping:
                newline = block.find(b"\n")
                if newline < 0 or at + newline + 1 >= end:
                    if newline >= 0 or at + len(block) >= end:
                        return
                    at += len(block)
                    continue
                skipping = False
                at, block = at + newline + 1, block[newline + 1:]
            if at + len(block) >= end:  # the line that holds the last byte of the range ends it
                newline = block.find(b"\n", max(end - 1 - at, 0))
                if newline >= 0:
                    yield block[:newline]
                    return
            at += len(block)
            yield block


def _lines(blocks: Iterator[bytes]) -> Iterator[pa.RecordBatch]:
    """Non-empty lines, a block at a time; lines end at newlines only."""
    rest: list[bytes] = []
    for block in blocks:
        first, *more = block.split(b"\n")
        rest.append(first)
        if more:
            whole = [b"".join(rest), *more[:-1]]
            rest = [more[-1]]
            if batch := [line.decode("utf-8", "replace") for line in whole if line]:
                yield pa.RecordBatch.from_arrays([pa.array(batch, pa.string())], names=["value"])
    if last := b"".join(rest):
        yield pa.RecordBatch.from_arrays([pa.array([last.decode("utf-8", "replace")], pa.string())], names=["value"])


class TagManifest(DataSource):
    """Options: ``plan``, the folder of stored pieces, and ``parts``, their number."""

    @classmethod
    def name(cls) -> str:
        return "tag_manifest"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema) -> DataSourceReader:
        return TagReader(self.options["plan"], int(self.options["parts"]))


class TagReader(DataSourceReader):
    def __init__(self, plan: str, parts: int):
        self.plan, self.parts = plan, parts

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(k) for k in range(self.parts)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        for file, _ in _files(f"{self.plan}/part={partition.value}"):
            store, inner = open_store(file)
            with store.open_input_file(inner) as stored:
                for batch in pq.ParquetFile(stored).iter_batches(columns=["path", "codec", "begin", "end"]):
                    for path, codec, begin, end in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                        yield from _lines(_range(path, begin, end) if codec == "none" else _blocks(path, codec))


def read_manifest(spark: SparkSession, manifest: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """Non-empty lines of all files of a manifest ``(path, codec)``.

    A path that does not exist and a codec that is not known are skipped, the latter with a warning. A file is
    decoded as its codec says, whatever its name; a folder stands for the files below it that are not hidden. A file
    that is listed twice is read twice. A compressed file that is cut off is an error.
    """
    unknown = manifest.filter(~F.coalesce(F.col("codec").isin(*CODECS), F.lit(False)))
    for codec, n in unknown.groupBy("codec").count().orderBy("codec").limit(SHOWN_CODECS).collect():
        print(f"tag manifest: skipping {n} files with unknown codec {codec!r}")
    spark.dataSource.register(TagManifest)
    order = ["path", "begin"]
    summed = running_sum(cut(pieces(manifest, part_bytes), [], order), [], order, F.col("weight"), "upto")
    dealt = settled(summed.select("path", "codec", "begin", "end",
                                  F.expr(f"(upto - weight) div {part_bytes}").cast("int").alias("part")), "pieces")
    last = dealt.agg(F.max("part")).first()[0]
    if last is None:
        return spark.createDataFrame([], "value string")
    plan = new_folder(spark, "manifest")
    dealt.repartition("part").write.partitionBy("part").parquet(plan)
    return spark.read.format("tag_manifest").option("plan", plan).option("parts", str(last + 1)).load()
