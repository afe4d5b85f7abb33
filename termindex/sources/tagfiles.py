"""Tag files: plain, gzip and xz, listed or in folders, and writing them."""

from __future__ import annotations

import gzip
import io
import lzma
import uuid
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termindex.session import settled
from termindex.sources.manifest import CODECS, read_manifest

__all__ = ["CODECS", "read_manifest", "read_tag_manifest", "read_tags", "read_tags_xz", "tag_lines", "write_tags"]
LINES_PER_BATCH = 20_000
BYTES_PER_STEP = 1 << 20


def read_tags(spark: SparkSession, paths: str | Sequence[str], partitions: int | None = None) -> DataFrame:
    """Non-empty lines of plain and gzip tag files, decoded by suffix.

    Lines end at newlines only: a carriage return is part of its line. A gzip
    file cannot be split, so its lines can be dealt to ``partitions`` tasks after
    the read; plain files are split by the scan. Other suffixes are not decoded,
    so an xz file is refused here.
    """
    listed = [paths] if isinstance(paths, str) else list(paths)
    if any(p.endswith(".xz") for p in listed):
        raise ValueError("xz tag files are read by read_tags_xz")
    lines = spark.read.option("lineSep", "\n").text(listed).filter("value <> ''")
    return lines.repartition(partitions) if partitions else lines


def _unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for content in batch["content"]:
            yield from _lines(bytes(content))


def _lines(packed: bytes) -> Iterator[pd.DataFrame]:
    """Decoded lines in bounded batches; the unpacked file is never held whole."""
    if not packed:
        return
    if packed[:2] == b"\x1f\x8b":
        yield from _gzip_lines(packed)
        return
    if packed[:6] != b"\xfd7zXZ\x00":
        yield from _plain_lines(packed)
        return
    decoder, rest, pending = lzma.LZMADecompressor(), b"", []
    feed = packed
    while True:
        if decoder.eof:  # a file may hold several streams
            feed = decoder.unused_data
            if not feed:
                break
            decoder = lzma.LZMADecompressor()
        elif not feed and decoder.needs_input:
            raise EOFError("xz tag file is cut off")
        *whole, rest = (rest + decoder.decompress(feed, BYTES_PER_STEP)).split(b"\n")
        feed = b""
        pending.extend(line for line in whole if line)
        if len(pending) >= LINES_PER_BATCH:
            yield _frame(pending)
            pending = []
    if rest:
        pending.append(rest)
    if pending:
        yield _frame(pending)


def _gzip_lines(packed: bytes) -> Iterator[pd.DataFrame]:
    with gzip.GzipFile(fileobj=io.BytesIO(packed)) as stream:
        yield from _batched(line.rstrip(b"\n") for line in stream)


def _plain_lines(packed: bytes) -> Iterator[pd.DataFrame]:
    yield from _batched(line.rstrip(b"\n") for line in io.BytesIO(packed))


def _batched(lines: Iterator[bytes]) -> Iterator[pd.DataFrame]:
    pending = []
    for line in lines:
        if line:
            pending.append(line)
        if len(pending) >= LINES_PER_BATCH:
            yield _frame(pending)
            pending = []
    if pending:
        yield _frame(pending)


def _frame(lines: list[bytes]) -> pd.DataFrame:
    return pd.DataFrame({"value": [line.decode("utf-8", "replace") for line in lines]})


def read_tags_xz(spark: SparkSession, paths: str | Sequence[str], partitions: int | None = None) -> DataFrame:
    """Non-empty lines of xz tag files (S3). One file is one row and one decoder."""
    files = spark.read.format("binaryFile").load(paths if isinstance(paths, str) else list(paths))
    lines = files.select("content").mapInPandas(_unpack, "value string")
    return lines.repartition(partitions) if partitions else lines


def read_tag_manifest(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Lines of all files of a manifest ``(path, codec)`` (S4); see ``manifest.read_manifest``."""
    return read_manifest(spark, manifest)


def tag_lines(tags: DataFrame) -> DataFrame:
    """Catalogue rows as tag lines, keeping other columns such as partition keys."""
    parts = [F.col("name"), F.col("file"), F.col("pattern"), F.col("kind"),
             F.concat(F.lit("language:"), F.col("lang"))]
    # A field without a value keeps its place.
    line = F.concat_ws("\t", *[F.coalesce(p, F.lit("")) for p in parts]).alias("value")
    kept = [c for c in tags.columns if c not in ("name", "file", "pattern", "kind", "lang")]
    return tags.select(line, *kept)


def write_tags(lines: DataFrame, folder: str, codec: str = "gzip",
               by: Sequence[str] = ("root_key", "filetype")) -> None:
    """Write tag lines compressed, one target folder per root and filetype.

    The rows are rebalanced by target: small targets get one file each, and a
    target with a large part of all rows is divided over several files. Targets
    that the rows name are replaced, others stay; without ``by`` the folder is
    replaced.
    """
    spread = lines.hint("rebalance", *by) if by else lines
    if codec in ("none", "gzip"):
        writer = (spread.write.mode("overwrite").option("compression", codec)
                  .option("partitionOverwriteMode", "dynamic"))
        (writer.partitionBy(*by) if by else writer).text(folder)
    elif codec == "lzma":
        _write_xz(spread, folder, list(by))
    else:
        raise ValueError(f"unknown codec {codec!r}")


def _write_xz(lines: DataFrame, folder: str, by: list[str]) -> None:
    """Each task packs its rows of a target into its own xz files.

    Spark has no xz writer. A task that is run again writes new names, and only
    the files of the tasks that finished are moved to their place at the end.
    """
    spark = lines.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    given = jvm.org.apache.hadoop.fs.Path(folder)
    folder = given.getFileSystem(conf).makeQualified(given).toString().rstrip("/")
    if folder.startswith("file:/") and not folder.startswith("file://"):
        folder = "file://" + folder[len("file:"):]
    staging = f"{folder}/_staging-{uuid.uuid4().hex}"

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow.fs as pafs

        store, root = pafs.FileSystem.from_uri(staging)
        store.create_dir(root, recursive=True)
        attempt = uuid.uuid4().hex
        current, stream, packer, done = None, None, None, []

        def close():
            if stream is not None:
                stream.write(packer.flush())
                stream.close()

        for batch in batches:
            groups = batch.groupby(by, sort=False) if by else [((), batch)]
            for key, rows in groups:
                if key != current or stream is None:
                    close()
                    name = f"part-{attempt}-{len(done)}.xz"
                    stream, packer = store.open_output_stream(f"{root}/{name}"), lzma.LZMACompressor()
                    current = key
                    target = "/".join(f"{c}={v}" for c, v in zip(by, key))
                    done.append((f"{target}/{name}" if target else name, name))
                stream.write(packer.compress("".join(v + "\n" for v in rows["value"]).encode("utf-8")))
        close()
        yield pd.DataFrame(done, columns=["target", "name"])

    ordered = lines.sortWithinPartitions(*by) if by else lines
    finished = settled(ordered.mapInPandas(pack, "target string, name string"))
    replaced = set()
    for row in finished.toLocalIterator():
        source = jvm.org.apache.hadoop.fs.Path(f"{staging}/{row['name']}")
        target = jvm.org.apache.hadoop.fs.Path(f"{folder}/{row['target']}")
        fs, parent = target.getFileSystem(conf), target.getParent()
        if parent.toString() not in replaced:
            replaced.add(parent.toString())
            for old in fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{parent.toString()}/part-*.xz")) or []:
                fs.delete(old.getPath(), False)
        fs.mkdirs(parent)
        if not fs.rename(source, target):
            raise OSError(f"{source.toString()} could not be moved to {target.toString()}; it is still there")
    # What is left was written by attempts that did not finish.
    rest = jvm.org.apache.hadoop.fs.Path(staging)
    rest.getFileSystem(conf).delete(rest, True)
