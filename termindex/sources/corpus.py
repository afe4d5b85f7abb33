"""Documents as rows: whole files or tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termindex.session import settled
from termindex.sources.manifest import open_store

FOLDER_FILES = 1000
PART_FILES, PART_BYTES = 20_000, 64 << 20  # read by a task
READ_BYTES = 16 << 20  # in a batch
OPENED = ("file",)  # schemes of which pyarrow names files as Hadoop does and every task sees the same
PACKED = r"\.(gz|bz2|deflate|snappy|lz4|zst|zstd|lzo|xz|passthrough)$"


def write_corpus(docs: DataFrame, folder: str, name: str, text: str) -> None:
    """One file ``<name>=<value>.txt`` for each value of the column, each of its texts with a line end behind it.

    Tasks write their own files, ``FOLDER_FILES`` to a folder, and nothing is moved at the end: a table of many
    documents costs the driver nothing and a store one file each. A value whose rows lie in several tasks has a file of
    each. ``folder`` is opened with ``pyarrow.fs``; a task that is run again writes folders of other names, and those of
    attempts that did not finish go.
    """
    path = docs.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(docs.sparkSession._jsc.hadoopConfiguration())
    files.mkdirs(path)
    root = files.makeQualified(path).toString()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, inner = open_store(root)
        attempt, count, now, out = uuid.uuid4().hex, 0, None, None
        for batch in batches:
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if out is None or key != now:
                    if out is not None:
                        out.close()
                    below = f"{inner}/{attempt}-{count // FOLDER_FILES}"
                    if count % FOLDER_FILES == 0:
                        store.create_dir(below, recursive=True)
                    now, out, count = key, store.open_output_stream(f"{below}/{name}={key}.txt"), count + 1
                out.write(((value or "") + "\n").encode())
        if out is not None:
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array([attempt]), pa.array([count], pa.int64())], names=["attempt", "files"])

    named = docs.select(F.coalesce(F.col(name).cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__")).alias("key"), text)
    done = {row["attempt"] for row in named.sortWithinPartitions("key").mapInArrow(write, "attempt string, files bigint").collect()}
    for below in files.listStatus(path):
        if below.getPath().getName().split("-")[0] not in done:
            files.delete(below.getPath(), True)


def _hidden(name: str) -> bool:
    """Names that Spark's readers pass over below a folder."""
    return name.startswith(".") or name.endswith("._COPYING_") or (name.startswith("_") and "=" not in name)


def _listed(batches: Iterator[pa.RecordBatch], recursive: bool) -> Iterator[pa.RecordBatch]:
    """(path, root, size): what lies in folders (path, root), hidden names left out; a folder has no size."""
    import pyarrow.fs as pafs

    for batch in batches:
        for folder, root in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            store, inner = open_store(root)
            own = folder if folder is not None else inner
            if store.get_file_info(own).type == pafs.FileType.File:
                found = [] if _hidden(own.rsplit("/", 1)[-1]) else [store.get_file_info(own)]
            else:
                found = [f for f in store.get_file_info(pafs.FileSelector(own, recursive=recursive))
                         if (recursive is False or f.type == pafs.FileType.File)
                         and not any(_hidden(p) for p in f.path[len(own):].split("/") if p)]
            for begin in range(0, len(found), 10_000):
                some = found[begin:begin + 10_000]
                sizes = [f.size if f.type == pafs.FileType.File else None for f in some]
                yield pa.RecordBatch.from_arrays([pa.array([f.path for f in some], pa.string()), pa.array([root] * len(some), pa.string()),
                                                  pa.array(sizes, pa.int64())], names=["path", "root", "size"])


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, data) of files (path, root); no batch is much larger than its largest file or ``READ_BYTES``."""
    stores, paths, data, size = {}, [], [], 0

    def read() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(data, pa.binary())], names=["path", "data"])

    for batch in batches:
        for path, root in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if root not in stores:
                stores[root] = open_store(root)[0]
            with stores[root].open_input_file(path) as file:
                data.append(file.read())
            paths.append(path)
            size += len(data[-1])
            if size >= READ_BYTES or len(data) >= FOLDER_FILES:
                yield read()
                paths, data, size = [], [], 0
    if data:
        yield read()


def _roots(spark: SparkSession, paths: list[str]) -> list[str] | None:
    """Files and folders that the patterns stand for, as URIs; None if there is one that tasks cannot open by themselves."""
    found = []
    for path in paths:
        below = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = below.getFileSystem(spark._jsc.hadoopConfiguration())
        if files.getUri().getScheme() not in OPENED:
            return None
        some = files.globStatus(files.makeQualified(below))
        if not some:
            return None  # Spark's reader tells what is missing
        found += [s.getPath().toUri().getPath() for s in some]
    return found


def read_corpus(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(doc_id, path, ext, text): one row per file, found recursively.

    The identifier is a hash of the path, so it is the same in every run. Files of a file system that all tasks can open
    are listed and read by tasks, many to each, so a corpus of many small files costs the driver no list. Of other stores,
    and of packed files, Spark's own reader makes the list.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    roots = _roots(spark, paths)
    if not roots:
        return _named(_by_spark(spark, paths))
    start = spark.createDataFrame([(None, root) for root in dict.fromkeys(roots)], "path string, root string")
    first = settled(start.repartition(len(set(roots))).mapInArrow(
        lambda b: _listed(b, False), "path string, root string, size bigint"), "listed")
    folders = first.filter("size IS NULL").select("path", "root")
    tasks = max(1, min(int(folders.count()), 16 * spark.sparkContext.defaultParallelism))
    below = folders.repartition(tasks).mapInArrow(lambda b: _listed(b, True), "path string, root string, size bigint")
    listed = first.union(below).filter("size > 0")  # Spark's reader gives no row for an empty file either
    listed = settled(listed if len(roots) == 1 else listed.dropDuplicates(["path"]), "listed")
    if not listed.filter(F.col("path").rlike(PACKED)).isEmpty():
        return _named(_by_spark(spark, paths))
    total = listed.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    parts = max(min(total[0], spark.sparkContext.defaultParallelism), total[0] // PART_FILES, total[1] // PART_BYTES, 1)
    files = listed.select("path", "root").repartition(int(parts), F.xxhash64("path"))
    return _named(files.mapInArrow(_contents, "path string, data binary").select("path", F.col("data").cast("string").alias("text")))


def _by_spark(spark: SparkSession, paths: list[str]) -> DataFrame:
    files = spark.read.text(paths, wholetext=True, recursiveFileLookup=True)
    # The scan gives a URI: drop scheme and authority, decode the rest ("+" is no blank in a path).
    bare = F.regexp_replace(F.col("_metadata.file_path"), r"^[A-Za-z0-9+.-]+:(?://[^/]*)?/*", "/")
    return files.select(F.url_decode(F.regexp_replace(bare, r"\+", "%2B")).alias("path"), F.col("value").alias("text"))


def _named(files: DataFrame) -> DataFrame:
    return files.select(
        F.xxhash64("path").alias("doc_id"), "path",
        F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("ext"), "text")
