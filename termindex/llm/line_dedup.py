"""Line deduplication with keep bitmaps.

Lines are reduced to 128-bit hashes of their keys. The hashes are partitioned by
range with documents and positions as secondary order, so a line that a third of
all documents share is spread over as many slices as it needs. Each slice is
streamed once: the first document of a key inside the slice is a running first
value, and a table with two rows per slice tells which key began in an earlier
slice. What comes back is a bitmap per document, in 64-bit words that are listed
only where a line goes; texts are not moved to find them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termindex.llm.common import BLANKS, ascii_lower, order_id, read, texts
from termindex.operators.slices import SLICE, cut

MIN_KEY = 10
HASH = ["h1", "h2"]


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def _hashed_lines(docs: DataFrame, min_key: int) -> DataFrame:
    """(id, text_hash, pos, h1, h2) of each line whose key is long enough."""
    keys = F.transform(lines_of(F.col("text")), line_key)
    return (
        docs.select(order_id().alias("id"), F.xxhash64("text").alias("text_hash"),
                    F.posexplode(keys).alias("pos", "key"))
        .filter(F.char_length("key") >= min_key)
        .select("id", "text_hash", "pos", F.xxhash64("key").alias("h1"),
                F.xxhash64(F.lit(1), F.col("key")).alias("h2"))
    )


def dropped_lines(docs: DataFrame, min_key: int = MIN_KEY) -> DataFrame:
    """(id, text_hash, pos) of the lines that go: their key is first found in a smaller id."""
    sliced = cut(_hashed_lines(docs, min_key), HASH, ["id", "pos"])
    streamed = (
        Window.partitionBy(SLICE, *HASH).orderBy("id", "pos")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    # Two rows per slice: its first and its last key with the smallest id each has there.
    edges = sliced.groupBy(SLICE).agg(
        F.min(F.struct(*HASH, "id")).alias("lo"),
        F.max(F.struct(*HASH, F.bitwise_not("id").alias("id"))).alias("hi"))
    begun = (
        edges.select("lo.h1", "lo.h2", "lo.id")
        .union(edges.select("hi.h1", "hi.h2", F.bitwise_not("hi.id")))
        .groupBy(*HASH).agg(F.min("id").alias("begun"))
    )
    return (
        sliced.withColumn("first", F.first("id").over(streamed))
        .join(F.broadcast(begun), HASH, "left")
        .filter(F.col("id") > F.least("first", F.coalesce("begun", "first")))
        .select("id", "text_hash", "pos")
    )


def keep_bitmaps(docs: DataFrame, min_key: int = MIN_KEY) -> DataFrame:
    """(id, text_hash, keep): one row per document that loses a line.

    ``keep`` is a map from the word number (line number div 64) to 64 bits, bit
    ``line mod 64`` set where the line stays. Words that are not in the map keep
    all their lines. Documents that lose nothing have no row.
    """
    bit = F.expr("shiftleft(1L, pos % 64)")
    words = (
        dropped_lines(docs, min_key).groupBy("id", "text_hash", F.expr("pos div 64").cast("int").alias("word"))
        .agg(F.bitwise_not(F.bit_or(bit)).alias("bits"))
    )
    return words.groupBy("id", "text_hash").agg(
        F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("keep"))


def dedup_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                min_key: int = MIN_KEY) -> DataFrame:
    """All columns of ``docs`` with the remaining text in ``text_column``, plus ``n_lines`` and ``n_dropped``.

    A key is the line without blanks at both ends, A-Z in lower case. Keys of at
    least ``min_key`` code points found in at least two documents lose all their
    lines except in the smallest id that holds them.

    A null or empty text is one empty line and stays as it is (null stays null).
    Rows without an id count as one document with the largest id. Rows that
    repeat an id are parts of one document: a line they share among themselves
    is not a repetition. Nothing is dropped inside the first document. Columns
    named ``n_lines`` or ``n_dropped`` are replaced. An empty table gives none.
    """
    plain = texts(docs, id_column, text_column)
    extra = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    others = [F.col(f"`{c}`") for c in extra if c != text_column]
    whole = docs.select(F.struct(*others, F.col(text_column).isNull().alias("_null")).alias("row"),
                        F.col(id_column).cast("bigint").alias("doc_id"),
                        F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    joined = (
        whole.withColumn("id", order_id()).withColumn("text_hash", F.xxhash64("text"))
        .join(keep_bitmaps(plain, min_key), ["id", "text_hash"], "left")
        .withColumn("lines", lines_of(F.col("text")))
    )
    stays = F.filter("lines", lambda line, i: F.getbit(
        F.coalesce(F.try_element_at("keep", F.floor(i / 64).cast("int")), F.lit(-1)), F.pmod(i, F.lit(64))) == 1)
    done = joined.withColumn("kept", F.when(F.col("keep").isNull(), F.col("lines")).otherwise(stays))
    new_text = F.when(F.col("keep").isNotNull(), F.array_join("kept", "\n")).when(~F.col("row._null"), F.col("text"))
    return done.select(
        *[new_text.alias(c) if c == text_column else F.col(f"row.`{c}`").alias(c) for c in extra],
        F.size("lines").cast("bigint").alias("n_lines"),
        (F.size("lines") - F.size("kept")).cast("bigint").alias("n_dropped"))


def op9_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return dedup_lines(read(spark, sf, "documents")).select(
        "doc_id", "n_lines", "n_dropped",
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


SQL = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
owners AS (
  SELECT k, min(doc_id) AS owner FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
marked AS (
  SELECT keyed.*, owner IS NOT NULL AND keyed.doc_id > owner AS gone FROM keyed LEFT JOIN owners USING (k))
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
