"""Documents: cleaning by language and token tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termindex.functions import text as tx
from termindex.operators.catalogue import first_part, identify_language
from termindex.operators.joins import measured_bytes

SPREAD_BYTES = 8 * 1024 * 1024
UNKNOWN_BYTES = 1 << 40  # Spark takes a table of unknown size to be larger than this


def spread(corpus: DataFrame) -> DataFrame:
    """Give a small corpus one partition per core; leave a large one as the scan cuts it.

    A few files with few row groups reach only a few tasks, and cleaning and
    tokenising are the costly steps. Moving the texts pays only while there is
    little to move, so a corpus with more than ``SPREAD_BYTES`` per core stays.
    """
    cores = corpus.sparkSession.sparkContext.defaultParallelism
    size = planned_bytes(corpus)
    return corpus.repartition(cores) if size is not None and size <= cores * SPREAD_BYTES else corpus


def planned_bytes(df: DataFrame) -> int | None:
    """What Spark takes the size of a table to be; None if no classic session is behind it."""
    try:
        return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except AttributeError:
        return None


def by_key(rows: DataFrame, keys: Sequence[str], corpus: DataFrame) -> DataFrame:
    """Rows made from the texts of a corpus, dealt out by key in parts that grow in number with it and not in size.

    An aggregation behind it holds the groups of one part. Without this, its first half holds the groups of a whole
    scan partition: for every word of every document many times what the texts take.
    """
    size = planned_bytes(corpus)
    if size is None or size > UNKNOWN_BYTES:  # no scan of files is below, so the rows are measured
        size = measured_bytes(corpus)
    parts = int(corpus.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(parts, -(-size // SPREAD_BYTES)), *keys)


def clean_corpus(corpus: DataFrame, languages: DataFrame, families: DataFrame,
                 enabled: bool = True, layout: bool = True) -> DataFrame:
    """Fold to ASCII and remove comments and strings where the language allows it.

    The first part of a compound filetype picks the language.
    """
    if not enabled:
        return corpus.withColumn("text", tx.ascii_fold("text"))
    typed = corpus.withColumn("_first", first_part("filetype"))
    known = identify_language(typed, languages, "_first", "_language")
    known = (known.join(families.select(F.col("language").alias("_language"), "family"), "_language", "left"))
    cleaned = (F.when(F.col("family") == "clike", tx.strip_code("text", "clike", layout))
               .when(F.col("family") == "python", tx.strip_code("text", "python", layout))
               .otherwise(tx.ascii_fold("text")))
    return known.withColumn("text", cleaned).select(*corpus.columns)


def tokenize(corpus: DataFrame, mode: str = "ident", distinct: bool = True,
             scoped: Sequence[str] = ()) -> DataFrame:
    """(doc_id, filetype, name); each name once per document unless told otherwise (K1-K3, A1).

    Documents whose first filetype part is in ``scoped`` have scoped names.
    Repeats are removed inside the row, before the array is unfolded.
    """
    found = tx.words("text", mode)
    if scoped:
        found = F.when(F.lower(first_part("filetype")).isin(list(scoped)), tx.words("text", "scoped")).otherwise(found)
    return corpus.select("doc_id", "filetype",
                         F.explode(F.array_distinct(found) if distinct else found).alias("name"))


def token_counts(corpus: DataFrame, mode: str = "ident") -> DataFrame:
    """(doc_id, name, n): how often each word is in each document (K1-K3).

    Counted inside the row: the words are sorted, and a word is as frequent as the next one's place is further on.
    Rows that repeat an id are one document.
    """
    words = corpus.select("doc_id", F.sort_array(tx.words("text", mode)).alias("_words"))
    place = F.transform("_words", lambda w, i: i)
    firsts = words.withColumn("_firsts", F.filter(
        place, lambda i: (i == 0) | (F.get("_words", i) != F.get("_words", i - 1))))
    counted = firsts.select("doc_id", F.inline(F.transform("_firsts", lambda i, k: F.struct(
        F.get("_words", i).alias("name"),
        (F.coalesce(F.get("_firsts", k + 1), F.size("_words")) - i).cast("bigint").alias("n")))))
    return by_key(counted, ["doc_id", "name"], corpus).groupBy("doc_id", "name").agg(F.sum("n").alias("n"))
