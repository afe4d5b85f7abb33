"""Which catalogue symbols occur in which documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termindex.operators.catalogue import has_special
from termindex.operators.corpus import by_key
from termindex.operators.joins import BROADCAST_BYTES, lookup, measured_bytes
from termindex.session import settled

DOC_HIT = ["doc_id", "filetype", "kind", "name"]


def present_tags(tokens: DataFrame, tags: DataFrame) -> DataFrame:
    """Catalogue symbols that occur in each document.

    ``tokens(doc_id, filetype, name)`` holds a name once per document and
    ``tags(filetype, kind, name)`` each symbol once, so the result has no
    repeats. A word that stands in very many documents is divided by document.
    """
    hits = lookup(tokens, settled(tags.select("filetype", "name", "kind").distinct()),
                  ["filetype", "name"], salt_by=F.col("doc_id"))
    return hits.select(*DOC_HIT)


def present_in_corpus(tokens: DataFrame, tags: DataFrame, filetype: str = "filetype") -> DataFrame:
    """Catalogue symbols that occur in any document of their filetype.

    While the catalogue's names are few enough to broadcast, tokens that are no
    symbol are dropped where they arise, and only symbols are shuffled. Either
    way the tokens become distinct names before the join, partly before the
    shuffle, so no word is more frequent than another when it runs.
    """
    keys = [filetype, "name"]
    tags = settled(tags)
    names = tags.select(*keys).distinct()
    words = tokens.select(*keys)
    if measured_bytes(names) <= BROADCAST_BYTES:
        words = words.join(F.broadcast(names), keys, "left_semi")
    return tags.join(words.distinct(), keys, "left_semi")


def present_or_same_file(tokens: DataFrame, corpus: DataFrame, tags: DataFrame) -> DataFrame:
    """As ``present_tags``, plus the symbols a document itself defines.

    Two equi-joins and a distinct over parts of bounded size, instead of one join with an OR. A file that
    defines a large part of all symbols is divided by symbol name.
    """
    by_name = present_tags(tokens, tags)
    places = settled(corpus.select("doc_id", "filetype", F.col("path").alias("file")))
    own = lookup(tags.select("filetype", "file", "kind", "name").distinct(), places,
                 ["filetype", "file"], salt_by=F.col("name"))
    return by_key(by_name.unionByName(own.select(*DOC_HIT)), DOC_HIT, corpus).distinct()


def present_or_special(tokens: DataFrame, corpus: DataFrame, tags: DataFrame) -> DataFrame:
    """As ``present_in_corpus``, plus names with ``$`` or ``.`` of the filetypes in use."""
    used = corpus.select("filetype").distinct()
    special = tags.filter(has_special("name")).join(used, "filetype", "left_semi")
    plain = present_in_corpus(tokens, tags.filter(~has_special("name")))
    return plain.unionByName(special)
