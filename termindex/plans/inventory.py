"""The whole chain: from documents and a catalogue to the matcher table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termindex import config as cfg
from termindex import rules as defaults
from termindex.functions.keys import local_name
from termindex.operators.assign import apply_rules, resolve_priority, restore_builtins
from termindex.operators.catalogue import drop_ignored_filetypes, has_special, tags_by_document_type
from termindex.operators.corpus import clean_corpus, tokenize
from termindex.operators.joins import lookup
from termindex.operators.match import present_in_corpus
from termindex.operators.render import chunk, merge_exclusions, render
from termindex.session import settled


@dataclass
class Settings:
    """Configuration tables of a run; replace any of them."""

    priorities: DataFrame
    equivalents: DataFrame
    rules: DataFrame
    language_map: DataFrame
    languages: DataFrame
    families: DataFrame
    ignored: DataFrame | None = None
    restored: DataFrame | None = None
    strip: bool = True
    chunk_size: int = defaults.CHUNK_SIZE
    separator: str = "|"
    token_mode: str = "ident"
    scoped: tuple[str, ...] = defaults.SCOPED_FILETYPES
    same_file: bool = False  # also symbols that a document's own file defines
    special: bool = False  # also names that no tokeniser can produce

    @classmethod
    def default(cls, spark: SparkSession) -> Settings:
        return cls(
            priorities=cfg.kind_priority(cfg.orders(spark)),
            equivalents=cfg.equivalents(spark),
            rules=merge_exclusions(cfg.group_rules(spark)),
            language_map=cfg.language_map(spark),
            languages=cfg.languages(spark),
            families=cfg.comment_families(spark),
        )


def present_symbols(corpus: DataFrame, tags: DataFrame, settings: Settings) -> DataFrame:
    """(filetype, kind, name, prio): each present symbol with the kind that wins.

    ``filetype`` is a part of the documents' filetype that has a kind order.
    """
    documents = drop_ignored_filetypes(corpus)
    usable = tags_by_document_type(tags, documents, settings.priorities, settings.equivalents,
                                   settings.language_map, settings.ignored)
    tokens = tokenize(clean_corpus(documents, settings.languages, settings.families,
                                   settings.strip, layout=False), settings.token_mode, scoped=settings.scoped)
    tokens = tokens.select(F.lower("filetype").alias("document_type"), "name")
    columns = ["document_type", "filetype", "kind", "name", "prio"]
    symbols = usable.select(*columns).distinct()
    present = present_in_corpus(tokens, symbols, "document_type")
    if settings.special:
        present = present.unionByName(symbols.filter(has_special("name"))).distinct()
    if settings.same_file:
        places = settled(documents.select(F.lower("filetype").alias("document_type"), F.col("path").alias("file")).distinct())
        own = lookup(usable.select(*columns, "file").distinct(), places, ["document_type", "file"], "left_semi",
                     salt_by=F.col("name"))
        present = present.unionByName(own.select(*columns)).distinct()
    if settings.scoped:  # functions are shown by their local names
        shown = F.when(F.col("filetype").isin(list(settings.scoped)), local_name("name", "kind")).otherwise(F.col("name"))
        present = present.withColumn("name", shown).distinct()
    return resolve_priority(present, settings.priorities)


def build_matchers(corpus: DataFrame, tags: DataFrame, settings: Settings) -> DataFrame:
    """Matcher table: (filetype, kind, group, chunk, form, n, text, excluded, fingerprint)."""
    grouped = apply_rules(present_symbols(corpus, tags, settings), settings.rules).select(
        "filetype", "kind", "name", "group")
    if settings.restored is not None:
        grouped = restore_builtins(grouped, settings.restored)
    pieces = chunk(grouped, ["filetype", "kind", "group"], settings.chunk_size)
    return render(pieces, settings.rules, settings.separator)
