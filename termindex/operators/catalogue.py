"""The tag catalogue: parsing, language and kind handling, filters, sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termindex import rules
from termindex.functions.keys import language_family
from termindex.operators.joins import lookup
from termindex.session import settled


def parse_tags(lines: DataFrame, value: str = "value") -> DataFrame:
    """Tag lines -> (name, file, pattern, kind, lang); absent parts are null.

    After the first three fields the last one-character field is the kind and
    the last ``language:`` field the language, so TABs inside the pattern do no
    harm.
    """
    fields = F.split(value, "\t")
    rest = F.slice(fields, 4, F.greatest(F.size(fields) - 3, F.lit(0)))
    kind = F.try_element_at(F.filter(rest, lambda x: F.length(x) == 1), F.lit(-1))
    lang = F.try_element_at(F.filter(rest, lambda x: F.startswith(x, F.lit("language:"))), F.lit(-1))
    return lines.select(
        F.get(fields, F.lit(0)).alias("name"),
        F.get(fields, F.lit(1)).alias("file"),
        F.get(fields, F.lit(2)).alias("pattern"),
        kind.alias("kind"),
        F.substring(lang, 10, 2147483647).alias("lang"),
    )


def valid_tags(parsed: DataFrame) -> DataFrame:
    """Drop header lines and rows without kind or language (F2)."""
    return parsed.filter(
        ~F.startswith("name", F.lit("!")) & F.col("kind").isNotNull() & F.col("lang").isNotNull())


def normalize_language(df: DataFrame, language_map: DataFrame, filetype: str = "filetype",
                       out: str = "language") -> DataFrame:
    """Filetype -> indexer language; an unmapped filetype passes through."""
    names = language_map.select(F.col("filetype").alias(filetype), F.col("ctags_lang").alias("_mapped"))
    return (df.join(names, filetype, "left")
            .withColumn(out, F.coalesce("_mapped", filetype)).drop("_mapped"))


def filetype_of_language(df: DataFrame, language_map: DataFrame, language: str = "lang",
                         out: str = "filetype") -> DataFrame:
    """Indexer language -> filetypes, lower-cased when unmapped (P8, other direction)."""
    names = language_map.select(F.col("ctags_lang").alias(language), F.col("filetype").alias("_mapped"))
    return (df.join(names, language, "left")
            .withColumn(out, F.coalesce("_mapped", F.lower(language))).drop("_mapped"))


def identify_language(df: DataFrame, languages: DataFrame, filetype: str = "filetype",
                      out: str = "language") -> DataFrame:
    """Known language of a filetype, whatever its case, else ``unknown``."""
    known = languages.select(F.col("filetype").alias("_known"), F.col("language").alias("_lang"))
    return (df.join(known, F.lower(filetype) == F.col("_known"), "left")
            .withColumn(out, F.coalesce("_lang", F.lit("unknown"))).drop("_known", "_lang"))


def first_part(filetype: Column | str) -> Column:
    """The part of a compound filetype that picks the language (P10)."""
    return F.get(F.split(F.lower(filetype), r"\."), F.lit(0))


def split_filetype(df: DataFrame, filetype: str = "filetype") -> DataFrame:
    """Parts of a compound filetype: adds (part_no, part); part 0 picks the language (P10)."""
    return df.select("*", F.posexplode(F.split(F.lower(filetype), r"\.")).alias("part_no", "part"))


def remap_kind(tags: DataFrame, equivalents: DataFrame) -> DataFrame:
    """Replace a kind by its equivalent for the filetype, once."""
    pairs = equivalents.select("filetype", F.col("kind_from").alias("kind"), "kind_to")
    return (tags.join(pairs, ["filetype", "kind"], "left")
            .withColumn("kind", F.coalesce("kind_to", "kind")).drop("kind_to"))


def in_order(tags: DataFrame, priorities: DataFrame) -> DataFrame:
    """Keep kinds of the filetype's order string; adds ``prio``."""
    return tags.join(priorities, ["filetype", "kind"])


def match_language(tags: DataFrame, filetypes: DataFrame, language_map: DataFrame) -> DataFrame:
    """Give each tag the filetypes its language serves.

    ``filetypes`` has one row per filetype in use. C and C++ serve each other.
    """
    wanted = (normalize_language(filetypes.select("filetype").distinct(), language_map)
              .select("filetype", language_family("language").alias("_family")))
    return (tags.withColumn("_family", language_family("lang"))
            .join(wanted, "_family").drop("_family"))


def drop_ignored_tags(tags: DataFrame, ignored: DataFrame) -> DataFrame:
    """Drop names on the filetype's ignore list."""
    return tags.join(ignored, ["filetype", "name"], "left_anti")


def drop_ignored_filetypes(corpus: DataFrame, ignore: list[str] | None = None) -> DataFrame:
    """Drop documents without a filetype or with an ignored one (F1)."""
    ignore = rules.IGNORED_FILETYPES if ignore is None else ignore
    return corpus.filter((F.col("filetype") != "") & ~F.col("filetype").isin(ignore))


def has_special(name: Column | str) -> Column:
    """Names no tokeniser can produce."""
    return F.rlike(name, F.lit("[$.]"))


def ascii_only(name: Column | str) -> Column:
    """Names with other characters can never match a folded document.

    Told by the byte count: Catalyst copies the filter of one join side to the
    other, where it runs for every token.
    """
    return F.octet_length(name) == F.length(name)


def distinct_tags(tags: DataFrame) -> DataFrame:
    """Each (filetype, kind, name) once, over all files (A2)."""
    return tags.select("filetype", "kind", "name").distinct()


def union_tags(*catalogues: DataFrame) -> DataFrame:
    """All rows of several catalogues."""
    return reduce(DataFrame.unionByName, catalogues)


def tags_by_document_type(tags: DataFrame, types: DataFrame, priorities: DataFrame,
                          equivalents: DataFrame, language_map: DataFrame,
                          ignored: DataFrame | None = None) -> DataFrame:
    """As ``applicable_tags`` for the filetypes of documents, also compound ones (P10).

    ``types(filetype)``. The first part picks the tags by language; every part
    with an order contributes kinds and is the ``filetype`` of its rows, beside
    the ``document_type`` they serve.
    """
    parts = split_filetype(types.select(F.lower("filetype").alias("filetype")).distinct()).select(
        F.col("filetype").alias("document_type"), first_part("filetype").alias("_first"),
        F.col("part").alias("filetype")).distinct()
    wanted = normalize_language(parts, language_map, "_first").select(
        "document_type", "filetype", language_family("language").alias("_family"))
    # Few families, so a shuffled join would have few, very large keys.
    usable = lookup(tags.filter(ascii_only("name")).withColumn("_family", language_family("lang")),
                    settled(wanted), ["_family"], salt_by=F.col("name")).drop("_family")
    usable = in_order(remap_kind(usable, equivalents), priorities)
    return usable if ignored is None else drop_ignored_tags(usable, ignored)


def applicable_tags(tags: DataFrame, priorities: DataFrame, equivalents: DataFrame,
                    language_map: DataFrame, ignored: DataFrame | None = None) -> DataFrame:
    """Tags usable for each filetype with an order: language, kind remap, order, ignore list.

    Adds ``filetype`` and ``prio``; filters come before anything that shuffles.
    """
    usable = match_language(tags.filter(ascii_only("name")), priorities, language_map)
    usable = in_order(remap_kind(usable, equivalents), priorities)
    return usable if ignored is None else drop_ignored_tags(usable, ignored)
