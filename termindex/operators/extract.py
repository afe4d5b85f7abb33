"""Building the catalogue from a corpus: which files, which symbols, which units."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termindex import rules as defaults


def extract_symbols(corpus: DataFrame, rules: Sequence[tuple[str, str, int, str]] | None = None,
                    language: str = "lang", keep: Sequence[str] = ()) -> DataFrame:
    """Symbols found by line rules: (name, file, kind, lang, line_no), line 1 first.

    ``rules`` are (language, line regex, capture group, kind). They become
    literal patterns of one projection over the lines of a text, tried only on
    lines of their language; nothing is shuffled. ``keep`` names further columns
    of the corpus to carry along.
    """
    rules = defaults.LINE_RULES if rules is None else list(rules)
    lines = corpus.select(
        *keep, F.col("path").alias("file"), F.col(language).alias("lang"),
        F.posexplode(F.split("text", "\n")).alias("_pos", "_line"))
    tried = [
        F.struct(F.when(F.lower("lang") == lang.lower(), F.regexp_extract("_line", regex, group))
                 .otherwise(F.lit("")).alias("name"), F.lit(kind).alias("kind"))
        for lang, regex, group, kind in rules
    ]
    return (
        lines.select(*keep, "file", "lang", (F.col("_pos") + 1).cast("bigint").alias("line_no"),
                     F.explode(F.filter(F.array(*tried), lambda t: t["name"] != "")).alias("_hit"))
        .select(*keep, F.col("_hit.name").alias("name"), "file", F.col("_hit.kind").alias("kind"),
                "lang", "line_no")
    )


def filter_ext(files: DataFrame, extensions: DataFrame, filetype: str = "filetype") -> DataFrame:
    """Keep files whose extension belongs to their filetype.

    A filetype without an extension list stands for an extension of its own name.
    """
    listed = extensions.select(F.col("filetype").alias("_ft")).distinct()
    known = extensions.select(F.col("filetype").alias("_ft2"), F.col("ext").alias("_ext2"))
    named = (files.withColumn("_ext", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)))
             .join(listed, F.col(filetype) == F.col("_ft"), "left"))
    own_name = F.col("_ft").isNull() & (F.col("_ext") == F.col(filetype))
    kept = named.join(known, (F.col(filetype) == F.col("_ft2")) & (F.col("_ext") == F.col("_ext2")), "left")
    return kept.filter(F.col("_ft2").isNotNull() | own_name).select(*files.columns)


def glob_pattern(globs: Iterable[str]) -> str:
    """One regex for file or directory names covered by any of the globs."""
    parts = ["".join(".*" if ch == "*" else "." if ch == "?" else re.escape(ch) for ch in g)
             for g in globs]
    return "(?:^|/)(?:" + "|".join(p.replace(".*", "[^/]*") for p in parts) + ")(?:/|$)"


def exclude_globs(files: DataFrame, globs: Iterable[str] | None = None) -> DataFrame:
    """Drop files with an excluded name or below a directory with one."""
    globs = defaults.EXCLUDED_GLOBS if globs is None else list(globs)
    return files.filter(~F.rlike("path", F.lit(glob_pattern(globs))))


def directory(path: Column | str) -> Column:
    return F.regexp_replace(path, r"/[^/]*$", "")


def scan_unit(files: DataFrame, norecurse: Iterable[str] | None = None, recursive: bool = True) -> DataFrame:
    """Indexing unit of each file, added as ``unit``.

    ``files(path, project)``: the file itself if its directory is not to be
    descended into or nothing is (``recursive`` off), else its project, else its
    directory.
    """
    if not recursive:
        return files.withColumn("unit", F.col("path"))
    norecurse = defaults.NORECURSE_DIRS if norecurse is None else list(norecurse)
    folder = F.when(directory("path") == "", F.lit("/")).otherwise(directory("path"))
    return files.withColumn(
        "unit", F.when(folder.isin(norecurse), F.col("path"))
        .otherwise(F.coalesce("project", folder)))


def units_to_index(units: DataFrame, manifest: DataFrame, force: bool = False) -> DataFrame:
    """Units that have no non-empty index yet; all of them if forced (E5).

    ``units(unit, run)``: a unit with ``run`` = 0 is never indexed.
    ``manifest(unit, size)``.
    """
    allowed = units.filter(F.coalesce("run", F.lit(1)) != 0)
    if force:
        return allowed
    return allowed.join(manifest.filter("size > 0"), "unit", "left_anti")
