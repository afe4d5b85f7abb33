"""Occurrences with offsets, text regions, and filters by region or context."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from termindex import rules as defaults
from termindex.functions import text as tx
from termindex.functions.pieces import AROUND, Wanted, occurrences_in
from termindex.operators.joins import BROADCAST_BYTES, measured_bytes
from termindex.operators.slices import cut, running_max

# Regions of each family, in the order they are tried.
REGIONS = {
    "clike": [("String", tx.DOUBLE_QUOTED), ("String", tx.SINGLE_QUOTED),
              ("Comment", tx.LINE_COMMENT), ("Comment", tx.BLOCK_COMMENT)],
    "python": [("String", tx.TRIPLE_DOUBLE), ("String", tx.TRIPLE_SINGLE),
               ("String", tx.PY_DOUBLE), ("String", tx.PY_SINGLE),
               ("Comment", tx.HASH_COMMENT)],
    "markup": [("Comment", tx.MARKUP_COMMENT), ("String", tx.MARKUP_STRING)],
}
# Characters at which a region can begin.
REGION_STARTS = {"clike": "\"'/", "python": "\"'#", "markup": "<\""}
# How a region begins and its least length. A piece that begins
# with one of the characters above and is no region is that character alone.
OPENINGS = {
    "clike": [("String", '"', 1), ("String", "'", 2), ("Comment", "//", 2), ("Comment", "/*", 2)],
    "python": [("String", '"', 2), ("String", "'", 2), ("Comment", "#", 1)],
    "markup": [("Comment", "<!--", 2), ("String", '"', 2)],
}
# Rules that ask for a keyword before the name.
KEYWORDS = {"after_enum": "enum", "after_struct": "struct", "after_union": "union"}


def occurrences(corpus: DataFrame, extra: Sequence[str] = (), context: bool = False,
                names: DataFrame | None = None) -> DataFrame:
    """Every identifier with its offsets: (doc_id, name, start, end), end exclusive (K4).

    With ``context`` also what stands around it, null at the borders of the
    text: ``gap_before``, ``word_before``, ``gap_after``, ``word_after``.

    A settled table of ``names(filetype, name, after)`` says that a join with
    them and ``context_match`` follow: while they are few enough to broadcast,
    identifiers that are none of them, or do not stand after the word they must
    follow, are dropped where they arise. Texts are cut where they lie, without
    a shuffle.
    """
    wanted = None
    if names is not None and measured_bytes(names) <= BROADCAST_BYTES:
        wanted = Wanted.of(names.toArrow())
    rows = corpus.select("doc_id", *extra, "text")
    # The cut reads UTF-8; what is none is decoded and folded here.
    sound = rows.withColumn("text", F.when(F.is_valid_utf8("text"), F.col("text")).otherwise(tx.ascii_fold("text")))
    schema = StructType(rows.schema.fields[:-1]).add("name", "string").add("start", "long")
    for column in AROUND if context else ():
        schema = schema.add(column, "string")

    def run(batches):
        for batch in batches:
            yield from occurrences_in(batch, context, wanted)

    return sound.mapInArrow(run, schema.add("end", "long"))


def region_spans(corpus: DataFrame, family: str) -> DataFrame:
    """Strings and comments of each document: (doc_id, region, start, end)."""
    starts = REGION_STARTS[family]
    choices = [pattern for _, pattern in REGIONS[family]]
    tile = "|".join([*choices, f"{tx.latin_except(starts)}++", r"[\s\S]"])
    cells = tx.tiled(corpus.select("doc_id", "text"), "text", tile)
    pieces = cells.select("doc_id", F.inline(F.arrays_zip("_piece", "_start")).alias("piece", "start"))
    region = F.lit(None).cast("string")
    for name, opening, least in reversed(OPENINGS[family]):
        opened = F.startswith("piece", F.lit(opening)) & (F.length("piece") >= least)
        region = F.when(opened, name).otherwise(region)
    return (
        pieces.withColumn("region", region).filter("region IS NOT NULL")
        .select("doc_id", "region", "start", (F.col("start") + F.length("piece")).alias("end"))
    )


def region_excluded(region: Column | str, notin: Iterable[str]) -> Column:
    """Whether a region's name is matched as a whole by one of the patterns."""
    return F.rlike(region, F.lit("^(?:" + "|".join(notin) + r")\z"))


def mask_regions(occurrences: DataFrame, spans: DataFrame,
                 notin: Iterable[str] | None = None, slices: int | None = None) -> DataFrame:
    """Drop occurrences that lie inside an excluded region.

    A sweep over each document: regions and occurrences in order of their starts, a region before an occurrence
    at the same place. An occurrence lies inside some region exactly if the largest end of all regions that began
    up to it is not before its own end, so one running maximum answers it, however many regions overlap or nest.
    The order is cut into even slices, so a long document is divided over many tasks. Regions with the same
    start are one before the shuffle. Occurrences without a document or a place stay.
    """
    notin = defaults.GLOBAL_NOTIN if notin is None else list(notin)
    reach = (
        spans.filter(region_excluded("region", notin) & F.col("doc_id").isNotNull())
        .groupBy("doc_id", F.col("start").alias("_at")).agg(F.max("end").alias("_reach"))
        .withColumn("_is_place", F.lit(0))
    )
    columns = occurrences.columns
    placed = occurrences.withColumns({"_at": F.col("start"), "_is_place": F.lit(1)})
    order = ["_at", "_is_place"]
    swept = running_max(
        cut(placed.unionByName(reach, allowMissingColumns=True), ["doc_id"], order, slices),
        ["doc_id"], order, F.col("_reach"), "_furthest")
    inside = F.coalesce(F.col("_furthest") >= F.col("end"), F.lit(False))
    return swept.filter((F.col("_is_place") == 1) & ~inside).select(*[F.col(f"`{c}`") for c in columns])


def occurrences_outside(corpus: DataFrame, family: str,
                        notin: Iterable[str] | None = None) -> DataFrame:
    """Identifiers outside the excluded regions of their own document.

    If every region of the family is excluded, one pass over the text takes a
    region as a single piece, so no identifier inside it appears: no join and no
    shuffle. Otherwise the regions are found and masked by ``mask_regions``.
    """
    notin = defaults.GLOBAL_NOTIN if notin is None else list(notin)
    names = {name for name, _ in REGIONS[family]}
    matcher = re.compile("(?:" + "|".join(notin) + ")")
    if not all(matcher.fullmatch(name) for name in names):
        return mask_regions(occurrences(corpus), region_spans(corpus, family), notin)
    regions = [pattern for _, pattern in REGIONS[family]]
    tile = "|".join([*regions, tx.IDENT, f"{tx.latin_except(tx.LETTERS + REGION_STARTS[family])}++", r"[\s\S]"])
    cells = tx.tiled(corpus.select("doc_id", "text"), "text", tile)
    return (
        cells.select("doc_id", F.inline(F.arrays_zip("_piece", "_start")).alias("name", "start"))
        .filter(tx.starts_word("name"))
        .withColumn("end", F.col("start") + F.length("name"))
    )


def _member_before(access: str) -> Column:
    """The gap ends with an access operator that follows a word, ``]`` or ``)``."""
    gap, word = F.col("gap_before"), F.col("word_before")
    return (F.rlike(gap, F.lit(rf"[\])0-9](?:{access})\z"))
            | (F.rlike(gap, F.lit(rf"^(?:{access})\z")) & word.isNotNull()))


def _after_keyword(keyword: str) -> Column:
    """The keyword and exactly one white-space character stand before the name."""
    return (F.col("word_before") == keyword) & F.rlike("gap_before", F.lit(r"^\s\z"))


def _context(rule: str) -> Column:
    before, after = F.col("gap_before"), F.col("gap_after")
    after_def = (F.col("word_before") == "def") & F.rlike(before, F.lit(r"^\s+\z"))
    call = F.rlike(after, F.lit(r"^\s*\("))
    tests = {
        **{name: _after_keyword(keyword) for name, keyword in KEYWORDS.items()},
        "after_member_access": _member_before(r"\.|->"),
        "after_member_dot": _member_before(r"\."),
        "after_ampersand": F.rlike(before, F.lit(r"&\z")),
        "no_member_access_follows": ~F.coalesce(F.rlike(after, F.lit(r"^(?:\.|->)")), F.lit(False)),
        "call_follows": call,
        "parenthesis_follows": F.rlike(after, F.lit(r"^\(")),
        "call_or_func_assignment_follows": call | (
            F.rlike(after, F.lit(r"^\s*:?=\s*\z")) & F.startswith("word_after", F.lit("func"))),
        "after_dot_or_def": F.rlike(before, F.lit(r"\.\z")) | after_def,
        "not_after_def": ~F.coalesce(after_def, F.lit(False)),
        "perl_call": F.rlike(F.coalesce(before, F.lit("\n")), F.lit(r"[>\s&]\z")) & ~F.coalesce(
            (F.col("word_before") == "sub") & F.rlike(before, F.lit(r"^\s\*\z")), F.lit(False)),
        "vim_command": F.rlike(F.coalesce(before, F.lit("\n")), F.lit(r"\s:?\z")) & F.rlike(
            F.coalesce(after, F.lit("\n")), F.lit(r"^!?\s|^!\z")),
    }
    return tests[rule]


def with_keywords(kinds: DataFrame, rules: Sequence[tuple[str, str, str]] | None = None) -> DataFrame:
    """(filetype, name, after): the keyword an occurrence must follow to fit the rule of its kind, else null."""
    after = F.lit(None).cast("string")
    for filetype, kind, rule in reversed(defaults.CONTEXT_RULES if rules is None else rules):
        is_kind = (F.col("filetype") == filetype) & (F.col("kind") == kind)
        after = F.when(is_kind, F.lit(KEYWORDS.get(rule)).cast("string")).otherwise(after)
    return kinds.select("filetype", "name", after.alias("after"))


def context_match(occurrences: DataFrame, rules: Sequence[tuple[str, str, str]] | None = None) -> DataFrame:
    """Keep occurrences whose surroundings fit the rule of their (filetype, kind).

    Kinds without a rule stay. Each rule is a predicate on the neighbouring
    pieces with literal patterns, so every pattern is compiled once.
    """
    rules = defaults.CONTEXT_RULES if rules is None else rules
    fits = None
    for filetype, kind, rule in rules:
        is_kind = (F.col("filetype") == filetype) & (F.col("kind") == kind)
        test = F.coalesce(_context(rule), F.lit(False))
        fits = F.when(is_kind, test) if fits is None else fits.when(is_kind, test)
    return occurrences if fits is None else occurrences.filter(fits.otherwise(F.lit(True)))
