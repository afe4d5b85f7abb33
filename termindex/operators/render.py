"""Bounded chunks of names and the text and fingerprint made from them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termindex import rules as defaults
from termindex.functions.text import escape_name
from termindex.operators.slices import cut, ranked, running_sum, spread_copies
from termindex.session import settled


def chunk(tags: DataFrame, group: Sequence[str], size: int = defaults.CHUNK_SIZE) -> DataFrame:
    """Number the names of each group and cut them into chunks of ``size``."""
    numbered = ranked(tags, group, ["name"], "_rank")
    return numbered.withColumn("chunk", F.expr(f"(_rank - 1) div {size}")).drop("_rank")


def _sorted_bag(df: DataFrame, columns: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rank of every row in the order, equal rows one after the other."""
    counted = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n"))
    for extra in [c for c in order if c not in columns]:
        counted = counted.withColumn(extra, F.length("name"))
    summed = running_sum(cut(counted, [], order), [], order, F.col("_n"), "_upto")
    copies = spread_copies(
        summed.select(*columns, (F.col("_upto") - F.col("_n")).alias("_base"), "_n"), "_n")
    return copies.select(*columns, (F.col("_base") + F.col("copy") + 1).alias("rank"))


def sort_tags_by_name(tags: DataFrame) -> DataFrame:
    """Catalogue in byte order of name, then kind, then file; adds ``rank``."""
    return _sorted_bag(tags, ["name", "kind", "file"], ["name", "kind", "file"])


def sort_tags_by_kind_and_length(tags: DataFrame) -> DataFrame:
    """Catalogue by kind, then length, then bytes; adds ``rank``."""
    return _sorted_bag(tags, ["kind", "name"], ["kind", "_length", "name"])


def order_groups(groups: DataFrame, priorities: DataFrame) -> DataFrame:
    """Groups of each filetype in order-string order; adds ``rank``.

    ``groups`` has one row per (filetype, kind).
    """
    return ranked(groups.join(priorities, ["filetype", "kind"]), [], ["filetype", "prio"])


def merge_exclusions(rules: DataFrame, common: Sequence[str] | None = None) -> DataFrame:
    """Add the common exclusions once to every rule that has its own."""
    common = defaults.GLOBAL_NOTIN if common is None else common
    merged = F.array_union("notin", F.array(*[F.lit(x) for x in common]))
    return rules.withColumn("notin", F.when(F.size("notin") > 0, merged).otherwise(F.col("notin")))


def matcher_form(notin: Column, prefix: Column, suffix: Column, allow_keyword: Column,
                 dotted: Column) -> Column:
    """``excluding``, ``keyword`` or ``match`` (R1); ``dotted``: some name has a dot."""
    plain = ((prefix == defaults.DEFAULT_PREFIX) & (suffix == defaults.DEFAULT_SUFFIX)
             & (allow_keyword == 1) & ~dotted)
    return F.when(F.size(notin) > 0, "excluding").when(plain, "keyword").otherwise("match")


def render(chunks: DataFrame, rules: DataFrame, separator: str = "|",
           escape: bool = False) -> DataFrame:
    """One row per chunk: form, text, exclusions and fingerprint.

    ``chunks(filetype, kind, group, chunk, name)``: the names of one chunk, at
    most the chunk size, meet in one row, and only then get their rule. A group
    without a rule (a restored built-in) has the default borders. A plain match
    is excluded from the common regions, one with exclusions of its own from what
    its rule lists, keywords from nothing. Fingerprints
    are taken from the names as they are, so escaping does not change them.
    """
    keys = ["filetype", "kind", "group", "chunk"]
    gathered = chunks.groupBy(*keys).agg(
        F.array_sort(F.collect_list("name")).alias("_names"),
        F.max(F.contains("name", F.lit("."))).alias("_dotted"))
    ruled = (
        gathered.join(rules.select("filetype", "kind", "group", "prefix", "suffix", "notin",
                                   "allow_keyword"), ["filetype", "kind", "group"], "left")
        .withColumn("prefix", F.coalesce("prefix", F.lit(defaults.DEFAULT_PREFIX)))
        .withColumn("suffix", F.coalesce("suffix", F.lit(defaults.DEFAULT_SUFFIX)))
        .withColumn("notin", F.coalesce("notin", F.expr("CAST(array() AS array<string>)")))
        .withColumn("allow_keyword", F.coalesce("allow_keyword", F.lit(1)))
        .withColumn("form", matcher_form(F.col("notin"), F.col("prefix"), F.col("suffix"),
                                         F.col("allow_keyword"), F.col("_dotted")))
    )
    shown = F.transform("_names", escape_name) if escape else F.col("_names")
    body = F.when(F.col("form") == "keyword", F.array_join(shown, " ")).otherwise(
        F.concat(F.col("prefix"), F.array_join(shown, separator), F.col("suffix")))
    return ruled.select(
        *keys, "form",
        F.size("_names").cast("bigint").alias("n"),
        body.alias("text"),
        F.when(F.col("form") == "match", ",".join(defaults.GLOBAL_NOTIN)).otherwise(
            F.array_join("notin", ",")).alias("excluded"),
        F.md5(F.array_join("_names", "\n")).alias("fingerprint"))


def fingerprint_tree(tags: DataFrame, group: Sequence[str], size: int = defaults.CHUNK_SIZE) -> DataFrame:
    """(group, level, node, n, digest): a hash tree over the sorted names of each group.

    The distinct names of a group, in byte order, are cut into chunks of ``size``. A node of level 0 is the md5 of
    the newline-joined names of its chunk, a node above the md5 of the newline-joined digests of up to
    ``size`` nodes below it; the last level of a group has one node. ``n`` counts the names below a node. No task
    joins more than ``size`` strings, and a name that is replaced in its place changes the nodes of one path.
    """
    named = chunk(tags.select(*group, "name").distinct(), group, size)
    level = settled(
        named.groupBy(*group, F.col("chunk").alias("node")).agg(
            F.md5(F.array_join(F.array_sort(F.collect_list("name")), "\n")).alias("digest"),
            F.count(F.lit(1)).alias("n")).withColumn("level", F.lit(0)), "leaves")
    columns = [*group, "level", "node", "n", "digest"]
    levels, depth = [level.select(*columns)], 0
    while level.agg(F.max("node")).first()[0]:
        depth += 1
        # Only groups of more than one node go on.
        wide = level.filter("node > 0").select(*[F.col(c).alias(f"_{c}_") for c in group]).distinct()
        same = F.lit(True)
        for c in group:
            same = same & F.col(c).eqNullSafe(F.col(f"_{c}_"))
        below = F.array_sort(F.collect_list(F.struct("node", "digest")))
        level = settled(
            level.join(wide, same, "left_semi")
            .groupBy(*group, F.expr(f"node div {size}").alias("node")).agg(
                F.md5(F.array_join(F.transform(below, lambda x: x["digest"]), "\n")).alias("digest"),
                F.sum("n").alias("n")).withColumn("level", F.lit(depth)), "level")
        levels.append(level.select(*columns))
    return reduce(DataFrame.unionByName, levels)


def group_fingerprint(tags: DataFrame, group: Sequence[str], size: int = defaults.CHUNK_SIZE) -> DataFrame:
    """One digest per group of names, whatever the size or order of the group (A6): the root of its hash tree.

    A group of at most ``size`` names has the md5 of its sorted, newline-joined names.
    """
    tree = fingerprint_tree(tags, group, size)
    return tree.groupBy(*group).agg(F.max_by(F.struct("n", "digest"), "level").alias("root")).select(
        *group, F.col("root.n").alias("n"), F.col("root.digest").alias("fingerprint"))


def changed_nodes(before: DataFrame, after: DataFrame, group: Sequence[str]) -> DataFrame:
    """(group, level, node) of two hash trees whose digests differ or that only one of them has."""
    keys = [*group, "level", "node"]
    told = [t.select(*keys, F.col("digest")) for t in (before, after)]
    return told[0].exceptAll(told[1]).unionByName(told[1].exceptAll(told[0])).select(*keys).distinct()
