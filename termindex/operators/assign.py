"""From matched symbols to groups: priority, rules, links, built-ins, counts."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termindex import rules as defaults
from termindex.operators.joins import lookup
from termindex.operators.render import chunk
from termindex.session import settled


def resolve_priority(tags: DataFrame, priorities: DataFrame) -> DataFrame:
    """A name with several kinds keeps the one earliest in the order string.

    ``tags(filetype, kind, name, prio)``. The best position is a plain minimum,
    combined before the shuffle; the kind follows from it.
    """
    best = tags.groupBy("filetype", "name").agg(F.min("prio").alias("prio"))
    return best.join(priorities, ["filetype", "prio"]).select("filetype", "kind", "name", "prio")


def apply_rules(tags: DataFrame, rules: DataFrame) -> DataFrame:
    """Attach group, borders, exclusions and keyword permission.

    A kind without a group is dropped; everything else has a default.
    """
    complete = rules.filter(F.col("group").isNotNull()).select(
        "filetype", "kind", "group",
        F.coalesce("prefix", F.lit(defaults.DEFAULT_PREFIX)).alias("prefix"),
        F.coalesce("suffix", F.lit(defaults.DEFAULT_SUFFIX)).alias("suffix"),
        F.coalesce("notin", F.expr("CAST(array() AS array<string>)")).alias("notin"),
        F.coalesce("allow_keyword", F.lit(1)).alias("allow_keyword"))
    return tags.join(complete, ["filetype", "kind"])


def resolve_links(links: DataFrame) -> DataFrame:
    """Follow group links to their end: (src, dst), however long the chain.

    Every round doubles the distance covered. Rounds end when no link moves on, or
    with the number that the longest possible chain needs. A group whose links run into a cycle has no end
    and no row.
    """
    links = settled(links.select("src", "dst"))
    reach = links
    for _ in range(math.ceil(math.log2(links.count() + 1))):
        onward = reach.select(F.col("src").alias("_at"), F.col("dst").alias("_to"))
        moved = settled(reach.join(onward, F.col("dst") == F.col("_at"), "left"))
        reach = moved.select("src", F.coalesce("_to", "dst").alias("dst"))
        if moved.filter("_to IS NOT NULL").isEmpty():
            break
    return reach.join(links.select(F.col("src").alias("dst")), "dst", "left_anti").select("src", "dst")


def restore_builtins(assigned: DataFrame, restored: DataFrame) -> DataFrame:
    """Names of built-in groups keep that group in their filetype.

    ``restored(filetype, group, name)``.
    """
    builtin = settled(restored.groupBy("filetype", "name").agg(F.min("group").alias("_builtin")))
    return (lookup(assigned, builtin, ["filetype", "name"], "left", salt_by=F.col("kind"))
            .withColumn("group", F.coalesce("_builtin", "group")).drop("_builtin"))


def group_members(tags: DataFrame, size: int = defaults.CHUNK_SIZE) -> DataFrame:
    """Sorted names of each group, as consecutive parts of at most ``size`` names (A3)."""
    parts = chunk(tags.select("filetype", "kind", "name").distinct(), ["filetype", "kind"], size)
    return parts.groupBy("filetype", "kind", "chunk").agg(
        F.array_sort(F.collect_list("name")).alias("members"))


def group_counts(tags: DataFrame) -> DataFrame:
    """Members per (filetype, kind), per filetype and in total (A4)."""
    return tags.rollup("filetype", "kind").agg(F.count(F.lit(1)).alias("n"))


def with_empty_groups(tags: DataFrame, priorities: DataFrame) -> DataFrame:
    """Members of every kind in the order, also of kinds without any (A5)."""
    counts = tags.groupBy("filetype", "kind").agg(F.count(F.lit(1)).alias("n"))
    return (priorities.join(counts, ["filetype", "kind"], "left")
            .select("filetype", "kind", "prio", F.coalesce("n", F.lit(0)).alias("n")))
