"""The project registry: owner of a path, roots to scan, replay of a change log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termindex.operators.extract import directory
from termindex.operators.joins import lookup
from termindex.operators.slices import cut, running_last
from termindex.session import settled


def ancestors(path: Column | str) -> Column:
    """The path itself and every directory above it, without the root."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    return F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))),
        lambda n: F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), n), "/")))


def resolve_project(paths: DataFrame, registry: DataFrame) -> DataFrame:
    """Owner of each distinct path: the first registered base at or above it.

    ``registry(path, reg_seq)``; the result is (path, project), null if none.
    Paths are made distinct before they are unfolded. A base that many paths lie
    below is divided by path.
    """
    distinct = paths.select("path").distinct()
    bases = settled(registry.select(F.col("path").alias("base"), "reg_seq"))
    above = distinct.select("path", F.explode(
        F.array_union(F.array(F.lit("/")), ancestors("path"))).alias("base"))
    owned = lookup(above, bases, ["base"], salt_by=F.col("path"))
    first = owned.groupBy("path").agg(F.min_by("base", "reg_seq").alias("project"))
    return distinct.join(first, "path", "left")


def with_project(files: DataFrame, registry: DataFrame) -> DataFrame:
    """Add the owner of each file's directory as ``project``, null if none.

    ``files(path, ...)``. Owners are found once per directory; a directory with
    a large part of all files is divided by file.
    """
    placed = files.withColumn("_dir", directory("path"))
    owned = resolve_project(placed.select(F.col("_dir").alias("path")), registry)
    owned = settled(owned.select(F.col("path").alias("_dir"), "project"))
    return lookup(placed, owned, ["_dir"], "left", salt_by=F.col("path")).drop("_dir")


def project_roots(registry: DataFrame) -> DataFrame:
    """Directories to scan for each project: its own and its extra ones.

    ``registry(path, extra_dirs)`` with an array, or ``(path, dir)`` with one row
    per extra directory and null where there is none.
    """
    if "extra_dirs" in registry.columns:
        return registry.select("path", F.explode(
            F.concat(F.array("path"), F.coalesce("extra_dirs", F.expr("CAST(array() AS array<string>)"))))
            .alias("root"))
    own = registry.select("path", F.col("path").alias("root")).distinct()
    return own.unionByName(registry.filter("dir IS NOT NULL").select("path", F.col("dir").alias("root")))


def fold_registry(log: DataFrame) -> DataFrame:
    """Current registry after a change log: (path, reg_seq, run, dir).

    ``log(seq, op, path, arg)`` with ``add_project`` (arg: run flag),
    ``remove_project``, ``add_dir`` and ``remove_dir`` (arg: directory). One row
    per extra directory, one with a null ``dir`` for a project without any.

    A project lives from its first ``add`` to the next ``remove``; a directory
    change belongs to the first registered live project at or above its path at
    that moment. The log of one path may be a large part of the whole, so the
    looks back run over slices of the log.
    """
    is_dir = F.col("op").isin("add_dir", "remove_dir")
    projects = log.filter(~is_dir).select(F.col("path").alias("base"), "seq", "op", "arg")
    changes = log.filter(is_dir).select(
        F.explode(F.array_union(F.array(F.lit("/")), ancestors("path"))).alias("base"), "seq", "op", "arg")
    sliced = cut(projects.unionByName(changes), ["base"], ["seq"])

    project_op = F.when(F.col("op").isin("add_project", "remove_project"), F.col("op"))
    seen = running_last(sliced, ["base"], ["seq"], project_op, "_previous", with_current=False)
    starts = (F.col("op") == "add_project") & (
        F.col("_previous").isNull() | (F.col("_previous") == "remove_project"))
    marked = seen.withColumn("_mark", F.when(starts, F.col("seq")).when(
        F.col("op") == "remove_project", F.lit(-1).cast("bigint")))
    lived = settled(running_last(marked, ["base"], ["seq"], F.col("_mark"), "_live", with_current=True))

    current = (
        lived.filter("_mark IS NOT NULL").groupBy("base")
        .agg(F.max_by("_mark", "seq").alias("reg_seq"),
             F.max_by(F.when(F.col("_mark") >= 0, F.col("arg")), "seq").alias("run"))
        .filter("reg_seq >= 0")
        .select(F.col("base").alias("path"), "reg_seq", F.col("run").cast("int").alias("run"))
    )
    owner = (
        lived.filter(is_dir & (F.col("_live") >= 0)).groupBy("seq", "op", "arg")
        .agg(F.min(F.struct("_live", "base")).alias("_owner"))
    )
    dirs = (
        owner.groupBy(F.col("_owner.base").alias("path"), F.col("_owner._live").alias("reg_seq"),
                      F.col("arg").alias("dir"))
        .agg(F.max_by("op", "seq").alias("_last")).filter("_last = 'add_dir'").drop("_last")
    )
    return (current.join(dirs, ["path", "reg_seq"], "left")
            .select("path", "reg_seq", "run", "dir"))
