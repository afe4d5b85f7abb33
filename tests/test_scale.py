"""Sliced windows, salted joins and digest trees give what the simple forms give."""

import hashlib

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from termindex.operators import joins, render, slices
from termindex.operators.match import present_tags


@pytest.fixture(scope="module")
def hot(spark):
    """A third of all rows in one group."""
    return spark.range(6000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 50)).alias("g"),
        F.md5(F.col("id").cast("string")).alias("name"), "id",
        F.when(F.col("id") % 7 == 0, F.col("id")).alias("v"))


def test_rank(spark, rows, hot):
    w = Window.partitionBy("g").orderBy("name")
    expected = hot.select("g", "name", F.row_number().over(w).alias("rank"))
    assert rows(slices.ranked(hot.select("g", "name"), ["g"], ["name"])) == rows(expected)


def test_rank_without_group(spark, rows, hot):
    got = [r["rank"] for r in slices.ranked(hot.select("name"), [], ["name"]).orderBy("name").collect()]
    assert got == list(range(1, 6001))


def test_slices_divide_a_hot_group(spark, hot):
    sizes = slices.cut(hot, ["g"], ["name"]).filter("g = 'hot'").groupBy("_slice").count().collect()
    assert len(sizes) >= 3 and max(r["count"] for r in sizes) < 1500


@pytest.mark.parametrize("with_current", [True, False])
def test_running_last(spark, rows, hot, with_current):
    w = Window.partitionBy("g").orderBy("name").rowsBetween(Window.unboundedPreceding, 0 if with_current else -1)
    expected = hot.select("g", "name", F.last("v", ignorenulls=True).over(w).alias("x"))
    sliced = slices.cut(hot, ["g"], ["name"])
    got = slices.running_last(sliced, ["g"], ["name"], F.col("v"), "x", with_current)
    assert rows(got.select("g", "name", "x")) == rows(expected)


def test_running_last_over_a_slice_without_values(spark):
    df = spark.range(1000).select(F.lit("g").alias("g"), "id", F.when(F.col("id") == 0, 5).alias("v"))
    got = slices.running_last(slices.cut(df, ["g"], ["id"]), ["g"], ["id"], F.col("v"), "x", True)
    assert got.filter("x = 5").count() == 1000


def test_running_sum(spark, rows, hot):
    w = Window.partitionBy("g").orderBy("name").rowsBetween(Window.unboundedPreceding, 0)
    value = F.when(F.col("id") % 5 == 0, 1).otherwise(0)
    expected = hot.select("g", "name", F.sum(value).over(w).alias("x"))
    got = slices.running_sum(slices.cut(hot, ["g"], ["name"]), ["g"], ["name"], value, "x")
    assert rows(got.select("g", "name", "x")) == rows(expected)


def test_copies(spark):
    df = spark.createDataFrame([("a", 150_000), ("b", 1), ("c", 65_536), ("d", 65_537)], "k string, n long")
    got = slices.spread_copies(df, "n").groupBy("k").agg(
        F.count("*"), F.min("copy"), F.max("copy"), F.countDistinct("copy")).orderBy("k").collect()
    assert [tuple(r) for r in got] == [
        (k, n, 0, n - 1, n) for k, n in [("a", 150_000), ("b", 1), ("c", 65_536), ("d", 65_537)]]


def test_bag_sort_with_hot_duplicates(spark, rows):
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "same").otherwise(F.concat(F.lit("n"), "id")).alias("name"),
        F.lit("f").alias("kind"), F.lit("x").alias("file"))
    w = Window.orderBy("name", "kind", "file")
    assert rows(render.sort_tags_by_name(df)) == rows(
        df.select("name", "kind", "file", F.row_number().over(w).alias("rank")))
    w = Window.orderBy("kind", F.length("name"), "name")
    assert rows(render.sort_tags_by_kind_and_length(df)) == rows(
        df.select("kind", "name", F.row_number().over(w).alias("rank")))


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join(spark, rows, hot, how):
    dim = spark.createDataFrame([("hot", 1), ("g1", 2), ("g2", 3), ("other", 4)], "g string, x int")
    small = joins.lookup(hot, dim, ["g"], how)
    salted = joins.lookup(hot, dim, ["g"], how, salt_by=F.col("id"), limit=0, heavy=100)
    assert rows(small.select(sorted(small.columns))) == rows(salted.select(sorted(salted.columns)))
    assert "BroadcastHashJoin" in small._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in salted._jdf.queryExecution().executedPlan().toString()


def test_present_tags_beyond_the_broadcast_bound(spark, rows, monkeypatch):
    tokens = spark.range(900).select(
        F.col("id").alias("doc_id"), F.lit("c").alias("filetype"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("n"), F.col("id") % 40)).alias("name"))
    tags = spark.range(30).select(F.lit("c").alias("filetype"), F.lit("f").alias("kind"),
                                  F.concat(F.lit("n"), "id").alias("name")).union(
        spark.createDataFrame([("c", "f", "hot"), ("c", "v", "hot")], "filetype string, kind string, name string"))
    small = rows(present_tags(tokens, tags))
    monkeypatch.setattr(joins.lookup, "__defaults__", ("inner", None, 0, 50))
    assert rows(present_tags(tokens, tags)) == small


def _root(names, size):
    """Root of the hash tree over sorted names, and all its nodes."""
    names, nodes, level, strings = sorted(set(names)), {}, 0, None
    strings = names
    while True:
        parts = [strings[i:i + size] for i in range(0, len(strings), size)]
        strings = [hashlib.md5("\n".join(p).encode()).hexdigest() for p in parts]
        nodes |= {(level, k): d for k, d in enumerate(strings)}
        if len(strings) == 1:
            return strings[0], nodes
        level += 1


@pytest.mark.parametrize("size", [3, 10, 2048])
def test_fingerprint_is_the_root_over_sorted_names(spark, size):
    groups = {"f": [f"n{i:04d}" for i in range(300)], "v": ["x", "w"], "one": ["a"], None: ["é", "b", "Z"], "full": list("abcdefghi")}
    df = spark.createDataFrame([("c", k, n) for k, names in groups.items() for n in [*names, names[0]]],
                               "filetype string, kind string, name string")
    tree = render.fingerprint_tree(df.repartition(5), ["filetype", "kind"], size).collect()
    assert {(r["kind"], r["level"], r["node"]): r["digest"] for r in tree} == {
        (k, *at): d for k, names in groups.items() for at, d in _root(names, size)[1].items()}
    got = {r["kind"]: (r["n"], r["fingerprint"]) for r in render.group_fingerprint(df, ["filetype", "kind"], size).collect()}
    assert got == {k: (len(names), _root(names, size)[0]) for k, names in groups.items()}


def test_replaced_name_changes_one_path(spark):
    def tree(names):
        df = spark.createDataFrame([("g", n) for n in names], "kind string, name string")
        return render.fingerprint_tree(df, ["kind"], 10)

    names = [f"n{i:04d}" for i in range(1000)]
    moved = render.changed_nodes(tree(names), tree([*names[:555], "n0555x", *names[556:]]), ["kind"])
    assert sorted((r["level"], r["node"]) for r in moved.collect()) == [(0, 55), (1, 5), (2, 0)]


def test_fingerprint_of_no_names(spark):
    none = spark.createDataFrame([], "kind string, name string")
    assert render.group_fingerprint(none, ["kind"]).collect() == []


def test_chunks_partition_a_group(spark, hot):
    parts = render.chunk(hot.select("g", "name"), ["g"], 100)
    assert parts.count() == 6000
    sizes = parts.groupBy("g", "chunk").count()
    assert sizes.filter("count > 100").count() == 0
    assert sizes.filter("g = 'hot'").count() == 20
