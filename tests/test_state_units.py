"""Re-extraction in micro-batches: units that lose all symbols or all files."""

import os

import pytest
from pyspark.sql import functions as F

from termindex.streaming import state as st


def test_emptied_units_go(spark, tmp_path):
    corpus, target = str(tmp_path / "corpus"), str(tmp_path / "index")
    schema = "root_key string, path string, text string"
    extract = lambda units: units.filter("text <> ''").select("root_key", F.col("text").alias("name"))

    def put(rows):
        (spark.createDataFrame(rows, schema).write.mode("overwrite").option("partitionOverwriteMode", "static")
         .partitionBy("root_key").parquet(corpus))
        return spark.read.schema("path string, text string, root_key string").parquet(corpus)

    def touch(units, batch, *keys):
        events = spark.createDataFrame([(k, True) for k in keys], "root_key string, forced boolean")
        st.reindex_per_batch(units, extract, target)(events, batch)
        return sorted(tuple(r) for r in st.read_index(spark, target).select("root_key", "name").collect())

    units = put([("a", "1", "x"), ("b", "2", "y"), ("c=d%", "3", "z")])
    assert touch(units, 0, "a", "b", "c=d%") == [("a", "x"), ("b", "y"), ("c=d%", "z")]
    units = put([("a", "1", "x2"), ("b", "2", "")])
    assert touch(units, 1, "a", "b") == [("a", "x2"), ("c=d%", "z")]
    assert touch(units, 2, "c=d%") == [("a", "x2")]
    assert touch(units, 2, "c=d%") == [("a", "x2")]
    units = put([("b", "2", "")])
    assert touch(units, 3, "a") == []
    assert touch(put([("a", "1", "x4")]), 4, "a") == [("a", "x4")]


def _index(spark, target, **more):
    """Call with (batch, {unit: name}): events touch these units of a corpus that holds just them."""
    def run(number, names, fail=False):
        units = spark.createDataFrame([(k, "p", v) for k, v in names.items()], "root_key string, path string, name string")
        events = spark.createDataFrame([(k, True) for k in names], "root_key string, forced boolean")

        def extract(df):
            if fail:
                raise RuntimeError("stopped in the middle")
            return df.select("root_key", "name")

        st.reindex_per_batch(units, extract, target, **more)(events, number)
    return run


def _held(df):
    return sorted(tuple(r) for r in df.select("root_key", "name").collect())


def test_reader_in_the_middle_sees_the_old_catalogue(spark, tmp_path):
    target = str(tmp_path / "index")
    run = _index(spark, target)
    assert st.read_index(spark, target) is None
    run(0, {"a": "a0", "b": "b0"})
    reader = st.read_index(spark, target)
    with pytest.raises(RuntimeError):
        run(1, {"a": "a1", "b": "b1"}, fail=True)
    assert _held(st.read_index(spark, target)) == [("a", "a0"), ("b", "b0")]
    # A batch that has written its symbols and its list, but is not finished, is not seen.
    run(1, {"a": "a1"})
    os.remove(f"{target}/versions/1")
    assert _held(st.read_index(spark, target)) == [("a", "a0"), ("b", "b0")]
    run(1, {"a": "a1"})
    assert _held(st.read_index(spark, target)) == [("a", "a1"), ("b", "b0")]
    assert _held(reader) == [("a", "a0"), ("b", "b0")]


def test_repeated_batch_and_numbers_that_go_on(spark, tmp_path):
    target = str(tmp_path / "index")
    run = _index(spark, target)
    run(0, {"a": "a0"})
    before = sorted(os.listdir(f"{target}/data/batch=0"))
    run(0, {"a": "other"})
    assert sorted(os.listdir(f"{target}/data/batch=0")) == before and _held(st.read_index(spark, target)) == [("a", "a0")]
    _index(spark, target, first=st.index_version(spark, target) + 1)(0, {"a": "a1"})
    assert st.index_version(spark, target) == 1 and _held(st.read_index(spark, target)) == [("a", "a1")]


def test_folders_stay_bounded(spark, tmp_path):
    target = str(tmp_path / "index")
    run = _index(spark, target, most_batches=3)
    for number in range(9):  # each batch leaves one unit of its own, and all touch one
        run(number, {f"u{number}": f"n{number}", "all": f"n{number}"})
    assert _held(st.read_index(spark, target)) == [("all", "n8")] + [(f"u{k}", f"n{k}") for k in range(9)]
    assert len(os.listdir(f"{target}/data")) <= 2 * 3 + 2 and len([n for n in os.listdir(f"{target}/units")]) == 2
