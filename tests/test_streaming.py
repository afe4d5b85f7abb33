"""Streams over several micro-batches, with a restart, equal their batch forms."""

import random
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from termindex.plans import bindings as b
from termindex.plans import registered
from termindex.session import new_folder
from termindex.streaming import events as ev
from termindex.streaming import gates, ordered
from termindex.streaming import state as st

SF = "/root/testdata/sf0.001"
PARTS = 6
EMITTED = ["event_id", "instance_id", "buffer_id", "fp"]


@pytest.fixture(scope="module")
def raw(spark):
    return b.read(spark, SF, "events")


@pytest.fixture(scope="module")
def slices(raw):
    """Events in consecutive pieces of time."""
    return [raw.filter(f"event_id div 170 = {i}") for i in range(PARTS)]


def feed(spark, slices, run):
    """Give the pieces one by one: three batches in a first run, the rest after a restart."""
    folder, progress = new_folder(spark, "in"), new_folder(spark, "progress")
    for number, piece in enumerate(slices):
        piece.coalesce(1).write.mode("append").parquet(folder)
        if number >= 2:
            run(ev.read_events(spark, folder, b.EVENT_SCHEMA, max_files=1), progress)


def same(rows, left, right):
    columns = sorted(right.columns)
    assert rows(left.select(columns)) == rows(right.select(columns))


def test_route(spark, rows, raw, slices):
    out = new_folder(spark, "out")
    feed(spark, slices, lambda s, p: st.run_to_table(b.routed(s), "r", p, out))
    same(rows, spark.read.parquet(out), b.routed(raw))


def test_first_seen(spark, rows, raw, slices):
    out = new_folder(spark, "out")
    feed(spark, slices, lambda s, p: st.run_to_table(ev.first_seen(b.routed(s)), "s", p, out))
    same(rows, spark.read.parquet(out), ev.first_seen(b.routed(raw)))


def test_first_seen_with_a_horizon(spark, rows, raw, slices):
    out = new_folder(spark, "out")
    feed(spark, slices, lambda s, p: st.run_to_table(ev.first_seen(b.routed(s), "400 days"), "s", p, out))
    same(rows, spark.read.parquet(out), ev.first_seen(b.routed(raw)))


def test_emit_on_change_stateful(spark, rows, raw, slices):
    out = new_folder(spark, "out")
    feed(spark, slices, lambda s, p: st.run_to_table(st.emit_on_change_stream(b.routed(s)), "e", p, out))
    same(rows, spark.read.parquet(out), ev.emit_on_change(b.routed(raw)))


def test_emit_on_change_by_batch(spark, rows, raw, slices):
    out, state = new_folder(spark, "out"), new_folder(spark, "state")
    feed(spark, slices, lambda s, p: st.run_steps(b.routed(s), st.emit_per_batch(out, state), "e", p))
    same(rows, spark.read.parquet(out).select(EMITTED), ev.emit_on_change(b.routed(raw)).select(EMITTED))


def test_gate_stateful(spark, rows, raw, slices):
    out = new_folder(spark, "out")
    feed(spark, slices, lambda s, p: st.run_to_table(st.enabled_gate_stream(b.routed(s, True)), "g", p, out))
    same(rows, spark.read.parquet(out), ev.enabled_gate(b.routed(raw, True)))


def test_gate_by_batch(spark, rows, raw, slices):
    out, state = new_folder(spark, "out"), new_folder(spark, "state")
    feed(spark, slices, lambda s, p: st.run_steps(b.routed(s, True), st.gate_per_batch(out, state), "g", p))
    columns = [*EMITTED, "epoch"]
    same(rows, spark.read.parquet(out).select(columns), ev.enabled_gate(b.routed(raw, True)).select(columns))


def test_repeated_batch_changes_nothing(spark, rows, raw, slices):
    out, state = new_folder(spark, "out"), new_folder(spark, "state")
    step = st.emit_per_batch(out, state)
    for number, piece in enumerate(slices[:3]):
        step(b.routed(piece), number)
        step(b.routed(piece), number)
    expected = ev.emit_on_change(b.routed(raw.filter("event_id < 510")))
    same(rows, spark.read.parquet(out).select(EMITTED), expected.select(EMITTED))


def test_latest_wins_per_batch(spark, rows, raw, slices):
    out = new_folder(spark, "out")
    feed(spark, slices, lambda s, p: st.run_steps(b.routed(s), st.latest_per_batch(out, []), "l", p))
    sliced = b.routed(raw).withColumn("slice", F.expr("event_id div 170"))
    same(rows, spark.read.parquet(out).select(EMITTED), ev.latest_wins(sliced, ["slice"]).select(EMITTED))


def test_reindex_replaces_only_touched_units(spark, rows):
    def index(number, text, target):
        units = spark.createDataFrame([("a", text), ("b", text)], "root_key string, path string")
        batch = spark.createDataFrame([("a", True), ("b", number == 0), ("b", False)], "root_key string, forced boolean")
        st.reindex_per_batch(units, lambda part: part, target)(batch, number)

    target = new_folder(spark, "index")
    index(0, "old", target)
    index(1, "new", target)
    index(1, "new", target)
    assert rows(st.read_index(spark, target).select("root_key", "path")) == [("a", "new"), ("b", "old")]


def test_hot_instance_in_batch_form(spark, rows, raw):
    """One instance holds most events; the sliced form equals a plain window."""
    from pyspark.sql import Window
    hot = b.routed(raw).withColumn("instance_id", F.when(F.col("event_id") % 3 > 0, 1).otherwise(F.col("instance_id")))
    w = Window.partitionBy("instance_id", "buffer_id").orderBy("ts", "event_id")
    last = F.lag("fp").over(w)
    expected = hot.withColumn("_l", last).filter("_l IS NULL OR _l <> fp OR forced").drop("_l")
    same(rows, ev.emit_on_change(hot), expected)


def made(spark, rows):
    """Events (event_id, seconds, instance, buffer, action, forced, fp)."""
    schema = "event_id long, s long, instance_id long, buffer_id int, action string, forced boolean, fp long"
    return spark.createDataFrame(rows, schema).select(
        "event_id", F.timestamp_seconds("s").alias("ts"), "instance_id", "buffer_id", "action", "forced", "fp")


def streamed(spark, batches, run):
    """Run a stream over the batches, one at a time; returns (output folder, checkpoint)."""
    folder, out, progress = new_folder(spark, "in"), new_folder(spark, "out"), new_folder(spark, "progress")
    for batch in batches:
        batch.coalesce(1).write.mode("append").parquet(folder)
        schema = ", ".join(f"{n} {t}" for n, t in batch.dtypes)
        st.run_to_table(run(ev.read_events(spark, folder, schema, max_files=1)), "r", progress, out)
    return out, progress


def some_events(n, seed, buffers=5, toggle=0.0, hot=0.5):
    """Half of all events in one instance; equal times, missing fingerprints."""
    rng = random.Random(seed)
    return [(k, rng.randrange(n // 3 + 1), 1 if rng.random() < hot else rng.randrange(2, 6), rng.randrange(buffers),
             "toggle" if rng.random() < toggle else "update", rng.random() < 0.05,
             None if rng.random() < 0.1 else rng.randrange(3)) for k in range(n)]


def test_hot_buffer_is_ordered_in_runs(spark, rows):
    """Runs of 100 rows: pages, merges of merges, and the same rows as the batch form."""
    events = made(spark, some_events(12_000, 1, buffers=1, hot=0.8))
    out, _ = streamed(spark, [events], lambda s: st.emit_on_change_stream(s, run_rows=100))
    same(rows, spark.read.parquet(out), ev.emit_on_change(events))


def test_gate_spreads_a_hot_instance_with_a_toggle_in_each_batch(spark, rows):
    pieces, events = [], some_events(4000, 2, buffers=40, toggle=0.01)
    events.sort(key=lambda e: (e[1], e[0]))
    for k in range(4):  # a day apart
        of = [(e, s + 86400 * k, *rest) for e, s, *rest in events[1000 * k:1000 * (k + 1)]]
        pieces.append([(-1, of[0][1], 1, 0, "toggle", False, 0), *of])
    out, progress = streamed(spark, [made(spark, p) for p in pieces], lambda s: st.enabled_gate_stream(s, run_rows=300))
    expected = ev.enabled_gate(made(spark, [e for p in pieces for e in p]))
    same(rows, spark.read.parquet(out), expected)
    keys = spark.read.format("statestore").option("stateVarName", "epoch").load(progress).select("key.*").collect()
    assert len([k for k in keys if k["instance_id"] == 1]) == st.SHARDS


def test_idle_buffer_leaves_the_state(spark):
    def at(*events):
        return made(spark, [(e, 10**6 + s, 1, buffer, "update", False, fp) for e, s, buffer, fp in events])

    def known(progress):
        df = spark.read.format("statestore").option("stateVarName", "last").load(progress)
        return sorted(r["buffer_id"] for r in df.select("key.buffer_id").collect())

    first, hour = at((1, 0, 1, 7), (2, 10, 2, 7)), 3600
    out, progress = streamed(spark, [first, at((3, 2 * hour, 2, 7))], lambda s: st.emit_on_change_stream(s, "1 hour", "1 second"))
    assert known(progress) == [2]
    out, progress = streamed(spark, [first, at((3, 2 * hour, 2, 7)), at((4, 2 * hour + 5, 1, 7), (5, 2 * hour + 6, 2, 7))],
                             lambda s: st.emit_on_change_stream(s, "1 hour", "1 second"))
    # Both had been idle for an hour when event 3 moved the watermark; event 3 itself met the old state.
    assert sorted(r["event_id"] for r in spark.read.parquet(out).collect()) == [1, 2, 4]
    out, progress = streamed(spark, [first, at((3, 2 * hour, 2, 7)), at((4, 2 * hour + 5, 1, 7))], st.emit_on_change_stream)
    assert sorted(r["event_id"] for r in spark.read.parquet(out).collect()) == [1, 2] and known(progress) == [1, 2]


class _Files:
    """A map state whose values lie on disk."""

    def __init__(self, folder):
        self.folder, self.held = folder, 0

    def updateValue(self, key, value):  # noqa: N802
        (self.folder / "-".join(map(str, key))).write_bytes(value[0])
        self.held += 1

    def getValue(self, key):  # noqa: N802
        return ((self.folder / "-".join(map(str, key))).read_bytes(),)

    def removeKey(self, key):  # noqa: N802
        (self.folder / "-".join(map(str, key))).unlink()
        self.held -= 1


def test_a_million_rows_of_one_key_in_a_fixed_memory(tmp_path):
    state = _Files(tmp_path)
    runs = ordered.Runs(SimpleNamespace(getMapState=lambda *a: state), ["ts", "event_id"])

    def pieces():
        draw = np.random.default_rng(1)
        for k in range(100):
            yield pd.DataFrame({"ts": pd.to_datetime(draw.integers(0, 10**9, 10_000), unit="s"),
                                "event_id": np.arange(10_000) + 10_000 * k, "fp": draw.integers(0, 9, 10_000)})

    tracemalloc.start()
    last, seen = None, 0
    for block in runs.ordered(pieces()):
        keys = block["ts"].to_numpy().astype("datetime64[s]").astype(np.int64) * 10**6 + block["event_id"].to_numpy()
        assert (np.diff(keys) > 0).all() and (last is None or last < keys[0])
        last, seen = keys[-1], seen + len(keys)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert seen == 1_000_000 and state.held == 0
    assert peak < 24 << 20, peak  # all rows take 24 MB as numbers alone, and several times that as one sorted frame


class _Counted:
    """A value or map state in memory that counts what it is asked."""

    def __init__(self):
        self.held, self.calls = {}, 0

    def __getattr__(self, name):
        def call(key=None, value=None):
            self.calls += 1
            if name in ("update", "updateValue"):
                self.held[key if value is not None else None] = value if value is not None else key
            return {"get": self.held.get(None), "getValue": self.held.get(key), "exists": bool(self.held),
                    "containsKey": key in self.held, "clear": self.held.clear() if name == "clear" else None}.get(name)
        return call


def test_a_key_with_toggles_only_is_cheap():
    """Each toggle goes to all shards of its instance: most keys have nothing else."""
    states = {}
    handle = SimpleNamespace(getValueState=lambda name, *a: states.setdefault(name, _Counted()),
                             getMapState=lambda name, *a: states.setdefault(name, _Counted()))
    shard = st._GatedShard(None, 1000)
    shard.init(handle)
    rows = pd.DataFrame({"event_id": [2, 1, 3], "ts": pd.to_datetime([5, 4, 6], unit="s"), "instance_id": 1, "buffer_id": 7,
                         "action": "toggle", "forced": False, "fp": 3})
    assert list(shard.handleInputRows((1, 0), iter([rows]), None)) == []  # no batch goes back for a key that emits nothing
    assert states["epoch"].held == {None: (3,)} and sum(s.calls for s in states.values()) <= 3


def test_many_small_buffers_share_keys(spark, rows):
    """Each buffer of each instance has its own memory, but is no key of its own; null instances are one instance, null buffers one buffer."""
    rng = random.Random(5)
    events = [(k, k // 2, None if k % 50 == 0 else rng.randrange(2000), None if k % 60 == 0 else rng.randrange(2), "update", rng.random() < 0.05,
               None if rng.random() < 0.2 else rng.randrange(3)) for k in range(12_000)]
    pieces = [made(spark, events[:7000]), made(spark, events[7000:])]
    out, progress = streamed(spark, pieces, lambda s: st.emit_on_change_stream(s, run_rows=20))
    same(rows, spark.read.parquet(out), ev.emit_on_change(made(spark, events)))
    state = spark.read.format("statestore").option("stateVarName", "last").load(progress)
    assert state.count() > 3000 and state.select("key").distinct().count() <= 3 * (st.BUFFER_SHARDS + 1)


def test_gate_of_many_instances_shares_keys(spark, rows):
    """An instance is no key of its own, and null instances are one instance beside all others."""
    rng = random.Random(6)
    events = [(k, k // 2, None if k % 50 == 0 else rng.randrange(-300, 600), rng.randrange(4), "toggle" if rng.random() < 0.1 else "update",
               rng.random() < 0.05, None if rng.random() < 0.2 else 2**62 + rng.randrange(3)) for k in range(12_000)]
    pieces = [made(spark, events[:7000]), made(spark, events[7000:])]
    out, progress = streamed(spark, pieces, lambda s: st.enabled_gate_stream(s, shards=2, run_rows=20))
    same(rows, spark.read.parquet(out), ev.enabled_gate(made(spark, events)))
    state = spark.read.format("statestore").option("stateVarName", "epoch").load(progress)
    assert 400 < state.select("key").distinct().count() <= 2 * (st.INSTANCE_KEYS + 1)


def test_pages_of_a_key_are_doubled(monkeypatch):
    """Few or many instances in a page: the same rows, and pages of bounded size."""
    held = []
    for most in (8, 10**6):
        monkeypatch.setattr(gates, "PAGE_INSTANCES", most)
        draw, states, out = np.random.default_rng(9), {}, []
        handle = SimpleNamespace(getValueState=lambda name, *a, of=states: of.setdefault(name, _Counted()),
                                 getMapState=lambda name, *a, of=states: of.setdefault(name, _Counted()))
        pages = gates._Pages(handle)
        for k in range(6):
            n = 400
            ids = np.sort(draw.integers(0, 200 if k else 3, n))
            no_print = draw.random(n) < 0.2
            places, epochs = pages.pass_through(ids, draw.random(n) < 0.05, draw.integers(0, 3, n), np.zeros(n, bool),
                                                np.where(no_print, 0, draw.integers(0, 3, n)), no_print, np.zeros(n, bool))
            out.append((places.tolist(), epochs.tolist()))
        held.append(out)
        sizes = [len(epochs) // 16 for epochs, _ in states["epoch"].held.values()]
        assert max(sizes) <= most and sum(sizes) == 200 and (len(sizes) > 16) == (most == 8)
    assert held[0] == held[1]


def test_registered_streams_name_their_batch_twin():
    for name in ("route_events", "first_seen", "emit_on_change", "enabled_gate", "latest_wins"):
        assert f"{name}_stream" in registered.QUERIES
