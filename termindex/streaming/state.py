"""Stateful streams: what has to be emitted, given what was emitted before."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from termindex.operators.joins import lookup
from termindex.session import new_folder, settled
from termindex.streaming.events import ORDER, emit_on_change, enabled_gate, last_prints, latest_wins
from termindex.streaming.gates import PACKED, GatedShards, packing
from termindex.streaming.ordered import RUN_ROWS, Runs

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


PRUNED_KEYS = 1000
SHARDS = 16
BUFFER_SHARDS = 256
NO_BUFFER = BUFFER_SHARDS + 1
INSTANCE_KEYS = 251  # a prime: numbers of instances with a step between them leave no keys empty
MOST_BATCHES = 32


def keep_state_on_disk(spark: SparkSession) -> None:
    """State of many buffers does not fit in executor memory; keyed state needs RocksDB."""
    spark.conf.set(PROVIDER, ROCKSDB)


class _Idle:
    """Forget a key's prints when nothing has come for a while of event time; never, without a time."""

    def __init__(self, handle: StatefulProcessorHandle, idle_ms: int | None):
        self._handle, self._idle_ms = handle, idle_ms
        self._due = handle.getValueState("due", "due bigint") if idle_ms else None

    def seen(self, last: pd.Timestamp) -> None:
        """Move the key's timer to its last event."""
        if self._idle_ms:
            due = int(last.value // 1_000_000) + self._idle_ms
            if self._due.exists():
                before = self._due.get()[0]
                if before >= due:
                    return
                self._handle.deleteTimer(before)
            self._due.update((due,))
            self._handle.registerTimer(due)

    def over(self) -> None:
        self._due.clear()


class _ChangedBuffer(StatefulProcessor):
    """State of a buffer: its last fingerprint, until it has been idle for long enough."""

    def __init__(self, idle_ms: int | None, run_rows: int):
        self._idle_ms, self._run_rows = idle_ms, run_rows

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._last = handle.getValueState("last", "fp bigint")
        self._runs = Runs(handle, ORDER, self._run_rows)
        self._idle = _Idle(handle, self._idle_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = self._last.get()[0] if self._last.exists() else None
        at = None
        for block in self._runs.ordered(rows):
            before = block["fp"].ffill().shift()
            if last is not None:
                before.iloc[0] = last
                before = before.ffill()
            known = block["fp"].dropna()
            last = int(known.iloc[-1]) if len(known) else last
            at = block["ts"].iloc[-1]
            yield block[before.isna() | (block["fp"].notna() & (before != block["fp"])) | block["forced"]]
        if last is not None:
            self._last.update((last,))
        if at is not None:
            self._idle.seen(at)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._last.clear()
        self._idle.over()
        yield pd.DataFrame()

    def close(self) -> None:
        pass


class _ChangedBuffers(StatefulProcessor):
    """State of a buffer number in a shard of the instances: the last fingerprint by instance, for good."""

    def __init__(self, run_rows: int):
        self._run_rows = run_rows

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._last = handle.getMapState("last", "instance_id bigint", "fp bigint")
        self._runs = Runs(handle, ["instance_id", *ORDER], self._run_rows)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        missing = {c: None for c, is_null in (("instance_id", key[1] % NO_BUFFER == BUFFER_SHARDS),
                                              ("buffer_id", key[1] >= NO_BUFFER)) if is_null}
        known = self._last.exists()
        open_, stored, last = None, None, None  # the instance whose rows may go on in the next block
        for block in self._runs.ordered(rows):
            ids = block["instance_id"].to_numpy()
            fp, has = block["fp"].to_numpy(), block["fp"].notna().to_numpy()
            first = np.flatnonzero(np.diff(ids, prepend=ids[0] - 1))
            begins = np.repeat(first, np.diff(first, append=len(ids)))
            filled = np.maximum.accumulate(np.where(has, np.arange(len(ids)), -1))  # the last row with a fingerprint
            before = np.concatenate([[-1], filled[:-1]])
            unknown = before < begins  # nothing ahead of it in this block
            emits = block["forced"].to_numpy(dtype=bool) | (~unknown & has & (fp != fp[before]))
            ends = np.append(first[1:], len(ids))
            for begin, end in zip(first.tolist(), ends.tolist(), strict=True):
                instance = (int(ids[begin]),)
                if instance != open_:
                    self._remember(open_, stored, last)
                    found = self._last.getValue(instance) if known else None
                    open_, stored, last = instance, found and found[0], found and found[0]
                k = begin
                while k < end and unknown[k]:
                    emits[k] |= last is None or (has[k] and fp[k] != last)
                    k += 1
                if filled[end - 1] >= begin:
                    last = int(fp[filled[end - 1]])
            yield block[emits].drop(columns="_shard", errors="ignore").assign(**missing)
        self._remember(open_, stored, last)

    def _remember(self, instance: tuple | None, stored: int | None, last: int | None) -> None:
        if last != stored:
            self._last.updateValue(instance, (last,))

    def close(self) -> None:
        pass


class _GatedShard(StatefulProcessor):
    """State of a shard of an instance: its toggles so far and the last fingerprint of each of its buffers.

    Most keys have few rows, many of them nothing but toggles, so a block is one plain loop that asks the state for
    no more than it needs.
    """

    def __init__(self, idle_ms: int | None, run_rows: int):
        self._idle_ms, self._run_rows = idle_ms, run_rows

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._epoch = handle.getValueState("epoch", "epoch bigint")
        self._last = handle.getMapState("last", "buffer_id int", "fp bigint")
        self._runs = Runs(handle, ORDER, self._run_rows)
        self._idle = _Idle(handle, self._idle_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        at = None
        for block in self._runs.ordered(rows):
            at = block["ts"].iloc[-1]
            places, epochs = self._emitted(*(block[c].tolist() for c in ("action", "buffer_id", "fp", "forced")))
            if places:
                yield block.take(places).drop(columns="_shard", errors="ignore").assign(epoch=epochs)
        if at is not None:
            self._idle.seen(at)

    def _emitted(self, actions: list, buffers: list, prints: list, forced: list) -> tuple[list[int], list[int]]:
        """The places of the rows that emit, and their epochs."""
        state = self._epoch.get()
        start = epoch = state[0] if state else 0
        held = self._last.exists()
        stored: dict[int, int | None] = {}
        known: dict[int, int | None] = {}
        places, epochs = [], []
        for k, (action, buffer, fp) in enumerate(zip(actions, buffers, prints, strict=True)):
            if action == "toggle":
                epoch += 1
                known = {}  # nothing is remembered across a toggle
            elif epoch % 2 == 0:
                has = not pd.isna(fp)
                if pd.isna(buffer):
                    before = None  # no buffer, so nothing is known of it
                else:
                    if buffer not in known:
                        found = self._last.getValue((int(buffer),)) if held and epoch == start else None
                        known[buffer] = stored[buffer] = found[0] if found else None
                    before = known[buffer]
                    if has:
                        known[buffer] = fp
                if before is None or forced[k] or (has and fp != before):
                    places.append(k)
                    epochs.append(epoch)
        if epoch != start:
            if held:
                self._last.clear()
            self._epoch.update((epoch,))
        for buffer, fp in known.items():
            if fp is not None and (epoch != start or fp != stored[buffer]):
                self._last.updateValue((int(buffer),), (int(fp),))
        return places, epochs

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._last.clear()  # whether the instance is switched on stays known
        self._idle.over()
        yield pd.DataFrame()

    def close(self) -> None:
        pass


def _schema(df: DataFrame, extra: str = "") -> str:
    return ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + extra


def _timed(events: DataFrame, idle: str | None, late: str) -> tuple[DataFrame, int | None, str]:
    """(events, idle time in milliseconds, time mode)."""
    if idle is None:
        return events, None, "None"
    return events.withWatermark("ts", late), int(pd.Timedelta(idle).total_seconds() * 1000), "EventTime"


def emit_on_change_stream(events: DataFrame, idle: str | None = None, late: str = "1 day",
                          run_rows: int = RUN_ROWS) -> DataFrame:
    """T3 on a stream ``(event_id, ts, instance_id, buffer_id, action, forced, fp)``.

    The rows of one key in one micro-batch are ordered in its task within a fixed memory: beyond ``run_rows`` in sorted
    runs that wait in the state store. State is keyed by buffer number and one of ``BUFFER_SHARDS`` shards of the
    instances, with an entry for each instance, so the many small buffers of a batch are handled together. With
    ``idle`` (such as ``"30 days"``) each buffer of each instance is a key with a timer: it leaves the state that long
    after its last event, once the watermark (``late`` behind the newest event) has passed, and its next event emits;
    events later than that are dropped. Without it every buffer is remembered. An event without a fingerprint emits if it is forced or the buffer's first.
    """
    keep_state_on_disk(events.sparkSession)
    timed, idle_ms, mode = _timed(events, idle, late)
    if idle is None:
        # A null in a key reaches Python as NaN, which equals nothing: shards of their own stand for it.
        shard = (F.when(F.col("instance_id").isNull(), BUFFER_SHARDS).otherwise(F.pmod(F.hash("instance_id"), F.lit(BUFFER_SHARDS)))
                 + F.when(F.col("buffer_id").isNull(), NO_BUFFER).otherwise(0))
        dealt = timed.withColumn("_shard", shard).withColumns({c: F.coalesce(c, F.lit(0)) for c in ("instance_id", "buffer_id")})
        grouped, processor = dealt.groupBy("buffer_id", "_shard"), _ChangedBuffers(run_rows)
    else:
        grouped, processor = timed.groupBy("instance_id", "buffer_id"), _ChangedBuffer(idle_ms, run_rows)
    return grouped.transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=_schema(events), outputMode="Append", timeMode=mode)


def enabled_gate_stream(events: DataFrame, idle: str | None = None, late: str = "1 day", shards: int = SHARDS,
                        run_rows: int = RUN_ROWS) -> DataFrame:
    """T4 on a stream: what an instance emits while it is switched on.

    The buffers of an instance are dealt over ``shards`` keys, and each of them gets the toggles of the instance,
    so an instance with a large part of all events is spread over as many tasks, and each shard knows the
    epoch by itself. A toggle clears what a shard remembers. Memory and ``idle`` as in ``emit_on_change_stream``;
    whether an instance is switched on is never forgotten. Without ``idle``, all instances whose numbers leave one
    remainder by ``INSTANCE_KEYS`` are one key (its ``instance_id`` is the remainder, ``INSTANCE_KEYS`` for those without a
    number), their events travel packed, and the key remembers them in pages.
    """
    keep_state_on_disk(events.sparkSession)
    timed, idle_ms, mode = _timed(events, idle, late)
    own = F.pmod(F.hash("buffer_id"), F.lit(shards))
    if idle is None:
        remainder = F.coalesce(F.pmod(F.col("instance_id").cast("bigint"), F.lit(INSTANCE_KEYS)), F.lit(INSTANCE_KEYS))
        keyed = timed.select("*", remainder.cast("bigint").alias("_key"), own.alias("_shard"),
                             F.coalesce(F.col("action") == "toggle", F.lit(False)).alias("_toggle"))
        return keyed.mapInArrow(packing(events.schema, shards), PACKED).groupBy("instance_id", "_shard").transformWithStateInPandas(
            statefulProcessor=GatedShards(events.schema, run_rows), outputStructType=_schema(events, ", epoch bigint"),
            outputMode="Append", timeMode=mode)
    own = F.array(own)
    everywhere = F.sequence(F.lit(0), F.lit(shards - 1))
    dealt = timed.withColumn("_shard", F.explode(F.when(F.col("action") == "toggle", everywhere).otherwise(own)))
    return dealt.groupBy("instance_id", "_shard").transformWithStateInPandas(
        statefulProcessor=_GatedShard(idle_ms, run_rows), outputStructType=_schema(events, ", epoch bigint"),
        outputMode="Append", timeMode=mode)


def _state_before(spark: SparkSession, state: str, batch_id: int, schema: str) -> DataFrame:
    """State after the previous batch; empty before the first."""
    if batch_id == 0:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{state}/version={batch_id - 1}")


def _keep_state(after: DataFrame, state: str, batch_id: int) -> None:
    """Store the state after a batch; a repeated batch replaces its own version."""
    after.write.mode("overwrite").parquet(f"{state}/version={batch_id}")
    spark = after.sparkSession
    old = spark._jvm.org.apache.hadoop.fs.Path(f"{state}/version={batch_id - 2}")
    old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)


PRINTS = "instance_id bigint, buffer_id int, fp bigint"
GATES = "instance_id bigint, buffer_id int, epoch bigint, fp bigint"


def emit_per_batch(target: str, state: str) -> Callable[[DataFrame, int], None]:
    """T3 as a ``foreachBatch`` step over built-in operators.

    The last fingerprints are a small table beside the stream. Within a batch the
    sliced look-back is used, so one buffer may hold a large part of a batch.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        before = _state_before(batch.sparkSession, state, batch_id, PRINTS)
        emit_on_change(batch, before).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")
        _keep_state(last_prints(batch, before), state, batch_id)

    return step


def gate_per_batch(target: str, state: str) -> Callable[[DataFrame, int], None]:
    """T4 as a ``foreachBatch`` step; the state also holds the toggles of each instance.

    A state row without a buffer carries an instance's epoch.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        before = settled(_state_before(batch.sparkSession, state, batch_id, GATES))
        epochs = before.filter("buffer_id IS NULL").select("instance_id", "epoch")
        prints = before.filter("buffer_id IS NOT NULL")
        enabled_gate(batch, epochs, prints).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

        flips = batch.groupBy("instance_id").agg(
            F.count_if(F.col("action") == "toggle").alias("_flips"))
        now = settled(
            flips.join(epochs, "instance_id", "full_outer")
            .select("instance_id", (F.coalesce("epoch", F.lit(0)) + F.coalesce("_flips", F.lit(0))).alias("epoch")))
        after_toggle = last_prints(enabled_gate(batch, epochs, prints, emitted_only=False), prints, ["epoch"])
        kept = lookup(after_toggle, now, ["instance_id", "epoch"], "left_semi", salt_by=F.col("buffer_id"))
        marks = now.withColumn("buffer_id", F.lit(None).cast("int")).withColumn("fp", F.lit(None).cast("bigint"))
        _keep_state(kept.unionByName(marks).select("instance_id", "buffer_id", "epoch", "fp"), state, batch_id)

    return step


def latest_per_batch(target: str, by: list[str]) -> Callable[[DataFrame, int], None]:
    """T5 as a ``foreachBatch`` step: a batch replaces its own folder when it is run again."""

    def step(batch: DataFrame, batch_id: int) -> None:
        latest_wins(batch, by).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return step


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def index_version(spark: SparkSession, target: str) -> int | None:
    """The newest finished version of an index; None before the first."""
    folder, fs = _path(spark, f"{target}/versions")
    return max((int(f.getPath().getName()) for f in fs.listStatus(folder)), default=None) if fs.exists(folder) else None


def read_index(spark: SparkSession, target: str, version: int | None = None) -> DataFrame | None:
    """The catalogue as one version has it: of each unit what the batch that indexed it last has written.

    A reader keeps its version whatever is written meanwhile; its files stay until two newer versions are finished.
    """
    version = index_version(spark, target) if version is None else version
    if version is None:
        return None
    units = spark.read.parquet(f"{target}/units/version={version}")
    batches = [row[0] for row in units.select("batch").distinct().collect()]  # at most MOST_BATCHES + 1
    if not batches:  # no unit has symbols
        return spark.read.parquet(f"{target}/data/batch={version}").filter(F.lit(False))
    rows = spark.read.option("basePath", f"{target}/data").parquet(*[f"{target}/data/batch={k}" for k in batches])
    live = units.withColumn("batch", F.col("batch").cast(rows.schema["batch"].dataType))
    return lookup(rows, live, ["root_key", "batch"], "left_semi", salt_by=F.xxhash64(*rows.columns)).drop("batch")


def reindex_per_batch(units: DataFrame, extract: Callable[[DataFrame], DataFrame],
                      target: str, most_batches: int = MOST_BATCHES, first: int = 0) -> Callable[[DataFrame, int], None]:
    """T6 as a ``foreachBatch`` step: re-extract the touched units and replace their part.

    ``units`` is the corpus with a ``root_key``; the events of a batch carry ``root_key`` and ``forced``. A batch
    writes the symbols of its units beside all others, then the list of all units with the batch that holds each, and
    at last an empty file named by its number: that one creation is the switch, and readers (``read_index``) see all
    of a batch or nothing. A unit without symbols leaves the list. A batch that was finished before does nothing; one
    that was not writes its folders anew. Versions are numbered like batches, from ``first`` on: a new stream, which counts
    its batches from 0 again, is given ``index_version() + 1`` for an index that is there. After the switch, folders go that neither this version nor the
    one before it needs. If more than ``most_batches`` hold something, the symbols of the oldest half are
    written together with those of this batch, so folders and their list stay bounded. With ``units`` stored
    by ``root_key`` only the touched partitions are read: their keys come to the driver if there are at most ``PRUNED_KEYS``
    and become a filter of the scan. A unit with a large part of all symbols is divided over several files.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        spark, batch_id = batch.sparkSession, first + batch_id
        current = index_version(spark, target)
        if current is not None and current >= batch_id:
            return
        touched = settled(batch.filter("forced AND root_key IS NOT NULL").select("root_key").distinct())
        keys = [row[0] for row in touched.limit(PRUNED_KEYS + 1).collect()]
        asked = units.filter(F.col("root_key").isin(keys)) if len(keys) <= PRUNED_KEYS else units
        symbols = settled(extract(lookup(asked, touched, ["root_key"], "left_semi", salt_by=F.col("path"))))
        found = symbols.select("root_key").distinct().withColumn("batch", F.lit(batch_id))
        if current is None:
            listed, written = found, symbols
        else:
            kept = settled(spark.read.parquet(f"{target}/units/version={current}").join(touched, "root_key", "left_anti"))
            holding = sorted(row[0] for row in kept.select("batch").distinct().collect())  # at most most_batches + 1
            merged = holding[:len(holding) // 2] if len(holding) > most_batches else []
            written = symbols
            if merged:
                rows = spark.read.option("basePath", f"{target}/data").parquet(*[f"{target}/data/batch={k}" for k in merged])
                live = kept.filter(F.col("batch").isin(merged)).withColumn("batch", F.col("batch").cast(rows.schema["batch"].dataType))
                moved = lookup(rows, live, ["root_key", "batch"], "left_semi", salt_by=F.xxhash64(*rows.columns))
                written = symbols.unionByName(moved.select(*symbols.columns))
            listed = kept.withColumn("batch", F.when(F.col("batch").isin(merged), batch_id).otherwise(F.col("batch"))).unionByName(found)
        (written.hint("rebalance", "root_key").sortWithinPartitions("root_key")
         .write.mode("overwrite").parquet(f"{target}/data/batch={batch_id}"))
        listed.select("root_key", F.col("batch").cast("bigint").alias("batch")).write.mode("overwrite").parquet(
            f"{target}/units/version={batch_id}")
        marker, fs = _path(spark, f"{target}/versions/{batch_id}")
        fs.create(marker, False).close()
        _forget(spark, target, batch_id, current)

    return step


def _forget(spark: SparkSession, target: str, version: int, before: int | None) -> None:
    """Delete the folders that neither of the two newest versions needs."""
    kept = [v for v in (version, before) if v is not None]
    needed = {f"batch={row[0]}" for v in kept
              for row in spark.read.parquet(f"{target}/units/version={v}").select("batch").distinct().collect()}
    for folder, names in (("versions", {str(v) for v in kept}), ("units", {f"version={v}" for v in kept}),
                          ("data", needed | {f"batch={version}"})):
        path, fs = _path(spark, f"{target}/{folder}")
        for below in fs.listStatus(path):
            if below.getPath().getName() not in names:
                fs.delete(below.getPath(), True)


def run_to_table(stream: DataFrame, label: str, checkpoint: str | None = None,
                 target: str | None = None) -> str:
    """Process what is there into a Parquet folder and stop; returns the folder."""
    spark = stream.sparkSession
    target = target or new_folder(spark, label)
    checkpoint = checkpoint or new_folder(spark, f"{label}-progress")
    query = (stream.writeStream.format("parquet").outputMode("append")
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start(target))
    query.awaitTermination()
    return target


def run_steps(stream: DataFrame, step: Callable[[DataFrame, int], None], label: str,
              checkpoint: str | None = None) -> None:
    """Process what is there with a ``foreachBatch`` step and stop."""
    checkpoint = checkpoint or new_folder(stream.sparkSession, f"{label}-progress")
    query = (stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()
