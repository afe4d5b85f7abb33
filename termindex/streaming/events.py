"""Editor events: routing, reading as a stream, and skew-proof batch forms.

The batch forms serve history and tests: they compute over any number of events
what the stream emits when the same events arrive in order of (ts, event_id).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termindex.operators.joins import lookup
from termindex.operators.slices import cut, running_last, running_sum

ORDER = ["ts", "event_id"]


def read_events(spark: SparkSession, folder: str, schema: str, pattern: str = "*.parquet",
                max_files: int | None = None) -> DataFrame:
    """Parquet event files as a stream; ``max_files`` bounds each micro-batch."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(folder)


def route(events: DataFrame, actions: DataFrame) -> DataFrame:
    """Event name -> (action, forced); events without an action are dropped."""
    return events.join(actions, "event")


def first_seen(events: DataFrame, horizon: str | None = None) -> DataFrame:
    """Buffers with unforced work, each once (T2). Works on streams and tables.

    A stream remembers every buffer; with a ``horizon`` such as ``"30 days"`` it
    forgets a buffer that long after its first event, and then reports it anew.
    """
    buffer = ["instance_id", "buffer_id"]
    unforced = events.filter(~F.col("forced"))
    if horizon is None:
        return unforced.select(*buffer).dropDuplicates(buffer)
    timed = unforced.select(*buffer, F.col("ts").cast("timestamp").alias("ts"))
    return (timed.withWatermark("ts", horizon).dropDuplicatesWithinWatermark(buffer)
            .select(*buffer))


def _with_earlier(events: DataFrame, earlier: DataFrame | None) -> DataFrame:
    """Put remembered fingerprints before the events, marked as ``_earlier``."""
    events = events.withColumn("_earlier", F.lit(False))
    if earlier is None:
        return events
    return events.unionByName(earlier.withColumn("_earlier", F.lit(True)), allowMissingColumns=True)


def _changed(events: DataFrame, buffer: list[str], earlier: DataFrame | None) -> DataFrame:
    # Remembered rows have no time and sort first.
    sliced = cut(_with_earlier(events, earlier), buffer, ORDER)
    seen = running_last(sliced, buffer, ORDER, F.col("fp"), "_last", with_current=False)
    changed = F.col("_last").isNull() | (F.col("_last") != F.col("fp")) | F.col("forced")
    return seen.filter(~F.col("_earlier") & changed).select(*events.columns)


def emit_on_change(events: DataFrame, earlier: DataFrame | None = None) -> DataFrame:
    """Events that emit: forced, or a fingerprint unlike the buffer's last one.

    ``earlier(instance_id, buffer_id, fp)`` is what was known before the events.
    """
    return _changed(events, ["instance_id", "buffer_id"], earlier)


def last_prints(events: DataFrame, earlier: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Last fingerprint of each buffer after the events."""
    keys = ["instance_id", "buffer_id", *(extra or [])]
    everything = _with_earlier(events.select(*keys, *ORDER, "fp"), earlier.select(*keys, "fp"))
    position = F.struct((~F.col("_earlier")).alias("new"), *[F.col(c) for c in ORDER])
    return everything.groupBy(*keys).agg(F.max_by("fp", position).alias("fp"))


def enabled_gate(events: DataFrame, epochs: DataFrame | None = None, earlier: DataFrame | None = None,
                 emitted_only: bool = True) -> DataFrame:
    """Emit on change while switched on; every ``toggle`` action flips an instance (T4).

    Adds ``epoch``, the number of toggles so far. Nothing is remembered across a
    toggle. ``epochs(instance_id, epoch)`` and ``earlier(instance_id, buffer_id,
    epoch, fp)`` are what was known before the events. Without ``emitted_only``
    all events of switched-on times are returned.
    """
    sliced = cut(events, ["instance_id"], ORDER)
    flips = F.when(F.col("action") == "toggle", 1).otherwise(0)
    counted = running_sum(sliced, ["instance_id"], ORDER, flips, "epoch").drop("_slice")
    if epochs is not None:
        base = epochs.withColumnRenamed("epoch", "_base")
        counted = (lookup(counted, base, ["instance_id"], "left", salt_by=F.col("event_id"))
                   .withColumn("epoch", F.col("epoch") + F.coalesce("_base", F.lit(0))).drop("_base"))
    enabled = counted.filter((F.col("action") != "toggle") & (F.col("epoch") % 2 == 0))
    enabled = enabled.select(*events.columns, "epoch")
    return _changed(enabled, ["instance_id", "buffer_id", "epoch"], earlier) if emitted_only else enabled


def latest_wins(events: DataFrame, by: list[str]) -> DataFrame:
    """The last event of each instance in each slice (T5).

    A maximum per key, combined before the shuffle.
    """
    keys = ["instance_id", *by]
    rest = [c for c in events.columns if c not in keys and c not in ORDER]
    last = events.groupBy(*keys).agg(F.max(F.struct(*ORDER, *rest)).alias("_last"))
    return last.select(*keys, *[F.col(f"_last.{c}").alias(c) for c in [*ORDER, *rest]])
