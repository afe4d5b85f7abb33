"""The gate of many instances at once: events packed into blobs, and what is remembered of instances in pages."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from termindex.streaming.ordered import Runs

PACKED_ROWS = 200_000  # events held by a task while it packs
BLOB_ROWS = 128  # of them in a blob at most, so that many blobs of a hot key are no large batch
FRAME_ROWS = 10_000  # unpacked at once
PAGE_INSTANCES = 1024  # in a page before the number of pages is doubled
ORDERED = ["instance_id", "ts", "event_id"]
PACKED = "instance_id bigint, _shard int, events binary, toggles binary"
_LAST = 2**63 - 1  # a null time or event comes last


def packing(schema: StructType, shards: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Packs batches of the columns of ``schema`` and (_key, _shard, _toggle): rows ``PACKED``, many events each.

    An event goes to the key and shard it names, a toggle to all shards of its key and with nothing but its order.
    """
    kept, names = to_arrow_schema(schema), schema.names

    def flushed(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        toggle = table["_toggle"].to_numpy()
        key, own = table["_key"].to_numpy().astype(np.int64), table["_shard"].to_numpy()
        rows: list[tuple[int, int, bytes | None, bytes | None]] = []
        at = np.flatnonzero(~toggle)
        dealt = key[at] * shards + own[at]
        order = np.argsort(dealt, kind="stable")
        events = table.select(names).take(pa.array(at[order])).cast(kept).combine_chunks().to_batches()
        for begin, end in _stretches(dealt[order]):
            rows.append((*divmod(int(dealt[order[begin]]), shards), events[0].slice(begin, end - begin).serialize().to_pybytes(), None))
        at = np.flatnonzero(toggle)
        order = np.argsort(key[at], kind="stable")
        flips = table.select(ORDERED).take(pa.array(at[order]))
        flips = np.stack([_numbers(flips[c].combine_chunks(), _LAST if c != "instance_id" else 0) for c in ORDERED])
        for begin, end in _stretches(key[at][order]):
            told = np.ascontiguousarray(flips[:, begin:end]).tobytes()
            rows += [(int(key[at[order[begin]]]), shard, None, told) for shard in range(shards)]
        for begin in range(0, len(rows), 1000):
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(
                zip(*rows[begin:begin + 1000], strict=True), (pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)],
                names=["instance_id", "_shard", "events", "toggles"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count >= PACKED_ROWS:
                yield from flushed(held)
                held, count = [], 0
        if count:
            yield from flushed(held)

    return run


def _stretches(sorted_keys: np.ndarray) -> Iterator[tuple[int, int]]:
    """(begin, end) of the rows of one key, ``BLOB_ROWS`` at most."""
    bounds = [*np.flatnonzero(np.diff(sorted_keys, prepend=sorted_keys[:1] - 1)).tolist(), len(sorted_keys)]
    for first, last in zip(bounds, bounds[1:], strict=False):
        for begin in range(first, last, BLOB_ROWS):
            yield begin, min(begin + BLOB_ROWS, last)


def _numbers(column: pa.Array, null: int) -> np.ndarray:
    """A column of numbers or times in 64 bits."""
    return pc.fill_null(pc.cast(column, pa.int64()), null).to_numpy(zero_copy_only=False)


class _Frames:
    """Blobs as frames of events and back to columns: numbers and times in 64 bits beside a mark of their nulls."""

    def __init__(self, schema: StructType):
        self.schema = to_arrow_schema(schema)
        whole = lambda t: pa.types.is_integer(t) or pa.types.is_timestamp(t)
        self.numbers = {f.name for f in self.schema if whole(f.type)}
        self.flags = {f.name for f in self.schema if pa.types.is_boolean(f.type)}

    def unpacked(self, pieces: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        events, toggles, count = [], [], 0
        for piece in pieces:
            for packed, told in zip(piece["events"], piece["toggles"], strict=True):
                if packed is not None:
                    events.append(pa.ipc.read_record_batch(pa.py_buffer(packed), self.schema))
                    count += events[-1].num_rows
                else:
                    toggles.append(np.frombuffer(told, np.int64).reshape(3, -1))
                    count += toggles[-1].shape[1]
                if count >= FRAME_ROWS:
                    yield self._frame(events, toggles)
                    events, toggles, count = [], [], 0
        if count:
            yield self._frame(events, toggles)

    def _frame(self, events: list[pa.RecordBatch], toggles: list[np.ndarray]) -> pd.DataFrame:
        table = pa.Table.from_batches(events, self.schema).combine_chunks()
        flips = np.concatenate([np.zeros((3, 0), np.int64), *toggles], axis=1)
        more = flips.shape[1]
        columns = {"_toggle": np.repeat([False, True], [len(table), more])}
        for name in self.schema.names:
            column = table[name]
            if name in self.numbers:
                values = _numbers(column, _LAST if name in ORDERED and name != "instance_id" else 0)
                rest = flips[ORDERED.index(name)] if name in ORDERED else np.zeros(more, np.int64)
            elif name in self.flags:
                values, rest = pc.fill_null(column, False).to_numpy(), np.zeros(more, bool)
            else:
                values, rest = column.to_pandas().to_numpy(dtype=object), np.full(more, None, object)
            columns[name] = np.concatenate([values, rest])
            if name in self.numbers or name in self.flags:
                columns[f"null {name}"] = np.concatenate([pc.is_null(column).to_numpy(), np.zeros(more, bool)])
        return pd.DataFrame(columns)

    def rows(self, frame: pd.DataFrame, epochs: np.ndarray) -> pd.DataFrame:
        """The columns of the events, and their epochs."""
        columns = {}
        for field in self.schema:
            name, values = field.name, frame[field.name]
            if name in self.numbers or name in self.flags:
                values, missing = values.to_numpy(), frame[f"null {name}"].to_numpy()
                if pa.types.is_timestamp(field.type):
                    values = pd.Series(np.where(missing, np.datetime64("NaT"), values.astype("datetime64[us]")))
                    values = values.dt.tz_localize("UTC") if field.type.tz else values
                elif missing.any():
                    values = (pd.arrays.BooleanArray if name in self.flags else pd.arrays.IntegerArray)(values.copy(), missing.copy())
            else:
                values = values.to_numpy()
            columns[name] = values
        return pd.DataFrame(columns | {"epoch": epochs})


def gated(ids: np.ndarray, toggle: np.ndarray, buffers: np.ndarray, no_buffer: np.ndarray, prints: np.ndarray,
          no_print: np.ndarray, forced: np.ndarray, known: tuple[np.ndarray, np.ndarray], last: np.ndarray):
    """Events in order of (instance, time) against what is known: (places that emit, their epochs, instances, toggles, prints).

    ``known`` are instances in order and their toggles so far, ``last`` the last prints, as (instance, buffer, print). What
    comes back of these is how they are after the events, of the instances of the events alone.
    """
    new = np.diff(ids, prepend=ids[:1] - 1) != 0
    num, instances = np.cumsum(new) - 1, ids[new]
    flips = np.cumsum(toggle)
    ahead = (flips - toggle)[new]  # toggles of the instances before
    start = np.zeros(len(instances), np.int64)
    if len(known[0]):
        at = np.minimum(np.searchsorted(known[0], instances), len(known[0]) - 1)
        start = np.where(known[0][at] == instances, known[1][at], 0)
    epochs = start[num] + flips - ahead[num]
    on = ~toggle & (epochs % 2 == 0)
    after = epochs[np.append(np.flatnonzero(new)[1:], len(ids)) - 1]

    at = np.searchsorted(instances, last[0])
    at = np.minimum(at, len(instances) - 1)
    held = last[:, instances[at] == last[0]]
    whose = np.searchsorted(instances, held[0])
    rows = np.flatnonzero(on & ~no_buffer)
    # What is remembered stands in front of the events of its buffer; a toggle begins another stretch.
    stretch = np.concatenate([whose + ahead[whose], (num + flips)[rows]])
    buffer = np.concatenate([held[1], buffers[rows]])
    value = np.concatenate([held[2], prints[rows]])
    has = np.concatenate([np.ones(len(whose), bool), ~no_print[rows]])
    order = np.lexsort((buffer, stretch))
    s, b, v, h = stretch[order], buffer[order], value[order], has[order]
    first = np.ones(len(s), bool)
    first[1:] = (s[1:] != s[:-1]) | (b[1:] != b[:-1])
    begins = np.flatnonzero(first)[np.cumsum(first) - 1] if len(s) else np.zeros(0, np.int64)
    filled = np.maximum.accumulate(np.where(h, np.arange(len(s)), -1)) if len(s) else begins
    before = np.append(-1, filled[:-1])[:len(s)]
    changed = (before < begins) | (h & (v != v[before]))
    emits = on & (forced | no_buffer)
    event = order >= len(whose)
    emits[rows[order[event] - len(whose)]] |= changed[event]
    places = np.flatnonzero(emits)

    ends = np.append(np.flatnonzero(first)[1:], len(s)) - 1 if len(s) else begins
    owner = np.concatenate([whose, num[rows]])[order][ends]
    epoch = np.concatenate([start[whose], epochs[rows]])[order][ends]
    stays = (filled[ends] >= begins[ends]) & (epoch == after[owner])
    told = np.stack([instances[owner[stays]], b[ends[stays]], v[filled[ends[stays]]]])
    return places, epochs[places], instances, after, told


class _Pages:
    """What a key remembers of its instances: toggles and last prints, in pages by a hash of the instance.

    A page holds ``PAGE_INSTANCES`` instances: when one has more, the number of pages doubles. A batch reads and writes
    the pages of its instances, a bounded part of the state for each, however many others the key has.
    """

    def __init__(self, handle: StatefulProcessorHandle):
        self._held = handle.getMapState("epoch", "page int", "epochs binary, prints binary")
        self._count = handle.getValueState("count", "pages int")

    @staticmethod
    def _page(ids: np.ndarray, count: int) -> np.ndarray:
        mixed = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(32)).astype(np.int64) & (count - 1)

    def _read(self, page: int) -> tuple[np.ndarray, np.ndarray]:
        found = self._held.getValue((page,))
        epochs, prints = (np.frombuffer(bytes(x), np.int64) for x in found) if found else (np.zeros(0, np.int64),) * 2
        return epochs.reshape(2, -1), prints.reshape(3, -1)

    def _write(self, page: int, epochs: np.ndarray, prints: np.ndarray) -> None:
        self._held.updateValue((page,), (np.ascontiguousarray(epochs).tobytes(), np.ascontiguousarray(prints).tobytes()))

    def pass_through(self, ids: np.ndarray, *rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places that emit, their epochs) of events in order; what is remembered afterwards is stored."""
        state = self._count.get()
        count = state[0] if state else 1
        of = self._page(ids[np.diff(ids, prepend=ids[:1] - 1) != 0], count)
        pages = {page: self._read(page) if state else (np.zeros((2, 0), np.int64), np.zeros((3, 0), np.int64))
                 for page in np.unique(of).tolist()}
        known = np.concatenate([e for e, _ in pages.values()], axis=1)
        last = np.concatenate([p for _, p in pages.values()], axis=1)
        known = known[:, np.argsort(known[0])]
        places, epochs, instances, after, prints = gated(ids, *rest, (known[0], known[1]), last)
        if not state:
            self._count.update((count,))
        of, of_prints, most = self._page(instances, count), self._page(prints[0], count), 0
        for page, (old, old_prints) in pages.items():
            here = of == page
            own = np.stack([instances[here], after[here]])
            merged = np.concatenate([old[:, ~np.isin(old[0], own[0])], own], axis=1)
            told = np.concatenate([old_prints[:, ~np.isin(old_prints[0], own[0])], prints[:, of_prints == page]], axis=1)
            if merged.shape != old.shape or told.shape != old_prints.shape or not (
                    np.array_equal(_sorted(merged), _sorted(old)) and np.array_equal(_sorted(told), _sorted(old_prints))):
                self._write(page, merged, told)
            most = max(most, merged.shape[1])
        while most > PAGE_INSTANCES:
            most = self._double(count)
            count *= 2
        return places, epochs

    def _double(self, count: int) -> int:
        """Cut each page in two; returns the size of the largest."""
        most = 0
        for page in range(count):
            epochs, prints = self._read(page)
            of, of_prints = self._page(epochs[0], 2 * count), self._page(prints[0], 2 * count)
            for half in (page, page + count):
                self._write(half, epochs[:, of == half], prints[:, of_prints == half])
                most = max(most, int((of == half).sum()))
        self._count.update((2 * count,))
        return most


def _sorted(rows: np.ndarray) -> np.ndarray:
    return rows[:, np.lexsort(rows[::-1])]


class GatedShards(StatefulProcessor):
    """State of a shard of all instances of one remainder: their toggles and the last fingerprints of their buffers."""

    def __init__(self, schema: StructType, run_rows: int):
        self._schema, self._run_rows = schema, run_rows

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._frames, self._pages = _Frames(self._schema), _Pages(handle)
        self._runs = Runs(handle, ORDERED, self._run_rows)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        names = ("instance_id", "_toggle", "buffer_id", "null buffer_id", "fp", "null fp", "forced")
        for block in self._runs.ordered(self._frames.unpacked(rows)):
            places, epochs = self._pages.pass_through(*(block[c].to_numpy() for c in names))
            if len(places):
                emitted = block.take(places).reset_index(drop=True)
                yield self._frames.rows(emitted, epochs)

    def close(self) -> None:
        pass
