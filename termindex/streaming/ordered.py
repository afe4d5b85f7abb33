"""Rows of one key of a micro-batch in order, within a fixed memory.

A stateful processor gets the rows of a key in pieces and in no order. Up to
``RUN_ROWS`` of them are sorted in memory. More are sorted in runs of that size, and the
runs are kept as pages in the key's own state until they are merged, at most
``FAN_IN`` runs at a time and one page of each in memory. The pages go as they are read;
an attempt that fails commits none of them.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql.streaming import StatefulProcessorHandle

RUN_ROWS = 50_000
PAGE_ROWS = 1_000
FAN_IN = 32


class Runs:
    """Sorted runs of one key in a map state ``(run, page) -> rows``."""

    def __init__(self, handle: StatefulProcessorHandle, order: list[str], run_rows: int = RUN_ROWS,
                 page_rows: int = PAGE_ROWS, fan_in: int = FAN_IN):
        self._pages = handle.getMapState("pages", "run int, page int", "rows binary")
        self.order, self.run_rows, self.page_rows, self.fan_in = order, run_rows, page_rows, fan_in

    def _put(self, run: int, page: int, rows: pd.DataFrame) -> None:
        packed = io.BytesIO()
        rows.reset_index(drop=True).to_feather(packed, compression="lz4")
        self._pages.updateValue((run, page), (packed.getvalue(),))

    def _take(self, run: int, page: int) -> pd.DataFrame:
        rows = pd.read_feather(io.BytesIO(bytes(self._pages.getValue((run, page))[0])))
        self._pages.removeKey((run, page))
        return rows

    def _store(self, run: int, blocks: Iterator[pd.DataFrame]) -> int:
        """Keep sorted blocks as one run; returns its number of pages."""
        page = 0
        for block in blocks:
            for begin in range(0, len(block), self.page_rows):
                self._put(run, page, block.iloc[begin:begin + self.page_rows])
                page += 1
        return page

    def _merged(self, runs: dict[int, int]) -> Iterator[pd.DataFrame]:
        """Sorted blocks of several runs, given as run -> number of pages."""
        heads = {run: (self._take(run, 0), 1) for run, pages in runs.items() if pages}
        while heads:
            ends = [tuple(head[c].to_numpy()[-1] for c in self.order) for run, (head, page) in heads.items() if page < runs[run]]
            upto, ready = min(ends, default=None), []
            for run, (head, page) in list(heads.items()):
                n = len(head) if upto is None else self._until(head, upto)
                ready.append(head.iloc[:n])
                if n < len(head):
                    heads[run] = (head.iloc[n:], page)
                elif page < runs[run]:
                    heads[run] = (self._take(run, page), page + 1)
                else:
                    del heads[run]
            yield pd.concat(ready, ignore_index=True).sort_values(self.order, ignore_index=True)

    def _until(self, rows: pd.DataFrame, bound: tuple) -> int:
        """How many of the sorted rows are not after the bound."""
        low, high = 0, len(rows)
        for column, value in zip(self.order, bound, strict=True):
            of = rows[column].to_numpy()[low:high]
            low, high = low + int(np.searchsorted(of, value, "left")), low + int(np.searchsorted(of, value, "right"))
        return high

    def ordered(self, pieces: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The rows of all pieces as blocks, each sorted, none before the one ahead of it."""
        held, count, runs = [], 0, {}

        def block() -> pd.DataFrame:
            rows = held[0] if len(held) == 1 else pd.concat(held, ignore_index=True)
            if len(rows) == 1:
                return rows
            return rows.take(np.lexsort([rows[c].to_numpy() for c in reversed(self.order)])).reset_index(drop=True)

        for piece in pieces:
            held.append(piece)
            count += len(piece)
            if count >= self.run_rows:
                runs[len(runs)] = self._store(len(runs), iter([block()]))
                held, count = [], 0
        if not runs:
            if count:
                yield block()
            return
        if count:
            runs[len(runs)] = self._store(len(runs), iter([block()]))
            held = []
        last = max(runs)
        while len(runs) > self.fan_in:
            some = {run: runs.pop(run) for run in sorted(runs)[:self.fan_in]}
            last += 1
            runs[last] = self._store(last, self._merged(some))
        yield from self._merged(runs)
