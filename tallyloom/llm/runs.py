"""Groups of rows that arrive sorted, as Arrow batches, inside a task."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def sorted_runs(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[list[np.ndarray]]:
    """The columns of each run of at least two rows with equal first column. Only one run is held at a time."""
    held: list[list[np.ndarray]] = []

    def joined() -> list[np.ndarray]:
        return [np.concatenate([h[c] for h in held]) for c in range(width)]

    for batch in batches:
        columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in range(width)]
        key = columns[0]
        if not len(key):
            continue
        cuts = np.flatnonzero(key[1:] != key[:-1]) + 1
        starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(key)]])
        if held and held[0][0][0] != key[0]:
            if sum(len(h[0]) for h in held) > 1:
                yield joined()
            held = []
        if len(starts) > 1:
            held.append([c[:ends[0]] for c in columns])
            if sum(len(h[0]) for h in held) > 1:
                yield joined()
            held = []
            inner = np.flatnonzero(ends[1:-1] - starts[1:-1] > 1) + 1
            for s, e in zip(starts[inner], ends[inner]):
                yield [c[s:e] for c in columns]
            held.append([c[starts[-1]:] for c in columns])
        else:
            held.append(columns)
    if held and sum(len(h[0]) for h in held) > 1:
        yield joined()


def whole_runs(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[list[np.ndarray]]:
    """The columns of many rows at a time, cut only where the first column changes."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in range(width)]
        if not len(columns[0]):
            continue
        changes = np.flatnonzero(columns[0][1:] != columns[0][:-1]) + 1
        cut = int(changes[-1]) if len(changes) else 0
        if cut or held and held[-1][0][-1] != columns[0][0]:
            yield [np.concatenate([*(h[c] for h in held), columns[c][:cut]]) for c in range(width)]
            held = []
        held.append([c[cut:] for c in columns])
    if held:
        yield [np.concatenate([h[c] for h in held]) for c in range(width)]
