"""Streaming over rows sorted by a key, in constant memory however many rows a key has."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def columns(b: pa.RecordBatch) -> dict[str, np.ndarray]:
    return {n: b.column(n).to_numpy(zero_copy_only=False) for n in b.schema.names}


def runs(batches: Iterator[pa.RecordBatch], keys: list[str], value: str) -> Iterator[tuple[dict, np.ndarray, np.ndarray]]:
    """Of rows sorted by `keys`: the columns, the `value` of the first row with the same keys, and whether another row
    has them too. The last row of a batch waits for the next batch; nothing else is kept."""
    held: dict | None = None
    before: tuple | None = None  # keys and first value of the run that came before what is held

    def emit(cols: dict, last: bool):
        nonlocal before
        n = len(cols[value])
        change = np.zeros(n + 1, bool)
        for k in keys:
            change[1:n] |= cols[k][1:] != cols[k][:-1]
        change[0] = before is None or any(cols[k][0] != v for k, v in zip(keys, before[0]))
        change[n] = True
        at = np.maximum.accumulate(np.where(change[:n], np.arange(n), -1))
        first = cols[value][np.maximum(at, 0)].copy()
        if not change[0]:
            first[at < 0] = before[1]
        again = ~change[:n]
        again[:-1] |= ~change[1:n]
        stop = n if last else n - 1
        if stop:
            before = (tuple(cols[k][stop - 1] for k in keys), first[stop - 1])
        return {k: v[:stop] for k, v in cols.items()}, first[:stop], again[:stop]

    for b in batches:
        if not b.num_rows:
            continue
        cols = columns(b)
        if held is not None:
            cols = {k: np.concatenate([held[k], v]) for k, v in cols.items()}
        out = emit(cols, False)
        if len(out[1]):
            yield out
        held = {k: v[-1:] for k, v in cols.items()}
    if held is not None:
        yield emit(held, True)


def others(batches: Iterator[pa.RecordBatch], keys: list[str], value: str) -> Iterator[tuple[dict, np.ndarray, np.ndarray]]:
    """Of rows sorted by `keys` and `value`: the columns, the `value` of the first row with the same keys, and whether a row
    with the same keys has another value. Rows wait while all of their keys so far have one value."""
    held: dict | None = None
    before: tuple | None = None  # keys, first value and answer of a run that goes on

    def emit(cols: dict, last: bool):
        nonlocal before, held
        n = len(cols[value])
        new = np.ones(n, bool)
        new[1:] = np.logical_or.reduce([cols[k][1:] != cols[k][:-1] for k in keys])
        start = np.flatnonzero(new)
        run = np.cumsum(new) - 1
        first = cols[value][start].copy()
        many = np.zeros(len(start), bool)
        if before is not None and all(cols[k][0] == v for k, v in zip(keys, before[0])):
            first[0], many[0] = before[1:]
        many |= np.logical_or.reduceat(cols[value] != first[run], start)
        stop = n if last or many[-1] else start[-1]
        before = (tuple(cols[k][-1] for k in keys), first[-1], many[-1])
        held = {k: v[stop:] for k, v in cols.items()} if stop < n else None
        return {k: v[:stop] for k, v in cols.items()}, first[run][:stop], many[run][:stop]

    for b in batches:
        if b.num_rows:
            cols = columns(b)
            if held is not None:
                cols = {k: np.concatenate([held[k], v]) for k, v in cols.items()}
            out = emit(cols, False)
            if len(out[1]):
                yield out
    if held is not None:
        yield emit(held, True)


def lists(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a list column; null is empty."""
    import pyarrow.compute as pc

    n = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return col.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(n)])
