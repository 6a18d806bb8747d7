"""Whole groups from the Arrow batches of a task whose rows are sorted by key."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def starts_of(*keys: np.ndarray) -> np.ndarray:
    """Positions where a run of equal keys starts, then the number of rows."""
    n = len(keys[0])
    changed = np.zeros(n, bool)
    if n:
        changed[0] = True
    for key in keys:
        changed[1:] |= key[1:] != key[:-1]
    return np.append(np.flatnonzero(changed), n)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], least_rows: int = 50_000) -> Iterator[pa.Table]:
    """Tables that hold only whole groups, of about ``least_rows`` rows; rows arrive sorted by key."""
    held: list[pa.Table] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(pa.Table.from_batches([batch]))
        rows += batch.num_rows
        if rows < least_rows:
            continue
        table = pa.concat_tables(held).combine_chunks()
        last = int(starts_of(*(table.column(k).to_numpy() for k in keys))[-2])
        if last:
            yield table.slice(0, last)
        held, rows = [table.slice(last)], table.num_rows - last
    if rows:
        yield pa.concat_tables(held).combine_chunks()


def cut_groups(batches: Iterator[pa.RecordBatch], keys: list[str], least_rows: int = 50_000, most_rows: int = 400_000) -> Iterator[tuple[pa.Table, bool]]:
    """As ``whole_groups``, with False; but a group of more than ``most_rows`` rows comes in
    pieces of its own, with True, so that no group is held whole."""
    held: list[pa.Table] = []
    rows, inside = 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(pa.Table.from_batches([batch]))
        rows += batch.num_rows
        if rows < least_rows:
            continue
        table = pa.concat_tables(held).combine_chunks()
        edges = starts_of(*(table.column(k).to_numpy() for k in keys))
        key = lambda r: tuple(table.column(k)[int(r)].as_py() for k in keys)
        start = 0
        if inside is not None and key(0) == inside:
            start = int(edges[1])
            yield table.slice(0, start), True
            edges = edges[1:]
        if start == table.num_rows:
            held, rows = [], 0
            continue
        last = int(edges[-2])
        if last > start:
            yield table.slice(start, last - start), False
        held, rows, inside = [table.slice(last)], table.num_rows - last, None
        if rows > most_rows:
            inside = key(last)
            yield held[0], True
            held, rows = [], 0
    if rows:
        table = pa.concat_tables(held).combine_chunks()
        edges = starts_of(*(table.column(k).to_numpy() for k in keys))
        start = int(edges[1]) if inside is not None and tuple(table.column(k)[0].as_py() for k in keys) == inside else 0
        if start:
            yield table.slice(0, start), True
        if start < table.num_rows:
            yield table.slice(start), False
