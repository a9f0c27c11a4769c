"""Columns of numbers packed into binary cells, so that a shuffle moves few rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def dealt(part: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch | None:
    """One row (p, cells) for each part; ``part`` and the columns are sorted by part."""
    if not len(part):
        return None
    cuts = np.flatnonzero(np.diff(part)) + 1
    cuts = np.concatenate(([0], cuts, [len(part)]))
    cells = [pa.array([c[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()) for c in columns]
    return pa.RecordBatch.from_arrays([pa.array(part[cuts[:-1]].astype(np.int64)), *cells], ["p", *[f"c{k}" for k in range(len(columns))]])


def gathered(table: pa.Table, column: str, dtype) -> np.ndarray:
    cells = [np.frombuffer(x.as_buffer(), dtype) for x in table[column] if x.is_valid]
    return np.concatenate(cells) if cells else np.zeros(0, dtype)


def summed(keys: np.ndarray, *counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, with the sums of their counts."""
    if not len(keys):
        return (keys, *counts)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return (keys[first], *[np.add.reduceat(c[order], first) for c in counts])


def top_bits(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)


def bits_for(n: float) -> int:
    return max(1, int(np.ceil(np.log2(max(2.0, n)))))
