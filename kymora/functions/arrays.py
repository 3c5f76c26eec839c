"""Lists of Arrow batches as numpy arrays, and work on rows in steps of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of results that are handed on together.
STEP_BYTES = 4 << 20


def list_values(column: pa.Array) -> list[np.ndarray | pa.Array]:
    """Values of a list column end to end: one array, or of structs one for each field; binary values stay as they are."""
    values = column.flatten()
    parts = values.flatten() if pa.types.is_struct(values.type) else [values]
    return [v if pa.types.is_binary(v.type) else v.to_numpy(zero_copy_only=False) for v in parts]


def row_steps(batches: Iterator[pa.RecordBatch], work: Callable[[pa.RecordBatch], Iterator[list[np.ndarray]]], limit: int = STEP_BYTES) -> Iterator[tuple[pa.RecordBatch, list[list[np.ndarray]]]]:
    """Rows with the arrays that ``work`` gives for each of them, as many at a time as give ``limit`` bytes (one at least)."""
    for batch in batches:
        first, held, size = 0, [], 0
        for k, result in enumerate(work(batch)):
            held.append(result)
            size += sum(r.nbytes for r in result)
            if size >= limit:
                yield batch.slice(first, k + 1 - first), held
                first, held, size = k + 1, [], 0
        if held:
            yield batch.slice(first), held
