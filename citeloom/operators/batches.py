"""Arrow batches of bounded size: a task's memory must not follow the number of long texts that stand in one batch."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

#: Bytes that a piece has at most, unless one value is larger.
BYTES = 1 << 20


def cuts(values: pa.Array, limit: int = BYTES) -> Iterator[tuple[int, int]]:
    """From where to where values (strings, or lists of strings) are cut so that each piece has few bytes; a single large value stays whole."""
    ends = values.offsets.to_numpy() if not pa.types.is_string(values.type) else None
    if ends is not None:
        words = values.values
        ends = _offsets(words)[ends]
    else:
        ends = _offsets(values)
    a = 0
    while a < len(values):
        b = max(a + 1, int(ends.searchsorted(ends[a] + limit, "right")) - 1)
        yield a, min(b, len(values))
        a = min(b, len(values))


def _offsets(strings: pa.Array):
    import numpy as np

    return np.frombuffer(strings.buffers()[1], np.int32)[strings.offset : strings.offset + len(strings) + 1] if len(strings) else np.zeros(1, np.int32)


def small(batches: Iterator[pa.RecordBatch], column: str, limit: int = BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose column of strings has few bytes."""
    for batch in batches:
        for a, b in cuts(batch.column(column), limit):
            yield batch.slice(a, b - a)
